"""Registered queries against their SQL, on the smallest tables."""

import pytest

from spanforge import catalog
from tests.conftest import rows_of

# One in four, in name order, and the flagship: the driver compares all of them.
NAMES = sorted(catalog.ORACLES)[::4] + ["cnd_top_candidates"]


@pytest.mark.parametrize("name", sorted(set(NAMES)))
def test_query_equals_sql(spark, duck, sf_dir, name):
    import pandas as pd

    got = catalog.QUERIES[name](spark, sf_dir).toPandas()
    want = duck.execute(catalog.ORACLES[name]).df()
    for f in (got, want):
        for c in f.columns:
            if "datetime" in str(f[c].dtype):
                f[c] = f[c].astype("datetime64[us]").map(lambda x: None if pd.isna(x) else x)
            elif str(f[c].dtype) in ("Int32", "Int64", "boolean"):
                f[c] = f[c].astype(object).where(f[c].notna(), None)
    assert rows_of(got) == rows_of(want)
