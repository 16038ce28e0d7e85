"""One Spark session for all tests."""

import os
import sys
from pathlib import Path

import pytest

ROOT = str(Path(__file__).resolve().parent.parent)
sys.path.insert(0, ROOT)
os.environ["PYTHONPATH"] = f"{ROOT}:{os.environ.get('PYTHONPATH', '')}"

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="session")
def spark(tmp_path_factory):
    from pyspark.sql import SparkSession

    top = tmp_path_factory.mktemp("spark")
    session = (
        SparkSession.builder.master("local[4]").config("spark.sql.shuffle.partitions", "4").config("spark.ui.enabled", "false").config("spark.sql.session.timeZone", "UTC")
        .config("spark.local.dir", str(top / "local")).config("spark.sql.warehouse.dir", str(top / "warehouse")).config("spark.checkpoint.dir", str(top / "shared")).getOrCreate()
    )
    session.sparkContext.setLogLevel("ERROR")
    yield session
    session.stop()


@pytest.fixture(scope="session")
def sf_dir():
    at = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")
    if not os.path.isdir(at):
        pytest.skip("no test data here")
    return at


@pytest.fixture(scope="session")
def duck(sf_dir):
    import duckdb

    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf_dir}/{t}.parquet'")
    return con


def rows_of(frame):
    """Rows of a pandas frame as sorted tuples of text, columns by name, numbers rounded."""

    import pandas as pd

    def text(v):
        if v is None or v is pd.NaT or v != v:
            return "NULL"
        if isinstance(v, bool) or type(v).__name__ == "bool":
            return str(bool(v))
        if hasattr(v, "isoformat"):
            return str(pd.Timestamp(v))
        if isinstance(v, (int, float)) or hasattr(v, "dtype"):
            return repr(round(float(v), 6))
        return str(v)

    cols = sorted(frame.columns)
    return cols, sorted(tuple(text(v) for v in r) for r in frame[cols].astype(object).itertuples(index=False))
