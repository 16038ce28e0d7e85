"""One bounded record per span from all tables of evidence."""

from __future__ import annotations

from collections.abc import Mapping
from functools import reduce

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def context_package(spans: DataFrame, parts: Mapping[str, DataFrame], most: Mapping[str, int] | int = 5) -> DataFrame:
    """span_id, package: JSON of the span's own columns and, by name, the first rows of each part.

    A part has span_id, ``order`` and the columns of its records; at most
    ``most`` of a span's are taken, by order, then as text. Spans without rows
    of a part have an empty list; rows of other spans are left out. All parts
    become rows of one form and are exchanged once, by span; a task holds the
    bounded records of a span, not its evidence.
    """
    record = lambda df, drop: F.to_json(F.struct(*(c for c in df.columns if c not in drop)))
    form = lambda df, name, order, drop: df.select(F.col("span_id").cast("string").alias("span_id"), F.lit(name).alias("part"), order.cast("double").alias("order"), record(df, drop).alias("record"))
    rows = [form(spans, "", F.lit(0), ())] + [form(df, name, F.col("order"), ("span_id", "order")) for name, df in parts.items()]
    bound = F.lit(None).cast("int")
    for name in parts:
        bound = F.when(F.col("part") == name, most if isinstance(most, int) else most[name]).otherwise(bound)
    # Dealt by span, both the window and the grouping find their rows together.
    dealt = reduce(DataFrame.unionByName, rows).where("span_id IS NOT NULL").repartition("span_id")
    first = dealt.withColumn("_n", F.row_number().over(Window.partitionBy("span_id", "part").orderBy("order", "record"))).where(F.col("_n") <= F.coalesce(bound, F.lit(1)))
    lists = lambda name: F.array_join(F.transform(F.array_sort(F.collect_list(F.when(F.col("part") == name, F.struct("_n", "record")))), lambda x: x["record"]), ",")
    whole = first.groupBy("span_id").agg(F.max(F.when(F.col("part") == "", F.col("record"))).alias("_own"), *(lists(name).alias(name) for name in parts)).where("_own IS NOT NULL")
    text = [F.lit('{"span":'), F.col("_own"), *(x for name in parts for x in (F.lit(f',"{name}":['), F.col(name), F.lit("]"))), F.lit("}")]
    return whole.select("span_id", F.concat(*text).alias("package"))
