"""Small column helpers shared by the operators."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def at(as_of: str) -> Column:
    """A point in time without zone."""
    return F.lit(as_of).cast("timestamp_ntz")


def days(n: int) -> Column:
    return F.expr(f"interval {int(n)} days")


def filled(c: Column) -> Column:
    """Null for empty or blank text."""
    return F.when(F.trim(c) != "", c)


def percent(part: Column, whole: Column, digits: int = 2) -> Column:
    return F.when(whole > 0, F.round(100.0 * part / whole, digits))


def share_of_total(df: DataFrame, n: str, out: str = "pct", digits: int = 2) -> DataFrame:
    """``df`` with each row's share of the sum of ``n``; the total is one row."""
    total = df.agg(F.sum(n).alias("_total"))
    return df.crossJoin(F.broadcast(total)).withColumn(out, percent(F.col(n), F.col("_total"), digits)).drop("_total")


def latest(df: DataFrame, keys: list[str], *order: Column) -> DataFrame:
    """The first row of each key in ``order``."""
    return df.withColumn("_rn", F.row_number().over(Window.partitionBy(*keys).orderBy(*order))).where("_rn = 1").drop("_rn")


def long_format(df: DataFrame, columns: list[str]) -> DataFrame:
    """metric, value rows of a one-row table."""
    pairs = ", ".join(f"'{c}', cast(`{c}` as double)" for c in columns)
    return df.selectExpr(f"stack({len(columns)}, {pairs}) as (metric, value)")
