"""Keyed state for streams that must tell first rows of a key from repeats.

State is one small value a key, kept by the state store and dropped a set time
after it was written, so the work of a batch follows its own rows and not what
came before. Keys are spread by hash; a key with very many rows holds no more
than its first.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming import DataStreamWriter, StreamingQuery

_PROVIDER = "spark.sql.streaming.stateStore.providerClass"


def with_store(spark: SparkSession) -> None:
    """Keys of many days are kept on disk; a store that is set stays."""
    if "RocksDB" not in (spark.conf.get(_PROVIDER, None) or ""):
        spark.conf.set(_PROVIDER, "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")


def started(writer: DataStreamWriter) -> StreamingQuery:
    """The running query of a stream with state that expires by the clock.

    Such a stream could always run one more empty batch; it is started without
    those, so that it ends when its input does.
    """
    conf, empty = SparkSession.active().conf, "spark.sql.streaming.noDataMicroBatches.enabled"
    before = conf.get(empty)
    conf.set(empty, "false")
    try:
        return writer.start()
    finally:
        conf.set(empty, before)


def with_new_keys(rows: DataFrame, keys: list[str], keep_days: int = 30) -> DataFrame:
    """A stream's rows and, with ``_new_key``, one row more for each key that did not come in the last ``keep_days``.

    Keys are dropped by the engine's own deduplication; its event time is the
    clock. It forgets a key twice its delay after the key came.
    """
    with_store(rows.sparkSession)
    seen = rows.select(*keys).withColumn("_seen_at", F.current_timestamp()).withWatermark("_seen_at", f"{keep_days * 12} hours")
    new = seen.dropDuplicatesWithinWatermark(keys).select(*keys, F.lit(True).alias("_new_key"))
    return rows.withColumn("_new_key", F.lit(False)).unionByName(new, allowMissingColumns=True)


def mark_first(batch: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """The rows of a batch of ``with_new_keys`` with is_first: the first in ``order`` of a key that is new."""
    of_key = Window.partitionBy(*keys)
    nth = F.row_number().over(of_key.orderBy("_new_key", *(F.col(c).asc_nulls_last() for c in order)))
    rows = batch.withColumns({"_new": F.max("_new_key").over(of_key), "_nth": nth}).where("NOT _new_key")
    return rows.withColumn("is_first", F.col("_new") & (F.col("_nth") == 1)).drop("_new_key", "_new", "_nth")
