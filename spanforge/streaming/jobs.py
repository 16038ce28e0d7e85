"""The event-driven operators as Structured Streaming jobs.

Each job takes a streaming DataFrame and returns a running query, or a
streaming DataFrame that a caller writes. ``replayed`` runs a job over all the
input there is and reads back what it wrote, for tests and registered queries.
"""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import DataStreamWriter, StreamingQuery

from ..sources.ingest import gate_rows
from .state import mark_first, started, with_new_keys


def shared_dir(spark: SparkSession) -> str:
    """The cluster's shared folder, or one of our own on a local master without the setting."""
    at = spark.conf.get("spark.checkpoint.dir", None)
    if not at:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        at = tempfile.mkdtemp(prefix="spanforge-")
        spark.conf.set("spark.checkpoint.dir", at)
    return at


def replayed(spark: SparkSession, run: Callable[[str, str], StreamingQuery]) -> str:
    """Run a job (output folder, checkpoint folder) until its input is used up; the output folder."""
    top = f"{shared_dir(spark)}/stream-{uuid.uuid4().hex}"
    run(f"{top}/out", f"{top}/checkpoint").awaitTermination()
    return f"{top}/out"


def idempotent_ingest(payloads: DataFrame, accepted_dir: str, audit_dir: str, checkpoint: str, keep_days: int = 30) -> StreamingQuery:
    """Gate every payload and audit it; of payloads with one id only the first one ever is no duplicate.

    Which ids came before is keyed state, dropped after ``keep_days``; no output
    is read again. Both outputs are in a folder per batch id, so a batch that
    runs again replaces its own files.
    """
    rows = payloads.select("interaction_id", "raw_snapshot_json", "zap_id", "ingested_at_utc", F.sha2("raw_snapshot_json", 256).alias("_sha"))
    marked = with_new_keys(rows, ["interaction_id"], keep_days)

    def batch(df: DataFrame, batch_id: int) -> None:
        df = mark_first(df, ["interaction_id"], ["ingested_at_utc", "_sha"])
        gate_rows(df, ~F.col("is_first")).write.mode("overwrite").parquet(f"{audit_dir}/batch={batch_id}")
        passed = df.sparkSession.read.parquet(f"{audit_dir}/batch={batch_id}").where("gate_status = 'pass'")
        passed.write.mode("overwrite").parquet(f"{accepted_dir}/batch={batch_id}")

    return started(marked.writeStream.foreachBatch(batch).option("checkpointLocation", checkpoint).trigger(availableNow=True))


def first_payloads(payloads: DataFrame, late: str = "1 day") -> DataFrame:
    """For readers that need no audit: the first payload of each id, as a stream; its state lasts as long as rows may be late."""
    return payloads.withWatermark("ingested_at_utc", late).dropDuplicatesWithinWatermark(["interaction_id"])


def chain_parts(calls: DataFrame, late: str = "1 day") -> DataFrame:
    """Per contact, day and project: calls, first, last and duration; shadow calls are left out.

    The rows of a day end together, so all projects of a contact's day come in
    one batch and ``finish_chains`` makes exact chains of them.
    """
    rows = calls.where("NOT is_shadow").withWatermark("event_at_utc", late).groupBy(F.window("event_at_utc", "1 day"), "contact_id", "project_id")
    return rows.agg(F.count("*").alias("n"), F.min("event_at_utc").alias("first_at"), F.max("event_at_utc").alias("last_at"), F.sum("duration_seconds").alias("duration"))


def finish_chains(parts: DataFrame) -> DataFrame:
    """Per contact and day: calls, first, last, total duration, mean gap, projects and the one with most calls, the smaller id in ties."""
    named = F.when(F.col("project_id").isNotNull(), F.struct(-F.col("n"), "project_id"))
    rows = parts.groupBy("contact_id", F.to_date("window.start").alias("day")).agg(
        F.sum("n").alias("n_calls"), F.min("first_at").alias("first_at"), F.max("last_at").alias("last_at"), F.sum("duration").alias("duration"), F.count("project_id").alias("n_projects"), F.min(named)["project_id"].alias("dominant_project_id")
    )
    gap = F.when(F.col("n_calls") > 1, F.timestamp_diff("SECOND", F.col("first_at"), F.col("last_at")) / (F.col("n_calls") - 1))
    return rows.withColumns({"duration": F.round("duration", 2), "mean_gap_s": gap})


def call_chains(calls: DataFrame, out_dir: str, checkpoint: str, mode: str = "append", late: str = "1 day") -> StreamingQuery:
    """Chains of the days that are over, in a folder per batch; in ``complete`` mode those of all days, in one."""
    path = (lambda n: out_dir) if mode == "complete" else (lambda n: f"{out_dir}/batch={n}")
    write = lambda df, n: finish_chains(df).write.mode("overwrite").parquet(path(n))
    return chain_parts(calls, late).writeStream.outputMode(mode).foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def call_sessions(calls: DataFrame, gap: str = "2 hours", late: str = "1 day") -> DataFrame:
    """Calls of a contact with no longer gap than ``gap`` as one session."""
    rows = calls.where("NOT is_shadow").withWatermark("event_at_utc", late).groupBy(F.session_window("event_at_utc", gap), "contact_id").agg(F.count("*").alias("n_calls"), F.min("event_at_utc").alias("first_at"), F.max("event_at_utc").alias("last_at"))
    return rows.select("contact_id", "n_calls", "first_at", "last_at")


def continuity_pairs(calls: DataFrame, earlier: DataFrame, hours: int = 48, late: str = "1 hour") -> DataFrame:
    """Each call with the contact's calls in the ``hours`` before it, as a stream-stream interval join."""
    a = calls.select("interaction_id", "contact_id", "event_at_utc").withWatermark("event_at_utc", late).alias("a")
    b = earlier.select(F.col("interaction_id").alias("prior_id"), F.col("contact_id").alias("_c"), F.col("event_at_utc").alias("prior_at")).withWatermark("prior_at", late).alias("b")
    on = (F.col("contact_id") == F.col("_c")) & (F.col("prior_at") < F.col("event_at_utc")) & (F.col("prior_at") >= F.col("event_at_utc") - F.expr(f"interval {hours} hours"))
    return a.join(b, on).select("interaction_id", "contact_id", "prior_id", "event_at_utc", "prior_at")


def rolling_ops(events: DataFrame, late: str = "1 hour") -> DataFrame:
    """Counts by status over a day that moves by the hour."""
    return events.withWatermark("received_at_utc", late).groupBy(F.window("received_at_utc", "24 hours", "1 hour"), "gate_status").agg(F.count("*").alias("n")).select(F.col("window.start").alias("from_at"), F.col("window.end").alias("to_at"), "gate_status", "n")


def running_contact_stats(touches: DataFrame, out_dir: str, checkpoint: str, keep_days: int = 365) -> StreamingQuery:
    """What each batch adds to a contact's counts; a repeated (contact, interaction) counts once and is reported as suppressed.

    Which pairs came before is keyed state; rows without a contact are left
    out. A batch writes one row per contact to a folder of its own, so one that
    runs again changes nothing, and ``contact_totals`` adds them up.
    """
    rows = touches.where("contact_id IS NOT NULL").select("contact_id", "interaction_id", "event_at_utc", F.coalesce("chars", F.lit(0)).cast("long").alias("chars"))
    marked = with_new_keys(rows, ["contact_id", "interaction_id"], keep_days)

    def batch(df: DataFrame, batch_id: int) -> None:
        df = mark_first(df, ["contact_id", "interaction_id"], ["event_at_utc", "chars"])
        first = F.col("is_first")
        sums = df.groupBy("contact_id").agg(F.count_if(first).alias("n"), F.sum(F.when(first, F.col("chars")).otherwise(0)).alias("chars"), F.max(F.when(first, F.col("event_at_utc"))).alias("last_at"), F.count_if(~first).alias("suppressed"))
        sums.write.mode("overwrite").parquet(f"{out_dir}/batch={batch_id}")

    return started(marked.writeStream.foreachBatch(batch).option("checkpointLocation", checkpoint).trigger(availableNow=True))


def contact_totals(spark: SparkSession, out_dir: str) -> DataFrame:
    """Counts per contact from what the batches added."""
    rows = spark.read.parquet(out_dir).groupBy("contact_id")
    return rows.agg(F.sum("n").alias("interaction_count"), F.sum("chars").alias("total_chars"), F.max("last_at").alias("last_interaction_at"), F.sum("suppressed").alias("suppressed"))


def auto_resolve(completions: DataFrame, queue: DataFrame, out_dir: str, checkpoint: str) -> StreamingQuery:
    """Ids of pending rows that a batch of completed interactions resolves."""

    def batch(df: DataFrame, batch_id: int) -> None:
        done = df.where("contact_id IS NOT NULL AND project_id IS NOT NULL").select("interaction_id").distinct()
        queue.where("status = 'pending'").join(done, "interaction_id", "left_semi").select("id", "interaction_id").write.mode("overwrite").parquet(f"{out_dir}/batch={batch_id}")

    return completions.writeStream.foreachBatch(batch).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def append_to(df: DataFrame, out_dir: str, checkpoint: str) -> DataStreamWriter:
    return df.writeStream.format("parquet").option("path", out_dir).option("checkpointLocation", checkpoint).outputMode("append").trigger(availableNow=True)
