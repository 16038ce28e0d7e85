"""Contact-to-project affinity and contact statistics."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

EDGE = ["contact_id", "project_id"]


def affinity_from_attributions(affinity: DataFrame, attributions: DataFrame, least: float = 0.8, step: float = 0.1, cap: float = 2.0) -> DataFrame:
    """Edges after confident attributions: each adds ``step`` times its confidence, up to ``cap``.

    Increments are positive and capped alike at every step, so the capped sum is the sequential result.
    """
    add = attributions.where((F.col("confidence") >= least) & F.col("contact_id").isNotNull() & F.col("project_id").isNotNull()).groupBy(*EDGE).agg(F.sum(F.col("confidence") * step).alias("_add"), F.count("*").alias("_n"))
    both = affinity.select(*EDGE, "weight", "confirmation_count").join(add, EDGE, "full")
    return both.select(*EDGE, F.when(F.col("_add").isNull(), F.col("weight")).otherwise(F.least(F.lit(cap), F.coalesce("weight", F.lit(0.0)) + F.col("_add"))).alias("weight"), (F.coalesce("confirmation_count", F.lit(0)) + F.coalesce("_n", F.lit(0))).alias("confirmation_count"))


def _ordered(events: DataFrame, order: list[str]) -> DataFrame:
    return events.groupBy(*EDGE).agg(F.array_sort(F.collect_list(F.struct(*order, "action"))).alias("events"))


def affinity_from_overrides(affinity: DataFrame, overrides: DataFrame, order: list[str], up: float = 0.3, down: float = 0.2, cap: float = 2.0) -> DataFrame:
    """Edges after confirmations and rejections in order, never over ``cap`` or under 0: an ordered fold per edge."""
    both = affinity.select(*EDGE, "weight").join(_ordered(overrides, order), EDGE, "full")
    step = lambda w, e: F.when(e["action"] == "confirm", F.least(F.lit(cap), w + up)).when(e["action"] == "reject", F.greatest(F.lit(0.0), w - down)).otherwise(w)
    start = F.coalesce("weight", F.lit(0.0))
    return both.select(*EDGE, F.when(F.col("events").isNull(), start).otherwise(F.aggregate("events", start, step)).alias("weight"))


def affinity_feedback(affinity: DataFrame, feedback: DataFrame, order: list[str]) -> DataFrame:
    """Edges after votes of plus or minus 1 in order, never negative, with counters."""
    both = affinity.select(*EDGE, "weight", "confirmation_count", "rejection_count").join(_ordered(feedback, order), EDGE, "full")
    step = lambda w, e: F.greatest(F.lit(0.0), w + F.when(e["action"] == "confirm", 1.0).when(e["action"] == "reject", -1.0).otherwise(0.0))
    start, ev = F.coalesce("weight", F.lit(0.0)), F.coalesce("events", F.array())
    n = lambda a: F.size(F.filter(F.col("events"), lambda e: e["action"] == a))
    return both.select(*EDGE, F.when(F.col("events").isNull(), start).otherwise(F.aggregate("events", start, step)).alias("weight"), (F.coalesce("confirmation_count", F.lit(0)) + F.when(F.col("events").isNull(), 0).otherwise(n("confirm"))).alias("confirmation_count"), (F.coalesce("rejection_count", F.lit(0)) + F.when(F.col("events").isNull(), 0).otherwise(n("reject"))).alias("rejection_count"))


def affinity_decay(affinity: DataFrame, factor: float = 0.95, least: float = 0.01) -> DataFrame:
    return affinity.withColumn("weight", F.when(F.col("weight") > least, F.col("weight") * factor).otherwise(F.col("weight")))


def affinity_share(interactions: DataFrame) -> DataFrame:
    """Each project's share of a contact's interactions, and the last of them."""
    n = interactions.where("contact_id IS NOT NULL AND project_id IS NOT NULL").groupBy(*EDGE).agg(F.count("*").alias("n"), F.max("event_at_utc").alias("last_interaction_at"))
    return n.withColumn("weight", F.col("n") / F.sum("n").over(Window.partitionBy("contact_id")))


def sync_assignments(affinity: DataFrame, links: DataFrame, start: float = 0.8) -> DataFrame:
    """New edges for links that have none."""
    return links.select(*EDGE).distinct().join(affinity, EDGE, "left_anti").withColumn("weight", F.lit(start))


def block_internal_floaters(affinity: DataFrame, contacts: DataFrame) -> DataFrame:
    """Edges without the positive ones of internal or floating contacts; weight 0 passes."""
    barred = contacts.where("is_internal OR floats_between_projects").select(F.col("id").alias("contact_id"))
    return affinity.where("weight > 0").join(barred, "contact_id", "left_anti").unionByName(affinity.where("weight <= 0 OR weight IS NULL"))


def contact_stats(touches: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(stats per contact, repeats): each (contact, interaction) counts once; the least row by time and size stays."""
    w = Window.partitionBy("contact_id", "interaction_id").orderBy("event_at_utc", "chars")
    rows = touches.withColumn("_n", F.row_number().over(w))
    stats = rows.where("_n = 1").groupBy("contact_id").agg(F.count("*").alias("interaction_count"), F.sum("chars").alias("total_transcript_chars"), F.max("event_at_utc").alias("last_interaction_at"))
    return stats, rows.where("_n > 1").drop("_n")


def engagement(contacts: DataFrame, key_chars: int = 50000, key_count: int = 20) -> DataFrame:
    """Engagement score, and key contacts: many characters or many interactions."""
    chars, n = F.coalesce("total_transcript_chars", F.lit(0)), F.coalesce("interaction_count", F.lit(0))
    return contacts.select("id", (n + chars / 150.0 * 0.5).alias("engagement_score"), ((chars > key_chars) | (n > key_count)).alias("is_key_contact"))
