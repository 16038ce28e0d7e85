"""Review queue upkeep: resolutions, retargeting, clean-ups, triage."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.basics import at, days, latest


def apply_resolutions(queue: DataFrame, resolutions: DataFrame, attributions: DataFrame) -> DataFrame:
    """A result per request: an error, or the lock, the project and the closed item.

    ``resolutions`` has item_id, actor, project_id, requested_at. Of requests
    for one item the first counts, later ones find it resolved.
    """
    nth = F.row_number().over(Window.partitionBy("item_id").orderBy("requested_at", "actor"))
    asked = resolutions.select("item_id", "actor", F.col("project_id").alias("new_project"), "requested_at").withColumn("_n", nth)
    last = latest(attributions, ["span_id"], F.desc("attributed_at"), F.desc("attribution_id")).select("span_id", "attribution_id", "attribution_lock", F.col("project_id").alias("old_project"))
    rows = asked.join(queue.select(F.col("id").alias("item_id"), "span_id", "status"), "item_id", "left").join(last, "span_id", "left")
    result = (
        F.when(F.coalesce("actor", F.lit("")) == "", "missing_actor").when(F.col("status").isNull(), "not_found").when((F.col("status") == "resolved") | (F.col("_n") > 1), "already_resolved").when(F.col("status") != "pending", "not_pending")
        .when(F.col("attribution_id").isNull(), "no_attribution").when((F.col("attribution_lock") == "human") & ~F.col("old_project").eqNullSafe(F.col("new_project")), "human_lock_conflict").otherwise("ok")
    )
    return rows.select("item_id", "actor", "requested_at", result.alias("result"), F.when(result == "ok", F.col("new_project")).alias("project_id"), F.when(result == "ok", F.lit("human")).alias("attribution_lock"), F.when(result == "ok", F.when(F.col("old_project").eqNullSafe(F.col("new_project")), "confirm").otherwise("override")).alias("action"))


def auto_resolve_completed(queue: DataFrame, interactions: DataFrame) -> DataFrame:
    """Pending rows of interactions that have a contact and a project by now are resolved."""
    done = interactions.where("contact_id IS NOT NULL AND project_id IS NOT NULL").select("interaction_id", F.lit(True).alias("_d"))
    rows = queue.join(done, "interaction_id", "left")
    go = (F.col("status") == "pending") & F.col("_d").isNotNull()
    return rows.select("id", "interaction_id", F.when(go, "resolved").otherwise(F.col("status")).alias("status"), go.alias("auto_resolved"))


def retarget_superseded(queue: DataFrame, spans: DataFrame, attributions: DataFrame) -> DataFrame:
    """What to do with pending rows on superseded spans: the active span of the same index, or why to dismiss."""
    old = spans.where("is_superseded").select("span_id", "interaction_id", "span_index")
    live = spans.where("NOT is_superseded").select("interaction_id", "span_index", F.col("span_id").alias("target"))
    has = queue.where("status = 'pending'").select(F.col("span_id").alias("target")).distinct().withColumn("_q", F.lit(True))
    done = attributions.where("decision = 'assign'").select(F.col("span_id").alias("target")).distinct().withColumn("_a", F.lit(True))
    rows = queue.where("status = 'pending'").select("id", "span_id").join(old, "span_id").join(live, ["interaction_id", "span_index"], "left").join(has, "target", "left").join(done, "target", "left")
    action = F.when(F.col("target").isNull(), "dismiss_missing").when(F.col("_a").isNotNull(), "dismiss_attributed").when(F.col("_q").isNotNull(), "dismiss_duplicate").otherwise("retarget")
    return rows.select("id", "span_id", action.alias("action"), F.when(action == "retarget", F.col("target")).alias("target"))


def dismiss_stale(queue: DataFrame, spans: DataFrame) -> DataFrame:
    """Pending rows without a span, with a missing or superseded one, or one of another interaction."""
    s = spans.select("span_id", F.col("interaction_id").alias("_i"), "is_superseded")
    rows = queue.where("status = 'pending'").join(s, "span_id", "left")
    why = F.when(F.col("span_id").isNull(), "no_span").when(F.col("_i").isNull(), "span_missing").when(F.col("_i") != F.col("interaction_id"), "other_interaction").when(F.col("is_superseded"), "superseded")
    return rows.select("id", why.alias("dismiss_reason")).where("dismiss_reason IS NOT NULL")


def noise_cleanup(queue: DataFrame, interactions: DataFrame, attributions: DataFrame, synthetic: str = "^(test|synthetic)") -> DataFrame:
    """Pending rows without a span: synthetic, without interaction, or of a resolved one; the first that holds."""
    i = interactions.select("interaction_id", F.lit(True).alias("_i"))
    done = attributions.where("decision = 'assign'").select("interaction_id").distinct().withColumn("_d", F.lit(True))
    rows = queue.where("status = 'pending' AND span_id IS NULL").join(i, "interaction_id", "left").join(done, "interaction_id", "left")
    action = F.when(F.col("interaction_id").rlike(synthetic), "dismiss_synthetic").when(F.col("_i").isNull(), "dismiss_no_interaction").when(F.col("_d").isNotNull(), "resolve_already_resolved").otherwise("keep")
    return rows.select("id", "interaction_id", action.alias("action"))


def noise_classification(cleaned: DataFrame) -> DataFrame:
    return cleaned.groupBy("action").agg(F.count("*").alias("n"))


def junk_cleanup(queue: DataFrame, attributions: DataFrame, junk: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(closed queue rows, latest attributions set to none) of junk spans."""
    bad = junk.where("junk").select("span_id").distinct()
    closed = queue.where("status = 'pending'").join(bad, "span_id", "left_semi").withColumn("status", F.lit("dismissed"))
    last = latest(attributions, ["span_id"], F.desc("attributed_at"), F.desc("attribution_id"))
    return closed, last.join(bad, "span_id", "left_semi").withColumn("decision", F.lit("none")).withColumn("project_id", F.lit(None).cast("string"))


def double_covered_fix(attributions: DataFrame, queue: DataFrame) -> DataFrame:
    """Resolved attributions under a pending review need review."""
    waits = queue.where("status = 'pending' AND span_id IS NOT NULL").select("span_id").distinct().withColumn("_w", F.lit(True))
    rows = attributions.join(waits, "span_id", "left")
    fix = F.col("_w").isNotNull() & (F.col("decision") == "assign") & ~F.col("needs_review")
    return rows.select("attribution_id", "span_id", (F.col("needs_review") | fix).alias("needs_review"), fix.alias("fixed"))


def needs_triage(queue: DataFrame, as_of: str) -> DataFrame:
    """Both queues as one with an urgency: hits by low confidence and age, or by kind for the journal."""
    p = queue.where(F.col("status") == "pending")
    c = F.coalesce("confidence", F.lit(0.0))
    a = p.where("module = 'attribution'").select("id", "module", (F.col("hit_count") * F.when(c < 0.5, 3).when(c < 0.7, 2).otherwise(1) * F.when(F.col("created_at") < at(as_of) - days(7), 2).otherwise(1)).alias("urgency"), "created_at")
    j = p.where("module = 'journal'").select("id", "module", F.when(F.col("reason") == "conflict", 5).when(F.col("reason") == "open_loop", 3).otherwise(1).alias("urgency"), "created_at")
    return a.unionByName(j)


def review_queue_spans(queue: DataFrame, spans: DataFrame, interactions: DataFrame, attributions: DataFrame) -> DataFrame:
    """Queue rows with their span, interaction and latest attribution."""
    last = latest(attributions, ["span_id"], F.desc("attributed_at"), F.desc("attribution_id")).select("span_id", F.col("project_id").alias("attributed_project"), F.col("confidence").alias("attributed_confidence"))
    s = spans.select("span_id", "span_index", "char_start", "char_end")
    return queue.select("id", "interaction_id", "span_id", "status", "reason").join(s, "span_id", "left").join(interactions.select("interaction_id", "contact_id"), "interaction_id", "left").join(last, "span_id", "left")


def pick_fresh_review_items(queue: DataFrame, labelled: DataFrame, quotas: dict[str, int]) -> DataFrame:
    """Pending interactions not labelled yet, the newest of each reason up to its quota."""
    fresh = queue.where("status = 'pending'").join(labelled.select("interaction_id").distinct(), "interaction_id", "left_anti")
    one = latest(fresh, ["interaction_id"], F.desc("created_at"), F.col("id"))
    limits = F.create_map(*(F.lit(x) for kv in quotas.items() for x in kv))
    ranked = one.where(F.col("reason").isin(*quotas)).withColumn("_n", F.row_number().over(Window.partitionBy("reason").orderBy(F.desc("created_at"), "id")))
    return ranked.where(F.col("_n") <= F.element_at(limits, F.col("reason"))).select("id", "interaction_id", "reason", "created_at")


def speaker_backfill(claims: DataFrame, resolved: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(claims with speakers filled in, audit of what changed)."""
    r = resolved.select(F.col("claim_id").alias("id"), F.col("contact_id").alias("_r"))
    rows = claims.join(r, "id", "left")
    change = F.col("speaker_contact_id").isNull() & F.col("_r").isNotNull()
    audit = rows.where(change).select("id", F.lit(None).cast("string").alias("old_speaker"), F.col("_r").alias("new_speaker"))
    return rows.withColumn("speaker_contact_id", F.coalesce("speaker_contact_id", "_r")).drop("_r"), audit


def speaker_rollback(claims: DataFrame, audit: DataFrame) -> DataFrame:
    """Claims as they were before the audited changes; later changes stay."""
    a = audit.select("id", "old_speaker", "new_speaker", F.lit(True).alias("_a"))
    rows = claims.join(a, "id", "left")
    back = F.col("_a").isNotNull() & F.col("speaker_contact_id").eqNullSafe(F.col("new_speaker"))
    return rows.withColumn("speaker_contact_id", F.when(back, F.col("old_speaker")).otherwise(F.col("speaker_contact_id"))).drop("old_speaker", "new_speaker", "_a")
