"""The decision policy over model proposals: guards in a fixed order, locks, labels."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.basics import latest

LOCKS = {"human": 3, "ai": 2}
OPEN_STATUS = ("active", "warranty", "estimating")


def eligible_candidates(candidates: DataFrame, projects: DataFrame, status: tuple[str, ...] = OPEN_STATUS) -> DataFrame:
    return candidates.join(projects.where(F.col("status").isin(*status)).select(F.col("id").alias("project_id")), "project_id", "left_semi")


def anchor_rules(proposals: DataFrame, anchors: DataFrame, staff: DataFrame) -> DataFrame:
    """An assignment needs a verified anchor that names no staff, and a strong one unless an owner overrides.

    ``anchors`` has span_id, text, verified, strong; ``proposals`` owner_override.
    """
    mine = anchors.join(staff.select(F.lower("name").alias("_s")).distinct().withColumn("_staff", F.lit(True)), F.lower("text") == F.col("_s"), "left")
    per = mine.groupBy("span_id").agg(F.count_if(F.col("verified") & F.col("_staff").isNull()).alias("n_valid"), F.count_if(F.col("verified") & F.col("strong") & F.col("_staff").isNull()).alias("n_strong"), F.count("_staff").alias("n_staff"))
    rows = proposals.join(per, "span_id", "left").na.fill(0, ["n_valid", "n_strong", "n_staff"])
    assign = F.col("decision") == "assign"
    why = F.when(assign & (F.col("n_valid") == 0), "no_valid_anchor").when(assign & (F.col("n_strong") == 0) & ~F.col("owner_override"), "no_strong_anchor")
    return rows.withColumn("anchor_reason", why).withColumn("decision", F.when(why.isNotNull(), "review").otherwise(F.col("decision")))


def common_alias_guard(proposals: DataFrame, anchors: DataFrame, classes: DataFrame) -> DataFrame:
    """Review assignments that rest on common words alone.

    An alias anchor is common when it has three words or fewer and each is in
    ``classes`` (word, class: common, color, material, generic).
    """
    words = anchors.where("verified").withColumn("_i", F.monotonically_increasing_id()).select("span_id", "_i", F.explode(F.split(F.lower(F.trim("text")), r"\s+")).alias("word"))
    known = words.join(classes.select("word", "class").distinct().groupBy("word").agg(F.min("class").alias("class")), "word", "left")
    per = known.groupBy("span_id", "_i").agg((F.count_if(F.col("class").isNull()).alias("_other")), F.count("*").alias("_n"))
    flags = per.groupBy("span_id").agg(F.bool_and((F.col("_other") == 0) & (F.col("_n") <= 3)).alias("common_only"))
    rows = proposals.join(flags, "span_id", "left")
    bad = (F.col("decision") == "assign") & F.coalesce("common_only", F.lit(False))
    return rows.withColumns({"common_alias": bad, "decision": F.when(bad, "review").otherwise(F.col("decision"))}).drop("common_only")


def location_rule_guard(proposals: DataFrame, anchors: DataFrame, rules: DataFrame, least: float = 0.80) -> DataFrame:
    """A configured phrase in an address anchor forces its project, unless a strong anchor speaks for another.

    ``rules`` has phrase, project_id; ``anchors`` span_id, kind, text, strong, candidate_project_id.
    """
    said = anchors.where("kind = 'address'").join(rules, F.contains(F.lower("text"), F.lower("phrase"))).groupBy("span_id").agg(F.countDistinct("project_id").alias("_n"), F.min("project_id").alias("_p")).where("_n = 1")
    strong = anchors.where("strong").select("span_id", "candidate_project_id")
    against = said.join(strong, "span_id").where("candidate_project_id <> _p").select("span_id").distinct()
    rows = proposals.join(said.join(against, "span_id", "left_anti"), "span_id", "left")
    hit = F.col("_p").isNotNull()
    return rows.withColumn("project_id", F.coalesce("_p", "project_id")).withColumn("decision", F.when(hit, "assign").otherwise(F.col("decision"))).withColumn("confidence", F.when(hit, F.greatest(F.lit(least), F.col("confidence"))).otherwise(F.col("confidence"))).withColumn("location_rule", hit).drop("_n", "_p")


def thresholds(proposals: DataFrame, assign: float = 0.75, none: float = 0.25, safe: float = 0.40) -> DataFrame:
    """Below ``none`` nothing, below ``assign`` review, save anchored contacts with a strong alias from ``safe`` on."""
    c, d = F.coalesce("confidence", F.lit(0.0)), F.col("decision")
    promoted = (d == "assign") & (c >= safe) & (c < assign) & F.col("anchored_contact") & F.col("strong_alias")
    out = F.when(promoted, "assign").when(c < none, "none").when((d == "assign") & (c < assign), "review").otherwise(d)
    return proposals.withColumn("safe_promoted", promoted).withColumn("decision", out)


def commitment_gate(proposals: DataFrame, prospects: DataFrame) -> DataFrame:
    """Prospects that do not commit lose their project and go to review; none stays none."""
    rows = proposals.join(prospects.select("span_id", "prospect", "committed"), "span_id", "left")
    gated = F.coalesce(F.col("prospect").isin("high", "medium") & ~F.col("committed"), F.lit(False))
    return rows.withColumn("project_id", F.when(~gated, F.col("project_id"))).withColumn("decision", F.when(gated & (F.col("decision") != "none"), "review").otherwise(F.col("decision"))).withColumn("commitment_gated", gated).drop("prospect", "committed")


def owner_gate(proposals: DataFrame, candidates: DataFrame, least: float = 0.92) -> DataFrame:
    """An owner override assigns with at least ``least``, unless in conflict, without project, or with another candidate."""
    other = candidates.select("span_id", F.col("project_id").alias("_c")).join(proposals.select("span_id", F.col("project_id").alias("_p")), "span_id").where("_c <> _p").select("span_id").distinct().withColumn("_other", F.lit(True))
    rows = proposals.join(other, "span_id", "left")
    go = F.col("owner_override") & ~F.col("owner_conflict") & F.col("project_id").isNotNull() & F.col("_other").isNull()
    return rows.withColumn("decision", F.when(go, "assign").otherwise(F.col("decision"))).withColumn("confidence", F.when(go, F.greatest(F.lit(least), F.col("confidence"))).otherwise(F.col("confidence"))).withColumn("owner_gated", go).drop("_other")


def block_and_closed_filters(proposals: DataFrame, blocked: DataFrame, projects: DataFrame) -> DataFrame:
    """A blocked project is nothing; an assignment to a closed one goes to review."""
    b = blocked.select("project_id").distinct().withColumn("_b", F.lit(True))
    c = projects.where(~F.col("status").isin(*OPEN_STATUS)).select(F.col("id").alias("project_id"), F.lit(True).alias("_c"))
    rows = proposals.join(b, "project_id", "left").join(c, "project_id", "left")
    bar = F.col("_b").isNotNull()
    return rows.withColumn("decision", F.when(bar, "none").when((F.col("decision") == "assign") & F.col("_c").isNotNull(), "review").otherwise(F.col("decision"))).withColumn("confidence", F.when(bar, 0.0).otherwise(F.col("confidence"))).withColumn("project_id", F.when(~bar, F.col("project_id"))).drop("_b", "_c")


def junk_override(proposals: DataFrame, junk: DataFrame) -> DataFrame:
    """Junk that is not assigned is nothing, at 0.2 at most, without review."""
    rows = proposals.join(junk.where("junk").select("span_id").distinct().withColumn("_j", F.lit(True)), "span_id", "left")
    j = F.col("_j").isNotNull() & (F.col("decision") != "assign")
    return rows.withColumn("decision", F.when(j, "none").otherwise(F.col("decision"))).withColumn("confidence", F.when(j, F.least(F.lit(0.2), F.col("confidence"))).otherwise(F.col("confidence"))).withColumn("junk", j).drop("_j")


def lock_rank(lock: Column) -> Column:
    return F.when(lock == "human", LOCKS["human"]).when(lock == "ai", LOCKS["ai"]).otherwise(0)


def gatekeeper(proposals: DataFrame, attributions: DataFrame, least: float = 0.75) -> DataFrame:
    """What is applied to a span: assignments with an anchor or a deterministic owner, under the latest lock."""
    last = latest(attributions, ["span_id"], F.desc(lock_rank(F.col("attribution_lock"))), F.desc("attributed_at"), F.col("attribution_id")).select("span_id", F.col("attribution_lock").alias("held"), F.col("project_id").alias("held_project"))
    rows = proposals.join(last, "span_id", "left")
    fit = (F.col("decision") == "assign") & (F.col("confidence") >= least) & (F.col("has_anchor") | F.col("owner_override")) & F.col("project_id").isNotNull()
    why = F.when(F.col("held") == "human", "human_lock_present").when((F.col("held") == "ai") & ~fit, "ai_lock_preserved").when(fit, "auto_assigned").when(F.col("decision") == "none", "no_match").otherwise("needs_review")
    out = rows.withColumn("reason", why)
    return out.withColumn("applied_project_id", F.when(F.col("reason").isin("human_lock_present", "ai_lock_preserved"), F.col("held_project")).when(F.col("reason") == "auto_assigned", F.col("project_id"))).withColumn("new_lock", F.when(F.col("held") == "human", "human").when(fit | (F.col("held") == "ai"), "ai"))


def monotonic_lock_violations(before: DataFrame, after: DataFrame) -> DataFrame:
    """Spans whose lock would fall."""
    b = before.select("span_id", F.col("lock").alias("old_lock"))
    return b.join(after.select("span_id", F.col("lock").alias("new_lock")), "span_id").where(lock_rank(F.col("new_lock")) < lock_rank(F.col("old_lock")))


def derive_labels(decided: DataFrame) -> DataFrame:
    """Where an attribution comes from and the tier of its evidence."""
    source = F.when(F.col("reason") == "human_lock_present", "human").when(F.col("owner_override"), "owner_override").when(F.col("reason") == "auto_assigned", "model").otherwise("none")
    tier = F.when(F.col("strong_alias") & F.col("anchored_contact"), 1).when(F.col("strong_alias") | F.col("anchored_contact"), 2).otherwise(3)
    return decided.withColumn("attribution_source", source).withColumn("evidence_tier", tier)


def reason_codes(*codes: Column) -> Column:
    """Distinct codes that are there, in order, joined."""
    return F.concat_ws(",", F.array_distinct(F.array_compact(F.array(*codes))))


def review_queue_merge(queue: DataFrame, decided: DataFrame) -> DataFrame:
    """Pending rows for spans in review, one per span with hits added up; pending rows of assigned spans are resolved."""
    d = decided.select("span_id", "decision", F.col("reason").alias("_why"))
    both = queue.join(d, "span_id", "full")
    review, pending = F.col("decision") == "review", F.col("status") == "pending"
    status = F.when(pending & (F.col("decision") == "assign"), "resolved").when(F.col("status").isNull() & review, "pending").otherwise(F.col("status"))
    return both.select("span_id", status.alias("status"), F.when(pending & review, F.col("hit_count") + 1).otherwise(F.coalesce("hit_count", F.lit(1))).alias("hit_count"), F.coalesce("_why", "reason").alias("reason")).where("status IS NOT NULL")
