"""Scores of predictions against labels, and of one version against another."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.basics import percent


def dominant_topic_score(rows: DataFrame) -> DataFrame:
    """1 or 0 for a right or wrong prediction, null without a label."""
    return rows.withColumn("correct", F.when(F.col("expected").isNull(), None).when(F.col("expected").eqNullSafe(F.col("predicted")), 1).otherwise(0))


def eval_report(scored: DataFrame, by: list[str]) -> DataFrame:
    """Accuracy by each column of ``by`` in turn and over all rows, as one table."""
    sets = [[c] for c in by] + [[]]
    out = None
    for s in sets:
        g = scored.groupBy(*s).agg(F.count("correct").alias("labelled"), F.coalesce(F.sum("correct"), F.lit(0)).alias("right"), percent(F.coalesce(F.sum("correct"), F.lit(0)), F.count("correct")).alias("accuracy_pct"))
        g = g.select(F.lit(s[0] if s else "all").alias("slice"), (F.col(s[0]).cast("string") if s else F.lit("all")).alias("value"), "labelled", "right", "accuracy_pct")
        out = g if out is None else out.unionByName(g)
    return out


def gt_correctness(rows: DataFrame) -> DataFrame:
    """Whether every expectation given holds: decision, project id, part of the project name; rows without any go."""
    d, p, n = F.col("expected_decision"), F.col("expected_project_id"), F.col("expected_name_contains")
    holds = lambda given, ok: given.isNull() | F.coalesce(ok, F.lit(False))
    ok = holds(d, d == F.col("decision")) & holds(p, p == F.col("project_id")) & holds(n, F.contains(F.lower("project_name"), F.lower(n)))
    return rows.where(d.isNotNull() | p.isNotNull() | n.isNotNull()).withColumn("correct", ok.cast("int"))


def bucket_metrics(rows: DataFrame) -> DataFrame:
    """Rows, accuracy, review and none rates of each tag."""
    each = rows.withColumn("tag", F.explode(F.split("tags", r"\s*[,;]\s*"))).where("tag <> ''")
    return each.groupBy("tag").agg(F.count("*").alias("rows"), percent(F.sum("correct"), F.count("correct")).alias("accuracy_pct"), percent(F.count_if(F.col("decision") == "review"), F.count("*")).alias("review_pct"), percent(F.count_if(F.col("decision") == "none"), F.count("*")).alias("none_pct"))


def confusion_by_project(rows: DataFrame) -> DataFrame:
    """TP, FP, FN, precision, recall and F1 of each project."""
    side = F.explode(F.array(F.struct(F.col("expected").alias("project"), F.lit(1).alias("is_actual")), F.struct(F.col("predicted").alias("project"), F.lit(0).alias("is_actual"))))
    hit = F.col("expected").eqNullSafe(F.col("predicted"))
    s = rows.select(hit.alias("hit"), side.alias("s")).select("hit", "s.*").where("project IS NOT NULL")
    n = s.groupBy("project").agg(F.count_if(F.col("hit") & (F.col("is_actual") == 1)).alias("tp"), F.count_if(~F.col("hit") & (F.col("is_actual") == 0)).alias("fp"), F.count_if(~F.col("hit") & (F.col("is_actual") == 1)).alias("fn"))
    ratio = lambda a, b: F.when(b > 0, F.round(a / b, 4))
    return n.select("project", "tp", "fp", "fn", ratio(F.col("tp"), F.col("tp") + F.col("fp")).alias("precision"), ratio(F.col("tp"), F.col("tp") + F.col("fn")).alias("recall"), ratio(2 * F.col("tp"), 2 * F.col("tp") + F.col("fp") + F.col("fn")).alias("f1"))


def gt_metrics(rows: DataFrame, leak: str) -> DataFrame:
    """Accuracy, review rate and counts of leaks (pattern), per run."""
    return rows.groupBy("run").agg(F.count("*").alias("rows"), percent(F.sum("correct"), F.count("correct")).alias("accuracy_pct"), percent(F.count_if(F.col("decision") == "review"), F.count("*")).alias("review_pct"), F.count_if(F.col("evidence").rlike(leak) & (F.col("correct") == 0)).alias("leaks"))


def gt_diff(metrics: DataFrame, baseline: str) -> DataFrame:
    """Differences of each run's accuracy and review rate from the baseline's."""
    b = metrics.where(F.col("run") == baseline).select(F.col("accuracy_pct").alias("_a"), F.col("review_pct").alias("_r"))
    return metrics.crossJoin(F.broadcast(b)).select("run", F.round(F.col("accuracy_pct") - F.col("_a"), 2).alias("accuracy_delta"), F.round(F.col("review_pct") - F.col("_r"), 2).alias("review_delta"))


def paired_ab(pairs: DataFrame, strata: list[str]) -> DataFrame:
    """2 x 2 cells of two versions on the same calls by stratum and in all, with McNemar's chi-square."""
    cells = [F.count("*").alias("n"), F.count_if((F.col("a") == 1) & (F.col("b") == 1)).alias("both"), F.count_if((F.col("a") == 1) & (F.col("b") == 0)).alias("only_a"), F.count_if((F.col("a") == 0) & (F.col("b") == 1)).alias("only_b"), F.count_if((F.col("a") == 0) & (F.col("b") == 0)).alias("neither")]
    d = F.col("only_a") + F.col("only_b")
    rows = pairs.where("a IS NOT NULL AND b IS NOT NULL").rollup(*strata).agg(*cells)
    return rows.select(*(F.coalesce(F.col(s).cast("string"), F.lit("all")).alias(s) for s in strata), "n", "both", "only_a", "only_b", "neither", F.when(d > 0, F.round((F.col("only_a") - F.col("only_b")) * (F.col("only_a") - F.col("only_b")) / d, 4)).alias("chi_square"), (d < 25).alias("needs_exact_test"))


def exact_mcnemar(only_a: int, only_b: int) -> float:
    """Two-sided exact binomial p-value of two discordant counts."""
    n, k = only_a + only_b, min(only_a, only_b)
    return 1.0 if not n else min(1.0, 2 * sum(math.comb(n, i) for i in range(k + 1)) / 2**n)


def temporal_backtest(rows: DataFrame, share: float = 0.3) -> DataFrame:
    """Precision, recall and abstention on the newest ``share`` of rows, one at least, by time then id.

    ``rows`` has id, at, expected, predicted. The cut is found on a count and a rank
    over ranges of time, so no task sees all rows: rows are counted by day first.
    """
    per_day = rows.groupBy(F.to_date("at").alias("_day")).agg(F.count("*").alias("_n"))
    newer = per_day.withColumn("_newer", F.coalesce(F.sum("_n").over(Window.orderBy(F.desc("_day")).rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))).withColumn("_want", F.greatest(F.lit(1), F.ceil(share * F.sum("_n").over(Window.partitionBy()))))
    placed = rows.withColumn("_day", F.to_date("at")).join(newer, "_day").where(F.col("_newer") < F.col("_want"))
    inside = placed.withColumn("_rn", F.row_number().over(Window.partitionBy("_day").orderBy(F.desc("at"), "id"))).where(F.col("_newer") + F.col("_rn") <= F.col("_want"))
    said, right = F.col("predicted").isNotNull(), F.col("predicted") == F.col("expected")
    return inside.agg(F.count("*").alias("holdout"), F.count_if(said).alias("answered"), F.count_if(right).alias("right"), percent(F.count_if(right), F.count_if(said)).alias("precision_pct"), percent(F.count_if(right), F.count("expected")).alias("recall_pct"), percent(F.count_if(~said), F.count("*")).alias("abstain_pct"))


def version_scoreboard(rows: DataFrame, old: str, new: str, metrics: dict[str, Column]) -> DataFrame:
    """metric, both versions' values and PASS, FAIL or NO_DATA for the new against the old; more is better."""
    each = rows.groupBy("version").agg(*(v.cast("double").alias(k) for k, v in metrics.items()))
    stack = ", ".join(f"'{k}', `{k}`" for k in metrics)
    long = each.selectExpr("version", f"stack({len(metrics)}, {stack}) as (metric, value)")
    both = long.groupBy("metric").agg(F.max(F.when(F.col("version") == old, F.col("value"))).alias("old_value"), F.max(F.when(F.col("version") == new, F.col("value"))).alias("new_value"))
    return both.withColumn("status", F.when(F.col("old_value").isNull() | F.col("new_value").isNull(), "NO_DATA").when(F.col("new_value") >= F.col("old_value"), "PASS").otherwise("FAIL"))


def launch_scorecard(measured: DataFrame, limits: DataFrame) -> DataFrame:
    """metric, value, limit and GO, NO_GO or NOT_MEASURED; a limit is a least or a most."""
    rows = limits.join(measured, "metric", "left")
    ok = F.when(F.col("side") == "min", F.col("value") >= F.col("limit")).otherwise(F.col("value") <= F.col("limit"))
    return rows.select("metric", "value", "side", "limit", F.when(F.col("value").isNull(), "NOT_MEASURED").when(ok, "GO").otherwise("NO_GO").alias("verdict"))


def hard_negative_labels(calls: DataFrame, window: int = 30) -> DataFrame:
    """For each call of a contact with two projects or more: its own project as positive, the contact's others within the window as negatives.

    Calls and visits meet on the contact; a visit is a contact's project on a day.
    """
    seen = calls.where("project_id IS NOT NULL").select("contact_id", F.col("project_id").alias("_p"), F.to_date("event_at_utc").alias("_day")).distinct()
    own = calls.where("project_id IS NOT NULL").select("interaction_id", "contact_id", "project_id", F.to_date("event_at_utc").alias("_on"))
    near = own.join(seen, "contact_id").where(F.abs(F.datediff("_day", "_on")) <= window).groupBy("interaction_id", "contact_id", "project_id", "_p").agg(F.min(F.abs(F.datediff("_day", "_on"))).alias("gap_days"))
    others = near.where("_p <> project_id")
    positive = own.join(others.select("interaction_id").distinct(), "interaction_id", "left_semi").select("interaction_id", "contact_id", F.col("project_id"), F.lit(1).alias("label"), F.lit(0).alias("gap_days"))
    negative = others.select("interaction_id", "contact_id", F.col("_p").alias("project_id"), F.lit(0).alias("label"), "gap_days")
    return positive.unionByName(negative).withColumn("difficulty", F.when(F.col("label") == 1, "positive").when(F.col("gap_days") <= 2, "hard").when(F.col("gap_days") <= 7, "medium").otherwise("easy"))


def stratified_sample(rows: DataFrame, stratum: str, key: str, per: int, seed: int = 7) -> DataFrame:
    """``per`` rows of each stratum by a hash of the key."""
    h = F.md5(F.concat_ws(":", F.lit(str(seed)), F.col(key)))
    return rows.withColumn("_n", F.row_number().over(Window.partitionBy(stratum).orderBy(h, key))).where(F.col("_n") <= per).drop("_n")


def review_contamination(attributions: DataFrame, claims: DataFrame) -> DataFrame:
    """Spans whose latest attribution is not an assignment and that still have active claims, with the rate."""
    from ..functions.basics import latest

    last = latest(attributions, ["span_id"], F.desc("attributed_at"), F.desc("attribution_id")).where("decision <> 'assign'")
    has = claims.where("active").select(F.col("source_span_id").alias("span_id")).distinct().withColumn("_c", F.lit(1))
    return last.join(has, "span_id", "left").groupBy("decision").agg(F.count("*").alias("spans"), F.count("_c").alias("with_claims"), percent(F.count("_c"), F.count("*")).alias("rate_pct"))


def ingest_gt_segments(segments: DataFrame, projects: DataFrame) -> DataFrame:
    """Segment labels with the project of their name, case aside; the last of (call, segment, turn type) stays."""
    p = projects.groupBy(F.lower(F.trim("name")).alias("_n")).agg(F.min("id").alias("project_id"))
    rows = segments.withColumn("_n", F.lower(F.trim("project_name"))).join(p, "_n", "left")
    w = Window.partitionBy("call_id", "segment", "turn_type").orderBy(F.desc("labelled_at"), "label_id")
    return rows.withColumn("_r", F.row_number().over(w)).where("_r = 1").select("call_id", "segment", "turn_type", "project_id", F.col("project_id").isNotNull().alias("resolved"))
