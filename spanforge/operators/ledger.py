"""Claims: gates, deduplication, lanes, promotion, facts as of a time, vector search."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.basics import days, latest

#: The three claim-type maps in use, by name.
CLAIM_TYPES = {
    "crosswalk": {"deadline": "event", "blocker": "open_loop"},
    "promotion": {"deadline": "commitment", "blocker": "risk"},
    "drift": {"deadline": "commitment", "blocker": "open_loop"},
}
#: Least confidence of a type to be promoted.
LEAST_CONFIDENCE = {"decision": 0.75, "schedule": 0.75, "commitment": 0.70, "open_loop": 0.65, "risk": 0.65}


def claims_write_gate(spans: DataFrame, attributions: DataFrame, projects: DataFrame, claims: DataFrame, shortest: int = 20, block_non_assign: bool = False) -> DataFrame:
    """Whether claims may be written for a span, why not, and whether they are confirmed."""
    ended = projects.where("status = 'closed'").select(F.col("id").alias("project_id"), F.lit(True).alias("_closed"))
    has = claims.where("active").select(F.col("source_span_id").alias("span_id")).distinct().withColumn("_has", F.lit(True))
    rows = spans.join(attributions.select("span_id", "project_id", "decision"), "span_id", "left").join(ended, "project_id", "left").join(has, "span_id", "left")
    size = F.col("char_end") - F.col("char_start")
    reason = F.when(size < shortest, "transcript_too_short").when(F.col("_closed"), "project_closed").when(F.col("_has"), "already_extracted")
    if block_non_assign:
        reason = reason.when(F.coalesce("decision", F.lit("none")) != "assign", "not_assigned")
    return rows.select("span_id", F.coalesce(reason, F.lit("write")).alias("gate"), F.coalesce((F.col("decision") == "assign") & F.col("project_id").isNotNull(), F.lit(False)).alias("confirmed"))


def insert_claims_dedup(stored: DataFrame, new: DataFrame) -> DataFrame:
    """New claims unique by (call, type, text, project or none) among the active ones, first of a batch."""
    key = ["call_id", "claim_type", "claim_text"]
    own = F.coalesce("project_id", F.lit("\u0000"))
    first = new.withColumn("_p", own).withColumn("_n", F.row_number().over(Window.partitionBy(*key, "_p").orderBy("created_at", "id"))).where("_n = 1").drop("_n")
    return first.join(stored.where("active").withColumn("_p", own).select(*key, "_p").distinct(), [*key, "_p"], "left_anti").select(*new.columns)


def confirmation_state(claims: DataFrame) -> DataFrame:
    return claims.withColumn("claim_confirmation_state", F.when(F.col("project_id").isNotNull() & (F.col("attribution_decision") == "assign"), "confirmed").otherwise("unconfirmed"))


def mapped_type(claim_type: Column, which: str) -> Column:
    out = claim_type
    for a, b in CLAIM_TYPES[which].items():
        out = F.when(claim_type == a, b).otherwise(out)
    return out


def decide_lane(claims: DataFrame, context: DataFrame) -> DataFrame:
    """PROMOTE, REVIEW or STAGE for each claim, by the first gate that holds, and its reason.

    ``context`` has per claim id: contradicted, in_candidates, multi_project.
    """
    c = claims.join(context.withColumnRenamed("id", "_cid"), F.col("id") == F.col("_cid"), "left").withColumn("lane_type", mapped_type(F.col("claim_type"), "promotion"))
    pointer = F.col("char_start").isNotNull() & F.col("char_end").isNotNull() & F.col("span_hash").isNotNull() & F.coalesce(F.col("pointer_type") == "transcript_span", F.lit(False)) & (F.col("char_start") < F.col("char_end"))
    least = F.element_at(F.create_map(*(F.lit(x) for kv in LEAST_CONFIDENCE.items() for x in kv)), F.col("lane_type"))
    yes = lambda n: F.coalesce(F.col(n), F.lit(False))
    gates = [
        (~pointer, "STAGE", "invalid_pointer"), (F.col("project_id").isNull(), "REVIEW", "null_project"), (yes("contradicted"), "REVIEW", "contradiction"), (~F.coalesce(F.col("in_candidates"), F.lit(True)), "REVIEW", "project_not_in_candidates"),
        (yes("multi_project"), "REVIEW", "multi_project_contact"), (F.col("testimony_type") == "reported", "REVIEW", "reported_speech"), (least.isNull(), "STAGE", "type_not_promotable"),
        ((F.col("lane_type") == "schedule") & (F.col("warrant_level") != "high"), "REVIEW", "schedule_not_anchored"), (F.coalesce("attribution_confidence", F.lit(0.0)) < least, "REVIEW", "low_confidence"),
    ]
    lane, why = F, F
    for cond, a, b in gates:
        lane, why = lane.when(cond, a), why.when(cond, b)
    return c.select("id", "lane_type", lane.otherwise("PROMOTE").alias("lane"), why.otherwise("all_gates_passed").alias("lane_reason"))


def promote_claims(claims: DataFrame, lanes: DataFrame) -> dict[str, DataFrame]:
    """beliefs, pointers, log and review rows out of lanes."""
    rows = claims.join(lanes, "id")
    up = rows.where("lane = 'PROMOTE'")
    return {
        "beliefs": up.select(F.col("id").alias("claim_id"), "project_id", F.col("lane_type").alias("belief_type"), F.col("claim_text").alias("text"), "warrant_level"),
        "pointers": up.select(F.col("id").alias("claim_id"), "source_span_id", "char_start", "char_end", "span_hash"),
        "log": up.select(F.col("id").alias("claim_id"), "run_id", F.lit("promoted").alias("event")),
        "review": rows.where("lane = 'REVIEW'").select(F.col("id").alias("item_id"), F.col("lane_reason").alias("reason"), "run_id").distinct(),
    }


def batch_promote_high_signal(claims: DataFrame, promoted: DataFrame, types: tuple[str, ...] = ("decision", "commitment", "deadline", "schedule", "blocker", "risk"), longest: int = 1000) -> DataFrame:
    """Beliefs out of active claims with a pointer that are not promoted yet."""
    status = F.when(F.col("claim_type") == "decision", "decided").when(F.col("claim_type").isin("commitment", "schedule", "deadline"), "promised").otherwise("reported")
    rows = claims.where(F.col("active") & F.col("claim_type").isin(*types) & F.col("char_start").isNotNull() & F.col("char_end").isNotNull())
    return rows.join(promoted.select(F.col("claim_id").alias("id")), "id", "left_anti").select("id", "project_id", status.alias("epistemic_status"), F.coalesce("attribution_confidence", F.when(F.col("warrant_level") == "high", 0.90).when(F.col("warrant_level") == "medium", 0.75).when(F.col("warrant_level") == "low", 0.60).otherwise(0.70)).alias("confidence"), F.substring("claim_text", 1, longest).alias("text"))


def apply_consolidation(claims: DataFrame, judgments: DataFrame) -> DataFrame:
    """Claims after judgments (source_id, target_id, relationship): superseded targets end, corroborated gain warrant; confirmed ones stay."""
    per = judgments.groupBy(F.col("target_id").alias("id")).agg(F.min(F.when(F.col("relationship") == "supersedes", F.col("source_id"))).alias("_by"), F.bool_or(F.col("relationship") == "corroborates").alias("_more"), F.bool_or(F.col("relationship") == "conflicts").alias("in_conflict"))
    rows = claims.join(per, "id", "left")
    free = F.col("claim_confirmation_state") != "confirmed"
    return rows.select("id", (F.col("active") & ~(free & F.col("_by").isNotNull())).alias("active"), F.when(free, F.col("_by")).alias("superseded_by"), F.when(free & F.col("_more"), "high").otherwise(F.col("warrant_level")).alias("warrant_level"), F.coalesce("in_conflict", F.lit(False)).alias("in_conflict"), (~free & F.col("_by").isNotNull()).alias("skipped_confirmed"))


def close_loops(loops: DataFrame, judgments: DataFrame, least: float = 0.75) -> DataFrame:
    """Open loops with a confident, evidenced judgment are closed; with who and when."""
    best = latest(judgments.where((F.col("resolved")) & (F.col("confidence") >= least) & F.col("evidence").isNotNull()), ["loop_id"], F.desc("confidence"), F.col("judged_at"), F.col("evidence"))
    rows = loops.join(best.select(F.col("loop_id").alias("id"), F.col("evidence").alias("closing_evidence"), F.col("judged_at")), "id", "left")
    ends = (F.col("status") == "open") & F.col("closing_evidence").isNotNull()
    return rows.select("id", "call_id", "project_id", F.when(ends, "closed").otherwise(F.col("status")).alias("status"), F.when(ends, F.col("judged_at")).alias("closed_at"), F.when(ends, F.col("closing_evidence")).alias("closing_evidence"))


def vector_search(queries: DataFrame, claims: DataFrame, k: int = 5, most: float = 0.5, block: int = 4096) -> DataFrame:
    """query_id, id, distance, rank: the nearest claims by cosine distance within ``most``.

    Both sides are dealt to blocks and each pair of blocks is one group, so no
    task holds more than a block of each; the k best of each query in a group
    are kept before they are merged per query. Null vectors take no part.
    Distances are rounded to 9 places before they are compared, so that those
    of equal vectors are equal and go by id.
    """
    import numpy as np
    import pandas as pd

    q, c = queries.where("embedding IS NOT NULL").select("query_id", "embedding"), claims.where("embedding IS NOT NULL").select("id", "embedding")
    rows, cols = max(1, -(-c.count() // block)), max(1, -(-q.count() // block))
    # Both sides' keys are of one type: cogrouped sides are dealt out as they are, and an int and a long of one value hash apart.
    each = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
    part = lambda id_, n: F.pmod(F.xxhash64(id_), F.lit(n)).cast("int")
    left = c.withColumn("r", part("id", rows)).withColumn("s", each(cols))
    right = q.withColumn("s", part("query_id", cols)).withColumn("r", each(rows))

    def unit(v: pd.Series) -> np.ndarray:
        m = np.stack(v.to_list()).astype(float)
        return m / np.maximum(np.sqrt((m * m).sum(1, keepdims=True)), 1e-300)

    def best(cs: pd.DataFrame, qs: pd.DataFrame) -> pd.DataFrame:
        out = []
        if len(cs) and len(qs):
            ids, far = cs["id"].to_numpy(), np.abs(np.round(1 - unit(qs["embedding"]) @ unit(cs["embedding"]).T, 9))
            for name, d in zip(qs["query_id"], far):
                keep = np.flatnonzero((d <= most) & (ids != name))
                keep = keep[np.lexsort((ids[keep], d[keep]))[:k]]
                out += [(name, i, x) for i, x in zip(ids[keep], d[keep])]
        return pd.DataFrame(out, columns=["query_id", "id", "distance"])

    kind = c.schema["id"].dataType.simpleString()
    found = left.groupBy("r", "s").cogroup(right.groupBy("r", "s")).applyInPandas(best, f"query_id {kind}, id {kind}, distance double")
    return found.withColumn("rank", F.row_number().over(Window.partitionBy("query_id").orderBy("distance", "id"))).where(F.col("rank") <= k)


def claim_search_text(claims: DataFrame, longest: int = 1400) -> DataFrame:
    parts = [F.concat(F.lit(f"{c}: "), F.col(c)) for c in ("claim_type", "claim_text", "warrant_level", "testimony_type")]
    return claims.select("id", F.substring(F.regexp_replace(F.lower(F.concat_ws(" | ", *parts)), r"\s+", " "), 1, longest).alias("search_text"))


def facts_known_as_of(calls: DataFrame, facts: DataFrame, most: int = 20, bin_days: int = 30) -> DataFrame:
    """Per call and project the newest facts true and observed by the call's time, none from the call itself.

    A fact is of use from the time it is known until ``most`` newer ones are,
    and as many more as a call has of its own. Facts and calls meet in the
    ``bin_days`` of that time, so a call meets about as many facts as it needs,
    not all of its project.
    """
    f = facts.where("project_id IS NOT NULL AND as_of_at IS NOT NULL AND observed_at IS NOT NULL").select("fact_id", "project_id", "as_of_at", "observed_at", "fact_kind", F.col("interaction_id").alias("_from"), F.greatest("as_of_at", "observed_at").alias("_known"))
    own = f.where("_from IS NOT NULL").groupBy("project_id", "_from").count().agg(F.max("count")).first()[0] or 0
    asked = calls.where("project_id IS NOT NULL AND event_at_utc IS NOT NULL").select("interaction_id", "project_id", "event_at_utc")
    last = asked.agg(F.max("event_at_utc")).first()[0]
    newer = Window.partitionBy("project_id").orderBy("as_of_at", "observed_at", F.desc("fact_id")).rowsBetween(1, most + own)
    f = f.withColumn("_until", F.when(F.count("*").over(newer) == most + own, F.max("_known").over(newer)))
    span = lambda at: F.floor(F.unix_seconds(at.cast("timestamp")) / (86400 * bin_days))
    ends = F.least(F.coalesce("_until", F.lit(last)), F.lit(last))
    filed = f.where((F.col("_known") <= F.lit(last)) & (F.col("_until").isNull() | (F.col("_until") > F.col("_known")))).withColumn("_bin", F.explode(F.sequence(span(F.col("_known")), span(ends))))
    in_time = (F.col("_known") <= F.col("event_at_utc")) & (F.col("_until").isNull() | (F.col("event_at_utc") < F.col("_until"))) & ~F.col("_from").eqNullSafe(F.col("interaction_id"))
    known = asked.withColumn("_bin", span(F.col("event_at_utc"))).join(filed, ["project_id", "_bin"]).where(in_time)
    w = Window.partitionBy("interaction_id", "project_id").orderBy(F.desc("as_of_at"), F.desc("observed_at"), "fact_id")
    return known.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= most).select("interaction_id", "project_id", "fact_id", "fact_kind", "as_of_at", "rank")


def facts_time_relation(facts: DataFrame, calls: DataFrame) -> DataFrame:
    """AS_OF for facts known by their call's time, POST_HOC for later ones."""
    return facts.join(calls.select("interaction_id", "event_at_utc"), "interaction_id").select("fact_id", "interaction_id", F.when((F.col("as_of_at") <= F.col("event_at_utc")) & (F.col("observed_at") <= F.col("event_at_utc")), "AS_OF").otherwise("POST_HOC").alias("relation"))


def facts_window_counts(calls: DataFrame, facts: DataFrame, window: int = 90) -> DataFrame:
    """Per call of a project with facts: its facts in the window before it, older ones, and later ones.

    Facts are added up along each project's time once; calls read the sums at
    their own time and at the window's begin.
    """
    asked = calls.where("project_id IS NOT NULL").select("interaction_id", "project_id", "event_at_utc", (F.col("event_at_utc") - days(window)).alias("_begin"))
    dated = facts.where("as_of_at IS NOT NULL").groupBy("project_id", F.col("as_of_at").cast("timestamp_ntz").alias("at")).agg(F.count("*").alias("n"))
    points = asked.select("project_id", F.explode(F.array(F.col("event_at_utc").cast("timestamp_ntz"), F.col("_begin").cast("timestamp_ntz"))).alias("at")).distinct().withColumn("n", F.lit(0).cast("long"))
    upto = Window.partitionBy("project_id").orderBy("at").rangeBetween(Window.unboundedPreceding, Window.currentRow)
    sums = dated.unionByName(points).withColumn("upto", F.sum("n").over(upto)).groupBy("project_id", "at").agg(F.max("upto").alias("upto"))
    total = facts.groupBy("project_id").agg(F.count("as_of_at").alias("all"))
    at = lambda name: sums.select("project_id", F.col("at").alias(f"_{name}"), F.col("upto").alias(name))
    rows = asked.select("interaction_id", "project_id", F.col("event_at_utc").cast("timestamp_ntz").alias("_now"), F.col("_begin").cast("timestamp_ntz").alias("_then"))
    rows = rows.join(at("now"), ["project_id", "_now"]).join(at("then"), ["project_id", "_then"]).join(total, "project_id")
    return rows.groupBy("interaction_id").agg(F.sum(F.col("now") - F.col("then")).alias("in_window"), F.sum("then").alias("before_window"), F.sum(F.col("all") - F.col("now")).alias("post_hoc"))


def facts_missing_provenance(facts: DataFrame) -> DataFrame:
    return facts.where("interaction_id IS NULL OR source_char_start IS NULL").select("fact_id", "project_id", "fact_kind")


def facts_by_kind(facts: DataFrame) -> DataFrame:
    return facts.groupBy("fact_kind").agg(F.count("*").alias("n"), F.countDistinct("project_id").alias("projects"), F.min("as_of_at").alias("first"), F.max("as_of_at").alias("last"))


def claims_for_review(claims: DataFrame) -> DataFrame:
    """Active claims with the width and quality of their pointer."""
    width = F.col("char_end") - F.col("char_start")
    quality = F.when(width.isNull(), "no_offsets").when(width < 5, "precise").when(width < 10, "wide").when(F.col("char_start") <= 1, "blanket").otherwise("broad")
    return claims.where("active").select("id", quality.alias("pointer_quality"), F.coalesce(width, F.lit(-1)).alias("width"), F.col("speaker_contact_id").isNull().alias("missing_speaker"))


def orphan_review_items(queue: DataFrame, claims: DataFrame) -> DataFrame:
    """Queue rows of the journal, conflicts aside, whose claim does not exist."""
    return queue.where("module = 'journal' AND reason <> 'conflict'").join(claims.select(F.col("source_span_id").alias("span_id")), "span_id", "left_anti").select("id", "interaction_id", "reason")


def check_promotions(beliefs: DataFrame, claims: DataFrame, queue: DataFrame) -> DataFrame:
    """Beliefs with neither a whole transcript pointer nor a resolved review."""
    fine = claims.where("pointer_type = 'transcript_span' AND char_start IS NOT NULL AND char_end IS NOT NULL AND span_hash IS NOT NULL").select(F.col("id").alias("claim_id"))
    seen = claims.join(queue.where("status = 'resolved'").select(F.col("span_id").alias("source_span_id")).distinct(), "source_span_id", "left_semi").select(F.col("id").alias("claim_id"))
    return beliefs.join(fine, "claim_id", "left_anti").join(seen, "claim_id", "left_anti")


def backfill_promotion_log(beliefs: DataFrame, log: DataFrame, claims: DataFrame) -> DataFrame:
    """A log row for each belief without one; its run is the belief's, else the claim's."""
    runs = claims.select(F.col("id").alias("claim_id"), F.col("run_id").alias("_run"))
    return beliefs.join(log, "claim_id", "left_anti").join(runs, "claim_id", "left").select("claim_id", F.coalesce("run_id", "_run").alias("run_id"), F.lit("backfilled").alias("event"))


def evidence_write_once(old: DataFrame, new: DataFrame) -> DataFrame:
    """Rows that would change a payload reference already set."""
    n = new.select(F.col("id").alias("_id"), F.col("payload_ref").alias("new_ref"))
    return old.join(n, F.col("id") == F.col("_id")).where("payload_ref IS NOT NULL AND NOT payload_ref <=> new_ref").select("id", "payload_ref", "new_ref")


def review_spans_missing_extraction(attributions: DataFrame, queue: DataFrame, claims: DataFrame, least: float = 0.70) -> DataFrame:
    """Spans whose latest attribution is a confident review with a project, pending, without active claims."""
    last = latest(attributions, ["span_id"], F.desc("attributed_at"), F.desc("attribution_id")).where((F.col("decision") == "review") & (F.col("confidence") >= least) & F.col("project_id").isNotNull())
    return last.join(queue.where("status = 'pending'"), "span_id", "left_semi").join(claims.where("active").select(F.col("source_span_id").alias("span_id")), "span_id", "left_anti").select("span_id", "project_id", "confidence")


def striking_rollup(signals: DataFrame, domain: tuple[str, ...]) -> DataFrame:
    """Per span the clamped score, how many signals are valid and the first of the most confident.

    ``signals`` has span_id, striking_score, text and signals, an array of
    (type, confidence, quote); a signal is valid when its type is in the domain
    and its quote, 3 characters or more, is in the text, case and spaces aside.
    """
    flat = lambda c: F.regexp_replace(F.lower(c), r"\s+", " ")
    ok = F.filter("signals", lambda s: s["type"].isin(*domain) & (F.length(s["quote"]) >= 3) & F.contains(flat(F.col("text")), flat(s["quote"])))
    best = F.aggregate(ok, F.struct(F.lit("none").alias("type"), F.lit(-1.0).alias("confidence")), lambda a, s: F.when(s["confidence"] > a["confidence"], F.struct(s["type"].alias("type"), s["confidence"].alias("confidence"))).otherwise(a))
    return signals.select("span_id", F.greatest(F.lit(0.0), F.least(F.lit(1.0), F.col("striking_score"))).alias("score"), F.size(ok).alias("n_signals"), best["type"].alias("primary_signal"))


def belief_snapshot(claims: DataFrame, loops: DataFrame, as_of: Column, top: int = 20, most_chars: int = 6000) -> DataFrame:
    """A JSON object per project: coverage, its most relevant claims and open loops, within a size.

    Claims are ranked by recency times confidence times warrant; the least
    relevant are left out until the claims fit, by a running sum of their JSON.
    """
    rank = F.unix_seconds(F.col("created_at").cast("timestamp")) / 1e9 * F.coalesce("attribution_confidence", F.lit(0.5)) * F.when(F.col("warrant_level") == "high", 1.5).otherwise(1.0)
    best = Window.partitionBy("project_id").orderBy(F.desc("_r"), "id")
    rows = claims.where(F.col("active") & F.col("project_id").isNotNull() & (F.col("created_at") <= as_of)).withColumn("_r", rank).withColumn("_n", F.row_number().over(best)).where(F.col("_n") <= top)
    rows = rows.withColumn("_j", F.struct(F.col("_n").alias("rank"), "id", "claim_type", "claim_text")).withColumn("_len", F.sum(F.length(F.to_json("_j")) + 1).over(best.rowsBetween(Window.unboundedPreceding, 0))).where(F.col("_len") <= most_chars)
    c = rows.groupBy("project_id").agg(F.array_sort(F.collect_list("_j")).alias("claims"))
    lw = Window.partitionBy("project_id").orderBy("created_at", "id")
    open_loops = loops.where((F.col("status") == "open") & (F.col("created_at") <= as_of)).withColumn("_n", F.row_number().over(lw)).where("_n <= 10").groupBy("project_id").agg(F.array_sort(F.collect_list(F.struct(F.col("_n").alias("rank"), "id", "loop_type"))).alias("open_loops"))
    return c.join(open_loops, "project_id", "left").select("project_id", F.size("claims").alias("n_claims"), F.to_json(F.struct("claims", "open_loops")).alias("snapshot"))


def recovered_claims_proof(spans: DataFrame, claims: DataFrame) -> DataFrame:
    """One row on the active claims of the given spans: spans, claims, those with a pointer, and surplus rows of equal claims."""
    own = claims.where("active").join(spans.select(F.col("span_id").alias("source_span_id")).distinct(), "source_span_id", "left_semi")
    pointed = F.col("char_start").isNotNull() & F.col("char_end").isNotNull() & (F.col("pointer_type") == "transcript_span")
    per = own.groupBy("call_id", "source_span_id", "claim_type", "claim_text").agg(F.count("*").alias("n"), F.count_if(pointed).alias("p"))
    sums = per.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("recovered_claims"), F.coalesce(F.sum("p"), F.lit(0)).alias("with_pointer"), F.coalesce(F.sum(F.col("n") - 1), F.lit(0)).alias("duplicate_key_rows"))
    return spans.agg(F.countDistinct("span_id").alias("target_spans")).crossJoin(sums)
