"""Gates, coverage, drift and digests over spans, attributions and review queues."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.basics import at, days, latest, long_format, percent, share_of_total

OPEN = ("open", "pending")


def gate_multi_span(interactions: DataFrame, spans: DataFrame, long_chars: int = 2000) -> DataFrame:
    """Interactions over ``long_chars`` with one active span or none."""
    active = spans.where("NOT is_superseded").groupBy("interaction_id").agg(F.count("*").alias("n_spans"))
    joined = interactions.join(active, "interaction_id", "left").withColumn("n_spans", F.coalesce("n_spans", F.lit(0)))
    return joined.where((F.col("transcript_chars") > long_chars) & (F.col("n_spans") <= 1)).select("interaction_id", "transcript_chars", "n_spans")


def gate_no_gap(spans: DataFrame) -> DataFrame:
    """Active spans that do not start where the one before them ends."""
    w = Window.partitionBy("interaction_id").orderBy("span_index")
    prev = spans.where("NOT is_superseded").withColumn("prev_end", F.lag("char_end").over(w))
    return prev.where("prev_end IS NOT NULL AND char_start <> prev_end").select("interaction_id", "span_index", "char_start", "prev_end")


def gate_no_uncovered(spans: DataFrame, attributions: DataFrame, queue: DataFrame) -> DataFrame:
    """Active spans with neither an attribution nor an open review."""
    waiting = queue.where(F.col("status").isin(*OPEN) & F.col("span_id").isNotNull())
    return spans.where("NOT is_superseded").join(attributions, "span_id", "left_anti").join(waiting, "span_id", "left_anti").select("interaction_id", "span_id")


def gate_no_double_covered(spans: DataFrame, attributions: DataFrame, queue: DataFrame) -> DataFrame:
    """Active spans that are resolved and still wait for review."""
    resolved = attributions.where("decision = 'assign' AND NOT needs_review").select("span_id").distinct()
    waiting = queue.where("status = 'pending' AND span_id IS NOT NULL").select("span_id").distinct()
    return spans.where("NOT is_superseded").join(resolved, "span_id", "left_semi").join(waiting, "span_id", "left_semi").select("interaction_id", "span_id")


def run_gates(gates: dict[str, DataFrame], sample: int = 20) -> DataFrame:
    """gate, status, violations (full count) and the first ``sample`` interactions."""
    out = None
    for name, rows in gates.items():
        first = rows.select("interaction_id").distinct().orderBy("interaction_id").limit(sample).agg(F.concat_ws(",", F.array_sort(F.collect_list("interaction_id"))).alias("sample"))
        row = rows.agg(F.count("*").alias("violations")).crossJoin(F.broadcast(first)).select(F.lit(name).alias("gate"), F.when(F.col("violations") == 0, "PASS").otherwise("FAIL").alias("status"), "violations", "sample")
        out = row if out is None else out.unionByName(row)
    return out


def interaction_verdict(interactions: DataFrame, spans: DataFrame, attributions: DataFrame, queue: DataFrame) -> DataFrame:
    """The first failing check of every interaction, or PASS."""
    n = interactions.select("interaction_id", "transcript_chars")
    live = spans.where("NOT is_superseded").select("interaction_id", "span_id")
    done = attributions.select("span_id").distinct().withColumn("done", F.lit(1))
    pending = queue.where("status = 'pending'")
    waits = pending.where("span_id IS NOT NULL").select("span_id").distinct().withColumn("waits", F.lit(1))
    review = attributions.where("needs_review").select("span_id").distinct().withColumn("asks", F.lit(1))
    per = live.join(done, "span_id", "left").join(waits, "span_id", "left").join(review, "span_id", "left").groupBy("interaction_id").agg(
        F.count("*").alias("active"), F.count_if(F.col("done").isNull() & F.col("waits").isNull()).alias("uncovered"), F.count_if(F.col("asks").isNotNull() & F.col("waits").isNull()).alias("gaps"))
    old = pending.join(spans.where("is_superseded").select("span_id"), "span_id", "left_semi").groupBy("interaction_id").agg(F.count("*").alias("on_old"))
    bare = pending.where("span_id IS NULL").groupBy("interaction_id").agg(F.count("*").alias("no_span"))
    for part in (per, old, bare):
        n = n.join(part, "interaction_id", "left")
    zero = lambda c: F.coalesce(F.col(c), F.lit(0))
    verdict = (
        F.when((F.coalesce("transcript_chars", F.lit(0)) == 0) & (zero("active") == 0), "PASS_EMPTY_TRANSCRIPT_TERMINAL").when(zero("active") == 0, "FAIL_NO_ACTIVE_SPANS").when(zero("uncovered") > 0, "FAIL_UNCOVERED")
        .when(zero("on_old") > 0, "FAIL_PENDING_SUPERSEDED").when(zero("no_span") > 0, "FAIL_PENDING_NULL_SPAN").when(zero("gaps") > 0, "FAIL_REVIEW_GAP").otherwise("PASS")
    )
    return n.select("interaction_id", verdict.alias("verdict"))


def daily_digest(interactions: DataFrame, spans: DataFrame, queue: DataFrame, verdicts: DataFrame) -> DataFrame:
    """Per day: calls, passing share, reviews per call, spans and spans made again."""
    day = interactions.select("interaction_id", F.to_date("event_at_utc").alias("day"))
    reviews = queue.groupBy("interaction_id").agg(F.count("*").alias("reviews"))
    made = spans.groupBy("interaction_id").agg(F.count_if(~F.col("is_superseded")).alias("spans"), F.count_if("is_superseded").alias("again"))
    rows = day.join(verdicts, "interaction_id", "left").join(reviews, "interaction_id", "left").join(made, "interaction_id", "left")
    return rows.groupBy("day").agg(
        F.count("*").alias("calls"), percent(F.count_if(F.col("verdict").startswith("PASS")), F.count("*")).alias("pass_pct"), F.round(F.sum(F.coalesce("reviews", F.lit(0))) / F.count("*"), 3).alias("reviews_per_call"),
        F.sum(F.coalesce("spans", F.lit(0))).alias("spans"), F.sum(F.coalesce("again", F.lit(0))).alias("reseeded"))


def pipeline_drift(spans: DataFrame, attributions: DataFrame, queue: DataFrame, oversize_words: int = 2000) -> DataFrame:
    """metric, value: pending rows by cause, model errors, missing attributions, oversize spans."""
    pending = queue.where("status = 'pending'").join(spans.select("span_id", "is_superseded"), "span_id", "left")
    a = pending.agg(F.count("*").alias("pending_total"), F.count_if(F.col("span_id").isNull()).alias("pending_null_span"), F.count_if("is_superseded").alias("pending_superseded"), F.count_if(F.col("span_id").isNotNull() & F.col("is_superseded").isNull()).alias("pending_missing_span"), F.count_if(F.col("reason") == "model_error").alias("model_errors"))
    b = spans.where("NOT is_superseded").agg(F.count_if(F.col("word_count") >= oversize_words).alias("oversize_spans"))
    c = spans.where("NOT is_superseded").join(attributions, "span_id", "left_anti").agg(F.count("*").alias("missing_attribution"))
    row = a.crossJoin(F.broadcast(b)).crossJoin(F.broadcast(c))
    return long_format(row, row.columns)


def reasons_by_module(queue: DataFrame) -> DataFrame:
    return queue.where("status = 'pending'").groupBy("module", "reason").agg(F.count("*").alias("n"), F.sum("hit_count").alias("hits"))


def coverage(spans: DataFrame, attributions: DataFrame, queue: DataFrame, as_of: str, window: int = 30) -> DataFrame:
    """Spans of the window by attribution, review only, or nothing, with shares."""
    live = spans.where(~F.col("is_superseded") & (F.col("created_at") > at(as_of) - days(window)) & (F.col("created_at") <= at(as_of)))
    has = attributions.select("span_id").distinct().withColumn("a", F.lit(1))
    waits = queue.where(F.col("status").isin(*OPEN) & F.col("span_id").isNotNull()).select("span_id").distinct().withColumn("q", F.lit(1))
    kind = F.when(F.col("a") == 1, "attributed").when(F.col("q") == 1, "review_only").otherwise("uncovered")
    return share_of_total(live.join(has, "span_id", "left").join(waits, "span_id", "left").groupBy(kind.alias("coverage")).agg(F.count("*").alias("n")), "n")


def oversize_spans(spans: DataFrame, chars: int = 12000, words: int = 2000) -> DataFrame:
    size = F.col("char_end") - F.col("char_start")
    return spans.where(~F.col("is_superseded") & ((size >= chars) | (F.col("word_count") >= words))).select("span_id", "interaction_id", size.alias("chars"), "word_count")


def closed_project_attributions(attributions: DataFrame, projects: DataFrame, closed: tuple[str, ...] = ("closed",)) -> DataFrame:
    """Attributions to closed projects by phase and status."""
    ended = projects.where(F.col("status").isin(*closed)).select(F.col("id").alias("project_id"), "phase", "status")
    return attributions.where("decision = 'assign'").join(ended, "project_id").groupBy("phase", "status").agg(F.count("*").alias("n"), F.countDistinct("interaction_id").alias("calls"))


def call_span_parity(interactions: DataFrame, spans: DataFrame) -> DataFrame:
    """metric, value: six counts that set calls against spans."""
    n = spans.groupBy("interaction_id").agg(F.count_if(~F.col("is_superseded")).alias("live"), F.count_if("is_superseded").alias("old"))
    row = interactions.select("interaction_id", "transcript_chars").join(n, "interaction_id", "full").agg(
        F.count("transcript_chars").alias("calls"), F.count_if(F.col("transcript_chars").isNotNull() & (F.col("live") > 0)).alias("calls_with_spans"), F.count_if(F.col("transcript_chars").isNotNull() & F.col("live").isNull()).alias("calls_without_spans"),
        F.count_if(F.col("transcript_chars").isNull()).alias("span_sets_without_call"), F.coalesce(F.sum("live"), F.lit(0)).alias("active_spans"), F.coalesce(F.sum("old"), F.lit(0)).alias("superseded_spans"))
    return long_format(row, row.columns)


def null_offsets(spans: DataFrame) -> DataFrame:
    return spans.groupBy("interaction_id").agg(F.count("*").alias("spans"), F.count_if(F.col("char_start").isNull() | F.col("char_end").isNull()).alias("null_offsets"))


def audit_pass_rate(audit: DataFrame) -> DataFrame:
    """Per day: events and how many passed, failed or went to a person."""
    each = lambda s: F.count_if(F.col("gate_status") == s)
    return audit.groupBy(F.to_date("received_at_utc").alias("day")).agg(F.count("*").alias("events"), each("pass").alias("passed"), each("fail").alias("failed"), each("needs_human").alias("needs_human"), percent(each("pass"), F.count("*")).alias("pass_pct"))


def lineage_coverage(audit: DataFrame) -> DataFrame:
    return audit.groupBy(F.to_date("received_at_utc").alias("day")).agg(F.count("*").alias("events"), F.count("source_run_id").alias("with_lineage"), percent(F.count("source_run_id"), F.count("*")).alias("lineage_pct"))


def human_queue(audit: DataFrame) -> DataFrame:
    return audit.where("triage_action = 'queue_human'").select("id", "interaction_id", "gate_reason", "received_at_utc")


def reason_breakdown(audit: DataFrame, as_of: str) -> DataFrame:
    """Gate reasons in all and over the last 24 hours."""
    recent = (F.col("received_at_utc") > at(as_of) - days(1)) & (F.col("received_at_utc") <= at(as_of))
    return audit.where("gate_reason IS NOT NULL").groupBy("gate_reason").agg(F.count("*").alias("n"), F.count_if(recent).alias("last_24h"))


def confidence_band(c: Column) -> Column:
    return F.when(c.isNull(), "unprocessed").when(c >= 0.8, "high").when(c >= 0.5, "medium").otherwise("low")


def attribution_confidence(interactions: DataFrame) -> DataFrame:
    return share_of_total(interactions.groupBy(confidence_band(F.col("project_attribution_confidence")).alias("band")).agg(F.count("*").alias("n")), "n")


def needs_review_share(interactions: DataFrame) -> DataFrame:
    return share_of_total(interactions.groupBy("needs_review").agg(F.count("*").alias("n")), "n")


def candidate_coverage(affinity: DataFrame, contacts: DataFrame) -> DataFrame:
    """Contacts with how many projects, strong edges and confirmations; each side summed before the join."""
    edges = affinity.groupBy("contact_id").agg(F.countDistinct("project_id").alias("projects"), F.count_if(F.col("weight") >= 0.5).alias("strong"), F.sum("confirmation_count").alias("confirmations"))
    return contacts.select(F.col("id").alias("contact_id"), "contact_type").join(edges, "contact_id", "left").groupBy("contact_type").agg(F.count("*").alias("contacts"), F.count("projects").alias("with_candidates"), F.coalesce(F.sum("strong"), F.lit(0)).alias("strong_edges"))


def override_rate(overrides: DataFrame) -> DataFrame:
    return overrides.groupBy(F.to_date("created_at").alias("day")).agg(F.count("*").alias("n"), F.count_if(F.col("action") == "reject").alias("rejected"), percent(F.count_if(F.col("action") == "reject"), F.count("*")).alias("reject_pct"))


def phone_backlog(interactions: DataFrame) -> DataFrame:
    """Interactions without a phone, tiered by what they could be repaired from."""
    tier = F.when(F.col("contact_name").isNotNull() & F.col("project_id").isNotNull(), "tier1_name_and_project").when(F.col("contact_name").isNotNull(), "tier2_name").when(F.col("project_id").isNotNull(), "tier3_project").otherwise("tier4_nothing")
    return interactions.where("contact_phone IS NULL").select("interaction_id", tier.alias("tier"), "transcript_chars")


def backlog_summary(backlog: DataFrame) -> DataFrame:
    """Rows and characters by tier, with a TOTAL row."""
    return backlog.rollup("tier").agg(F.count("*").alias("n"), F.sum("transcript_chars").alias("chars"), F.grouping("tier").alias("_g")).select(F.when(F.col("_g") == 1, "TOTAL").otherwise(F.col("tier")).alias("tier"), "n", "chars")


def phone_parity(calls: DataFrame, interactions: DataFrame) -> DataFrame:
    """Per call, whether the stored phone is there and agrees with the raw one."""
    raw = calls.select(F.regexp_replace("interaction_id", "^cll_(TEST_)?", "").alias("interaction_id"), F.col("other_party_phone").alias("raw_phone"))
    joined = raw.join(interactions.select("interaction_id", "contact_phone"), "interaction_id", "left")
    state = F.when(F.col("raw_phone").isNull() & F.col("contact_phone").isNull(), "FAIL_MISSING_PHONE").when(F.col("raw_phone").isNull() | F.col("contact_phone").isNull(), "WARN").when(F.col("raw_phone") != F.col("contact_phone"), "FAIL_DRIFT").otherwise("PASS")
    return joined.select("interaction_id", "raw_phone", "contact_phone", state.alias("parity"))


def parity_summary(parity: DataFrame) -> DataFrame:
    return share_of_total(parity.groupBy("parity").agg(F.count("*").alias("n")), "n")


def daily_ops_dashboard(interactions: DataFrame, queue: DataFrame, audit: DataFrame) -> DataFrame:
    a = interactions.agg(F.count("*").alias("interactions"), F.count_if("needs_review").alias("needs_review"), F.count_if(F.col("contact_phone").isNull()).alias("missing_phone"))
    b = queue.agg(F.count_if(F.col("status") == "pending").alias("pending_reviews"))
    c = audit.agg(F.count_if(F.col("gate_status") == "fail").alias("failed_events"), F.count("source_run_id").alias("events_with_lineage"))
    row = a.crossJoin(F.broadcast(b)).crossJoin(F.broadcast(c))
    return long_format(row, row.columns)


def drift_distribution(df: DataFrame, field: str) -> DataFrame:
    return share_of_total(df.groupBy(F.col(field).alias("value")).agg(F.count("*").alias("n")), "n")


def drift_violations(df: DataFrame, field: str, domain: list[str]) -> DataFrame:
    return df.where(F.col(field).isNotNull() & ~F.col(field).isin(*domain)).groupBy(F.col(field).alias("value")).agg(F.count("*").alias("n"))


def drift_new_values(df: DataFrame, field: str, time: str, as_of: str, window: int = 7) -> DataFrame:
    """Values seen in the window and never before it; null is no value."""
    since = at(as_of) - days(window)
    known = df.where(F.col(field).isNotNull() & (F.col(time) <= at(as_of)))
    return known.groupBy(F.col(field).alias("value")).agg(F.min(time).alias("first_seen"), F.count("*").alias("n")).where(F.col("first_seen") > since)


def drift_case_variants(df: DataFrame, field: str) -> DataFrame:
    """Values that differ in case only."""
    seen = df.where(F.col(field).isNotNull()).groupBy(F.lower(field).alias("folded")).agg(F.countDistinct(field).alias("variants"), F.concat_ws("|", F.array_sort(F.collect_set(field))).alias("spellings"), F.count("*").alias("n"))
    return seen.where("variants > 1")


def drift_dashboard(df: DataFrame, limits: dict[str, tuple[int, int]]) -> DataFrame:
    """Distinct values of each field against its limits: GREEN, YELLOW or RED and a score."""
    row = df.agg(*(F.countDistinct(f).alias(f) for f in limits))
    edges = F.map_from_arrays(F.array(*map(F.lit, limits)), F.array(*(F.array(F.lit(a), F.lit(b)) for a, b in limits.values())))
    rows = long_format(row, list(limits)).withColumn("_l", F.element_at(edges, F.col("metric")))
    health = F.when(F.col("value") <= F.col("_l")[0], "GREEN").when(F.col("value") <= F.col("_l")[1], "YELLOW").otherwise("RED")
    return rows.select("metric", F.col("value").cast("long").alias("distinct_values"), health.alias("health"), F.when(health == "GREEN", 100).when(health == "YELLOW", 50).otherwise(0).alias("score"))


def drift_snapshot(df: DataFrame, fields: list[str], day: str) -> DataFrame:
    """day, field, distinct values and health by the snapshot's own limits."""
    rows = long_format(df.agg(*(F.countDistinct(f).alias(f) for f in fields)), fields)
    v = F.col("value")
    return rows.select(F.lit(day).cast("date").alias("day"), F.col("metric").alias("field"), v.cast("long").alias("distinct_values"), F.when(v <= 15, "GREEN").when(v <= 80, "YELLOW").when(v <= 500, "ORANGE").otherwise("RED").alias("health"))


def project_feed(projects: DataFrame, interactions: DataFrame, claims: DataFrame, loops: DataFrame, striking: DataFrame, queue: DataFrame, as_of: str) -> DataFrame:
    """A row per project: totals, seven-day counts, open loops, signals, reviews and a risk flag."""
    week = lambda t: (F.col(t) > at(as_of) - days(7)) & (F.col(t) <= at(as_of))
    parts = [
        interactions.groupBy("project_id").agg(F.count("*").alias("calls"), F.count_if(week("event_at_utc")).alias("calls_7d"), F.max("event_at_utc").alias("last_call")),
        claims.where("active").groupBy("project_id").agg(F.count("*").alias("claims"), F.count_if(week("created_at")).alias("claims_7d")),
        loops.groupBy("project_id").agg(F.count_if(F.col("status") == "open").alias("open_loops")),
        striking.groupBy("project_id").agg(F.count("*").alias("signals"), F.count_if(week("created_at")).alias("signals_7d")),
        queue.where("status = 'pending'").groupBy("project_id").agg(F.count("*").alias("pending_reviews")),
    ]
    out = projects.select(F.col("id").alias("project_id"), "name", "status")
    for p in parts:
        out = out.join(p, "project_id", "left")
    numbers = [c for p in parts for c in p.columns if c not in ("project_id", "last_call")]
    out = out.select("project_id", "name", "status", *(F.coalesce(c, F.lit(0)).alias(c) for c in numbers), "last_call")
    risk = F.when(F.col("open_loops") >= 5, "high_open_loops").when(F.col("signals_7d") >= 3, "elevated_striking").when(F.col("last_call").isNull() | (F.col("last_call") < at(as_of) - days(14)), "stale").otherwise("ok")
    return out.withColumn("risk", risk)


def primary_project(interactions: DataFrame, attributions: DataFrame) -> DataFrame:
    """The call's own project, else the project most of its spans are assigned to; ties to the latest, then the id."""
    counts = attributions.where("decision = 'assign' AND project_id IS NOT NULL").groupBy("interaction_id", "project_id").agg(F.count("*").alias("n"), F.count("attribution_lock").alias("locks"), F.max("attributed_at").alias("last"))
    best = latest(counts, ["interaction_id"], F.desc("n"), F.desc("last"), F.col("project_id"))
    out = interactions.select("interaction_id", F.col("project_id").alias("own")).join(best, "interaction_id", "left")
    return out.select("interaction_id", F.coalesce("own", "project_id").alias("primary_project"), F.when(F.col("own").isNotNull(), "call").when(F.col("project_id").isNotNull(), "spans").otherwise("none").alias("basis"), F.coalesce("locks", F.lit(0)).alias("locks"))


def best_applied_project(attributions: DataFrame) -> DataFrame:
    """Per call the applied span project of highest confidence."""
    rows = attributions.where("decision = 'assign' AND project_id IS NOT NULL")
    return latest(rows, ["interaction_id"], F.desc("confidence"), F.desc("attributed_at"), F.col("attribution_id")).select("interaction_id", "project_id", "confidence")


def projects_with_phase(projects: DataFrame, interactions: DataFrame, claims: DataFrame) -> DataFrame:
    calls = interactions.groupBy("project_id").agg(F.count("*").alias("calls"))
    made = claims.where("active").groupBy("project_id").agg(F.count("*").alias("claims"))
    return projects.select(F.col("id").alias("project_id"), "name", "phase", "status").join(calls, "project_id", "left").join(made, "project_id", "left").select("project_id", "name", "phase", "status", F.coalesce("calls", F.lit(0)).alias("calls"), F.coalesce("claims", F.lit(0)).alias("claims"))


def morning_manifest(queue: DataFrame, interactions: DataFrame, contacts: DataFrame) -> DataFrame:
    """Pending items with their call and contact."""
    c = contacts.select(F.col("id").alias("contact_id"), F.col("name").alias("contact"), "is_internal")
    return queue.where("status = 'pending'").select("id", "interaction_id", "module", "reason", F.col("created_at").alias("due_at")).join(interactions.select("interaction_id", "contact_id", "channel", "event_at_utc"), "interaction_id").join(c, "contact_id", "left").select("id", "interaction_id", "module", "reason", "due_at", "channel", "event_at_utc", "contact", "is_internal")


def invalid_keyword_json(df: DataFrame, column: str) -> DataFrame:
    """Rows whose JSON does not parse or is not an array; null is no JSON."""
    fine = F.try_parse_json(column).isNotNull() & F.ltrim(F.col(column)).startswith("[")
    return df.where(F.col(column).isNotNull() & ~fine)


def non_postable_codes(used: DataFrame, codes: DataFrame) -> DataFrame:
    """Codes in use that are no postable code, with how often."""
    return used.where("code IS NOT NULL").join(codes.where("code_type = 'COST_CODE'"), "code", "left_anti").groupBy("code").agg(F.count("*").alias("n"))


def pending_null_span(queue: DataFrame) -> DataFrame:
    """Pending review rows without a span, counted by module and reason."""
    return queue.where("status = 'pending' AND span_id IS NULL").groupBy("module", "reason").agg(F.count("*").alias("n"), F.min("created_at").alias("oldest"))


def pending_superseded(queue: DataFrame, spans: DataFrame) -> DataFrame:
    """Pending review rows whose span has been superseded."""
    return queue.where("status = 'pending'").join(spans.where("is_superseded").select("span_id", "segment_generation"), "span_id").select("id", "interaction_id", "span_id", "segment_generation", "created_at")


def financial_coverage(interactions: DataFrame) -> DataFrame:
    """Per channel how many interactions have a financial JSON, by its inference status, and their share in percent."""
    status, has = F.get_json_object("financial_json", "$.inference_status"), F.col("financial_json").isNotNull()
    by = [F.count_if(status == s).alias(s) for s in ("auto_assigned", "flagged_for_review", "no_inference")]
    rows = interactions.groupBy("channel").agg(F.count("*").alias("total"), F.count_if(has).alias("with_json"), *by, F.count_if(~has).alias("pending"))
    return rows.withColumn("coverage_pct", F.round(100.0 * F.col("with_json") / F.col("total"), 1))
