"""Evidence that a span is about a project: sources, aggregation, ranking."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..plans.match import find_terms, named_groups, tokens, with_members, within_distance

EVIDENCE = ["span_id", "project_id", "source", "weight", "score", "assigned", "strong", "evidence"]


def evidence(df: DataFrame, source: str, weight: Column | float = 0.0, score: Column | float = 0.0, assigned: Column | bool = False, strong: Column | bool | None = None, text: Column | None = None) -> DataFrame:
    """Rows of one source in the common form; strong is null where the source has no alias evidence."""
    lit = lambda x, kind: (x if isinstance(x, Column) else F.lit(x)).cast(kind)
    return df.select("span_id", "project_id", F.lit(source).alias("source"), lit(weight, "double").alias("weight"), lit(score, "double").alias("score"), lit(assigned, "boolean").alias("assigned"), lit(strong, "boolean").alias("strong"), (text if text is not None else F.lit(None)).cast("string").alias("evidence"))


def from_project_contacts(spans: DataFrame, links: DataFrame, base: float = 0.22, trade: float = 0.18) -> DataFrame:
    """Direct links of the span's contact; equal trade adds to the score."""
    rows = spans.select("span_id", "contact_id", F.col("trade").alias("_t")).join(links.where("is_active").select("contact_id", "project_id", "trade"), "contact_id")
    return evidence(rows, "project_contacts", score=F.lit(base) + F.when(F.col("trade").eqNullSafe(F.col("_t")), trade).otherwise(0.0), assigned=True)


def from_affinity(spans: DataFrame, edges: DataFrame) -> DataFrame:
    """Edges of the span's contact, halved for internal floaters."""
    rows = spans.select("span_id", "contact_id", "is_floater").join(edges.where("weight > 0").select("contact_id", "project_id", "weight"), "contact_id").withColumn("w", F.col("weight") * F.when(F.col("is_floater"), 0.5).otherwise(1.0))
    return evidence(rows, "affinity", F.col("w"), F.col("w"))


def from_existing_project(spans: DataFrame, score: float = 0.11) -> DataFrame:
    return evidence(spans.where("project_id IS NOT NULL").select("span_id", "project_id"), "existing_project", score=score)


def match_strength(kind: Column, term: Column) -> Column:
    """Strong: an exact name, an address, several words, or an alias of six characters or more."""
    return (kind == "name") | term.rlike(r"^\d+\s+\S") | F.trim(term).rlike(r"\S\s+\S") | (F.length(F.trim(term)) >= 6)


def from_terms(spans: DataFrame, aliases: DataFrame, longest: int | None = None, ignored: tuple[str, ...] = ()) -> DataFrame:
    """Names and aliases in the text: evidence rows without a score."""
    terms = aliases.where(~F.lower("term").isin(*ignored)) if ignored else aliases
    rows = find_terms(spans.select("span_id", "text"), terms.select("project_id", "term", "kind"), "span_id", longest)
    return evidence(rows, "transcript_terms", strong=match_strength(F.col("kind"), F.col("term")), text=F.concat_ws(":", "kind", "term", "first_token"))


def from_alias_scan(scans: DataFrame, key: str = "interaction_id") -> DataFrame:
    """Projects that an alias scan found in a text, weighted by the best score; evidence is the alias it has it from."""
    best = scans.groupBy(F.col(key).alias("span_id"), "project_id").agg(F.max("score").alias("score"), F.max_by("alias", F.struct("score", "alias")).alias("alias"))
    return evidence(best, "alias_scan", weight=F.col("score"), text=F.col("alias"))


def from_geo(places: DataFrame, projects: DataFrame, km: float = 50.0, nearest: int = 5) -> DataFrame:
    """The nearest projects of a span's places: nearer and directed mentions score more.

    ``places`` has span_id, place, lat, lon, role; the role that decides is the
    most frequent, destination before origin before proximity on a tie.

    Positions meet, each once. Projects of the same position are as far and as
    often met, so only the ``nearest`` first of them, by id, can be returned.
    """
    where = projects.select(F.col("id").alias("project_id"), F.struct(F.col("lat").alias("t_lat"), F.col("lon").alias("t_lon")).alias("_p")).groupBy("project_id").agg(F.array_sort(F.collect_list("_p")).alias("_at"))
    first = where.withColumn("_n", F.row_number().over(Window.partitionBy("_at").orderBy("project_id"))).where(F.col("_n") <= nearest)
    sites = first.groupBy("_at").agg(F.array_sort(F.collect_list("project_id")).alias("_ids")).select(F.element_at("_ids", 1).alias("_site"), "_ids", "_at")
    pairs = within_distance(places.select("lat", "lon").distinct(), sites.select("_site", F.inline("_at")), km).select("lat", "lon", "_site", "distance")
    met = places.join(pairs, ["lat", "lon"])
    best = met.groupBy("span_id", "_site").agg(F.min("distance").alias("distance"), F.countDistinct("place").alias("n"), *(F.count_if(F.col("role") == r).alias(r) for r in ("destination", "origin", "proximity")))
    by = Window.partitionBy("span_id")
    best = best.withColumn("_rn", F.row_number().over(by.orderBy("distance", "_site"))).where(F.col("_rn") <= nearest).join(sites.select("_site", "_ids"), "_site").withColumn("project_id", F.explode("_ids"))
    directed = (F.greatest("destination", "origin") >= F.col("proximity")) & (F.greatest("destination", "origin") > 0)
    score = 0.05 + 0.35 * (1 - F.col("distance") / km) + F.when(directed, 0.12).otherwise(0.0) + F.least(F.lit(0.08), 0.02 * (F.col("n") - 1))
    rows = best.withColumn("_rn", F.row_number().over(by.orderBy("distance", "project_id"))).where(F.col("_rn") <= nearest)
    return evidence(rows, "geo_proximity", score=F.greatest(F.lit(0.05), F.least(F.lit(0.55), score)), text=F.round("distance", 3))


def for_every_candidate(candidates: DataFrame, spans: DataFrame, source: str, score: Column | float) -> DataFrame:
    """A score for every candidate of the given spans: material signal, floater anti-signal."""
    rows = candidates.select("span_id", "project_id").distinct().join(spans, "span_id")
    return evidence(rows, source, score=score)


def from_structural_type(spans: DataFrame, keywords: DataFrame, projects: DataFrame) -> DataFrame:
    """Projects of the type that a keyword in the text names: 0.50 if there is one, else 0.30."""
    named = named_groups(spans.select("span_id", "text"), keywords, "span_id", "type")
    # How many a type has is counted once, not for each span.
    n = projects.groupBy("type").agg(F.count("*").alias("_n"))
    rows = with_members(named, "span_id", projects.select(F.col("id").alias("project_id"), "type").join(n, "type"), "type", "project_id")
    return evidence(rows, "structural_type", score=F.when(F.col("_n") == 1, 0.50).otherwise(0.30))


def from_budget_tier(spans: DataFrame, tiers: DataFrame, projects: DataFrame, nearest: int = 3, score: float = 0.40) -> DataFrame:
    """The projects whose value is nearest to the middle of the tier a keyword names.

    The nearest are found per tier, so projects meet tiers, not spans.
    """
    middles = tiers.select("tier", ((F.col("low") + F.col("high")) / 2).cast("double").alias("middle")).distinct()
    values = projects.where("contract_value IS NOT NULL").select(F.col("id").alias("project_id"), F.col("contract_value").cast("double").alias("v"))
    gap = F.abs(F.col("v") - F.col("middle"))
    # A table of tiers is a parameter of a few rows, and each task keeps its nearest before they meet.
    near = values.join(F.broadcast(middles)).withColumn("_rn", F.row_number().over(Window.partitionBy("tier", "middle").orderBy(gap, "project_id"))).where(F.col("_rn") <= nearest)
    named = named_groups(spans.select("span_id", "text"), tiers.select("term", "tier"), "span_id", "tier")
    # There are few tiers, so an exchange by tier would send all spans to as few tasks.
    return evidence(named.join(F.broadcast(near.select("tier", "project_id")), "tier"), "budget_tier", score=score, text=F.col("tier"))


def from_email_mentions(spans: DataFrame, messages: DataFrame, mentions: DataFrame, days: int = 30, score: float = 0.45) -> DataFrame:
    """Projects named in messages of the span's contact within ``days`` of it, on either side; evidence is how many messages.

    Messages are first counted by contact, project and time, and a contact's
    spans of one time are one; these meet on the contact and on bins of
    ``days``: counts are filed under their own bin and both beside it, and the
    distance decides. A message that has several times counts once.
    """
    bin_ = lambda c: F.floor(F.unix_micros(F.col(c).cast("timestamp")) / (days * 86_400_000_000)).cast("long")
    sent = messages.where("contact_id IS NOT NULL AND sent_at IS NOT NULL").groupBy("contact_id", "message_id").agg(F.array_sort(F.collect_set("sent_at")).alias("_times"))
    counted = sent.join(mentions.select("message_id", "project_id").distinct(), "message_id").groupBy("contact_id", "_times", "project_id").agg(F.count("*").alias("n"))
    filed = counted.withColumn("sent_at", F.explode("_times")).withColumn("_b", F.explode(F.array(bin_("sent_at") - 1, bin_("sent_at"), bin_("sent_at") + 1)))
    when = spans.where("event_at_utc IS NOT NULL").select("span_id", "contact_id", "event_at_utc")
    asked = when.select("contact_id", "event_at_utc", bin_("event_at_utc").alias("_b")).distinct()
    gap = F.expr(f"INTERVAL {days} DAYS")
    near = asked.join(filed, ["contact_id", "_b"]).where((F.col("sent_at") >= F.col("event_at_utc") - gap) & (F.col("sent_at") <= F.col("event_at_utc") + gap))
    # Several times of a message may lie within one window.
    near = near.select("contact_id", "event_at_utc", "project_id", "_times", "n").distinct()
    sums = near.groupBy("contact_id", "event_at_utc", "project_id").agg(F.sum("n").alias("n"))
    found = when.distinct().join(sums, ["contact_id", "event_at_utc"])
    return evidence(found, "gmail_content_match", score=score, text=F.col("n").cast("string"))


def from_cross_contact_claims(terms: DataFrame, claims: DataFrame, projects: DataFrame, least: int = 2, most: int = 100, top: int = 5, score: float = 0.20) -> DataFrame:
    """Open client projects whose confirmed claims have any of a span's terms: ``score`` times hits over 5, at most once, for the ``top`` first.

    ``terms`` has span_id and term, one word each; spans of fewer than ``least``
    terms are left out. Of the claims with a span's terms the first ``most`` by
    id count. A term's claims are cut to as many before they meet spans: the
    first of all terms together are among the first of each, so a term that
    every claim has costs no more than a rare one; and none counts that comes
    after the last of another term of the span with ``most``. Spans with the
    same terms are looked at once.
    """
    words = claims.where("active AND claim_confirmation_state = 'confirmed' AND project_id IS NOT NULL").select("id", "project_id", F.explode(F.array_distinct(tokens(F.col("claim_text")))).alias("term"))
    first = Window.partitionBy("term").orderBy("id")
    postings = words.withColumn("_n", F.row_number().over(first)).where(F.col("_n") <= most).drop("_n")
    asked = terms.select("span_id", F.lower("term").alias("term")).where(F.length("term") > 1)
    sets = asked.groupBy("span_id").agg(F.array_sort(F.collect_set("term")).alias("_set")).where(F.size("_set") >= least)
    ends = postings.groupBy("term").agg(F.count("*").alias("_n"), F.max("id").alias("_end")).where(F.col("_n") >= most).select("term", "_end")
    each = sets.select("_set").distinct().withColumn("_s", F.xxhash64("_set")).withColumn("term", F.explode("_set"))
    upto = each.join(ends, "term").groupBy("_s", "_set").agg(F.min("_end").alias("_upto"))
    asks = each.join(upto, ["_s", "_set"], "left")
    met = asks.join(postings, "term").where("_upto IS NULL OR id <= _upto").select("_s", "_set", "id", "project_id").distinct()
    met = met.withColumn("_n", F.row_number().over(Window.partitionBy("_s", "_set").orderBy("id"))).where(F.col("_n") <= most)
    open_ = projects.where(F.col("status").isin("active", "warranty", "estimating") & (F.col("project_kind") == "client")).select(F.col("id").alias("project_id"))
    hits = met.groupBy("_s", "_set", "project_id").agg(F.count("*").alias("hits")).join(open_, "project_id", "left_semi")
    best = hits.withColumn("_n", F.row_number().over(Window.partitionBy("_s", "_set").orderBy(F.desc("hits"), "project_id"))).where(F.col("_n") <= top)
    best = sets.withColumn("_s", F.xxhash64("_set")).join(best, ["_s", "_set"])
    return evidence(best, "cross_contact_claim_match", score=score * F.least(F.col("hits") / 5, F.lit(1.0)), text=F.col("hits").cast("string"))


def aggregate_candidates(*sources: DataFrame) -> DataFrame:
    """One row per (span, project): sources, largest weight, sum of scores, alias evidence."""
    rows = sources[0].select(*EVIDENCE)
    for s in sources[1:]:
        rows = rows.unionByName(s.select(*EVIDENCE))
    return rows.groupBy("span_id", "project_id").agg(
        F.concat_ws(",", F.array_sort(F.collect_set("source"))).alias("sources"), F.countDistinct("source").alias("n_sources"), F.max("weight").alias("weight"), F.sum("score").alias("score"), F.bool_or("assigned").alias("assigned"),
        F.count("strong").alias("n_alias"), F.count_if(F.col("strong")).alias("n_strong"), F.min(F.when(F.col("source") == "geo_proximity", F.col("evidence").cast("double"))).alias("distance"))


PROFILE = ["contact_id", "trade", "is_floater"]


def contact_candidates(spans: DataFrame, links: DataFrame, edges: DataFrame) -> DataFrame:
    """Candidates of each different contact, trade and is_floater of ``spans``: links and affinity, aggregated once for all its spans."""
    who = spans.where("contact_id IS NOT NULL").select(*PROFILE).distinct().withColumn("span_id", F.struct(*PROFILE))
    found = aggregate_candidates(from_project_contacts(who, links), from_affinity(who, edges))
    return found.select("span_id.*", *(c for c in found.columns if c != "span_id"))


def span_candidates(spans: DataFrame, by_contact: DataFrame, existing: float = 0.11, cap: int | None = None) -> DataFrame:
    """What ``aggregate_candidates`` makes of links, affinity and existing projects, from candidates by contact.

    Only spans and the candidates of contacts are exchanged, not their pairs. A
    span's existing project adds to the candidate of its contact or is one of
    its own; span_id is a span's only one. For a ranking to ``cap`` only a
    contact's first ``cap`` are needed beside the existing project, which alone
    moves, and only up.
    """
    mine = [F.col(c).eqNullSafe(F.col(f"_{c}")) for c in PROFILE[1:]]
    theirs = by_contact.withColumnsRenamed({c: f"_{c}" for c in PROFILE[1:]} | {"project_id": "_project"})
    same = F.col("contact_id") == F.col("_contact")
    theirs = theirs.withColumnRenamed("contact_id", "_contact")
    rows = spans.select("span_id", *PROFILE, "project_id")
    fields = [c for c in by_contact.columns if c not in (*PROFILE, "project_id")]
    first = theirs
    if cap is not None:
        ranked = rank_candidates(flag_weak(theirs.withColumnsRenamed({"_project": "project_id"}).withColumn("span_id", F.struct("_contact", *(f"_{c}" for c in PROFILE[1:])))), cap)
        first = ranked.withColumnRenamed("project_id", "_project").select(theirs.columns)
    other = rows.join(first, same & mine[0] & mine[1] & ~F.col("_project").eqNullSafe(F.col("project_id"))).select("span_id", F.col("_project").alias("project_id"), *fields)
    own = rows.where("project_id IS NOT NULL").join(theirs, same & mine[0] & mine[1] & (F.col("_project") == F.col("project_id")), "left")
    adds = {"n_sources": 1, "n_alias": 0, "n_strong": 0, "weight": 0.0, "score": existing}
    made = {c: (F.coalesce(F.col(c), F.lit(0)) + n).cast(by_contact.schema[c].dataType) for c, n in adds.items()}
    made["weight"] = F.greatest(F.coalesce("weight", F.lit(0.0)), F.lit(0.0))
    made["sources"] = F.array_join(F.array_sort(F.filter(F.array_append(F.split(F.coalesce("sources", F.lit("")), ","), F.lit("existing_project")), lambda x: x != "")), ",")
    made["assigned"] = F.coalesce("assigned", F.lit(False))
    return other.unionByName(own.withColumns(made).select("span_id", "project_id", *fields))


def apply_blocklist(candidates: DataFrame, blocked: DataFrame) -> DataFrame:
    return candidates.join(blocked.where("hard AND active").select("project_id"), "project_id", "left_anti")


def owner_override(candidates: DataFrame, spans: DataFrame, links: DataFrame, boost: float = 1.25) -> DataFrame:
    """A span whose contact owns exactly one project keeps only that, boosted, unless a strong anchor speaks for another."""
    owned = links.where("role = 'owner' AND is_active").groupBy("contact_id").agg(F.countDistinct("project_id").alias("_n"), F.min("project_id").alias("owned")).where("_n = 1")
    own = spans.select("span_id", "contact_id").join(owned, "contact_id").select("span_id", "owned")
    against = candidates.join(own, "span_id").where("n_strong > 0 AND project_id <> owned").select("span_id").distinct()
    rows = candidates.join(own.join(against, "span_id", "left_anti"), "span_id", "left")
    kept = rows.where("owned IS NULL OR project_id = owned")
    mine = F.col("owned").isNotNull()
    return kept.withColumn("score", F.col("score") + F.when(mine, boost).otherwise(0.0)).withColumn("assigned", F.col("assigned") | mine).withColumn("owner_override", mine).drop("owned")


def flag_weak(candidates: DataFrame) -> DataFrame:
    """weak_only: alias evidence, none of it strong, and no direct link."""
    return candidates.withColumn("weak_only", (F.col("n_alias") > 0) & (F.col("n_strong") == 0) & ~F.col("assigned"))


def demote_ambiguous(candidates: DataFrame, ambiguous: DataFrame, by: float = 0.65) -> DataFrame:
    """Candidates that rest on an ambiguous word alone lose ``by``, not below 0."""
    rows = candidates.join(ambiguous.select("span_id", "project_id").distinct().withColumn("_amb", F.lit(True)), ["span_id", "project_id"], "left")
    down = F.coalesce(F.col("_amb"), F.lit(False)) & (F.col("n_sources") == 1) & ~F.col("assigned")
    return rows.withColumn("demoted", down).withColumn("score", F.when(down, F.greatest(F.lit(0.0), F.col("score") - by)).otherwise(F.col("score"))).drop("_amb")


def rank_candidates(candidates: DataFrame, cap: int = 8) -> DataFrame:
    """The best ``cap`` candidates of each span, in one order with the project id last."""
    geo_only = F.col("sources") == "geo_proximity"
    order = [F.desc("assigned"), F.asc("weak_only"), F.desc("n_alias"), F.desc("n_strong"), F.desc("n_sources"), F.desc(F.coalesce("weight", F.lit(0.0))), F.desc(F.coalesce("score", F.lit(0.0))), geo_only.asc(), F.col("distance").asc_nulls_last(), F.col("project_id")]
    return candidates.withColumn("rank", F.row_number().over(Window.partitionBy("span_id").orderBy(*order))).where(F.col("rank") <= cap)


def continuity_links(calls: DataFrame, hours: int = 48, most: int = 5) -> DataFrame:
    """Each call's earlier calls of the contact within ``hours``: tier 1 same project, 2 called back, 3 recent.

    A gap over 4 hours needs tier 1. An equi-join on the contact and the days
    the window touches; then the range.
    """
    a = calls.select("interaction_id", "contact_id", "event_at_utc", "project_id", "channel").withColumn("_d", F.explode(F.sequence(F.lit(0), F.lit(-(-hours // 24))))).withColumn("_day", F.date_sub(F.to_date("event_at_utc"), F.col("_d")))
    b = calls.select("contact_id", F.col("interaction_id").alias("prior_id"), F.col("event_at_utc").alias("_t"), F.col("project_id").alias("_p"), F.col("channel").alias("_c"), F.to_date("event_at_utc").alias("_day"))
    gap = F.timestamp_diff("SECOND", F.col("_t"), F.col("event_at_utc"))
    met = a.join(b, ["contact_id", "_day"]).where((F.col("_t") < F.col("event_at_utc")) & (F.col("_t") >= F.col("event_at_utc") - F.expr(f"interval {hours} hours")))
    tier = F.when(F.col("project_id") == F.col("_p"), 1).when(F.col("channel") == F.col("_c"), 2).otherwise(3)
    rows = met.select("interaction_id", "prior_id", tier.alias("tier"), gap.alias("gap_s")).where("tier = 1 OR gap_s <= 14400")
    return rows.withColumn("rank", F.row_number().over(Window.partitionBy("interaction_id").orderBy("tier", "gap_s", "prior_id"))).where(F.col("rank") <= most)


def intake_rank(rows: DataFrame) -> DataFrame:
    """rank_score and confidence of (interaction, project) rows with assigned, existing, mentioned, affinity, n_alias, weak, n_sources."""
    score = F.when(F.col("assigned"), 100).otherwise(0) + F.when(F.col("existing"), F.when(F.col("assigned"), 20).otherwise(80)).otherwise(0) + F.when(F.col("mentioned"), 40).otherwise(0) + F.least(10 * F.col("affinity"), F.lit(50.0))
    score = score + F.when(F.col("weak"), F.least(10 * F.col("n_alias"), F.lit(30))).otherwise(F.least(20 * F.col("n_alias"), F.lit(60)))
    sure = score / 330.0 + F.when(F.col("n_sources") >= 3, 0.1).otherwise(0.0) + F.when(F.col("n_alias") >= 2, 0.05).otherwise(0.0)
    out = rows.withColumn("rank_score", score).withColumn("confidence", F.when(F.col("weak"), F.least(F.lit(0.35), sure)).otherwise(F.least(F.lit(0.99), sure)))
    return out.withColumn("rank", F.row_number().over(Window.partitionBy("interaction_id").orderBy(F.desc("rank_score"), "project_id")))


def auto_assign(ranked: DataFrame, client_projects: DataFrame) -> DataFrame:
    """Per interaction the assigned project and the rule: a single client project, a solo candidate, or a clear first.

    ``ranked`` has interaction_id, contact_id, project_id, rank, rank_score, confidence;
    ``client_projects`` the active client projects of contacts.
    """
    one = client_projects.groupBy("contact_id").agg(F.countDistinct("project_id").alias("n_client"), F.min("project_id").alias("only_client"))
    top = ranked.groupBy("interaction_id", "contact_id").agg(F.count("*").alias("n"), F.max(F.when(F.col("rank") == 1, F.col("project_id"))).alias("first"), F.max(F.when(F.col("rank") == 1, F.col("rank_score"))).alias("s1"), F.max(F.when(F.col("rank") == 2, F.col("rank_score"))).alias("s2"), F.max(F.when(F.col("rank") == 1, F.col("confidence"))).alias("c1"))
    rows = top.join(one, "contact_id", "left")
    n_client = F.coalesce("n_client", F.lit(0))
    rule = F.when(n_client == 1, "single_client_project").when((F.col("n") == 1) & (n_client <= 3), "solo_candidate").when((F.col("s1") >= 150) & (F.col("s1") >= 2 * F.coalesce("s2", F.lit(0.0))) & (F.col("c1").isNull() | (F.col("c1") >= 0.55)), "clear_first").otherwise("no_rule")
    return rows.select("interaction_id", rule.alias("rule"), F.when(rule == "single_client_project", F.col("only_client")).when(rule != "no_rule", F.col("first")).alias("project_id"))


def claim_overlap(spans: DataFrame, claims: DataFrame, recent: int = 8, scale: float = 2.2, cap: float = 0.35) -> DataFrame:
    """The best share of a recent confirmed claim's words that a span of the same contact has."""
    w = Window.partitionBy("contact_id", "project_id").orderBy(F.desc("created_at"), "id")
    some = claims.where("active AND project_id IS NOT NULL AND claim_confirmation_state = 'confirmed'").withColumn("_rn", F.row_number().over(w)).where(F.col("_rn") <= recent)
    words = lambda c: F.array_distinct(F.filter(F.split(F.lower(c), r"[^a-z0-9]+"), lambda x: F.length(x) >= 4))
    c = some.select("contact_id", "project_id", F.col("id").alias("claim_id"), words(F.col("claim_text")).alias("_w")).where(F.size("_w") > 0).select("contact_id", "project_id", "claim_id", F.size("_w").alias("_n"), F.explode("_w").alias("word"))
    s = spans.select("span_id", "contact_id", F.explode(words(F.col("text"))).alias("word"))
    per = s.join(c, ["contact_id", "word"]).groupBy("span_id", "project_id", "claim_id").agg((scale * F.count("*") / F.first("_n")).alias("_s"))
    return evidence(per.groupBy("span_id", "project_id").agg(F.least(F.lit(cap), F.max("_s")).alias("s")), "claim_overlap", score=F.col("s"))


def claim_crossref(spans: DataFrame, candidates: DataFrame, claims: DataFrame, terms: DataFrame | None = None) -> DataFrame:
    """score of each (span, candidate): IDF-weighted share of the span's terms that the project's claims have.

    A term is there if each of its words of four letters or more begins with a
    claim word of the project or a claim word begins with it, by five letters
    or more, or both are equal. IDF counts only the span's candidates that have
    claims. With ``terms`` (span_id, term, weight) these count, each by its
    weight.

    A span's terms go to each of its projects as one row, meet the project's
    words there, and come back as one flag a term, so words are never exchanged
    one by one.
    """
    cut = lambda c: F.array_distinct(F.filter(F.split(F.lower(c), r"[^a-z0-9]+"), lambda x: F.length(x) >= 4))
    if terms is None:
        said = spans.groupBy("span_id").agg(F.array_distinct(F.flatten(F.collect_list(cut(F.col("text"))))).alias("_t"))
        asked = said.select("span_id", F.transform("_t", lambda t: F.array(t)).alias("_p"), F.transform("_t", lambda t: F.lit(1.0)).alias("_w"))
    else:
        parts = terms.select("span_id", cut(F.col("term")).alias("p"), F.col("weight").cast("double").alias("w")).where(F.size("p") > 0)
        asked = parts.groupBy("span_id").agg(F.collect_list(F.struct("p", "w")).alias("_t")).select("span_id", F.col("_t.p").alias("_p"), F.col("_t.w").alias("_w"))
    begins = lambda x: F.transform(F.sequence(F.least(F.lit(5), F.length(x)), F.length(x)), lambda n: F.left(x, n))
    # A word is filed under its beginnings, and whole under a sign; a part asks for itself and its beginnings as whole words.
    whole = lambda x: F.concat(F.lit("="), x)
    keys = lambda x: F.concat(F.array(x), F.transform(begins(x), whole))
    own = claims.where("active AND project_id IS NOT NULL").select("project_id", F.explode(cut(F.col("claim_text"))).alias("word")).distinct()
    known = own.groupBy("project_id").agg(F.collect_list("word").alias("_o")).select("project_id", F.array_distinct(F.flatten(F.transform("_o", lambda x: F.concat(begins(x), F.array(whole(x)))))).alias("_own"))
    pairs = candidates.groupBy("span_id").agg(F.collect_set("project_id").alias("_ps"))
    met = asked.where(F.size("_p") > 0).join(pairs, "span_id").select("span_id", "_p", "_w", F.explode("_ps").alias("project_id")).join(known, "project_id")
    found = F.array_intersect(F.flatten(F.transform(F.flatten("_p"), keys)), "_own")
    flags = F.transform(F.array(found), lambda f: F.transform("_p", lambda ps: F.forall(ps, lambda x: F.arrays_overlap(keys(x), f))))
    back = met.select("span_id", "_w", F.struct("project_id", F.element_at(flags, 1).alias("hit")).alias("c")).groupBy("span_id").agg(F.any_value("_w").alias("_w"), F.collect_list("c").alias("_c"))
    n = F.size("_c")
    idf = F.transform("_w", lambda w, i: (F.log((n + 1) / (F.size(F.filter("_c", lambda c: F.get(c["hit"], i))) + 1)) + 0.15) * w)
    total = lambda xs: F.aggregate(xs, F.lit(0.0), lambda s, x: s + x)
    each = back.select("span_id", idf.alias("_idf"), F.explode("_c").alias("_c")).where(F.exists("_c.hit", lambda h: h))
    mine = total(F.zip_with("_idf", "_c.hit", lambda x, h: F.when(h, x).otherwise(0.0)))
    return each.select("span_id", "_c.project_id", F.round(mine / total("_idf"), 3).alias("crossref"), F.size(F.filter("_c.hit", lambda h: h)).cast("long").alias("n_terms"))


def contamination_audit(interactions: DataFrame, scans: DataFrame, least: float = 0.5) -> DataFrame:
    """Attributed calls without a contact whose transcript also scans to other projects."""
    rows = interactions.where("contact_id IS NULL AND project_id IS NOT NULL").select("interaction_id", F.col("project_id").alias("own")).join(scans.where(F.col("score") >= least), "interaction_id").where("project_id <> own")
    return rows.groupBy("interaction_id", "own").agg(F.countDistinct("project_id").alias("others"), F.concat_ws(",", F.array_sort(F.collect_set("project_id"))).alias("other_projects"))


def project_journal_state(candidates: DataFrame, spans: DataFrame, claims: DataFrame, loops: DataFrame, most_claims: int = 5, most_loops: int = 3) -> DataFrame:
    """Per candidate its latest confirmed claims of the same contact and open loops."""
    pairs = candidates.select("span_id", "project_id").join(spans.select("span_id", "contact_id"), "span_id")
    c = claims.where("active AND claim_confirmation_state = 'confirmed'").select("contact_id", "project_id", F.col("id").alias("claim_id"), "created_at")
    cw = Window.partitionBy("contact_id", "project_id").orderBy(F.desc("created_at"), "claim_id")
    c = c.withColumn("_rn", F.row_number().over(cw)).where(F.col("_rn") <= most_claims).groupBy("contact_id", "project_id").agg(F.concat_ws(",", F.transform(F.array_sort(F.collect_list(F.struct("_rn", "claim_id"))), lambda x: x["claim_id"])).alias("claims"))
    lw = Window.partitionBy("project_id").orderBy(F.desc("created_at"), "id")
    o = loops.where("status = 'open'").withColumn("_rn", F.row_number().over(lw)).where(F.col("_rn") <= most_loops).groupBy("project_id").agg(F.concat_ws(",", F.transform(F.array_sort(F.collect_list(F.struct("_rn", "id"))), lambda x: x["id"])).alias("loops"))
    return pairs.join(c, ["contact_id", "project_id"], "left").join(o, "project_id", "left").select("span_id", "project_id", "claims", "loops")
