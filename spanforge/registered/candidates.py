"""Queries of the candidate evidence and ranking operators."""

from pyspark.sql import functions as F

from ..operators import candidates as c
from ..operators.ledger import confirmation_state
from . import register

SP = "SELECT i.interaction_id AS span_id, i.contact_id, i.project_id, c.trade, c.is_internal AND c.floats_between_projects OR c.floats_between_projects AS is_floater FROM {i} i JOIN {c} c ON c.id = i.contact_id"


def _spans(t):
    return t.spark.sql(SP, i=t.interactions, c=t.contacts)


HEAD = f"sp AS ({SP.format(i='interactions', c='contacts')})"
PC = "pc AS (SELECT span_id, p.project_id, 'project_contacts' AS source, 0.0::DOUBLE AS weight, 0.22::DOUBLE + CASE WHEN p.trade = sp.trade THEN 0.18::DOUBLE ELSE 0.0 END AS score, true AS assigned FROM sp JOIN project_contacts p ON p.contact_id = sp.contact_id WHERE is_active)"
AF = "af AS (SELECT span_id, a.project_id, 'affinity' AS source, weight * CASE WHEN is_floater THEN 0.5::DOUBLE ELSE 1.0::DOUBLE END AS weight, weight * CASE WHEN is_floater THEN 0.5::DOUBLE ELSE 1.0::DOUBLE END AS score, false AS assigned FROM sp JOIN affinity a ON a.contact_id = sp.contact_id WHERE weight > 0)"
EX = "ex AS (SELECT span_id, project_id, 'existing_project' AS source, 0.0::DOUBLE AS weight, 0.11::DOUBLE AS score, false AS assigned FROM sp WHERE project_id IS NOT NULL)"
AGG = "ag AS (SELECT span_id, project_id, string_agg(DISTINCT source, ',' ORDER BY source) AS sources, count(DISTINCT source) AS n_sources, max(weight) AS weight, sum(score) AS score, bool_or(assigned) AS assigned FROM (SELECT * FROM pc UNION ALL SELECT * FROM af UNION ALL SELECT * FROM ex) GROUP BY 1, 2)"
V = "interactions contacts project_contacts affinity"
COLS = ["span_id", "project_id", "source", "weight", "score", "assigned"]


def _agg(t, only: str = "true", cap: int | None = None):
    spans = _spans(t).where(only)
    return c.span_candidates(spans, c.contact_candidates(spans, t.project_contacts, t.affinity), cap=cap)


register("cnd01_project_contacts", lambda t: c.from_project_contacts(_spans(t), t.project_contacts).select(*COLS), V, f"WITH {HEAD}, {PC} SELECT * FROM pc")
register("cnd02_affinity", lambda t: c.from_affinity(_spans(t), t.affinity).select(*COLS), V, f"WITH {HEAD}, {AF} SELECT * FROM af")
register("cnd03_existing_project", lambda t: c.from_existing_project(_spans(t)).select(*COLS), V, f"WITH {HEAD}, {EX} SELECT * FROM ex")
register("cnd15_aggregate", lambda t: _agg(t).withColumn("score", F.round("score", 6)).drop("n_alias", "n_strong", "distance"), V, f"WITH {HEAD}, {PC}, {AF}, {EX}, {AGG} SELECT * REPLACE (round(score, 6) AS score) FROM ag")
register("cnd16_blocklist", lambda t: c.apply_blocklist(_agg(t), t.projects.selectExpr("id AS project_id", "status = 'closed' AS hard", "project_kind = 'client' AS active")).select("span_id", "project_id", "sources"), V + " projects", f"WITH {HEAD}, {PC}, {AF}, {EX}, {AGG} SELECT span_id, project_id, sources FROM ag WHERE project_id NOT IN (SELECT id FROM projects WHERE status = 'closed' AND project_kind = 'client')")
register("cnd17_owner_override", lambda t: c.owner_override(_agg(t), _spans(t), t.project_contacts).select("span_id", "project_id", F.round("score", 6).alias("score"), "assigned", "owner_override"), V, f"""WITH {HEAD}, {PC}, {AF}, {EX}, {AGG},
ow AS (SELECT contact_id, min(project_id) AS owned FROM project_contacts WHERE role = 'owner' AND is_active GROUP BY 1 HAVING count(DISTINCT project_id) = 1), so AS (SELECT span_id, owned FROM sp JOIN ow USING (contact_id))
SELECT ag.span_id, project_id, round(score + CASE WHEN owned IS NOT NULL THEN 1.25::DOUBLE ELSE 0 END, 6) AS score, assigned OR owned IS NOT NULL AS assigned, owned IS NOT NULL AS owner_override FROM ag LEFT JOIN so USING (span_id) WHERE owned IS NULL OR owned = project_id""")
register("cnd19_rank", lambda t: c.rank_candidates(c.flag_weak(_agg(t, cap=3)), 3).select("span_id", "project_id", "rank"), V, f"""WITH {HEAD}, {PC}, {AF}, {EX}, {AGG}
SELECT span_id, project_id, CAST(row_number() OVER (PARTITION BY span_id ORDER BY assigned DESC, n_sources DESC, weight DESC, score DESC, project_id) AS INT) AS rank FROM ag QUALIFY rank <= 3""")


def _aliases(t):
    words = F.split(F.regexp_replace(F.col("text"), r"^\s+", ""), r"\s+")
    two = t.benchmark.select(F.col("item_id").cast("string").alias("project_id"), F.array_join(F.slice(words, 1, 2), " ").alias("term"), F.lit("alias").alias("kind"))
    three = t.benchmark.select(F.col("item_id").cast("string").alias("project_id"), F.array_join(F.slice(words, 1, 3), " ").alias("term"), F.lit("name").alias("kind"))
    return two.unionByName(three)


def _texts(t):
    return t.texts.select(F.col("interaction_id").alias("span_id"), "text")


ALIAS = r"""
bw AS (SELECT CAST(item_id AS VARCHAR) AS project_id, string_split_regex(regexp_replace(text, '^\s+', ''), '\s+') AS w FROM benchmark),
al AS (SELECT project_id, array_to_string(w[1:2], ' ') AS term, 'alias' AS kind FROM bw UNION ALL SELECT project_id, array_to_string(w[1:3], ' '), 'name' FROM bw),
ak AS (SELECT *, array_to_string(list_filter(string_split_regex(lower(term), '[^\p{L}\p{N}_]+'), lambda x: x <> ''), ' ') AS phrase FROM al),
tk AS (SELECT interaction_id AS span_id, list_filter(string_split_regex(lower(text), '[^\p{L}\p{N}_]+'), lambda x: x <> '') AS w FROM texts),
gr AS (SELECT span_id, unnest(range(len(w) - n + 1)) AS place, n, w FROM tk, (VALUES (1), (2), (3)) AS s(n) WHERE len(w) >= n),
gp AS (SELECT span_id, place, array_to_string(w[place + 1 : place + n], ' ') AS phrase FROM gr),
ft AS (SELECT span_id, project_id, term, kind, min(place) AS first_token, count(*) AS hits FROM gp JOIN ak USING (phrase) WHERE phrase <> '' GROUP BY ALL)
"""


def top_candidates(t, cap: int = 8):
    """Top project candidates of each transcript by the names and aliases in it."""
    found = c.from_terms(_texts(t), _aliases(t), 3)
    return c.rank_candidates(c.flag_weak(c.aggregate_candidates(found)), cap).select("span_id", "project_id", "rank", "n_alias", "n_strong", "weak_only")


register("cnd_top_candidates", top_candidates, "texts", f"""WITH {ALIAS},
st AS (SELECT *, kind = 'name' OR regexp_matches(term, '^\\d+\\s+\\S') OR regexp_matches(trim(term), '\\S\\s+\\S') OR length(trim(term)) >= 6 AS strong FROM ft),
a AS (SELECT span_id, project_id, count(*) AS n_alias, count(*) FILTER (WHERE strong) AS n_strong FROM st GROUP BY 1, 2)
SELECT span_id, project_id, CAST(row_number() OVER (PARTITION BY span_id ORDER BY n_strong = 0, n_alias DESC, n_strong DESC, project_id) AS INT) AS rank, n_alias, n_strong, n_strong = 0 AS weak_only FROM a QUALIFY rank <= 8""")
register("cnd05_transcript_terms", lambda t: c.from_terms(_texts(t), _aliases(t), 3).select("span_id", "project_id", "strong", "evidence"), "texts", f"""WITH {ALIAS}
SELECT span_id, project_id, kind = 'name' OR regexp_matches(term, '^\\d+\\s+\\S') OR regexp_matches(trim(term), '\\S\\s+\\S') OR length(trim(term)) >= 6 AS strong, kind || ':' || term || ':' || CAST(first_token AS VARCHAR) AS evidence FROM ft""")
PLACES = "SELECT CAST(user_id AS STRING) AS span_id, CAST(event_id AS STRING) AS place, CAST((event_id * 29) % 180 - 90 AS DOUBLE) / 2 + 0.1 AS lat, CAST((event_id * 41) % 360 - 180 AS DOUBLE) / 2 + 0.1 AS lon, CASE event_type WHEN 'click' THEN 'destination' WHEN 'view' THEN 'origin' ELSE 'proximity' END AS role FROM {e}"
register("cnd08_geo_proximity", lambda t: c.from_geo(t.spark.sql(PLACES, e=t.events), t.projects, 300.0).select("span_id", "project_id", F.round("score", 4).alias("score")), "projects", f"""WITH p AS ({PLACES.format(e="events")}),
h AS (SELECT span_id, place, role, id AS project_id, 2 * 6371.0 * asin(sqrt(least(1.0, pow(sin((radians(j.lat) - radians(p.lat)) / 2), 2) + cos(radians(p.lat)) * cos(radians(j.lat)) * pow(sin((radians(j.lon) - radians(p.lon)) / 2), 2)))) AS d FROM p, projects j),
g AS (SELECT span_id, project_id, min(d) AS d, count(DISTINCT place) AS n, count(*) FILTER (WHERE role = 'destination') AS de, count(*) FILTER (WHERE role = 'origin') AS o, count(*) FILTER (WHERE role = 'proximity') AS pr FROM h WHERE d <= 300 GROUP BY 1, 2),
r AS (SELECT * FROM g QUALIFY row_number() OVER (PARTITION BY span_id ORDER BY d, project_id) <= 5)
SELECT span_id, project_id, round(greatest(0.05, least(0.55, 0.05 + 0.35 * (1 - d / 300) + CASE WHEN greatest(de, o) >= pr AND greatest(de, o) > 0 THEN 0.12 ELSE 0 END + least(0.08, 0.02 * (n - 1)))), 4) AS score FROM r""")
register("cnd10_floater_anti_signal", lambda t: c.for_every_candidate(_agg(t, "is_floater"), _spans(t).where("is_floater").select("span_id"), "floater_anti_signal", -0.28).select("span_id", "project_id", "score"), V, f"WITH {HEAD}, {PC}, {AF}, {EX}, {AGG} SELECT ag.span_id, ag.project_id, -0.28::DOUBLE AS score FROM ag JOIN sp USING (span_id) WHERE is_floater")
CT = "ct AS (SELECT *, CASE WHEN project_id IS NOT NULL AND attribution_decision = 'assign' THEN 'confirmed' END AS st FROM claims)"
register("cnd11_claim_overlap", lambda t: c.claim_overlap(t.claims.select(F.col("id").alias("span_id"), "contact_id", F.col("claim_text").alias("text")).distinct(), confirmation_state(t.claims)).select("span_id", "project_id", F.round("score", 4).alias("score")), "claims", f"""WITH {CT},
so AS (SELECT * FROM ct WHERE active AND st = 'confirmed' QUALIFY row_number() OVER (PARTITION BY contact_id, project_id ORDER BY created_at DESC, id) <= 8),
cw AS (SELECT contact_id, project_id, id, list_distinct(list_filter(string_split_regex(lower(claim_text), '[^a-z0-9]+'), lambda x: length(x) >= 4)) AS w FROM so), ce AS (SELECT contact_id, project_id, id, len(w) AS n, unnest(w) AS word FROM cw),
se AS (SELECT span_id, contact_id, unnest(list_distinct(list_filter(string_split_regex(lower(claim_text), '[^a-z0-9]+'), lambda x: length(x) >= 4))) AS word FROM (SELECT DISTINCT id AS span_id, contact_id, claim_text FROM claims)),
p AS (SELECT span_id, project_id, ce.id, 2.2::DOUBLE * count(*) / first(n) AS s FROM se JOIN ce USING (contact_id, word) GROUP BY 1, 2, 3) SELECT span_id, project_id, round(least(0.35, max(s)), 4) AS score FROM p GROUP BY 1, 2""")
register("cnd21_continuity_links", lambda t: c.continuity_links(t.calls), "calls", """
WITH m AS (SELECT a.interaction_id, b.interaction_id AS prior_id, CASE WHEN a.project_id = b.project_id THEN 1 WHEN a.channel = b.channel THEN 2 ELSE 3 END AS tier, CAST(floor((epoch_us(a.event_at_utc) - epoch_us(b.event_at_utc)) / 1000000) AS BIGINT) AS gap_s
 FROM calls a JOIN calls b ON a.contact_id = b.contact_id AND b.event_at_utc < a.event_at_utc AND b.event_at_utc >= a.event_at_utc - INTERVAL 48 HOUR)
SELECT *, CAST(row_number() OVER (PARTITION BY interaction_id ORDER BY tier, gap_s, prior_id) AS INT) AS rank FROM m WHERE tier = 1 OR gap_s <= 14400 QUALIFY rank <= 5""")
IR = "SELECT a.contact_id AS interaction_id, a.contact_id, a.project_id, rejection_count % 2 = 0 AS assigned, confirmation_count > 2 AS existing, rejection_count = 1 AS mentioned, weight AS affinity, confirmation_count AS n_alias, rejection_count > 1 AS weak, confirmation_count % 4 AS n_sources FROM {a} a"
IRS = """rs AS (SELECT *, CASE WHEN assigned THEN 100 ELSE 0 END + CASE WHEN existing THEN CASE WHEN assigned THEN 20 ELSE 80 END ELSE 0 END + CASE WHEN mentioned THEN 40 ELSE 0 END + least(10 * affinity, 50.0::DOUBLE) + CASE WHEN weak THEN least(10 * n_alias, 30) ELSE least(20 * n_alias, 60) END AS rank_score FROM ir),
rc AS (SELECT *, least(CASE WHEN weak THEN 0.35::DOUBLE ELSE 0.99::DOUBLE END, rank_score / 330.0::DOUBLE + CASE WHEN n_sources >= 3 THEN 0.1::DOUBLE ELSE 0 END + CASE WHEN n_alias >= 2 THEN 0.05::DOUBLE ELSE 0 END) AS confidence, CAST(row_number() OVER (PARTITION BY interaction_id ORDER BY rank_score DESC, project_id) AS INT) AS rank FROM rs)"""
register("cnd24_intake_rank", lambda t: c.intake_rank(t.spark.sql(IR, a=t.affinity)).select("interaction_id", "project_id", "rank_score", "confidence", "rank"), "affinity", f"WITH ir AS ({IR.format(a='affinity')}), {IRS} SELECT interaction_id, project_id, rank_score, confidence, rank FROM rc")
register("cnd25_auto_assign", lambda t: c.auto_assign(c.intake_rank(t.spark.sql(IR, a=t.affinity)), t.project_contacts.where("is_active")), "affinity project_contacts", f"""WITH ir AS ({IR.format(a='affinity')}), {IRS}, o AS (SELECT contact_id, count(DISTINCT project_id) AS n, min(project_id) AS p FROM project_contacts WHERE is_active GROUP BY 1),
tp AS (SELECT interaction_id, contact_id, count(*) AS n, max(CASE WHEN rank = 1 THEN project_id END) AS f, max(CASE WHEN rank = 1 THEN rank_score END) AS s1, max(CASE WHEN rank = 2 THEN rank_score END) AS s2, max(CASE WHEN rank = 1 THEN confidence END) AS c1 FROM rc GROUP BY 1, 2),
r AS (SELECT tp.*, o.p, CASE WHEN o.n = 1 THEN 'single_client_project' WHEN tp.n = 1 AND coalesce(o.n, 0) <= 3 THEN 'solo_candidate' WHEN s1 >= 150 AND s1 >= 2 * coalesce(s2, 0) AND c1 >= 0.55 THEN 'clear_first' ELSE 'no_rule' END AS rule FROM tp LEFT JOIN o USING (contact_id))
SELECT interaction_id, rule, CASE WHEN rule = 'single_client_project' THEN p WHEN rule <> 'no_rule' THEN f END AS project_id FROM r""")
register("cnd22_project_journal_state", lambda t: c.project_journal_state(_agg(t), _spans(t), confirmation_state(t.claims), t.loops), V + " claims loops", f"""WITH {HEAD}, {PC}, {AF}, {EX}, {AGG}, {CT},
cl AS (SELECT contact_id, project_id, string_agg(id, ',' ORDER BY rn, id) AS claims FROM (SELECT *, row_number() OVER (PARTITION BY contact_id, project_id ORDER BY created_at DESC, id) AS rn FROM ct WHERE active AND st = 'confirmed') WHERE rn <= 5 GROUP BY 1, 2),
lo AS (SELECT project_id, string_agg(id, ',' ORDER BY rn, id) AS loops FROM (SELECT *, row_number() OVER (PARTITION BY project_id ORDER BY created_at DESC, id) AS rn FROM loops WHERE status = 'open') WHERE rn <= 3 GROUP BY 1)
SELECT ag.span_id, ag.project_id, claims, lo.loops FROM ag JOIN sp USING (span_id) LEFT JOIN cl ON cl.contact_id = sp.contact_id AND cl.project_id = ag.project_id LEFT JOIN lo ON lo.project_id = ag.project_id""")
