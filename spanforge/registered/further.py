"""Queries of identity, mention and route operators, and of the single steps that others are made of."""

from pyspark.sql import functions as F

from ..functions import text as x
from ..operators import candidates as c
from ..operators import entity as e
from ..operators import identity as i
from ..plans.match import find_terms
from ..sources.ingest import normalize_follow_ups
from . import register

# --- speakers of two-party calls

WORDS = "SELECT 'cll_' || interaction_id AS interaction_id, speaker, turn AS start FROM {t}"
NAMES = "SELECT 'Customer#' || CAST(c_custkey AS STRING) AS label, CAST(c_custkey AS STRING) AS contact_id, CAST(60 + c_custkey % 40 AS INT) AS quality FROM {c}"
register("ent06_diarized_speakers", lambda t: i.resolve_diarized_speakers(t.spark.sql(WORDS, t=t.turns), t.calls_raw.withColumn("direction", F.when(F.col("direction") == "x", "out").otherwise(F.col("direction"))).withColumn("owner_name", F.lit("customer#7")), t.contacts, t.spark.sql(NAMES, c=t.customer)), "turns calls_raw contacts", f"""
WITH w AS ({WORDS.format(t='turns')}), nm AS ({NAMES.format(c='customer')}),
f AS (SELECT interaction_id, arg_min(speaker, start) AS first FROM w GROUP BY 1 HAVING count(DISTINCT speaker) = 2),
l AS (SELECT DISTINCT w.interaction_id, w.speaker, CASE WHEN (w.speaker = f.first) = starts_with(lower(k.direction), 'in') THEN 'owner' ELSE 'other_party' END AS role, k.owner_phone, k.other_party_phone, k.other_party_name FROM w JOIN f USING (interaction_id) JOIN calls_raw k USING (interaction_id)),
p AS (SELECT right(regexp_replace(phone, '[^0-9]', '', 'g'), 10) AS d, min(id) AS id FROM contacts WHERE phone IS NOT NULL GROUP BY 1),
r AS (SELECT l.*, p.id AS by_phone, nm.contact_id AS by_name, nm.quality AS q FROM l LEFT JOIN p ON p.d = right(regexp_replace(CASE role WHEN 'owner' THEN owner_phone ELSE other_party_phone END, '[^0-9]', '', 'g'), 10)
  LEFT JOIN nm ON lower(nm.label) = lower(CASE role WHEN 'owner' THEN 'customer#7' ELSE other_party_name END))
SELECT interaction_id, speaker, role, coalesce(by_phone, by_name) AS contact_id, CAST(CASE WHEN by_phone IS NOT NULL THEN CASE role WHEN 'owner' THEN 88 ELSE 86 END ELSE least(q, CASE role WHEN 'owner' THEN 82 ELSE 80 END) END AS INT) AS quality,
  CASE WHEN by_phone IS NOT NULL THEN 'phone' ELSE 'name' END AS "match" FROM r WHERE by_phone IS NOT NULL OR by_name IS NOT NULL""")
register("ent08_claim_speakers", lambda t: e.extract_claim_speakers(t.claims.withColumn("speaker_label", F.concat(F.lit("Customer#"), "contact_id")), t.spark.sql(NAMES, c=t.customer)), "claims", f"""
WITH nm AS ({NAMES.format(c='customer')}) SELECT id, coalesce(speaker_contact_id, nm.contact_id) AS speaker_contact_id FROM claims LEFT JOIN nm ON nm.label = 'Customer#' || claims.contact_id""")

# --- mentioned contacts

PEOPLE = "SELECT CAST(min(p_partkey) AS STRING) AS id, p_name AS name, min(p_partkey) % 11 = 0 AS floats_between_projects FROM {p} GROUP BY p_name"
TIES = "SELECT CAST(p_partkey AS STRING) AS contact_id, CAST(p_partkey % 25 AS STRING) AS project_id, CAST(p_partkey % 10 AS DOUBLE) / 8 AS weight FROM {p} UNION ALL SELECT CAST(p_partkey AS STRING), CAST(p_partkey % 7 AS STRING), 0.5 FROM {p} WHERE p_partkey % 3 = 0"
SAID = "SELECT CAST(p_partkey AS STRING) AS span_id, p_type || ' ' || CASE p_partkey % 3 WHEN 0 THEN p_name WHEN 1 THEN split_part(p_name, ' ', 1) || ' and ' || split_part(p_name, ' ', 2) ELSE split_part(p_name, ' ', 1) END || ', ' || p_brand AS text FROM {p}"
MENTIONS = f"""WITH pe AS ({PEOPLE.format(p='part')}), ti AS ({TIES.format(p='part')}), sa AS ({SAID.format(p='part')}),
nm AS (SELECT *, lower(name) AS full_, lower(split_part(name, ' ', 1)) AS first_, lower(split_part(name, ' ', 2)) AS last_ FROM pe),
pr AS (SELECT nm.*, a.weight, a.project_id FROM nm JOIN (SELECT contact_id, count(DISTINCT project_id) AS n, max(weight) AS weight, arg_min(project_id, (-weight, project_id)) AS project_id FROM ti GROUP BY 1) a ON a.contact_id = nm.id WHERE NOT floats_between_projects AND (weight >= 0.9 OR n = 1)),
tx AS (SELECT span_id, ' ' || regexp_replace(lower(text), '[^a-z0-9_]+', ' ', 'g') || ' ' AS t FROM sa),
m AS (SELECT span_id, pr.id AS contact_id, project_id, weight, CASE WHEN contains(t, ' ' || full_ || ' ') THEN 100 WHEN length(last_) >= 3 AND contains(t, ' ' || first_ || ' ') AND contains(t, ' ' || last_ || ' ') THEN 80
  WHEN length(first_) >= 4 AND contains(t, ' ' || first_ || ' ') AND NOT EXISTS (SELECT 1 FROM nm WHERE nm.first_ = pr.first_ AND nm.last_ <> pr.last_ AND nm.last_ <> '' AND contains(t, ' ' || nm.full_ || ' ')) THEN 60 END AS quality FROM tx, pr)"""
LAST = "SELECT span_id, project_id, contact_id, weight, quality FROM m WHERE quality IS NOT NULL QUALIFY row_number() OVER (PARTITION BY span_id, project_id ORDER BY quality DESC, weight DESC, contact_id) = 1"


def _mentions(t):
    return i.expand_from_mentions(t.spark.sql(SAID, p=t.part), t.spark.sql(PEOPLE, p=t.part), t.spark.sql(TIES, p=t.part))


register("ent11_expand_from_mentions", _mentions, "", f"{MENTIONS} {LAST}")
register("cnd07_mention_expansion", lambda t: c.evidence(_mentions(t), "mention_expansion", weight=F.coalesce("weight", F.lit(0.9))).select("span_id", "project_id", "source", "weight"), "", f"{MENTIONS} SELECT span_id, project_id, 'mention_expansion' AS source, weight FROM ({LAST})")

# --- routes

PLACED = "SELECT CAST(event_id % 700 AS STRING) AS span_id, CAST(user_id % 40 AS STRING) AS place_id, CASE event_type WHEN 'error' THEN 'origin' WHEN 'click' THEN 'proximity' ELSE 'destination' END AS role, CASE WHEN event_id % 3 = 0 THEN 'head to' END AS verb_hint, CASE WHEN event_id % 9 = 0 THEN NULL ELSE CAST(event_id % 10 AS DOUBLE) / 10 END AS confidence, event_id AS created_at FROM {e}"
PLACES = "SELECT CAST(n_nationkey AS STRING) AS id, CAST(n_nationkey * 7 % 80 - 40 AS DOUBLE) AS lat, CAST(n_nationkey * 13 % 160 - 80 AS DOUBLE) AS lon FROM {n}"
register("cnd28_span_enroute", lambda t: i.span_enroute(t.spark.sql(PLACED, e=t.events), t.spark.sql(PLACES, n=t.nation), t.projects.where("status IN ('active', 'warranty', 'estimating') AND project_kind = 'client'"), 500.0).withColumn("miles", F.round("miles", 6)), "projects", f"""
WITH pm AS ({PLACED.format(e='events')}), pl AS ({PLACES.format(n='nation')}),
b AS (SELECT *, row_number() OVER (PARTITION BY span_id, role ORDER BY confidence DESC NULLS LAST, created_at DESC) AS rn FROM pm),
d AS (SELECT span_id, place_id, verb_hint FROM b WHERE role = 'destination' AND rn = 1), o AS (SELECT span_id, place_id FROM b WHERE role = 'origin' AND rn = 1),
h AS (SELECT pl.id AS place, p.id AS project_id, asin(sqrt(least(1.0, pow(sin((radians(p.lat) - radians(pl.lat)) / 2), 2) + cos(radians(pl.lat)) * cos(radians(p.lat)) * pow(sin((radians(p.lon) - radians(pl.lon)) / 2), 2)))) * 2 AS a FROM pl, projects p WHERE status IN ('active', 'warranty', 'estimating') AND project_kind = 'client'),
np AS (SELECT * FROM h WHERE a * 6371.0 <= 500.0 QUALIFY row_number() OVER (PARTITION BY place ORDER BY a, project_id) = 1)
SELECT coalesce(d.span_id, o.span_id) AS span_id, o.place_id AS origin_place_id, d.place_id AS destination_place_id, CASE WHEN verb_hint IS NULL THEN 'weak' ELSE 'explicit' END AS confidence, project_id, round(a * 3958.8, 6) AS miles
FROM d FULL JOIN o USING (span_id) LEFT JOIN np ON np.place = d.place_id""")

# --- single steps

ALIASES = "SELECT DISTINCT CAST(p_partkey % 25 AS STRING) AS project_id, CASE p_partkey % 3 WHEN 0 THEN p_name WHEN 1 THEN split_part(p_name, ' ', 2) ELSE '12 ' || p_name END AS term, CASE WHEN p_partkey % 3 = 0 THEN 'name' ELSE 'alias' END AS kind FROM {p}"
register("txt03_find_terms", lambda t: find_terms(t.claims.select(F.col("id").alias("span_id"), F.col("claim_text").alias("text")), t.spark.sql(ALIASES, p=t.part).select("term").distinct(), "span_id").select("span_id", "term", "first_token").distinct(), "claims", f"""
WITH al AS (SELECT DISTINCT lower(term) AS phrase, term FROM ({ALIASES.format(p='part')})), tx AS (SELECT DISTINCT id AS span_id, trim(regexp_replace(lower(claim_text), '[^a-z0-9_]+', ' ', 'g')) AS t FROM claims),
g AS (SELECT span_id, term, ' ' || t || ' ' AS t, ' ' || phrase || ' ' AS p FROM tx JOIN al ON contains(' ' || t || ' ', ' ' || phrase || ' '))
SELECT span_id, term, CAST(len(string_split(substr(t, 1, instr(t, p)), ' ')) - 2 AS INT) AS first_token FROM g""")
register("txt06_match_strength", lambda t: t.spark.sql(ALIASES, p=t.part).select("project_id", "term", "kind", c.match_strength(F.col("kind"), F.col("term")).alias("strong")), "", f"SELECT project_id, term, kind, kind = 'name' OR contains(term, ' ') OR length(term) >= 6 AS strong FROM ({ALIASES.format(p='part')})")
ROLES = (r"\b(?:large|old|new)\b", r"\b(?:small|cold)\b")
register("txt23_place_role", lambda t: t.claims.select("id", x.detect_place_role(F.col("claim_text"), F.length("claim_text") - 3, *ROLES, back=60).alias("role")), "claims", r"""
SELECT id, CASE WHEN regexp_matches(b, '\b(large|old|new)\b') THEN 'destination' WHEN regexp_matches(b, '\b(small|cold)\b') THEN 'origin' ELSE 'proximity' END AS role FROM (SELECT id, lower(substr(claim_text, greatest(1, length(claim_text) - 63), least(60, length(claim_text) - 4))) AS b FROM claims)""")
MATERIALS = "SELECT DISTINCT split_part(p_name, ' ', 2) AS term, CAST(length(split_part(p_name, ' ', 2)) AS DOUBLE) / 40 AS boost, length(split_part(p_name, ' ', 2)) <> 5 AS active FROM {p}"
register("cnd09_material_signal", lambda t: c.for_every_candidate(t.claims.where("project_id IS NOT NULL").selectExpr("source_span_id AS span_id", "project_id"), x.callout_material_signal(t.claims.select(F.col("source_span_id").alias("span_id"), F.col("claim_text").alias("text")).distinct(), t.spark.sql(MATERIALS, p=t.part)).select("span_id", F.col("score").alias("_s")), "material_signal", F.col("_s")).select("span_id", "project_id", F.round("score", 9).alias("score")), "claims", f"""
WITH ma AS ({MATERIALS.format(p='part')}), tx AS (SELECT source_span_id AS span_id, ' ' || regexp_replace(lower(claim_text), '[^a-z0-9_]+', ' ', 'g') || ' ' AS t FROM (SELECT DISTINCT source_span_id, claim_text FROM claims)),
h AS (SELECT DISTINCT span_id, term, boost FROM tx JOIN ma ON active AND contains(t, ' ' || term || ' ')), s AS (SELECT span_id, greatest(0.0::DOUBLE, least(0.45::DOUBLE, sum(0.08::DOUBLE + boost))) AS score FROM h GROUP BY 1)
SELECT DISTINCT c.source_span_id AS span_id, project_id, round(score, 9) AS score FROM claims c JOIN s ON s.span_id = c.source_span_id WHERE project_id IS NOT NULL""")
RANKED = "SELECT source_span_id AS span_id, project_id, CAST(max(char_start % 3) AS BIGINT) AS n_alias, CAST(max(char_start % 2) AS BIGINT) AS n_strong, bool_or(active) AND max(char_start) % 5 = 0 AS assigned, count(DISTINCT claim_type) AS n_sources, sum(attribution_confidence) AS score FROM {c} WHERE project_id IS NOT NULL AND char_start IS NOT NULL GROUP BY 1, 2"
register("cnd18_weak_and_demoted", lambda t: c.flag_weak(c.demote_ambiguous(t.spark.sql(RANKED, c=t.claims), t.claims.where("contains(claim_text, 'small')").selectExpr("source_span_id AS span_id", "project_id"))).select("span_id", "project_id", F.round("score", 9).alias("score"), "weak_only", "demoted"), "claims", f"""
WITH r AS ({RANKED.format(c='claims')}), a AS (SELECT DISTINCT source_span_id AS span_id, project_id, true AS amb FROM claims WHERE contains(claim_text, 'small')), j AS (SELECT r.*, coalesce(amb, false) AND n_sources = 1 AND NOT assigned AS demoted FROM r LEFT JOIN a USING (span_id, project_id))
SELECT span_id, project_id, round(CASE WHEN demoted THEN greatest(0.0, score - 0.65) ELSE score END, 9) AS score, n_alias > 0 AND n_strong = 0 AND NOT assigned AS weak_only, demoted FROM j""")
register("src22_normalize_follow_ups", lambda t: normalize_follow_ups(t.spark.sql("SELECT call_id AS interaction_id, array_sort(collect_list(named_struct('text', CASE WHEN active THEN ' ' || claim_text ELSE ' ' END, 'priority', CASE claim_type WHEN 'risk' THEN 'urgent' ELSE upper(warrant_level) END))) AS items FROM {c} GROUP BY 1", c=t.claims), most=2, longest=12).select("interaction_id", F.expr("array_join(transform(items, y -> y.text || '/' || y.priority), '|')").alias("items")), "claims", """
WITH k AS (SELECT call_id, trim(claim_text) AS text, CASE claim_type WHEN 'risk' THEN 'urgent' ELSE upper(warrant_level) END AS up, row_number() OVER (PARTITION BY call_id ORDER BY ' ' || claim_text, CASE claim_type WHEN 'risk' THEN 'urgent' ELSE upper(warrant_level) END) AS n FROM claims WHERE active),
c AS (SELECT DISTINCT call_id AS interaction_id FROM claims) SELECT interaction_id, coalesce(string_agg(substr(text, 1, 12) || '/' || CASE WHEN lower(up) IN ('low', 'medium', 'high') THEN lower(up) ELSE 'medium' END, '|' ORDER BY n), '') AS items FROM c LEFT JOIN k ON k.call_id = c.interaction_id AND n <= 2 GROUP BY 1""")
