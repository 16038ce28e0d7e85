"""Queries of probes, guards on evidence, and loaders with quarantine."""

import uuid

from pyspark.sql import functions as F

from ..operators import candidates as c
from ..operators import facts as f
from ..operators import probe as p
from ..sources import loaders
from ..streaming.jobs import shared_dir
from . import register

# Vectors as claims: number as time, label as project, and a text made of both.
VECTORS = "SELECT CAST(vec_id AS STRING) AS id, CAST(label AS STRING) AS project_id, embedding, vec_id AS created_at, vec_id % 9 <> 0 AS active, 'Claim ' || CAST(vec_id % 97 AS STRING) || ' of group ' || CAST(label AS STRING) AS claim_text FROM {e}"
PROBES = [("third", ["%of group 3"]), ("fallback", ["%windship%", "claim 5 %"]), ("rare", ["claim 13 %", "%group 1"]), ("none", ["%nothing%"])]
_TRY = " UNION ALL ".join(f"SELECT '{name}' AS probe, {i} AS try, '{x}' AS pattern" for name, xs in PROBES for i, x in enumerate(xs))
register("led26_vector_probe", lambda t: p.vector_probe(t.spark.sql(VECTORS, e=t.embeddings), t.projects, PROBES, "%project 3%"), "projects", f"""
WITH v AS MATERIALIZED (SELECT * FROM ({VECTORS.format(e="embeddings")}) WHERE active AND embedding IS NOT NULL), tr AS ({_TRY}),
s AS (SELECT probe, pattern AS seed_source, embedding AS seed FROM tr JOIN v ON lower(claim_text) LIKE pattern QUALIFY row_number() OVER (PARTITION BY probe ORDER BY try, created_at DESC, id DESC) = 1),
r AS (SELECT probe, seed_source, id, project_id, round(list_cosine_similarity(seed::DOUBLE[], embedding::DOUBLE[]), 6) AS score FROM s, v)
SELECT probe, seed_source, CAST(row_number() OVER (PARTITION BY probe ORDER BY score DESC, r.id) AS INT) AS rank, r.id, coalesce(name, '<unknown>') AS project_name, score, round(1 - score, 6) AS distance, lower(coalesce(name, '<unknown>')) LIKE '%project 3%' AS alert
FROM r LEFT JOIN projects ON projects.id = project_id QUALIFY rank <= 10""")
register("led26_indexed_probe", lambda t: p.indexed_probe(t.embeddings.where("vec_id % 50 = 0").select(F.col("vec_id").alias("query_id"), "embedding"), t.embeddings.select(F.col("vec_id").alias("id"), "embedding")))

CLAIMS = "SELECT *, CASE WHEN attribution_decision = 'assign' THEN 'confirmed' ELSE 'unconfirmed' END AS claim_confirmation_state FROM {c}"
TERMS = "SELECT call_id AS span_id, explode(split(lower(claim_text), ' ')) AS term FROM {c}"
register("cnd13_cross_contact_claims", lambda t: c.from_cross_contact_claims(t.spark.sql(TERMS, c=t.claims), t.spark.sql(CLAIMS, c=t.claims), t.projects).select("span_id", "project_id", "score", "evidence"), "claims projects", """
WITH k AS (SELECT id, project_id, list_distinct(string_split(lower(claim_text), ' ')) AS w FROM claims WHERE active AND attribution_decision = 'assign' AND project_id IS NOT NULL),
u AS MATERIALIZED (SELECT id, project_id, unnest(w) AS term FROM k), q AS MATERIALIZED (SELECT DISTINCT call_id AS span_id, unnest(string_split(lower(claim_text), ' ')) AS term FROM claims),
a AS (SELECT span_id, list_sort(list(term)) AS ts FROM q WHERE length(term) > 1 GROUP BY 1 HAVING count(*) >= 2), d AS MATERIALIZED (SELECT DISTINCT ts FROM a),
m AS (SELECT DISTINCT ts, id, project_id FROM (SELECT ts, unnest(ts) AS term FROM d) JOIN u USING (term)), x AS (SELECT * FROM m QUALIFY row_number() OVER (PARTITION BY ts ORDER BY id) <= 100),
h AS (SELECT ts, project_id, count(*) AS hits FROM x JOIN projects ON projects.id = project_id WHERE status IN ('active', 'warranty', 'estimating') AND project_kind = 'client' GROUP BY 1, 2 QUALIFY row_number() OVER (PARTITION BY ts ORDER BY count(*) DESC, project_id) <= 5)
SELECT span_id, project_id, 0.2::DOUBLE * least(hits / 5.0::DOUBLE, 1.0::DOUBLE) AS score, CAST(hits AS VARCHAR) AS evidence FROM a JOIN h USING (ts)""")

FACTS = "SELECT fact_id, project_id, fact_kind, as_of_at, CASE CAST(interaction_id AS BIGINT) % 5 WHEN 0 THEN 'small widget' WHEN 1 THEN 'the gizmo' WHEN 2 THEN 'ring of ECONOMY type' WHEN 3 THEN 'standard house bolt' ELSE 'pending' END || CASE WHEN CAST(interaction_id AS BIGINT) % 7 = 0 THEN ' panel-a12' ELSE '' END AS fact_payload FROM {f} WHERE fact_kind <> 'schedule' OR CAST(project_id AS INT) % 3 = 0"
PROPOSED = "SELECT id AS span_id, project_id, attribution_decision AS decision FROM {c}"
REFERRED = "SELECT id AS span_id, id || '-1' AS ref_id, project_id, CASE claim_type WHEN 'risk' THEN 'scope' WHEN 'question' THEN 'budget' ELSE 'schedule' END AS fact_kind, created_at AS fact_as_of_at, claim_text AS fact_excerpt FROM {c}"
SAID = "SELECT id AS span_id, CASE length(id) % 5 WHEN 0 THEN 'there is no ' WHEN 1 THEN 'not, well, ' WHEN 2 THEN 'We never had that ' WHEN 3 THEN 'never in my life a ' ELSE 'yes, the ' END || claim_text AS text FROM {c}"
_WORDS = "regexp_extract_all({}, '[a-z0-9-]+')"
register("dec07_fact_reference_guard", lambda t: f.fact_reference_guard(*(t.spark.sql(s, c=t.claims, f=t.facts) if "{f}" in s else t.spark.sql(s, c=t.claims) for s in (PROPOSED, REFERRED)), t.spark.sql(FACTS, f=t.facts), t.spark.sql(SAID, c=t.claims)), "claims facts", f"""
WITH p AS ({PROPOSED.format(c="claims")}), r AS ({REFERRED.format(c="claims")}), x AS ({SAID.format(c="claims")}),
fk AS (SELECT *, lower(fact_kind || ' ' || fact_payload) AS t FROM ({FACTS.format(f="facts")}) QUALIFY row_number() OVER (PARTITION BY project_id ORDER BY as_of_at DESC, fact_id) <= 20),
m AS MATERIALIZED (SELECT r.span_id, fk.fact_kind, fact_payload, t FROM r JOIN fk ON fk.project_id = r.project_id AND fk.fact_kind = r.fact_kind
  QUALIFY row_number() OVER (PARTITION BY span_id ORDER BY coalesce(as_of_at = fact_as_of_at, false) DESC, len(list_filter(list_filter({_WORDS.format("lower(fact_excerpt)")}, lambda w: length(w) >= 4)[1:6], lambda w: contains(t, w))) DESC, as_of_at DESC, fact_id) = 1),
g AS (SELECT span_id, t, regexp_matches(lower(fact_kind), '{"|".join(f.STRONG_KINDS)}') OR len(list_filter({_WORDS.format("t")}, lambda w: length(w) >= 8 AND w NOT IN ('{"', '".join(f.LOW_SIGNAL)}') AND regexp_matches(w, '[0-9-]'))) > 0 AS strong,
  list_filter({_WORDS.format("t")}, lambda w: length(w) >= 5 AND w NOT IN ('{"', '".join(f.LOW_SIGNAL)}'))[1:5] AS sig FROM m),
n AS (SELECT g.*, len(list_filter(sig, lambda w: regexp_matches(lower(text), '\\b(not|no|never|without|isn''?t|aren''?t|wasn''?t|weren''?t)\\s+(\\w+\\s+){{0,2}}' || w || '\\b'))) > 0 AS denied FROM g JOIN x USING (span_id)),
j AS (SELECT p.*, n.span_id IS NOT NULL AS has, coalesce(strong, false) AS strong, coalesce(denied, false) AS denied FROM p LEFT JOIN n USING (span_id))
SELECT span_id, CASE WHEN decision = 'assign' AND has AND (NOT strong OR denied) THEN 'review' ELSE decision END AS decision, decision = 'assign' AND has AND (NOT strong OR denied) AS downgraded,
  CASE WHEN decision = 'assign' AND has AND denied THEN 'world_model_fact_contradiction' WHEN decision = 'assign' AND has AND NOT strong THEN 'world_model_fact_weak_only' END AS reason_code,
  CAST(has AS BIGINT) AS n_references, strong AS strong_anchor, denied AS contradiction FROM j""")


def _lines(t, lines) -> str:
    """A folder of text files with the ``value`` of the rows."""
    at = f"{shared_dir(t.spark)}/lines-{uuid.uuid4().hex}"
    lines.write.text(at)
    return at


def _counted(good, quarantine, key: str):
    rows = good.select(F.lit("good").alias("result"), key).unionByName(quarantine.select(F.col("reason").alias("result"), key))
    return rows.groupBy("result").agg(F.count("*").alias("n"), F.count_distinct(key).alias("n_keys"))


MANIFEST = "SELECT {o} || 'i' || CAST(doc_id AS STRING) || CASE WHEN doc_id % 11 = 0 THEN '!' ELSE '' END AS i, CASE doc_id % 7 WHEN 0 THEN 'x1' WHEN 1 THEN '' ELSE CAST(doc_id % 5 AS STRING) END AS s, CASE quality WHEN 1 THEN ' Assign' ELSE 'review' END || CASE WHEN doc_id % 13 = 0 THEN 's' ELSE '' END AS d, doc_id FROM {l}"


def _manifest(t):
    rows = t.spark.sql(MANIFEST.replace("{o}", "''"), l=t.labels).select(F.to_json(F.struct(F.col("i").alias("interaction_id"), F.col("s").alias("span_index"), F.col("d").alias("expected_decision"))).alias("j"), "doc_id")
    return _counted(*loaders.load_manifest(t.spark, _lines(t, rows.select(F.when(F.col("doc_id") % 17 == 0, F.expr("left(j, 9)")).otherwise(F.col("j")).alias("value"))), json=True), "interaction_id")


register("src12_load_manifest", _manifest, "", f"""
WITH m AS ({MANIFEST.format(o="''", l="labels")}), r AS (SELECT CASE WHEN doc_id % 17 = 0 THEN '' ELSE i END AS k, CASE WHEN doc_id % 17 = 0 THEN 'unreadable' WHEN i LIKE '%!' THEN 'invalid_interaction_id' WHEN s = 'x1' THEN 'invalid_span_index' WHEN trim(lower(d)) NOT IN ('assign', 'review', 'none') THEN 'invalid_decision' ELSE 'good' END AS result FROM m)
SELECT result, count(*) AS n, count(DISTINCT k) AS n_keys FROM r GROUP BY 1""")


def _facts(t):
    n = F.col("interaction_id").cast("long")
    when = F.date_format("as_of_at", "yyyy-MM-dd'T'HH:mm:ss")
    later = F.date_format(F.col("as_of_at") + F.expr("INTERVAL 1 DAY") * F.when(n % 19 == 0, -1).otherwise(1), "yyyy-MM-dd'T'HH:mm:ss")
    fact = F.struct(F.when(n % 10 != 0, F.col("project_id")).alias("project_id"), F.when(n % 23 == 0, F.lit("May")).otherwise(when).alias("as_of_at"), later.alias("observed_at"), "fact_kind", F.struct(F.col("fact_id").alias("ref")).alias("fact_payload"), "interaction_id", "source_char_start")
    line = F.when(n % 29 == 0, F.concat(F.lit("{"), F.to_json(fact))).otherwise(F.to_json(fact))
    return _counted(*loaders.load_facts_jsonl(t.spark, _lines(t, t.facts.select(line.alias("value")))), "project_id")


register("src13_load_facts", _facts, "facts", """
WITH n AS (SELECT *, CAST(interaction_id AS BIGINT) AS n FROM facts), r AS (SELECT CASE WHEN n % 29 <> 0 AND n % 10 <> 0 THEN project_id END AS k, CASE WHEN n % 29 = 0 THEN 'unreadable' WHEN n % 10 = 0 THEN 'no_project' WHEN n % 23 = 0 THEN 'invalid_as_of_at' WHEN n % 19 = 0 THEN 'observed_before_it_held' ELSE 'good' END AS result FROM n)
SELECT result, count(*) AS n, count(DISTINCT k) AS n_keys FROM r GROUP BY 1""")
