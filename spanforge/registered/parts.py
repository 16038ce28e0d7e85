"""Queries of the sources of evidence by tier and type, the contamination audit and the merge gate."""

from pyspark.sql import functions as F

from ..operators import candidates as c
from ..operators import entity as e
from ..operators import ledger as l
from ..operators import metrics as m
from ..operators import package as p
from . import register

CALLS = "SELECT id AS span_id, claim_text AS text FROM {c}"
# Kinds of parts stand for words of a budget tier, their names for words of a type of structure.
TIERS = [("economy", "small", 0.0, 2000.0), ("promo", "small", 0.0, 2000.0), ("standard", "middle", 2000.0, 6000.0), ("large", "upper", 6000.0, 14000.0)]
TYPES = [("gizmo", "design"), ("bolt", "framing"), ("ring", "framing"), ("plate", "finish")]
_ROWS = lambda rows: ", ".join(str(tuple(r)) for r in rows)
register("cnd14a_budget_tier", lambda t: c.from_budget_tier(t.spark.sql(CALLS, c=t.claims), t.spark.createDataFrame(TIERS, "term string, tier string, low double, high double"), t.projects).select("span_id", "project_id", "score", "evidence"), "claims projects", f"""
WITH ti(term, tier, low, high) AS (VALUES {_ROWS(TIERS)}), mi AS (SELECT DISTINCT tier, (low + high) / 2 AS m FROM ti),
ne AS (SELECT tier, id AS project_id FROM mi, projects WHERE contract_value IS NOT NULL QUALIFY row_number() OVER (PARTITION BY tier ORDER BY abs(contract_value - m), id) <= 3),
na AS (SELECT DISTINCT claims.id AS span_id, tier FROM claims JOIN ti ON list_contains(string_split(lower(claim_text), ' '), term))
SELECT span_id, project_id, 0.4::DOUBLE AS score, tier AS evidence FROM na JOIN ne USING (tier)""")
register("cnd14b_structural_type", lambda t: c.from_structural_type(t.spark.sql(CALLS, c=t.claims), t.spark.createDataFrame(TYPES, "term string, type string"), t.projects.withColumnRenamed("phase", "type")).select("span_id", "project_id", "score"), "claims projects", f"""
WITH ty(term, type) AS (VALUES {_ROWS(TYPES)}), na AS (SELECT DISTINCT claims.id AS span_id, type FROM claims JOIN ty ON list_contains(string_split(lower(claim_text), ' '), term))
SELECT span_id, projects.id AS project_id, CASE WHEN count(*) OVER (PARTITION BY span_id, type) = 1 THEN 0.5::DOUBLE ELSE 0.3::DOUBLE END AS score FROM na JOIN projects ON phase = type""")
register("cnd27_contamination_audit", lambda t: c.contamination_audit(t.interactions.withColumn("contact_id", F.when(F.col("channel") != "sms", F.col("contact_id"))), t.attributions.select("interaction_id", "project_id", F.col("confidence").alias("score")).where("project_id IS NOT NULL")), "interactions attributions", """
SELECT i.interaction_id, i.project_id AS own, count(DISTINCT a.project_id) AS others, string_agg(DISTINCT a.project_id, ',' ORDER BY a.project_id) AS other_projects
FROM interactions i JOIN attributions a ON a.interaction_id = i.interaction_id AND a.project_id <> i.project_id WHERE channel = 'sms' AND i.project_id IS NOT NULL AND confidence >= 0.5::DOUBLE GROUP BY 1, 2""")
# The other engine compares bytes: letters beyond ASCII stand as one sign each.
NICK = [("that", 1), ("than", 1), ("der", 2), ("die", 2), ("les", 3), ("des", 3)]
PAIRS = "SELECT interaction_id AS pair_id, w[{a}] || ' ' || w[{b}] AS name_a, replace(w[{a}], 'e', 'a') || ' ' || CASE WHEN length(text) % 4 = 0 THEN w[{a}] ELSE w[{b}] END AS name_b, length(text) % 3 <> 0 AS anchored, length(text) % 11 = 0 AS conflict FROM ({t}) WHERE {n} >= 3"


def _pairs(t):
    # Names are among the first three words: what follows is left in one piece, however long the text.
    words = t.texts.select("interaction_id", "text", F.filter(F.split("text", r"[^\p{L}]+", 5), lambda x: x != "").alias("w"))
    return t.spark.sql(PAIRS.format(a=0, b=1, t="SELECT * FROM {w}", n="size(w)"), w=words)


register("ent28_identity_merge_gate", lambda t: e.identity_merge_gate(_pairs(t), t.spark.createDataFrame(NICK, "name string, group int")).select("pair_id", "gate"), "texts", f"""
WITH tx AS (SELECT interaction_id, text, list_filter(string_split_regex(text, '[^\\p{{L}}]+'), lambda v: v <> '') AS w FROM texts), pa AS ({PAIRS.format(a=1, b=2, t="SELECT * FROM tx", n="len(w)")}),
ni(name, grp) AS (VALUES {_ROWS(NICK)}), x AS (SELECT *, split_part(lower(name_a), ' ', 1) AS fa, split_part(lower(name_b), ' ', 1) AS fb, split_part(lower(name_a), ' ', 2) = split_part(lower(name_b), ' ', 2) AS same FROM pa),
y AS (SELECT *, lower(name_a) = lower(name_b) AS exact, same AND (EXISTS (SELECT 1 FROM ni p JOIN ni q ON p.grp = q.grp WHERE p.name = fa AND q.name = fb) OR (length(fa) > 3 AND length(fb) > 3 AND jaro_winkler_similarity(translate(fa, 'éèêëçàáâíóúñäöüß', '0123456789!@#$%&'), translate(fb, 'éèêëçàáâíóúñäöüß', '0123456789!@#$%&')) >= 0.85)) AS near FROM x)
SELECT pair_id, CASE WHEN conflict THEN 'BLOCK' WHEN (exact OR near) AND anchored THEN 'AUTO_MERGE' WHEN exact OR near THEN 'SUGGEST' ELSE 'REJECT' END AS gate FROM y""")

PARTS = {
    "attributions": "SELECT interaction_id AS span_id, -confidence AS order_by, project_id, decision, CAST(round(confidence * 100) AS INT) AS percent FROM {attributions} WHERE project_id IS NOT NULL",
    "claims": "SELECT call_id AS span_id, -char_start AS order_by, id, claim_type, claim_text FROM {claims} WHERE active AND char_start IS NOT NULL",
    "loops": "SELECT call_id AS span_id, 0 AS order_by, id, loop_type FROM {loops} WHERE status = 'open'",
    "reviews": "SELECT interaction_id AS span_id, -hit_count AS order_by, reason, status FROM {review_queue}",
}
OWN = "SELECT interaction_id AS span_id, channel, contact_id, coalesce(project_id, 'none') AS project_id FROM {interactions}"
_FIELDS = {"attributions": "project_id decision percent", "claims": "id claim_type claim_text", "loops": "id loop_type", "reviews": "reason status"}


def _packages(t):
    table = lambda sql, name: t.spark.sql(sql, **{name: getattr(t, name)})
    parts = {k: table(sql, "review_queue" if k == "reviews" else k).withColumnRenamed("order_by", "order") for k, sql in PARTS.items()}
    return p.context_package(table(OWN, "interactions"), parts, {"attributions": 3, "claims": 2, "loops": 5, "reviews": 2})


def _json(fields: str) -> str:
    return "CAST(to_json(struct_pack(" + ", ".join(f"{f} := {f}" for f in fields.split()) + ")) AS VARCHAR)"


_MOST = {"attributions": 3, "claims": 2, "loops": 5, "reviews": 2}
_LISTS = ",\n".join(f"r_{k} AS (SELECT span_id, {_json(_FIELDS[k])} AS j, order_by FROM ({sql.format(**{n: n for n in ('attributions', 'claims', 'loops', 'review_queue')})})), l_{k} AS (SELECT span_id, string_agg(j, ',' ORDER BY n) AS s FROM (SELECT *, row_number() OVER (PARTITION BY span_id ORDER BY order_by, j) AS n FROM r_{k}) WHERE n <= {_MOST[k]} GROUP BY 1)" for k, sql in PARTS.items())
_TEXT = " || ".join(f"',\"{k}\":[' || coalesce(l_{k}.s, '') || ']'" for k in PARTS)
register("cnd23_context_package", _packages, "interactions attributions claims loops review_queue", f"""
WITH {_LISTS}, o AS (SELECT span_id, {_json("span_id channel contact_id project_id")} AS j FROM ({OWN.format(interactions="interactions")}))
SELECT o.span_id, chr(123) || '"span":' || j || {_TEXT} || chr(125) AS package FROM o {" ".join(f"LEFT JOIN l_{k} ON l_{k}.span_id = o.span_id" for k in PARTS)}""")

register("led25_recovered_claims_proof", lambda t: l.recovered_claims_proof(t.review_queue.where("status = 'pending' AND span_id IS NOT NULL").select("span_id"), t.claims), "review_queue claims", """
WITH s AS (SELECT DISTINCT span_id FROM review_queue WHERE status = 'pending' AND span_id IS NOT NULL), c AS (SELECT * FROM claims WHERE active AND source_span_id IN (SELECT span_id FROM s)),
d AS (SELECT count(*) AS n FROM c GROUP BY call_id, source_span_id, claim_type, claim_text HAVING count(*) > 1)
SELECT (SELECT count(*) FROM s) AS target_spans, (SELECT count(*) FROM c) AS recovered_claims, (SELECT count(*) FROM c WHERE char_start IS NOT NULL AND char_end IS NOT NULL AND pointer_type = 'transcript_span') AS with_pointer, (SELECT CAST(coalesce(sum(n - 1), 0) AS BIGINT) FROM d) AS duplicate_key_rows""")
register("met15_pending_null_span", lambda t: m.pending_null_span(t.review_queue), "review_queue", "SELECT module, reason, count(*) AS n, min(created_at) AS oldest FROM review_queue WHERE status = 'pending' AND span_id IS NULL GROUP BY 1, 2")
register("met15_pending_superseded", lambda t: m.pending_superseded(t.review_queue, t.spans), "review_queue spans", "SELECT q.id, q.interaction_id, q.span_id, segment_generation, q.created_at FROM review_queue q JOIN spans s USING (span_id) WHERE status = 'pending' AND is_superseded")
MONEY = "SELECT channel, CASE WHEN transcript_chars % 5 = 0 THEN NULL ELSE chr(123) || '\"inference_status\":\"' || CASE transcript_chars % 4 WHEN 0 THEN 'auto_assigned' WHEN 1 THEN 'flagged_for_review' WHEN 2 THEN 'no_inference' ELSE 'other' END || '\"' || chr(125) END AS financial_json FROM {i}"
register("met34_financial_coverage", lambda t: m.financial_coverage(t.spark.sql(MONEY, i=t.interactions)), "interactions", f"""
WITH f AS (SELECT channel, json_extract_string(financial_json, '$.inference_status') AS s, financial_json IS NOT NULL AS h FROM ({MONEY.format(i="interactions")}))
SELECT channel, count(*) AS total, count(*) FILTER (h) AS with_json, count(*) FILTER (s = 'auto_assigned') AS auto_assigned, count(*) FILTER (s = 'flagged_for_review') AS flagged_for_review, count(*) FILTER (s = 'no_inference') AS no_inference, count(*) FILTER (NOT h) AS pending, round(100.0::DOUBLE * count(*) FILTER (h) / count(*), 1) AS coverage_pct FROM f GROUP BY 1""")
