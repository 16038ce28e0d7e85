"""Queries of the policy, review and evaluation operators."""

from pyspark.sql import functions as F

from ..operators import evaluate as v
from ..operators import policy as p
from ..operators import review as r
from . import register

PR = "SELECT span_id, attribution_id, project_id, decision, confidence, length(attribution_id) % 4 = 0 AS owner_override, length(attribution_id) % 7 = 0 AS owner_conflict, attribution_lock IS NOT NULL AS anchored_contact, prompt_version = 'v1' AS strong_alias, prompt_version = 'v1' AS has_anchor FROM {a}"


def _pr(t):
    return t.spark.sql(PR, a=t.attributions)


HP = f"pr AS ({PR.format(a='attributions')})"
register("dec01_eligible_candidates", lambda t: p.eligible_candidates(t.affinity.select("contact_id", "project_id"), t.projects), "affinity projects", "SELECT contact_id, project_id FROM affinity WHERE project_id IN (SELECT id FROM projects WHERE status <> 'closed')")
register("dec02_anchor_rules", lambda t: p.anchor_rules(_pr(t), t.claims.selectExpr("source_span_id AS span_id", "claim_text AS text", "char_start IS NOT NULL AS verified", "warrant_level = 'high' AS strong"), t.part.where("p_size = 7").selectExpr("concat(p_name, ' ', p_type) AS name")).select("span_id", "attribution_id", "decision", "anchor_reason"), "attributions claims", f"""
WITH {HP}, s AS (SELECT DISTINCT lower(p_name || ' ' || p_type) AS n FROM part WHERE p_size = 7), k AS (SELECT source_span_id AS span_id, count(*) FILTER (WHERE char_start IS NOT NULL AND n IS NULL) AS v, count(*) FILTER (WHERE char_start IS NOT NULL AND warrant_level = 'high' AND n IS NULL) AS g FROM claims LEFT JOIN s ON s.n = lower(claim_text) GROUP BY 1),
w AS (SELECT pr.*, CASE WHEN decision = 'assign' AND coalesce(v, 0) = 0 THEN 'no_valid_anchor' WHEN decision = 'assign' AND coalesce(g, 0) = 0 AND NOT owner_override THEN 'no_strong_anchor' END AS anchor_reason FROM pr LEFT JOIN k USING (span_id))
SELECT span_id, attribution_id, CASE WHEN anchor_reason IS NOT NULL THEN 'review' ELSE decision END AS decision, anchor_reason FROM w""")
register("dec03_common_alias_guard", lambda t: p.common_alias_guard(_pr(t), t.claims.selectExpr("source_span_id AS span_id", "claim_text AS text", "active AS verified"), t.part.selectExpr("substring_index(p_name, ' ', 1) AS word", "'color' AS class").unionByName(t.part.where("p_size < 25").selectExpr("substring_index(p_name, ' ', -1) AS word", "'material' AS class")).unionByName(t.part.where("p_type <> 'SMALL'").selectExpr("lower(p_type) AS word", "'generic' AS class"))).select("span_id", "attribution_id", "decision", "common_alias"), "attributions claims", f"""
WITH {HP}, cw AS (SELECT split_part(p_name, ' ', 1) AS word FROM part UNION SELECT split_part(p_name, ' ', -1) FROM part WHERE p_size < 25 UNION SELECT lower(p_type) FROM part WHERE p_type <> 'SMALL'),
an AS (SELECT row_number() OVER () AS i, source_span_id AS span_id, string_split_regex(lower(trim(claim_text)), '\\s+') AS w FROM claims WHERE active), uw AS (SELECT i, span_id, len(w) AS n, unnest(w) AS word FROM an),
pa AS (SELECT i, span_id, any_value(n) AS n, count(*) FILTER (WHERE word NOT IN (SELECT word FROM cw)) AS o FROM uw GROUP BY 1, 2), fl AS (SELECT span_id, bool_and(o = 0 AND n <= 3) AS c FROM pa GROUP BY 1),
r AS (SELECT pr.*, decision = 'assign' AND coalesce(c, false) AS bad FROM pr LEFT JOIN fl USING (span_id)) SELECT span_id, attribution_id, CASE WHEN bad THEN 'review' ELSE decision END AS decision, bad AS common_alias FROM r""")
register("dec04_location_rule", lambda t: p.location_rule_guard(_pr(t), t.claims.selectExpr("source_span_id AS span_id", "CASE WHEN active THEN 'address' ELSE 'alias' END AS kind", "claim_text AS text", "warrant_level = 'high' AS strong", "project_id AS candidate_project_id"), t.part.where("p_type = 'SMALL'").selectExpr("p_name AS phrase", "'77' AS project_id").distinct()).select("span_id", "attribution_id", "decision", "location_rule"), "attributions claims", f"""
WITH {HP}, ru AS (SELECT DISTINCT lower(p_name) AS phrase FROM part WHERE p_type = 'SMALL'), sa AS (SELECT DISTINCT source_span_id AS span_id FROM claims JOIN ru ON contains(lower(claim_text), phrase) WHERE active),
ag AS (SELECT DISTINCT source_span_id AS span_id FROM claims WHERE warrant_level = 'high' AND project_id <> '77'), r AS (SELECT pr.*, span_id IN (SELECT span_id FROM sa) AND span_id NOT IN (SELECT span_id FROM ag) AS hit FROM pr)
SELECT span_id, attribution_id, CASE WHEN hit THEN 'assign' ELSE decision END AS decision, hit AS location_rule FROM r""")
register("dec05_thresholds", lambda t: p.thresholds(_pr(t)).select("span_id", "attribution_id", "decision", "safe_promoted"), "attributions", f"""WITH {HP}, s AS (SELECT *, decision = 'assign' AND confidence >= 0.4::DOUBLE AND confidence < 0.75::DOUBLE AND anchored_contact AND strong_alias AS sp FROM pr)
SELECT span_id, attribution_id, CASE WHEN sp THEN 'assign' WHEN confidence < 0.25::DOUBLE THEN 'none' WHEN decision = 'assign' AND confidence < 0.75::DOUBLE THEN 'review' ELSE decision END AS decision, sp AS safe_promoted FROM s""")
register("dec06_commitment_gate", lambda t: p.commitment_gate(_pr(t), t.spans.selectExpr("span_id", "CASE WHEN word_count > 1500 THEN 'high' ELSE 'none' END AS prospect", "span_index % 2 = 0 AS committed")).select("span_id", "attribution_id", "project_id", "decision", "commitment_gated"), "attributions spans", f"""WITH {HP}, g AS (SELECT pr.*, coalesce(word_count > 1500 AND span_index % 2 <> 0, false) AS g FROM pr LEFT JOIN spans USING (span_id))
SELECT span_id, attribution_id, CASE WHEN NOT g THEN project_id END AS project_id, CASE WHEN g AND decision <> 'none' THEN 'review' ELSE decision END AS decision, g AS commitment_gated FROM g""")
register("dec08_owner_gate", lambda t: p.owner_gate(_pr(t), t.attributions.select("span_id", "project_id")).select("span_id", "attribution_id", "decision", "confidence", "owner_gated").distinct(), "attributions", f"""WITH {HP}, o AS (SELECT DISTINCT pr.span_id FROM pr JOIN attributions a ON a.span_id = pr.span_id AND a.project_id <> pr.project_id), g AS (SELECT pr.*, owner_override AND NOT owner_conflict AND project_id IS NOT NULL AND span_id NOT IN (SELECT span_id FROM o) AS g FROM pr)
SELECT DISTINCT span_id, attribution_id, CASE WHEN g THEN 'assign' ELSE decision END AS decision, CASE WHEN g THEN greatest(0.92::DOUBLE, confidence) ELSE confidence END AS confidence, g AS owner_gated FROM g""")
register("dec09_block_and_closed", lambda t: p.block_and_closed_filters(_pr(t), t.projects.where("phase = 'framing'").selectExpr("id AS project_id"), t.projects).select("span_id", "attribution_id", "project_id", "decision", "confidence"), "attributions projects", f"""WITH {HP}
SELECT span_id, attribution_id, CASE WHEN coalesce(phase, '') <> 'framing' THEN project_id END AS project_id, CASE WHEN phase = 'framing' THEN 'none' WHEN decision = 'assign' AND status = 'closed' THEN 'review' ELSE decision END AS decision, CASE WHEN phase = 'framing' THEN 0.0::DOUBLE ELSE confidence END AS confidence FROM pr LEFT JOIN projects j ON j.id = pr.project_id""")
register("dec10_junk_override", lambda t: p.junk_override(_pr(t), t.spans.selectExpr("span_id", "word_count < 600 AS junk")).select("span_id", "attribution_id", "decision", "confidence", "junk"), "attributions spans", f"""WITH {HP}, j AS (SELECT pr.*, coalesce(word_count < 600, false) AND decision <> 'assign' AS j FROM pr LEFT JOIN spans USING (span_id))
SELECT span_id, attribution_id, CASE WHEN j THEN 'none' ELSE decision END AS decision, CASE WHEN j THEN least(0.2::DOUBLE, confidence) ELSE confidence END AS confidence, j AS junk FROM j""")
GK = f"""WITH {HP}, l AS (SELECT span_id, attribution_lock AS held, project_id AS hp FROM attributions QUALIFY row_number() OVER (PARTITION BY span_id ORDER BY CASE attribution_lock WHEN 'human' THEN 3 WHEN 'ai' THEN 2 ELSE 0 END DESC, attributed_at DESC, attribution_id) = 1),
f AS (SELECT pr.*, held, hp, decision = 'assign' AND confidence >= 0.75::DOUBLE AND (has_anchor OR owner_override) AND project_id IS NOT NULL AS fit FROM pr LEFT JOIN l USING (span_id)),
g AS (SELECT *, CASE WHEN held = 'human' THEN 'human_lock_present' WHEN held = 'ai' AND NOT fit THEN 'ai_lock_preserved' WHEN fit THEN 'auto_assigned' WHEN decision = 'none' THEN 'no_match' ELSE 'needs_review' END AS reason FROM f)"""
register("dec11_gatekeeper", lambda t: p.gatekeeper(_pr(t), t.attributions).select("span_id", "attribution_id", "reason", "applied_project_id", "new_lock"), "attributions", f"""{GK}
SELECT span_id, attribution_id, reason, CASE WHEN reason IN ('human_lock_present', 'ai_lock_preserved') THEN hp WHEN reason = 'auto_assigned' THEN project_id END AS applied_project_id, CASE WHEN held = 'human' THEN 'human' WHEN fit OR held = 'ai' THEN 'ai' END AS new_lock FROM g""")
register("dec12_derive_labels", lambda t: p.derive_labels(p.gatekeeper(_pr(t), t.attributions)).groupBy("attribution_source", "evidence_tier").agg(F.count("*").alias("n")), "attributions", f"""{GK}
SELECT CASE WHEN reason = 'human_lock_present' THEN 'human' WHEN owner_override THEN 'owner_override' WHEN reason = 'auto_assigned' THEN 'model' ELSE 'none' END AS attribution_source, CASE WHEN strong_alias AND anchored_contact THEN 1 WHEN strong_alias OR anchored_contact THEN 2 ELSE 3 END AS evidence_tier, count(*) AS n FROM g GROUP BY 1, 2""")
register("dec13_reason_codes", lambda t: t.attributions.select("attribution_id", p.reason_codes(F.when(F.col("needs_review"), "review"), F.when(F.col("project_id").isNull(), "no_project"), F.when(F.col("decision") == "review", "review"), F.col("attribution_lock")).alias("codes")), "attributions", "SELECT attribution_id, concat_ws(',', CASE WHEN needs_review THEN 'review' END, CASE WHEN project_id IS NULL THEN 'no_project' END, attribution_lock) AS codes FROM attributions")
register("dec14_review_queue_merge", lambda t: p.review_queue_merge(t.review_queue.where("span_id IS NOT NULL").groupBy("span_id").agg(F.min("status").alias("status"), F.sum("hit_count").alias("hit_count"), F.min("reason").alias("reason")), _pr(t).groupBy("span_id").agg(F.min("decision").alias("decision"), F.lit("fresh").alias("reason"))), "attributions review_queue", f"""
WITH {HP}, q AS (SELECT span_id, min(status) AS status, CAST(sum(hit_count) AS BIGINT) AS hit_count, min(reason) AS reason FROM review_queue WHERE span_id IS NOT NULL GROUP BY 1), d AS (SELECT span_id, min(decision) AS decision FROM pr GROUP BY 1),
b AS (SELECT coalesce(q.span_id, d.span_id) AS span_id, CASE WHEN status = 'pending' AND decision = 'assign' THEN 'resolved' WHEN status IS NULL AND decision = 'review' THEN 'pending' ELSE status END AS status, CASE WHEN status = 'pending' AND decision = 'review' THEN hit_count + 1 ELSE coalesce(hit_count, 1) END AS hit_count, CASE WHEN d.span_id IS NOT NULL THEN 'fresh' ELSE reason END AS reason FROM q FULL JOIN d ON q.span_id = d.span_id)
SELECT * FROM b WHERE status IS NOT NULL""")

RES = "SELECT CASE WHEN hit_count = 5 THEN 'x' || id ELSE id END AS item_id, CASE WHEN confidence > 0.95 THEN '' ELSE 'rev' END AS actor, CASE WHEN hit_count = 1 THEN project_id ELSE '9' END AS project_id, created_at AS requested_at FROM {q} WHERE hit_count <> 2"
register("rev01_apply_resolutions", lambda t: r.apply_resolutions(t.review_queue, t.spark.sql(RES, q=t.review_queue), t.attributions).groupBy("result", "action").agg(F.count("*").alias("n")), "review_queue attributions", f"""
WITH a AS (SELECT *, row_number() OVER (PARTITION BY item_id ORDER BY requested_at, actor) AS n FROM ({RES.format(q='review_queue')})), l AS (SELECT span_id, attribution_id, attribution_lock, project_id AS op FROM attributions QUALIFY row_number() OVER (PARTITION BY span_id ORDER BY attributed_at DESC, attribution_id DESC) = 1),
j AS (SELECT a.*, q.status, l.attribution_id, attribution_lock, op FROM a LEFT JOIN review_queue q ON q.id = a.item_id LEFT JOIN l ON l.span_id = q.span_id),
k AS (SELECT *, CASE WHEN actor = '' THEN 'missing_actor' WHEN status IS NULL THEN 'not_found' WHEN status = 'resolved' OR n > 1 THEN 'already_resolved' WHEN status <> 'pending' THEN 'not_pending' WHEN attribution_id IS NULL THEN 'no_attribution' WHEN attribution_lock = 'human' AND op IS DISTINCT FROM project_id THEN 'human_lock_conflict' ELSE 'ok' END AS result FROM j)
SELECT result, CASE WHEN result = 'ok' THEN CASE WHEN op IS NOT DISTINCT FROM project_id THEN 'confirm' ELSE 'override' END END AS action, count(*) AS n FROM k GROUP BY 1, 2""")
register("rev02_auto_resolve", lambda t: r.auto_resolve_completed(t.review_queue, t.interactions), "review_queue interactions", "SELECT id, q.interaction_id, CASE WHEN status = 'pending' AND i.interaction_id IS NOT NULL THEN 'resolved' ELSE status END AS status, status = 'pending' AND i.interaction_id IS NOT NULL AS auto_resolved FROM review_queue q LEFT JOIN interactions i ON i.interaction_id = q.interaction_id AND i.contact_id IS NOT NULL AND i.project_id IS NOT NULL")
register("rev03_retarget_superseded", lambda t: r.retarget_superseded(t.review_queue, t.spans.unionByName(t.spans.where("is_superseded AND word_count > 1500").selectExpr("concat(span_id, 'n') AS span_id", "interaction_id", "span_index", "char_start", "char_end", "false AS is_superseded", "3 AS segment_generation", "word_count", "created_at")), t.attributions.where("confidence > 0.5").withColumn("span_id", F.concat("span_id", F.lit("n")))), "review_queue spans attributions", """
WITH o AS (SELECT * FROM spans WHERE is_superseded), q AS (SELECT id, q.span_id, CASE WHEN word_count > 1500 THEN span_id || 'n' END AS target FROM review_queue q JOIN o USING (span_id) WHERE status = 'pending'),
a AS (SELECT *, CASE WHEN target IS NULL THEN 'dismiss_missing' WHEN EXISTS (SELECT 1 FROM attributions x WHERE x.span_id = q.span_id AND confidence > 0.5 AND decision = 'assign') THEN 'dismiss_attributed' ELSE 'retarget' END AS action FROM q) SELECT id, span_id, action, CASE WHEN action = 'retarget' THEN target END AS target FROM a""")
register("rev04_dismiss_stale", lambda t: r.dismiss_stale(t.review_queue, t.spans.where("word_count < 2900")), "review_queue spans", """
SELECT id, CASE WHEN q.span_id IS NULL THEN 'no_span' WHEN s.span_id IS NULL THEN 'span_missing' WHEN is_superseded THEN 'superseded' END AS dismiss_reason FROM review_queue q LEFT JOIN spans s ON s.span_id = q.span_id AND word_count < 2900 WHERE status = 'pending' AND (q.span_id IS NULL OR s.span_id IS NULL OR is_superseded)""")
NC = "n AS (SELECT id, interaction_id, CASE WHEN regexp_matches(interaction_id, '^(11|test)') THEN 'dismiss_synthetic' WHEN interaction_id NOT IN (SELECT interaction_id FROM interactions WHERE channel <> 'sms') THEN 'dismiss_no_interaction' WHEN interaction_id IN (SELECT interaction_id FROM attributions WHERE decision = 'assign') THEN 'resolve_already_resolved' ELSE 'keep' END AS action FROM review_queue WHERE status = 'pending' AND span_id IS NULL)"
register("rev05_noise_cleanup", lambda t: r.noise_cleanup(t.review_queue, t.interactions.where("channel <> 'sms'"), t.attributions, "^(11|test)"), "review_queue interactions attributions", f"WITH {NC} SELECT * FROM n")
register("rev06_noise_classification", lambda t: r.noise_classification(r.noise_cleanup(t.review_queue, t.interactions.where("channel <> 'sms'"), t.attributions, "^(11|test)")), "review_queue interactions attributions", f"WITH {NC} SELECT action, count(*) AS n FROM n GROUP BY 1")
register("rev07_junk_cleanup", lambda t: r.junk_cleanup(t.review_queue, t.attributions, t.spans.selectExpr("span_id", "word_count < 300 AS junk"))[0].select("id", "span_id", "status"), "review_queue spans", "SELECT id, span_id, 'dismissed' AS status FROM review_queue WHERE status = 'pending' AND span_id IN (SELECT span_id FROM spans WHERE word_count < 300)")
register("rev08_double_covered_fix", lambda t: r.double_covered_fix(t.attributions, t.review_queue), "attributions review_queue", "WITH w AS (SELECT DISTINCT span_id FROM review_queue WHERE status = 'pending' AND span_id IS NOT NULL) SELECT attribution_id, a.span_id, needs_review OR (w.span_id IS NOT NULL AND decision = 'assign') AS needs_review, w.span_id IS NOT NULL AND decision = 'assign' AND NOT needs_review AS fixed FROM attributions a LEFT JOIN w ON w.span_id = a.span_id")
register("rev10_needs_triage", lambda t: r.needs_triage(t.review_queue, "1998-01-01"), "review_queue", """
SELECT id, module, CASE WHEN module = 'journal' THEN CASE reason WHEN 'conflict' THEN 5 WHEN 'open_loop' THEN 3 ELSE 1 END ELSE hit_count * CASE WHEN confidence < 0.5 THEN 3 WHEN confidence < 0.7::DOUBLE THEN 2 ELSE 1 END * CASE WHEN created_at < TIMESTAMP '1997-12-25' THEN 2 ELSE 1 END END AS urgency, created_at FROM review_queue WHERE status = 'pending'""")
register("rev11_review_queue_spans", lambda t: r.review_queue_spans(t.review_queue, t.spans, t.interactions, t.attributions).select("id", "interaction_id", "span_id", "contact_id", "attributed_project", "attributed_confidence"), "review_queue interactions attributions", """
WITH l AS (SELECT span_id, project_id, confidence FROM attributions QUALIFY row_number() OVER (PARTITION BY span_id ORDER BY attributed_at DESC, attribution_id DESC) = 1)
SELECT id, q.interaction_id, q.span_id, contact_id, l.project_id AS attributed_project, l.confidence AS attributed_confidence FROM review_queue q LEFT JOIN interactions i ON i.interaction_id = q.interaction_id LEFT JOIN l ON l.span_id = q.span_id""")
register("rev13_pick_fresh", lambda t: r.pick_fresh_review_items(t.review_queue, t.interactions.where("needs_review"), {"conflict": 3, "open_loop": 5, "model_error": 2}), "review_queue interactions", """
WITH f AS (SELECT * FROM review_queue WHERE status = 'pending' AND interaction_id NOT IN (SELECT interaction_id FROM interactions WHERE needs_review)), o AS (SELECT * FROM f QUALIFY row_number() OVER (PARTITION BY interaction_id ORDER BY created_at DESC, id) = 1)
SELECT id, interaction_id, reason, created_at FROM o WHERE reason IN ('conflict', 'open_loop', 'model_error') QUALIFY row_number() OVER (PARTITION BY reason ORDER BY created_at DESC, id) <= CASE reason WHEN 'conflict' THEN 3 WHEN 'open_loop' THEN 5 ELSE 2 END""")
register("rev09_speaker_backfill_audit", lambda t: r.speaker_backfill(t.claims.dropDuplicates(["id"]), t.claims.where("active").selectExpr("id AS claim_id", "contact_id").distinct())[1], "claims", "SELECT DISTINCT id, CAST(NULL AS VARCHAR) AS old_speaker, contact_id AS new_speaker FROM claims WHERE speaker_contact_id IS NULL AND active")

SC = "SELECT l.doc_id, l.quality AS expected, CASE WHEN n_chars < 600 THEN 0 ELSE 1 END AS predicted, d.lang, d.source FROM {l} l JOIN {d} d ON l.doc_id = d.doc_id"


def _sc(t):
    return t.spark.sql(SC, l=t.labels, d=t.documents)


HS = f"s AS (SELECT *, CASE WHEN expected IS NULL THEN NULL WHEN expected = predicted THEN 1 ELSE 0 END AS correct FROM ({SC.format(l='labels', d='documents')}))"
register("eva01_eval_report", lambda t: v.eval_report(v.dominant_topic_score(_sc(t)), ["lang", "source"]), "", f"""WITH {HS}
SELECT 'lang' AS slice, lang AS value, count(correct) AS labelled, CAST(sum(correct) AS BIGINT) AS right, round(100.0::DOUBLE * sum(correct) / count(correct), 2) AS accuracy_pct FROM s GROUP BY lang UNION ALL SELECT 'source', source, count(correct), CAST(sum(correct) AS BIGINT), round(100.0::DOUBLE * sum(correct) / count(correct), 2) FROM s GROUP BY source
UNION ALL SELECT 'all', 'all', count(correct), CAST(sum(correct) AS BIGINT), round(100.0::DOUBLE * sum(correct) / count(correct), 2) FROM s""")
GT = "SELECT attribution_id, decision, project_id, 'Project ' || project_id AS project_name, CASE WHEN prompt_version = 'v1' THEN 'assign' END AS expected_decision, CASE WHEN attribution_lock = 'human' THEN '7' END AS expected_project_id, CASE WHEN attribution_lock = 'ai' THEN 'PROJECT 1' END AS expected_name_contains FROM {a}"
HG = f"g AS (SELECT *, CAST((expected_decision IS NULL OR expected_decision = decision) AND (expected_project_id IS NULL OR coalesce(expected_project_id = project_id, false)) AND (expected_name_contains IS NULL OR coalesce(contains(lower(project_name), 'project 1'), false)) AS INT) AS correct FROM ({GT.format(a='attributions')}) WHERE coalesce(expected_decision, expected_project_id, expected_name_contains) IS NOT NULL)"
register("eva02_gt_correctness", lambda t: v.gt_correctness(t.spark.sql(GT, a=t.attributions)).select("attribution_id", "correct"), "attributions", f"WITH {HG} SELECT attribution_id, correct FROM g")
register("eva04_bucket_metrics", lambda t: v.bucket_metrics(v.gt_correctness(t.spark.sql(GT, a=t.attributions)).withColumn("tags", F.concat_ws("; ", "expected_decision", F.lit("all")))), "attributions", f"WITH {HG}, e AS (SELECT *, 'all' AS tag FROM g UNION ALL SELECT *, expected_decision FROM g WHERE expected_decision IS NOT NULL) SELECT tag, count(*) AS rows, round(100.0::DOUBLE * sum(correct) / count(correct), 2) AS accuracy_pct, round(100.0::DOUBLE * count(*) FILTER (WHERE decision = 'review') / count(*), 2) AS review_pct, round(100.0::DOUBLE * count(*) FILTER (WHERE decision = 'none') / count(*), 2) AS none_pct FROM e GROUP BY 1")
register("eva05_review_contamination", lambda t: v.review_contamination(t.attributions, t.claims), "attributions claims", "WITH l AS (SELECT * FROM attributions QUALIFY row_number() OVER (PARTITION BY span_id ORDER BY attributed_at DESC, attribution_id DESC) = 1), h AS (SELECT l.*, EXISTS (SELECT 1 FROM claims c WHERE c.source_span_id = l.span_id AND active) AS c FROM l WHERE decision <> 'assign') SELECT decision, count(*) AS spans, count(*) FILTER (WHERE c) AS with_claims, round(100.0::DOUBLE * count(*) FILTER (WHERE c) / count(*), 2) AS rate_pct FROM h GROUP BY 1")
CF = "SELECT CAST(o_orderkey % 25 AS STRING) AS expected, CASE WHEN o_custkey % 9 = 0 THEN NULL ELSE CAST((o_orderkey + CASE WHEN o_custkey % 4 = 0 THEN 1 ELSE 0 END) % 25 AS STRING) END AS predicted, CAST(o_orderkey AS STRING) AS id, o_orderdate AS at_, o_orderpriority AS tier, o_orderstatus AS kind, o_custkey FROM {o}"
register("eva06_confusion_by_project", lambda t: v.confusion_by_project(t.spark.sql(CF, o=t.orders)), "", f"""WITH c AS ({CF.format(o='orders')}), p AS (SELECT expected AS project, count(*) FILTER (WHERE expected = predicted) AS tp, 0 AS fp, count(*) FILTER (WHERE expected IS DISTINCT FROM predicted) AS fn FROM c GROUP BY 1 UNION ALL SELECT predicted, 0, count(*) FILTER (WHERE expected <> predicted), 0 FROM c WHERE predicted IS NOT NULL GROUP BY 1),
s AS (SELECT project, CAST(sum(tp) AS BIGINT) AS tp, CAST(sum(fp) AS BIGINT) AS fp, CAST(sum(fn) AS BIGINT) AS fn FROM p GROUP BY 1) SELECT *, round(tp / (tp + fp), 4) AS precision, round(tp / (tp + fn), 4) AS recall, round(2 * tp / (2 * tp + fp + fn), 4) AS f1 FROM s""")
register("eva07_paired_ab", lambda t: v.paired_ab(t.spark.sql(CF, o=t.orders).selectExpr("CAST(expected <=> predicted AS INT) AS a", "CAST(o_custkey % 3 <> 0 AS INT) AS b", "kind"), ["kind"]), "", f"""WITH c AS (SELECT CAST(expected IS NOT DISTINCT FROM predicted AS INT) AS a, CAST(o_custkey % 3 <> 0 AS INT) AS b, kind FROM ({CF.format(o='orders')})), u AS (SELECT a, b, kind FROM c UNION ALL SELECT a, b, 'all' FROM c),
g AS (SELECT kind, count(*) AS n, count(*) FILTER (WHERE a = 1 AND b = 1) AS both, count(*) FILTER (WHERE a = 1 AND b = 0) AS only_a, count(*) FILTER (WHERE a = 0 AND b = 1) AS only_b, count(*) FILTER (WHERE a = 0 AND b = 0) AS neither FROM u GROUP BY 1) SELECT *, round((only_a - only_b) * (only_a - only_b) / (only_a + only_b), 4) AS chi_square, only_a + only_b < 25 AS needs_exact_test FROM g""")
register("eva08_temporal_backtest", lambda t: v.temporal_backtest(t.spark.sql(CF, o=t.orders).withColumnRenamed("at_", "at")), "", f"""WITH c AS ({CF.format(o='orders')}), h AS (SELECT *, row_number() OVER (ORDER BY at_ DESC, id) AS rn, count(*) OVER () AS n FROM c), k AS (SELECT * FROM h WHERE rn <= greatest(1, ceil(0.3::DOUBLE * n)))
SELECT count(*) AS holdout, count(predicted) AS answered, count(*) FILTER (WHERE predicted = expected) AS right, round(100.0::DOUBLE * count(*) FILTER (WHERE predicted = expected) / count(predicted), 2) AS precision_pct, round(100.0::DOUBLE * count(*) FILTER (WHERE predicted = expected) / count(expected), 2) AS recall_pct, round(100.0::DOUBLE * count(*) FILTER (WHERE predicted IS NULL) / count(*), 2) AS abstain_pct FROM k""")
register("eva09_version_scoreboard", lambda t: v.version_scoreboard(t.attributions.withColumnRenamed("prompt_version", "version"), "v1", "v2", {"assigned": F.count_if(F.col("decision") == "assign"), "with_project": F.count("project_id"), "best": F.max("confidence")}), "attributions", """
WITH e AS (SELECT prompt_version AS ver, CAST(count(*) FILTER (WHERE decision = 'assign') AS DOUBLE) AS assigned, CAST(count(project_id) AS DOUBLE) AS with_project, max(confidence) AS best FROM attributions GROUP BY 1), l AS (SELECT ver, unnest(['assigned', 'with_project', 'best']) AS metric, unnest([assigned, with_project, best]) AS value FROM e),
b AS (SELECT metric, max(value) FILTER (WHERE ver = 'v1') AS old_value, max(value) FILTER (WHERE ver = 'v2') AS new_value FROM l GROUP BY 1) SELECT *, CASE WHEN new_value >= old_value THEN 'PASS' ELSE 'FAIL' END AS status FROM b""")
register("eva11_hard_negative_labels", lambda t: v.hard_negative_labels(t.interactions), "interactions", """
WITH o AS (SELECT interaction_id, contact_id, project_id, CAST(event_at_utc AS DATE) AS d FROM interactions WHERE project_id IS NOT NULL), n AS (SELECT a.interaction_id, a.contact_id, b.project_id, min(abs(b.d - a.d)) AS gap_days FROM o a JOIN o b ON a.contact_id = b.contact_id AND a.project_id <> b.project_id AND abs(b.d - a.d) <= 30 GROUP BY 1, 2, 3)
SELECT o.interaction_id, o.contact_id, o.project_id, 1 AS label, CAST(0 AS INT) AS gap_days, 'positive' AS difficulty FROM o WHERE interaction_id IN (SELECT interaction_id FROM n) UNION ALL SELECT interaction_id, contact_id, project_id, 0, CAST(gap_days AS INT), CASE WHEN gap_days <= 2 THEN 'hard' WHEN gap_days <= 7 THEN 'medium' ELSE 'easy' END FROM n""")
register("eva12_stratified_sample", lambda t: v.stratified_sample(t.interactions.select("interaction_id", "channel"), "channel", "interaction_id", 50), "interactions", "SELECT interaction_id, channel FROM interactions QUALIFY row_number() OVER (PARTITION BY channel ORDER BY md5('7:' || interaction_id), interaction_id) <= 50")
register("eva13_ingest_gt_segments", lambda t: v.ingest_gt_segments(t.lineitem.selectExpr("CAST(l_orderkey AS STRING) AS call_id", "l_linenumber AS segment", "l_returnflag AS turn_type", "concat(' PROJECT ', l_suppkey + 9) AS project_name", "l_shipdate AS labelled_at", "concat(l_partkey, '-', l_suppkey, '-', l_extendedprice) AS label_id"), t.projects), "projects", """
WITH s AS (SELECT CAST(l_orderkey AS VARCHAR) AS call_id, l_linenumber AS segment, l_returnflag AS turn_type, l_suppkey + 9 AS k, l_shipdate AS a, CAST(l_partkey AS VARCHAR) || '-' || CAST(l_suppkey AS VARCHAR) || '-' || CAST(l_extendedprice AS VARCHAR) AS lid FROM lineitem), o AS (SELECT * FROM s QUALIFY row_number() OVER (PARTITION BY call_id, segment, turn_type ORDER BY a DESC, lid) = 1)
SELECT call_id, segment, turn_type, p.id AS project_id, p.id IS NOT NULL AS resolved FROM o LEFT JOIN projects p ON p.id = CAST(k AS VARCHAR)""")
LIM = "SELECT CASE r_regionkey WHEN 0 THEN 'review_pct' WHEN 1 THEN 'with_project_pct' ELSE 'unmeasured_' || CAST(r_regionkey AS STRING) END AS metric, CASE WHEN r_regionkey = 0 THEN 'max' ELSE 'min' END AS side, CAST(30 + r_regionkey * 10 AS DOUBLE) AS limit FROM {r}"
register("eva10_launch_scorecard", lambda t: v.launch_scorecard(t.attributions.agg(F.round(100.0 * F.count_if("needs_review") / F.count("*"), 2).alias("review_pct"), F.round(100.0 * F.count("project_id") / F.count("*"), 2).alias("with_project_pct")).selectExpr("stack(2, 'review_pct', review_pct, 'with_project_pct', with_project_pct) AS (metric, value)"), t.spark.sql(LIM.replace("AS limit", "AS `limit`"), r=t.region)), "attributions", f"""
WITH m AS (SELECT 'review_pct' AS metric, round(100.0::DOUBLE * count(*) FILTER (WHERE needs_review) / count(*), 2) AS value FROM attributions UNION ALL SELECT 'with_project_pct', round(100.0::DOUBLE * count(project_id) / count(*), 2) FROM attributions), l AS ({LIM.format(r='region').replace('AS limit', 'AS "limit"')})
SELECT metric, value, side, "limit", CASE WHEN value IS NULL THEN 'NOT_MEASURED' WHEN side = 'min' AND value >= "limit" OR side = 'max' AND value <= "limit" THEN 'GO' ELSE 'NO_GO' END AS verdict FROM l LEFT JOIN m USING (metric)""")
