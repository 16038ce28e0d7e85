"""Queries of the affinity and claims operators."""

from pyspark.sql import functions as F

from ..functions.basics import at
from ..operators import affinity as a
from ..operators import ledger as d
from . import register

ATTR = "SELECT contact_id, a.project_id, confidence FROM {a} a JOIN {i} i ON a.interaction_id = i.interaction_id"


def _attr(t):
    return t.spark.sql(ATTR, a=t.attributions, i=t.interactions)


register("aff01_from_attributions", lambda t: a.affinity_from_attributions(t.affinity, _attr(t)).withColumn("weight", F.round("weight", 6)), "affinity attributions interactions", f"""
WITH x AS ({ATTR.format(a="attributions", i="interactions")}), n AS (SELECT contact_id, project_id, sum(confidence * 0.1::DOUBLE) AS add, count(*) AS n FROM x WHERE confidence >= 0.8::DOUBLE AND project_id IS NOT NULL GROUP BY 1, 2)
SELECT coalesce(f.contact_id, n.contact_id) AS contact_id, coalesce(f.project_id, n.project_id) AS project_id, round(CASE WHEN add IS NULL THEN weight ELSE least(2.0, coalesce(weight, 0) + add) END, 6) AS weight, CAST(coalesce(confirmation_count, 0) + coalesce(n, 0) AS BIGINT) AS confirmation_count
FROM affinity f FULL JOIN n ON f.contact_id = n.contact_id AND f.project_id = n.project_id""")
register("aff02_from_overrides", lambda t: a.affinity_from_overrides(t.affinity, t.overrides, ["created_at", "seq"]).withColumn("weight", F.round("weight", 6)), "affinity overrides", """
WITH RECURSIVE o AS (SELECT contact_id, project_id, action, row_number() OVER (PARTITION BY contact_id, project_id ORDER BY created_at, seq) AS n FROM overrides),
s AS (SELECT coalesce(f.contact_id, x.contact_id) AS contact_id, coalesce(f.project_id, x.project_id) AS project_id, coalesce(weight, 0.0::DOUBLE) AS weight FROM affinity f FULL JOIN (SELECT DISTINCT contact_id, project_id FROM o) x ON f.contact_id = x.contact_id AND f.project_id = x.project_id),
r AS (SELECT contact_id, project_id, weight, 0 AS n FROM s UNION ALL SELECT r.contact_id, r.project_id, CASE action WHEN 'confirm' THEN least(2.0::DOUBLE, weight + 0.3::DOUBLE) ELSE greatest(0.0::DOUBLE, weight - 0.2::DOUBLE) END, o.n FROM r JOIN o ON o.contact_id = r.contact_id AND o.project_id = r.project_id AND o.n = r.n + 1)
SELECT contact_id, project_id, round(weight, 6) AS weight FROM r QUALIFY row_number() OVER (PARTITION BY contact_id, project_id ORDER BY n DESC) = 1""")
register("aff03_feedback", lambda t: a.affinity_feedback(t.affinity, t.overrides, ["created_at", "seq"]).withColumn("weight", F.round("weight", 6)), "affinity overrides", """
WITH RECURSIVE o AS (SELECT contact_id, project_id, action, row_number() OVER (PARTITION BY contact_id, project_id ORDER BY created_at, seq) AS n FROM overrides),
k AS (SELECT contact_id, project_id, count(*) FILTER (WHERE action = 'confirm') AS c, count(*) FILTER (WHERE action = 'reject') AS j FROM o GROUP BY 1, 2),
s AS (SELECT coalesce(f.contact_id, k.contact_id) AS contact_id, coalesce(f.project_id, k.project_id) AS project_id, coalesce(weight, 0.0::DOUBLE) AS weight, CAST(coalesce(confirmation_count, 0) + coalesce(c, 0) AS INT) AS confirmation_count, CAST(coalesce(rejection_count, 0) + coalesce(j, 0) AS INT) AS rejection_count FROM affinity f FULL JOIN k ON f.contact_id = k.contact_id AND f.project_id = k.project_id),
r AS (SELECT *, 0 AS n FROM s UNION ALL SELECT r.contact_id, r.project_id, greatest(0.0::DOUBLE, weight + CASE action WHEN 'confirm' THEN 1 ELSE -1 END), confirmation_count, rejection_count, o.n FROM r JOIN o ON o.contact_id = r.contact_id AND o.project_id = r.project_id AND o.n = r.n + 1)
SELECT contact_id, project_id, round(weight, 6) AS weight, confirmation_count, rejection_count FROM r QUALIFY row_number() OVER (PARTITION BY contact_id, project_id ORDER BY n DESC) = 1""")
register("aff04_decay", lambda t: a.affinity_decay(t.affinity).select("contact_id", "project_id", "weight"), "affinity", "SELECT contact_id, project_id, CASE WHEN weight > 0.01 THEN weight * 0.95::DOUBLE ELSE weight END AS weight FROM affinity")
register("aff05_share", lambda t: a.affinity_share(t.interactions), "interactions", "WITH n AS (SELECT contact_id, project_id, count(*) AS n, max(event_at_utc) AS last_interaction_at FROM interactions WHERE project_id IS NOT NULL GROUP BY 1, 2) SELECT *, n / sum(n) OVER (PARTITION BY contact_id) AS weight FROM n")
register("aff06_sync_assignments", lambda t: a.sync_assignments(t.affinity.where("weight > 0.2"), t.project_contacts), "affinity project_contacts", "SELECT contact_id, project_id, 0.8::DOUBLE AS weight FROM project_contacts p WHERE NOT EXISTS (SELECT 1 FROM affinity f WHERE weight > 0.2::DOUBLE AND f.contact_id = p.contact_id AND f.project_id = p.project_id)")
register("aff07_block_internal_floaters", lambda t: a.block_internal_floaters(t.affinity.select("contact_id", "project_id", "weight"), t.contacts), "affinity contacts", "SELECT contact_id, project_id, weight FROM affinity f WHERE weight <= 0 OR NOT EXISTS (SELECT 1 FROM contacts c WHERE c.id = f.contact_id AND (is_internal OR floats_between_projects))")
register("aff08_contact_stats", lambda t: a.contact_stats(t.calls.selectExpr("contact_id", "CAST(CAST(interaction_id AS BIGINT) % 900 AS STRING) AS interaction_id", "event_at_utc", "CAST(duration_seconds AS BIGINT) AS chars"))[0], "calls", """
WITH x AS (SELECT contact_id, CAST(CAST(interaction_id AS BIGINT) % 900 AS VARCHAR) AS interaction_id, event_at_utc, CAST(trunc(duration_seconds) AS BIGINT) AS chars FROM calls), f AS (SELECT * FROM x QUALIFY row_number() OVER (PARTITION BY contact_id, interaction_id ORDER BY event_at_utc, chars) = 1)
SELECT contact_id, count(*) AS interaction_count, CAST(sum(chars) AS BIGINT) AS total_transcript_chars, max(event_at_utc) AS last_interaction_at FROM f GROUP BY 1""")
register("aff09_engagement", lambda t: a.engagement(t.contacts), "contacts", "SELECT id, interaction_count + total_transcript_chars / 150.0::DOUBLE * 0.5::DOUBLE AS engagement_score, total_transcript_chars > 50000 OR interaction_count > 20 AS is_key_contact FROM contacts")

register("led01_claims_write_gate", lambda t: d.claims_write_gate(t.spans.where("NOT is_superseded"), t.attributions, t.projects, t.claims), "spans attributions projects claims", """
SELECT s.span_id, CASE WHEN char_end - char_start < 20 THEN 'transcript_too_short' WHEN p.status = 'closed' THEN 'project_closed' WHEN EXISTS (SELECT 1 FROM claims c WHERE c.source_span_id = s.span_id AND active) THEN 'already_extracted' ELSE 'write' END AS gate,
 coalesce(decision = 'assign' AND a.project_id IS NOT NULL, false) AS confirmed FROM spans s LEFT JOIN attributions a USING (span_id) LEFT JOIN projects p ON p.id = a.project_id WHERE NOT is_superseded""")
register("led02_insert_claims_dedup", lambda t: d.insert_claims_dedup(t.claims.where("warrant_level = 'high'"), t.claims.where("warrant_level = 'low'")).select("id", "call_id", "claim_type", "claim_text", "project_id"), "claims", """
WITH n AS (SELECT * FROM claims WHERE warrant_level = 'low' QUALIFY row_number() OVER (PARTITION BY call_id, claim_type, claim_text, project_id ORDER BY created_at, id) = 1)
SELECT id, call_id, claim_type, claim_text, project_id FROM n WHERE NOT EXISTS (SELECT 1 FROM claims s WHERE s.warrant_level = 'high' AND active AND s.call_id = n.call_id AND s.claim_type = n.claim_type AND s.claim_text = n.claim_text AND s.project_id IS NOT DISTINCT FROM n.project_id)""")
register("led03_confirmation_state", lambda t: d.confirmation_state(t.claims).groupBy("claim_confirmation_state", "claim_type").agg(F.count("*").alias("n")), "claims", "SELECT CASE WHEN project_id IS NOT NULL AND attribution_decision = 'assign' THEN 'confirmed' ELSE 'unconfirmed' END AS claim_confirmation_state, claim_type, count(*) AS n FROM claims GROUP BY 1, 2")
register("led04_claim_type_maps", lambda t: t.claims.select(*(d.mapped_type(F.col("claim_type"), m).alias(m) for m in d.CLAIM_TYPES), "claim_type").groupBy("claim_type", *d.CLAIM_TYPES).agg(F.count("*").alias("n")), "claims", """
SELECT claim_type, CASE claim_type WHEN 'deadline' THEN 'event' WHEN 'blocker' THEN 'open_loop' ELSE claim_type END AS crosswalk, CASE claim_type WHEN 'deadline' THEN 'commitment' WHEN 'blocker' THEN 'risk' ELSE claim_type END AS promotion,
 CASE claim_type WHEN 'deadline' THEN 'commitment' WHEN 'blocker' THEN 'open_loop' ELSE claim_type END AS drift, count(*) AS n FROM claims GROUP BY ALL""")
CONTEXT = "SELECT DISTINCT id, CAST(length(claim_text) % 7 = 0 AS BOOLEAN) AS contradicted, CAST(length(claim_text) % 5 <> 0 AS BOOLEAN) AS in_candidates, CAST(length(id) % 6 = 0 AS BOOLEAN) AS multi_project FROM {c}"
LANES = f"""ctx AS ({CONTEXT.format(c="claims")}), lt AS (SELECT c.*, ctx.contradicted, ctx.in_candidates, ctx.multi_project, CASE claim_type WHEN 'deadline' THEN 'commitment' WHEN 'blocker' THEN 'risk' ELSE claim_type END AS lane_type FROM claims c JOIN ctx USING (id)),
mn AS (SELECT *, CASE lane_type WHEN 'decision' THEN 0.75 WHEN 'schedule' THEN 0.75 WHEN 'commitment' THEN 0.70 WHEN 'open_loop' THEN 0.65 WHEN 'risk' THEN 0.65 END::DOUBLE AS least FROM lt),
rs AS (SELECT id, project_id, run_id, claim_text, warrant_level, lane_type, CASE WHEN char_start IS NULL OR char_end IS NULL OR span_hash IS NULL OR pointer_type IS NULL OR char_start >= char_end THEN 'invalid_pointer' WHEN project_id IS NULL THEN 'null_project' WHEN contradicted THEN 'contradiction' WHEN NOT in_candidates THEN 'project_not_in_candidates'
 WHEN multi_project THEN 'multi_project_contact' WHEN testimony_type = 'reported' THEN 'reported_speech' WHEN least IS NULL THEN 'type_not_promotable' WHEN lane_type = 'schedule' AND warrant_level <> 'high' THEN 'schedule_not_anchored' WHEN attribution_confidence < least THEN 'low_confidence' ELSE 'all_gates_passed' END AS lane_reason FROM mn),
lanes AS (SELECT *, CASE WHEN lane_reason IN ('invalid_pointer', 'type_not_promotable') THEN 'STAGE' WHEN lane_reason = 'all_gates_passed' THEN 'PROMOTE' ELSE 'REVIEW' END AS lane FROM rs)"""


def _lanes(t):
    return d.decide_lane(t.claims, t.spark.sql(CONTEXT, c=t.claims))


register("led05_decide_lane", lambda t: _lanes(t), "claims", f"WITH {LANES} SELECT id, lane_type, lane, lane_reason FROM lanes")
register("led06_promote_claims", lambda t: d.promote_claims(t.claims.dropDuplicates(["id"]), _lanes(t).dropDuplicates(["id"]))["beliefs"].groupBy("belief_type", "warrant_level").agg(F.count("*").alias("n")), "claims", f"WITH {LANES} SELECT lane_type AS belief_type, warrant_level, count(DISTINCT id) AS n FROM lanes WHERE lane = 'PROMOTE' GROUP BY 1, 2")
register("led07_batch_promote", lambda t: d.batch_promote_high_signal(t.claims, t.claims.where("warrant_level = 'high'").select(F.col("id").alias("claim_id"))), "claims", """
SELECT id, project_id, CASE WHEN claim_type = 'decision' THEN 'decided' WHEN claim_type IN ('commitment', 'schedule', 'deadline') THEN 'promised' ELSE 'reported' END AS epistemic_status, attribution_confidence AS confidence, claim_text AS text
FROM claims WHERE active AND claim_type IN ('decision', 'commitment', 'deadline', 'schedule', 'blocker', 'risk') AND char_start IS NOT NULL AND id NOT IN (SELECT id FROM claims WHERE warrant_level = 'high')""")
JUDGE = "SELECT id AS target_id, 'new-' || id AS source_id, CASE length(claim_text) % 3 WHEN 0 THEN 'supersedes' WHEN 1 THEN 'corroborates' ELSE 'conflicts' END AS relationship FROM {c} WHERE warrant_level = 'low'"
register("led09_consolidation", lambda t: d.apply_consolidation(d.confirmation_state(t.claims), t.spark.sql(JUDGE, c=t.claims)), "claims", f"""
WITH j AS ({JUDGE.format(c="claims")}), p AS (SELECT target_id AS id, min(source_id) FILTER (WHERE relationship = 'supersedes') AS by_, bool_or(relationship = 'corroborates') AS more, bool_or(relationship = 'conflicts') AS conf FROM j GROUP BY 1),
f AS (SELECT c.*, by_, more, conf, NOT (project_id IS NOT NULL AND attribution_decision = 'assign') AS free FROM claims c LEFT JOIN p USING (id))
SELECT id, active AND NOT (free AND by_ IS NOT NULL) AS active, CASE WHEN free THEN by_ END AS superseded_by, CASE WHEN free AND more THEN 'high' ELSE warrant_level END AS warrant_level, coalesce(conf, false) AS in_conflict, NOT free AND by_ IS NOT NULL AS skipped_confirmed FROM f""")
VERDICTS = "SELECT DISTINCT id AS loop_id, length(id) % 2 = 0 AS resolved, CAST(length(id) % 5 AS DOUBLE) / 4 AS confidence, CASE WHEN loop_type = 'decision' THEN NULL ELSE 'said so in ' || call_id END AS evidence, max(created_at) OVER (PARTITION BY id) + INTERVAL 1 DAY AS judged_at FROM {l}"
register("led10_close_loops", lambda t: d.close_loops(t.loops, t.spark.sql(VERDICTS, l=t.loops)), "loops", f"""
WITH v AS ({VERDICTS.format(l="loops")}), b AS (SELECT * FROM v WHERE resolved AND confidence >= 0.75 AND evidence IS NOT NULL QUALIFY row_number() OVER (PARTITION BY loop_id ORDER BY confidence DESC, judged_at, evidence) = 1)
SELECT id, call_id, project_id, CASE WHEN status = 'open' AND evidence IS NOT NULL THEN 'closed' ELSE status END AS status, CASE WHEN status = 'open' AND evidence IS NOT NULL THEN judged_at END AS closed_at, CASE WHEN status = 'open' THEN evidence END AS closing_evidence FROM loops LEFT JOIN b ON b.loop_id = loops.id""")
register("led11_vector_search", lambda t: d.vector_search(t.embeddings.where("vec_id % 25 = 0").select(F.col("vec_id").alias("query_id"), "embedding"), t.embeddings.select(F.col("vec_id").alias("id"), "embedding"), 5, 0.9).withColumn("distance", F.round("distance", 4)), "", """
WITH d AS (SELECT q.vec_id AS query_id, c.vec_id AS id, round(1 - list_cosine_similarity(q.embedding::DOUBLE[], c.embedding::DOUBLE[]), 9) AS far FROM embeddings q JOIN embeddings c ON q.vec_id <> c.vec_id WHERE q.vec_id % 25 = 0)
SELECT query_id, id, round(far, 4) AS distance, CAST(row_number() OVER (PARTITION BY query_id ORDER BY far, id) AS INT) AS rank FROM d WHERE far <= 0.9 QUALIFY rank <= 5""")
register("led12_claim_search_text", lambda t: d.claim_search_text(t.claims), "claims", "SELECT id, 'claim_type: ' || claim_type || ' | claim_text: ' || lower(claim_text) || ' | warrant_level: ' || warrant_level || ' | testimony_type: ' || testimony_type AS search_text FROM claims")
register("led13_facts_known_as_of", lambda t: d.facts_known_as_of(t.interactions, t.facts, 5), "interactions facts", """
SELECT i.interaction_id, i.project_id, fact_id, fact_kind, as_of_at, CAST(row_number() OVER (PARTITION BY i.interaction_id, i.project_id ORDER BY as_of_at DESC, observed_at DESC, fact_id) AS INT) AS rank FROM interactions i JOIN facts f ON f.project_id = i.project_id AND as_of_at <= event_at_utc AND observed_at <= event_at_utc AND f.interaction_id <> i.interaction_id QUALIFY rank <= 5""")
register("led14_facts_time_relation", lambda t: d.facts_time_relation(t.facts, t.interactions), "facts interactions", "SELECT fact_id, interaction_id, CASE WHEN as_of_at <= event_at_utc AND observed_at <= event_at_utc THEN 'AS_OF' ELSE 'POST_HOC' END AS relation FROM facts JOIN interactions USING (interaction_id)")
register("led15_facts_window_counts", lambda t: d.facts_window_counts(t.interactions, t.facts), "interactions facts", """
SELECT i.interaction_id, count(*) FILTER (WHERE as_of_at <= event_at_utc AND as_of_at > event_at_utc - INTERVAL 90 DAY) AS in_window, count(*) FILTER (WHERE as_of_at <= event_at_utc - INTERVAL 90 DAY) AS before_window, count(*) FILTER (WHERE as_of_at > event_at_utc) AS post_hoc FROM interactions i JOIN facts f ON f.project_id = i.project_id GROUP BY 1""")
register("led16_facts_missing_provenance", lambda t: d.facts_missing_provenance(t.facts), "facts", "SELECT fact_id, project_id, fact_kind FROM facts WHERE source_char_start IS NULL")
register("led16_facts_by_kind", lambda t: d.facts_by_kind(t.facts), "facts", "SELECT fact_kind, count(*) AS n, count(DISTINCT project_id) AS projects, min(as_of_at) AS first, max(as_of_at) AS last FROM facts GROUP BY 1")
register("led24_claims_for_review", lambda t: d.claims_for_review(t.claims), "claims", "SELECT id, CASE WHEN char_start IS NULL THEN 'no_offsets' WHEN char_end - char_start < 5 THEN 'precise' WHEN char_end - char_start < 10 THEN 'wide' WHEN char_start <= 1 THEN 'blanket' ELSE 'broad' END AS pointer_quality, coalesce(char_end - char_start, -1) AS width, speaker_contact_id IS NULL AS missing_speaker FROM claims WHERE active")
register("led22_orphan_review_items", lambda t: d.orphan_review_items(t.review_queue, t.claims), "review_queue claims", "SELECT id, interaction_id, reason FROM review_queue q WHERE module = 'journal' AND reason <> 'conflict' AND NOT EXISTS (SELECT 1 FROM claims c WHERE c.source_span_id = q.span_id)")
register("led20_check_promotions", lambda t: d.check_promotions(t.claims.select(F.col("id").alias("claim_id"), "project_id"), t.claims, t.review_queue), "claims review_queue", """
SELECT id AS claim_id, project_id FROM claims b WHERE NOT EXISTS (SELECT 1 FROM claims c WHERE c.id = b.id AND pointer_type = 'transcript_span' AND char_start IS NOT NULL) AND NOT EXISTS (SELECT 1 FROM claims c JOIN review_queue q ON q.span_id = c.source_span_id WHERE c.id = b.id AND q.status = 'resolved')""")
register("led21_backfill_promotion_log", lambda t: d.backfill_promotion_log(t.claims.selectExpr("id AS claim_id", "CASE WHEN active THEN NULL ELSE 'own' END AS run_id").distinct(), t.claims.where("warrant_level = 'high'").selectExpr("id AS claim_id"), t.claims.dropDuplicates(["id"])), "claims", "SELECT DISTINCT id AS claim_id, CASE WHEN active THEN run_id ELSE 'own' END AS run_id, 'backfilled' AS event FROM claims WHERE id NOT IN (SELECT id FROM claims WHERE warrant_level = 'high')")
register("led23_evidence_write_once", lambda t: d.evidence_write_once(t.loops.selectExpr("id", "CASE WHEN status = 'open' THEN NULL ELSE loop_type END AS payload_ref"), t.loops.dropDuplicates(["id"]).selectExpr("id", "CASE WHEN length(id) % 2 = 0 THEN 'question' END AS payload_ref")), "loops", """
SELECT l.id, loop_type AS payload_ref, CASE WHEN length(l.id) % 2 = 0 THEN 'question' END AS new_ref FROM loops l WHERE status <> 'open' AND loop_type IS DISTINCT FROM CASE WHEN length(l.id) % 2 = 0 THEN 'question' END""")
register("led18_review_spans_missing_extraction", lambda t: d.review_spans_missing_extraction(t.attributions, t.review_queue, t.claims), "attributions review_queue claims", """
WITH a AS (SELECT * FROM attributions QUALIFY row_number() OVER (PARTITION BY span_id ORDER BY attributed_at DESC, attribution_id DESC) = 1)
SELECT span_id, project_id, confidence FROM a WHERE decision = 'review' AND confidence >= 0.7::DOUBLE AND project_id IS NOT NULL AND EXISTS (SELECT 1 FROM review_queue q WHERE q.span_id = a.span_id AND status = 'pending') AND NOT EXISTS (SELECT 1 FROM claims c WHERE c.source_span_id = a.span_id AND active)""")
register("led17_striking_rollup", lambda t: d.striking_rollup(t.striking.select("span_id", "striking_score", F.concat(F.lit("Loud  "), "signal", F.lit(" here")).alias("text"), F.array(F.struct(F.lit("error").alias("type"), F.lit(0.5).alias("confidence"), F.concat(F.lit("LOUD "), "signal").alias("quote")), F.struct(F.lit("tone").alias("type"), F.lit(0.9).alias("confidence"), F.lit("error here").alias("quote")), F.struct(F.lit("odd").alias("type"), F.lit(1.0).alias("confidence"), F.lit("here").alias("quote"))).alias("signals")), ("error", "tone")), "striking", "SELECT span_id, greatest(0.0::DOUBLE, least(1.0::DOUBLE, striking_score)) AS score, CASE WHEN signal = 'error' THEN 2 ELSE 1 END AS n_signals, CASE WHEN signal = 'error' THEN 'tone' ELSE 'error' END AS primary_signal FROM striking")
register("led08_belief_snapshot", lambda t: d.belief_snapshot(t.claims, t.loops, at("2000-01-01")), "claims loops", """
WITH c AS (SELECT *, CAST(row_number() OVER (PARTITION BY project_id ORDER BY epoch(created_at) / 1e9::DOUBLE * coalesce(attribution_confidence, 0.5::DOUBLE) * CASE WHEN warrant_level = 'high' THEN 1.5::DOUBLE ELSE 1 END DESC, id) AS INT) AS rank FROM claims WHERE active AND project_id IS NOT NULL AND created_at <= TIMESTAMP '2000-01-01' QUALIFY rank <= 20),
j AS (SELECT *, to_json(struct_pack(rank := rank, id := id, claim_type := claim_type, claim_text := claim_text)) AS j FROM c), k AS (SELECT *, sum(length(CAST(j AS VARCHAR)) + 1) OVER (PARTITION BY project_id ORDER BY rank) AS n FROM j QUALIFY n <= 6000),
a AS (SELECT project_id, count(*) AS n_claims, string_agg(CAST(j AS VARCHAR), ',' ORDER BY rank) AS claims FROM k GROUP BY 1),
o AS (SELECT *, CAST(row_number() OVER (PARTITION BY project_id ORDER BY created_at, id) AS INT) AS rank FROM loops WHERE status = 'open' AND created_at <= TIMESTAMP '2000-01-01' QUALIFY rank <= 10),
p AS (SELECT project_id, string_agg(CAST(to_json(struct_pack(rank := rank, id := id, loop_type := loop_type)) AS VARCHAR), ',' ORDER BY rank) AS loops FROM o GROUP BY 1)
SELECT project_id, CAST(n_claims AS INT) AS n_claims, chr(123) || '"claims":[' || claims || ']' || coalesce(',"open_loops":[' || loops || ']', '') || chr(125) AS snapshot FROM a LEFT JOIN p USING (project_id)""")
