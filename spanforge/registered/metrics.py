"""Queries of the gates, coverage, drift and digest operators."""

from ..operators import metrics as m
from . import register

DAY = "2000-01-01"

register("met01_gate_multi_span", lambda t: m.gate_multi_span(t.interactions, t.spans), "interactions spans", """
SELECT i.interaction_id, transcript_chars, count(s.span_id) AS n_spans FROM interactions i LEFT JOIN spans s ON s.interaction_id = i.interaction_id AND NOT is_superseded
WHERE transcript_chars > 2000 GROUP BY ALL HAVING count(s.span_id) <= 1""")
register("met02_gate_no_gap", lambda t: m.gate_no_gap(t.spans), "spans", """
SELECT interaction_id, span_index, char_start, prev_end FROM (SELECT *, lag(char_end) OVER (PARTITION BY interaction_id ORDER BY span_index) AS prev_end FROM spans WHERE NOT is_superseded) WHERE char_start <> prev_end""")
register("met03_gate_no_uncovered", lambda t: m.gate_no_uncovered(t.spans, t.attributions.where("decision <> 'none'"), t.review_queue), "spans attributions review_queue", """
SELECT interaction_id, span_id FROM spans s WHERE NOT is_superseded AND NOT EXISTS (SELECT 1 FROM attributions a WHERE a.span_id = s.span_id AND decision <> 'none')
AND NOT EXISTS (SELECT 1 FROM review_queue q WHERE q.span_id = s.span_id AND status IN ('open', 'pending'))""")
register("met04_gate_no_double_covered", lambda t: m.gate_no_double_covered(t.spans, t.attributions, t.review_queue), "spans attributions review_queue", """
SELECT interaction_id, span_id FROM spans s WHERE NOT is_superseded AND EXISTS (SELECT 1 FROM attributions a WHERE a.span_id = s.span_id AND decision = 'assign' AND NOT needs_review)
AND EXISTS (SELECT 1 FROM review_queue q WHERE q.span_id = s.span_id AND status = 'pending')""")
register("met05_run_gates", lambda t: m.run_gates({"multi_span": m.gate_multi_span(t.interactions, t.spans), "no_gap": m.gate_no_gap(t.spans)}), "interactions spans", """
WITH a AS (SELECT i.interaction_id FROM interactions i LEFT JOIN spans s ON s.interaction_id = i.interaction_id AND NOT is_superseded WHERE transcript_chars > 2000 GROUP BY 1 HAVING count(s.span_id) <= 1),
b AS (SELECT interaction_id FROM (SELECT *, lag(char_end) OVER (PARTITION BY interaction_id ORDER BY span_index) AS e FROM spans WHERE NOT is_superseded) WHERE char_start <> e),
u AS (SELECT 'multi_span' AS gate, interaction_id FROM a UNION ALL SELECT 'no_gap', interaction_id FROM b)
SELECT g.gate, CASE WHEN count(u.interaction_id) = 0 THEN 'PASS' ELSE 'FAIL' END AS status, count(u.interaction_id) AS violations,
 coalesce((SELECT string_agg(x, ',' ORDER BY x) FROM (SELECT DISTINCT v.interaction_id AS x FROM u v WHERE v.gate = g.gate ORDER BY 1 LIMIT 20)), '') AS sample
FROM (VALUES ('multi_span'), ('no_gap')) g(gate) LEFT JOIN u ON u.gate = g.gate GROUP BY g.gate""")
VERDICT = """
live AS (SELECT interaction_id, span_id, EXISTS (SELECT 1 FROM attributions a WHERE a.span_id = s.span_id) AS done, EXISTS (SELECT 1 FROM review_queue q WHERE q.span_id = s.span_id AND status = 'pending') AS waits,
 EXISTS (SELECT 1 FROM attributions a WHERE a.span_id = s.span_id AND needs_review) AS asks FROM spans s WHERE NOT is_superseded),
per AS (SELECT interaction_id, count(*) AS active, count(*) FILTER (WHERE NOT done AND NOT waits) AS uncovered, count(*) FILTER (WHERE asks AND NOT waits) AS gaps FROM live GROUP BY 1),
old AS (SELECT q.interaction_id, count(*) AS n FROM review_queue q JOIN spans s ON s.span_id = q.span_id WHERE status = 'pending' AND is_superseded GROUP BY 1),
bare AS (SELECT interaction_id, count(*) AS n FROM review_queue WHERE status = 'pending' AND span_id IS NULL GROUP BY 1),
verdicts AS (SELECT i.interaction_id, CASE WHEN coalesce(transcript_chars, 0) = 0 AND coalesce(active, 0) = 0 THEN 'PASS_EMPTY_TRANSCRIPT_TERMINAL' WHEN coalesce(active, 0) = 0 THEN 'FAIL_NO_ACTIVE_SPANS' WHEN uncovered > 0 THEN 'FAIL_UNCOVERED'
 WHEN old.n > 0 THEN 'FAIL_PENDING_SUPERSEDED' WHEN bare.n > 0 THEN 'FAIL_PENDING_NULL_SPAN' WHEN gaps > 0 THEN 'FAIL_REVIEW_GAP' ELSE 'PASS' END AS verdict
 FROM interactions i LEFT JOIN per USING (interaction_id) LEFT JOIN old USING (interaction_id) LEFT JOIN bare USING (interaction_id))
"""
register("met06_interaction_verdict", lambda t: m.interaction_verdict(t.interactions, t.spans, t.attributions, t.review_queue), "interactions spans attributions review_queue", f"WITH {VERDICT} SELECT * FROM verdicts")
register("met08_daily_digest", lambda t: m.daily_digest(t.interactions, t.spans, t.review_queue, m.interaction_verdict(t.interactions, t.spans, t.attributions, t.review_queue)), "interactions spans attributions review_queue", f"""WITH {VERDICT},
r AS (SELECT interaction_id, count(*) AS n FROM review_queue GROUP BY 1), s AS (SELECT interaction_id, count(*) FILTER (WHERE NOT is_superseded) AS n, count(*) FILTER (WHERE is_superseded) AS again FROM spans GROUP BY 1)
SELECT CAST(event_at_utc AS DATE) AS day, count(*) AS calls, round(100.0::DOUBLE * count(*) FILTER (WHERE verdict LIKE 'PASS%') / count(*), 2) AS pass_pct, round(sum(coalesce(r.n, 0)) / count(*), 3) AS reviews_per_call,
 CAST(sum(coalesce(s.n, 0)) AS BIGINT) AS spans, CAST(sum(coalesce(again, 0)) AS BIGINT) AS reseeded
FROM interactions i JOIN verdicts USING (interaction_id) LEFT JOIN r USING (interaction_id) LEFT JOIN s USING (interaction_id) GROUP BY 1""")
register("met09_pipeline_drift", lambda t: m.pipeline_drift(t.spans, t.attributions.where("decision <> 'none'"), t.review_queue), "spans attributions review_queue", """
WITH p AS (SELECT q.*, s.is_superseded, s.span_id AS sid FROM review_queue q LEFT JOIN spans s USING (span_id) WHERE status = 'pending'), l AS (SELECT * FROM spans WHERE NOT is_superseded),
r AS (SELECT (SELECT count(*) FROM p) AS pending_total, (SELECT count(*) FROM p WHERE span_id IS NULL) AS pending_null_span, (SELECT count(*) FROM p WHERE is_superseded) AS pending_superseded, (SELECT count(*) FROM p WHERE span_id IS NOT NULL AND sid IS NULL) AS pending_missing_span,
 (SELECT count(*) FROM p WHERE reason = 'model_error') AS model_errors, (SELECT count(*) FROM l WHERE word_count >= 2000) AS oversize_spans, (SELECT count(*) FROM l WHERE NOT EXISTS (SELECT 1 FROM attributions a WHERE a.span_id = l.span_id AND decision <> 'none')) AS missing_attribution)
SELECT metric, CAST(value AS DOUBLE) AS value FROM (UNPIVOT r ON COLUMNS(*) INTO NAME metric VALUE value)""")
register("met09_reasons_by_module", lambda t: m.reasons_by_module(t.review_queue), "review_queue", "SELECT module, reason, count(*) AS n, CAST(sum(hit_count) AS BIGINT) AS hits FROM review_queue WHERE status = 'pending' GROUP BY ALL")
register("met11_coverage", lambda t: m.coverage(t.spans, t.attributions.where("decision = 'assign'"), t.review_queue, DAY, 365), "spans attributions review_queue", f"""
WITH l AS (SELECT CASE WHEN EXISTS (SELECT 1 FROM attributions a WHERE a.span_id = s.span_id AND decision = 'assign') THEN 'attributed' WHEN EXISTS (SELECT 1 FROM review_queue q WHERE q.span_id = s.span_id AND status IN ('open', 'pending')) THEN 'review_only' ELSE 'uncovered' END AS coverage
 FROM spans s WHERE NOT is_superseded AND created_at > TIMESTAMP '{DAY}' - INTERVAL 365 DAY AND created_at <= TIMESTAMP '{DAY}')
SELECT coverage, count(*) AS n, round(100.0::DOUBLE * count(*) / sum(count(*)) OVER (), 2) AS pct FROM l GROUP BY coverage""")
register("met12_oversize_spans", lambda t: m.oversize_spans(t.spans), "spans", "SELECT span_id, interaction_id, char_end - char_start AS chars, word_count FROM spans WHERE NOT is_superseded AND (char_end - char_start >= 12000 OR word_count >= 2000)")
register("met13_closed_project_attributions", lambda t: m.closed_project_attributions(t.attributions, t.projects), "attributions projects", "SELECT phase, status, count(*) AS n, count(DISTINCT interaction_id) AS calls FROM attributions a JOIN projects p ON p.id = a.project_id WHERE status = 'closed' AND decision = 'assign' GROUP BY ALL")
register("met14_call_span_parity", lambda t: m.call_span_parity(t.interactions, t.spans), "interactions spans", """
WITH n AS (SELECT interaction_id, count(*) FILTER (WHERE NOT is_superseded) AS live, count(*) FILTER (WHERE is_superseded) AS old FROM spans GROUP BY 1), j AS (SELECT i.transcript_chars, live, old FROM interactions i FULL JOIN n USING (interaction_id)),
r AS (SELECT count(transcript_chars) AS calls, count(*) FILTER (WHERE transcript_chars IS NOT NULL AND live > 0) AS calls_with_spans, count(*) FILTER (WHERE transcript_chars IS NOT NULL AND live IS NULL) AS calls_without_spans,
 count(*) FILTER (WHERE transcript_chars IS NULL) AS span_sets_without_call, CAST(sum(live) AS BIGINT) AS active_spans, CAST(sum(old) AS BIGINT) AS superseded_spans FROM j)
SELECT metric, CAST(value AS DOUBLE) AS value FROM (UNPIVOT r ON COLUMNS(*) INTO NAME metric VALUE value)""")
register("met37_null_offsets", lambda t: m.null_offsets(t.spans), "spans", "SELECT interaction_id, count(*) AS spans, count(*) FILTER (WHERE char_start IS NULL OR char_end IS NULL) AS null_offsets FROM spans GROUP BY 1")
register("met18_audit_pass_rate", lambda t: m.audit_pass_rate(t.event_audit), "event_audit", """SELECT CAST(received_at_utc AS DATE) AS day, count(*) AS events, count(*) FILTER (WHERE gate_status = 'pass') AS passed, count(*) FILTER (WHERE gate_status = 'fail') AS failed,
 count(*) FILTER (WHERE gate_status = 'needs_human') AS needs_human, round(100.0::DOUBLE * count(*) FILTER (WHERE gate_status = 'pass') / count(*), 2) AS pass_pct FROM event_audit GROUP BY 1""")
register("met18_lineage_coverage", lambda t: m.lineage_coverage(t.event_audit), "event_audit", "SELECT CAST(received_at_utc AS DATE) AS day, count(*) AS events, count(source_run_id) AS with_lineage, round(100.0::DOUBLE * count(source_run_id) / count(*), 2) AS lineage_pct FROM event_audit GROUP BY 1")
register("met18_human_queue", lambda t: m.human_queue(t.event_audit), "event_audit", "SELECT id, interaction_id, gate_reason, received_at_utc FROM event_audit WHERE triage_action = 'queue_human'")
register("met18_reason_breakdown", lambda t: m.reason_breakdown(t.event_audit, "2024-01-15"), "event_audit", "SELECT gate_reason, count(*) AS n, count(*) FILTER (WHERE received_at_utc > TIMESTAMP '2024-01-14' AND received_at_utc <= TIMESTAMP '2024-01-15') AS last_24h FROM event_audit WHERE gate_reason IS NOT NULL GROUP BY 1")
register("met19_attribution_confidence", lambda t: m.attribution_confidence(t.interactions), "interactions", """SELECT CASE WHEN project_attribution_confidence IS NULL THEN 'unprocessed' WHEN project_attribution_confidence >= 0.8 THEN 'high' WHEN project_attribution_confidence >= 0.5 THEN 'medium' ELSE 'low' END AS band,
 count(*) AS n, round(100.0::DOUBLE * count(*) / sum(count(*)) OVER (), 2) AS pct FROM interactions GROUP BY 1""")
register("met19_needs_review", lambda t: m.needs_review_share(t.interactions), "interactions", "SELECT needs_review, count(*) AS n, round(100.0::DOUBLE * count(*) / sum(count(*)) OVER (), 2) AS pct FROM interactions GROUP BY 1")
register("met20_candidate_coverage", lambda t: m.candidate_coverage(t.affinity, t.contacts), "affinity contacts", """WITH e AS (SELECT contact_id, count(DISTINCT project_id) AS projects, count(*) FILTER (WHERE weight >= 0.5) AS strong FROM affinity GROUP BY 1)
SELECT contact_type, count(*) AS contacts, count(projects) AS with_candidates, CAST(coalesce(sum(strong), 0) AS BIGINT) AS strong_edges FROM contacts LEFT JOIN e ON e.contact_id = contacts.id GROUP BY 1""")
register("met20_override_rate", lambda t: m.override_rate(t.overrides), "overrides", "SELECT CAST(created_at AS DATE) AS day, count(*) AS n, count(*) FILTER (WHERE action = 'reject') AS rejected, round(100.0::DOUBLE * count(*) FILTER (WHERE action = 'reject') / count(*), 2) AS reject_pct FROM overrides GROUP BY 1")
TIER = """b AS (SELECT interaction_id, CASE WHEN contact_name IS NOT NULL AND project_id IS NOT NULL THEN 'tier1_name_and_project' WHEN contact_name IS NOT NULL THEN 'tier2_name' WHEN project_id IS NOT NULL THEN 'tier3_project' ELSE 'tier4_nothing' END AS tier, transcript_chars FROM interactions WHERE contact_phone IS NULL)"""
register("met21_phone_backlog", lambda t: m.phone_backlog(t.interactions), "interactions", f"WITH {TIER} SELECT * FROM b")
register("met21_backlog_summary", lambda t: m.backlog_summary(m.phone_backlog(t.interactions)), "interactions", f"WITH {TIER} SELECT tier, count(*) AS n, CAST(sum(transcript_chars) AS BIGINT) AS chars FROM b GROUP BY tier UNION ALL SELECT 'TOTAL', count(*), CAST(sum(transcript_chars) AS BIGINT) FROM b")
PARITY = """p AS (SELECT regexp_replace(c.interaction_id, '^cll_(TEST_)?', '') AS interaction_id, other_party_phone AS raw_phone FROM calls_raw c),
v AS (SELECT p.interaction_id, raw_phone, contact_phone, CASE WHEN raw_phone IS NULL AND contact_phone IS NULL THEN 'FAIL_MISSING_PHONE' WHEN raw_phone IS NULL OR contact_phone IS NULL THEN 'WARN' WHEN raw_phone <> contact_phone THEN 'FAIL_DRIFT' ELSE 'PASS' END AS parity FROM p LEFT JOIN interactions i USING (interaction_id))"""
register("met22_phone_parity", lambda t: m.phone_parity(t.calls_raw, t.interactions), "calls_raw interactions", f"WITH {PARITY} SELECT * FROM v")
register("met22_parity_summary", lambda t: m.parity_summary(m.phone_parity(t.calls_raw, t.interactions)), "calls_raw interactions", f"WITH {PARITY} SELECT parity, count(*) AS n, round(100.0::DOUBLE * count(*) / sum(count(*)) OVER (), 2) AS pct FROM v GROUP BY 1")
register("met23_daily_ops_dashboard", lambda t: m.daily_ops_dashboard(t.interactions, t.review_queue, t.event_audit), "interactions review_queue event_audit", """
WITH r AS (SELECT (SELECT count(*) FROM interactions) AS interactions, (SELECT count(*) FROM interactions WHERE needs_review) AS needs_review, (SELECT count(*) FROM interactions WHERE contact_phone IS NULL) AS missing_phone, (SELECT count(*) FROM review_queue WHERE status = 'pending') AS pending_reviews,
 (SELECT count(*) FROM event_audit WHERE gate_status = 'fail') AS failed_events, (SELECT count(source_run_id) FROM event_audit) AS events_with_lineage)
SELECT metric, CAST(value AS DOUBLE) AS value FROM (UNPIVOT r ON COLUMNS(*) INTO NAME metric VALUE value)""")
register("met24_drift_distribution", lambda t: m.drift_distribution(t.claims, "claim_type"), "claims", "SELECT claim_type AS value, count(*) AS n, round(100.0::DOUBLE * count(*) / sum(count(*)) OVER (), 2) AS pct FROM claims GROUP BY 1")
register("met25_drift_violations", lambda t: m.drift_violations(t.claims, "claim_type", ["decision", "commitment", "question", "fact"]), "claims", "SELECT claim_type AS value, count(*) AS n FROM claims WHERE claim_type NOT IN ('decision', 'commitment', 'question', 'fact') GROUP BY 1")
register("met25_drift_new_values", lambda t: m.drift_new_values(t.claims, "claim_text", "created_at", DAY, 300), "claims", f"SELECT claim_text AS value, min(created_at) AS first_seen, count(*) AS n FROM claims WHERE created_at <= TIMESTAMP '{DAY}' GROUP BY 1 HAVING min(created_at) > TIMESTAMP '{DAY}' - INTERVAL 300 DAY")
register("met25_drift_case_variants", lambda t: m.drift_case_variants(t.texts.selectExpr("regexp_extract(text, '^([A-Za-z]+)', 1) AS word").where("word <> ''"), "word"), "texts", """SELECT lower(word) AS folded, count(DISTINCT word) AS variants, array_to_string(list_sort(list(DISTINCT word)), '|') AS spellings, count(*) AS n
FROM (SELECT regexp_extract(text, '^([A-Za-z]+)', 1) AS word FROM texts) WHERE word <> '' GROUP BY 1 HAVING count(DISTINCT word) > 1""")
register("met26_drift_dashboard", lambda t: m.drift_dashboard(t.claims, {"claim_type": (5, 10), "claim_text": (10, 50), "run_id": (500, 600)}), "claims", """
WITH c AS (SELECT 'claim_type' AS metric, count(DISTINCT claim_type) AS v, 5 AS a, 10 AS b FROM claims UNION ALL SELECT 'claim_text', count(DISTINCT claim_text), 10, 50 FROM claims UNION ALL SELECT 'run_id', count(DISTINCT run_id), 500, 600 FROM claims)
SELECT metric, v AS distinct_values, CASE WHEN v <= a THEN 'GREEN' WHEN v <= b THEN 'YELLOW' ELSE 'RED' END AS health, CASE WHEN v <= a THEN 100 WHEN v <= b THEN 50 ELSE 0 END AS score FROM c""")
register("met26_drift_snapshot", lambda t: m.drift_snapshot(t.claims, ["claim_type", "claim_text", "run_id"], DAY), "claims", f"""
WITH c AS (SELECT 'claim_type' AS field, count(DISTINCT claim_type) AS v FROM claims UNION ALL SELECT 'claim_text', count(DISTINCT claim_text) FROM claims UNION ALL SELECT 'run_id', count(DISTINCT run_id) FROM claims)
SELECT DATE '{DAY}' AS day, field, v AS distinct_values, CASE WHEN v <= 15 THEN 'GREEN' WHEN v <= 80 THEN 'YELLOW' WHEN v <= 500 THEN 'ORANGE' ELSE 'RED' END AS health FROM c""")
register("met27_project_feed", lambda t: m.project_feed(t.projects, t.interactions, t.claims, t.loops, t.striking, t.review_queue, "2000-06-01"), "projects interactions claims loops striking review_queue", """
WITH i AS (SELECT project_id, count(*) AS calls, count(*) FILTER (WHERE event_at_utc > TIMESTAMP '2000-05-25' AND event_at_utc <= TIMESTAMP '2000-06-01') AS calls_7d, max(event_at_utc) AS last_call FROM interactions GROUP BY 1),
c AS (SELECT project_id, count(*) AS claims, count(*) FILTER (WHERE created_at > TIMESTAMP '2000-05-25' AND created_at <= TIMESTAMP '2000-06-01') AS claims_7d FROM claims WHERE active GROUP BY 1),
l AS (SELECT project_id, count(*) FILTER (WHERE status = 'open') AS open_loops FROM loops GROUP BY 1),
s AS (SELECT project_id, count(*) AS signals, count(*) FILTER (WHERE created_at > TIMESTAMP '2000-05-25' AND created_at <= TIMESTAMP '2000-06-01') AS signals_7d FROM striking GROUP BY 1),
q AS (SELECT project_id, count(*) AS pending_reviews FROM review_queue WHERE status = 'pending' GROUP BY 1),
f AS (SELECT p.id AS project_id, name, status, coalesce(calls, 0) AS calls, coalesce(calls_7d, 0) AS calls_7d, coalesce(claims, 0) AS claims, coalesce(claims_7d, 0) AS claims_7d, coalesce(open_loops, 0) AS open_loops, coalesce(signals, 0) AS signals, coalesce(signals_7d, 0) AS signals_7d, coalesce(pending_reviews, 0) AS pending_reviews, last_call
 FROM projects p LEFT JOIN i ON i.project_id = p.id LEFT JOIN c ON c.project_id = p.id LEFT JOIN l ON l.project_id = p.id LEFT JOIN s ON s.project_id = p.id LEFT JOIN q ON q.project_id = p.id)
SELECT *, CASE WHEN open_loops >= 5 THEN 'high_open_loops' WHEN signals_7d >= 3 THEN 'elevated_striking' WHEN last_call IS NULL OR last_call < TIMESTAMP '2000-05-18' THEN 'stale' ELSE 'ok' END AS risk FROM f""")
register("met28_primary_project", lambda t: m.primary_project(t.interactions, t.attributions), "interactions attributions", """
WITH c AS (SELECT interaction_id, project_id, count(*) AS n, count(attribution_lock) AS locks, max(attributed_at) AS last FROM attributions WHERE decision = 'assign' AND project_id IS NOT NULL GROUP BY 1, 2),
b AS (SELECT * FROM c QUALIFY row_number() OVER (PARTITION BY interaction_id ORDER BY n DESC, last DESC, project_id) = 1)
SELECT i.interaction_id, coalesce(i.project_id, b.project_id) AS primary_project, CASE WHEN i.project_id IS NOT NULL THEN 'call' WHEN b.project_id IS NOT NULL THEN 'spans' ELSE 'none' END AS basis, coalesce(locks, 0) AS locks FROM interactions i LEFT JOIN b USING (interaction_id)""")
register("met28_best_applied_project", lambda t: m.best_applied_project(t.attributions), "attributions", "SELECT interaction_id, project_id, confidence FROM attributions WHERE decision = 'assign' AND project_id IS NOT NULL QUALIFY row_number() OVER (PARTITION BY interaction_id ORDER BY confidence DESC, attributed_at DESC, attribution_id) = 1")
register("met29_projects_with_phase", lambda t: m.projects_with_phase(t.projects, t.interactions, t.claims), "projects interactions claims", "SELECT id AS project_id, name, phase, status, (SELECT count(*) FROM interactions i WHERE i.project_id = p.id) AS calls, (SELECT count(*) FROM claims c WHERE c.project_id = p.id AND active) AS claims FROM projects p")
register("met30_morning_manifest", lambda t: m.morning_manifest(t.review_queue, t.interactions, t.contacts), "review_queue interactions contacts", "SELECT q.id, q.interaction_id, module, reason, q.created_at AS due_at, channel, event_at_utc, c.name AS contact, is_internal FROM review_queue q JOIN interactions i USING (interaction_id) LEFT JOIN contacts c ON c.id = i.contact_id WHERE status = 'pending'")
register("met38_invalid_keyword_json", lambda t: m.invalid_keyword_json(t.events.selectExpr("event_id", "CASE WHEN event_id % 3 = 0 THEN '[' || props || ']' WHEN event_id % 3 = 1 THEN props ELSE '[oops' END AS keywords"), "keywords"), "", "SELECT event_id, CASE WHEN event_id % 3 = 1 THEN props ELSE '[oops' END AS keywords FROM events WHERE event_id % 3 <> 0")
register("met36_non_postable_codes", lambda t: m.non_postable_codes(t.lineitem.selectExpr("CAST(l_partkey % 300 AS STRING) AS code"), t.part.selectExpr("CAST(p_partkey AS STRING) AS code", "CASE WHEN p_partkey % 4 = 0 THEN 'DIVISION' ELSE 'COST_CODE' END AS code_type")), "", "SELECT CAST(l_partkey % 300 AS VARCHAR) AS code, count(*) AS n FROM lineitem WHERE CAST(l_partkey % 300 AS VARCHAR) NOT IN (SELECT CAST(p_partkey AS VARCHAR) FROM part WHERE p_partkey % 4 <> 0) GROUP BY 1")
