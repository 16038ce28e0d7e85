"""Queries of the ingest operators."""

from pyspark.sql import functions as F

from ..sources import ingest as i
from . import register

PHONE = "coalesce(nullif(trim(json_extract_string(raw_snapshot_json, '$.signal.contact.phone')), ''), nullif(trim(json_extract_string(raw_snapshot_json, '$.signal.phone')), ''), nullif(trim(json_extract_string(raw_snapshot_json, '$.phone')), ''))"

register("src01_ingest_call_events", lambda t: i.ingest_call_events(t.calls_raw.unionByName(t.calls_raw.where("pipeline_version = 'v3'")), t.calls_raw.where("is_shadow")), "calls_raw", f"""
WITH p AS (SELECT * FROM calls_raw UNION ALL SELECT * FROM calls_raw WHERE pipeline_version = 'v3'), n AS (SELECT *, row_number() OVER (PARTITION BY interaction_id ORDER BY ingested_at_utc) > 1 OR is_shadow AS again, {PHONE} AS phone FROM p),
f AS (SELECT *, coalesce(regexp_matches(phone, '^\\+[0-9]{{10,15}}$'), false) AS fine FROM n)
SELECT interaction_id, phone, CASE WHEN again THEN 'fail' WHEN NOT fine THEN 'needs_human' ELSE 'pass' END AS gate_status, CASE WHEN again THEN 'reject' WHEN NOT fine THEN 'queue_human' ELSE 'auto_persist' END AS triage_action,
 concat_ws(',', CASE WHEN again THEN 'i2_duplicate' END, CASE WHEN NOT fine THEN 'i1_phone_invalid' END, CASE WHEN zap_id IS NULL THEN 'lineage_missing_warning' END) AS gate_reasons, sha256(raw_snapshot_json) AS payload_sha256, ingested_at_utc AS received_at_utc FROM f""")
register("src03_resolve_party_phones", lambda t: i.resolve_party_phones(t.calls_raw), "calls_raw", f"""
WITH d AS (SELECT *, CASE WHEN lower(trim(direction)) = 'inbound' THEN 'inbound' WHEN lower(trim(direction)) = 'outgoing' THEN 'outbound' ELSE 'unknown' END AS side, {PHONE} AS raw FROM calls_raw)
SELECT interaction_id, side AS direction, nullif(owner_phone, '') AS owner_phone, CASE side WHEN 'outbound' THEN coalesce(nullif(other_party_phone, ''), raw) WHEN 'inbound' THEN coalesce(raw, nullif(other_party_phone, '')) ELSE nullif(other_party_phone, '') END AS other_party_phone FROM d""")
register("src04_intake_gate", lambda t: i.intake_gate(t.calls_raw), "calls_raw", """
SELECT interaction_id, concat_ws(',', CASE WHEN length(trim(transcript)) < 10 THEN 'G4_EMPTY_TRANSCRIPT' END, CASE WHEN event_at_utc IS NULL THEN 'G4_TIMESTAMP_MISSING' END) AS codes,
 CASE WHEN length(trim(transcript)) < 10 OR event_at_utc IS NULL THEN 'NEEDS_REVIEW' ELSE 'PASS' END AS gate, length(trim(transcript)) < 10 AS terminal_empty FROM calls_raw""")
register("src05_merge_never_regress", lambda t: i.merge_never_regress(t.calls_raw.where("NOT is_shadow").selectExpr("interaction_id", "owner_phone", "other_party_name"), t.calls_raw.where("pipeline_version = 'v4'").selectExpr("interaction_id", "CASE WHEN zap_id IS NULL THEN '' ELSE '+1999' END AS owner_phone", "CAST(NULL AS STRING) AS other_party_name"), "interaction_id", ["owner_phone", "other_party_name"]), "calls_raw", """
WITH o AS (SELECT * FROM calls_raw WHERE NOT is_shadow), n AS (SELECT interaction_id, CASE WHEN zap_id IS NULL THEN '' ELSE '+1999' END AS p FROM calls_raw WHERE pipeline_version = 'v4')
SELECT coalesce(o.interaction_id, n.interaction_id) AS interaction_id, coalesce(nullif(n.p, ''), o.owner_phone) AS owner_phone, o.other_party_name FROM o FULL JOIN n ON o.interaction_id = n.interaction_id""")
REPAIR = "SELECT interaction_id, '+1888' AS phone, CASE WHEN pipeline_version = 'v3' THEN 'a longer transcript text' ELSE 'short' END AS transcript, CASE WHEN zap_id IS NULL THEN 'a summary' END AS summary FROM calls_raw WHERE other_party_name IS NULL"
register("src06_apply_repairs", lambda t: i.apply_repairs(t.calls_raw.selectExpr("interaction_id", "other_party_phone AS phone", "transcript", "zap_id AS summary"), t.spark.sql(REPAIR.replace("calls_raw", "{c}"), c=t.calls_raw)), "calls_raw", f"""
WITH r AS ({REPAIR}), b AS (SELECT c.interaction_id, c.other_party_phone AS p, c.transcript AS t, c.zap_id AS s, coalesce(c.other_party_phone, r.phone) AS phone, CASE WHEN length(r.transcript) > 10 THEN r.transcript ELSE c.transcript END AS transcript, CASE WHEN length(r.summary) > 5 THEN r.summary ELSE c.zap_id END AS summary FROM calls_raw c LEFT JOIN r USING (interaction_id))
SELECT interaction_id, phone, transcript, summary, CAST(phone IS DISTINCT FROM p AS INT) + CAST(transcript IS DISTINCT FROM t AS INT) + CAST(summary IS DISTINCT FROM s AS INT) AS fields_changed FROM b""")
register("src07_validate_repairs", lambda t: i.validate_repairs(t.calls_raw.selectExpr("regexp_replace(interaction_id, '^cll_(TEST_)?', '') AS interaction_id", "other_party_phone AS phone", "transcript"), t.interactions), "calls_raw interactions", """
WITH c AS (SELECT regexp_replace(interaction_id, '^cll_(TEST_)?', '') AS interaction_id, other_party_phone AS phone, transcript FROM calls_raw),
v AS (SELECT c.interaction_id, concat_ws(',', CASE WHEN phone IS NULL THEN 'phone_null' END, CASE WHEN length(transcript) <= 10 THEN 'transcript_short' END, CASE WHEN phone IS NOT NULL AND phone IS DISTINCT FROM contact_phone THEN 'phone_not_synced' END) AS issues FROM c LEFT JOIN interactions i USING (interaction_id)) SELECT * FROM v WHERE issues <> ''""")
register("src08_latest_per_key", lambda t: i.latest_per_key(t.attributions.select("span_id", "attribution_id", "attributed_at", "confidence"), ["span_id"], ["attributed_at", "confidence", "attribution_id"]), "attributions", "SELECT span_id, attribution_id, attributed_at, confidence FROM attributions QUALIFY row_number() OVER (PARTITION BY span_id ORDER BY attributed_at DESC NULLS LAST, confidence DESC NULLS LAST, attribution_id DESC NULLS LAST) = 1")
VARIANT = "SELECT CAST(event_id AS STRING) AS row_id, CAST(user_id AS STRING) AS interaction_id, CASE WHEN event_id % 2 = 0 THEN 'e1' ELSE 'e2' END AS engine, CASE event_type WHEN 'click' THEN 'final' WHEN 'view' THEN 'draft' END AS variant, value > 50 AS is_final, ts AS created_at FROM {e}"
register("src09_dedupe_transcript_variants", lambda t: i.dedupe_transcript_variants(t.spark.sql(VARIANT, e=t.events)), "", f"""
WITH v AS ({VARIANT.format(e="events")}), b AS (SELECT row_id, interaction_id, engine, CASE WHEN is_final THEN 'final' ELSE 'draft' END AS variant, is_final, created_at FROM v WHERE variant IS NULL QUALIFY row_number() OVER (PARTITION BY interaction_id, engine ORDER BY created_at DESC, row_id) = 1),
u AS (SELECT * FROM v WHERE variant IS NOT NULL UNION ALL SELECT * FROM b WHERE NOT EXISTS (SELECT 1 FROM v WHERE v.interaction_id = b.interaction_id AND v.engine = b.engine AND v.variant = b.variant))
SELECT row_id, interaction_id, engine, variant, is_final, created_at FROM u QUALIFY row_number() OVER (PARTITION BY interaction_id, engine, variant ORDER BY created_at DESC, row_id) = 1""")
register("src10_dedupe_contacts", lambda t: i.dedupe_contacts(t.calls_raw.selectExpr("interaction_id AS id", "other_party_phone AS phone", "ingested_at_utc AS created_at")), "calls_raw", "SELECT interaction_id AS id, other_party_phone AS phone, ingested_at_utc AS created_at FROM calls_raw QUALIFY other_party_phone IS NULL OR row_number() OVER (PARTITION BY other_party_phone ORDER BY ingested_at_utc, interaction_id) = 1")
register("src11_validate_ids", lambda t: i.validate_ids(t.orders.selectExpr("CASE o_orderkey % 4 WHEN 0 THEN 'c1l_' WHEN 1 THEN 'CLL_' WHEN 2 THEN 'cll_' ELSE 'x-' END || CAST(o_orderkey AS STRING) AS interaction_id")), "", """
SELECT CASE o_orderkey % 4 WHEN 0 THEN 'c1l_' WHEN 1 THEN 'CLL_' WHEN 2 THEN 'cll_' ELSE 'x-' END || CAST(o_orderkey AS VARCHAR) AS interaction_id, CASE WHEN o_orderkey % 4 < 2 THEN 'warning:confusable_prefix' WHEN o_orderkey % 4 = 2 THEN '' ELSE 'error:bad_form' END AS issues,
 CASE WHEN o_orderkey % 4 = 3 THEN 'x-' ELSE 'cll_' END || CAST(o_orderkey AS VARCHAR) AS suggested FROM orders""")
register("src14_export_scheduler_jsonl", lambda t: i.export_scheduler_jsonl(t.loops, ["id", "call_id", "status", "created_at"]), "loops", "SELECT '{\"id\":\"' || id || '\",\"call_id\":\"' || call_id || '\",\"status\":\"' || status || '\",\"created_at\":\"' || strftime(created_at, '%Y-%m-%dT%H:%M:%SZ') || '\"}' AS line FROM loops")
ITEMS = "'[{\"title\":\"T' || {m} || '\",\"action\":\"call\"},{\"title\":\"T' || {m} || '\",\"action\":\"send\"}]'"
register("src15_materialize_action_items", lambda t: i.materialize_action_items(t.interactions.selectExpr("interaction_id", "project_id", ITEMS.replace("{m}", "channel") + " AS items_json"), t.interactions.where("needs_review").selectExpr("interaction_id", "left(md5('T' || channel || '|call'), 8) AS item_hash")), "interactions", """
WITH a AS (SELECT interaction_id, project_id, needs_review AS stored, 'T' || channel AS title, unnest(['call', 'send']) AS action FROM interactions), b AS (SELECT *, substr(md5(title || '|' || action), 1, 8) AS item_hash FROM a)
SELECT interaction_id, item_hash, title, action, project_id, CASE WHEN project_id IS NOT NULL THEN 'resolved' ELSE 'unknown' END AS attribution_status, CASE WHEN project_id IS NOT NULL THEN 0.80::DOUBLE END AS attribution_confidence, project_id IS NULL AS needs_review FROM b WHERE NOT (stored AND action = 'call')""")
register("src18_apply_retention", lambda t: i.apply_retention(t.event_audit.selectExpr("id", "received_at_utc", "gate_status = 'pass' AS exported"), "received_at_utc", "exported", "2024-01-30", 14), "event_audit", "SELECT id, received_at_utc, gate_status = 'pass' AS exported FROM event_audit WHERE received_at_utc >= TIMESTAMP '2024-01-16' OR gate_status <> 'pass'")
register("src19_extract_phone_layers", lambda t: i.extract_phone_layers(t.calls_raw.selectExpr("interaction_id", "CASE WHEN zap_id IS NULL THEN 'note 0005551234567 or 5550' || lpad(CAST(length(transcript) AS STRING), 6, '0') ELSE raw_snapshot_json END AS raw_snapshot_json")), "calls_raw", f"""
WITH r AS (SELECT interaction_id, CASE WHEN zap_id IS NULL THEN NULL ELSE raw_snapshot_json END AS raw_snapshot_json, '5550' || lpad(CAST(length(transcript) AS VARCHAR), 6, '0') AS d FROM calls_raw)
SELECT interaction_id, CASE WHEN raw_snapshot_json IS NULL THEN '+1' || d ELSE '+1' || right(regexp_replace({PHONE}, '[^0-9]', '', 'g'), 10) END AS phone, CASE WHEN raw_snapshot_json IS NULL THEN 'text' ELSE 'field' END AS layer FROM r""")
register("src23_live_calls", lambda t: i.live_calls(t.calls_raw), "calls_raw", "SELECT DISTINCT interaction_id FROM calls_raw WHERE interaction_id LIKE 'cll\\_%' ESCAPE '\\' AND NOT interaction_id LIKE 'cll\\_TEST\\_%' ESCAPE '\\'")
register("src21_register_keys", lambda t: i.register_keys(t.events.selectExpr("CAST(event_id % 3000 AS STRING) AS key", "ts"), t.events.where("event_id < 1000").selectExpr("CAST(event_id AS STRING) AS key", "ts AS first_seen", "ts AS last_seen", "CAST(2 AS BIGINT) AS hit_count")), "", """
WITH n AS (SELECT CAST(event_id % 3000 AS VARCHAR) AS key, min(ts) AS f, max(ts) AS l, count(*) AS n FROM events GROUP BY 1), k AS (SELECT CAST(event_id AS VARCHAR) AS key, ts, 2 AS h FROM events WHERE event_id < 1000)
SELECT coalesce(n.key, k.key) AS key, least(ts, f) AS first_seen, greatest(ts, l) AS last_seen, CAST(coalesce(h, 0) + coalesce(n, 0) AS BIGINT) AS hit_count, coalesce(h, 0) + coalesce(n, 0) > 1 AS is_duplicate FROM n FULL JOIN k ON n.key = k.key""")
register("src20_sync_parent_stats", lambda t: i.sync_parent_transcript_stats(t.interactions.withColumn("transcript_chars", F.expr("CASE WHEN channel = 'sms' THEN 0 ELSE transcript_chars END")).withColumn("review_reasons", F.array(F.col("review_reason"), F.lit("G4_EMPTY_TRANSCRIPT"))), t.spans), "interactions spans", """
WITH n AS (SELECT interaction_id, sum(char_end - char_start) AS n FROM spans WHERE NOT is_superseded GROUP BY 1), b AS (SELECT i.*, CASE WHEN channel = 'sms' THEN 0 ELSE transcript_chars END AS c, n FROM interactions i LEFT JOIN n USING (interaction_id)), f AS (SELECT *, coalesce(c, 0) = 0 AND coalesce(n, 0) > 0 AS fix FROM b)
SELECT interaction_id, CAST(CASE WHEN fix THEN n ELSE c END AS BIGINT) AS transcript_chars, CASE WHEN fix THEN review_reason ELSE review_reason || ',G4_EMPTY_TRANSCRIPT' END AS reasons, CASE WHEN fix THEN true ELSE needs_review END AS needs_review, fix AS synced FROM f""")
register("src17_parse_model_outputs", lambda t: i.parse_model_outputs(t.events.selectExpr("event_id", "CASE WHEN event_id % 3 = 0 THEN '```json\n' || props || '\n```' WHEN event_id % 3 = 1 THEN replace(props, '}', ',}') ELSE 'nothing ' || props END AS output"), "k int")[0].selectExpr("event_id", "parsed.k AS k"), "", "SELECT event_id, CAST(json_extract(props, '$.k') AS INT) AS k FROM events WHERE event_id % 3 <> 2")
