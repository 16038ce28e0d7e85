"""Queries that replay the driver's tables as streams; results as of the end of the input."""

from pyspark.sql import functions as F

from ..sources.drivermap import VIEWS
from ..streaming import jobs as j
from . import register


def _stream(t, view: str, base: str):
    """A view over one base table, read as a stream of files."""
    batch = getattr(t, base)
    stream = t.spark.readStream.schema(batch.schema).parquet(f"{t.sf_dir}/{base}.parquet*")
    rows = t.spark.sql(VIEWS[view], **{base: stream})
    # Watermarks need instants; results go back to times without zone.
    return rows.withColumns({c: F.col(c).cast("timestamp") for c, kind in rows.dtypes if kind == "timestamp_ntz"})


def _zoneless(df):
    return df.withColumns({c: F.col(c).cast("timestamp_ntz") for c, kind in df.dtypes if kind == "timestamp"})


def _ingest(t):
    out = j.replayed(t.spark, lambda o, c: j.idempotent_ingest(_stream(t, "calls_raw", "orders"), f"{o}/accepted", f"{o}/audit", c))
    return t.spark.read.parquet(f"{out}/audit").select("interaction_id", "phone", "gate_status", "triage_action", "gate_reasons")

PHONE = "coalesce(nullif(json_extract_string(raw_snapshot_json, '$.signal.contact.phone'), ''), nullif(json_extract_string(raw_snapshot_json, '$.signal.phone'), ''))"
register("str01_idempotent_ingest", _ingest, "calls_raw", f"""
WITH f AS (SELECT *, regexp_matches({PHONE}, '^\\+[0-9]{{10,15}}$') AS fine FROM calls_raw)
SELECT interaction_id, {PHONE} AS phone, CASE WHEN NOT fine THEN 'needs_human' ELSE 'pass' END AS gate_status, CASE WHEN NOT fine THEN 'queue_human' ELSE 'auto_persist' END AS triage_action, concat_ws(',', CASE WHEN NOT fine THEN 'i1_phone_invalid' END, CASE WHEN zap_id IS NULL THEN 'lineage_missing_warning' END) AS gate_reasons FROM f""")


def _table(t, rows, mode: str = "complete"):
    """The result table of an aggregating stream after all input."""
    path = {}

    def run(o, c):
        path["o"] = o
        return rows.writeStream.outputMode(mode).option("checkpointLocation", c).trigger(availableNow=True).foreachBatch(lambda df, n: df.write.mode("overwrite").parquet(o)).start()

    return _zoneless(t.spark.read.parquet(j.replayed(t.spark, run)))


register("str02_call_chains", lambda t: _zoneless(t.spark.read.parquet(j.replayed(t.spark, lambda o, c: j.call_chains(_stream(t, "calls", "events"), o, c, "complete")))), "calls", """
WITH p AS (SELECT contact_id, CAST(event_at_utc AS DATE) AS day, project_id, count(*) AS n FROM calls WHERE NOT is_shadow GROUP BY ALL),
q AS (SELECT contact_id, day, count(project_id) AS n_projects, first(project_id ORDER BY project_id IS NULL, n DESC, project_id) AS dominant_project_id FROM p GROUP BY 1, 2),
c AS (SELECT contact_id, CAST(event_at_utc AS DATE) AS day, count(*) AS n_calls, min(event_at_utc) AS first_at, max(event_at_utc) AS last_at, round(sum(duration_seconds), 2) AS duration,
 CASE WHEN count(*) > 1 THEN floor((epoch_us(max(event_at_utc)) - epoch_us(min(event_at_utc))) / 1000000) / (count(*) - 1) END AS mean_gap_s FROM calls WHERE NOT is_shadow GROUP BY 1, 2)
SELECT c.*, n_projects, dominant_project_id FROM c JOIN q USING (contact_id, day)""")
register("str02_call_sessions", lambda t: _table(t, j.call_sessions(_stream(t, "calls", "events"))), "calls", """
WITH g AS (SELECT *, CASE WHEN event_at_utc >= lag(event_at_utc) OVER w + INTERVAL 2 HOUR OR lag(event_at_utc) OVER w IS NULL THEN 1 ELSE 0 END AS new FROM calls WHERE NOT is_shadow WINDOW w AS (PARTITION BY contact_id ORDER BY event_at_utc)), s AS (SELECT *, sum(new) OVER (PARTITION BY contact_id ORDER BY event_at_utc) AS n FROM g)
SELECT contact_id, count(*) AS n_calls, min(event_at_utc) AS first_at, max(event_at_utc) AS last_at FROM s GROUP BY contact_id, n""")


def _continuity(t):
    rows = j.continuity_pairs(_stream(t, "calls", "events"), _stream(t, "calls", "events"))
    return _zoneless(t.spark.read.parquet(j.replayed(t.spark, lambda o, c: j.append_to(rows, o, c).start())))


register("str03_continuity_pairs", _continuity, "calls", "SELECT a.interaction_id, a.contact_id, b.interaction_id AS prior_id, a.event_at_utc, b.event_at_utc AS prior_at FROM calls a JOIN calls b ON a.contact_id = b.contact_id AND b.event_at_utc < a.event_at_utc AND b.event_at_utc >= a.event_at_utc - INTERVAL 48 HOUR")


def _stats(t):
    touches = _stream(t, "calls", "events").selectExpr("contact_id", "CAST(CAST(interaction_id AS BIGINT) % 900 AS STRING) AS interaction_id", "event_at_utc", "CAST(duration_seconds AS BIGINT) AS chars")
    return _zoneless(j.contact_totals(t.spark, j.replayed(t.spark, lambda o, c: j.running_contact_stats(touches, o, c))))


register("str04_contact_stats", _stats, "calls", """
WITH x AS (SELECT contact_id, CAST(CAST(interaction_id AS BIGINT) % 900 AS VARCHAR) AS i, CAST(trunc(duration_seconds) AS BIGINT) AS chars, event_at_utc FROM calls),
r AS (SELECT *, row_number() OVER (PARTITION BY contact_id, i ORDER BY event_at_utc, chars) AS n FROM x)
SELECT contact_id, count(*) FILTER (n = 1) AS interaction_count, CAST(sum(chars) FILTER (n = 1) AS BIGINT) AS total_chars, max(event_at_utc) FILTER (n = 1) AS last_interaction_at, count(*) FILTER (n > 1) AS suppressed FROM r GROUP BY 1""")
register("str05_rolling_ops", lambda t: _table(t, j.rolling_ops(_stream(t, "event_audit", "events"))), "event_audit", """
WITH h AS (SELECT gate_status, date_trunc('hour', received_at_utc) AS h FROM event_audit), w AS (SELECT gate_status, h - k * INTERVAL 1 HOUR AS from_at FROM h, range(24) r(k))
SELECT from_at, from_at + INTERVAL 24 HOUR AS to_at, gate_status, count(*) AS n FROM w GROUP BY 1, 3""")
register("str06_auto_resolve", lambda t: t.spark.read.parquet(j.replayed(t.spark, lambda o, c: j.auto_resolve(_stream(t, "interactions", "orders"), t.review_queue, o, c))).select("id", "interaction_id"), "interactions review_queue", "SELECT id, interaction_id FROM review_queue q WHERE status = 'pending' AND interaction_id IN (SELECT interaction_id FROM interactions WHERE project_id IS NOT NULL)")
