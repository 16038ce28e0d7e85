"""Engine tables as views over the driver's tables.

Each view is one SQL text that Spark and DuckDB both run: Spark to feed the
operators, DuckDB as the head of the oracle queries. Every derived column is a
pure expression of the source row, so both engines agree on it.
"""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession

BASE = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()

VIEWS = {
    "interactions": """
SELECT CAST(o_orderkey AS STRING) AS interaction_id, CAST(o_custkey AS STRING) AS contact_id,
  CASE WHEN o_orderkey % 6 = 0 THEN NULL ELSE '+1555' || lpad(CAST(o_custkey AS STRING), 7, '0') END AS contact_phone,
  CASE WHEN o_orderkey % 5 = 0 THEN NULL ELSE 'Customer#' || lpad(CAST(o_custkey AS STRING), 9, '0') END AS contact_name,
  CASE WHEN o_orderkey % 7 = 0 THEN NULL ELSE CAST(o_orderkey % 25 AS STRING) END AS project_id,
  CASE WHEN o_orderkey % 9 = 0 THEN NULL ELSE CAST(o_orderkey % 21 AS DOUBLE) / 20 END AS project_attribution_confidence,
  o_orderstatus = 'P' AS needs_review, o_orderpriority AS review_reason,
  CASE WHEN o_orderkey % 3 = 0 THEN 'call' WHEN o_orderkey % 3 = 1 THEN 'sms' ELSE 'email' END AS channel,
  CAST(floor(o_totalprice / 50) AS INT) AS transcript_chars, o_orderdate AS event_at_utc,
  o_orderdate + INTERVAL 1 DAY AS ingested_at_utc, o_orderpriority = '1-URGENT' AS is_key
FROM {orders}""",
    "calls_raw": """
SELECT CASE WHEN o_orderkey % 40 = 0 THEN 'cll_TEST_' ELSE 'cll_' END || CAST(o_orderkey AS STRING) AS interaction_id,
  CASE WHEN o_orderkey % 3 = 0 THEN 'Inbound' WHEN o_orderkey % 3 = 1 THEN 'outgoing' ELSE 'x' END AS direction,
  CASE WHEN o_orderkey % 4 = 0 THEN '' ELSE '+1444' || lpad(CAST(o_orderkey % 1000 AS STRING), 7, '0') END AS owner_phone,
  CASE WHEN o_orderkey % 5 < 2 THEN NULL ELSE '+1555' || lpad(CAST(o_custkey AS STRING), 7, '0') END AS other_party_phone,
  CASE WHEN o_orderkey % 8 = 0 THEN NULL ELSE 'Customer#' || CAST(o_custkey AS STRING) END AS other_party_name,
  CASE WHEN o_orderkey % 11 = 0 THEN NULL ELSE o_orderdate END AS event_at_utc, o_orderdate + INTERVAL 2 DAY AS ingested_at_utc,
  CASE WHEN o_orderkey % 10 = 0 THEN 'hi' ELSE 'call about ' || o_orderpriority || ' order worth ' || CAST(CAST(floor(o_totalprice) AS BIGINT) AS STRING) END AS transcript,
  CASE WHEN o_orderkey % 12 = 0 THEN NULL ELSE 'zap-' || CAST(o_orderkey AS STRING) END AS zap_id,
  CASE WHEN o_orderkey % 2 = 0 THEN 'v3' ELSE 'v4' END AS pipeline_version, o_orderkey % 23 = 0 AS is_shadow,
  chr(123) || '"signal":' || chr(123) || '"contact":' || chr(123) || '"phone":"' || CASE WHEN o_orderkey % 6 = 0 THEN '' ELSE '+1555' || lpad(CAST(o_custkey AS STRING), 7, '0') END || '"' || chr(125) || ',"phone":"+1777' || lpad(CAST(o_orderkey % 97 AS STRING), 7, '0') || '"' || chr(125) || chr(125) AS raw_snapshot_json
FROM {orders}""",
    "spans": """
SELECT CAST(l_orderkey AS STRING) || '-' || CAST(l_linenumber AS STRING) AS span_id, CAST(l_orderkey AS STRING) AS interaction_id,
  l_linenumber - 1 AS span_index, (l_linenumber - 1) * 1200 + CASE WHEN (l_orderkey + l_linenumber) % 17 = 0 THEN 5 ELSE 0 END AS char_start,
  l_linenumber * 1200 AS char_end, CAST(l_orderkey % 13 = 0 AND l_linenumber % 2 = 0 AS BOOLEAN) AS is_superseded,
  CASE WHEN l_orderkey % 13 = 0 AND l_linenumber % 2 = 0 THEN 1 ELSE 2 END AS segment_generation,
  CAST(max(l_quantity) * 60 AS INT) AS word_count, min(l_shipdate) AS created_at
FROM {lineitem} GROUP BY l_orderkey, l_linenumber""",
    "attributions": """
SELECT CAST(l_orderkey AS STRING) || '-' || CAST(l_linenumber AS STRING) AS span_id, CAST(l_orderkey AS STRING) AS interaction_id,
  CAST(l_orderkey AS STRING) || '-' || CAST(l_linenumber AS STRING) || '-' || CAST(l_partkey AS STRING) || '-' || CAST(l_suppkey AS STRING) AS attribution_id,
  CASE WHEN l_partkey % 12 = 0 THEN NULL ELSE CAST(l_suppkey AS STRING) END AS project_id, l_discount * 10 AS confidence,
  CASE l_returnflag WHEN 'A' THEN 'assign' WHEN 'R' THEN 'review' ELSE 'none' END AS decision,
  CASE WHEN l_linestatus = 'F' AND l_partkey % 5 = 0 THEN 'human' WHEN l_linestatus = 'F' AND l_partkey % 5 < 3 THEN 'ai' END AS attribution_lock,
  l_returnflag = 'R' AS needs_review, CASE WHEN l_partkey % 2 = 0 THEN 'v1' ELSE 'v2' END AS prompt_version, l_shipdate AS attributed_at
FROM {lineitem}""",
    "review_queue": """
SELECT CAST(l_orderkey AS STRING) || '-' || CAST(l_linenumber AS STRING) || '-' || CAST(l_partkey AS STRING) || '-' || CAST(l_suppkey AS STRING) || '-' || CAST(l_extendedprice AS STRING) AS id,
  CAST(l_orderkey AS STRING) AS interaction_id,
  CASE WHEN l_partkey % 11 = 0 THEN NULL ELSE CAST(l_orderkey AS STRING) || '-' || CAST(l_linenumber AS STRING) END AS span_id,
  CASE WHEN l_suppkey % 3 = 0 THEN 'journal' ELSE 'attribution' END AS module,
  CASE l_partkey % 4 WHEN 0 THEN 'resolved' WHEN 1 THEN 'dismissed' ELSE 'pending' END AS status,
  CASE l_partkey % 5 WHEN 0 THEN 'conflict' WHEN 1 THEN 'open_loop' WHEN 2 THEN 'model_error' WHEN 3 THEN 'low_confidence' ELSE 'weak_anchor' END AS reason,
  CAST(l_quantity AS INT) % 5 + 1 AS hit_count, l_shipdate AS created_at, CAST(l_suppkey AS STRING) AS project_id, l_discount * 10 AS confidence
FROM {lineitem} WHERE l_returnflag = 'R'""",
    "contacts": """
SELECT CAST(c_custkey AS STRING) AS id, c_name AS name,
  CASE WHEN c_custkey % 10 = 0 THEN NULL ELSE '+1 (555) ' || lpad(CAST(c_custkey AS STRING), 7, '0') END AS phone,
  CASE WHEN c_custkey % 4 = 0 THEN '1555' || lpad(CAST(c_custkey + 1 AS STRING), 7, '0') END AS secondary_phone,
  c_mktsegment AS contact_type, c_mktsegment AS trade, 'Company ' || CAST(c_nationkey AS STRING) AS company, c_custkey % 50 = 0 AS is_internal,
  c_custkey % 37 = 0 AS floats_between_projects, CASE WHEN c_custkey % 8 = 0 THEN 'mail c' || CAST(c_custkey AS STRING) || '@example.com today' WHEN c_custkey % 8 = 1 THEN 'ring 555-010-' || lpad(CAST(c_custkey % 10000 AS STRING), 4, '0') ELSE 'no notes' END AS notes,
  'Al' || CAST(c_custkey AS STRING) || '|' || 'Cust ' || CAST(c_custkey % 700 AS STRING) AS alias_list,
  CAST(floor(c_acctbal * 10) AS INT) AS total_transcript_chars, CAST(c_custkey % 30 AS INT) AS interaction_count, c_nationkey AS region_key
FROM {customer}""",
    "projects": """
SELECT CAST(s_suppkey AS STRING) AS id, 'Project ' || CAST(s_suppkey AS STRING) AS name,
  CASE s_suppkey % 5 WHEN 0 THEN 'closed' WHEN 1 THEN 'warranty' WHEN 2 THEN 'estimating' ELSE 'active' END AS status,
  CASE WHEN s_suppkey % 9 = 0 THEN 'internal' ELSE 'client' END AS project_kind, CASE s_suppkey % 3 WHEN 0 THEN 'design' WHEN 1 THEN 'framing' ELSE 'finish' END AS phase,
  n_name AS city, s_acctbal AS contract_value, CAST((s_suppkey * 37) % 180 - 90 AS DOUBLE) / 2 AS lat, CAST((s_suppkey * 53) % 360 - 180 AS DOUBLE) / 2 AS lon
FROM {supplier} JOIN {nation} ON s_nationkey = n_nationkey""",
    "project_contacts": """
SELECT CAST(l_suppkey AS STRING) AS project_id, CAST(o_custkey AS STRING) AS contact_id, max(CASE WHEN l_partkey % 10 = 0 THEN 'owner' ELSE 'sub' END) AS role,
  max(CASE WHEN l_partkey % 2 = 0 THEN 'BUILDING' ELSE 'MACHINERY' END) AS trade, bool_or(l_linestatus = 'O') AS is_active
FROM {lineitem} JOIN {orders} ON l_orderkey = o_orderkey WHERE l_linenumber = 1 AND l_returnflag = 'A' GROUP BY l_suppkey, o_custkey""",
    "affinity": """
SELECT CAST(o_custkey AS STRING) AS contact_id, CAST(l_suppkey AS STRING) AS project_id, CAST(least(200, 10 * count(*) + 7 * max(l_linenumber)) AS DOUBLE) / 100 AS weight,
  CAST(count(*) AS INT) AS confirmation_count, CAST(sum(CASE WHEN l_returnflag = 'R' THEN 1 ELSE 0 END) AS INT) AS rejection_count, max(l_shipdate) AS last_interaction_at
FROM {lineitem} JOIN {orders} ON l_orderkey = o_orderkey WHERE l_linenumber <= 2 GROUP BY o_custkey, l_suppkey""",
    "claims": """
SELECT CAST(l_orderkey AS STRING) || '-' || CAST(l_linenumber AS STRING) || '-' || CAST(l_partkey AS STRING) || '-' || CAST(l_suppkey AS STRING) AS id,
  CAST(l_orderkey % 100 AS STRING) AS run_id, CAST(l_orderkey AS STRING) AS call_id, CASE WHEN l_partkey % 10 = 0 THEN NULL ELSE CAST(l_suppkey AS STRING) END AS project_id,
  CAST(l_orderkey AS STRING) || '-' || CAST(l_linenumber AS STRING) AS source_span_id, p_name || ' ' || p_type AS claim_text,
  CASE l_partkey % 8 WHEN 0 THEN 'decision' WHEN 1 THEN 'commitment' WHEN 2 THEN 'deadline' WHEN 3 THEN 'blocker' WHEN 4 THEN 'question' WHEN 5 THEN 'schedule' WHEN 6 THEN 'risk' ELSE 'fact' END AS claim_type,
  CASE l_linestatus WHEN 'F' THEN 'high' ELSE 'low' END AS warrant_level, CASE WHEN l_suppkey % 7 = 0 THEN 'reported' ELSE 'direct' END AS testimony_type, l_partkey % 9 <> 0 AS active,
  CASE l_returnflag WHEN 'A' THEN 'assign' WHEN 'R' THEN 'review' ELSE 'none' END AS attribution_decision, l_discount * 10 AS attribution_confidence,
  CASE WHEN l_partkey % 13 = 0 THEN NULL ELSE CAST(l_partkey % 400 AS INT) END AS char_start, CASE WHEN l_partkey % 13 = 0 THEN NULL ELSE CAST(l_partkey % 400 AS INT) + CAST(length(p_name) AS INT) END AS char_end,
  CASE WHEN l_partkey % 13 = 0 THEN NULL ELSE md5(p_name) END AS span_hash, CASE WHEN l_partkey % 6 = 0 THEN NULL ELSE 'transcript_span' END AS pointer_type, l_shipdate AS created_at,
  CASE WHEN l_partkey % 3 = 0 THEN NULL ELSE CAST(o_custkey AS STRING) END AS speaker_contact_id, CAST(o_custkey AS STRING) AS contact_id
FROM {lineitem} JOIN {part} ON l_partkey = p_partkey JOIN {orders} ON l_orderkey = o_orderkey WHERE l_linenumber <= 3""",
    "loops": """
SELECT CAST(l_orderkey AS STRING) || '-' || CAST(l_partkey AS STRING) || '-' || CAST(l_suppkey AS STRING) AS id, CAST(l_orderkey AS STRING) AS call_id, CAST(l_suppkey AS STRING) AS project_id,
  CASE l_returnflag WHEN 'A' THEN 'question' WHEN 'R' THEN 'follow_up' ELSE 'decision' END AS loop_type, CASE WHEN l_linestatus = 'O' THEN 'open' ELSE 'closed' END AS status, l_shipdate AS created_at
FROM {lineitem} WHERE l_linenumber = 4""",
    "facts": """
SELECT CAST(l_suppkey AS STRING) AS project_id, l_shipdate AS as_of_at, l_shipdate + CAST(l_quantity AS INT) % 20 * INTERVAL 1 DAY AS observed_at,
  CASE l_returnflag WHEN 'A' THEN 'scope' WHEN 'R' THEN 'budget' ELSE 'schedule' END AS fact_kind, CAST(l_orderkey AS STRING) AS interaction_id,
  CAST(l_orderkey AS STRING) || '-' || CAST(l_partkey AS STRING) || '-' || CAST(l_extendedprice AS STRING) AS fact_id, CASE WHEN l_partkey % 4 = 0 THEN NULL ELSE CAST(l_partkey AS INT) END AS source_char_start
FROM {lineitem} WHERE l_linenumber = 5""",
    "striking": """
SELECT CAST(event_id AS STRING) AS span_id, CAST(event_id % 500 AS STRING) AS interaction_id, CAST(user_id % 100 AS STRING) AS project_id, value / 100 - 0.1 AS striking_score, event_type AS signal, ts AS created_at
FROM {events} WHERE event_type IN ('error', 'purchase')""",
    "event_audit": """
SELECT CAST(event_id AS STRING) AS id, CAST(event_id % 4000 AS STRING) AS interaction_id, CASE event_type WHEN 'error' THEN 'fail' WHEN 'click' THEN 'needs_human' ELSE 'pass' END AS gate_status,
  CASE event_type WHEN 'error' THEN 'i2_duplicate' WHEN 'click' THEN 'i1_phone_invalid' WHEN 'view' THEN 'lineage_missing_warning' END AS gate_reason,
  CASE event_type WHEN 'error' THEN 'reject' WHEN 'click' THEN 'queue_human' ELSE 'auto_persist' END AS triage_action, CASE WHEN event_id % 5 = 0 THEN NULL ELSE 'zap' END AS source_run_id, ts AS received_at_utc
FROM {events}""",
    "calls": """
SELECT CAST(event_id AS STRING) AS interaction_id, CAST(user_id AS STRING) AS contact_id, CASE WHEN event_id % 4 = 0 THEN NULL ELSE CAST(user_id % 7 AS STRING) END AS project_id, event_type AS channel, ts AS event_at_utc, value AS duration_seconds, event_id % 29 = 0 AS is_shadow
FROM {events}""",
    "overrides": """
SELECT CAST(user_id AS STRING) AS contact_id, CAST(event_id % 5 AS STRING) AS project_id, CASE WHEN event_type IN ('purchase', 'signup') THEN 'confirm' ELSE 'reject' END AS action, ts AS created_at, event_id AS seq
FROM {events} WHERE event_type <> 'view'""",
    "turns": """
SELECT CAST(conv_id AS STRING) AS interaction_id, turn, upper(substr(role, 1, 1)) || substr(role, 2) AS speaker, text FROM {conversations}""",
    "texts": """
SELECT CAST(doc_id AS STRING) AS interaction_id, coalesce(text, '') AS text, source AS contact_id, lang FROM {documents}""",
}


def _needs(name: str) -> list[str]:
    return re.findall(r"\{(\w+)\}", VIEWS[name])


def oracle(views: str, body: str) -> str:
    """DuckDB SQL for ``body`` over the named views."""
    heads = [f"{v} AS ({VIEWS[v].format(**{n: n for n in _needs(v)})})" for v in views.split()]
    body = body.strip()
    if not heads:
        return body
    if body.upper().startswith("WITH RECURSIVE "):
        return "WITH RECURSIVE " + ",\n".join(heads) + ",\n" + body[15:]
    return "WITH " + ",\n".join(heads) + (",\n" + body[5:] if body.upper().startswith("WITH ") else "\n" + body)


class Tables:
    """The base tables and the views of one data folder, as attributes."""

    def __init__(self, spark: SparkSession, sf_dir: str):
        self.spark, self.sf_dir = spark, sf_dir

    def __getattr__(self, name: str) -> DataFrame:
        if name in VIEWS:
            return self.spark.sql(VIEWS[name], **{n: getattr(self, n) for n in _needs(name)})
        if name in BASE:
            return self.spark.read.parquet(f"{self.sf_dir}/{name}.parquet")
        raise AttributeError(name)
