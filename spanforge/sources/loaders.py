"""Readers of label manifests and fact lines that keep what they can't use, with the reason.

Files are read with a fixed schema and a column for records that don't parse,
split where the format allows it; no row stops a load and none is lost: good
and quarantined rows add up to the records of the files.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: The fields of a manifest row, the decisions it may expect, and the form of ids.
MANIFEST = ("row_id", "interaction_id", "span_index", "span_id", "expected_project_id", "expected_project_name_contains", "expected_decision", "notes", "tags")
DECISIONS = ("assign", "review", "none")
ID, UUID = r"^[A-Za-z0-9_.:-]+$", r"(?i)^[0-9a-f]{8}-([0-9a-f]{4}-){3}[0-9a-f]{12}$"
_BAD = "_corrupt_record"


def _first_reason(checks: list[tuple[Column, str]]) -> Column:
    return F.coalesce(*(F.when(F.coalesce(bad, F.lit(True)), F.lit(reason)) for bad, reason in checks), F.lit(None))


def _parted(rows: DataFrame, columns: list[str]) -> tuple[DataFrame, DataFrame]:
    return rows.where("reason IS NULL").select(*columns), rows.where("reason IS NOT NULL").select("reason", "record", *columns)


def load_manifest(spark: SparkSession, path: str, json: bool = False) -> tuple[DataFrame, DataFrame]:
    """(good, quarantine) of a CSV file with a header, or of JSON rows one a line.

    Fields are trimmed; rows without an id get one from their content. A row is
    set aside if it doesn't parse, its ids are malformed, its span index is no
    number or its decision none of DECISIONS. A file without an
    ``interaction_id`` header is refused.
    """
    fields = ", ".join(f"{c} string" for c in (*MANIFEST, _BAD))
    if json:
        rows = spark.read.schema(fields).option("columnNameOfCorruptRecord", _BAD).json(path)
        broken, record = F.col(_BAD).isNotNull(), F.coalesce(F.col(_BAD), F.to_json(F.struct(*MANIFEST)))
    else:
        header = [c.strip() for c in spark.read.option("header", True).csv(path).columns]
        if "interaction_id" not in header:
            raise ValueError("a manifest needs an interaction_id header")
        shape = ", ".join(f"`{c}` string" for c in (*header, _BAD))
        rows = spark.read.schema(shape).option("header", True).option("enforceSchema", True).option("columnNameOfCorruptRecord", _BAD).csv(path)
        rows = rows.select(*(F.col(c) if c in header else F.lit(None).cast("string").alias(c) for c in MANIFEST), _BAD)
        broken, record = F.col(_BAD).isNotNull(), F.coalesce(F.col(_BAD), F.to_csv(F.struct(*MANIFEST)))
    rows = rows.select(*(F.coalesce(F.trim(c), F.lit("")).alias(c) for c in MANIFEST), broken.alias("_broken"), record.alias("record"))
    own = F.concat(F.lit("row_"), F.left(F.md5(F.concat_ws("|", *MANIFEST)), F.lit(12)))
    decision = F.lower("expected_decision")
    reason = _first_reason([
        (F.col("_broken"), "unreadable"), (~F.regexp_like("interaction_id", F.lit(ID)), "invalid_interaction_id"), ((F.col("span_index") != "") & F.col("span_index").try_cast("int").isNull(), "invalid_span_index"),
        ((F.col("span_id") != "") & ~F.regexp_like("span_id", F.lit(ID)), "invalid_span_id"), (~decision.isin(*DECISIONS), "invalid_decision"),
    ])
    rows = rows.withColumn("reason", reason).withColumns({"row_id": F.when(F.col("row_id") == "", own).otherwise(F.col("row_id")), "expected_decision": decision})
    return _parted(rows.withColumn("span_index", F.col("span_index").try_cast("int")), list(MANIFEST))


def load_facts_jsonl(spark: SparkSession, path: str, uuids: bool = False) -> tuple[DataFrame, DataFrame]:
    """(good, quarantine) of typed facts, one JSON object per line; the payload stays JSON text.

    A fact is set aside if its line doesn't parse, it lacks a project (with
    ``uuids``, a UUID), kind or payload, a time doesn't parse, it was observed
    before it held, or its source places are out of order.
    """
    texts = ("project_id", "as_of_at", "observed_at", "fact_kind", "fact_payload", "interaction_id", "evidence_event_id", "source_char_start", "source_char_end")
    rows = spark.read.schema(", ".join(f"{c} string" for c in (*texts, _BAD))).option("columnNameOfCorruptRecord", _BAD).json(path)
    when = lambda c: F.try_to_timestamp(F.col(c)).cast("timestamp_ntz")
    rows = rows.select(
        F.trim("project_id").alias("project_id"), when("as_of_at").alias("as_of_at"), when("observed_at").alias("observed_at"), F.trim("fact_kind").alias("fact_kind"), "fact_payload", "interaction_id", "evidence_event_id",
        F.col("source_char_start").try_cast("int").alias("source_char_start"), F.col("source_char_end").try_cast("int").alias("source_char_end"),
        F.struct(F.col("source_char_start").alias("a"), F.col("source_char_end").alias("b")).alias("_places"), F.col(_BAD).isNotNull().alias("_broken"), F.coalesce(F.col(_BAD), F.to_json(F.struct(*texts))).alias("record"),
    )
    whole = lambda raw, read: raw.isNotNull() & read.isNull()
    reason = _first_reason([
        (F.col("_broken"), "unreadable"), (F.col("project_id").isNull() | (F.col("project_id") == ""), "no_project"), (~F.regexp_like("project_id", F.lit(UUID)) if uuids else F.lit(False), "project_is_no_uuid"),
        (F.col("as_of_at").isNull(), "invalid_as_of_at"), (F.col("observed_at").isNull(), "invalid_observed_at"), (F.col("observed_at") < F.col("as_of_at"), "observed_before_it_held"),
        (F.col("fact_kind").isNull() | (F.col("fact_kind") == ""), "no_kind"), (F.col("fact_payload").isNull(), "no_payload"),
        (whole(F.col("_places.a"), F.col("source_char_start")) | whole(F.col("_places.b"), F.col("source_char_end")) | F.coalesce(F.col("source_char_end") < F.col("source_char_start"), F.lit(False)), "invalid_source_places"),
    ])
    return _parted(rows.withColumn("reason", reason), list(texts))
