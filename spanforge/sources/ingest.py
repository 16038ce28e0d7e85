"""Ingest gates, never-regress merges, deduplication and exports of call records."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.basics import at, days, filled, latest

#: JSON paths of a phone in a payload, first one that is filled wins.
PHONE_PATHS = ("$.signal.contact.phone", "$.signal.phone", "$.phone")
E164 = r"^\+[0-9]{10,15}$"


def first_json(column: str, paths: tuple[str, ...] = PHONE_PATHS) -> Column:
    return F.coalesce(*(filled(F.get_json_object(column, p)) for p in paths))


def ingest_call_events(payloads: DataFrame, stored: DataFrame) -> DataFrame:
    """A gate row for every payload: phone, status, action, reasons and the payload's hash.

    ``payloads`` has interaction_id, raw_snapshot_json, zap_id and ingested_at_utc;
    ``stored`` the interaction_ids already kept. Of payloads with one id in the
    batch, all but the first are duplicates as well. Accepted rows are those
    with action auto_persist.
    """
    seen = stored.select("interaction_id").distinct().withColumn("_stored", F.lit(True))
    order = Window.partitionBy("interaction_id").orderBy(F.col("ingested_at_utc").asc_nulls_last(), F.sha2("raw_snapshot_json", 256))
    rows = payloads.withColumn("_nth", F.row_number().over(order)).join(seen, "interaction_id", "left")
    return gate_rows(rows, F.coalesce(F.col("_stored"), F.lit(False)) | (F.col("_nth") > 1))


def gate_rows(payloads: DataFrame, again: Column) -> DataFrame:
    """Phone, status, action and reasons of each payload, given which are duplicates."""
    rows = payloads.withColumn("phone", first_json("raw_snapshot_json"))
    fine = F.coalesce(F.col("phone").rlike(E164), F.lit(False))
    reasons = F.array_compact(F.array(F.when(again, "i2_duplicate"), F.when(~fine, "i1_phone_invalid"), F.when(F.col("zap_id").isNull(), "lineage_missing_warning")))
    status = F.when(again, "fail").when(~fine, "needs_human").otherwise("pass")
    action = F.when(again, "reject").when(~fine, "queue_human").otherwise("auto_persist")
    return rows.select("interaction_id", "phone", status.alias("gate_status"), action.alias("triage_action"), F.concat_ws(",", reasons).alias("gate_reasons"), F.sha2("raw_snapshot_json", 256).alias("payload_sha256"), F.col("ingested_at_utc").alias("received_at_utc"))


def resolve_party_phones(calls: DataFrame) -> DataFrame:
    """Direction as inbound, outbound or unknown, and who the owner and the other party are by it."""
    d = F.lower(F.trim("direction"))
    side = F.when(d.isin("inbound", "incoming", "in", "received"), "inbound").when(d.isin("outbound", "outgoing", "out", "sent", "placed"), "outbound").otherwise("unknown")
    own, other = filled(F.col("owner_phone")), filled(F.col("other_party_phone"))
    raw = first_json("raw_snapshot_json")
    return calls.select("interaction_id", side.alias("direction"), own.alias("owner_phone"), F.when(side == "outbound", F.coalesce(other, raw)).when(side == "inbound", F.coalesce(raw, other)).otherwise(other).alias("other_party_phone"))


def intake_gate(calls: DataFrame, shortest: int = 10) -> DataFrame:
    """Codes of what is wrong with a call before it goes on, and whether it ends here."""
    n = F.length(F.coalesce(F.trim("transcript"), F.lit("")))
    codes = F.array_compact(F.array(F.when(~F.col("interaction_id").rlike("^[A-Za-z0-9_]+$"), "G1_ID_MALFORMED"), F.when(n < shortest, "G4_EMPTY_TRANSCRIPT"), F.when(F.col("event_at_utc").isNull(), "G4_TIMESTAMP_MISSING")))
    return calls.select("interaction_id", F.concat_ws(",", codes).alias("codes"), F.when(F.size(codes) > 0, "NEEDS_REVIEW").otherwise("PASS").alias("gate"), (n < shortest).alias("terminal_empty"))


def merge_never_regress(old: DataFrame, new: DataFrame, key: str, columns: list[str]) -> DataFrame:
    """The keyed union in which an incoming null or blank never overwrites a value."""
    n = new.select(F.col(key).alias("_k"), *(F.col(c).alias(f"_n_{c}") for c in columns))
    both = old.select(key, *columns).join(n, F.col(key) == F.col("_k"), "full")
    return both.select(F.coalesce(key, "_k").alias(key), *(F.coalesce(filled(F.col(f"_n_{c}")), F.col(c)).alias(c) for c in columns))


def apply_repairs(calls: DataFrame, repairs: DataFrame) -> DataFrame:
    """Calls with repaired phone, transcript and summary, and the number of fields changed.

    A phone only fills a missing one; a transcript over 10 characters and a
    summary over 5 replace the stored.
    """
    r = repairs.select(F.col("interaction_id").alias("_id"), filled(F.col("phone")).alias("_p"), F.col("transcript").alias("_t"), F.col("summary").alias("_s"))
    both = calls.join(r, F.col("interaction_id") == F.col("_id"), "left")
    rules = {"phone": F.coalesce("phone", "_p"), "transcript": F.when(F.length("_t") > 10, F.col("_t")).otherwise(F.col("transcript")), "summary": F.when(F.length("_s") > 5, F.col("_s")).otherwise(F.col("summary"))}
    changed = sum(((~F.col(c).eqNullSafe(v)).cast("int") for c, v in rules.items()), F.lit(0))
    return both.select("interaction_id", *(v.alias(c) for c, v in rules.items()), changed.alias("fields_changed"))


def validate_repairs(calls: DataFrame, interactions: DataFrame) -> DataFrame:
    """Calls with issues left: no phone, short transcript, phone not the interaction's."""
    i = interactions.select("interaction_id", F.col("contact_phone").alias("_cp"))
    both = calls.join(i, "interaction_id", "left")
    issues = F.array_compact(F.array(F.when(F.col("phone").isNull(), "phone_null"), F.when(F.length(F.coalesce("transcript", F.lit(""))) <= 10, "transcript_short"), F.when(F.col("phone").isNotNull() & ~F.col("phone").eqNullSafe(F.col("_cp")), "phone_not_synced")))
    return both.select("interaction_id", F.concat_ws(",", issues).alias("issues")).where("issues <> ''")


def latest_per_key(df: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """The newest row of each key by several columns, nulls last."""
    return latest(df, keys, *(F.col(c).desc_nulls_last() for c in order))


def dedupe_transcript_variants(df: DataFrame) -> DataFrame:
    """One row per (id, engine, variant): the newest untyped row takes the variant of its flag unless a typed row has it."""
    typed = df.where("variant IS NOT NULL")
    bare = latest(df.where("variant IS NULL"), ["interaction_id", "engine"], F.desc("created_at"), F.col("row_id"))
    named = bare.withColumn("variant", F.when(F.col("is_final"), "final").otherwise("draft"))
    kept = named.join(typed.select("interaction_id", "engine", "variant").distinct(), ["interaction_id", "engine", "variant"], "left_anti")
    return latest(typed.unionByName(kept), ["interaction_id", "engine", "variant"], F.desc("created_at"), F.col("row_id"))


def dedupe_contacts(contacts: DataFrame, order: str = "created_at") -> DataFrame:
    """The contact that came first for each phone; contacts without one all stay."""
    return latest(contacts.where("phone IS NOT NULL"), ["phone"], F.col(order), F.col("id")).unionByName(contacts.where("phone IS NULL"))


def validate_ids(df: DataFrame, column: str = "interaction_id") -> DataFrame:
    """Issues of an id: not ASCII, a prefix that looks alike, a wrong form; and the id it should be."""
    c = F.col(column)
    look = c.rlike("^(?i)c[1il]{2}_") & ~c.startswith("cll_")
    better = F.when(look, F.concat(F.lit("cll_"), F.substring(c, 5, 1000))).otherwise(c)
    issues = F.array_compact(F.array(F.when(c.isNull() | (c == ""), "error:empty"), F.when(~c.rlike(r"^[\x00-\x7f]*$"), "error:not_ascii"), F.when(look, "warning:confusable_prefix"), F.when(~better.rlike("^cll_[A-Za-z0-9_]+$"), "error:bad_form")))
    return df.select(column, F.concat_ws(",", issues).alias("issues"), better.alias("suggested"))


def export_scheduler_jsonl(items: DataFrame, columns: list[str]) -> DataFrame:
    """One JSON object per row, times as UTC ISO text."""
    parts = [F.date_format(c, "yyyy-MM-dd'T'HH:mm:ss'Z'").alias(c) if kind.startswith("timestamp") else F.col(c) for c, kind in items.select(*columns).dtypes]
    return items.select(F.to_json(F.struct(*parts)).alias("line"))


def materialize_action_items(interactions: DataFrame, stored: DataFrame, column: str = "items_json") -> DataFrame:
    """New action items out of a JSON array of {title, action}; the hash of both is the item's key."""
    items = interactions.select("interaction_id", "project_id", F.explode(F.from_json(column, "array<struct<title:string,action:string>>")).alias("i"))
    key = F.left(F.md5(F.concat_ws("|", F.coalesce("i.title", F.lit("")), F.coalesce("i.action", F.lit("")))), F.lit(8))
    rows = items.select("interaction_id", key.alias("item_hash"), "i.title", "i.action", "project_id", F.when(F.col("project_id").isNotNull(), "resolved").otherwise("unknown").alias("attribution_status"), F.when(F.col("project_id").isNotNull(), 0.80).alias("attribution_confidence"), F.col("project_id").isNull().alias("needs_review"))
    return rows.dropDuplicates(["interaction_id", "item_hash"]).join(stored, ["interaction_id", "item_hash"], "left_anti")


def apply_retention(df: DataFrame, time: str, flag: str, as_of: str, keep_days: int) -> DataFrame:
    """Rows that stay: those in the window, and older ones without the mark."""
    return df.where((F.col(time) >= at(as_of) - days(keep_days)) | ~F.coalesce(F.col(flag), F.lit(False)))


def extract_phone_layers(df: DataFrame, column: str = "raw_snapshot_json") -> DataFrame:
    """A phone by layers: a JSON field, else ten digits in the text that are not all one digit; as +1 and ten digits."""
    digits = F.regexp_replace(first_json(column), "[^0-9]", "")
    field = F.when(F.length(digits) >= 10, F.concat(F.lit("+1"), F.right(digits, F.lit(10))))
    found = F.filter(F.regexp_extract_all(column, F.lit(r"(?<![0-9])([0-9]{10})(?![0-9])"), F.lit(1)), lambda x: ~x.rlike(r"^([0-9])\1{9}$"))
    text = F.when(F.size(found) > 0, F.concat(F.lit("+1"), F.get(found, F.lit(0))))
    return df.select("interaction_id", F.coalesce(field, text).alias("phone"), F.when(field.isNotNull(), "field").when(text.isNotNull(), "text").otherwise("none").alias("layer"))


def live_calls(df: DataFrame, prefix: str = "cll_", excluded: tuple[str, ...] = ("cll_TEST_", "cll_SHADOW_", "cll_V4_")) -> DataFrame:
    """Ids of real calls."""
    out = df.where(F.col("interaction_id").startswith(prefix))
    for e in excluded:
        out = out.where(~F.col("interaction_id").startswith(e))
    return out.select("interaction_id").distinct()


def register_keys(events: DataFrame, keys: DataFrame) -> DataFrame:
    """The key table after a batch: first and last sight, hits, and whether the key was known or repeats."""
    new = events.groupBy("key").agg(F.min("ts").alias("_first"), F.max("ts").alias("_last"), F.count("*").alias("_n"))
    both = keys.join(new, "key", "full")
    return both.select("key", F.least("first_seen", "_first").alias("first_seen"), F.greatest("last_seen", "_last").alias("last_seen"), (F.coalesce("hit_count", F.lit(0)) + F.coalesce("_n", F.lit(0))).alias("hit_count"), (F.coalesce("hit_count", F.lit(0)) + F.coalesce("_n", F.lit(0)) > 1).alias("is_duplicate"))


def sync_parent_transcript_stats(interactions: DataFrame, spans: DataFrame, reasons: str = "review_reasons", empty: tuple[str, ...] = ("G4_EMPTY_TRANSCRIPT", "terminal_empty")) -> DataFrame:
    """Where the stored length is 0 and active spans have text: their length, without the empty-transcript reasons."""
    n = spans.where("NOT is_superseded").groupBy("interaction_id").agg(F.sum(F.col("char_end") - F.col("char_start")).alias("_n"))
    both = interactions.join(n, "interaction_id", "left")
    fix = (F.coalesce("transcript_chars", F.lit(0)) == 0) & (F.coalesce("_n", F.lit(0)) > 0)
    left = F.array_except(F.col(reasons), F.array(*map(F.lit, empty)))
    return both.select("interaction_id", F.when(fix, F.col("_n")).otherwise(F.col("transcript_chars")).cast("long").alias("transcript_chars"), F.concat_ws(",", F.when(fix, left).otherwise(F.col(reasons))).alias("reasons"), F.when(fix, F.size(left) > 0).otherwise(F.col("needs_review")).alias("needs_review"), fix.alias("synced"))


def normalize_follow_ups(items: DataFrame, most: int = 12, domain: tuple[str, ...] = ("low", "medium", "high"), longest: int = 200) -> DataFrame:
    """Per call at most ``most`` follow-ups with text, trimmed, with a priority of the domain."""
    text = F.transform(F.filter("items", lambda x: F.coalesce(F.trim(x["text"]), F.lit("")) != ""), lambda x: F.struct(F.substring(F.trim(x["text"]), 1, longest).alias("text"), F.when(F.lower(x["priority"]).isin(*domain), F.lower(x["priority"])).otherwise("medium").alias("priority")))
    return items.select("interaction_id", F.slice(text, 1, most).alias("items"))


def parse_model_outputs(raw: DataFrame, schema: str, column: str = "output") -> tuple[DataFrame, DataFrame]:
    """(good, quarantine): model text without code fences, control characters and trailing commas, read as ``schema``."""
    text = F.regexp_replace(F.col(column), r"(?s)^\s*```(?:json)?\s*|\s*```\s*$", "")
    text = F.regexp_replace(F.regexp_replace(text, r"[\x00-\x1f]", " "), r",\s*([}\]])", "$1")
    rows = raw.withColumn("_clean", text).withColumn("parsed", F.when(F.try_parse_json("_clean").isNotNull(), F.from_json("_clean", schema)))
    return rows.where("parsed IS NOT NULL").drop("_clean"), rows.where("parsed IS NULL").drop("parsed")
