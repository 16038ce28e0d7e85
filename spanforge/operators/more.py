"""Further operators over payloads, texts, vendors and candidates."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.basics import filled
from ..plans.match import find_terms, with_members


def normalize_payload(df: DataFrame, fields: dict[str, tuple[str, ...]], column: str = "raw_snapshot_json") -> DataFrame:
    """Each field from its column, else from the first filled JSON path of ``fields``."""
    lifted = {f: F.coalesce(*([filled(F.col(f))] if f in df.columns else []), *(filled(F.get_json_object(column, p)) for p in paths)) for f, paths in fields.items()}
    return df.select("interaction_id", *(v.alias(f) for f, v in lifted.items()))


def backfill_action_items(interactions: DataFrame, column: str = "items_json", kinds: tuple[str, ...] = ("tasks", "events", "deadlines", "reminders", "follow_ups")) -> DataFrame:
    """Items of an object of arrays, whose JSON may itself be a string in JSON; a row per item with its kind and hash."""
    item = "array<struct<title:string,action:string>>"
    schema = "struct<" + ",".join(f"{k}:{item}" for k in kinds) + ">"
    text = F.when(F.col(column).startswith('"'), F.from_json(F.concat(F.lit('{"s":'), F.col(column), F.lit("}")), "s string")["s"]).otherwise(F.col(column))
    rows = interactions.select("interaction_id", F.from_json(text, schema).alias("o"))

    def of(kind: str) -> Column:
        return F.transform(F.coalesce(F.col(f"o.{kind}"), F.array().cast(item)), lambda x: F.struct(F.lit(kind).alias("kind"), x["title"].alias("title"), x["action"].alias("action")))

    each = F.flatten(F.array(*map(of, kinds)))
    flat = rows.select("interaction_id", F.explode(each).alias("i")).select("interaction_id", "i.*")
    return flat.withColumn("item_hash", F.left(F.md5(F.concat_ws("|", F.coalesce("title", F.lit("")), F.coalesce("action", F.lit("")))), F.lit(8))).dropDuplicates(["interaction_id", "item_hash"])


def extract_compounds(text: Column, patterns: tuple[str, ...]) -> Column:
    """Distinct phrases of several kinds, each a pattern with one group, in lower case."""
    out = F.array().cast("array<string>")
    for p in patterns:
        out = F.array_union(out, F.regexp_extract_all(F.lower(text), F.lit(p), F.lit(1)))
    return out


def search_variants(terms: DataFrame, rules: DataFrame, most: int = 24) -> DataFrame:
    """Terms of a span with the spellings that rewrite rules (found, put) add, at most ``most``; the terms first."""
    own = terms.select("span_id", "term", F.lit(0).alias("_o"))
    made = terms.join(rules, F.contains("term", F.col("found"))).select("span_id", F.replace("term", F.col("found"), F.col("put")).alias("term"), F.lit(1).alias("_o"))
    best = own.unionByName(made).groupBy("span_id", "term").agg(F.min("_o").alias("_o"))
    return best.withColumn("_n", F.row_number().over(Window.partitionBy("span_id").orderBy("_o", "term"))).where(F.col("_n") <= most).select("span_id", "term", (F.col("_o") == 1).alias("is_variant"))


def filter_overhead_mentions(matches: DataFrame, words: tuple[str, ...], anchors: DataFrame, reach: int = 50) -> DataFrame:
    """Location matches (text, term, start from 1) with whether an overhead word within ``reach`` makes them one.

    A company's anchor city counts with any overhead word near it; another place only with the definite ones of ``words``.
    """
    near = F.lower(F.substring(F.col("text"), F.greatest(F.lit(1), F.col("start") - reach), F.length("term") + 2 * reach))
    rows = matches.join(anchors.select(F.lower("city").alias("_c")).distinct().withColumn("_anchor", F.lit(True)), F.lower("term") == F.col("_c"), "left")
    definite = F.exists(F.array(*(F.lit(f"the {w}") for w in words)), lambda w: F.contains(near, w))
    any_word = F.exists(F.array(*map(F.lit, words)), lambda w: F.contains(near, w))
    return rows.withColumn("is_overhead", definite | (F.col("_anchor").isNotNull() & any_word)).drop("_c", "_anchor")


def resolve_transcript_speakers(labels: DataFrame, resolved: DataFrame, links: DataFrame, floater: int = 3) -> DataFrame:
    """Speakers of a call with their contact, its projects and whether it floats."""
    n = links.groupBy("contact_id").agg(F.countDistinct("project_id").alias("n_projects"), F.concat_ws(",", F.array_sort(F.collect_set("project_id"))).alias("project_ids"))
    rows = labels.join(resolved.select(F.col("label").alias("speaker"), "contact_id", "quality"), "speaker", "left").join(n, "contact_id", "left")
    return rows.select("interaction_id", "speaker", "contact_id", "quality", F.coalesce("n_projects", F.lit(0)).alias("n_projects"), F.coalesce(F.col("n_projects") >= floater, F.lit(False)).alias("floater"), F.coalesce("project_ids", F.lit("")).alias("project_ids"))


def other_party_trade(speakers: DataFrame, contacts: DataFrame, links: DataFrame, score: float = 0.18) -> DataFrame:
    """Active projects of the trade of a call's other speakers, who are found by whole-word names."""
    terms = contacts.where("trade IS NOT NULL").select(F.col("name").alias("term"), "trade").distinct()
    named = find_terms(speakers.select(F.col("speaker").alias("text"), "span_id"), terms, "span_id").groupBy("span_id").agg(F.array_sort(F.collect_set("trade")).alias("_trades"))
    # Spans name few sets of trades: the projects of each are made distinct once, and what a span gets is not exchanged.
    of = links.where("is_active").select("trade", "project_id").distinct()
    each = named.select("_trades").distinct().withColumn("trade", F.explode("_trades")).join(of, "trade").select("_trades", "project_id").distinct()
    return with_members(named, "span_id", each, "_trades", "project_id").select("span_id", "project_id", F.lit(score).alias("score"))


def candidate_sources_report(runs: DataFrame, claims: DataFrame) -> DataFrame:
    """Candidate projects of each run by where they come from: its configuration or its claims."""
    config = runs.select("run_id", F.explode("candidate_ids").alias("project_id"), F.lit("run_config").alias("origin"))
    made = claims.where("project_id IS NOT NULL").select("run_id", "project_id", F.lit("claims").alias("origin"))
    return config.unionByName(made).groupBy("run_id", "origin").agg(F.countDistinct("project_id").alias("n"))


def vendor_cost_codes(lines: DataFrame) -> DataFrame:
    """Vendors with their ordered distinct codes and divisions."""
    return lines.groupBy("vendor_id").agg(F.concat_ws(",", F.array_sort(F.collect_set(F.trim("code")))).alias("codes"), F.countDistinct(F.trim("code")).alias("n_codes"), F.concat_ws(",", F.array_sort(F.collect_set(F.substring(F.trim("code"), 1, 2)))).alias("divisions"))


def resolved_vendors(vendors: DataFrame, codes: DataFrame, tiers: dict[str, int]) -> DataFrame:
    """Vendors with their codes and a tier by how many codes they have."""
    tier = F
    for name, least in sorted(tiers.items(), key=lambda kv: -kv[1]):
        tier = tier.when(F.coalesce("n_codes", F.lit(0)) >= least, name)
    return vendors.join(codes, "vendor_id", "left").select("vendor_id", "name", F.coalesce("codes", F.lit("")).alias("codes"), tier.otherwise("none").alias("tier"))


def transcript_dup_metrics(df: DataFrame) -> DataFrame:
    """Per engine: rows, distinct (call, variant) and rows over."""
    n = df.groupBy("engine", "interaction_id", "variant").agg(F.count("*").alias("n"))
    return n.groupBy("engine").agg(F.sum("n").alias("rows"), F.count("*").alias("keys"), F.sum(F.col("n") - 1).alias("surplus"), F.max("n").alias("most"))


def owner_identity_metrics(calls: DataFrame) -> DataFrame:
    """Calls by direction and version with how many lack an owner or other party phone."""
    return calls.groupBy("direction", "pipeline_version").agg(F.count("*").alias("calls"), F.count_if(filled(F.col("owner_phone")).isNull()).alias("no_owner_phone"), F.count_if(filled(F.col("other_party_phone")).isNull()).alias("no_other_phone"))


def call_tasks_as_items(tasks: DataFrame, zone: str) -> DataFrame:
    """Tasks as scheduler items: the local due time in UTC and a hash as id."""
    return tasks.select("interaction_id", "title", F.to_utc_timestamp(F.col("due_local").cast("timestamp"), zone).cast("timestamp_ntz").alias("due_at"), F.md5(F.concat_ws("|", "interaction_id", "title")).alias("item_hash"))


def project_timeline(*parts: DataFrame) -> DataFrame:
    """Events of several kinds (project_id, kind, at, ref) as one, with their place in the project."""
    rows = parts[0].select("project_id", "kind", "at", "ref")
    for p in parts[1:]:
        rows = rows.unionByName(p.select("project_id", "kind", "at", "ref"))
    return rows.where("project_id IS NOT NULL").withColumn("nth", F.row_number().over(Window.partitionBy("project_id").orderBy("at", "kind", "ref")))
