"""The guard on facts that a proposal refers to."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.basics import latest

#: Kinds of facts that anchor by themselves, words that say little, and words that deny what follows.
STRONG_KINDS = "address alias client scope material finish feature model serial room lot unit".split()
LOW_SIGNAL = "project house home build phase status update pending active call notes unknown none".split()
NEGATIONS = "not no never without isn't isnt aren't arent wasn't wasnt weren't werent".split()
ADDRESS = r"(?i)\b\d{2,6}\s+[a-z0-9'.-]+(\s+[a-z0-9'.-]+){0,3}\s+(st|street|ave|avenue|blvd|boulevard|rd|road|dr|drive|ln|lane|ct|court|cir|circle|pl|place|way|pkwy|parkway)\b"


def _tokens(text: Column) -> Column:
    return F.regexp_extract_all(F.lower(text), F.lit("([a-z0-9-]+)"))


def strong_anchor(kind: Column, payload: Column) -> Column:
    """Whether a fact can hold a decision: by its kind, an address, or a long word with a digit or a hyphen."""
    text = F.concat_ws(" ", kind, payload)
    long = F.exists(_tokens(text), lambda t: (F.length(t) >= 8) & ~t.isin(*LOW_SIGNAL) & F.regexp_like(t, F.lit("[0-9-]")))
    return F.regexp_like(F.lower(kind), F.lit("|".join(STRONG_KINDS))) | F.regexp_like(text, F.lit(ADDRESS)) | long


def matched_facts(references: DataFrame, facts: DataFrame, most: int = 20) -> DataFrame:
    """The fact each reference means: of its project and kind, at its time, else with most of its words, else the newest.

    ``references``: span_id, ref_id, project_id, fact_kind, fact_as_of_at, fact_excerpt; ``facts``: fact_id,
    project_id, fact_kind, as_of_at, fact_payload, of which the ``most`` newest of a project count. These are one
    row of at most ``most`` facts a project and kind, so a reference meets one row and takes its fact there.
    """
    newest = [F.desc("as_of_at"), F.col("fact_id")]
    pack = facts.withColumn("_n", F.row_number().over(Window.partitionBy("project_id").orderBy(*newest))).where(F.col("_n") <= most)
    pack = pack.withColumn("_text", F.lower(F.concat_ws(" ", "fact_kind", "fact_payload")))
    rest = [c for c in facts.columns if c not in ("project_id", "fact_kind")]
    packed = pack.groupBy("project_id", "fact_kind").agg(F.collect_list(F.struct("_n", "_text", *rest)).alias("_facts"))
    asked = references.withColumn("_t", F.slice(F.filter(_tokens(F.col("fact_excerpt")), lambda t: F.length(t) >= 4), 1, 6))
    same = lambda f: F.coalesce(f["as_of_at"] == F.col("fact_as_of_at"), F.lit(False))
    hits = lambda f: F.size(F.filter("_t", lambda t: F.contains(f["_text"], t)))
    met = asked.join(packed, ["project_id", "fact_kind"])
    met = met.withColumn("_best", F.array_max(F.transform("_facts", lambda f: F.struct(same(f).alias("same"), hits(f).alias("hits"), (-f["_n"]).alias("newest"), f.alias("f")))))
    met = met.select(*references.columns, F.col("_best.same").alias("_same"), F.col("_best.hits").alias("_hits"), *(F.col(f"_best.f.{c}").alias(c) for c in rest))
    return latest(met.repartition("span_id"), ["span_id", "ref_id"], F.desc("_same"), F.desc("_hits"), *newest).drop("_same")


def denied_words(texts: DataFrame, reach: int = 3) -> DataFrame:
    """span_id, denied: words that stand at most ``reach`` words after a negation, with plain words between them."""
    words = texts.where("text IS NOT NULL").select("span_id", F.filter(F.split(F.lower("text"), r"\s+"), lambda w: w != "").alias("w"))
    plain = lambda i: F.regexp_like(F.get("w", i), F.lit("^[a-z0-9_]+$"))
    negation = lambda word: F.regexp_like(word, F.lit(rf"(^|[^a-z0-9_])({'|'.join(NEGATIONS)})$"))
    reached = lambda i: F.array_compact(F.array(*(F.when(_all([plain(i + j) for j in range(1, d)]), F.get("w", i + d)) for d in range(1, reach + 1))))
    after = F.flatten(F.transform("w", lambda word, i: F.when(negation(word), reached(i)).otherwise(F.array().cast("array<string>"))))
    named = F.filter(F.transform(after, lambda x: F.regexp_extract(x, "^([a-z0-9-]*[a-z0-9])", 1)), lambda x: x != "")
    return words.select("span_id", F.explode(named).alias("token")).groupBy("span_id").agg(F.collect_set("token").alias("denied"))


def _all(conditions: list[Column]) -> Column:
    out = F.lit(True)
    for c in conditions:
        out = out & F.coalesce(c, F.lit(False))
    return out


def fact_reference_guard(proposals: DataFrame, references: DataFrame, facts: DataFrame, texts: DataFrame, most: int = 20) -> DataFrame:
    """span_id, decision, downgraded, reason_code, n_references, strong_anchor, contradiction.

    An assignment that refers to facts of its project goes to review if none of
    them is a strong anchor, or if the text denies a word of one. References to
    other projects, or to kinds that the project has no fact of, don't count.
    """
    own = references.join(proposals.select("span_id", "project_id"), ["span_id", "project_id"], "left_semi")
    # What depends on the fact alone is found once for each fact.
    signal = F.slice(F.filter(_tokens(F.concat_ws(" ", "fact_kind", "fact_payload")), lambda t: (F.length(t) >= 5) & ~t.isin(*LOW_SIGNAL)), 1, 5)
    looked = facts.withColumns({"_strong": strong_anchor(F.col("fact_kind"), F.col("fact_payload")), "_signal": signal})
    met = matched_facts(own, looked, most).join(denied_words(texts), "span_id", "left")
    sums = met.groupBy("span_id").agg(F.count("*").alias("n_references"), F.bool_or("_strong").alias("_anchor"), F.bool_or(F.arrays_overlap("_signal", "denied")).alias("_denied"))
    rows = proposals.join(sums, "span_id", "left")
    n, anchor, no = F.coalesce("n_references", F.lit(0)), F.coalesce("_anchor", F.lit(False)), F.coalesce("_denied", F.lit(False)) & F.col("n_references").isNotNull()
    down = (F.col("decision") == "assign") & (n > 0) & (~anchor | no)
    reason = F.when(down & no, "world_model_fact_contradiction").when(down, "world_model_fact_weak_only")
    return rows.select("span_id", F.when(down, "review").otherwise(F.col("decision")).alias("decision"), down.alias("downgraded"), reason.alias("reason_code"), n.alias("n_references"), anchor.alias("strong_anchor"), no.alias("contradiction"))
