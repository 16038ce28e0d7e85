"""Cutting transcripts into contiguous spans, and pointers into them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def segment_even(texts: DataFrame, key: str, most: int) -> DataFrame:
    """ceil(length / most) even chunks of each text; one empty span for an empty one."""
    n = F.length(F.coalesce("text", F.lit("")))
    k = F.greatest(F.lit(1), F.ceil(n / most)).cast("int")
    rows = texts.select(key, "text", n.alias("_n"), k.alias("_k"), F.explode(F.sequence(F.lit(0), k - 1)).alias("span_index"))
    edge = lambda i: F.floor(F.col("_n") * i / F.col("_k")).cast("int")
    return rows.select(key, "span_index", edge(F.col("span_index")).alias("char_start"), edge(F.col("span_index") + 1).alias("char_end"))


def enforce_max_chars(spans: DataFrame, key: str, most: int) -> DataFrame:
    """Spans over ``most`` are split evenly and tagged; spans are numbered again."""
    size = F.col("char_end") - F.col("char_start")
    k = F.greatest(F.lit(1), F.ceil(size / most)).cast("int")
    rows = spans.select(key, "char_start", "char_end", k.alias("_k"), F.explode(F.sequence(F.lit(0), k - 1)).alias("_i"))
    edge = lambda i: (F.col("char_start") + F.floor((F.col("char_end") - F.col("char_start")) * i / F.col("_k"))).cast("int")
    out = rows.select(key, edge(F.col("_i")).alias("char_start"), edge(F.col("_i") + 1).alias("char_end"), F.when(F.col("_k") > 1, "oversize_split").otherwise("kept").alias("reason"))
    return out.withColumn("span_index", F.row_number().over(Window.partitionBy(key).orderBy("char_start", "char_end")) - 1)


def normalize_boundaries(proposed: DataFrame, key: str, shortest: int = 200, most_spans: int = 10) -> DataFrame:
    """A contiguous cover of [0, length) from proposed (start, confidence) cuts.

    Cuts are clamped and sorted; a cut less than ``shortest`` after the last
    kept one, or before the end, is dropped; of more than ``most_spans`` the
    least confident cuts go, the later of equals first. ``proposed`` has key,
    length and cuts, an array of (start, confidence); cuts per call are few.
    """
    inside = F.filter(F.array_sort(F.transform("cuts", lambda c: F.struct(F.greatest(F.lit(0), F.least(F.col("length"), c["start"])).alias("start"), c["confidence"].alias("confidence")))), lambda c: (c["start"] > 0) & (c["start"] <= F.col("length") - shortest))
    zero = F.expr("cast(array() as array<struct<start:int,confidence:double>>)")
    kept = F.aggregate(inside, zero, lambda a, c: F.when(c["start"] - F.coalesce(F.try_element_at(a, F.lit(-1))["start"], F.lit(0)) >= shortest, F.concat(a, F.array(F.struct(c["start"].cast("int").alias("start"), c["confidence"].cast("double").alias("confidence"))))).otherwise(a))
    strong = F.slice(F.array_sort(F.transform("_kept", lambda c: F.struct((-c["confidence"]).alias("x"), c["start"].alias("start")))), 1, most_spans - 1)
    rows = proposed.withColumn("_kept", kept).withColumn("_s", F.concat(F.array(F.lit(0)), F.array_sort(F.transform(strong, lambda c: c["start"]))))
    ends = F.concat(F.slice("_s", 2, F.size("_s")), F.array(F.col("length").cast("int")))
    cut = rows.select(key, F.posexplode(F.arrays_zip(F.col("_s").alias("char_start"), ends.alias("char_end"))).alias("span_index", "_z"))
    return cut.select(key, "span_index", "_z.char_start", "_z.char_end")


def split_natural(spans: DataFrame, key: str, target: int, reach: int = 280) -> DataFrame:
    """Cuts near every ``target`` characters: after the nearest newline or sentence end, else white space, else there.

    ``spans`` has key and text. A fold carries the cursor; candidates are only
    looked for within ``reach`` of the next target.
    """
    n = F.length("text")

    def next_cut(cursor: Column) -> Column:
        want = cursor + target
        window = F.substring(F.col("text"), want - reach + 1, F.lit(2 * reach))
        before, after = F.substring(window, 1, reach), F.substring(window, reach + 1, 2 * reach)
        # Of each half only the place nearest to the target is looked for.
        last = lambda p: F.length(F.regexp_extract(before, f"(?s)^.*{p}", 0))
        first = lambda p: F.length(F.regexp_extract(after, f"(?s)^.*?{p}", 0))
        place = lambda gap, at: F.when(gap, F.struct(F.abs(at).alias("d"), (want + at).alias("at")))
        best = lambda p: F.array_min(F.array(place(last(p) > 0, last(p) - reach), place(first(p) > 0, first(p))))["at"]
        return F.coalesce(best(r"[\n.!?]"), best(r"\s"), want)

    steps = F.sequence(F.lit(1), F.greatest(F.lit(1), F.ceil(n / (target - reach)).cast("int")))
    cuts = F.aggregate(steps, F.array(F.lit(0)), lambda a, _: F.when(F.element_at(a, -1) + target + reach < n, F.concat(a, F.array(next_cut(F.element_at(a, -1)).cast("int")))).otherwise(a))
    rows = spans.select(key, n.alias("_n"), cuts.alias("_s"))
    ends = F.concat(F.slice("_s", 2, F.size("_s")), F.array(F.col("_n").cast("int")))
    return rows.select(key, F.posexplode(F.arrays_zip(F.col("_s").alias("char_start"), ends.alias("char_end"))).alias("span_index", "_z")).select(key, "span_index", "_z.char_start", "_z.char_end")


def retry_split_policy(texts: DataFrame, n_spans: DataFrame, key: str, long_chars: int = 2000, per: int = 5000, most: int = 10) -> DataFrame:
    """Long texts that came as one span are cut into equal parts with confidence 0.5."""
    n = F.length("text")
    again = texts.join(n_spans.where("n = 1"), key).where(n > long_chars)
    k = F.greatest(F.lit(2), F.least(F.lit(most), F.ceil(n / per))).cast("int")
    rows = again.select(key, n.alias("_n"), k.alias("_k"), F.explode(F.sequence(F.lit(0), k - 1)).alias("span_index"))
    edge = lambda i: F.floor(F.col("_n") * i / F.col("_k")).cast("int")
    return rows.select(key, "span_index", edge(F.col("span_index")).alias("char_start"), edge(F.col("span_index") + 1).alias("char_end"), F.lit(0.5).alias("confidence"))


def locate_claim_pointers(claims: DataFrame) -> DataFrame:
    """char_start, char_end and hash of a claim's text in its transcript, by fallbacks.

    The whole text, its first 30 characters, then the first 25 with white space
    taken as one, without punctuation, and without speaker labels. Positions of
    the last three are in the cleaned text, which ``pointer_basis`` names.
    """
    t, c = F.lower("transcript"), F.lower(F.trim("claim_text"))
    flat = lambda x: F.regexp_replace(x, r"\s+", " ")
    bare = lambda x: F.regexp_replace(x, r"[^a-z0-9 ]", "")
    plain = lambda x: F.regexp_replace(x, r"(?m)^[a-z .'-]{1,41}:\s*", "")
    head = lambda x, n: F.substring(x, 1, n)
    tries = [("text", t, c), ("text", t, head(c, 30)), ("whitespace", flat(t), head(flat(c), 25)), ("punctuation", bare(flat(t)), head(bare(flat(c)), 25)), ("labels", flat(plain(t)), head(flat(plain(c)), 25))]
    at, basis, size = F, F, F
    for name, hay, needle in tries:
        hit = (needle != "") & F.contains(hay, needle)
        at, basis, size = at.when(hit, F.instr(hay, needle)), basis.when(hit, name), size.when(hit, F.length(needle))
    return claims.select("claim_id", (at - 1).alias("char_start"), (at - 1 + size).alias("char_end"), basis.alias("pointer_basis"), F.when(at.isNotNull(), F.md5("claim_text")).alias("span_hash"))


def recompute_pointers(claims: DataFrame) -> DataFrame:
    """The exact position of what follows the first colon of a claim, without leading dots."""
    c = F.lower(F.trim(F.regexp_replace(F.regexp_replace("claim_text", r"^[^:]*:", ""), r"^\s*\.+", "")))
    at = F.when(c != "", F.nullif(F.instr(F.lower("transcript"), c), F.lit(0)))
    return claims.select("claim_id", (at - 1).alias("char_start"), (at - 1 + F.length(c)).alias("char_end"))


def span_hash(text: Column) -> Column:
    return F.md5(text)


def validate_span(text: Column, start: Column, end: Column, expected: Column) -> Column:
    """Whether the characters at [start, end) are the expected text, case aside."""
    return F.lower(F.substring(text, start + 1, end - start)) == F.lower(expected)


def reseed(spans: DataFrame, new_spans: DataFrame, attributions: DataFrame) -> dict[str, DataFrame]:
    """The next generation of spans, human locks carried to the span of the same index, and locks lost."""
    gen = spans.groupBy("interaction_id").agg((F.max("segment_generation") + 1).alias("segment_generation"))
    fresh = new_spans.join(gen, "interaction_id", "left").withColumn("segment_generation", F.coalesce("segment_generation", F.lit(1))).withColumn("is_superseded", F.lit(False))
    old = spans.join(new_spans.select("interaction_id").distinct(), "interaction_id", "left_semi").withColumn("is_superseded", F.lit(True))
    live = spans.where("NOT is_superseded").select("span_id", "interaction_id", "span_index")
    locks = attributions.where("attribution_lock = 'human'").select("span_id", "project_id").join(live, "span_id").select("interaction_id", "span_index", "project_id").distinct().join(new_spans.select("interaction_id").distinct(), "interaction_id", "left_semi")
    carried = locks.join(fresh.select("interaction_id", "span_index", F.col("span_id").alias("new_span_id")), ["interaction_id", "span_index"])
    lost = locks.join(fresh.select("interaction_id", "span_index"), ["interaction_id", "span_index"], "left_anti")
    return {"spans": old.unionByName(fresh, allowMissingColumns=True), "locks": carried.withColumn("decision", F.lit("assign")).withColumn("confidence", F.lit(1.0)), "lost": lost}


def unsegmented(interactions: DataFrame, spans: DataFrame) -> DataFrame:
    return interactions.join(spans, "interaction_id", "left_anti").select("interaction_id")


def expected_min_spans(length: Column) -> Column:
    return F.when(length <= 2000, 1).when(length <= 6000, 2).when(length <= 12000, 3).otherwise(4)


def boundary_quotes(spans: DataFrame, terms: DataFrame, text: str = "text", width: int = 80) -> DataFrame:
    """For each anchor term of a call the first span that has it, with the text around it."""
    low = F.lower(text)
    rows = spans.join(terms, "interaction_id").withColumn("_at", F.instr(low, F.lower("term"))).where("_at > 0")
    first = rows.withColumn("_n", F.row_number().over(Window.partitionBy("interaction_id", "term").orderBy("span_index"))).where("_n = 1")
    return first.select("interaction_id", "term", "span_index", F.substring(F.col(text), F.greatest(F.lit(1), F.col("_at") - 20), F.lit(width)).alias("quote"))
