"""Host-level quality rules: document rules, then a verdict on each host.

Every document gets rule counts and a verdict on its own text. Failures are
added up by host; each host's failure rate is shrunk towards the rate of all
hosts with a beta prior fitted to the hosts' rates by moments, and a document
of a host whose shrunk rate is above ``max_host_rate`` is rejected as well.

Defined results for odd input
    Null or empty text: no words, so ``base_failed``. Very long texts are
    measured whole. A null host is a host of its own. Repeated rows count each
    time and each get their row back. A rate that equals ``max_host_rate``, and
    a share that equals its rule's limit, passes. An empty table gives no rows.
    ``judge`` neither reads nor returns extra columns; one named like a result
    is ignored. ``keep_good`` returns all (its own start with ``_bad_`` and
    ``_own_``).
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .tables import WORD, let, staged, text_key

#: The characters that count as symbols.
SYMBOLS = "#*$%&|<>"
SPACE = " \t\n\x0b\f\r"


@dataclass(frozen=True)
class Rules:
    min_words: int = 10
    max_repeat_percent: int = 20
    #: Rules that count only towards a host's failures.
    max_symbol_percent: int = 10
    max_dup_line_percent: int = 50
    #: A host is rejected when its shrunk failure rate is above this.
    max_host_rate: float = 0.5
    window: int = 5


def repeated_words(words: Column, k: int) -> Column:
    """Words inside k-word windows that occur twice or more in ``words``."""

    def grams(hashes: Column) -> Column:
        return F.transform(F.sequence(F.lit(0), F.size(hashes) - k), lambda i: F.xxhash64(*(hashes[i + j] for j in range(k))))

    def covered(g: Column) -> Column:
        order = F.array_sort(F.transform(g, lambda h, i: F.struct(h.alias("h"), i.alias("i"))))

        def of(s: Column) -> Column:
            same = lambda x, i, j: F.coalesce(F.get(s, j)["h"] == x["h"], F.lit(False))
            starts = F.array_sort(F.transform(F.filter(s, lambda x, i: same(x, i, i - 1) | same(x, i, i + 1)), lambda x: x["i"]))
            start = F.struct(F.lit(-k).alias("last"), F.lit(0).alias("n"))
            return F.aggregate(starts, start, lambda a, x: F.struct(x.alias("last"), (a["n"] + F.least(F.lit(k), x - a["last"])).alias("n")), lambda a: a["n"])

        return let(order, of)

    counted = let(F.transform(words, lambda w: F.xxhash64(w)), lambda h: let(grams(h), lambda g: F.when(F.size(F.array_distinct(g)) < F.size(g), covered(g)).otherwise(0)))
    return F.when(F.size(words) >= k, counted).otherwise(0).cast("long")


def measured(docs: DataFrame, host: str = "source", rules: Rules = Rules()) -> DataFrame:
    """doc_id, host, a key of the text and the rule counts of each row's whole text."""
    text = F.coalesce(F.col("text"), F.lit(""))
    lines = F.filter(F.split("t", "\n", -1), lambda x: x.rlike(WORD))
    words = docs.select("doc_id", F.col(host).alias("host"), text.alias("t")).select("*", F.regexp_extract_all("t", F.lit(f"({WORD})"), F.lit(1)).alias("w"), lines.alias("l"))
    out = words.select(
        "doc_id",
        "host",
        text_key(F.col("t")).alias("text_key"),
        F.size("w").cast("long").alias("n_words"),
        F.length(F.translate("t", SPACE, "")).cast("long").alias("word_chars"),
        (F.length("t") - F.length(F.translate("t", SYMBOLS, ""))).cast("long").alias("n_symbols"),
        F.size("l").cast("long").alias("n_lines"),
        (F.size("l") - F.size(F.array_distinct("l"))).cast("long").alias("n_dup_lines"),
        repeated_words(F.col("w"), rules.window).alias("n_repeat_words"),
    )
    base = (F.col("n_words") < rules.min_words) | (100 * F.col("n_repeat_words") > rules.max_repeat_percent * F.col("n_words"))
    soft = (100 * F.col("n_symbols") > rules.max_symbol_percent * F.col("word_chars")) | (100 * F.col("n_dup_lines") > rules.max_dup_line_percent * F.col("n_lines"))
    return out.withColumn("base_failed", base).withColumn("any_failed", base | soft)


def host_verdicts(rows: DataFrame, rules: Rules = Rules()) -> DataFrame:
    """host, pages, failures, shrunk rate and ``host_ok`` from measured rows."""
    hosts = rows.groupBy("host").agg(F.count("*").alias("pages"), F.count_if("any_failed").alias("failures")).withColumn("rate", F.col("failures") / F.col("pages"))
    # Moments over hosts, each host weighted by its pages.
    n, m = F.sum("pages"), F.sum("failures") / F.sum("pages")
    moments = hosts.agg(m.alias("mean"), (F.sum(F.col("pages") * F.col("rate") * F.col("rate")) / n - m * m).alias("var"))
    strength = F.when(F.col("var") > 0, F.greatest(F.lit(1.0), F.least(F.lit(1e4), F.col("mean") * (1 - F.col("mean")) / F.col("var") - 1))).otherwise(F.lit(1e4))
    prior = moments.select("mean", strength.alias("strength"))  # one row
    shrunk = (F.col("failures") + F.col("mean") * F.col("strength")) / (F.col("pages") + F.col("strength"))
    return hosts.crossJoin(F.broadcast(prior)).select("host", "pages", "failures", shrunk.alias("shrunk_rate"), (shrunk <= rules.max_host_rate).alias("host_ok"))


def judge(docs: DataFrame, host: str = "source", rules: Rules = Rules()) -> DataFrame:
    """doc_id, host, counts, base_failed, kept for every row of ``docs``.

    The counts are written once, as narrow rows: they are read for the hosts
    and again for the documents. The join to the hosts is on a table of known
    size, so it is broadcast only when that is small and else sorted, where
    adaptive execution splits a hot host.
    """
    rows = staged(measured(docs, host, rules), "quality-rows")
    hosts = staged(host_verdicts(rows, rules).select(F.col("host").alias("h"), "host_ok"), "quality-hosts")
    out = rows.join(hosts, rows["host"].eqNullSafe(hosts["h"]), "left")
    return out.withColumn("kept", ~F.col("base_failed") & F.coalesce("host_ok", F.lit(True))).drop("h")


def keep_good(docs: DataFrame, host: str = "source", rules: Rules = Rules()) -> DataFrame:
    """The rows of ``docs`` that pass, with all their columns.

    What is rejected is a text on a host, so rows that share a doc_id with a
    rejected one stay. Only the keys of rejected texts travel to the join.
    """
    bad = judge(docs, host, rules).where(~F.col("kept")).select(F.col("text_key").alias("_bad_key"), F.col("host").alias("_bad_host")).distinct()
    own = docs.withColumn("_own_key", text_key(F.coalesce(F.col("text"), F.lit(""))))
    return own.join(bad, (own["_own_key"] == bad["_bad_key"]) & own[host].eqNullSafe(bad["_bad_host"]), "left_anti").drop("_own_key")


def query(spark, sf_dir: str) -> DataFrame:
    from .tables import read

    return judge(read(spark, sf_dir, "documents")).select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")


SQL = r"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, source, coalesce(text, '') AS t FROM documents),
w AS (SELECT *, regexp_extract_all(t, '[^\x20\x09-\x0D]+') AS w, list_filter(string_split(t, chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS l FROM d),
g AS (SELECT r, i, [w[i], w[i+1], w[i+2], w[i+3], w[i+4]] AS g FROM (SELECT r, w, unnest(range(1, len(w) - 3)) AS i FROM w)),
twice AS (SELECT r, i FROM (SELECT r, i, count(*) OVER (PARTITION BY r, g) AS n FROM g) WHERE n > 1),
rep AS (SELECT r, count(DISTINCT i + j) AS n FROM twice, range(0, 5) AS s(j) GROUP BY r),
m AS (SELECT w.r, doc_id, source, CAST(len(w) AS BIGINT) AS n_words,
    CAST(length(regexp_replace(t, '[\x20\x09-\x0D]+', '', 'g')) AS BIGINT) AS word_chars,
    CAST(length(t) - length(regexp_replace(t, '[#*$%&|<>]+', '', 'g')) AS BIGINT) AS n_symbols,
    CAST(len(l) - len(list_distinct(l)) AS BIGINT) AS n_dup_lines, len(l) AS n_lines,
    CAST(coalesce(rep.n, 0) AS BIGINT) AS n_repeat_words FROM w LEFT JOIN rep USING (r)),
f AS (SELECT *, n_words < 10 OR 100 * n_repeat_words > 20 * n_words AS base_failed,
    100 * n_symbols > 10 * word_chars OR 100 * n_dup_lines > 50 * n_lines AS soft FROM m),
h AS (SELECT source AS host, count(*) AS pages, count(*) FILTER (WHERE base_failed OR soft) AS failures FROM f GROUP BY source),
p AS (SELECT sum(failures) / sum(pages) AS mean, sum(pages * (failures / pages) * (failures / pages)) / sum(pages) - (sum(failures) / sum(pages)) * (sum(failures) / sum(pages)) AS var FROM h),
s AS (SELECT mean, CASE WHEN var > 0 THEN greatest(1.0, least(1e4, mean * (1 - mean) / var - 1)) ELSE 1e4 END AS k FROM p)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
    NOT base_failed AND (failures + mean * k) / (pages + k) <= 0.5 AS kept
FROM f JOIN h ON f.source IS NOT DISTINCT FROM h.host CROSS JOIN s
"""
