"""Site-relative line dedup: drop the lines that too many pages of a host carry.

For each host, the pages that contain a line are divided by the host's pages;
a line above ``max_share`` on at least ``min_pages`` pages is boilerplate there
and leaves every page of that host. Pages with equal text count as one, so that
a page is not taken for boilerplate because it was crawled often; a template
that many different pages are made from is boilerplate. Lines are compared
without the white space around them; lines without a word are never dropped.

A host has at most (its distinct lines per page / ``max_share``) boilerplate
lines, so a row of them per host stays small however many pages it has. Pages
and lines travel as 128-bit keys; equal pages meet, and lines are counted, per
task before they are shuffled.

Defined results for odd input
    Null text stays null with 0 lines and is no page; empty text stays empty
    with one line. Very long texts are read whole. A null host is a host of its
    own. Repeated rows count as one page and each come back. A share that
    equals ``max_share`` is no boilerplate, a count that equals ``min_pages``
    may be. An empty table gives no rows. Other columns pass through
    ``clean_lines`` unchanged, whatever their names (its own start with
    ``_ld_``).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .tables import WORD, dropped, let, read, staged, text_key

TRIM = r"^[\x20\x09-\x0D]+|[\x20\x09-\x0D]+$"
MAX_SHARE, MIN_PAGES = 0.1, 5


def _keys(lines: Column) -> Column:
    """The key of each line, null for one without a word."""
    return F.transform(lines, lambda x: F.when(x.rlike(WORD), text_key(F.regexp_replace(x, TRIM, ""))))


def boilerplate(docs: DataFrame, host: str = "source", max_share: float = MAX_SHARE, min_pages: int = MIN_PAGES) -> DataFrame:
    """One row per host that has boilerplate: ``_ld_host``, ``_ld_bad`` (array of line keys)."""
    own = docs.where(F.col("text").isNotNull()).select(F.col(host).alias("h"), text_key(F.col("text")).alias("p"), F.array_compact(F.array_distinct(_keys(F.split("text", "\n", -1)))).alias("k"))
    pages = staged(own.groupBy("h", "p").agg(F.first("k").alias("k")).drop("p"), "line-pages")
    lines = pages.select("h", F.explode("k").alias("k")).groupBy("h", "k").agg(F.count("*").alias("n")).where(F.col("n") >= min_pages)
    sizes = pages.groupBy(F.col("h").alias("p")).agg(F.count("*").alias("pages"))
    often = lines.join(sizes, F.col("h").eqNullSafe(F.col("p"))).where(F.col("n") > max_share * F.col("pages"))
    bad = staged(often.groupBy(F.col("h").alias("_ld_host")).agg(F.collect_list("k").alias("_ld_bad")), "line-boilerplate")
    dropped(pages)
    return bad


def clean_lines(docs: DataFrame, host: str = "source", max_share: float = MAX_SHARE, min_pages: int = MIN_PAGES) -> DataFrame:
    """``docs`` with ``text`` cleaned, plus ``_ld_lines`` and ``_ld_dropped``."""
    bad = boilerplate(docs, host, max_share, min_pages)
    joined = docs.join(bad, docs[host].eqNullSafe(bad["_ld_host"]), "left").drop("_ld_host")
    lines = F.split("text", "\n", -1)
    # A page has few of its host's boilerplate lines: they are found once, by hashing, and only those are looked up.
    own = F.struct(lines.alias("line"), _keys(lines).alias("key"))
    kept = let(own, lambda o: let(F.array_intersect(o["key"], F.col("_ld_bad")), lambda bad: F.when(F.size(bad) == 0, o["line"]).otherwise(F.filter(o["line"], lambda x, i: ~F.coalesce(F.array_contains(bad, F.get(o["key"], i)), F.lit(False))))))
    out = joined.withColumn("_ld_kept", F.when(F.col("_ld_bad").isNotNull(), kept).otherwise(lines))
    out = out.withColumn("_ld_lines", F.when(F.col("text").isNull(), 0).otherwise(F.size(lines)).cast("long"))
    out = out.withColumn("_ld_dropped", F.when(F.col("text").isNull(), 0).otherwise(F.col("_ld_lines") - F.size("_ld_kept")).cast("long"))
    return out.withColumn("text", F.when(F.col("_ld_dropped") > 0, F.array_join("_ld_kept", "\n")).otherwise(F.col("text"))).drop("_ld_kept", "_ld_bad")


def query(spark, sf_dir: str) -> DataFrame:
    """Production parameters: a line on over 10% of a host's pages, and on 5 of them at least, goes."""
    out = clean_lines(read(spark, sf_dir, "documents").select("doc_id", "source", "text"))
    return out.select("doc_id", "source", "text", F.col("_ld_lines").alias("n_lines"), F.col("_ld_dropped").alias("n_dropped"))


SQL = r"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, source, text FROM documents),
l AS (SELECT r, doc_id, source, text, unnest(string_split(text, chr(10))) AS line, unnest(range(len(string_split(text, chr(10))))) AS i FROM d WHERE text IS NOT NULL),
k AS (SELECT *, regexp_replace(line, '^[\x20\x09-\x0D]+|[\x20\x09-\x0D]+$', '', 'g') AS core FROM l),
p AS (SELECT source, count(DISTINCT text) AS pages FROM documents GROUP BY source),
n AS (SELECT source, core, count(DISTINCT text) AS n FROM k WHERE core <> '' GROUP BY source, core),
b AS (SELECT n.source, core FROM n JOIN p ON n.source IS NOT DISTINCT FROM p.source WHERE n >= 5 AND n > 0.1 * pages),
m AS (SELECT k.*, b.core IS NOT NULL AS bad FROM k LEFT JOIN b ON k.source IS NOT DISTINCT FROM b.source AND k.core = b.core),
a AS (SELECT r, coalesce(string_agg(line, chr(10) ORDER BY i) FILTER (WHERE NOT bad), '') AS text, count(*) AS n_lines, count(*) FILTER (WHERE bad) AS n_dropped FROM m GROUP BY r)
SELECT d.doc_id, d.source, a.text, coalesce(n_lines, 0) AS n_lines, coalesce(n_dropped, 0) AS n_dropped FROM d LEFT JOIN a USING (r)
"""
