"""Source divergence audit: how far the word frequencies of sources lie apart.

Within a language, every source and the language itself give each kept term a
smoothed frequency p in parts of ``SCALE``; f = floor((p - q)^2 / q) is what a
term adds to the divergence of p from q. The audit has, for every source, its
divergence from each other source of the language and the terms that set it
apart from the language most.

Pairs are computed in a cube of (group block, group block, term block) cells.
Sources are dealt to group blocks of about ``GROUPS`` by hash, kept terms to
term blocks of about ``TERMS``. The slice of a group block and a term block is
sent to every cell that its group block is a side of; a cell has two slices,
fills them into two small dense tables and gives the partial divergence of
every pair of its groups, in both directions, over its terms. Terms that no
group of a cell has are all alike there and are counted, not sent. Partial
divergences are then added along the term axis. A cell's size does not grow
with the corpus, and a source or language with most of the rows only has
higher counts.

All arithmetic is in whole numbers and exact.

Defined results for odd input
    Null text, lang and source are read as empty strings, which are a language
    and a source like others. Rows that repeat a doc_id are documents of their
    own. A language without kept terms has N and V of 0: its pairs have value
    0 and it has no term rows. A source alone in its language has no pair
    rows. Ties of value go to the item whose UTF-8 bytes are smaller. Texts
    are read whole. An empty table gives no rows; other columns are not read.
"""

from __future__ import annotations

from collections import Counter, defaultdict
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .tables import dropped, read, staged

SCALE, GROUPS, TERMS = 1_000_000_000, 32, 4096
#: Different (language, source, term) that a task counts before it hands them on.
HELD = 400_000
#: ASCII letters make terms, lower-cased, as all bytes from 128 on do; the rest separates them.
_FOLD = bytes(b | 32 if 65 <= b <= 90 else b if 97 <= b <= 122 or b >= 128 else 32 for b in range(256))


def terms_of(raw: bytes) -> list[bytes]:
    """The terms of a UTF-8 text: ASCII delimiters split, so bytes will do."""
    return raw.translate(_FOLD).split()


def term_counts(docs: DataFrame) -> DataFrame:
    """lang, source, term (UTF-8), n, docs; every group also has one row of the empty term, with 0."""

    def count(it: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        n: dict = defaultdict(Counter)
        docs: dict = defaultdict(Counter)

        def rows() -> pd.DataFrame:
            out = [(*g, t, c, docs[g][t]) for g in n for t, c in n[g].items()]
            n.clear(), docs.clear()
            return pd.DataFrame(out, columns=["lang", "source", "term", "n", "docs"])

        for p in it:
            for lang, source, raw in zip(p["lang"], p["source"], p["text"]):
                terms = terms_of(raw)
                n[lang, source].update(terms)
                n[lang, source][b""] += 0
                docs[lang, source].update(set(terms))
            if sum(map(len, n.values())) > HELD:
                yield rows()
        yield rows()

    text = lambda c: F.coalesce(F.col(c).cast("string"), F.lit("")).alias(c)
    some = docs.select(text("lang"), text("source"), F.coalesce(F.col("text").cast("string"), F.lit("")).cast("binary").alias("text"))
    made = some.mapInPandas(count, "lang string, source string, term binary, n long, docs long")
    return made.groupBy("lang", "source", "term").agg(F.sum("n").alias("n"), F.sum("docs").alias("docs"))


def share(n: Column, total: Column, kept: Column) -> Column:
    """1 + floor(SCALE * (n + 1) / (total + kept))."""
    wide = lambda c: c.cast("decimal(19,0)")
    return F.when(kept > 0, F.lit(1) + F.call_function("div", F.lit(SCALE).cast("decimal(10,0)") * wide(n + 1), wide(total + kept)))


def apart(p: Column, q: Column) -> Column:
    return F.call_function("div", (p - q) * (p - q), q)


def cell(p: pd.DataFrame) -> pd.DataFrame:
    """Partial divergences, in both directions, of the pairs of a cell's two slices.

    Rows of an empty term are the groups: p is that of a term they don't have, ``kept`` the kept terms of the term block.
    """
    key = p[["lang", "lo", "hi"]].iloc[0]
    bare = (p["term"].str.len() == 0).to_numpy()
    groups, rest = p[bare].sort_values(["i", "source"], kind="stable"), p[~bare]
    names, side, base = groups["source"].to_numpy(), groups["i"].to_numpy(), groups["p"].to_numpy(np.int64)
    at = {g: k for k, g in enumerate(names)}
    codes, seen = pd.factorize(rest["term"])
    dense = np.repeat(base[:, None], len(seen), 1)
    dense[[at[s] for s in rest["source"]], codes] = rest["p"].to_numpy(np.int64)
    absent = int(groups["kept"].iloc[0]) - len(seen) if len(groups) else 0
    out = []
    for a in range(len(names)):
        # Within a block all others; between blocks those of the other side.
        others = np.flatnonzero(side != side[a] if key["lo"] != key["hi"] else np.arange(len(names)) != a)
        if not len(others):
            continue
        if groups["kept"].iloc[0] == 0:
            value = np.zeros(len(others), np.int64)
        else:
            q, q0 = dense[others], base[others]
            value = ((dense[a] - q) ** 2 // q).sum(1) + absent * ((base[a] - q0) ** 2 // q0)
        out += zip([names[a]] * len(others), names[others].tolist(), value.tolist())
    return pd.DataFrame([(key["lang"], *r) for r in out], columns=["lang", "source", "item", "part"])


def cube(groups: DataFrame, counted: DataFrame, kept: DataFrame, langs: DataFrame) -> DataFrame:
    """lang, source, item, value: the divergence of each source from each other of its language.

    ``groups`` has lang, source, p0; ``counted`` lang, source, term, p; ``kept`` lang, term; ``langs`` lang, kept, sources.
    """
    cut = langs.select(F.col("lang").alias("_l"), F.ceil(F.col("sources") / GROUPS).cast("int").alias("blocks"), F.greatest(F.lit(1), F.ceil(F.col("kept") / TERMS)).cast("int").alias("slabs"))
    dealt = lambda c, n: F.pmod(F.xxhash64(c), F.col(n)).cast("int")
    slabs = kept.join(cut, F.col("lang") == F.col("_l")).groupBy("lang", dealt("term", "slabs").alias("t")).agg(F.count("*").alias("kept"))
    heads = groups.join(cut, F.col("lang") == F.col("_l")).withColumn("t", F.explode(F.sequence(F.lit(0), F.col("slabs") - 1)))
    heads = heads.join(slabs, ["lang", "t"], "left").select("lang", "source", "t", "blocks", F.lit(b"").alias("term"), F.coalesce("p0", F.lit(1)).alias("p"), F.coalesce("kept", F.lit(0)).alias("kept"))
    slices = counted.join(cut, F.col("lang") == F.col("_l")).select("lang", "source", dealt("term", "slabs").alias("t"), "blocks", "term", "p", F.lit(0).cast("long").alias("kept"))
    sent = heads.unionByName(slices).withColumn("i", dealt("source", "blocks")).withColumn("j", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    sent = sent.select("lang", F.least("i", "j").alias("lo"), F.greatest("i", "j").alias("hi"), "t", "i", "source", "term", "p", "kept")
    parts = sent.groupBy("lang", "lo", "hi", "t").applyInPandas(cell, "lang string, source string, item string, part long")
    return parts.groupBy("lang", "source", "item").agg(F.sum("part").alias("value"))


def audit(docs: DataFrame, min_docs: int = 3, top: int = 200) -> DataFrame:
    """lang, source, part, item, value, rank: ``pair`` rows of all other sources and ``term`` rows of the ``top`` first terms."""
    counts = staged(term_counts(docs), "term-counts")
    kept = staged(counts.where("length(term) > 0").groupBy("lang", "term").agg(F.sum("docs").alias("docs"), F.sum("n").alias("lang_n")).where(F.col("docs") >= min_docs).drop("docs"), "kept-terms")
    own = staged(counts.join(kept, ["lang", "term"]), "kept-counts")
    sources = counts.where("length(term) = 0").groupBy("lang").agg(F.count("*").alias("sources"))
    langs = staged(sources.join(kept.groupBy("lang").agg(F.count("*").alias("kept"), F.sum("lang_n").alias("lang_total")), "lang", "left").na.fill(0), "langs")
    totals = counts.where("length(term) = 0").select("lang", "source").join(own.groupBy("lang", "source").agg(F.sum("n").alias("total")), ["lang", "source"], "left").na.fill(0, ["total"]).join(langs, "lang")
    groups = staged(totals.withColumn("p0", share(F.lit(0), F.col("total"), F.col("kept"))), "groups")
    shares = own.join(groups.select("lang", "source", "total", "kept", "lang_total"), ["lang", "source"])
    shares = shares.select("lang", "source", "term", share(F.col("n"), F.col("total"), F.col("kept")).alias("p"), share(F.col("lang_n"), F.col("lang_total"), F.col("kept")).alias("q"))
    shares = staged(shares, "shares")
    for df in (counts, own):
        dropped(df)

    rank = F.row_number().over(Window.partitionBy("lang", "source").orderBy(F.desc("value"), "item"))
    pairs = cube(groups.select("lang", "source", "p0"), shares.select("lang", "source", "term", "p"), kept.select("lang", "term"), langs.select("lang", "kept", "sources"))
    pairs = pairs.withColumn("rank", rank)
    terms = shares.where("p > q").select("lang", "source", F.col("term").cast("string").alias("item"), apart(F.col("p"), F.col("q")).alias("value")).withColumn("rank", rank).where(F.col("rank") <= top)
    made = lambda df, name: df.select("lang", "source", F.lit(name).alias("part"), "item", "value", "rank")
    return made(pairs, "pair").unionByName(made(terms, "term"))


def query(spark, sf_dir: str) -> DataFrame:
    return audit(read(spark, sf_dir, "documents"))


SQL = r"""
WITH d AS (SELECT row_number() OVER () AS id, coalesce(lang, '') AS lang, coalesce(source, '') AS source,
    regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x40\x5B-\x60\x7B-\x7F]+') AS ts FROM documents),
w AS (SELECT id, lang, source, unnest(ts) AS term FROM d),
c AS MATERIALIZED (SELECT lang, source, term, count(*) AS n, count(DISTINCT id) AS docs FROM w GROUP BY ALL),
k AS MATERIALIZED (SELECT lang, term, sum(n) AS n FROM c GROUP BY ALL HAVING sum(docs) >= 3),
l AS (SELECT lang, count(*) AS v, sum(n) AS total FROM k GROUP BY lang),
g AS (SELECT DISTINCT lang, source FROM d),
t AS (SELECT g.lang, g.source, coalesce(sum(k.n * 0 + c.n), 0) AS total FROM g LEFT JOIN c USING (lang, source) LEFT JOIN k USING (lang, term) GROUP BY ALL),
p AS MATERIALIZED (SELECT t.lang, t.source, k.term, coalesce(c.n, 0) AS n,
    CAST(1 + CAST(1000000000 AS HUGEINT) * (coalesce(c.n, 0) + 1) // (t.total + l.v) AS BIGINT) AS p, CAST(1 + CAST(1000000000 AS HUGEINT) * (k.n + 1) // (l.total + l.v) AS BIGINT) AS q
    FROM t JOIN k USING (lang) JOIN l USING (lang) LEFT JOIN c ON c.lang = t.lang AND c.source = t.source AND c.term = k.term),
f AS (SELECT a.lang, a.source, b.source AS item, sum((a.p - b.p) * (a.p - b.p) // b.p) AS value FROM p a JOIN p b ON a.lang = b.lang AND a.term = b.term AND a.source <> b.source GROUP BY ALL),
pairs AS (SELECT a.lang, a.source, 'pair' AS part, b.source AS item, CAST(coalesce(f.value, 0) AS BIGINT) AS value
    FROM g a JOIN g b ON a.lang = b.lang AND a.source <> b.source LEFT JOIN f ON f.lang = a.lang AND f.source = a.source AND f.item = b.source),
terms AS (SELECT lang, source, 'term' AS part, term AS item, (p - q) * (p - q) // q AS value FROM p WHERE n > 0 AND p > q),
r AS (SELECT *, CAST(row_number() OVER (PARTITION BY lang, source, part ORDER BY value DESC, item) AS INTEGER) AS rank FROM (SELECT * FROM pairs UNION ALL SELECT * FROM terms))
SELECT lang, source, part, item, value, rank FROM r WHERE part = 'pair' OR rank <= 200
"""
