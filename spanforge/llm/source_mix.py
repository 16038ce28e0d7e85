"""Mixing sources to target weights by Pareto order sampling.

A source's target is its share, by weight, of the words of all sources, at most
``max_copies`` times its own words; what is over is shared again by weight
(:func:`targets`). The whole part of target over words is the number of copies
that every document of the source gets for certain. For the fraction f, a
document's inclusion odds are the odds of f times its own weight (by default
:func:`length_weight`, which lets short documents in less often); documents are
ranked by their random odds over their inclusion odds, and the first get one
more copy until the words taken come nearest to the target.

The ranking of a source is never done in one task: documents are dealt to
``bins`` ranges of their rank, words are summed by range, and only the range in
which the target falls is ordered document by document. The targets are found
in one task over one narrow row per source.

Defined results for odd input
    Null or empty text has size 0 and takes 0 words. Very long texts are
    counted whole. A null source is a source of its own, last in order. Null,
    negative or non-finite weights count as 0: no copy beyond the certain ones.
    Ties of rank are broken by doc_id, then size; of fully equal rows any may
    be the ones before the cut. An empty table gives no rows. Reruns agree: the
    random number is a hash of doc_id and ``seed``. Columns of the input are
    kept by ``mix``; the library's own start with ``_mx_``.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .tables import WORD, read, staged

#: The weights of the sources in order, repeating.
WEIGHTS = (1, 2, 3)


def words_of(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def length_weight(size: Column) -> Column:
    """From 0 without words towards 1: half of it at 50 words."""
    return size / (size + F.lit(50.0))


def targets(sizes: DataFrame, weights: Sequence[float] = WEIGHTS, max_copies: float = 3.0) -> DataFrame:
    """source, source_size, target from one row per source (source, source_size).

    Sources are in code-point order, null last. With the level L at which the
    targets add up to all words, a target is min(max_copies * size, weight * L):
    sources fill up in the order of size over weight, so running sums find L.
    """
    order = Window.orderBy(F.col("source").asc_nulls_last())
    w = F.element_at(F.array(*map(F.lit, map(float, weights))), (F.col("_i") % len(weights) + 1).cast("int"))
    ranked = sizes.withColumn("_i", F.row_number().over(order) - 1).withColumn("_w", w).withColumn("_cap", max_copies * F.col("source_size"))
    # Once sources before this one are at their cap, L is what is left over the weights left.
    # After the first that is not, levels only fall, so L is the largest of those.
    whole = Window.partitionBy()
    before = Window.orderBy(F.col("_cap") / F.col("_w"), "_i").rowsBetween(Window.unboundedPreceding, -1)
    left = F.sum("source_size").over(whole) - F.coalesce(F.sum("_cap").over(before), F.lit(0.0))
    level = left / (F.sum("_w").over(whole) - F.coalesce(F.sum("_w").over(before), F.lit(0.0)))
    filled = ranked.withColumn("_level", level).withColumn("_full", F.col("_cap") <= F.col("_w") * F.col("_level"))
    final = F.max(F.when(~F.col("_full"), F.col("_level"))).over(whole)
    return filled.withColumn("_final", final).select("source", "source_size", F.when(F.col("_full"), F.col("_cap")).otherwise(F.col("_w") * F.col("_final")).alias("target"))


def mix_rows(docs: DataFrame, source: str = "source", weight: str | None = None, weights: Sequence[float] = WEIGHTS, max_copies: float = 3.0, seed: int = 17, bins: int = 4096) -> DataFrame:
    """_mx_doc, _mx_source, _mx_size, _mx_source_size, _mx_target and _mx_copies for every row of ``docs``.

    ``weight`` names a column of relative inclusion odds.
    """
    size = words_of(F.col("text"))
    own = length_weight(size) if weight is None else F.col(weight).cast("double")
    own = F.when(own.isNotNull() & ~F.isnan(own) & (own > 0) & (own < float("inf")), own).otherwise(0.0)
    # 52 bits of a hash, never 0 or 1.
    unit = (F.conv(F.substring(F.md5(F.concat_ws(":", F.lit(str(seed)), F.coalesce(F.col("doc_id").cast("string"), F.lit("null")))), 1, 13), 16, 10).cast("double") + 0.5) / F.lit(float(1 << 52))
    rows = staged(docs.select(F.col("doc_id").alias("_mx_doc"), F.col(source).alias("_mx_source"), size.alias("_mx_size"), own.alias("_w"), unit.alias("_u")), "mix-sizes")
    sizes = rows.groupBy(F.col("_mx_source").alias("source")).agg(F.sum("_mx_size").alias("source_size"))
    mean = F.when(F.col("source_size") > 0, F.least(F.lit(float(max_copies)), F.col("target") / F.col("source_size"))).otherwise(0.0)
    goal = targets(sizes, weights, max_copies).withColumn("sure", F.floor(mean)).withColumn("fraction", mean - F.floor(mean)).withColumnRenamed("source", "s")
    per_source = staged(goal, "mix-sources")

    share = rows.join(per_source, F.col("_mx_source").eqNullSafe(F.col("s")), "left")
    odds = lambda p: p / (1 - p)
    drawn = (F.col("fraction") > 0) & (F.col("_mx_size") > 0) & (F.col("_w") > 0)
    # The odds of the fraction are the same for all of a source: the ranges need not have them.
    chance = odds(F.col("_u")) / F.col("_w")
    share = share.withColumn("_rank", F.when(drawn, odds(F.col("_u")) / (odds(F.col("fraction")) * F.col("_w"))))
    share = share.withColumn("_bin", F.when(drawn, F.least(F.lit(bins - 1), F.floor(F.lit(bins) * chance / (1 + chance))).cast("int")))

    sums = share.groupBy(F.col("_mx_source").alias("b_source"), F.col("_bin").alias("b")).agg(F.sum("_mx_size").alias("words"), F.max(F.col("target") - F.col("sure") * F.col("source_size")).alias("_budget")).where("b IS NOT NULL")
    run = Window.partitionBy("b_source").orderBy("b").rowsBetween(Window.unboundedPreceding, -1)
    cut = sums.withColumn("_before", F.coalesce(F.sum("words").over(run), F.lit(0))).where(F.col("_before") + F.col("words") >= F.col("_budget"))
    cut = cut.groupBy("b_source").agg(F.min_by(F.struct("b", "_before", "_budget"), "b").alias("at"))
    cut = staged(cut.select(F.col("b_source").alias("c_source"), "at.b", "at._before", "at._budget"), "mix-cuts")

    placed = share.join(cut, F.col("_mx_source").eqNullSafe(F.col("c_source")), "left")
    inside = placed.where(F.col("_bin") == F.col("b"))
    place = Window.partitionBy("_mx_source").orderBy("_rank", "_mx_doc", "_mx_size")
    upto = F.col("_before") + F.sum("_mx_size").over(place.rowsBetween(Window.unboundedPreceding, 0))
    # The document on which the budget falls is taken if that comes nearer to it.
    near = inside.withColumn("_extra", (2 * upto - F.col("_mx_size") < 2 * F.col("_budget")).cast("int"))
    rest = placed.where(~F.coalesce(F.col("_bin") == F.col("b"), F.lit(False))).withColumn("_extra", F.when(F.col("_bin").isNotNull() & (F.col("b").isNull() | (F.col("_bin") < F.col("b"))), 1).otherwise(0))
    both = near.unionByName(rest)
    return both.select("_mx_doc", "_mx_source", "_mx_size", F.col("source_size").alias("_mx_source_size"), F.col("target").alias("_mx_target"), (F.col("sure") + F.col("_extra")).cast("int").alias("_mx_copies"))


def mix(docs: DataFrame, source: str = "source", **how) -> DataFrame:
    """The mixed rows: each row of ``docs`` as often as the mix takes it, all columns kept.

    Rows are matched by doc_id, source and size. Of rows equal in all three
    some may be before the cut and others after it; that happens to one such
    group of a source at most, whose rows are then numbered.
    """
    key = ["_mx_doc", "_mx_source", "_mx_size"]
    taken = mix_rows(docs, source, **how).groupBy(*key).agg(F.min("_mx_copies").alias("_mx_least"), F.sum("_mx_copies").alias("_mx_all"), F.count("*").alias("_mx_n")).where("_mx_all > 0")
    sized = docs.withColumn("_mx_own", words_of(F.col("text")))
    on = sized["doc_id"].eqNullSafe(taken["_mx_doc"]) & sized[source].eqNullSafe(taken["_mx_source"]) & (sized["_mx_own"] == taken["_mx_size"])
    met = staged(sized.join(taken, on), "mix-taken")
    more = F.col("_mx_all") - F.col("_mx_n") * F.col("_mx_least")
    split = met.where(more > 0).withColumn("_mx_copies", F.col("_mx_least") + (F.row_number().over(Window.partitionBy(*key).orderBy("text")) <= more).cast("int"))
    out = met.where(more == 0).withColumn("_mx_copies", F.col("_mx_least")).unionByName(split).where("_mx_copies > 0")
    return out.withColumn("_mx_i", F.explode(F.sequence(F.lit(1), F.col("_mx_copies")))).select(*docs.columns)


def query(spark, sf_dir: str) -> DataFrame:
    out = mix_rows(read(spark, sf_dir, "documents"))
    return out.select(F.col("_mx_doc").alias("doc_id"), F.col("_mx_size").alias("size"), F.col("_mx_source_size").alias("source_size"), F.col("_mx_target").alias("target"), (F.col("_mx_copies") * F.col("_mx_size")).alias("taken"), F.col("_mx_source").alias("source"))


SQL = r"""
WITH d AS (SELECT doc_id, source, CAST(len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) AS BIGINT) AS size,
    (CAST(('0x' || substr(md5('17:' || coalesce(CAST(doc_id AS VARCHAR), 'null')), 1, 13)) AS BIGINT) + 0.5::DOUBLE) / 4503599627370496.0::DOUBLE AS u FROM documents),
s AS (SELECT source, CAST(sum(size) AS BIGINT) AS source_size FROM d GROUP BY source),
r AS (SELECT *, row_number() OVER (ORDER BY source ASC NULLS LAST) - 1 AS i FROM s),
w AS (SELECT *, CAST(i % 3 + 1 AS DOUBLE) AS w, 3.0::DOUBLE * source_size AS cap FROM r),
l AS (SELECT *, (sum(source_size) OVER () - coalesce(sum(cap) OVER b, 0)) / (sum(w) OVER () - coalesce(sum(w) OVER b, 0)) AS level FROM w
    WINDOW b AS (ORDER BY cap / w, i ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
t AS (SELECT source, source_size, CASE WHEN cap <= w * level THEN cap ELSE w * max(CASE WHEN cap > w * level THEN level END) OVER () END AS target FROM l),
e AS (SELECT d.*, source_size, target, CASE WHEN source_size > 0 THEN least(3.0::DOUBLE, target / source_size) ELSE 0 END AS e, size / (size + 50.0::DOUBLE) AS v
    FROM d JOIN t ON d.source IS NOT DISTINCT FROM t.source),
k AS (SELECT *, floor(e) AS sure, e - floor(e) AS f FROM e),
o AS (SELECT *, CASE WHEN f > 0 AND size > 0 THEN (u / (1 - u)) / (f / (1 - f) * v) END AS rank FROM k),
c AS (SELECT *, target - sure * source_size AS budget,
    sum(size) OVER (PARTITION BY source ORDER BY rank ASC NULLS LAST, doc_id, size ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS upto FROM o)
SELECT doc_id, size, source_size, CAST(target AS DOUBLE) AS target,
    CAST((sure + CASE WHEN rank IS NOT NULL AND 2 * upto - size < 2 * budget THEN 1 ELSE 0 END) * size AS BIGINT) AS taken, source FROM c
"""
