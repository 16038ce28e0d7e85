"""Exact top-k search by exhaustive term-at-a-time accumulation.

A dimension is a term; its postings are the vectors of a batch with a weight
other than 0 there. The query rows go to the tasks in waves of at most
``wave_bytes``, broadcast; in each wave every vector is read once, where it
lies, and never shuffled. For a query, the terms are gone through one by one:
its weight scatters the term's postings, weighted, into a dense score array
over the batch. The k best of a batch are found by partition selection and
merged into the task's; what the tasks found is merged per query.

Defined results for odd input
    Vectors that are null or hold null, NaN or an infinity take no part, as
    queries and as candidates; empty vectors score 0 with all. Vectors of other
    lengths meet in the dimensions both have. With a column ``row`` that numbers
    the rows (the query gives one), rows that repeat a vec_id are queries and
    candidates of their own: a query row has its own k best, the other rows of
    its vec_id among them. Without it a vec_id is one query, and its rows are
    candidates of others only. Null vec_ids take no part. Components over
    ``LIMIT`` after scaling are refused by an error, as sums would leave 64 bits.
    Ties go to the smaller vec_id. An empty table gives no rows; other columns
    are not read.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .tables import dropped, read, staged

_NONE = -np.iinfo(np.int64).max
#: Sums of 2,048 products of such components stay within 64 bits.
LIMIT = 1 << 26


def whole_weights(vectors: DataFrame, scale: int = 256) -> DataFrame:
    """vec_id and floor(scale * x) of each component, of the rows that take part."""
    x = F.col("embedding").cast("array<double>")
    fit = F.col("vec_id").isNotNull() & F.col("embedding").isNotNull() & F.forall(x, lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) < float("inf")))
    whole = lambda v: F.when(F.abs(v) <= float(LIMIT // scale), F.floor(v * float(scale)).cast("long")).otherwise(F.raise_error(F.lit(f"a component is over {LIMIT} after scaling")).cast("long"))
    return vectors.where(fit).select(F.col("vec_id").cast("long").alias("vec_id"), F.transform(x, whole).alias("w"))


def postings(rows: pd.Series) -> list[tuple[np.ndarray, np.ndarray]]:
    """For each term the places of the rows that have it and their weights."""
    width = max(map(len, rows), default=0)
    dense = np.zeros((len(rows), width), np.int64)
    for i, r in enumerate(rows):
        dense[i, : len(r)] = r
    return [(np.flatnonzero(dense[:, t]), dense[dense[:, t] != 0, t]) for t in range(width)]


def search_batch(vectors: pd.DataFrame, rows: np.ndarray, weights: list[np.ndarray], k: int) -> tuple[np.ndarray, np.ndarray]:
    """Scores and vec_ids of the k best of ``vectors`` but its own row for each query row, in no order; fewer are filled up with the least score."""
    vectors = vectors.sort_values("vec_id", ignore_index=True, kind="stable")
    own, row, terms = vectors["vec_id"].to_numpy(np.int64), vectors["row"].to_numpy(np.int64), postings(vectors["w"])
    full = [len(at) == len(own) for at, _ in terms]
    best, found = np.full((len(rows), k), _NONE), np.full((len(rows), k), -1, np.int64)
    for n, (q, weight) in enumerate(zip(rows, weights)):
        scores = np.zeros(len(own), np.int64)
        for t in np.flatnonzero(weight[: len(terms)]):
            at, w = terms[t]
            if full[t]:
                scores += weight[t] * w
            else:
                scores[at] += weight[t] * w
        keep = np.flatnonzero(row != q)
        if len(keep) > k:
            s = scores[keep]
            least = -np.partition(-s, k - 1)[k - 1]
            # All above the k-th score, and of those equal to it the smallest ids: ids are sorted.
            above = keep[s > least]
            keep = np.concatenate([above, keep[s == least][: k - len(above)]])
        best[n, : len(keep)], found[n, : len(keep)] = scores[keep], own[keep]
    return best, found


def top_k(vectors: DataFrame, queries: DataFrame, k: int = 5, wave_bytes: int = 32 << 20) -> DataFrame:
    """query_id, rank, vec_id, score; both inputs as ``whole_weights`` gives them.

    The number of waves comes from the size of the queries, so what is
    broadcast at once is at most ``wave_bytes``, give or take the luck of
    hashing, however many queries there are.
    """
    spark = vectors.sparkSession
    row = F.col("row" if "row" in vectors.columns else "vec_id").alias("row")
    vectors, queries = vectors.select(row, "vec_id", "w"), queries.select(row, "vec_id", "w")
    size = queries.agg(F.sum(F.size("w") * 8 + 24)).first()[0] or 0
    waves, parts = max(1, -(-size // wave_bytes)), []
    for wave in range(waves):
        asked = queries.where(F.pmod(F.xxhash64("vec_id", "w"), F.lit(waves)) == wave).select("row", "vec_id", "w").toArrow().combine_chunks()
        lists = asked.column("w").combine_chunks() if asked.num_rows else None
        rows, ids = (asked.column(c).to_numpy().astype(np.int64) for c in ("row", "vec_id"))
        weights = np.split(lists.flatten().to_numpy().astype(np.int64), np.cumsum(np.diff(lists.offsets.to_numpy()))[:-1]) if lists is not None else []
        shared = spark.sparkContext.broadcast((rows, ids, weights))

        def search(it: Iterator[pd.DataFrame], shared=shared) -> Iterator[pd.DataFrame]:
            rows, ids, weights = shared.value
            best, found = np.full((len(ids), k), _NONE), np.full((len(ids), k), -1, np.int64)
            for p in it:
                more, also = search_batch(p, rows, weights, k)
                best, found = np.hstack([best, more]), np.hstack([found, also])
                order = np.lexsort((found, -best), axis=1)[:, :k]
                best, found = np.take_along_axis(best, order, 1), np.take_along_axis(found, order, 1)
            real = best != _NONE
            yield pd.DataFrame({"row": np.repeat(rows, k).reshape(-1, k)[real], "query_id": np.repeat(ids, k).reshape(-1, k)[real], "vec_id": found[real], "score": best[real]})

        parts.append(staged(vectors.mapInPandas(search, "row long, query_id long, vec_id long, score long"), "best"))
        shared.destroy()
    order = Window.partitionBy("row").orderBy(F.desc("score"), "vec_id")
    return reduce(DataFrame.unionByName, parts).withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def query(spark, sf_dir: str) -> DataFrame:
    # Numbered as they are written, so a row keeps its number.
    vectors = staged(whole_weights(read(spark, sf_dir, "embeddings")).withColumn("row", F.monotonically_increasing_id()), "vectors")
    out = top_k(vectors, vectors.where(F.col("vec_id") % 50 == 0))
    dropped(vectors)
    return out


SQL = """
WITH e AS (SELECT row_number() OVER () AS n, vec_id, list_transform(embedding, lambda x: CAST(floor(256 * CAST(x AS DOUBLE)) AS BIGINT)) AS w FROM embeddings
    WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (SELECT q.n, q.vec_id AS query_id, c.vec_id, CAST(list_sum(list_transform(list_zip(q.w, c.w), lambda p: p[1] * p[2])) AS BIGINT) AS score
    FROM e q JOIN e c ON q.n <> c.n WHERE q.vec_id % 50 = 0),
r AS (SELECT *, CAST(row_number() OVER (PARTITION BY n ORDER BY score DESC, vec_id) AS INTEGER) AS rank FROM s)
SELECT query_id, rank, vec_id, score FROM r WHERE rank <= 5
"""
