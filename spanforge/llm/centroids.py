"""Centroid clustering (Lloyd's rounds) with heap-ordered bounds.

A vector is entered under a key: the gap between its distance to the second
nearest centroid and to its own, plus the drift that its cluster's bounds have
accumulated so far. When centroids move, only the drift of each cluster grows:
by the move of its own centroid and the largest move of another. A gap has
expired where the key is not over the drift; those vectors are popped and
scanned against all centroids, and entered again. All others keep their
cluster without being looked at.

The heaps of all clusters lie in written runs, sorted by key. A run is never
changed: as drifts only grow, an entry is popped in the round in which its
cluster's drift passes its key, and is dead from then on, so a filter on two
numbers a cluster says which entries of which run are due, and files skip what
lies above. A round writes the popped vectors as a new run. Sums of clusters
are carried on by the vectors that changed theirs. The driver holds the
centroids, sums and drifts (k rows each), never vectors.

Distances are whole numbers and exact; roots, gaps and drifts are rounded to
the safe side, so ties and near ties are scanned again every round.

Defined results for odd input
    Vectors that are null, hold null, NaN or an infinity or have another length
    than ``width`` take no part. Rows that repeat a vec_id are vectors of their
    own; those with the same hash start in the order of their components. Rows
    of null vec_id take part, and are starting centroids only where others are
    too few. Fewer vectors than k give that many centroids. Ties go to the
    smaller cluster number; empty clusters keep their centroid. An empty table
    gives no rows; other columns are not read. Components over ``LIMIT`` after
    scaling are refused by an error, as distances would leave 64 bits.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass
from functools import reduce

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .tables import dropped, read, staged

LIMIT = 1 << 27
#: Up to here sums of 64 squares are exact in floating point too.
_SMALL = 1 << 22
#: How far roots are rounded to the safe side, relative to their size.
_SAFE = 1e-9


def whole_vectors(vectors: DataFrame, scale: int = 256, width: int = 64) -> DataFrame:
    """vec_id and w, floor(scale * x) of each component, of the rows that take part."""
    x = F.col("embedding").cast("array<double>")
    fit = F.col("embedding").isNotNull() & (F.size("embedding") == width) & F.forall(x, lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) < float("inf")))
    whole = lambda v: F.when(F.abs(v) <= float(LIMIT // scale), F.floor(v * float(scale)).cast("int")).otherwise(F.raise_error(F.lit(f"a component is over {LIMIT} after scaling")).cast("int"))
    return vectors.where(fit).select(F.col("vec_id").cast("long").alias("vec_id"), F.transform(x, whole).alias("w"))


def squares(x: np.ndarray, centroids: np.ndarray) -> np.ndarray:
    """Exact squared distances, a row per vector and a column per centroid."""
    if max(np.abs(x).max(initial=0), np.abs(centroids).max(initial=0)) <= _SMALL and x.shape[1] <= 64:
        a, c = x.astype(np.float64), centroids.astype(np.float64)
        return ((a * a).sum(1)[:, None] - 2 * (a @ c.T) + (c * c).sum(1)).astype(np.int64)
    return np.stack([((x - c) ** 2).sum(1) for c in centroids], axis=1)


def scanned(x: np.ndarray, centroids: np.ndarray, drift: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The nearest centroid of each vector, the smaller number in ties, and the key to enter it under."""
    cluster, key, step = np.zeros(len(x), np.int32), np.zeros(len(x)), max(1, 1_000_000 // len(centroids))
    for a in range(0, len(x), step):
        d = squares(x[a : a + step], centroids)
        best = d.argmin(1)
        near = np.sqrt(np.take_along_axis(d, best[:, None], 1)[:, 0].astype(float))
        if len(centroids) > 1:
            far = np.sqrt(np.partition(d, 1, axis=1)[:, 1].astype(float))
            gap = np.maximum(far - near - _SAFE * (far + near), 0)
        else:
            gap = np.full(len(d), np.inf)
        cluster[a : a + step], key[a : a + step] = best, drift[best] + gap
    return cluster, key


def moves(old: np.ndarray, new: np.ndarray) -> np.ndarray:
    """What each cluster's drift grows by: its own centroid's move and the largest move of another."""
    own = np.sqrt(((new - old).astype(float) ** 2).sum(1)) * (1 + _SAFE)
    if len(own) < 2:
        return own
    top = np.argsort(-own)[:2]
    other = np.full(len(own), own[top[0]])
    other[top[0]] = own[top[1]]
    return own + other


@dataclass
class Clusters:
    """vec_id, w, cluster, distance of every vector; the centroids; and how many vectors each round scanned."""

    assigned: DataFrame
    centroids: list[list[int]]
    scans: list[int]


def first_by_hash(vectors: DataFrame, k: int, seed: int = 2) -> list[list[int]]:
    """The vectors of the k smallest hashes of seed and vec_id, in that order."""
    h = F.sha2(F.concat(F.lit(f"{seed}:"), F.col("vec_id").cast("string")), 256)
    return [list(r.w) for r in vectors.orderBy(h.asc_nulls_last(), "w").limit(k).collect()]


def heap_clusters(vectors: DataFrame, starts: list[list[int]], rounds: int = 5) -> Clusters:
    """``vectors`` as ``whole_vectors`` gives them, after ``rounds`` rounds from ``starts`` and one more assignment."""
    if not starts:
        empty = vectors.limit(0).withColumns({"cluster": F.lit(0), "distance": F.lit(0).cast("long")})
        return Clusters(empty, [], [])
    k, width = len(starts), len(starts[0])
    centroids, drift = np.array(starts, np.int64), np.zeros(k)
    sums, counts = [[0] * width for _ in range(k)], [0] * k
    runs: list[DataFrame] = []
    scans, last = [], drift

    def scan(some: DataFrame, centroids: np.ndarray, drift: np.ndarray) -> DataFrame:
        def run(it: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            for p in it:
                x = np.stack(p["w"].to_numpy()).astype(np.int64) if len(p) else np.zeros((0, width), np.int64)
                cluster, key = scanned(x, centroids, drift)
                yield pd.DataFrame({"vec_id": p["vec_id"].astype("Int64"), "w": p["w"], "was": p["cluster"].astype("Int32"), "cluster": cluster, "key": key})

        return some.select("vec_id", "w", "cluster").mapInPandas(run, "vec_id long, w array<int>, was int, cluster int, key double")

    def over(at: np.ndarray):
        """Entries whose key is over their cluster's drift."""
        return F.col("key") > F.element_at(F.lit(at.tolist()), F.col("cluster") + 1)

    for turn in range(rounds + 1):
        if turn == 0:
            due = vectors.withColumn("cluster", F.lit(None).cast("int"))
        else:
            # The bound on all clusters' drifts goes down to the files; the newest run holds what has never been due.
            popped = [r.where((F.col("key") <= float(drift.max())) & ~over(drift) & (over(last) if i < turn - 1 else F.lit(True))) for i, r in enumerate(runs)]
            due = reduce(DataFrame.unionByName, popped)
        runs.append(staged(scan(due, centroids, drift).sortWithinPartitions("key"), "heap-run"))
        if turn == rounds:
            scans.append(runs[-1].count())
            break
        # A vector counts where it is now and no more where it was.
        sides = F.explode(F.array(F.struct(F.col("cluster").alias("c"), F.lit(1).alias("s")), F.struct(F.col("was").alias("c"), F.lit(-1).alias("s"))))
        changed = runs[-1].where("was IS NULL OR was <> cluster").select(sides.alias("x"), "w").select("x.*", "w").where("c IS NOT NULL")
        for r in changed.groupBy("c").agg(F.sum("s").cast("long"), *(F.sum(F.col("s").cast("long") * F.col("w")[i]) for i in range(width))).collect():
            counts[r[0]] += r[1]
            sums[r[0]] = [a + b for a, b in zip(sums[r[0]], r[2:])]
        scans.append(runs[-1].count())
        moved = np.array([[s // n for s in total] if n else list(old) for total, n, old in zip(sums, counts, centroids.tolist())], np.int64)
        last, drift, centroids = drift, drift + moves(centroids, moved), moved

    def distances(it: Iterator[pd.DataFrame], final=centroids) -> Iterator[pd.DataFrame]:
        for p in it:
            x = np.stack(p["w"].to_numpy()).astype(np.int64) if len(p) else np.zeros((0, width), np.int64)
            yield pd.DataFrame({"vec_id": p["vec_id"].astype("Int64"), "w": p["w"], "cluster": p["cluster"], "distance": ((x - final[p["cluster"].to_numpy()]) ** 2).sum(1)})

    live = reduce(DataFrame.unionByName, [r.where(over(drift)) for r in runs[:-1]] + runs[-1:])
    assigned = staged(live.select("vec_id", "w", "cluster").mapInPandas(distances, "vec_id long, w array<int>, cluster int, distance long"), "assigned")
    for r in runs:
        dropped(r)
    return Clusters(assigned, centroids.tolist(), scans)


def query(spark, sf_dir: str) -> DataFrame:
    vectors = whole_vectors(read(spark, sf_dir, "embeddings"))
    out = heap_clusters(vectors, first_by_hash(vectors, 40))
    sums = dict(out.assigned.groupBy("cluster").agg(F.sum("distance")).collect())
    named = [(c, s, sum(sums.values()), hashlib.sha256(",".join(map(str, out.centroids[c])).encode()).hexdigest()) for c, s in sums.items()]
    per = spark.createDataFrame(named, "c int, cluster_inertia long, inertia long, centroid_sha256 string")
    return out.assigned.join(F.broadcast(per), F.col("cluster") == F.col("c")).select("vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256")


def _sql(rounds: int = 5, k: int = 40) -> str:
    d2 = "CAST(list_sum(list_transform(list_zip(v.w, c.w), lambda p: (p[1] - p[2]) * (p[1] - p[2]))) AS BIGINT)"
    nearest = "a{r} AS MATERIALIZED (SELECT n, min(struct_pack(d := " + d2 + ", i := c.i)) AS b FROM v, c{r} c GROUP BY n)"
    # Of integers // cuts towards 0, so the rest is brought to 0 or more first.
    mean = "s{r} AS (SELECT b.i AS i, j, CAST(sum(w[j]) AS HUGEINT) AS s, count(*) AS m FROM a{r} JOIN v USING (n), generate_series(1, 64) g(j) GROUP BY ALL), m{r} AS (SELECT i, list((s - ((s % m) + m) % m) // m ORDER BY j) AS w FROM s{r} GROUP BY i), c{n} AS MATERIALIZED (SELECT c.i, CASE WHEN m.w IS NULL THEN c.w ELSE CAST(m.w AS BIGINT[]) END AS w FROM c{r} c LEFT JOIN m{r} m USING (i))"
    steps = ",\n".join(f"{nearest.format(r=r)},\n{mean.format(r=r, n=r + 1)}" for r in range(rounds))
    return f"""
WITH v AS MATERIALIZED (SELECT row_number() OVER () AS n, vec_id, list_transform(embedding, lambda x: CAST(floor(256 * CAST(x AS DOUBLE)) AS BIGINT)) AS w FROM embeddings
    WHERE len(embedding) = 64 AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
c0 AS MATERIALIZED (SELECT row_number() OVER (ORDER BY sha256('2:' || vec_id), w) - 1 AS i, w FROM v ORDER BY sha256('2:' || vec_id), w LIMIT {k}),
{steps},
{nearest.format(r=rounds)}
SELECT vec_id, CAST(b.i AS INTEGER) AS cluster, b.d AS distance, CAST(sum(b.d) OVER (PARTITION BY b.i) AS BIGINT) AS cluster_inertia, CAST(sum(b.d) OVER () AS BIGINT) AS inertia,
    sha256(array_to_string(c.w, ',')) AS centroid_sha256
FROM a{rounds} a JOIN v USING (n) JOIN c{rounds} c ON c.i = a.b.i
"""


SQL = _sql()
