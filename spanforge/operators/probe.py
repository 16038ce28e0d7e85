"""Nearest claims to a seed claim, exactly for few seeds and through an index of buckets for many."""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from functools import reduce

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.basics import latest


def probe_seeds(claims: DataFrame, probes: Sequence[tuple[str, Sequence[str]]]) -> DataFrame:
    """probe, seed_source, seed_id, seed: for each probe the newest active claim with a vector that its first pattern with any claim fits."""
    some = claims.where("active AND embedding IS NOT NULL")
    rows = [some.where(F.lower("claim_text").like(p)).select(F.lit(name).alias("probe"), F.lit(i).alias("_try"), F.lit(p).alias("seed_source"), F.col("id").alias("seed_id"), F.col("embedding").alias("seed"), "created_at") for name, patterns in probes for i, p in enumerate(patterns)]
    return latest(reduce(DataFrame.unionByName, rows), ["probe"], F.col("_try"), F.desc("created_at"), F.desc("seed_id")).drop("_try", "created_at")


def cosine(a: Column, b: Column) -> Column:
    dot = lambda x, y: F.aggregate(F.zip_with(x, y, lambda p, q: p.cast("double") * q.cast("double")), F.lit(0.0), lambda s, v: s + v)
    return dot(a, b) / F.sqrt(dot(a, a) * dot(b, b))


def _ranked(rows: DataFrame, keys: list[str], k: int) -> DataFrame:
    order = Window.partitionBy(*keys).orderBy(F.desc("score"), "id")
    return rows.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)


def vector_probe(claims: DataFrame, projects: DataFrame, probes: Sequence[tuple[str, Sequence[str]]], alert: str, k: int = 10) -> DataFrame:
    """probe, seed_source, rank, id, project_name, score, distance, alert: the ``k`` claims nearest to each probe's seed, the seed itself too.

    A score is a cosine, rounded to 6 places before ranking; ``alert`` marks
    projects of such a name. There is one seed a probe, so every claim is
    looked at once, where it lies.
    """
    seeds = probe_seeds(claims, probes)
    rows = claims.where("active AND embedding IS NOT NULL").join(F.broadcast(seeds))
    near = _ranked(rows.withColumn("score", F.round(cosine(F.col("seed"), F.col("embedding")), 6)), ["probe"], k)
    named = near.join(projects.select(F.col("id").alias("_p"), "name"), F.col("project_id") == F.col("_p"), "left")
    name = F.coalesce("name", F.lit("<unknown>"))
    return named.select("probe", "seed_source", "rank", "id", name.alias("project_name"), "score", F.round(1 - F.col("score"), 6).alias("distance"), F.lower(name).like(alert).alias("alert"))


def _sides(x: np.ndarray, tables: int, bits: int, flips: int, seed: int = 11) -> list[np.ndarray]:
    """The buckets of vectors of one width in each table: their own, then those across one of the ``flips`` nearest planes."""
    planes = np.random.default_rng([seed, x.shape[1]]).normal(size=(x.shape[1], tables * bits))
    side = (x @ planes).reshape(len(x), tables, bits)
    own = ((side > 0) << np.arange(bits)).sum(2)
    near = np.argsort(np.abs(side), axis=2)[:, :, :flips]
    return [own] + [own ^ (1 << near[:, :, f]) for f in range(min(flips, bits))]


def bucketed(vectors: DataFrame, id_: str, tables: int, bits: int, flips: int = 0, seed: int = 11) -> DataFrame:
    """id, table, bucket: the side of ``bits`` random planes a vector lies on, for each of ``tables`` sets of planes.

    With ``flips`` also the buckets on the other side of the planes it is nearest to, one at a time.
    """
    def rows(it: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for p in it:
            out = []
            for _, part in p.groupby(p["embedding"].map(len)):
                for b in _sides(np.stack(part["embedding"].to_list()).astype(float), tables, bits, flips, seed):
                    out.append((np.repeat(part["id"].to_numpy(), tables), np.tile(np.arange(tables), len(part)), b.ravel()))
            cols = [np.concatenate([o[i] for o in out]) if out else [] for i in range(3)]
            yield pd.DataFrame({"id": cols[0], "table": cols[1], "bucket": cols[2]})

    kind = vectors.schema[id_].dataType.simpleString()
    return vectors.where("embedding IS NOT NULL").select(F.col(id_).alias("id"), "embedding").mapInPandas(rows, f"id {kind}, table int, bucket int")


#: Claims of a block, and queries that meet a block at once.
BLOCK, ASKED = 4_096, 1_024


def indexed_probe(queries: DataFrame, claims: DataFrame, k: int = 10, tables: int = 24, bits: int = 6, flips: int = 2, block: int = BLOCK, asked: int = ASKED) -> DataFrame:
    """query_id, rank, id, score: the ``k`` claims nearest to many queries, of those that share a bucket with them.

    Every claim is in the index, and what shares a bucket is ranked by exact
    cosines; a query's own id and vectors without a direction are left out. More
    ``tables`` and ``flips`` or fewer ``bits`` find more of the true neighbours
    and look at more claims.

    About ``block`` claims and ``asked`` queries meet as matrices, each pair
    once however many buckets it shares, and only a query's first ``k`` of a
    block are exchanged, never pairs.
    """
    blocks, turns = (max(1, -(-df.count() // size)) for df, size in ((claims, block), (queries, asked)))
    part = lambda n: F.pmod(F.xxhash64("id"), F.lit(n)).cast("int")
    every = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
    some = lambda df, id_: df.where("embedding IS NOT NULL").select(F.col(id_).alias("id"), "embedding")
    given = some(claims, "id").withColumns({"block": part(blocks), "turn": every(turns)})
    wanted = some(queries, "query_id").withColumns({"turn": part(turns), "block": every(blocks)})

    def near(ask: pd.DataFrame, have: pd.DataFrame) -> pd.DataFrame:
        out = [pd.DataFrame({"query_id": [], "id": [], "score": []})]
        wide = {n: p for n, p in have.groupby(have["embedding"].map(len))}
        for n, q in ask.groupby(ask["embedding"].map(len)):
            if n not in wide or not n:
                continue
            c = wide[n]
            x, y = (np.stack(p["embedding"].to_list()).astype(float) for p in (q, c))
            mine = _sides(y, tables, bits, 0)[0].T.copy()
            meets = q["id"].to_numpy()[:, None] != c["id"].to_numpy()[None, :]
            shares = np.zeros(meets.shape, bool)
            for own in _sides(x, tables, bits, flips):
                for t in range(tables):
                    shares |= own[:, t, None] == mine[t]
            with np.errstate(all="ignore"):
                score = np.round(x @ y.T / np.sqrt((x * x).sum(1)[:, None] * (y * y).sum(1)), 6)
            score[~(meets & shares & np.isfinite(score))] = -np.inf
            least = np.partition(score, -min(k, len(c)), axis=1)[:, -min(k, len(c))]
            i, j = np.nonzero((score >= least[:, None]) & (score > -np.inf))
            best = pd.DataFrame({"query_id": q["id"].to_numpy()[i], "id": c["id"].to_numpy()[j], "score": score[i, j], "_i": i})
            out.append(best.sort_values(["_i", "score", "id"], ascending=[True, False, True]).groupby("_i").head(k).drop(columns="_i"))
        return pd.concat(out[1:] or out)

    kinds = [df.schema[c].dataType.simpleString() for df, c in ((queries, "query_id"), (claims, "id"))]
    met = wanted.groupBy("block", "turn").cogroup(given.groupBy("block", "turn")).applyInPandas(near, f"query_id {kinds[0]}, id {kinds[1]}, score double")
    return _ranked(met, ["query_id"], k).select("query_id", "rank", "id", "score")
