"""Labelled rows to learn from, and models as one broadcast row."""

from __future__ import annotations

import pickle
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def fold(doc_id: Column, parts: int) -> Column:
    """crc32 of the id as text, modulo ``parts``; null for a null id."""
    return F.crc32(doc_id.cast("string").cast("binary")) % parts


def learning_rows(docs: DataFrame, labels: DataFrame, label: str, parts: int, out: int, per_class: int) -> tuple[DataFrame, float]:
    """(text, label) of at most ``per_class`` labelled rows of each class, and the share of label 1.

    Only ids outside fold ``out`` are used. Which ones is up to a hash of the
    id. Ids with no, other or contradicting labels aren't used; the share is
    counted over all that are. The ids that are joined to the texts are at
    most twice ``per_class``.
    """
    known = labels.where(F.col("doc_id").isNotNull() & F.col(label).isin(0, 1)).groupBy("doc_id").agg(F.min(label).alias("y"), F.max(label).alias("z")).where("y = z").where(fold(F.col("doc_id"), parts) != out)
    ones, n = known.agg(F.sum("y"), F.count("*")).first()
    pick = [known.where(F.col("y") == y).orderBy(F.xxhash64("doc_id"), "doc_id").limit(per_class) for y in (0, 1)]
    ids = pick[0].unionByName(pick[1]).select(F.col("doc_id").alias("_id"), F.col("y").alias("label"))
    rows = docs.select("doc_id", "text").join(F.broadcast(ids), F.col("doc_id") == F.col("_id")).select("text", "label")
    return rows, (ones or 0) / n if n else 0.0


def learnt(rows: DataFrame, train: Callable[[list[str], list[int]], object]) -> object:
    """What ``train`` makes of the rows, in one task; the rows are bounded by ``per_class``."""

    def run(it: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        p = pd.concat([pd.DataFrame({"text": [], "label": []}), *it])
        p = p.assign(text=p["text"].fillna("")).sort_values(["label", "text"])
        yield pd.DataFrame({"model": [pickle.dumps(train(p["text"].tolist(), p["label"].astype(int).tolist()))]})

    made = rows.repartition(1).mapInPandas(run, "model binary").first()
    return pickle.loads(made[0]) if made else train([], [])  # no rows, no task


def scored(docs: DataFrame, score: Callable[[object, list[str]], list[float]], model: object, parts: int, out: int, least: float = 0.3) -> DataFrame:
    """doc_id, held_out, score, predicted of every row."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(it: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for p in it:
            yield pd.DataFrame({"doc_id": p["doc_id"], "score": score(shared.value, p["text"].fillna("").tolist())})

    rows = docs.select("doc_id", "text").mapInPandas(run, f"doc_id {docs.schema['doc_id'].dataType.simpleString()}, score double")
    return rows.select("doc_id", F.coalesce(fold(F.col("doc_id"), parts) == out, F.lit(False)).alias("held_out"), "score", (F.col("score") >= least).cast("int").alias("predicted"))
