"""Toxicity by a character n-gram classifier with naive Bayes features.

A text is the set of its hashed character n-grams, white space as one space. A
feature's value is its naive Bayes log-count ratio between the classes of the
labelled rows; logistic regression with a penalty is trained on these values.
Rows to learn from are at most ``PER_CLASS`` of each class; the intercept is
then shifted to the share of toxic rows among all labelled rows of the fold.

Defined results for odd input
    Null and empty texts are scored like any other, by the intercept. Repeated
    rows each get their score. With no labelled rows, or one class only, every
    score is the share of toxic rows. An empty table gives no rows. Very long
    texts are scored whole. A score that equals the threshold is predicted 1;
    rows to learn from that tie in their hash go by doc_id. Other columns of
    ``documents`` are never read.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame

from .labelled import learning_rows, learnt, scored
from .tables import read

BITS, SIZES, PER_CLASS = 18, (3, 4, 5), 2500
_MULTIPLY = np.random.default_rng(3).integers(0, 1 << 31, (8, 8), dtype=np.int64).astype(np.uint32) * np.uint32(2) + np.uint32(1)
_LAST = np.zeros(1 << BITS, np.int32)


def grams(text: str) -> np.ndarray:
    """The distinct hashed n-grams of a text."""
    data = np.frombuffer(f" {' '.join(text.lower().split())} ".encode("utf-32-le", "surrogatepass"), np.uint32)
    parts = []
    for n in SIZES:
        if len(data) >= n:
            h = np.full(len(data) - n + 1, n, np.uint32)
            for j in range(n):
                h += data[j : len(data) - n + 1 + j] * _MULTIPLY[n, j]
            h ^= h >> np.uint32(15)
            h *= np.uint32(0x2C1B3C6D)
            h ^= h >> np.uint32(12)
            h *= np.uint32(0x297A2D39)
            parts.append(h >> np.uint32(32 - BITS))
    ids = np.concatenate(parts).astype(np.int32) if parts else np.zeros(0, np.int32)
    # Of equal ids the last one written stands: one place for each id.
    place = np.arange(len(ids), dtype=np.int32)
    _LAST[ids] = place
    return ids[_LAST[ids] == place]


def log_count_ratios(ids: np.ndarray, toxic: np.ndarray) -> np.ndarray:
    """For each feature the log of its smoothed share in toxic documents over that in others; one entry for each feature of each document."""
    p = 1 + np.bincount(ids[toxic], minlength=1 << BITS)
    q = 1 + np.bincount(ids[~toxic], minlength=1 << BITS)
    return np.log((p / p.sum()) / (q / q.sum())).astype(np.float32)


def train(texts: list[str], labels: list[int], share: float = 0.5, rounds: int = 80, penalty: float = 1e-4, rate: float = 0.05) -> dict:
    y = np.array(labels, np.float32)
    if not len(y) or y.min() == y.max():
        return {"v": np.zeros(1 << BITS, np.float32), "b": float(np.log(max(share, 1e-3) / max(1 - share, 1e-3)))}
    rows = [grams(t) for t in texts]
    sizes = np.array([len(r) for r in rows])
    ids, doc = np.concatenate(rows), np.repeat(np.arange(len(rows), dtype=np.int32), sizes)
    r = log_count_ratios(ids, y[doc] > 0)
    w, b, m, s, mb, sb = np.ones(1 << BITS, np.float32) * 0.01, 0.0, 0.0, 0.0, 0.0, 0.0
    weight = np.where(y > 0, 0.5 / y.mean(), 0.5 / (1 - y.mean())).astype(np.float32)
    for t in range(1, rounds + 1):
        z = np.bincount(doc, weights=(r * w)[ids], minlength=len(y)) + b
        err = (weight * (1 / (1 + np.exp(-np.clip(z, -30, 30))) - y)).astype(np.float32) / len(y)
        g = (np.bincount(ids, weights=err[doc], minlength=1 << BITS) * r).astype(np.float32) + penalty * w
        gb = float(err.sum())
        m, s, mb, sb = 0.9 * m + 0.1 * g, 0.99 * s + 0.01 * g * g, 0.9 * mb + 0.1 * gb, 0.99 * sb + 0.01 * gb * gb
        fix, fixs = 1 - 0.9**t, 1 - 0.99**t
        w -= (rate * (m / fix) / (np.sqrt(s / fixs) + 1e-8)).astype(np.float32)
        b -= rate * (mb / fix) / (np.sqrt(sb / fixs) + 1e-8)
    return {"v": r * w, "b": b + float(np.log(max(share, 1e-3) / max(1 - share, 1e-3)))}


def score(model: dict, texts: list[str]) -> list[float]:
    v, b = model["v"], model["b"]
    return [float(1 / (1 + np.exp(-np.clip(v[grams(t)].sum(dtype=np.float64) + b, -30, 30)))) for t in texts]


def toxicity(docs: DataFrame, labels: DataFrame, parts: int = 4, out: int = 2, per_class: int = PER_CLASS) -> DataFrame:
    rows, share = learning_rows(docs, labels, "toxic", parts, out, per_class)
    return scored(docs, score, learnt(rows, lambda t, y: train(t, y, share)), parts, out)


def query(spark, sf_dir: str) -> DataFrame:
    return toxicity(read(spark, sf_dir, "documents"), read(spark, sf_dir, "labels"))
