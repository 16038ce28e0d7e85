"""Document quality by attention-based multiple-instance learning.

A document is a bag of passages of ``WORDS`` words. Each passage is encoded: a
fixed vector of hashed byte trigrams and of the shape of its words goes through
a learnt layer. Learnt gated attention weighs the passages, the weighted sum of
their codes is the document's, and a logistic unit scores it. Only labels of
whole documents are used. Rows to learn from are at most ``PER_CLASS`` of each
class; the intercept is shifted to the share of label 1 among all labelled rows.

Defined results for odd input
    Null, empty and wordless texts are one passage without content and scored
    as such. Repeated rows each get their score. With no labelled rows, or one
    class only, every score is the share of label 1. An empty table gives no
    rows. Very long texts are scored whole, ``STEP`` passages at a time. A score
    that equals the threshold is predicted 1; rows to learn from that tie in
    their hash go by doc_id. Other columns of ``documents`` are never read.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame

from .labelled import learning_rows, learnt, scored
from .shingles import words
from .tables import read

WORDS, TRIGRAMS, SHAPE, PER_CLASS, STEP = 50, 128, 10, 1500, 2000
HIDDEN, GATE = 24, 12
#: Bytes by kind for the shape of a passage.
_KIND = np.zeros(256, np.int64)
_KIND[[*range(48, 58)]] = 1
_KIND[[*range(65, 91)]] = 2
_KIND[[*map(ord, "#*$%&|<>@=_+~^\\{}[]")]] = 3
_KIND[[*map(ord, ".,;:!?'\"()-/")]] = 4
_KIND[[*range(9, 14), 32]] = 5


def passages(text: str) -> np.ndarray:
    """A row of TRIGRAMS + SHAPE numbers for each passage."""
    raw = text.encode("utf-8", "surrogatepass")
    word, start, end = words(raw)
    if not len(word):
        return np.zeros((1, TRIGRAMS + SHAPE), np.float32)
    n = -(-len(word) // WORDS)
    own = np.arange(len(word)) // WORDS
    data = np.frombuffer(raw, np.uint8)
    edges = np.append(start[::WORDS], len(data))
    edges[0] = 0
    place = np.repeat(np.arange(n), np.diff(edges))
    wide = data.astype(np.uint32)
    h = wide[:-2] * np.uint32(0x9E3779B1) + wide[1:-1] * np.uint32(0x85EBCA6B) + wide[2:] * np.uint32(0xC2B2AE35) if len(wide) > 2 else wide[:0]
    h = (h ^ (h >> np.uint32(15))) * np.uint32(0x2C1B3C6D) >> np.uint32(32 - 7)
    grams = np.bincount(place[: len(h)] * TRIGRAMS + h, minlength=n * TRIGRAMS).reshape(n, TRIGRAMS)
    kinds = np.bincount(place * 6 + _KIND[data], minlength=n * 6).reshape(n, 6) / np.bincount(place, minlength=n)[:, None]
    count = np.bincount(own, minlength=n)
    order = np.lexsort((word, own))
    w, o = word[order], own[order]
    distinct = np.bincount(o, weights=np.concatenate([[True], (w[1:] != w[:-1]) | (o[1:] != o[:-1])]), minlength=n) / count
    again = np.bincount(own[1:], weights=word[1:] == word[:-1], minlength=n) / count
    length = np.bincount(own, weights=end - start, minlength=n) / count
    spread = np.sqrt(np.maximum(np.bincount(own, weights=(end - start) ** 2.0, minlength=n) / count - length**2, 0))
    out = np.empty((n, TRIGRAMS + SHAPE), np.float32)
    out[:, :TRIGRAMS] = np.sqrt(grams / np.maximum(grams.sum(1, keepdims=True), 1)) * 3
    out[:, TRIGRAMS:] = np.column_stack([kinds[:, 1:] * [4, 4, 8, 4, 4], distinct * 2, again * 2, length / 5, spread / 3, np.log1p(count) / 4])
    return out


def forward(m: dict, x: np.ndarray, first: np.ndarray) -> tuple:
    """Codes, gates, attention and scores of the bags of x that begin at ``first``."""
    h = np.tanh(x @ m["W"] + m["c"])
    t, g = np.tanh(h @ m["V"]), 1 / (1 + np.exp(-(h @ m["U"])))
    a = (t * g) @ m["a"]
    sizes = np.diff(np.append(first, len(x)))
    a = np.exp(a - np.repeat(np.maximum.reduceat(a, first), sizes))
    a /= np.repeat(np.add.reduceat(a, first), sizes)
    z = np.add.reduceat(a[:, None] * h, first)
    return h, t, g, a, sizes, z, 1 / (1 + np.exp(-np.clip(z @ m["o"] + m["b"], -30, 30)))


def gradient(m: dict, x: np.ndarray, begin: np.ndarray, y: np.ndarray, weight: np.ndarray) -> dict:
    """Of the mean of ``weight`` times the log loss over the bags of x that begin at ``begin``."""
    h, th, g, a, sizes, z, p = forward(m, x, begin)
    e = weight * (p - y) / len(y)
    dz = np.repeat(e[:, None] * m["o"], sizes, axis=0)
    da = (dz * h).sum(1)
    da = a * (da - np.repeat(np.add.reduceat(a * da, begin), sizes))
    dt, dg = da[:, None] * m["a"] * g * (1 - th * th), da[:, None] * m["a"] * th * g * (1 - g)
    dh = (a[:, None] * dz + dt @ m["V"].T + dg @ m["U"].T) * (1 - h * h)
    return {"W": x.T @ dh, "c": dh.sum(0), "V": h.T @ dt, "U": h.T @ dg, "a": (th * g).T @ da, "o": z.T @ e, "b": e.sum()}


def train(texts: list[str], labels: list[int], share: float = 0.5, epochs: int = 30, rate: float = 0.01, penalty: float = 1e-4, batch: int = 64) -> dict:
    odds = float(np.log(max(share, 1e-3) / max(1 - share, 1e-3)))
    rng, d = np.random.default_rng(5), TRIGRAMS + SHAPE
    m = {"W": rng.normal(0, d**-0.5, (d, HIDDEN)), "c": np.zeros(HIDDEN), "V": rng.normal(0, 0.3, (HIDDEN, GATE)), "U": rng.normal(0, 0.3, (HIDDEN, GATE)), "a": rng.normal(0, 0.3, GATE), "o": rng.normal(0, 0.3, HIDDEN), "b": np.zeros(())}
    y = np.array(labels, float)
    if not len(y) or y.min() == y.max():
        return m | {"o": np.zeros(HIDDEN), "b": odds}
    bags = [passages(t) for t in texts]
    weight = np.where(y > 0, 0.5 / y.mean(), 0.5 / (1 - y.mean()))
    first, second, t = {k: 0.0 for k in m}, {k: 0.0 for k in m}, 0
    for _ in range(epochs):
        for at in np.array_split(rng.permutation(len(y)), max(1, len(y) // batch)):
            x = np.concatenate([bags[i] for i in at]).astype(float)
            begin = np.concatenate([[0], np.cumsum([len(bags[i]) for i in at])[:-1]])
            grad = gradient(m, x, begin, y[at], weight[at])
            t += 1
            for k in m:
                q = grad[k] + penalty * m[k]
                first[k], second[k] = 0.9 * first[k] + 0.1 * q, 0.99 * second[k] + 0.01 * q * q
                m[k] = m[k] - rate * (first[k] / (1 - 0.9**t)) / (np.sqrt(second[k] / (1 - 0.99**t)) + 1e-8)
    return {k: v.astype(np.float32) for k, v in m.items()} | {"b": float(m["b"]) + odds}


def score(m: dict, texts: list[str]) -> list[float]:
    out: list[float] = []
    bags: list[np.ndarray] = []

    def flush() -> None:
        if bags:
            first = np.concatenate([[0], np.cumsum([len(b) for b in bags])[:-1]]).astype(int)
            out.extend(forward(m, np.concatenate(bags), first)[-1].astype(float).tolist())
            bags.clear()

    for t in texts:
        bags.append(passages(t))
        if sum(map(len, bags)) >= STEP:
            flush()
    flush()
    return out


def quality(docs: DataFrame, labels: DataFrame, parts: int = 5, out: int = 0, per_class: int = PER_CLASS) -> DataFrame:
    rows, share = learning_rows(docs, labels, "quality", parts, out, per_class)
    return scored(docs, score, learnt(rows, lambda t, y: train(t, y, share)), parts, out)


def query(spark, sf_dir: str) -> DataFrame:
    return quality(read(spark, sf_dir, "documents"), read(spark, sf_dir, "labels"))
