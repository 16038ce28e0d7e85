"""Centroid clustering against plain rounds over all distances."""

import hashlib
import random

import numpy as np
import pytest

pytest.importorskip("spanforge.llm")

from spanforge.llm import centroids  # noqa: E402

TABLE = "vec_id long, embedding array<double>, label int"


def plain(rows, k, rounds=5):
    """(vec_id, cluster, distance) by scanning everything in every round, in whole numbers of any size."""
    kept = [(i, [int(np.floor(256 * x)) for x in v]) for i, v in rows if v is not None and len(v) == 64 and all(x is not None and np.isfinite(x) for x in v)]
    key = lambda r: (r[0] is None, hashlib.sha256(f"2:{r[0]}".encode()).hexdigest(), r[1])
    at = [w for _, w in sorted(kept, key=key)[:k]]
    for turn in range(rounds + 1):
        d = [[sum((a - b) ** 2 for a, b in zip(w, c)) for c in at] for _, w in kept]
        own = [r.index(min(r)) for r in d]
        if turn < rounds:
            for c in range(len(at)):
                mine = [w for (_, w), o in zip(kept, own) if o == c]
                at[c] = [sum(x) // len(mine) for x in zip(*mine)] if mine else at[c]
    return sorted((i if i is not None else -1, o, r[o]) for (i, _), o, r in zip(kept, own, d)), at


def built(spark, rows, k, rounds=5):
    v = centroids.whole_vectors(spark.createDataFrame([(i, x, 0) for i, x in rows], TABLE))
    out = centroids.heap_clusters(v, centroids.first_by_hash(v, k), rounds)
    return sorted((-1 if r.vec_id is None else r.vec_id, r.cluster, r.distance) for r in out.assigned.collect()), out


def cloud(rng, n, middles, spread):
    mid = [[rng.uniform(-1, 1) for _ in range(64)] for _ in range(middles)]
    return [(i, [m + rng.gauss(0, spread) for m in mid[i % middles]]) for i in range(n)]


@pytest.mark.parametrize("k, middles, spread", [(7, 5, 0.3), (12, 3, 0.02), (1, 2, 0.5), (40, 10, 0.4)])
def test_equals_plain_rounds(spark, k, middles, spread):
    rows = cloud(random.Random(k), 300, middles, spread)
    got, out = built(spark, rows, k)
    want, at = plain(rows, k)
    assert got == want and out.centroids == at


def test_only_expired_gaps_are_scanned(spark):
    """On groups that are well apart, later rounds leave most vectors alone."""
    rows = cloud(random.Random(5), 600, 4, 0.01)
    rows.sort(key=lambda r: hashlib.sha256(f"2:{r[0]}".encode()).hexdigest())
    starts = {r[0] % 4: r for r in reversed(rows)}
    v = centroids.whole_vectors(spark.createDataFrame([(i, x, 0) for i, x in rows], TABLE))
    out = centroids.heap_clusters(v, [[int(np.floor(256 * x)) for x in starts[m][1]] for m in range(4)])
    assert out.scans[0] == 600 and sum(out.scans[1:]) < 60


def test_ties_repeats_and_odd_rows(spark):
    rng = random.Random(1)
    unit = [[float(i == j) for j in range(64)] for i in range(4)]
    rows = [(i, unit[i % 4]) for i in range(40)] + [(3, unit[2]), (3, unit[1]), (3, unit[1]), (None, unit[0]), (None, [rng.random() for _ in range(64)])]
    odd = [(50, None), (51, []), (52, [1.0] * 63), (53, [1.0] * 65), (54, [None] + [1.0] * 63), (55, [float("nan")] * 64), (56, [float("inf")] * 64)]
    for k in (3, 6, 60):
        got, out = built(spark, rows + odd, k)
        want, at = plain(rows, k)
        assert got == want and out.centroids == at


def test_large_components(spark):
    rows = [(i, [float((i * 37 + j * 11) % 100) * 5000 for j in range(64)]) for i in range(60)]
    got, _ = built(spark, rows, 5)
    assert got == plain(rows, 5)[0]
    with pytest.raises(Exception, match="after scaling"):
        built(spark, [(1, [1e9] * 64)], 1)


def test_empty(spark):
    assert built(spark, [], 4)[0] == []
    assert built(spark, [(1, None)], 4)[0] == []
