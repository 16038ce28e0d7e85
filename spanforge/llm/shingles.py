"""Word shingles of a text as sorted 64-bit hashes, in numpy over whole texts."""

from __future__ import annotations

import numpy as np

#: A-Z in lower case, and the white space between words.
LOWER = bytes(c + 32 if 65 <= c <= 90 else c for c in range(256))
_SPACE = np.array([c == 32 or 9 <= c <= 13 for c in range(256)])
_BYTE = np.random.default_rng(7).integers(0, 1 << 63, 256, dtype=np.int64).astype(np.uint64) | np.uint64(1)
_STEP = 0x9E3779B97F4A7C15
_BACK = pow(_STEP, -1, 1 << 64)
_PLACE = np.random.default_rng(8).integers(0, 1 << 63, 64, dtype=np.int64).astype(np.uint64) | np.uint64(1)
_POWERS: dict[str, np.ndarray] = {}


def _powers(name: str, base: int, n: int) -> np.ndarray:
    have = _POWERS.get(name)
    if have is None or len(have) < n:
        steps = np.full(max(n, 1 << 16), base, np.uint64)
        steps[0] = 1
        _POWERS[name] = have = np.cumprod(steps)
    return have[:n]


def mixed(x: np.ndarray) -> np.ndarray:
    """A finalizer, so that sums of products behave like random numbers."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> np.uint64(27))
    x = x * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def words(raw: bytes, lower: bool = True) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Hash, first byte and end of each word of ``raw``, by sums of powers over its bytes."""
    data = np.frombuffer(raw.translate(LOWER) if lower else raw, np.uint8)
    gap = np.concatenate([[True], _SPACE[data], [True]])
    edge = np.flatnonzero(gap[1:] != gap[:-1])
    start, end = edge[0::2], edge[1::2]
    n = len(data)
    sums = np.zeros(n + 1, np.uint64)
    np.cumsum(_BYTE[data] * _powers("step", _STEP, n), out=sums[1:])
    return mixed((sums[end] - sums[start]) * _powers("back", _BACK, n + 1)[start]), start, end


def grams(word: np.ndarray, k: int) -> np.ndarray:
    """Hashes of the k-word windows in order; of fewer words, one of all."""
    m = len(word)
    if m == 0:
        return word
    if m < k:
        return mixed((word * _PLACE[:m]).sum(keepdims=True) + np.uint64(m))
    out = np.zeros(m - k + 1, np.uint64)
    for j in range(k):
        out += word[j : m - k + 1 + j] * _PLACE[j]
    return mixed(out)


def long_grams(word: np.ndarray, k: int) -> np.ndarray:
    """Hashes of the k-word windows, from running sums: for large k. Fewer words have none."""
    n = len(word)
    if n < k:
        return word[:0]
    sums = np.zeros(n + 1, np.uint64)
    np.cumsum(word * _powers("step", _STEP, n), out=sums[1:])
    return mixed((sums[k:] - sums[:-k]) * _powers("back", _BACK, n - k + 1))


def shingle_set(text: str | None, k: int = 5) -> np.ndarray:
    """The distinct k-word shingles of a text, sorted."""
    return np.unique(grams(words(text.encode())[0], k)) if text else np.zeros(0, np.uint64)
