"""The source divergence audit against plain sums over all terms."""

import random
import re
from collections import Counter, defaultdict

import pytest

pytest.importorskip("spanforge.llm")

from spanforge.llm import divergence  # noqa: E402

DOCS = "doc_id long, text string, lang string, source string, part string"


def plain(rows, top=200):
    n, docs, groups = defaultdict(Counter), defaultdict(Counter), defaultdict(set)
    for _, text, lang, source in rows:
        lang, source = lang or "", source or ""
        terms = re.findall(r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+", "".join(c.lower() if "A" <= c <= "Z" else c for c in text or ""))
        groups[lang].add(source)
        n[lang, source].update(terms)
        docs[lang].update(set(terms))
    out = set()
    for lang, sources in groups.items():
        kept = [t for t, c in docs[lang].items() if c >= 3]
        whole = sum((n[lang, s] for s in sources), Counter())

        def p(count):
            total = sum(count[t] for t in kept)
            return {t: 1 + 10**9 * (count[t] + 1) // (total + len(kept)) for t in kept}

        ps, q = {s: p(n[lang, s]) for s in sources}, p(whole)
        for a in sources:
            pairs = [(b, sum((ps[a][t] - ps[b][t]) ** 2 // ps[b][t] for t in kept)) for b in sources if b != a]
            terms = [(t, (ps[a][t] - q[t]) ** 2 // q[t]) for t in kept if n[lang, a][t] > 0 and ps[a][t] > q[t]]
            for part, found in (("pair", pairs), ("term", terms)):
                ranked = sorted(found, key=lambda x: (-x[1], x[0].encode()))
                out |= {(lang, a, part, item, value, k + 1) for k, (item, value) in enumerate(ranked) if part == "pair" or k < top}
    return out


def built(spark, rows, **how):
    df = spark.createDataFrame([(*r, "x") for r in rows], DOCS)
    got = [(r.lang, r.source, r.part, r.item, r.value, r.rank) for r in divergence.audit(df, **how).collect()]
    assert len(got) == len(set(got))
    return set(got)


@pytest.mark.parametrize("groups, terms", [(32, 4096), (3, 20), (1, 7), (2, 1000)])
def test_equals_plain_sums(spark, monkeypatch, groups, terms):
    """However the cube is cut."""
    monkeypatch.setattr(divergence, "GROUPS", groups)
    monkeypatch.setattr(divergence, "TERMS", terms)
    rng = random.Random(groups)
    rows = [(i, " ".join(f"{rng.choice('abcdé')}{'xyz'[rng.randrange(3)] * rng.randrange(4)}{', '[rng.randrange(2)]}" for _ in range(rng.randrange(40))), rng.choice(["en", "de", None]), f"s{rng.choice([0, 0, 0, 0, *range(9)])}") for i in range(400)]
    rows += [(900 + i, "one THREE ünï Four5six _a-b Straße", "fr", "only") for i in range(3)] + [(950, "rare words here", "xx", s) for s in "ab"]
    assert built(spark, rows) == plain(rows)


def test_only_the_first_terms_are_kept(spark):
    rows = [(i, " ".join(f"w{chr(97 + k)}" for k in range(i % 20)), "en", f"s{i % 3}") for i in range(90)]
    assert built(spark, rows, top=4) == plain(rows, 4)


def test_odd_rows(spark):
    long = " ".join("abcdefghij"[i % 10] * (1 + i % 7) for i in range(60000))
    rows = [(1, None, None, None), (2, "", "", ""), (3, None, "en", None), (4, long, "en", "a"), (4, long, "en", "a"), (4, long, "en", "b"), (None, "A a\x00a ¡é!", "en", "c"), (6, "12 ... \t", "en", "d")]
    assert built(spark, rows) == plain(rows)
    assert built(spark, []) == set()
