"""Personal data: base patterns against the patterns as written, decoding against all paths, the field on lines it has not seen."""

import hashlib
import itertools
import random
import re
import time

import numpy as np
import pytest

pytest.importorskip("spanforge.llm")

from pyspark.sql import functions as F  # noqa: E402

from spanforge.llm import pii  # noqa: E402

LINES = pii.LABELLED.strip().splitlines()
PATTERNS = {
    "email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+",
    "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
    "card": r"[0-9]([\x20-]?[0-9])+",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}


@pytest.fixture(scope="module")
def field():
    return pii.train(LINES)


def plain(text):
    out = []
    for kind, pattern in PATTERNS.items():
        for m in re.finditer(pattern, text):
            digits = re.sub("[^0-9]", "", m.group())
            total = sum(d if i % 2 == 0 else (2 * d if d < 5 else 2 * d - 9) for i, d in enumerate(map(int, reversed(digits))))
            fits = {"email": True, "ip": all(int(x) <= 255 for x in m.group().split(".")) if kind == "ip" else True, "card": 12 <= len(digits) <= 19 and total % 10 == 0, "phone": 9 <= len(digits) <= 15}
            if fits[kind]:
                out.append((kind, m.start(), m.end()))
    return sorted(out, key=lambda s: (s[1], list(PATTERNS).index(s[0])))


def test_base_equals_the_patterns():
    rng = random.Random(4)
    bits = ["a", "Z9", ".", "..", "@", "-", " ", "1", "25", "255", "256", "0004", "é", "+", "+1", "(", ")", "555", "4111 1111 1111 1111", "4000-0000-0000-0002", "x@y.z", "1.2.3.4", "\n", "_%"]
    for _ in range(4000):
        text = "".join(rng.choice(bits) for _ in range(rng.randrange(24)))
        assert pii.base_spans(text) == plain(text), text
    some = "a@b.c@d.e f@g h.i@j-k.l 1.2.3.4.5.6.7.8.9 300.1.1.1, +1 (706) 555-3138, 9807915762804490, +12, 4111-1111 1111 1111"
    assert pii.base_spans(some) == plain(some) and {k for k, _, _ in plain(some)} == set(PATTERNS)


def test_long_runs_take_linear_time():
    began = time.time()
    for text in ("a" * 400_000, "9" * 400_000, "1." * 200_000, "a@" * 200_000, "+1" * 200_000, "+" + "1 " * 200_000 + "x", "4-" * 200_000, "@" * 400_000, "(" * 400_000):
        pii.base_spans(text)
    assert time.time() - began < 20


def test_viterbi_equals_all_paths():
    rng = np.random.default_rng(2)
    for _ in range(60):
        n, s = int(rng.integers(1, 6)), 3
        e, steps, first, last = rng.normal(size=(1, n, s)), rng.normal(size=(s, s)), rng.normal(size=s), rng.normal(size=s)
        worth = lambda p: first[p[0]] + last[p[-1]] + sum(e[0, i, x] for i, x in enumerate(p)) + sum(steps[a, b] for a, b in itertools.pairwise(p))
        best = max(itertools.product(range(s), repeat=n), key=worth)
        assert tuple(pii.viterbi(e, np.array([n]), steps, first, last)[0]) == best


def test_short_runs_decode_as_whole_texts(field):
    rng = np.random.default_rng(1)
    for _ in range(300):
        n = int(rng.integers(1, 60))
        e = rng.normal(0, 3, (n, len(pii.STATES)))
        e[:, 0] += rng.integers(0, 9)
        starts = np.unique(np.r_[0, rng.integers(0, n, 3)])
        whole = [pii.viterbi(e[None, a:b], np.array([b - a]), field.steps, field.first, field.last)[0] for a, b in zip(starts, np.r_[starts[1:], n])]
        assert (pii.decoded(e, starts, field) == np.concatenate(whole)).all()


def test_gradient_is_that_of_the_likelihood():
    """Training on few lines drives the likelihood up: they are then decoded as labelled."""
    few = ["call {phone|555-0142} now", "{name|Ann Lee} met Bo", "nothing to see"]
    finder = pii.Finder(pii.train(few, turns=120))
    for line in few:
        text, spans = pii.clean_line(line)
        assert [s for s in finder.find([text])[0][1]] == spans


def score(finder, lines):
    hit = want = found = 0
    for line in lines:
        text, spans = pii.clean_line(line)
        base, more = finder.find([text])[0]
        got = {(a, b) for _, a, b in base + more}
        want, found, hit = want + len(spans), found + len(got), hit + len(got & {(a, b) for _, a, b in spans})
    return hit / max(1, found), hit / max(1, want)


def test_held_out_lines():
    """Trained on three lines in four: precision and recall on the fourth, exact spans."""
    scores = [score(pii.Finder(pii.train([x for i, x in enumerate(LINES) if i % 4 != k])), LINES[k::4]) for k in range(4)]
    precision, recall = np.mean(scores, axis=0)
    assert precision >= 0.75 and recall >= 0.5, (precision, recall)


def test_new_values_in_new_sentences(field):
    lines = [
        "you may write to {email|sonja.k [at] post.example.org} this week", "mail {email|info at shop dot example dot net} today", "send {email|b.roy (at) site (dot) fr} a note",
        "Call {phone|(313) 555-0187} at once", "his phone: {phone|415-555-0111} please", "Tel. {phone|040 555 77 12} bitte", "cell {phone|512.555.0190} ok",
        "SSN [078] {id|123-45-6789} on record", "IBAN {id|DE12500105170648489890} danke", "host {ip|10[.]1[.]7[.]9} fell", "Card {card|4222.2222.2222.2220} lost",
        "Mr. {name|Oscar Lindt} came", "My name is {name|Nora Klein} hello",
    ]
    precision, recall = score(pii.Finder(field), lines)
    assert precision >= 0.9 and recall >= 0.85


def test_clean_texts_stay_clean(field):
    texts = ["The train at 12:30 cost 4.50 in 2019, see page 212 or 30-45.", "It. Was. The End of Days.\nAnd Then Rain", "version 4.0.1 of lib 2.0", "0595765450607129 and 4952935900253052x", "add 250 g of flour at the dot", "a (at) b", "ID 12345 of 99"]
    assert all(more == [] for _, more in pii.Finder(field).find(texts))


def test_query_equals_plain_digest(spark, field):
    long = "word " * 30000 + "x@y.zz " + "mehr " * 30000
    rows = [(1, None), (2, ""), (3, "a@b.cd and +1 (706) 555-3138"), (3, "a@b.cd and +1 (706) 555-3138"), (None, "é 1.2.3.4"), (2**60 + 1, "call (706) 555-3138 today, 4111111111111111"), (5, long), (6, "nothing")]
    df = spark.createDataFrame([(*r, "s", 1) for r in rows], "doc_id long, text string, spans string, start int")
    got = {r.doc_id: r for r in pii.spans(df, field).collect()}
    assert len(got) == len(rows) - 1
    for i, t in rows:
        base = [(s["kind"], s["start"], s["end"]) for s in got[i].spans if s["base"]]
        assert base == plain(t or "")
    assert [s["kind"] for s in got[2**60 + 1].spans] == ["phone", "card"] and got[3].redacted == "[email] and [phone]" and got[1].redacted == ""
    assert pii.spans(df.limit(0), field).count() == 0
    none = pii.fitted(spark.createDataFrame([], "line string"))
    assert all(s["base"] for r in pii.spans(df, none).collect() for s in r.spans)


def test_registered_query(spark, sf_dir):
    docs = {r.doc_id: r.text or "" for r in spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text").collect()}
    out = pii.query(spark, sf_dir).collect()
    assert sorted(r.doc_id for r in out) == sorted(docs)
    for r in out:
        base = plain(docs[r.doc_id])
        listed = [f"{k}:{a}:{b}" for k, a, b in base]
        assert r.base_sha256 == hashlib.sha256(",".join(listed).encode()).hexdigest()
        assert (r.n_email, r.n_ip, r.n_card, r.n_phone) == tuple(sum(k == x for k, _, _ in base) for x in PATTERNS)
        assert set(listed) <= set(r.spans.split(",") if r.spans else [])
    assert pii.query(spark, sf_dir).where(F.size(F.split("spans", ",")) > 20).count() == 0
