"""The training-data operators against brute force, round trips and odd input."""

import hashlib
import os
import random
import re
import zlib

import numpy as np
import pytest

pytest.importorskip("spanforge.llm")

from pyspark.sql import functions as F  # noqa: E402

from spanforge.llm import bpe, catalog, components, labelled, line_dedup, near_dedup, passages, quality_mil, quality_rules, shingles, source_mix, tables, topk, toxicity  # noqa: E402
from tests.conftest import rows_of  # noqa: E402

DOCS = "doc_id long, text string, lang string, source string, n_chars long"
LONG = " ".join(f"w{i % 977}x{i % 13}" for i in range(20000))
ODD = [(1, None, "en", "a", 0), (2, "", "en", "a", 0), (3, " \t\n ", "en", None, 4), (4, "one two", "en", "a", 7), (4, "one two", "en", "a", 7), (5, LONG, "de", None, len(LONG)), (None, "lost id here", "fr", "b", 12), (6, "x\ny\nx", None, "b", 5)]


@pytest.fixture(scope="module")
def odd(spark):
    return spark.createDataFrame(ODD, DOCS)


@pytest.fixture(scope="module")
def none(spark):
    return spark.createDataFrame([], DOCS)


@pytest.mark.parametrize("name", sorted(catalog.ORACLES))
def test_query_equals_sql(spark, duck, sf_dir, name):
    assert rows_of(catalog.QUERIES[name](spark, sf_dir).toPandas()) == rows_of(duck.execute(catalog.ORACLES[name]).df())


# --- line dedup


def test_lines_odd(odd, none, spark):
    out = {(r.doc_id, r.text): (r._ld_lines, r._ld_dropped) for r in line_dedup.clean_lines(odd.withColumn("h", F.lit(1)).withColumn("pages", F.lit(2))).collect()}
    assert out[(1, None)] == (0, 0) and out[(2, "")] == (1, 0) and len(out) == len(ODD) - 1
    assert line_dedup.clean_lines(none).count() == 0


def test_lines_by_host(spark):
    rows = [(i, f"menu\nown {i}\n menu \nend", "h1") for i in range(6)] + [(100 + i, f"menu\nother {i}", "h2") for i in range(4)] + [(200, "menu\n\nx", None)]
    got = {r.doc_id: r.text for r in line_dedup.clean_lines(spark.createDataFrame(rows, "doc_id long, text string, source string")).collect()}
    assert got[3] == "own 3" and got[101] == "menu\nother 1" and got[200] == "menu\n\nx"


def test_lines_copies_are_one_page(spark):
    """A page crawled often keeps its lines; what over a tenth of the different pages carry goes."""
    rows = [(i, "copied a\ncopied b\nmenu", "h") for i in range(40)] + [(100 + i, f"own {i}\nmenu\n{'often' if i < 6 else 'x'}", "h") for i in range(60)]
    got = {r.doc_id: r.text for r in line_dedup.clean_lines(spark.createDataFrame(rows, "doc_id long, text string, source string")).collect()}
    assert got[0] == "copied a\ncopied b" and got[101] == "own 1\noften"  # 6 of 61 pages


# --- near-dedup


def brute_groups(rows, percent):
    sets = {}
    for i, t in rows:
        w = re.findall(r"[^\x20\x09-\x0D]+", "".join(c.lower() if "A" <= c <= "Z" else c for c in t or ""))
        sets[i] = {tuple(w[k : k + 5]) for k in range(max(1, len(w) - 4))} if w else set()
    up = {i: i for i in sets}

    def root(x):
        while up[x] != x:
            x = up[x]
        return x

    ids = sorted(sets)
    for a in ids:
        for b in ids:
            if a < b and sets[a] and 100 * len(sets[a] & sets[b]) >= percent * len(sets[a] | sets[b]):
                x, y = sorted((root(a), root(b)))
                up[y] = x
    return {i: (len(sets[i]), root(i)) for i in ids}


@pytest.mark.parametrize("percent", [80, 85])
def test_near_groups_equal_brute_force(spark, percent):
    rng = random.Random(percent)
    rows = []
    for g in range(25):
        base = [f"v{rng.randrange(4000)}" for _ in range(rng.choice([3, 4, 5, 12, 60, 200]))]
        for _ in range(rng.choice([1, 2, 9])):
            w = list(base)
            for _ in range(rng.choice([0, 0, 1, 1, 2, 4])):
                w[rng.randrange(len(w))] = f"v{rng.randrange(4000)}"
            rows.append((len(rows), " ".join(w)))
    rows += [(900, None), (901, ""), (902, "Same WORDS Here"), (903, "same words\there")]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in near_dedup.near_groups(df, percent).collect()}
    assert got == brute_groups(rows, percent)


@pytest.mark.parametrize("block, set_block, leaders", [(8, 8, 16), (4, 8, 2), (1, 4, 1), (4, 8, 0), (8, 1000, 1)])
def test_near_many_blocks(spark, monkeypatch, block, set_block, leaders):
    """Groups over several blocks lose no link, however few the leaders reach."""
    monkeypatch.setattr(near_dedup, "BLOCK", block)
    monkeypatch.setattr(near_dedup, "SET_BLOCK", set_block)
    monkeypatch.setattr(near_dedup, "LEADERS", leaders)
    rng = random.Random(3)
    base = [f"v{i}" for i in range(120)]
    rows = []
    for i in range(80):
        w = list(base)
        for _ in range(rng.randrange(4)):
            w[rng.randrange(120)] = f"z{rng.randrange(9)}"
        rows.append((i, " ".join(w)))
    # A chain: each text shares enough with the next only.
    rows += [(100 + i, " ".join(f"c{k}" for k in range(2 * i, 2 * i + 60))) for i in range(30)]
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in near_dedup.near_groups(spark.createDataFrame(rows, "doc_id long, text string"), 85).collect()}
    assert got == brute_groups(rows, 85)


def test_near_reach():
    assert near_dedup.chunks_for(85) == 12 and near_dedup.chunks_for(80) == 16
    assert abs(near_dedup.miss_probability(85, 12) - 2.3e-6) < 1e-7 and abs(near_dedup.miss_probability(80, 16) - 3.3e-5) < 1e-6
    with pytest.raises(ValueError):
        near_dedup.chunks_for(79)


def test_staged_tables_are_dropped(spark):
    """Only what the result is read from stays."""
    before = set(os.listdir(tables.shared_dir(spark)))
    near_dedup.near_groups(spark.createDataFrame([(i, f"a b c d e f {i // 2}") for i in range(8)], "doc_id long, text string")).collect()
    left = {n.rsplit("-", 1)[0] for n in set(os.listdir(tables.shared_dir(spark))) - before}
    assert left == {"shingled", "named"}


def test_near_odd(odd, none):
    out = near_dedup.near_groups(odd).collect()
    assert len(out) == len(ODD) and all(r.kept for r in out)
    assert {r.doc_id: r.n_shingles for r in out}[4] == 1 and near_dedup.near_groups(none).count() == 0
    assert near_dedup.keep_one(odd.withColumn("n", F.lit(1)).withColumn("rep", F.lit(2))).count() == len(ODD) - 1  # one row stands twice


def test_keep_one_takes_rows(spark):
    """Rows are judged by themselves where doc_ids repeat or are null; one row of each group stays."""
    a, b, c = (" ".join(f"{x}{i}" for i in range(40)) for x in "abc")
    rows = [(0, a, "x"), (1, a, "y"), (1, b, "y"), (2, b + " more", "z"), (3, c, "x"), (3, c, "x"), (4, c, "y"), (None, c, "y"), (None, "", "n"), (5, None, "n")]
    out = near_dedup.keep_one(spark.createDataFrame(rows, "doc_id long, text string, source string")).collect()
    texts = sorted((r.text or "")[:2] for r in out)
    assert texts == ["", "", "a0", "b0", "c0"]


def test_signature_reach():
    """Pairs within reach share a file: each of the allowed errors leaves a chunk with at most one."""
    rng = random.Random(1)
    for _ in range(200):
        off = set(rng.sample(range(60), 23))
        assert any(sum(c * 5 + j in off for j in range(5)) <= 1 for c in range(12))


def test_components(spark):
    chain = [(i, i + 1) for i in range(40)] + [(100, 101), (103, 101), (7, 7)]
    got = {r.node: r.component for r in components.components(spark.createDataFrame(chain, "a long, b long")).collect()}
    assert got == {**{i: 0 for i in range(41)}, 100: 100, 101: 100, 103: 100}
    assert components.components(spark.createDataFrame([], "a long, b long")).count() == 0


def test_shingle_words_are_bytes_split():
    for t in ("", " a", "a b\x0bc\x85d é\x1fz ", "A B"):
        w, s, e = shingles.words(t.encode())
        assert [t.encode()[a:b] for a, b in zip(s, e)] == t.encode().split()
    assert len(set(shingles.words(b"aa bb aa Aa")[0])) == 2


# --- top-k


def test_topk_odd(spark):
    nan, inf = float("nan"), float("inf")
    rows = [(0, [1.0, -0.5]), (50, [0.5, 0.25]), (50, [0.5, 0.25]), (50, [0.25, -1.0]), (3, None), (4, [1.0, None]), (5, [nan, 1.0]), (6, [inf, 1.0]), (7, []), (8, [1.0, -0.5]), (8, [1.0, -0.5]), (8, [2.0, 0.5]), (9, [0.001, 0.0, 9.0]), (None, [1.0, 1.0])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>").withColumn("w", F.lit(1)).withColumn("rank", F.lit(1))
    v = topk.whole_weights(df)
    w = [(i, [int(np.floor(256 * np.float64(np.float32(x)))) for x in e]) for i, e in rows if i is not None and e is not None and all(x is not None and np.isfinite(x) for x in e)]
    want = []
    for q in (0, 50):
        s = sorted((-sum(a * b for a, b in zip(x, y)), c) for i, x in w if i == q for c, y in w if c != q)[:5]
        want += [(q, k + 1, c, -x) for k, (x, c) in enumerate(s)]
    for wave in (32 << 20, 40):
        assert sorted((r.query_id, r.rank, r.vec_id, r.score) for r in topk.top_k(v, v.where("vec_id % 50 = 0"), 5, wave).collect()) == sorted(want)
    assert topk.top_k(v.where("vec_id < 0"), v.where("vec_id < 0")).count() == 0


def test_topk_numbered_rows(spark):
    """Rows that repeat a vec_id are queries and candidates of their own."""
    rows = [(50, [1, 2], 0), (50, [3, -1], 1), (50, [3, -1], 2), (1, [2, 2], 3), (2, [2, 2], 4), (100, [-1, 5], 5)]
    v = spark.createDataFrame(rows, "vec_id long, w array<long>, row long")
    want = []
    for q, x, n in rows:
        if q % 50 == 0:
            s = sorted((-sum(a * b for a, b in zip(x, y)), c) for c, y, m in rows if m != n)[:3]
            want += [(q, k + 1, c, -z) for k, (z, c) in enumerate(s)]
    for wave in (32 << 20, 40):
        got = topk.top_k(v, v.where("vec_id % 50 = 0"), 3, wave).collect()
        assert sorted(map(tuple, got)) == sorted(want)


def test_topk_refuses_what_would_overflow(spark):
    df = spark.createDataFrame([(1, [262144.0])], "vec_id long, embedding array<double>")
    assert topk.whole_weights(df).first().w == [1 << 26]
    with pytest.raises(Exception, match="after scaling"):
        topk.whole_weights(spark.createDataFrame([(1, [1e12])], "vec_id long, embedding array<double>")).collect()


# --- passages


def test_passages_planted(spark):
    rng = random.Random(5)
    word = lambda: f"{rng.choice('bcdfg')}{rng.randrange(10**6)}"
    shared = [word() for _ in range(70)]
    fuzzy = [word() for _ in range(120)]
    rows = []
    for i in range(30):
        w = [word() for _ in range(rng.randrange(60, 300))]
        at = rng.randrange(len(w))
        if i % 3 == 0:
            w[at:at] = shared
        if i % 5 == 1:
            f = list(fuzzy)
            for k in rng.sample(range(120), 5):
                f[k : k + 1] = rng.choice([[], [word()], [f[k], word()]])
            w[at:at] = f
        rows.append((i, " ".join(w)))
    rows += [(90, None), (91, ""), (92, "a b c"), (93, "same same " * 300)]
    df = spark.createDataFrame(rows, "doc_id long, text string").withColumn("doc", F.lit(1)).withColumn("h", F.lit(2))
    found = passages.repeated_passages(df)
    texts = dict(rows)
    got = found.collect()
    exact = {(r.doc_id, r.of_doc_id) for r in got if " ".join(shared[5:65]) in texts[r.doc_id][r.start_char : r.end_char]}
    assert exact >= {(i, 0) for i in range(3, 30, 3)} and {d for d, _ in exact} == set(range(3, 30, 3))  # an older one with more of the same stands beside it
    whole = {i: set() for i in range(6, 30, 5)}
    for r in got:
        if r.doc_id in whole and r.of_doc_id % 5 == 1:
            whole[r.doc_id] |= set(texts[r.doc_id][r.start_char : r.end_char].split()) & set(fuzzy)
    assert all(len(w) >= 90 for w in whole.values())  # of the 115 words or so that are left of the passage
    assert {r.doc_id for r in got} <= {i for i in range(30) if i % 3 == 0 or i % 5 == 1}
    assert all(texts[r.of_doc_id][r.of_start : r.of_end].split()[0] == texts[r.doc_id][r.start_char : r.end_char].split()[0] for r in got)
    cut = {r.doc_id: r.text for r in passages.cut_passages(df, found).collect()}
    assert " ".join(shared) not in cut[3] and " ".join(shared) in cut[0] and cut[90] is None and cut[2] == texts[2]


def pieced(rng, pieces, words_each, same, pairs=12):
    """Rows whose last ``2 * pairs`` documents share, two and two, a passage of pieces that older ones have singly."""
    word = lambda: f"{rng.choice('bcdfg')}{rng.randrange(10**6)}"
    text = lambda n: [word() for _ in range(n)]
    rows, last, want = [], [], []
    for g in range(pairs):
        parts = [text(words_each) for _ in range(pieces)]
        rows += [(len(rows) + k, " ".join(text(80) + p + text(80))) for k, p in enumerate(parts)]
        whole = sum(parts, [])
        other = [w if rng.random() < same else word() for w in whole]
        last.append([" ".join(text(70) + w + text(70)) for w in (whole, other)])
    for both in last:
        want.append((len(rows) + 1, len(rows)))
        rows += [(len(rows) + k, t) for k, t in enumerate(both)]
    return rows, want


@pytest.mark.parametrize("pieces, words_each", [(2, 40), (3, 45), (2, 31), (4, 20)])
def test_passages_of_pieces_seen_before(spark, pieces, words_each):
    rows, want = pieced(random.Random(pieces * words_each), pieces, words_each, 1.0)
    got = {(r.doc_id, r.of_doc_id, r.n_words) for r in passages.repeated_passages(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert all(any(pair == (d, o) and n >= pieces * words_each for d, o, n in got) for pair in want)


def test_passages_odd(odd, none):
    assert passages.repeated_passages(odd).count() == 0 and passages.repeated_passages(none).count() == 0


def test_chain_is_best_collinear():
    """The Fenwick chain scores as the quadratic program does."""
    rng = random.Random(8)
    for _ in range(60):
        pts = sorted({(rng.randrange(60), rng.randrange(60)) for _ in range(rng.randrange(2, 14))})
        x, y = np.array([p[0] for p in pts]), np.array([p[1] for p in pts])
        f = []
        for j in range(len(pts)):
            f.append(1 + max([0.0] + [f[i] - passages.GAP_COST * ((x[j] - x[i]) + (y[j] - y[i])) for i in range(j) if x[i] < x[j] and y[i] < y[j]]))
        path = passages.chain(x, y)[0]
        got = len(path) - passages.GAP_COST * ((x[path[-1]] - x[path[0]]) + (y[path[-1]] - y[path[0]]))
        assert abs(got - max(f)) < 1e-9 or len(path) == len(pts)


# --- mixing


def test_targets_fill_up(spark):
    rows = [("a", 10), ("b", 1000), ("c", 50), (None, 0)]
    got = {r.source: r.target for r in source_mix.targets(spark.createDataFrame(rows, "source string, source_size long")).collect()}
    assert got["a"] == 30 and got["c"] == 150 and got[None] == 0 and abs(sum(got.values()) - 1060) < 1e-6


def test_mix_is_near_and_reruns(spark, sf_dir, odd, none):
    df = spark.read.parquet(sf_dir.replace("sf0.001", "sf0.01") + "/documents.parquet")
    one = sorted(map(tuple, source_mix.mix_rows(df, bins=64).collect()))
    assert one == sorted(map(tuple, source_mix.mix_rows(df.repartition(7)).collect()))  # the bins change nothing
    taken, most = {}, {}
    for d, s, n, size, target, k in one:
        taken[s] = taken.get(s, 0) + k * n
        most[s] = (target, max(n, most.get(s, (0, 0))[1]))
        assert 0 <= k <= 3
    assert all(abs(taken[s] - t) <= m / 2 + 1 for s, (t, m) in most.items())
    assert source_mix.mix(odd).columns == odd.columns and source_mix.mix_rows(odd).count() == len(ODD) and source_mix.mix_rows(none).count() == 0


def test_mix_weights(spark):
    """Inclusion odds follow the weights; weight 0, null or NaN takes no part in the draw."""
    rows = [(i, "w " * 10, "s", 50.0 if i < 200 else 1.0) for i in range(600)] + [(900, "w", "s", None), (901, "w", "s", float("nan"))] + [(1000 + i, "w " * 10, "t", 1.0) for i in range(900)]
    got = {r._mx_doc: r._mx_copies for r in source_mix.mix_rows(spark.createDataFrame(rows, "doc_id long, text string, source string, weight double"), weight="weight", weights=(1, 4)).collect()}
    heavy, light = sum(got[i] for i in range(200)), sum(got[i] for i in range(200, 600))
    assert abs(10 * (heavy + light) - 15002 / 5) <= 10 and heavy / 200 > 3 * light / 400 and got[900] == got[901] == 0


@pytest.mark.parametrize("rows", [
    [(i, "w " * (3 + i % 40), None) for i in range(60)],
    [(i, "w " * 100, "b") for i in range(40)] + [(100 + i, "w " * (3 + i), "a") for i in range(9)],
    [(1, "w w", "a")] + [(2 + i, "w " * 500, "b") for i in range(30)],
    [(1, None, "a"), (2, "", "a"), (3, " ", None)] + [(4 + i, "w " * (1 + 7 * i), "c") for i in range(25)],
    [(7, "w w w", "a")] * 3 + [(8, "w " * 90, "b"), (9, "w " * 10, "b"), (10, "w " * 40, "c")],
    [(i // 2, "w " * 20, f"s{i % 4}") for i in range(80)],
])
def test_mix_equals_sql_and_reaches_targets(spark, rows):
    """One source, capped sources, empty ones, equal shares and equal rows."""
    duckdb = pytest.importorskip("duckdb")
    df = spark.createDataFrame(rows, "doc_id long, text string, source string")
    con = duckdb.connect()
    con.register("documents", df.toPandas())
    want = sorted((r[0], r[1], r[4], str(r[5])) for r in con.execute(source_mix.SQL).fetchall())
    out = source_mix.mix_rows(df).collect()
    assert sorted((r._mx_doc, r._mx_size, r._mx_copies * r._mx_size, str(r._mx_source)) for r in out) == want
    assert all(r._mx_copies <= 3 for r in out)
    for source in {r._mx_source for r in out}:
        own = [r for r in out if r._mx_source == source]
        assert abs(sum(r._mx_copies * r._mx_size for r in own) - own[0]._mx_target) <= max(r._mx_size for r in own) / 2 + 1e-6
    assert source_mix.mix(df).count() == sum(r._mx_copies for r in out)


# --- classifiers


@pytest.mark.parametrize("op, label, parts, out, least", [(toxicity.toxicity, "toxic", 4, 2, 0.85), (quality_mil.quality, "quality", 5, 0, 0.97)])
def test_held_out_accuracy(spark, sf_dir, op, label, parts, out, least):
    big = sf_dir.replace("sf0.001", "sf0.01")
    docs, labels = spark.read.parquet(f"{big}/documents.parquet"), spark.read.parquet(f"{big}/labels.parquet")
    rows = op(docs, labels).join(labels, "doc_id").toPandas()
    assert (rows["held_out"] == [zlib.crc32(str(i).encode()) % parts == out for i in rows["doc_id"]]).all()
    held = rows[rows["held_out"]]
    assert (held["predicted"] == held[label]).mean() >= least
    assert rows["score"].between(0, 1).all()


@pytest.mark.parametrize("op", [toxicity.toxicity, quality_mil.quality])
def test_classifier_odd(spark, odd, none, op):
    empty = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    some = spark.createDataFrame([(4, 1, 1), (5, 0, 0), (6, None, None), (None, 1, 1), (1, 0, 0), (2, 1, 0), (2, 0, 1)], "doc_id long, quality int, toxic int")
    for labels in (empty, some):
        out = op(odd.withColumn("score", F.lit(1)).withColumn("label", F.lit(2)), labels).collect()
        assert len(out) == len(ODD) and all(0 <= r.score <= 1 and r.predicted == int(r.score >= 0.3) for r in out)
    assert op(none, some).count() == 0


def test_learning_rows_are_of_the_fold(spark):
    docs = spark.createDataFrame([(i, f"t{i}") for i in range(200)], "doc_id long, text string")
    labels = spark.createDataFrame([(i, i % 2) for i in range(200)], "doc_id long, toxic int")
    rows, share = labelled.learning_rows(docs, labels, "toxic", 4, 2, 20)
    got = rows.collect()
    assert len(got) == 40 and all(zlib.crc32(r.text[1:].encode()) % 4 != 2 for r in got) and 0.4 < share < 0.6


def plain_grams(text):
    """The hashed n-grams by loops over characters."""
    chars, out = [ord(c) for c in f" {' '.join(text.lower().split())} "], set()
    for n in toxicity.SIZES:
        for i in range(len(chars) - n + 1):
            h = n
            for j in range(n):
                h = (h + chars[i + j] * int(toxicity._MULTIPLY[n, j])) % 2**32
            h ^= h >> 15
            h = h * 0x2C1B3C6D % 2**32
            h ^= h >> 12
            out.add((h * 0x297A2D39 % 2**32) >> (32 - toxicity.BITS))
    return out


def test_toxicity_equals_plain_loops():
    """Features, log-count ratios and scores, counted one by one."""
    rng = random.Random(12)
    texts = ["".join(rng.choice("abcé \n👍") for _ in range(rng.randrange(0, 60))) for _ in range(40)]
    labels = [i % 3 == 0 for i in range(40)]
    sets = [plain_grams(t) for t in texts]
    assert [set(toxicity.grams(t).tolist()) for t in texts] == sets
    counts = {True: {}, False: {}}
    for s, y in zip(sets, labels):
        for f in s:
            counts[y][f] = counts[y].get(f, 0) + 1
    total = {y: (1 << toxicity.BITS) + sum(c.values()) for y, c in counts.items()}
    ids = np.concatenate([toxicity.grams(t) for t in texts])
    r = toxicity.log_count_ratios(ids, np.repeat(labels, [len(s) for s in sets]))
    for f in set().union(*sets) | {1, 2, 3}:
        want = np.log((1 + counts[True].get(f, 0)) / total[True]) - np.log((1 + counts[False].get(f, 0)) / total[False])
        assert abs(r[f] - want) < 1e-5
    model = toxicity.train(texts, [int(y) for y in labels], 0.3)
    for t, s, got in zip(texts, sets, toxicity.score(model, texts)):
        assert abs(got - 1 / (1 + np.exp(-(sum(float(model["v"][f]) for f in s) + model["b"])))) < 1e-6
    assert not model["v"][r == 0].any()  # features without evidence have no say


def test_attention_equals_plain_loops():
    """Scores by loops over passages, and the gradient by small steps."""
    rng = np.random.default_rng(4)
    d, hid, gate = quality_mil.TRIGRAMS + quality_mil.SHAPE, 5, 3
    m = {"W": rng.normal(0, 0.3, (d, hid)), "c": rng.normal(0, 0.3, hid), "V": rng.normal(0, 0.5, (hid, gate)), "U": rng.normal(0, 0.5, (hid, gate)), "a": rng.normal(0, 0.5, gate), "o": rng.normal(0, 0.5, hid), "b": np.array(0.2)}
    sizes, y, weight = [1, 4, 2], np.array([1.0, 0.0, 1.0]), np.array([1.0, 2.0, 0.5])
    x, begin = rng.normal(0, 1, (7, d)), np.array([0, 1, 5])

    def plain(m):
        out, at = [], 0
        for n in sizes:
            codes = [np.tanh(m["c"] + sum(x[k, i] * m["W"][i] for i in range(d))) for k in range(at, at + n)]
            raw = [sum(m["a"][j] * np.tanh(h @ m["V"][:, j]) / (1 + np.exp(-(h @ m["U"][:, j]))) for j in range(gate)) for h in codes]
            att = np.exp(raw) / np.exp(raw).sum()
            out.append(1 / (1 + np.exp(-(sum(w * h for w, h in zip(att, codes)) @ m["o"] + m["b"]))))
            at += n
        return np.array(out)

    loss = lambda m: float(np.mean(weight * -(y * np.log(plain(m)) + (1 - y) * np.log(1 - plain(m)))))
    assert np.allclose(quality_mil.forward(m, x, begin)[-1], plain(m))
    grad = quality_mil.gradient(m, x, begin, y, weight)
    for k in m:
        for at in list(np.ndindex(m[k].shape))[:: 1 if m[k].size < 20 else 97]:
            up, down = {**m, k: m[k].copy()}, {**m, k: m[k].copy()}
            up[k][at] += 1e-5
            down[k][at] -= 1e-5
            assert abs((loss(up) - loss(down)) / 2e-5 - grad[k][at]) < 1e-7


@pytest.mark.parametrize("op", [toxicity.toxicity, quality_mil.quality])
def test_repeated_ids_each_get_their_score(spark, op):
    """Rows that share a labelled id are all learnt from and each scored by their own text."""
    rows = [(i, f"{'bad awful' if i % 2 else 'fine good'} words {i} here") for i in range(60)] + [(7, "bad awful once more"), (7, "bad awful once more"), (7, None)]
    labels = spark.createDataFrame([(i, i % 2, i % 2) for i in range(50)] + [(7, 1, 1)], "doc_id long, quality int, toxic int")
    out = op(spark.createDataFrame(rows, "doc_id long, text string"), labels).collect()
    mine = sorted(r.score for r in out if r.doc_id == 7)
    assert len(out) == len(rows) and len(mine) == 4 and len(set(mine)) == 3


def test_grams_are_distinct():
    ids = toxicity.grams("aaaa aaaa aaaa")
    assert len(ids) == len(set(ids.tolist())) and len(toxicity.grams("")) == 0


# --- BPE


@pytest.fixture(scope="module")
def enc():
    pytest.importorskip("public_tokenizers")
    return bpe.Encoder(bpe.vocabulary())


def plain(enc, texts):
    return [np.array(e.ids, "<u4").tobytes() for e in enc.lib.encode_batch(texts, add_special_tokens=False)]


def test_bpe_equals_library(enc, monkeypatch):
    monkeypatch.setattr(bpe, "MASK", 15)
    monkeypatch.setattr(bpe, "LEAST", 6)
    rng = random.Random(2)
    parts = ["a", "the ", "'s", " ", "\n", "\t", "é", "é", "Σ", "ΟΔΟΣ", "<|endoftext|>", "<|start", "oftext|>", " ", "\x85", "\x1c", "23", "!?", "'ll", "日本", "👍", "ß", "İ", "́", "passage of many words "]
    texts = ["".join(rng.choice(parts) for _ in range(rng.randrange(150))) for _ in range(400)]
    assert enc.encode_many(texts) == plain(enc, texts)


def test_bpe_refuses_other_vocabularies():
    tokenizers = pytest.importorskip("public_tokenizers")
    with pytest.raises(ValueError):
        bpe.Encoder(tokenizers.path("byte_bpe_50k.json"))


def test_bpe_reuses_chunks(enc):
    passage = " ".join(f"word{i} of a shared passage" for i in range(2000))
    enc.encode_many([passage])
    n = len(enc.chunks)
    enc.encode_many(["another beginning. " + passage])
    assert len(enc.chunks) - n <= 3 < n


def test_bpe_documents(spark, odd, none, enc):
    out = sorted(map(tuple, bpe.digests(odd, bpe.vocabulary()).collect()), key=str)
    want = []
    for i, t, *_ in ODD:
        ids = plain(enc, [t or ""])[0]
        text = enc.lib.decode(np.frombuffer(ids, "<u4").tolist(), skip_special_tokens=False)
        want.append((i, len(ids) // 4, hashlib.sha256(ids).hexdigest(), hashlib.sha256(text.encode()).hexdigest()))
    assert out == sorted(want, key=str) and bpe.digests(none, bpe.vocabulary()).count() == 0


# --- quality rules


def test_repeated_words_equal_brute_force(spark):
    rng = random.Random(4)
    rows = [(i, " ".join(rng.choice("abcd") for _ in range(rng.randrange(40)))) for i in range(60)]
    df = spark.createDataFrame(rows, "doc_id long, text string").withColumn("source", F.lit("s"))
    got = {r.doc_id: r.n_repeat_words for r in quality_rules.measured(df).collect()}
    for i, t in rows:
        w = t.split()
        g = [tuple(w[k : k + 5]) for k in range(len(w) - 4)]
        assert got[i] == len({k + j for k in range(len(g)) if g.count(g[k]) > 1 for j in range(5)})


def test_rules_odd(odd, none):
    out = quality_rules.judge(odd.withColumn("host", F.lit("x")).withColumn("t", F.lit(1))).collect()
    assert len(out) == len(ODD) and {r.n_words for r in out if r.doc_id in (1, 2, 3)} == {0}
    assert quality_rules.judge(none).count() == 0
    assert quality_rules.keep_good(odd).columns == odd.columns


def test_keep_good_takes_rows(spark):
    good = "a fine text with more than ten words in it for sure "
    rows = [(1, good, "a"), (1, "short", "a"), (None, "short", "a"), (None, good + "two", "a"), (3, None, "a")] + [(10 + i, good + str(i), "a") for i in range(9)]
    out = quality_rules.keep_good(spark.createDataFrame(rows, "doc_id long, text string, source string"))
    assert sorted((r.doc_id or 0) for r in out.collect()) == [0, 1, *range(10, 19)] and out.columns == ["doc_id", "text", "source"]


def test_host_verdict(spark):
    good = "a fine text with more than ten words in it for sure " * 1
    rows = [(i, "short", "bad") for i in range(40)] + [(40, good, "bad")] + [(100 + i, good, "fine") for i in range(40)] + [(200, "short", "fine"), (300, good, "new")]
    got = {r.doc_id: r.kept for r in quality_rules.judge(spark.createDataFrame(rows, "doc_id long, text string, source string")).collect()}
    assert not got[40] and got[101] and not got[200] and got[300]


# --- pipeline


def test_pipeline_stages_equal_sql(spark, sf_dir):
    """Each stage but the last against its operator's SQL over what the stage before it kept."""
    duckdb = pytest.importorskip("duckdb")
    pipeline = pytest.importorskip("corpus_pipeline")
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    text = lambda rows: sorted((r[0], r[1]) for r in rows)
    wanted = {
        "quality_rules": lambda con: con.execute(f"SELECT doc_id, text FROM documents SEMI JOIN (SELECT doc_id FROM ({quality_rules.SQL}) WHERE kept) USING (doc_id)").fetchall(),
        "line_dedup": lambda con: con.execute(f"SELECT doc_id, text FROM ({line_dedup.SQL})").fetchall(),
        "near_dedup": None,
        "source_mix": lambda con: con.execute(f"SELECT d.doc_id, d.text FROM documents d JOIN (SELECT doc_id, CAST(taken / size AS INT) AS n FROM ({source_mix.SQL}) WHERE size > 0) USING (doc_id), range(0, 3) AS r(i) WHERE i < n").fetchall(),
    }
    for name, stage in pipeline.STAGES[:-1]:
        con = duckdb.connect()
        frame = docs.toPandas()
        con.register("documents", frame)
        out = stage(spark, docs, sf_dir).cache()
        got = text(out.select("doc_id", "text").collect())
        if wanted[name]:
            assert got == text(wanted[name](con)), name
        else:
            groups = brute_groups(list(zip(frame["doc_id"], frame["text"])), 80)
            assert len(got) == len({c for _, c in groups.values()}) == len({groups[i][1] for i, _ in got})
        docs = out


def test_pipeline(spark, sf_dir, none):
    pipeline = pytest.importorskip("corpus_pipeline")
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").cache()
    seen, n = docs, [docs.count()]
    for name, stage in pipeline.STAGES[:-1]:
        seen = stage(spark, seen, sf_dir).cache()
        assert seen.columns == docs.columns
        n.append(seen.count())
    assert n[0] > n[1] == n[2] > n[3] and n[4] > 0
    assert pipeline.run(spark, sf_dir).count() == n[4]
    rows = none
    for _, stage in pipeline.STAGES:
        rows = stage(spark, rows, sf_dir)
    assert rows.count() == 0


@pytest.mark.parametrize("n", range(5))
def test_stages_take_odd_rows(spark, odd, sf_dir, n):
    pipeline = pytest.importorskip("corpus_pipeline")
    pipeline.STAGES[n][1](spark, odd, sf_dir).collect()
