"""Rules on small tables with invented rows."""

import pytest
from pyspark.sql import functions as F

from spanforge.functions import text as x
from spanforge.operators import affinity, candidates, entity, evaluate, ledger, metrics, policy, segment
from spanforge.plans import match
from spanforge.sources import ingest


def col(spark, values, expr, kind="string"):
    df = spark.createDataFrame([(i, v) for i, v in enumerate(values)], f"i int, v {kind}")
    return [r[0] for r in df.orderBy("i").select(expr(F.col("v"))).collect()]


def test_phones(spark):
    got = col(spark, ["5551234", "(555) 010-1234", "1-555-010-1234", "+44 555 010 12345", "none", "", None], x.normalize_phone)
    assert got == ["5551234", "5550101234", "5550101234", "5501012345", None, None, None]


def test_duration(spark):
    assert col(spark, [0.0, -3.0, 12.0, 10000.0, 60000.0, None], x.normalize_duration, "double") == [None, None, 12.0, 10000.0, 60.0, None]


def test_amounts(spark):
    got = col(spark, ["$1,200 and $3k, or 40 dollars each", "two dollars", "$2 million", None], x.extract_amounts)
    assert got == [[1200.0, 3000.0, 40.0], [], [2e6], None]


def test_find_terms_possessive_and_inside(spark):
    texts = spark.createDataFrame([(1, "Met at Marlow's barn, the Marlow road."), (2, "marlowe barn"), (3, None), (4, "")], "id int, text string")
    terms = spark.createDataFrame([("p1", "Marlow"), ("p2", "the marlow"), ("p3", "  ")], "project_id string, term string")
    got = {(r.id, r.project_id, r.first_token, r.hits) for r in match.find_terms(texts, terms, "id", 2).collect()}
    assert got == {(1, "p1", 2, 2), (1, "p2", 5, 1)}


def test_trigrams(spark):
    a = spark.createDataFrame([("harbor",), ("zzz",), (None,)], "a string")
    b = spark.createDataFrame([("harbour",), ("harbor",)], "b string")
    got = {(r.a, r.b): round(r.similarity, 3) for r in match.trigram_join(a, b, "a", "b", 0.5).collect()}
    assert got == {("harbor", "harbor"): 1.0, ("harbor", "harbour"): 0.5}


@pytest.mark.parametrize("lat", [0.0, 45.0, 80.0])
def test_grid_join_equals_all_pairs(spark, lat):
    import itertools
    import math

    places = [(i, lat + 0.37 * i - 2, 178.0 + 0.9 * i) for i in range(8)]
    targets = [(100 + i, lat + 0.29 * i - 1, ((178.5 + 0.8 * i + 180) % 360) - 180) for i in range(8)]
    p = spark.createDataFrame(places, "place int, lat double, lon double").withColumn("lon", F.expr("(lon + 180) % 360 - 180"))
    t = spark.createDataFrame(targets, "target int, t_lat double, t_lon double")
    got = {(r.place, r.target) for r in match.within_distance(p, t, 120.0).collect()}

    def km(a, b, c, d):
        a, b, c, d = map(math.radians, (a, b, c, d))
        return 2 * 6371 * math.asin(math.sqrt(math.sin((c - a) / 2) ** 2 + math.cos(a) * math.cos(c) * math.sin((d - b) / 2) ** 2))

    assert got == {(a[0], b[0]) for a, b in itertools.product(places, targets) if km(a[1], a[2], b[1], b[2]) <= 120}


def test_segments_cover(spark):
    texts = spark.createDataFrame([("a", "x" * 1001), ("b", ""), ("c", None), ("d", "y" * 10)], "id string, text string")
    got = {}
    for r in segment.segment_even(texts, "id", 400).orderBy("id", "span_index").collect():
        got.setdefault(r.id, []).append((r.char_start, r.char_end))
    assert got == {"a": [(0, 333), (333, 667), (667, 1001)], "b": [(0, 0)], "c": [(0, 0)], "d": [(0, 10)]}


def test_boundaries_cover_without_gap(spark):
    rows = [("a", 5000, [(900, 0.9), (950, 0.1), (4990, 0.8), (-5, 0.5), (2500, 0.2), (3500, 0.7)]), ("b", 100, []), ("c", 3000, [(1000, 0.5), (2000, 0.5)])]
    df = spark.createDataFrame(rows, "id string, length int, cuts array<struct<start:int,confidence:double>>")
    got = {}
    for r in segment.normalize_boundaries(df, "id", 200, 3).orderBy("id", "span_index").collect():
        got.setdefault(r.id, []).append((r.char_start, r.char_end))
    assert got == {"a": [(0, 900), (900, 3500), (3500, 5000)], "b": [(0, 100)], "c": [(0, 1000), (1000, 2000), (2000, 3000)]}


def test_split_natural_covers(spark):
    text = "word " * 300 + ". " + "more " * 300
    df = spark.createDataFrame([("a", text), ("b", "short"), ("c", "x" * 3000)], "id string, text string")
    got = {}
    for r in segment.split_natural(df, "id", 1000).orderBy("id", "span_index").collect():
        got.setdefault(r.id, []).append((r.char_start, r.char_end))
    for key, n in (("a", len(text)), ("b", 5), ("c", 3000)):
        spans = got[key]
        assert spans[0][0] == 0 and spans[-1][1] == n and all(p[1] == q[0] for p, q in zip(spans, spans[1:]))
        assert all(e - s <= 1560 for s, e in spans)


def test_pointer_fallbacks(spark):
    rows = [(1, "Ann: We pour the slab on Monday.", "pour the slab"), (2, "we  pour\nthe   slab today", "pour the slab today please now"), (3, "nothing here", "absent words"), (4, "nothing", "")]
    df = spark.createDataFrame(rows, "claim_id int, transcript string, claim_text string")
    got = {r.claim_id: (r.char_start, r.pointer_basis) for r in segment.locate_claim_pointers(df).collect()}
    assert got == {1: (8, "text"), 2: (None, None), 3: (None, None), 4: (None, None)}


def test_affinity_fold_caps_and_floors(spark):
    edges = spark.createDataFrame([("c", "p", 1.9), ("c", "q", 0.1)], "contact_id string, project_id string, weight double")
    ev = spark.createDataFrame([("c", "p", 1, "confirm"), ("c", "p", 2, "reject"), ("c", "q", 1, "reject"), ("c", "q", 2, "confirm"), ("d", "p", 1, "confirm")], "contact_id string, project_id string, seq int, action string")
    got = {(r.contact_id, r.project_id): round(r.weight, 6) for r in affinity.affinity_from_overrides(edges, ev, ["seq"]).collect()}
    assert got == {("c", "p"): 1.8, ("c", "q"): 0.3, ("d", "p"): 0.3}


def test_merge_twice_is_once(spark):
    old = spark.createDataFrame([("1", "+1", "Ann"), ("2", None, "Bo")], "id string, phone string, name string")
    new = spark.createDataFrame([("1", " ", "Ada"), ("2", "+2", None), ("3", "+3", "")], "id string, phone string, name string")
    once = ingest.merge_never_regress(old, new, "id", ["phone", "name"])
    twice = ingest.merge_never_regress(once, new, "id", ["phone", "name"])
    assert sorted(map(tuple, once.collect())) == sorted(map(tuple, twice.collect())) == [("1", "+1", "Ada"), ("2", "+2", "Bo"), ("3", "+3", None)]


def test_ingest_repeats_in_batch(spark):
    rows = [("a", '{"phone":"+15550101234"}', "z", "2024-01-01"), ("a", '{"phone":"+15550101234"}', "z", "2024-01-02"), ("b", "{}", None, "2024-01-01"), ("c", '{"phone":"+15550101234"}', "z", "2024-01-01")]
    df = spark.createDataFrame(rows, "interaction_id string, raw_snapshot_json string, zap_id string, d string").withColumn("ingested_at_utc", F.to_timestamp("d"))
    got = sorted((r.interaction_id, r.gate_status, r.gate_reasons) for r in ingest.ingest_call_events(df, spark.createDataFrame([("c",)], "interaction_id string")).collect())
    assert got == [("a", "fail", "i2_duplicate"), ("a", "pass", ""), ("b", "needs_human", "i1_phone_invalid,lineage_missing_warning"), ("c", "fail", "i2_duplicate")]


def test_ranks_are_dense_and_capped(spark):
    rows = [("s", f"p{i}", "affinity", 0.5, 0.5, False, None, None) for i in range(12)]
    ev = spark.createDataFrame(rows, "span_id string, project_id string, source string, weight double, score double, assigned boolean, strong boolean, evidence string")
    got = [(r.rank, r.project_id) for r in candidates.rank_candidates(candidates.flag_weak(candidates.aggregate_candidates(ev))).orderBy("rank").collect()]
    assert [r for r, _ in got] == list(range(1, 9)) and [p for _, p in got] == sorted(f"p{i}" for i in range(12))[:8]


def test_locks_never_fall(spark):
    before = spark.createDataFrame([("a", "human"), ("b", "ai"), ("c", None)], "span_id string, lock string")
    after = spark.createDataFrame([("a", "ai"), ("b", "human"), ("c", None)], "span_id string, lock string")
    assert [r.span_id for r in policy.monotonic_lock_violations(before, after).collect()] == ["a"]


def test_lane_gates(spark):
    cols = "id string, claim_type string, project_id string, char_start int, char_end int, span_hash string, pointer_type string, testimony_type string, warrant_level string, attribution_confidence double"
    good = ["decision", "p", 1, 9, "h", "transcript_span", "direct", "high", 0.9]
    cases = {"ok": {}, "pointer": {2: 9}, "null": {1: None}, "reported": {6: "reported"}, "type": {0: "fact"}, "anchor": {0: "schedule", 7: "low"}, "low": {8: 0.1}}
    rows = [(k, *(v.get(i, g) for i, g in enumerate(good))) for k, v in cases.items()]
    ctx = spark.createDataFrame([(k, False, True, False) for k in cases], "id string, contradicted boolean, in_candidates boolean, multi_project boolean")
    got = {r.id: (r.lane, r.lane_reason) for r in ledger.decide_lane(spark.createDataFrame(rows, cols), ctx).collect()}
    assert got == {"ok": ("PROMOTE", "all_gates_passed"), "pointer": ("STAGE", "invalid_pointer"), "null": ("REVIEW", "null_project"), "reported": ("REVIEW", "reported_speech"), "type": ("STAGE", "type_not_promotable"), "anchor": ("REVIEW", "schedule_not_anchored"), "low": ("REVIEW", "low_confidence")}


def test_jaro_winkler():
    assert round(entity.jaro_winkler("martha", "marhta"), 4) == 0.9611 and entity.jaro_winkler("a", "b") == 0.0 and entity.jaro_winkler("", "a") == 0.0


def test_identity_gate(spark):
    pairs = spark.createDataFrame([(1, "Ida Brook", "ida brook", True, False), (2, "Robert Stone", "Bob Stone", True, False), (3, "Jon Stone", "Don Stone", True, False), (4, "Martha Vale", "Marhta Vale", False, False), (5, "Ida Brook", "Ida Brook", True, True)], "pair_id int, name_a string, name_b string, anchored boolean, conflict boolean")
    nick = spark.createDataFrame([("robert", 1), ("bob", 1)], "name string, group int")
    assert {r.pair_id: r.gate for r in entity.identity_merge_gate(pairs, nick).collect()} == {1: "AUTO_MERGE", 2: "AUTO_MERGE", 3: "REJECT", 4: "SUGGEST", 5: "BLOCK"}


def test_exact_test():
    assert evaluate.exact_mcnemar(0, 0) == 1.0 and abs(evaluate.exact_mcnemar(1, 9) - 0.021484) < 1e-6


def test_gates(spark):
    rows = [("ok", 0, 0, 10), ("ok", 1, 10, 20), ("gap", 0, 0, 10), ("gap", 1, 12, 20), ("over", 0, 0, 10), ("over", 1, 8, 20), ("one", 0, 0, 3000)]
    spans = spark.createDataFrame(rows, "interaction_id string, span_index int, char_start int, char_end int").withColumn("is_superseded", F.lit(False))
    assert sorted(r.interaction_id for r in metrics.gate_no_gap(spans).collect()) == ["gap", "over"]
    calls = spark.createDataFrame([("ok", 3000), ("one", 3000)], "interaction_id string, transcript_chars int")
    assert [r.interaction_id for r in metrics.gate_multi_span(calls, spans).collect()] == ["one"]


def test_model_outputs(spark):
    raw = spark.createDataFrame([(1, '```json\n{"a": 1,}\n```'), (2, "nothing"), (3, None), (4, '{"a": 2}')], "i int, output string")
    good, bad = ingest.parse_model_outputs(raw, "a int")
    assert sorted((r.i, r.parsed.a) for r in good.collect()) == [(1, 1), (4, 2)] and sorted(r.i for r in bad.collect()) == [2, 3]


def test_entry(spark):
    import __spark_entry__ as e

    assert set(e.oracle_sql()) <= set(e.queries()) and len(e.queries()) > 200


def test_fuzzy_queries_take_all_rows(spark, sf_dir):
    from spanforge import catalog

    got = {(r.term, r.alias): r.score for r in catalog.QUERIES["ent09_fuzzy_alias_matches"](spark, sf_dir).collect()}
    part = spark.read.parquet(f"{sf_dir}/part.parquet").select("p_partkey", "p_name").collect()
    terms, names = {(p.p_name[:5] + str(p.p_partkey % 10)).lower() for p in part}, {p.p_name.lower() for p in part}

    def grams(w):
        w = f"  {w} "
        return {w[i : i + 3] for i in range(len(w) - 2)}

    def edits(a, b):
        row = list(range(len(b) + 1))
        for i, x in enumerate(a):
            new = [i + 1]
            for j, y in enumerate(b):
                new.append(min(row[j] + (x != y), row[j + 1] + 1, new[-1] + 1))
            row = new
        return row[-1]

    of = {w: grams(w) for w in terms | names}
    want = {}
    for a in terms:
        for b in names:
            if b.startswith(a):
                want[a, b] = 1.0 if a == b else 0.95
            else:
                d = edits(a, b) if abs(len(a) - len(b)) <= 2 else 9
                k = max(len(of[a] & of[b]) / len(of[a] | of[b]), 1 - d / 5 if d <= 2 else 0)
                if k >= 0.4:
                    want[a, b] = k
    assert got == pytest.approx(want)
    ids = {int(r.id) for r in catalog.QUERIES["ent26_suggest_contact_aliases"](spark, sf_dir).select("id").distinct().collect()}
    assert not ids or max(ids) >= 20


def test_fuzzy_alias_prefix_of_a_long_alias(spark):
    t = spark.createDataFrame([("green",)], "term string")
    a = spark.createDataFrame([("green antique chocolate lavender metallic",), ("evergreen",)], "alias string")
    got = {r.alias: r.score for r in entity.fuzzy_alias_matches(t, a).collect()}
    assert got["green antique chocolate lavender metallic"] == 0.95


def test_crossref_and_quotes_take_all_rows(spark, sf_dir):
    from spanforge import catalog
    from spanforge.sources.drivermap import Tables

    t = Tables(spark, sf_dir)
    turns = t.turns.where("text IS NOT NULL").count()
    assert catalog.QUERIES["txt17_verify_quotes"](spark, sf_dir).where("verified IS NOT NULL").count() >= turns > 0
    # Each call has the words of its own claim: all calls of projects with active claims are scored.
    own = t.claims.where("active AND project_id IS NOT NULL AND length(claim_text) > 9").select(F.col("call_id").alias("span_id"), "project_id").distinct()
    scored = catalog.QUERIES["cnd20_claim_crossref"](spark, sf_dir)
    assert own.join(scored, ["span_id", "project_id"], "left_anti").count() == 0 < own.count()


def test_find_terms_of_many_words(spark):
    texts = spark.createDataFrame([(1, "the old mill on upper creek road west, again"), (2, "the old mill on upper creek")], "id int, text string")
    terms = spark.createDataFrame([("p1", "Old Mill on Upper Creek Road West"), ("p2", "mill")], "project_id string, term string")
    assert {(r.id, r.project_id, r.first_token) for r in match.find_terms(texts, terms, "id").collect()} == {(1, "p1", 1), (1, "p2", 2), (2, "p2", 2)}
    assert match.find_terms(texts, terms.where("false"), "id").count() == 0


def test_jaro_winkler_counts_whole_transpositions():
    """Three characters out of place are one transposition, as in Winkler's own count."""
    assert round(entity.jaro_winkler("èoumentan", "èoumantan"), 4) == 0.9306 and round(entity.jaro_winkler("rendatnd", "randatnd"), 4) == 0.8821


def test_jaro_winkler_takes_long_words_in_one_pass():
    """Words of 40,000 letters, as junk has them: every letter of one used to be held against half of the other."""
    import time

    began = time.time()
    assert round(entity.jaro_winkler("ab" * 20_000, "c" * 39_999 + "b"), 4) == 0.3334
    assert time.time() - began < 5


def test_names_of_pairs_leave_the_rest_of_a_text_unsplit(spark):
    from types import SimpleNamespace

    from spanforge.registered import parts

    texts = ["", "one", "one two", "one two three", "- one two three", "1. one, two; three four five " + "x " * 500, "one two   ", "éa ßb ñc d"]
    df = spark.createDataFrame([(str(i), x) for i, x in enumerate(texts)], "interaction_id string, text string")
    out = parts._pairs(SimpleNamespace(spark=spark, texts=df))
    names = {r.pair_id: r.name_a for r in out.collect()}
    assert names == {"3": "one two", "4": "one two", "5": "one two", "7": "éa ßb"}
    assert ", 5)" in out._jdf.queryExecution().optimizedPlan().toString()
