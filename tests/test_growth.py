"""Steps whose work must grow no faster than their input."""

import random

from pyspark.sql import functions as F

from spanforge.operators import candidates, entity, facts, identity, more, segment, terms
from spanforge.plans import match


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_large_dictionaries_and_phrases_are_exchanged(spark, monkeypatch):
    texts = spark.createDataFrame([(1, "a b c"), (2, "c")], "id int, text string")
    terms = spark.createDataFrame([("b c",), ("c",)], "term string")
    want = [(1, "b c", 1, 1), (1, "c", 2, 1), (2, "c", 0, 1)]
    assert "BroadcastHashJoin" in plan(match.find_terms(texts, terms, "id"))
    monkeypatch.setattr(match, "BROADCAST_TERMS", 1)
    large = match.find_terms(texts, terms, "id")
    assert "Broadcast" not in plan(large) and sorted(map(tuple, large.collect())) == want


def test_phrases_are_made_where_a_term_begins(spark):
    """Of a text of 300 words, of which 3 places begin like a term, only these become phrases."""
    texts = spark.createDataFrame([(1, "Old mill. " + "a b " * 146 + "the old mill, the old mill road"), (2, "old")], "id int, text string")
    terms = spark.createDataFrame([("p", "old mill"), ("q", "Old Mill Road"), ("r", "the old mill road x")], "project_id string, term string")
    out = match.find_terms(texts, terms, "id", 3)
    assert sorted((r.id, r.project_id, r.first_token, r.hits) for r in out.collect()) == [(1, "p", 0, 3), (1, "q", 298, 1)]
    assert sum(int(x.metrics().apply("numOutputRows").value()) for x in _joins(out, "Generate")) <= 320


def test_short_and_long_terms_agree_by_either_way(spark, monkeypatch):
    texts = spark.createDataFrame([(1, "a b c a b"), (2, "b c"), (3, ""), (4, None), (5, "c a a a")], "id int, text string")
    terms = spark.createDataFrame([("a",), ("A b",), ("a, b c",), ("a a",), ("b c a b x",), ("c",), ("c",)], "term string")
    rows = lambda longest: sorted(map(tuple, match.find_terms(texts, terms, "id", longest).collect()))
    want = {1: [(1, "a", 0, 2), (1, "c", 2, 2), (2, "c", 1, 2), (5, "a", 1, 3), (5, "c", 0, 2)]}
    want[None] = sorted(want[1] + [(1, "A b", 0, 2), (1, "a, b c", 0, 1), (5, "a a", 1, 2)])
    for few in (50_000, 1):
        monkeypatch.setattr(match, "BROADCAST_TERMS", few)
        assert {n: rows(n) for n in want} == want


def test_mentions_join_the_best_of_a_name(spark):
    """One project has 300 contacts of a name; a span meets one of them for each way to name it."""
    people = spark.range(300).select(F.col("id").cast("string"), F.lit("Anna Berg").alias("name"), F.lit(False).alias("floats_between_projects"))
    edges = people.select(F.col("id").alias("contact_id"), F.lit("p").alias("project_id"), (F.col("id").cast("double") % 7).alias("weight"))
    texts = spark.createDataFrame([(1, "anna berg"), (2, "berg and anna"), (3, "anna")], "span_id int, text string")
    out = identity.expand_from_mentions(texts, people, edges)
    assert sorted(tuple(r) for r in out.collect()) == [(1, "p", "104", 6.0, 100), (2, "p", "104", 6.0, 80), (3, "p", "104", 6.0, 60)]
    rows = [int(x.metrics().apply("numOutputRows").value()) for x in _joins(out)]
    assert rows and max(rows) <= 300


def _joins(df, kind="Join"):
    """Join nodes of the executed plan, or others by name, with what they made."""
    qe = df._jdf.queryExecution()
    qe.toRdd().count()
    found, todo = [], [qe.executedPlan()]
    while todo:
        node = todo.pop()
        name = node.nodeName()
        if name == "AdaptiveSparkPlan":
            todo.append(node.executedPlan())
            continue
        if name.endswith("QueryStage"):
            todo.append(node.plan())
            continue
        if kind in name and node.metrics().contains("numOutputRows"):
            found.append(node)
        kids = node.children()
        todo += [kids.apply(i) for i in range(kids.size())]
    return found


def most_met(df):
    return max(int(x.metrics().apply("numOutputRows").value()) for x in _joins(df.select("*")))


def test_mail_is_counted_before_it_meets_spans(spark):
    spans = spark.sql("SELECT id AS span_id, 'c' AS contact_id, TIMESTAMP_NTZ '2024-01-10' AS event_at_utc FROM range(60)")
    mail = spark.sql("SELECT id AS message_id, 'c' AS contact_id, TIMESTAMP_NTZ '2024-01-01' + (n * 3) * INTERVAL 1 DAY AS sent_at FROM range(60), (SELECT explode(array(0, 1)) AS n)")
    out = candidates.from_email_mentions(spans, mail, mail.selectExpr("message_id", "'p' AS project_id"))
    assert {(r.project_id, r.evidence) for r in out.collect()} == {("p", "60")} and out.count() == 60
    assert most_met(out) <= 120


def test_spans_with_the_same_terms_meet_claims_once(spark):
    claims = spark.sql("SELECT lpad(id, 3, '0') AS id, 'p' AS project_id, 'small bolt' AS claim_text, true AS active, 'confirmed' AS claim_confirmation_state FROM range(40)")
    terms = spark.sql("SELECT id AS span_id, explode(array('small', 'Bolt')) AS term FROM range(50)")
    out = candidates.from_cross_contact_claims(terms, claims, spark.createDataFrame([("p", "active", "client")], "id string, status string, project_kind string"))
    assert out.count() == 50 and {(r.score, r.evidence) for r in out.collect()} == {(0.2, "40")}
    assert most_met(out) <= 100


def test_projects_of_a_type_are_counted_once(spark):
    projects = spark.createDataFrame([("1", "deck"), ("2", "deck"), ("3", "barn")], "id string, type string")
    out = candidates.from_structural_type(spark.createDataFrame([(1, "a deck"), (2, "a barn")], "span_id int, text string"), spark.createDataFrame([("deck", "deck"), ("barn", "barn")], "term string, type string"), projects)
    assert sorted((r.span_id, r.project_id, r.score) for r in out.collect()) == [(1, "1", 0.3), (1, "2", 0.3), (2, "3", 0.5)]
    assert "Window" not in plan(out)


def test_projects_of_a_trade_are_not_made_distinct_by_span(spark):
    contacts = spark.createDataFrame([("Ann", "roof"), ("Bo", "tile"), ("Cy", None)], "name string, trade string")
    links = spark.createDataFrame([("roof", "1", True), ("tile", "1", True), ("tile", "2", True), ("tile", "3", False)], "trade string, project_id string, is_active boolean")
    out = more.other_party_trade(spark.createDataFrame([(1, "Ann and Bo"), (2, "ann"), (3, "Cy")], "span_id int, speaker string"), contacts, links)
    assert sorted((r.span_id, r.project_id) for r in out.collect()) == [(1, "1"), (1, "2"), (2, "1")]
    assert not out._jdf.queryExecution().optimizedPlan().nodeName().endswith("Aggregate")


def test_a_trade_reaches_projects_of_all_ids(spark, sf_dir):
    """A registered query that read only projects whose ids begin with 0 or 1, and an operator that knew names of two words."""
    from spanforge import catalog

    assert {r[0] for r in catalog.QUERIES["cnd12_other_party_trade"](spark, sf_dir).selectExpr("left(project_id, 1)").distinct().collect()} > {"2", "5", "9"}
    out = more.other_party_trade(spark.createDataFrame([(1, "Ann van Dyck"), (2, "Ann van")], "span_id int, speaker string"), spark.createDataFrame([("Ann van Dyck", "roof")], "name string, trade string"), spark.createDataFrame([("roof", "7", True)], "trade string, project_id string, is_active boolean"))
    assert [tuple(r) for r in out.select("span_id", "project_id").collect()] == [(1, "7")]


def test_spans_of_one_group_meet_its_members_in_all_partitions(spark):
    """One trade and one type have all spans and all projects: their pairs were made in one task."""
    made = lambda out: [r["count"] for r in out.groupBy(F.spark_partition_id()).count().collect()]
    ids = lambda n, *more_: spark.range(n).selectExpr("CAST(id AS STRING) AS id", *more_)
    typed = candidates.from_structural_type(ids(400, "'a deck' AS text").withColumnRenamed("id", "span_id"), spark.createDataFrame([("deck", "deck")], "term string, type string"), ids(50, "'deck' AS type"))
    traded = more.other_party_trade(ids(400, "'Ann' AS speaker").withColumnRenamed("id", "span_id"), spark.createDataFrame([("Ann", "roof")], "name string, trade string"), ids(50, "'roof' AS trade", "true AS is_active").withColumnRenamed("id", "project_id"))
    for out in (typed, traded):
        assert out.select("span_id", "project_id").distinct().count() == out.count() == 20_000
        assert len(made(out)) > 1 and max(made(out)) < 15_000


def test_holders_of_an_alias_are_counted_once(spark):
    contacts = spark.sql("SELECT id, 'N' || id AS name, CAST(NULL AS STRING) AS company, array('Bob') AS aliases FROM range(80)")
    out = entity.contact_alias_collisions(contacts.selectExpr("id AS contact_id", "'bob' AS alias").union(spark.sql("SELECT 99L, 'BOB'")), contacts)
    assert {(r.contact_id == 99, r.kind, r.n_contacts) for r in out.collect()} == {(False, "alias", 79), (True, "alias", 80)} and out.count() == 81
    assert most_met(out) <= 200


def test_keyed_state_stays_in_the_engine(spark, tmp_path):
    """First rows of a key are told apart without a Python call a key."""
    from spanforge.streaming import jobs

    spark.sql("SELECT CAST(id % 4 AS STRING) AS contact_id, CAST(id % 8 AS STRING) AS interaction_id, TIMESTAMP '2024-01-01' + id * INTERVAL 1 HOUR AS event_at_utc, id AS chars FROM range(24)").write.parquet(f"{tmp_path}/in")
    rows = spark.readStream.schema(spark.read.parquet(f"{tmp_path}/in").schema).parquet(f"{tmp_path}/in")
    query = jobs.running_contact_stats(rows, f"{tmp_path}/out", f"{tmp_path}/c")
    query.awaitTermination()
    names = {s["operatorName"] for s in query.lastProgress["stateOperators"]}
    assert names and not any("transformWithState" in n for n in names)
    assert sorted(tuple(r)[:3] for r in jobs.contact_totals(spark, f"{tmp_path}/out").select("contact_id", "interaction_count", "total_chars").collect()) == [("0", 2, 4), ("1", 2, 6), ("2", 2, 8), ("3", 2, 10)]


def test_terms_are_whole_words_of_any_letters_in_both_engines(spark):
    import duckdb

    from spanforge import catalog
    from spanforge.functions.text import high_signal_terms

    texts = ["stx345ñ and abc-123", "é12 oak road", "12 oak road, 15 feet of ßx345", "x345 x346", "_ab123 ab1234"]
    con = duckdb.connect()
    con.execute("CREATE TABLE documents AS SELECT unnest(range(5)) AS doc_id, unnest(?) AS text, 'en' AS lang, 's' AS source", [texts])
    want = con.execute(catalog.ORACLES["txt14_high_signal_terms"]).fetchall()
    got = high_signal_terms(spark.createDataFrame([(str(i), t) for i, t in enumerate(texts)], "interaction_id string, text string"), "interaction_id")
    assert sorted(map(tuple, got.collect())) == sorted(want) and ("3", "x346", 82, 2) in want


def test_equal_distances_go_by_id(spark):
    import math

    from spanforge.operators.ledger import vector_search

    v = [math.sin(i * i) for i in range(64)]
    claims = spark.createDataFrame([(i, [x * (1 + i / 7) for x in v]) for i in range(40)], "id long, embedding array<double>")
    out = vector_search(claims.where("id = 39").selectExpr("id AS query_id", "embedding"), claims, 8, 0.9)
    assert [(r.id, r.distance) for r in out.orderBy("rank").collect()] == [(i, 0.0) for i in range(8)]


def test_vector_blocks_meet_in_any_partition(spark):
    """Blocks lie in partitions of their own, as those of large tables do."""
    from spanforge.operators.ledger import vector_search

    claims = spark.range(40).selectExpr("id", "array(cos(id / 9D), sin(id / 9D)) AS embedding")
    near = lambda block: sorted(map(tuple, vector_search(claims.where("id % 5 = 0").selectExpr("id AS query_id", "embedding"), claims, 3, 0.9, block).collect()))
    want = {q: sorted((i for i in range(40) if i != q), key=lambda i: (abs(i - q), i))[:3] for q in range(0, 40, 5)}
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        for block in (4096, 8, 3):
            assert [(q, rank, i) for q, i, _, rank in sorted(near(block), key=lambda r: (r[0], r[3]))] == [(q, n, i) for q in want for n, i in enumerate(want[q], 1)]
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")


def test_candidates_by_contact_equal_those_by_span(spark):
    spans = spark.sql("SELECT CAST(id AS STRING) AS span_id, CAST(id % 3 AS STRING) AS contact_id, CASE WHEN id % 5 > 0 THEN CAST(id % 6 AS STRING) END AS project_id, 'roof' AS trade, id % 2 = 0 AS is_floater FROM range(40)")
    links = spark.sql("SELECT CAST(id % 2 AS STRING) AS contact_id, CAST(id AS STRING) AS project_id, CASE WHEN id > 2 THEN 'roof' END AS trade, id <> 4 AS is_active FROM range(6)")
    edges = spark.sql("SELECT CAST(id % 3 AS STRING) AS contact_id, CAST(id AS STRING) AS project_id, CAST(id AS DOUBLE) / 4 AS weight FROM range(9)")
    want = candidates.aggregate_candidates(candidates.from_project_contacts(spans, links), candidates.from_affinity(spans, edges), candidates.from_existing_project(spans))
    by_contact = candidates.contact_candidates(spans, links, edges)
    rows = lambda df: sorted(str(tuple(r)) for r in df.withColumn("score", F.round("score", 9)).select(want.columns).collect())
    got = candidates.span_candidates(spans, by_contact)
    assert rows(got) == rows(want)
    ranked = lambda df: sorted((r.span_id, r["rank"], r.project_id) for r in candidates.rank_candidates(candidates.flag_weak(df), 2).collect())
    assert ranked(candidates.span_candidates(spans, by_contact, cap=2)) == ranked(want)
    assert not got._jdf.queryExecution().optimizedPlan().nodeName().endswith("Aggregate")


def test_positions_meet_once(spark, monkeypatch):
    seen = []

    def spy(places, targets, km):
        seen.append((places.count(), targets.count()))
        return match.within_distance(places, targets, km)

    monkeypatch.setattr(candidates, "within_distance", spy)
    places = spark.createDataFrame([(f"s{i % 3}", f"p{i}", float(i % 2), 0.0, "origin" if i % 4 else "destination") for i in range(60)] + [("s0", "p9", None, 0.0, "origin")], "span_id string, place string, lat double, lon double, role string")
    projects = spark.createDataFrame([(f"{i:03d}", float(i % 2) / 10, 0.0) for i in range(80)] + [("two", 0.0, 0.0), ("two", 1.0, 0.0), ("far", 80.0, 0.0), ("none", None, 0.0)], "id string, lat double, lon double")
    got = {(r.span_id, r.project_id) for r in candidates.from_geo(places, projects, 30.0).collect()}
    assert got == {(s, p) for s in ("s0", "s1", "s2") for p in ("000", "002", "004", "006", "008")}
    assert seen[0][0] <= 3 and seen[0][1] <= 7
    # A project of two positions counts the places at both.
    assert [round(r.score, 4) for r in candidates.from_geo(places, projects.where("id = 'two'"), 30.0).collect()] == [0.55] * 3


def test_classes_are_given_to_different_words(spark):
    text = "Pay $1,200 for the red door, said Anna and Anna. " * 3
    out = terms.tagged_terms(spark.createDataFrame([(1, text)], "id int, text string"), "id", (r"\b(red [a-z]+)",), ["door"], ["the", "and"])
    got = {r.term: r["class"] for r in out.collect()}
    assert (got["$1,200"], got["red door"], got["anna"], got["door"], got["pay"]) == ("dollar", "compound", "proper", "domain", "generic") and len(got) == out.count()
    assert "array_distinct(concat(" not in plan(out)


def test_cuts_are_found_without_a_look_at_each_character(spark):
    rng = random.Random(4)
    texts = [(i, "".join(rng.choice("ab. \n😀é") if rng.random() < 0.05 * (i % 4) else "x" for _ in range(rng.randrange(0, 900)))) for i in range(40)]
    target, reach, want = 120, 50, {}
    for i, t in texts:
        cuts = [0]
        while cuts[-1] + target + reach < len(t):
            w = cuts[-1] + target
            places = lambda signs: [(abs(p - w), p) for p in range(w - reach + 1, w + reach + 1) if t[p - 1] in signs]
            cuts.append(min(places("\n.!?") or places(" \n") or [(0, w)])[1])
        want[i] = list(zip(cuts, cuts[1:] + [len(t)]))
    out = segment.split_natural(spark.createDataFrame(texts, "id int, text string"), "id", target, reach)
    got = {}
    for r in out.orderBy("id", "span_index").collect():
        got.setdefault(r.id, []).append((r.char_start, r.char_end))
    assert got == want and "RLIKE" not in plan(out)


def test_speakers_read_labels_once(spark, tmp_path):
    """Labels are scanned once, however many ways lead from them to a contact."""
    at = str(tmp_path / "labels")
    spark.createDataFrame([("Anna Berg", "p"), ("Anna", "q")], "label string, project_id string").write.parquet(at)
    people = spark.createDataFrame([("1", "Anna Berg", ["annie"], False)], "id string, name string, aliases array<string>, is_internal boolean")
    edges = spark.createDataFrame([("1", "p", 0.5), ("1", "p", 0.7), ("1", "x", 2.0)], "contact_id string, project_id string, weight double")
    out = entity.resolve_speakers(spark.read.parquet(at), people, edges)
    assert plan(out).count("FileScan") == 1
    assert sorted(map(tuple, out.collect())) == [("Anna", "q", "1", 65, "first_name_prefix", 65.0), ("Anna Berg", "p", "1", 100, "exact_name", 107.0)]


def test_crossref_meets_projects_not_words(spark):
    """60 words of a span and 60 of a project begin alike; the span meets the project once."""
    alike = lambda i: f"abcde{chr(97 + i // 10)}{chr(97 + i % 10)}"
    spans = spark.createDataFrame([("s", " ".join(map(alike, range(60)))), ("t", "abcd abcdef none")], "span_id string, text string")
    pairs = spark.createDataFrame([("s", "p"), ("s", "q"), ("t", "p"), ("t", "r")], "span_id string, project_id string")
    claims = spark.createDataFrame([(True, "p", " ".join(map(alike, range(60)))), (True, "q", "abcde and abcd"), (True, "q", None), (False, "r", "none")], "active boolean, project_id string, claim_text string")
    out = candidates.claim_crossref(spans, pairs, claims)
    assert most_met(out) <= 4
    # Of two projects with claims both have each term of s; abcdef begins like words of p, and r has no active claims.
    assert sorted(map(tuple, out.collect())) == [("s", "p", 1.0, 60), ("s", "q", 1.0, 60)] + [("t", "p", 0.082, 1)]


def test_calls_of_a_speaker_share_its_projects(spark):
    """40 calls of a speaker with 30 projects: pairs are made once, by the last join."""
    calls = spark.range(40).select(F.col("id").cast("string").alias("interaction_id"), F.lit("a").alias("contact_id")).unionByName(spark.createDataFrame([("7", "b"), ("7", "b"), ("8", None), (None, "b")], "interaction_id string, contact_id string"))
    people = spark.createDataFrame([("a", "other", True), ("b", "client", False)], "id string, contact_type string, is_internal boolean")
    edges = spark.range(30).select(F.lit("a").alias("contact_id"), F.col("id").cast("string").alias("project_id"), F.lit(1.0).alias("weight")).unionByName(spark.createDataFrame([("b", "3", 1.0), ("b", "x", 0.5), ("b", "y", 0.0)], "contact_id string, project_id string, weight double"))
    out = entity.expand_from_speakers(calls, people, edges)
    want = {(str(i), str(p)): (0.7, 1) for i in range(40) for p in range(30)} | {("7", "3"): (0.95, 2), ("7", "x"): (0.95, 1), (None, "3"): (0.95, 1), (None, "x"): (0.95, 1)}
    assert {(r.interaction_id, r.project_id): (r.score, r.n_speakers) for r in out.collect()} == want
    assert "Aggregate" not in plan(out).split("Join")[0]


def test_references_meet_one_row_of_facts(spark):
    """50 references to a project of 20 facts meet one row each, and take the same fact as by pairs."""
    known = spark.range(20).select(F.format_string("f%02d", "id").alias("fact_id"), F.lit("p").alias("project_id"), F.lit("scope").alias("fact_kind"), F.col("id").alias("as_of_at"), F.concat(F.lit("word"), F.col("id")).alias("fact_payload"))
    asked = spark.range(50).select(F.col("id").cast("string").alias("span_id"), F.lit("1").alias("ref_id"), F.lit("p").alias("project_id"), F.lit("scope").alias("fact_kind"), F.when(F.col("id") < 20, F.col("id")).alias("fact_as_of_at"), F.when(F.col("id") < 40, F.concat(F.lit("the word"), F.col("id") % 20)).alias("fact_excerpt"))
    out = facts.matched_facts(asked, known)
    assert most_met(out) == 50
    # By time; else by words, where word1 stands in word10 to word19 too and the newest of them counts; else the newest.
    by_word = {f"{i}": "f19" if i == 21 else f"f{i - 20:02}" for i in range(20, 40)}
    assert {r.span_id: r.fact_id for r in out.collect()} == {f"{i}": f"f{i:02}" for i in range(20)} | by_word | {f"{i}": "f19" for i in range(40, 50)}


def test_a_denial_stays_in_its_text(spark):
    """A negation in one text of a span denies no word at that place of another."""
    texts = spark.createDataFrame([("s", "there is no door"), ("s", "we see the panel"), ("t", "never that big, old panel"), ("u", "not well, panel")], "span_id string, text string")
    assert {(r.span_id, *sorted(r.denied)) for r in facts.denied_words(texts).collect()} == {("s", "door"), ("t", "big", "that"), ("u", "well")}


def test_tiers_are_found_in_the_text_and_not_exchanged_by_tier(spark):
    texts = spark.createDataFrame([("1", "an economy or promo part"), ("2", "Large part, large house"), ("3", "economy-like"), ("4", None), ("5", "nothing")], "span_id string, text string")
    tiers = spark.createDataFrame([("economy", "small", 0.0, 10.0), ("promo", "small", 0.0, 10.0), ("large house", "upper", 90.0, 110.0)], "term string, tier string, low double, high double")
    projects = spark.createDataFrame([("a", 5.0), ("b", 100.0)], "id string, contract_value double")
    with_nearest = candidates.from_budget_tier(texts, tiers, projects, nearest=1)
    want = [("1", "a", "small"), ("2", "b", "upper"), ("3", "a", "small")]
    assert sorted((r.span_id, r.project_id, r.evidence) for r in with_nearest.collect()) == want
    top = plan(with_nearest).split("HashAggregate")[0]
    assert "BroadcastHashJoin" in top and "Exchange" not in top


def test_groups_of_a_large_dictionary_are_the_same(spark, monkeypatch):
    texts = spark.createDataFrame([(1, "a b c"), (2, "c c"), (3, "b")], "id int, text string")
    terms = spark.createDataFrame([("b c", "x"), ("c", "x"), ("c", "y"), ("", "z")], "term string, kind string")
    few = sorted(map(tuple, match.named_groups(texts, terms, "id", "kind").collect()))
    monkeypatch.setattr(match, "FEW_TERMS", 1)
    assert few == sorted(map(tuple, match.named_groups(texts, terms, "id", "kind").collect())) == [(1, "x"), (1, "y"), (2, "x"), (2, "y")]
