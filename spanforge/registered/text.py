"""Queries of the text and segmentation operators."""

from pyspark.sql import functions as F

from ..functions import text as x
from ..operators import segment as s
from . import register

TURNS = "tr AS (SELECT interaction_id, string_agg(speaker || ': ' || text, chr(10) ORDER BY turn) AS text FROM turns GROUP BY 1)"


def _calls(t):
    """Transcripts with speaker labels, one per conversation."""
    lines = t.turns.groupBy("interaction_id").agg(F.array_sort(F.collect_list(F.struct("turn", F.concat("speaker", F.lit(": "), "text").alias("l")))).alias("a"))
    return lines.select("interaction_id", F.array_join(F.transform("a", lambda z: z["l"]), "\n").alias("text"))


WORDS4 = "list_distinct(list_filter(string_split_regex(lower({c}), '[^a-z0-9]+'), lambda w: length(w) >= 4 OR length(w) = 3 AND NOT regexp_matches(w, '^[0-9]+$')))"

register("txt01_strip_speaker_labels", lambda t: _calls(t).select("interaction_id", x.strip_speaker_labels(F.col("text")).alias("text")), "turns", f"WITH {TURNS} SELECT interaction_id, regexp_replace(text, '(?m)^[A-Z][A-Za-z]*(?: [A-Z][A-Za-z]*){{0,3}}:[ \\t]*', '', 'g') AS text FROM tr")
register("txt02_sanitize", lambda t: t.texts.select("interaction_id", F.md5(x.sanitize_text(F.col("text"), True)).alias("clean"), x.control_count(F.col("text")).alias("controls")), "texts", "SELECT interaction_id, md5(trim(regexp_replace(regexp_replace(text, '[\\x00-\\x08\\x0b\\x0c\\x0e-\\x1f\\x7f]', ' ', 'g'), '[ \\t\\n\\r]+', ' ', 'g'))) AS clean, CAST(0 AS INT) AS controls FROM texts")
register("txt04_token_overlap", lambda t: t.turns.where("turn = 0").join(t.turns.where("turn = 1").select("interaction_id", F.col("text").alias("reply")), "interaction_id").select("interaction_id", F.size(x.token_overlap(F.col("text"), F.col("reply"))).alias("shared")), "turns", f"SELECT a.interaction_id, CAST(len(list_intersect({WORDS4.format(c='a.text')}, {WORDS4.format(c='b.text')})) AS INT) AS shared FROM turns a JOIN turns b ON a.interaction_id = b.interaction_id AND a.turn = 0 AND b.turn = 1")
register("txt05_normalize_alias_terms", lambda t: x.normalize_alias_terms(t.part.selectExpr("p_brand AS project_id", "CASE WHEN p_partkey % 2 = 0 THEN upper(p_name) ELSE ' ' || p_name END AS alias", "p_partkey AS position"), 8, 10), "", """
WITH a AS (SELECT p_brand AS project_id, trim(CASE WHEN p_partkey % 2 = 0 THEN upper(p_name) ELSE ' ' || p_name END) AS alias, p_partkey AS position FROM part), b AS (SELECT * FROM a WHERE length(alias) >= 8 QUALIFY row_number() OVER (PARTITION BY project_id, lower(alias) ORDER BY position, alias) = 1)
SELECT project_id, alias FROM b QUALIFY row_number() OVER (PARTITION BY project_id ORDER BY position, alias) <= 10""")
register("txt07_snippet_around", lambda t: t.texts.where("length(text) > 0").select("interaction_id", F.md5(x.snippet_around(F.col("text"), F.floor(F.length("text") / 2).cast("int") + 1, F.lit(5))).alias("snippet")), "texts", r"""
WITH p AS (SELECT *, length(text) AS n, length(text) // 2 + 1 AS st FROM texts WHERE length(text) > 0), q AS (SELECT *, greatest(1, st - 40) AS lo, least(n, st + 4 + 40) AS hi FROM p)
SELECT interaction_id, md5(CASE WHEN lo > 1 THEN '...' ELSE '' END || substr(trim(regexp_replace(substr(text, lo, hi - lo + 1), '\s+', ' ', 'g')), 1, 100) || CASE WHEN hi < n THEN '...' ELSE '' END) AS snippet FROM q""")
register("txt08_truncate_around", lambda t: t.texts.select("interaction_id", F.md5(x.truncate_around(F.col("text"), F.lit(100), F.lit(301), 300)).alias("cut")), "texts", "SELECT interaction_id, md5(CASE WHEN length(text) <= 300 THEN text ELSE substr(text, CAST(greatest(1, least(floor(401 / 2.0 - 150), length(text) - 299)) AS INT), 300) END) AS cut FROM texts")
register("txt09_normalize_phone", lambda t: t.contacts.select("id", x.normalize_phone(F.col("phone")).alias("p1"), x.normalize_phone(F.col("secondary_phone")).alias("p2")), "contacts", "SELECT id, right(regexp_replace(phone, '[^0-9]', '', 'g'), 10) AS p1, right(regexp_replace(secondary_phone, '[^0-9]', '', 'g'), 10) AS p2 FROM contacts")
register("txt10_extract_amounts", lambda t: t.orders.selectExpr("o_orderkey", "'about $' || CAST(CAST(o_totalprice AS BIGINT) AS STRING) || CASE WHEN o_orderkey % 2 = 0 THEN 'k and ' ELSE ' and ' END || CAST(o_custkey AS STRING) || ' dollars' AS text").select("o_orderkey", F.aggregate(x.extract_amounts(F.col("text")), F.lit(0.0), lambda a, b: a + b).alias("total")), "", "SELECT o_orderkey, CAST(trunc(o_totalprice) AS BIGINT) * CASE WHEN o_orderkey % 2 = 0 THEN 1000.0::DOUBLE ELSE 1.0::DOUBLE END + o_custkey AS total FROM orders")
register("txt16_normalize_quote", lambda t: t.texts.select("interaction_id", F.md5(x.normalize_quote(F.col("text"))).alias("q")), "texts", "SELECT interaction_id, md5(trim(regexp_replace(regexp_replace(regexp_replace(translate(lower(text), '‘’“”–— ', '''''\"\"-- '), '[''\"]', '', 'g'), '-', ' ', 'g'), '[^a-z0-9]+', ' ', 'g'))) AS q FROM texts")
register("txt17_verify_quotes", lambda t: x.verify_quotes(t.turns.select(F.concat_ws("-", "interaction_id", "turn").alias("anchor_id"), F.expr("replace(substr(text, 20, 40), 'e', 'a')").alias("quote"), "text")))
register("txt18_extract_speakers", lambda t: x.extract_speakers(_calls(t)), "turns", f"WITH {TURNS}, l AS (SELECT interaction_id, regexp_extract(unnest(string_split(text, chr(10))), '^\\s*([A-Za-z][A-Za-z .''-]{{0,40}}):', 1) AS speaker FROM tr) SELECT interaction_id, speaker, count(*) AS n_lines FROM l WHERE speaker <> '' GROUP BY 1, 2")
CALLED = "SELECT interaction_id || '-' || CAST(turn AS STRING) AS interaction_id, CASE length(text) % 7 WHEN 0 THEN 'Hi: please leave a message after the tone. ' WHEN 1 THEN 'Can you hear me? Call dropped ' WHEN 2 THEN 'the estimate, call failed ' WHEN 3 THEN 'Ann Lee: yes' || chr(10) || 'Bo: no ' ELSE '' END || text AS text, CAST(length(text) * 7 % 20000 AS DOUBLE) AS duration_seconds FROM {t}"
_ANY = lambda family: " || ".join(f"CASE WHEN regexp_matches(text, '(?i){p.replace(chr(39), chr(39) * 2)}') THEN '{code}|' ELSE '' END" for code, p in family.items())
register("txt19_junk_prefilter", lambda t: x.junk_prefilter(t.spark.sql(CALLED, t=t.turns)), "turns", f"""
WITH a AS ({CALLED.format(t="turns")}), b AS (SELECT interaction_id, len(regexp_extract_all(text, '(?i)[a-z0-9'']+')) AS words, len(regexp_extract_all(trim(text), '{x.TURN}')) AS turns, CAST(floor(CASE WHEN duration_seconds <= 0 THEN NULL WHEN duration_seconds > 10000 THEN duration_seconds / 1000.0::DOUBLE ELSE duration_seconds END + 0.5) AS BIGINT) AS seconds,
  regexp_matches(text, '(?i){"|".join(x.SUBSTANCE)}') AS substantive, {_ANY(x.VOICEMAIL)} AS v, {_ANY(x.CONNECTION)} AS c FROM a),
f AS (SELECT *, words > 0 AND words < 20 AS few, coalesce(seconds < 15, false) AS short, v <> '' AND words <= 80 AS jv, c <> '' AND words <= 40 AND NOT substantive AS jc FROM b), g AS (SELECT *, jv OR jc OR (few AND (turns <= 1 OR short) AND NOT substantive) AS junk FROM f)
SELECT interaction_id, CAST(words AS INT) AS words, CAST(turns AS INT) AS turns, seconds, substantive, rtrim(v || c, '|') AS hits, junk, CASE WHEN junk THEN concat_ws(',', 'junk_call_filtered', CASE WHEN jv THEN 'voicemail_pattern' END, CASE WHEN jc THEN 'connection_failure_pattern' END, CASE WHEN few THEN 'low_word_count' END, CASE WHEN turns <= 1 THEN 'single_speaker_turn' END, CASE WHEN short THEN 'short_duration' END) ELSE '' END AS codes FROM g""")
register("txt20_normalize_duration", lambda t: t.events.select("event_id", x.normalize_duration(F.expr("value * 300 - 100")).alias("s")), "", "SELECT event_id, CASE WHEN value * 300 - 100 <= 0 THEN NULL WHEN value * 300 - 100 > 10000 THEN (value * 300 - 100) / 1000.0::DOUBLE ELSE value * 300 - 100 END AS s FROM events")
register("txt21_classify_prospect", lambda t: x.classify_prospect(t.texts, (r"(^|[^\p{L}])the([^\p{L}]|$)", r"(^|[^\p{L}])der([^\p{L}]|$)", r"(^|[^\p{L}])and([^\p{L}]|$)"), (r"(^|[^\p{L}])que([^\p{L}]|$)",)), "texts", r"""
WITH a AS (SELECT interaction_id, CAST(regexp_matches(lower(text), '(^|[^\p{L}])the([^\p{L}]|$)') AS INT) + CAST(regexp_matches(lower(text), '(^|[^\p{L}])der([^\p{L}]|$)') AS INT) + CAST(regexp_matches(lower(text), '(^|[^\p{L}])and([^\p{L}]|$)') AS INT) AS e, regexp_matches(lower(text), '(^|[^\p{L}])que([^\p{L}]|$)') AS committed FROM texts)
SELECT interaction_id, e AS evidence_hits, CASE WHEN e >= 2 THEN 'high' WHEN e = 1 THEN 'medium' ELSE 'none' END AS prospect, committed FROM a""")
register("txt24_find_callbacks", lambda t: x.find_callbacks(t.texts, ("the and", "of the", "to the")), "texts", "WITH p AS (SELECT interaction_id, lower(text) AS t, unnest(['the and', 'of the', 'to the']) AS phrase FROM texts) SELECT interaction_id, phrase, substr(t, greatest(1, instr(t, phrase) - 20), 80) AS snippet FROM p WHERE contains(t, phrase)")
register("txt26_contact_notes_pii", lambda t: x.contact_notes_pii(t.contacts), "contacts", "SELECT id, notes LIKE '%@%' AS has_email, notes LIKE 'ring %' AS has_phone FROM contacts WHERE notes <> 'no notes'")
register("txt27_material_signal", lambda t: x.callout_material_signal(t.claims.select(F.col("id").alias("span_id"), F.col("claim_text").alias("text")).distinct(), t.part.selectExpr("p_name AS term", "CAST(p_size AS DOUBLE) / 100 AS boost", "p_size < 40 AS active").groupBy("term").agg(F.max("boost").alias("boost"), F.bool_or("active").alias("active"))).withColumn("score", F.round("score", 6)), "claims", """
WITH m AS (SELECT p_name AS term, max(CAST(p_size AS DOUBLE) / 100) AS boost, bool_or(p_size < 40) AS active FROM part GROUP BY 1), c AS (SELECT DISTINCT id, claim_text FROM claims)
SELECT id AS span_id, round(greatest(0.0, least(0.45::DOUBLE, sum(0.08::DOUBLE + boost))), 6) AS score, count(*) AS n_materials FROM c JOIN m ON active AND (' ' || lower(claim_text) || ' ') LIKE ('% ' || term || ' %') GROUP BY 1""")
register("seg01_even", lambda t: s.segment_even(t.texts, "interaction_id", 1000), "texts", """
WITH a AS (SELECT interaction_id, length(text) AS n, greatest(1, (length(text) + 999) // 1000) AS k FROM texts), b AS (SELECT *, unnest(range(k)) AS i FROM a)
SELECT interaction_id, CAST(i AS INT) AS span_index, CAST(n * i // k AS INT) AS char_start, CAST(n * (i + 1) // k AS INT) AS char_end FROM b""")
register("seg02_enforce_max_chars", lambda t: s.enforce_max_chars(t.spans.where("NOT is_superseded").select("interaction_id", "char_start", "char_end"), "interaction_id", 500), "spans", """
WITH a AS (SELECT interaction_id, char_start AS s, char_end - char_start AS n, (char_end - char_start + 499) // 500 AS k FROM spans WHERE NOT is_superseded), b AS (SELECT *, unnest(range(k)) AS i FROM a),
c AS (SELECT interaction_id, CAST(s + n * i // k AS INT) AS char_start, CAST(s + n * (i + 1) // k AS INT) AS char_end, CASE WHEN k > 1 THEN 'oversize_split' ELSE 'kept' END AS reason FROM b)
SELECT *, CAST(row_number() OVER (PARTITION BY interaction_id ORDER BY char_start, char_end) - 1 AS INT) AS span_index FROM c""")
register("seg03_normalize_boundaries", lambda t: s.normalize_boundaries(t.spans.groupBy("interaction_id").agg(F.max("char_end").alias("length"), F.collect_list(F.struct(F.col("char_start").alias("start"), (F.col("word_count") / 3000.0).alias("confidence"))).alias("cuts")), "interaction_id", 1000, 4))
register("seg04_split_natural", lambda t: s.split_natural(t.texts, "interaction_id", 2000))
register("seg05_retry_split", lambda t: s.retry_split_policy(t.texts, t.texts.select("interaction_id", (F.length("text") % 2 + 1).alias("n")), "interaction_id"), "texts", """
WITH a AS (SELECT interaction_id, length(text) AS n, greatest(2, least(10, (length(text) + 4999) // 5000)) AS k FROM texts WHERE length(text) > 2000 AND length(text) % 2 = 0), b AS (SELECT *, unnest(range(k)) AS i FROM a)
SELECT interaction_id, CAST(i AS INT) AS span_index, CAST(n * i // k AS INT) AS char_start, CAST(n * (i + 1) // k AS INT) AS char_end, 0.5::DOUBLE AS confidence FROM b""")
register("seg07_locate_claim_pointers", lambda t: s.locate_claim_pointers(t.texts.selectExpr("interaction_id AS claim_id", "text AS transcript", "CASE WHEN length(text) % 3 = 0 THEN substr(text, 11, 60) WHEN length(text) % 3 = 1 THEN substr(text, 11, 32) || 'zzz' ELSE 'qqqqqq not there' END AS claim_text")).select("claim_id", "char_start", "char_end", "pointer_basis").where("pointer_basis = 'text'"), "texts", """
WITH c AS (SELECT interaction_id AS claim_id, lower(text) AS t, lower(trim(CASE WHEN length(text) % 3 = 0 THEN substr(text, 11, 60) WHEN length(text) % 3 = 1 THEN substr(text, 11, 32) || 'zzz' ELSE 'qqqqqq not there' END, ' ')) AS c FROM texts), d AS (SELECT claim_id, t, CASE WHEN c <> '' AND contains(t, c) THEN c WHEN c <> '' AND contains(t, substr(c, 1, 30)) THEN substr(c, 1, 30) END AS n FROM c)
SELECT claim_id, CAST(instr(t, n) - 1 AS INT) AS char_start, CAST(instr(t, n) - 1 + length(n) AS INT) AS char_end, 'text' AS pointer_basis FROM d WHERE n IS NOT NULL""")
register("led19_recompute_pointers", lambda t: s.recompute_pointers(t.texts.selectExpr("interaction_id AS claim_id", "text AS transcript", "'Note: ..' || substr(text, 5, 30) AS claim_text")), "texts", """
WITH c AS (SELECT interaction_id AS claim_id, lower(text) AS t, lower(trim(regexp_replace(substr(text, 5, 30), '^\\.+', ''), ' ')) AS c FROM texts) SELECT claim_id, CASE WHEN c <> '' AND instr(t, c) > 0 THEN CAST(instr(t, c) - 1 AS INT) END AS char_start, CASE WHEN c <> '' AND instr(t, c) > 0 THEN CAST(instr(t, c) - 1 + length(c) AS INT) END AS char_end FROM c""")
register("seg08_validate_span", lambda t: t.texts.select("interaction_id", s.span_hash(F.substring("text", 1, 50)).alias("hash"), s.validate_span(F.col("text"), F.lit(3), F.lit(9), F.upper(F.substring("text", 4, 6))).alias("valid")), "texts", "SELECT interaction_id, md5(substr(text, 1, 50)) AS hash, lower(substr(text, 4, 6)) = lower(upper(substr(text, 4, 6))) AS valid FROM texts")
register("seg09_reseed_locks", lambda t: s.reseed(t.spans, t.spans.where("NOT is_superseded AND span_index < 3 AND word_count > 1000").selectExpr("concat(span_id, 'n') AS span_id", "interaction_id", "span_index", "char_start", "char_end"), t.attributions)["locks"].select("interaction_id", "span_index", "project_id", "new_span_id", "decision", "confidence"), "spans attributions", """
WITH n AS (SELECT span_id || 'n' AS new_span_id, interaction_id, span_index FROM spans WHERE NOT is_superseded AND span_index < 3 AND word_count > 1000)
SELECT DISTINCT s.interaction_id, s.span_index, a.project_id, n.new_span_id, 'assign' AS decision, 1.0::DOUBLE AS confidence FROM attributions a JOIN spans s USING (span_id) JOIN n ON n.interaction_id = s.interaction_id AND n.span_index = s.span_index WHERE attribution_lock = 'human' AND NOT is_superseded""")
register("seg10_unsegmented", lambda t: s.unsegmented(t.interactions, t.spans), "interactions spans", "SELECT interaction_id FROM interactions WHERE interaction_id NOT IN (SELECT interaction_id FROM spans)")
register("seg11_expected_min_spans", lambda t: t.texts.select("interaction_id", s.expected_min_spans(F.length("text")).alias("n")), "texts", "SELECT interaction_id, CASE WHEN length(text) <= 2000 THEN 1 WHEN length(text) <= 6000 THEN 2 WHEN length(text) <= 12000 THEN 3 ELSE 4 END AS n FROM texts")
register("seg06_boundary_quotes", lambda t: s.boundary_quotes(t.turns.withColumn("span_index", F.col("turn")), t.turns.select("interaction_id").distinct().crossJoin(t.spark.createDataFrame([("the",), ("que",)], "term string")), "text"), "turns", """
WITH r AS (SELECT interaction_id, turn AS span_index, text, term, instr(lower(text), term) AS pl FROM turns, (VALUES ('the'), ('que')) v(term) WHERE instr(lower(text), term) > 0)
SELECT interaction_id, term, span_index, substr(text, greatest(1, pl - 20), 80) AS quote FROM r QUALIFY row_number() OVER (PARTITION BY interaction_id, term ORDER BY span_index) = 1""")
