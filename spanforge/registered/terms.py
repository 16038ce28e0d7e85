"""Queries of tagged terms and of what is weighted by them."""

from pyspark.sql import functions as F

from ..functions import text as x
from ..operators import candidates as c
from ..operators import messages as m
from ..operators import terms as g
from . import register

# Names stand after a space that follows a small letter, a digit or a comma.
PROPER = "list_distinct(list_filter(list_transform(range(2, len(w) + 1), lambda i: CASE WHEN regexp_matches(w[i - 1], '[a-z0-9,;]$') THEN regexp_extract(w[i], '^([A-Z][a-z]{2,})($|[^\\p{L}\\p{N}_])', 1) ELSE '' END), lambda v: v <> ''))"
register("txt12_proper_nouns", lambda t: t.texts.select("interaction_id", F.size(x.extract_proper_nouns(F.col("text"), ("the", "and"))).alias("n")), "texts", f"""
WITH s AS (SELECT interaction_id, string_split(text, ' ') AS w FROM texts) SELECT interaction_id, CAST(len(list_filter({PROPER}, lambda v: lower(v) NOT IN ('the', 'and'))) AS INTEGER) AS n FROM s""")

# The other engine's word boundaries know ASCII only: words of all letters get a sign before and after them.
_A, _Z = "\ue000", "\ue001"
_WHOLE = "unnest(list_transform(regexp_extract_all(mk, '" + _A + "({})" + _Z + "', 1), lambda v: regexp_replace(v, '[" + _A + _Z + "]', '', 'g')))"
register("txt14_high_signal_terms", lambda t: x.high_signal_terms(t.texts, "interaction_id"), "texts", f"""
WITH s AS (SELECT interaction_id, text, lower(text) AS low, string_split(text, ' ') AS w, regexp_replace(lower(text), '([\\p{{L}}\\p{{N}}_]+)', '{_A}\\1{_Z}', 'g') AS mk FROM texts),
r AS (SELECT interaction_id, {_WHOLE.format('[0-9]{2,5}' + _Z + ' ' + _A + '[a-z]+' + _Z + ' ' + _A + '(?:street|st|road|rd|lane|ln|drive|dr|avenue|ave)')} AS term, 100 AS score FROM s
  UNION ALL SELECT interaction_id, unnest(regexp_extract_all(low, '(\\$ ?[0-9][0-9,]*)', 1)), 95 FROM s UNION ALL SELECT interaction_id, {_WHOLE.format('[0-9]+' + _Z + ' ' + _A + '(?:feet|foot|inch|inches|yards|gallons|pieces|boxes|sheets)')}, 90 FROM s
  UNION ALL SELECT interaction_id, unnest(list_transform({PROPER}, lambda v: lower(v))), 88 FROM s UNION ALL SELECT interaction_id, {_WHOLE.format('[a-z]{1,4}(?:' + _Z + '-' + _A + ')?[0-9]{3,6}')}, 82 FROM s
  UNION ALL SELECT interaction_id, v, 72 FROM (SELECT interaction_id, unnest(string_split_regex(low, '[^\\p{{L}}\\p{{N}}_]+')) AS v FROM s) WHERE length(v) >= 7),
b AS (SELECT interaction_id, term, max(score) AS score FROM r GROUP BY 1, 2)
SELECT interaction_id, term, score, CAST(row_number() OVER (PARTITION BY interaction_id ORDER BY score DESC, length(term) DESC, term) AS INT) AS rank FROM b QUALIFY rank <= 20""")

PAIRS, DOMAIN, STOP = r"\b((?:the|der|les) [a-z]{4,})", ["than", "that", "und", "eau"], ["the", "and", "der", "les"]
_IN = lambda words: "('" + "', '".join(words) + "')"
TAGGED = f"""ts AS (SELECT {{key}} AS k, {{text}} AS text, string_split({{text}}, ' ') AS w FROM {{source}}),
tg AS (SELECT k, unnest(list_transform(regexp_extract_all(text, '(\\$([0-9]{{{{1,3}}}}(,[0-9]{{{{3}}}})+|[0-9]+)(\\.[0-9]+)?)', 1), lambda v: lower(v))) AS term, 0 AS c FROM ts
  UNION ALL SELECT k, unnest(regexp_extract_all(lower(text), '{{compound}}', 1)), 1 FROM ts
  UNION ALL SELECT k, unnest(list_transform({PROPER.replace("{", "{{").replace("}", "}}")}, lambda v: lower(v))), 2 FROM ts
  UNION ALL SELECT k, v, CASE WHEN v IN {{domain}} THEN 3 ELSE 4 END FROM (SELECT k, unnest(string_split(regexp_replace(lower(text), '[^a-z0-9$]+', ' ', 'g'), ' ')) AS v FROM ts) WHERE length(v) >= 3 AND v NOT IN {{stop}}),
tt AS MATERIALIZED (SELECT k, term, min(c) AS c FROM tg GROUP BY 1, 2)"""
_CLASS = f"list_extract({list(g.CLASS_WEIGHTS)}, c + 1) AS class, list_extract({list(g.CLASS_WEIGHTS.values())}::DOUBLE[], c + 1) AS weight"
register("txt13_tagged_terms", lambda t: g.tagged_terms(t.texts, "interaction_id", (PAIRS,), DOMAIN, STOP), "texts", f"""
WITH {TAGGED.format(key="interaction_id", text="text", source="texts", compound="(?:^|[^\\p{L}\\p{N}_])((?:the|der|les) [a-z]{4,})", domain=_IN(DOMAIN), stop=_IN(STOP))}
SELECT k AS interaction_id, term, {_CLASS} FROM tt""")

# A call's claims are its text, their projects its candidates.
CUT = "list_distinct(list_filter(string_split_regex(lower({}), '[^a-z0-9]+'), lambda v: length(v) >= 4))"
SCORED = f"""ow AS MATERIALIZED (SELECT DISTINCT project_id, unnest({CUT.format("claim_text")}) AS word FROM claims WHERE active AND project_id IS NOT NULL),
pr AS MATERIALIZED (SELECT DISTINCT call_id AS span_id, project_id FROM claims WHERE project_id IS NOT NULL),
pt AS (SELECT span_id, term, len({CUT.format("term")}) AS np, unnest({CUT.format("term")}) AS part FROM tm),
hi AS MATERIALIZED (SELECT span_id, project_id, term FROM pt JOIN pr USING (span_id) JOIN ow USING (project_id) WHERE part = word OR (starts_with(part, word) AND length(word) >= 5) OR (starts_with(word, part) AND length(part) >= 5) GROUP BY span_id, project_id, term, np HAVING count(DISTINCT part) = np),
nn AS (SELECT span_id, count(*) AS n FROM pr WHERE project_id IN (SELECT project_id FROM ow) GROUP BY 1), df AS (SELECT span_id, term, count(*) AS d FROM hi GROUP BY 1, 2),
we AS (SELECT tm.span_id, tm.term, (ln((n + 1)::DOUBLE / (coalesce(d, 0) + 1)) + 0.15::DOUBLE) * weight AS idf FROM tm JOIN nn USING (span_id) LEFT JOIN df ON df.span_id = tm.span_id AND df.term = tm.term WHERE len({CUT.format("tm.term")}) > 0),
al AS (SELECT span_id, sum(idf) AS s FROM we GROUP BY 1)
SELECT hi.span_id, hi.project_id, round(sum(idf) / any_value(al.s), 3) AS crossref, count(*) AS n_terms FROM hi JOIN we USING (span_id, term) JOIN al ON al.span_id = hi.span_id GROUP BY 1, 2"""


def _call_claims(t):
    return t.claims.select(F.col("call_id").alias("span_id"), F.col("claim_text").alias("text")), t.claims.select(F.col("call_id").alias("span_id"), "project_id").where("project_id IS NOT NULL"), t.claims


register("cnd20_claim_crossref", lambda t: c.claim_crossref(*_call_claims(t)), "claims", f"""
WITH tm AS MATERIALIZED (SELECT DISTINCT call_id AS span_id, unnest({CUT.format("claim_text")}) AS term, 1.0::DOUBLE AS weight FROM claims), {SCORED}""")
SAID = "'we paid $' || CAST(length(id) * 100 AS VARCHAR) || ' for the ' || claim_text || ' and Widget'"
KINDS = r"\b((?:small|large|red) [a-z]+)\b"


def _weighted(t):
    texts = t.claims.select(F.col("call_id").alias("span_id"), F.expr(SAID.replace("VARCHAR", "STRING")).alias("text"))
    # A call's texts are exchanged rather than the terms made of them.
    texts = texts.repartition("span_id")
    spans, pairs, claims = _call_claims(t)
    return c.claim_crossref(spans, pairs, claims, g.tagged_terms(texts, "span_id", (KINDS,), ["gizmo", "bolt"], ["for", "the", "and"]))


register("cnd20_weighted_crossref", _weighted, "claims", f"""
WITH {TAGGED.format(key="call_id", text=SAID, source="claims", compound=KINDS.replace(chr(92) + "b", ""), domain=_IN(["gizmo", "bolt"]), stop=_IN(["for", "the", "and"]))},
tm AS MATERIALIZED (SELECT k AS span_id, term, list_extract({list(g.CLASS_WEIGHTS.values())}::DOUBLE[], c + 1) AS weight FROM tt), {SCORED}""")


# Turns of conversations as messages, and orders' calls around them.
MAIL = "SELECT CAST(conv_id AS STRING) || '-' || CAST(turn AS STRING) AS message_id, CAST(conv_id % 150 AS STRING) AS contact_id, TIMESTAMP '1995-01-01' + CAST(conv_id % 1500 AS INT) * INTERVAL 1 DAY AS sent_at, CASE WHEN conv_id % 4 = 0 THEN NULL ELSE left(text, 60) END AS subject, text || ' $1,250.50 and $3k' AS body FROM {c}"
NAMED = "SELECT CAST(item_id AS STRING) AS project_id, regexp_extract(text, '^([A-Za-z]+ [a-z]+)', 1) AS alias FROM {b} UNION ALL SELECT CAST(item_id AS STRING), regexp_extract(text, ' ([a-z]{{4,}}) ', 1) FROM {b}"


def _mail(t):
    return t.spark.sql(MAIL.replace("TIMESTAMP '", "TIMESTAMP_NTZ '"), c=t.conversations), t.spark.sql(NAMED.replace("{{", "{").replace("}}", "}").replace("{4,}", "{{4,}}"), b=t.benchmark)


_MENTIONED = f"""ma AS MATERIALIZED ({MAIL.format(c="conversations")}), na AS (SELECT DISTINCT project_id, lower(alias) AS a FROM ({NAMED.format(b="benchmark")}) WHERE length(alias) >= 3),
hy AS (SELECT message_id, ' ' || array_to_string(list_filter(string_split_regex(lower(concat_ws(' ', subject, body)), '[^\\p{{L}}\\p{{N}}_]+'), lambda v: v <> ''), ' ') || ' ' AS s FROM ma),
me AS MATERIALIZED (SELECT message_id, project_id, a FROM hy JOIN na ON contains(s, ' ' || a || ' '))"""
register("txt25_email_signals", lambda t: m.email_signals(*_mail(t), stopwords=["the", "and"]), "", f"""
WITH {_MENTIONED}, ag AS (SELECT message_id, string_agg(DISTINCT a, '|' ORDER BY a) AS mentions, string_agg(DISTINCT project_id, ',' ORDER BY project_id) AS projects FROM me GROUP BY 1),
kw AS (SELECT message_id, list_filter(string_split(regexp_replace(lower(coalesce(subject, '')), '[^a-z0-9]+', ' ', 'g'), ' '), lambda v: length(v) >= 3 AND v NOT IN ('the', 'and')) AS k, regexp_extract_all(body, '\\$(?:[0-9]{{1,3}}(?:,[0-9]{{3}})+|[0-9]+)(?:\\.[0-9]+)?\\s*[kK]?') AS am FROM ma)
SELECT message_id, mentions, projects, array_to_string(list_filter(k, lambda v, i: list_position(k, v) = i)[1:12], ' ') AS keywords, array_to_string(list_filter(am, lambda v, i: list_position(am, v) = i)[1:10], '|') AS amounts FROM ma JOIN kw USING (message_id) LEFT JOIN ag USING (message_id)""")
register("cnd04_email_mentions", lambda t: c.from_email_mentions(t.interactions.select(F.col("interaction_id").alias("span_id"), F.expr("CAST(CAST(contact_id AS INT) % 150 AS STRING)").alias("contact_id"), "event_at_utc"), _mail(t)[0], m.mentioned_projects(*_mail(t))).select("span_id", "project_id", "score", "evidence"), "interactions", f"""
WITH {_MENTIONED}, ca AS (SELECT interaction_id AS span_id, CAST(CAST(contact_id AS INT) % 150 AS VARCHAR) AS contact_id, event_at_utc FROM interactions),
pm AS (SELECT DISTINCT message_id, project_id FROM me)
SELECT span_id, project_id, 0.45::DOUBLE AS score, CAST(count(DISTINCT message_id) AS VARCHAR) AS evidence FROM ca JOIN ma ON ma.contact_id = ca.contact_id AND ma.sent_at BETWEEN event_at_utc - INTERVAL 30 DAY AND event_at_utc + INTERVAL 30 DAY JOIN pm USING (message_id) GROUP BY 1, 2""")
