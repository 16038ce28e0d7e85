"""Queries of the entity and alias operators."""

from pyspark.sql import functions as F

from ..operators import entity as e
from . import register


def _contacts(t):
    return t.contacts.withColumn("aliases", F.split("alias_list", r"\|")).withColumn("company_aliases", F.when(F.col("is_internal"), F.array(F.lit("x"))).otherwise(F.array().cast("array<string>")))


PH = "ph AS (SELECT id, 1 AS nth, right(regexp_replace(phone, '[^0-9]', '', 'g'), 10) AS key FROM contacts WHERE phone IS NOT NULL UNION ALL SELECT id, 2, right(regexp_replace(secondary_phone, '[^0-9]', '', 'g'), 10) FROM contacts WHERE secondary_phone IS NOT NULL)"
ALIASES = "SELECT CAST(p_partkey % 100 AS STRING) AS project_id, CASE WHEN p_partkey % 2 = 0 THEN upper(p_name) ELSE p_name END || CAST(p_partkey % 40 AS STRING) AS alias, p_size < 30 AS active, CASE WHEN p_partkey % 100 < 20 OR p_partkey % 3 = 0 THEN 'auto' ELSE 'human' END AS source, TIMESTAMP '2024-01-01' + CAST(p_size AS INT) * INTERVAL 1 DAY AS created_at, CASE p_partkey % 3 WHEN 0 THEN 'pending' WHEN 1 THEN 'approved' ELSE 'rejected' END AS status, CAST(p_size AS DOUBLE) / 50 AS confidence FROM {p}"
AD = f"al AS ({ALIASES.format(p='part')})"


def _aliases(t):
    return t.spark.sql(ALIASES.replace("TIMESTAMP '2024-01-01'", "TIMESTAMP_NTZ '2024-01-01'"), p=t.part)


register("ent01_lookup_by_phone", lambda t: e.lookup_contact_by_phone(t.interactions, t.contacts, "interaction_id", "contact_phone"), "interactions contacts", f"WITH {PH} SELECT interaction_id, id AS contact_id, CASE nth WHEN 1 THEN 'primary' ELSE 'secondary' END AS matched_on FROM interactions JOIN ph ON right(regexp_replace(contact_phone, '[^0-9]', '', 'g'), 10) = key QUALIFY row_number() OVER (PARTITION BY interaction_id ORDER BY nth, id) = 1")
register("ent30_backfill_contact_resolution", lambda t: e.backfill_contact_resolution(t.interactions, t.contacts, "interaction_id", "contact_phone"), "interactions contacts", f"WITH {PH}, o AS (SELECT key, min(id) AS contact_id FROM ph GROUP BY 1 HAVING count(DISTINCT id) = 1) SELECT interaction_id, o.contact_id FROM interactions JOIN o ON right(regexp_replace(contact_phone, '[^0-9]', '', 'g'), 10) = key")
register("ent32_backfill_party_names", lambda t: e.backfill_party_names(t.interactions.selectExpr("interaction_id", "CASE WHEN needs_review THEN contact_name END AS other_party_name", "CASE WHEN channel = 'sms' THEN NULL ELSE contact_id END AS contact_id"), t.contacts, t.interactions), "interactions contacts", """
WITH c AS (SELECT interaction_id, CASE WHEN needs_review THEN contact_name END AS o, CASE WHEN channel = 'sms' THEN NULL ELSE contact_id END AS contact_id, contact_name AS i FROM interactions)
SELECT interaction_id, coalesce(o, k.name, i) AS other_party_name, CASE WHEN o IS NOT NULL THEN 'own' WHEN k.name IS NOT NULL THEN 'contact' WHEN i IS NOT NULL THEN 'interaction' ELSE 'none' END AS basis FROM c LEFT JOIN contacts k ON k.id = c.contact_id""")
DICT = "di AS (SELECT id, lower(trim(name)) AS term, 'name' AS kind FROM contacts UNION SELECT id, lower(trim(unnest(string_split(alias_list, '|')))), 'alias' FROM contacts)"
ASK = "SELECT DISTINCT CASE WHEN l_orderkey % 2 = 0 THEN 'CUST ' || CAST(l_partkey % 900 AS STRING) ELSE 'Customer#' || lpad(CAST(l_partkey AS STRING), 9, '0') END AS name FROM {l}"
register("ent02_find_by_name_or_alias", lambda t: e.find_contact_by_name_or_alias(t.spark.sql(ASK, l=t.lineitem), _contacts(t)), "contacts", f"WITH {DICT}, a AS ({ASK.format(l='lineitem')}) SELECT name, id AS contact_id, kind FROM a JOIN di ON lower(trim(name)) = term QUALIFY row_number() OVER (PARTITION BY name ORDER BY kind DESC, id) = 1")
register("ent04_match_by_names", lambda t: e.match_contacts_by_names(t.spark.sql(ASK, l=t.lineitem), _contacts(t)), "contacts", f"WITH {DICT}, a AS ({ASK.format(l='lineitem')}), m AS (SELECT id, min(CASE kind WHEN 'name' THEN 0 ELSE 1 END) AS rank FROM (SELECT DISTINCT lower(trim(name)) AS term FROM a) JOIN di USING (term) GROUP BY 1) SELECT id, CAST(rank AS INT) AS rank, is_internal FROM m JOIN contacts USING (id) ORDER BY rank, is_internal, id LIMIT 25")
register("ent03_match_in_text", lambda t: e.match_contacts_in_text(t.interactions.selectExpr("interaction_id", "concat('talk with ', contact_name, ' and cust ', contact_id, ' now') AS text").where("text IS NOT NULL"), _contacts(t).withColumn("name", F.regexp_replace("name", "#", " ")), "interaction_id"), "interactions contacts", """
WITH x AS (SELECT interaction_id, 'customer ' || right(contact_name, 9) AS nm, 'cust ' || contact_id AS al FROM interactions WHERE contact_name IS NOT NULL), d AS (SELECT id, lower(replace(name, '#', ' ')) AS nm, lower(unnest(string_split(alias_list, '|'))) AS al FROM contacts),
m AS (SELECT interaction_id, id, 1.0::DOUBLE AS c FROM x JOIN (SELECT DISTINCT id, nm FROM d) USING (nm) UNION ALL SELECT interaction_id, id, 0.9::DOUBLE FROM x JOIN d USING (al)) SELECT interaction_id, id, max(c) AS confidence FROM m GROUP BY 1, 2""")
def _said(t):
    """Speaker labels: the first two words of every text, for the project of its number, and some with a word only."""
    first = F.regexp_extract("text", r"^[^\p{L}]*(\p{L}+)", 1)
    two = F.array_join(F.split(F.regexp_extract("text", r"^[^\p{L}]*(\p{L}+(?:[^\p{L}]+\p{L}+)?)", 1), r"[^\p{L}]+"), " ")
    rows = t.texts.select(F.when(F.crc32("interaction_id") % 8 == 0, first).otherwise(two).alias("label"), (F.col("interaction_id").cast("long") % 90).cast("string").alias("project_id"))
    return rows.distinct().where("label <> ''")


def _persons(t):
    """Contacts named by each word of the benchmark's texts and the one after it."""
    w = t.benchmark.select("item_id", F.filter(F.split("text", r"[^\p{L}]+"), lambda x: x != "").alias("w"))
    rows = w.select("item_id", F.posexplode(F.arrays_zip(F.col("w").alias("f"), F.expr("slice(w, 2, size(w))").alias("l"))).alias("n", "p"))
    return rows.select((F.col("item_id") * 1000 + F.col("n")).cast("string").alias("id"), F.concat_ws(" ", F.initcap("p.f"), F.initcap("p.l")).alias("name"), F.array(F.concat(F.lit("the "), F.lower("p.f"))).alias("aliases"), (F.col("n") % 11 == 0).alias("is_internal"))


register("ent05_resolve_speakers", lambda t: e.resolve_speakers(_said(t), _persons(t), t.affinity))
register("ent09_fuzzy_alias_matches", lambda t: e.fuzzy_alias_matches(t.part.selectExpr("concat(substr(p_name, 1, 5), p_partkey % 10) AS term"), t.part.selectExpr("p_name AS alias")), "", """
WITH g AS (SELECT DISTINCT lower(substr(p_name, 1, 5) || CAST(p_partkey % 10 AS VARCHAR)) AS term FROM part), a AS (SELECT DISTINCT lower(p_name) AS alias FROM part),
x AS (SELECT term, list_distinct(list_transform(range(1, length(term) + 2), lambda i: substr('  ' || term || ' ', i, 3))) AS gt FROM g), y AS (SELECT alias, list_distinct(list_transform(range(1, length(alias) + 2), lambda i: substr('  ' || alias || ' ', i, 3))) AS ga FROM a),
m AS (SELECT term, alias, len(list_intersect(gt, ga)) AS o, len(gt) AS n, len(ga) AS k, levenshtein(term, alias) AS d FROM x, y), s AS (SELECT term, alias, d, o::DOUBLE / (n + k - o) AS sim FROM m),
r AS (SELECT term, alias, CASE WHEN term = alias THEN 1.0::DOUBLE WHEN starts_with(alias, term) THEN 0.95::DOUBLE ELSE greatest(CASE WHEN sim >= 0.2 THEN sim ELSE 0 END, CASE WHEN d <= 2 AND sim >= 0.2 THEN 1 - d / 5.0::DOUBLE ELSE 0 END) END AS score FROM s WHERE sim >= 0.2 OR starts_with(alias, term))
SELECT term, alias, score FROM r WHERE score >= 0.4""")
register("ent12_expand_from_speakers", lambda t: e.expand_from_speakers(t.interactions.select("interaction_id", "contact_id"), t.contacts.withColumn("contact_type", F.when(F.col("contact_type") == "BUILDING", "client").otherwise("other")), t.affinity), "interactions contacts affinity", """
SELECT interaction_id, f.project_id, max(CASE WHEN contact_type = 'BUILDING' THEN 0.95::DOUBLE WHEN is_internal THEN 0.7::DOUBLE ELSE 0.6::DOUBLE END) AS score, count(DISTINCT i.contact_id) AS n_speakers FROM interactions i JOIN contacts c ON c.id = i.contact_id JOIN affinity f ON f.contact_id = i.contact_id WHERE weight > 0 GROUP BY 1, 2""")
register("ent13_list_floaters", lambda t: e.list_floaters(t.project_contacts), "project_contacts", "SELECT contact_id, count(DISTINCT project_id) AS n_projects, string_agg(DISTINCT project_id, ',' ORDER BY project_id) AS projects FROM project_contacts GROUP BY 1 HAVING count(DISTINCT project_id) >= 3")
register("ent14_contact_fanout", lambda t: e.contact_fanout(t.contacts, t.interactions, t.affinity.where("weight > 0.3"), "1998-01-01", 365), "contacts interactions affinity", """
WITH a AS (SELECT contact_id, count(DISTINCT project_id) AS n FROM interactions WHERE event_at_utc > TIMESTAMP '1997-01-01' AND event_at_utc <= TIMESTAMP '1998-01-01' AND project_id IS NOT NULL GROUP BY 1), f AS (SELECT contact_id, count(DISTINCT project_id) AS n FROM affinity WHERE weight > 0.3::DOUBLE GROUP BY 1),
r AS (SELECT id AS contact_id, coalesce(a.n, 0) AS x, coalesce(f.n, 0) AS y, greatest(coalesce(a.n, 0), coalesce(f.n, 0)) AS m FROM contacts c LEFT JOIN a ON a.contact_id = c.id LEFT JOIN f ON f.contact_id = c.id)
SELECT contact_id, x AS active_project_count, y AS affinity_project_count, m AS effective_fanout, CASE WHEN m = 0 THEN 'unknown' WHEN m = 1 THEN 'anchored' WHEN m = 2 THEN 'semi' WHEN m <= 4 THEN 'drifter' ELSE 'floater' END AS fanout_class FROM r""")
register("ent15_project_alias_lookup", lambda t: e.project_alias_lookup(t.projects, _aliases(t), t.projects.where("phase = 'framing'").select(F.col("id").alias("project_id"))), "projects", f"""WITH {AD}, f AS (SELECT * FROM projects WHERE project_kind = 'client' AND status <> 'closed' AND phase <> 'framing')
SELECT project_id, lower(trim(alias)) AS alias FROM al WHERE active AND project_id IN (SELECT id FROM f) UNION SELECT id, lower(trim(name)) FROM f""")
register("ent16_client_aliases", lambda t: e.generate_client_aliases(t.affinity, t.contacts), "affinity contacts", "SELECT DISTINCT project_id, unnest(['Customer', right(name, 9)]) AS alias FROM affinity f JOIN contacts c ON c.id = f.contact_id WHERE weight > 0")
register("ent17_place_aliases", lambda t: e.generate_place_aliases(t.projects.selectExpr("id", "concat(name, ' residence') AS name", "city", "CAST(NULL AS STRING) AS county", "concat(id, ' Oak Hill Road') AS address")), "projects", """
SELECT id AS project_id, unnest([name, city, 'Oak Hill Road', 'Oak Hill']) AS alias, unnest([0.95, 0.80, 0.85, 0.85]::DOUBLE[]) AS confidence, unnest(['name_stem', 'city', 'street', 'street']) AS alias_type FROM projects""")
register("ent18_alias_candidates_zero", lambda t: e.alias_candidates_zero(t.projects, _aliases(t).withColumn("project_id", (F.col("project_id") % 7).cast("int").cast("string"))), "projects", """
WITH b AS (SELECT * FROM projects WHERE id NOT IN (SELECT CAST((p_partkey % 100) % 7 AS VARCHAR) FROM part)) SELECT id AS project_id, unnest(['Project', id]) AS alias, unnest([0.7, 0.6]::DOUBLE[]) AS confidence FROM b""")
register("ent19_alias_candidates_auto_only", lambda t: e.alias_candidates_auto_only(t.projects.withColumn("address", F.concat(F.col("id"), F.lit(" Oak Road"))), _aliases(t)), "projects", f"WITH {AD}, a AS (SELECT project_id FROM al GROUP BY 1 HAVING bool_and(source = 'auto')) SELECT id AS project_id, 'Project Oak Road' AS alias, 0.5::DOUBLE AS confidence FROM projects WHERE id IN (SELECT project_id FROM a)")
register("ent20_alias_candidates_mined", lambda t: e.alias_candidates_mined(t.claims.select(F.col("call_id").alias("interaction_id"), "project_id", F.col("claim_text").alias("text")), t.part.where("p_size < 10").select(F.lower(F.substring_index("p_name", " ", 1)).alias("term")), t.part.select(F.lower("p_type").alias("term")).where("term = 'small'"), 4), "claims", """
WITH w AS (SELECT DISTINCT project_id, call_id, unnest(list_filter(string_split_regex(lower(claim_text), '[^\\p{L}\\p{N}_]+'), lambda x: length(x) >= 4)) AS term FROM claims WHERE project_id IS NOT NULL),
n AS (SELECT project_id, term, count(DISTINCT call_id) AS n, list_sort(list(DISTINCT call_id)) AS s FROM w GROUP BY 1, 2 HAVING count(DISTINCT call_id) >= 4)
SELECT project_id, term, n, least(0.8, 0.4::DOUBLE + 0.1::DOUBLE * (n - 3)) AS confidence, array_to_string(s[1:3], ',') AS samples FROM n WHERE term NOT IN (SELECT lower(split_part(p_name, ' ', 1)) FROM part WHERE p_size < 10) AND term <> 'small'""")
register("ent21_promote_aliases", lambda t: e.promote_aliases(_aliases(t), _aliases(t).where("source = 'human'")), "", f"""WITH {AD} SELECT project_id, alias, confidence FROM al a WHERE status = 'approved' AND NOT EXISTS (SELECT 1 FROM al b WHERE b.source = 'human' AND b.active AND b.project_id = a.project_id AND lower(b.alias) = lower(a.alias)) QUALIFY row_number() OVER (PARTITION BY project_id, lower(alias) ORDER BY confidence DESC, alias) = 1""")
register("ent22_retire_closed_aliases", lambda t: e.retire_closed_aliases(_aliases(t), t.projects).select("project_id", "alias", "active", "retired"), "projects", f"WITH {AD} SELECT project_id, alias, active AND coalesce(p.status, '') <> 'closed' AS active, active AND coalesce(p.status, '') = 'closed' AS retired FROM al LEFT JOIN projects p ON p.id = al.project_id")
register("ent23_expire_suggestions", lambda t: e.expire_suggestions(_aliases(t), "2024-02-20").groupBy("status").agg(F.count("*").alias("n")), "", f"WITH {AD} SELECT CASE WHEN status = 'pending' AND created_at < TIMESTAMP '2024-01-21' THEN 'rejected' ELSE status END AS status, count(*) AS n FROM al GROUP BY 1")
register("ent24_alias_collisions", lambda t: e.alias_collisions(_aliases(t)), "", f"WITH {AD} SELECT lower(alias) AS alias, count(DISTINCT project_id) AS n, string_agg(DISTINCT project_id, ',' ORDER BY project_id) AS projects FROM al WHERE active GROUP BY 1 HAVING count(DISTINCT project_id) > 1")
register("ent25_contact_alias_collisions", lambda t: e.contact_alias_collisions(t.contacts.selectExpr("id AS contact_id", "concat('Cust ', CAST(id AS INT) % 300) AS alias"), _contacts(t)), "contacts", """
WITH p AS (SELECT id AS contact_id, 'Cust ' || CAST(CAST(id AS INT) % 300 AS VARCHAR) AS alias FROM contacts), k AS (SELECT DISTINCT id, lower(unnest(string_split(alias_list, '|'))) AS k FROM contacts)
SELECT contact_id, alias, 'alias' AS kind, count(DISTINCT id) AS n_contacts FROM p JOIN k ON lower(alias) = k WHERE id <> contact_id GROUP BY 1, 2""")
register("ent26_suggest_contact_aliases", lambda t: e.suggest_contact_aliases(t.texts, _persons(t)))
register("ent27_alias_discovery_status", lambda t: e.alias_discovery_status(_contacts(t)), "contacts", "SELECT id, CASE WHEN is_internal THEN 'OK' ELSE 'NEEDS_COMPANY_ALIASES' END AS status FROM contacts")
register("ent29_link_vendors", lambda t: e.link_vendors(t.lineitem.selectExpr("concat(l_orderkey, '-', l_linenumber, '-', l_partkey, '-', l_extendedprice) AS row_id", "CASE WHEN l_partkey % 50 = 0 THEN NULL ELSE CAST(l_partkey AS STRING) END AS vendor_id", "CAST(l_suppkey + 5 AS STRING) AS project_id"), t.projects).groupBy("result").agg(F.count("*").alias("n")), "projects", """
WITH l AS (SELECT CASE WHEN l_partkey % 50 = 0 THEN NULL ELSE CAST(l_partkey AS VARCHAR) END AS v, CAST(l_suppkey + 5 AS VARCHAR) AS p FROM lineitem), r AS (SELECT v, p, row_number() OVER (PARTITION BY v, p) AS n FROM l)
SELECT CASE WHEN v IS NULL THEN 'missing_field' WHEN p NOT IN (SELECT id FROM projects) THEN 'unknown_project' WHEN n > 1 THEN 'repeated' ELSE 'ok' END AS result, count(*) AS n FROM r GROUP BY 1""")
register("ent31_external_contacts", lambda t: e.external_contacts(t.contacts), "contacts", "SELECT id, name, interaction_count, interaction_count + total_transcript_chars / 150.0::DOUBLE * 0.5::DOUBLE AS engagement_score FROM contacts WHERE NOT is_internal AND interaction_count > 0")
register("ent33_pending_alias_review", lambda t: e.pending_alias_review(_aliases(t), _aliases(t)).select("project_id", "alias", "collides_with"), "", f"""WITH {AD}, h AS (SELECT DISTINCT lower(alias) AS a, project_id AS p FROM al WHERE active)
SELECT al.project_id, alias, coalesce(string_agg(DISTINCT p, ',' ORDER BY p), '') AS collides_with FROM al LEFT JOIN h ON h.a = lower(alias) WHERE status = 'pending' AND (p IS NULL OR p <> al.project_id) GROUP BY al.project_id, alias, created_at""")
