"""Contacts, speakers and aliases: lookups, ladders, fan-out, suggestions."""

from __future__ import annotations

from collections import deque

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.basics import at, days, latest
from ..functions.phonetic import with_codes
from ..functions.text import normalize_phone
from ..plans.match import find_terms, tokens, trigram_join, trigrams


def _phones(contacts: DataFrame) -> DataFrame:
    each = F.explode(F.array(F.struct(F.lit(1).alias("nth"), F.col("phone").alias("p")), F.struct(F.lit(2).alias("nth"), F.col("secondary_phone").alias("p"))))
    return contacts.select("id", each.alias("x")).select("id", "x.nth", normalize_phone(F.col("x.p")).alias("key")).where(F.length("key") >= 7)


def lookup_contact_by_phone(df: DataFrame, contacts: DataFrame, key: str, phone: str) -> DataFrame:
    """The contact whose primary, else secondary, phone has the same last ten digits."""
    asked = df.select(key, normalize_phone(F.col(phone)).alias("key")).where(F.length("key") >= 7)
    return latest(asked.join(_phones(contacts), "key"), [key], F.col("nth"), F.col("id")).select(key, F.col("id").alias("contact_id"), F.when(F.col("nth") == 1, "primary").otherwise("secondary").alias("matched_on"))


def backfill_contact_resolution(df: DataFrame, contacts: DataFrame, key: str, phone: str) -> DataFrame:
    """The contact of a phone that is exactly one contact's."""
    one = _phones(contacts).groupBy("key").agg(F.countDistinct("id").alias("n"), F.min("id").alias("contact_id")).where("n = 1")
    return df.select(key, normalize_phone(F.col(phone)).alias("key")).join(one, "key").select(key, "contact_id")


def backfill_party_names(calls: DataFrame, contacts: DataFrame, interactions: DataFrame) -> DataFrame:
    """A missing party name from the resolved contact, else from the interaction."""
    c = contacts.select(F.col("id").alias("contact_id"), F.col("name").alias("_cn"))
    i = interactions.select("interaction_id", F.col("contact_name").alias("_in"))
    return calls.join(c, "contact_id", "left").join(i, "interaction_id", "left").select("interaction_id", F.coalesce("other_party_name", "_cn", "_in").alias("other_party_name"), F.when(F.col("other_party_name").isNotNull(), "own").when(F.col("_cn").isNotNull(), "contact").when(F.col("_in").isNotNull(), "interaction").otherwise("none").alias("basis"))


def alias_dictionary(contacts: DataFrame) -> DataFrame:
    """id, term, kind: names and aliases in lower case, trimmed."""
    names = contacts.select("id", F.lower(F.trim("name")).alias("term"), F.lit("name").alias("kind"))
    other = contacts.select("id", F.explode("aliases").alias("a")).select("id", F.lower(F.trim("a")).alias("term"), F.lit("alias").alias("kind"))
    return names.unionByName(other).where("term <> ''").distinct()


def find_contact_by_name_or_alias(names: DataFrame, contacts: DataFrame) -> DataFrame:
    """Exact, case-insensitive matches of asked names, names before aliases."""
    met = names.select("name", F.lower(F.trim("name")).alias("term")).distinct().join(alias_dictionary(contacts), "term")
    return latest(met, ["name"], F.desc("kind"), F.col("id")).select("name", F.col("id").alias("contact_id"), "kind")


def match_contacts_by_names(names: DataFrame, contacts: DataFrame, most: int = 25) -> DataFrame:
    """Contacts by rank 0 for a name or 1 for an alias, external ones first, at most ``most`` rows in all."""
    met = names.select(F.lower(F.trim("name")).alias("term")).distinct().join(alias_dictionary(contacts), "term")
    best = met.groupBy("id").agg(F.min(F.when(F.col("kind") == "name", 0).otherwise(1)).alias("rank"))
    return best.join(contacts.select("id", "is_internal"), "id").orderBy("rank", "is_internal", "id").limit(most).select("id", "rank", "is_internal")


def match_contacts_in_text(texts: DataFrame, contacts: DataFrame, key: str) -> DataFrame:
    """Contacts whose name (1.0) or alias of 4 characters or more (0.9) a text has as whole words."""
    terms = alias_dictionary(contacts).where("kind = 'name' OR length(term) >= 4")
    found = find_terms(texts, terms, key)
    return found.groupBy(key, "id").agg(F.max(F.when(F.col("kind") == "name", 1.0).otherwise(0.9)).alias("confidence"))


#: The quality of each way in which a label can name a contact.
SPEAKER_QUALITY = {"exact_name": 100, "exact_alias": 95, "exact_full_name": 90, "phonetic_first_exact_last": 80, "phonetic_both": 75, "surname_phonetic": 72, "first_name_prefix": 65}


def resolve_speakers(labels: DataFrame, contacts: DataFrame, affinity: DataFrame, either: bool = False) -> DataFrame:
    """label, project_id if there is one, contact_id, quality, match_type, score: the best contact of each speaker label.

    A label is the whole name or an alias, has its first two words, or sounds
    like them by Double Metaphone (words of four letters or more; with
    ``either`` the secondary codes count too, else primary ones), or is one
    word that the name begins with. A contact's affinity to the label's project
    counts ten times on top; ties go to internal contacts, then the smaller id.
    A word without letters has no sound.

    Every way is an equi-join. Of the contacts that share a key only the best
    is joined, and the best of those that know the label's project, so output
    grows with labels, however common a name or sound is. Labels are read once:
    one pass gives all their ways, and one join both kinds of contacts.
    """
    known = "project_id" in labels.columns
    lower = lambda c: F.lower(F.trim(c))
    word = lambda c, i: F.get(F.split(F.lower(c), " "), F.lit(i))
    ask = labels.select("label", (F.col("project_id") if known else F.lit(None).cast("string")).alias("project_id")).distinct().where(F.trim("label") != "")
    ask = ask.select("label", "project_id", lower(F.col("label")).alias("full"), word(F.col("label"), 0).alias("f"), F.nullif(word(F.col("label"), 1), F.lit("")).alias("l"))
    have = contacts.where("name IS NOT NULL").select("id", "is_internal", lower(F.col("name")).alias("full"), word(F.col("name"), 0).alias("f"), F.nullif(word(F.col("name"), 1), F.lit("")).alias("l"))

    def sounds(df: DataFrame) -> DataFrame:
        for c in ("f", "l"):
            df = with_codes(df, c, f"{c}1", f"{c}2")
            several = F.array_distinct(F.array(f"{c}1", f"{c}2")) if either else F.array(f"{c}1")
            df = df.withColumn(f"{c}s", F.filter(several, lambda x: x != "")).drop(f"{c}1", f"{c}2")
        return df

    one, none = lambda c: F.array(F.col(c)), F.array(F.lit(""))
    long = lambda c: F.length(c) >= 4
    begins = F.when(long("f"), F.transform(F.sequence(F.lit(4), F.greatest(F.lit(4), F.length("f"))), lambda n: F.left("f", n)))
    # The way, when a label can go it, and what both sides must share: one value of each of two lists.
    ways = [
        ("exact_name", F.lit(True), one("full"), none, one("full"), none),
        ("exact_full_name", F.col("l").isNotNull(), one("f"), one("l"), one("f"), one("l")),
        ("phonetic_first_exact_last", long("f"), F.col("fs"), one("l"), F.col("fs"), one("l")),
        ("phonetic_both", long("f") & long("l"), F.col("fs"), F.col("ls"), F.col("fs"), F.col("ls")),
        ("surname_phonetic", long("l"), one("f"), F.col("ls"), one("f"), F.col("ls")),
        ("first_name_prefix", long("f") & F.col("l").isNull(), one("f"), none, begins, none),
    ]
    key = ["way", "k1", "k2"]

    def keyed(df: DataFrame, lists: list[tuple[str, Column, Column, Column]], *more: str) -> DataFrame:
        both = lambda way, a, b: F.flatten(F.transform(a, lambda x: F.transform(b, lambda y: F.struct(F.lit(way).alias("way"), x.alias("k1"), y.alias("k2")))))
        all_ = F.flatten(F.array_compact(F.array(*(F.when(when, both(way, a, b)) for way, when, a, b in lists))))
        return sounds(df).select(*more, F.inline(all_)).where("k1 IS NOT NULL AND k2 IS NOT NULL")

    wants = [(way, when, a, b) for way, when, a, b, _, _ in ways] + [("exact_alias", F.lit(True), one("full"), none)]
    wanted = keyed(ask, wants, "label", "project_id")
    aliases = alias_dictionary(contacts).where("kind = 'alias'").join(contacts.select("id", "is_internal"), "id").select("id", "is_internal", F.lit("exact_alias").alias("way"), F.col("term").alias("k1"), F.lit("").alias("k2"))
    given = keyed(have, [(way, F.lit(True), a, b) for way, _, _, _, a, b in ways], "id", "is_internal").unionByName(aliases)

    # The best contact of a key for any label, and for labels of a project it knows.
    theirs = F.concat(F.lit("="), F.col("project_id"))
    best_of = latest(given, key, F.desc("is_internal"), F.col("id")).select(*key, F.lit("").alias("_for"), "id", "is_internal", F.lit(0.0).alias("boost"))
    if known:
        edges = affinity.select(F.col("contact_id").alias("id"), theirs.alias("_for"), (10 * F.col("weight")).alias("boost"))
        near = latest(given.join(edges, "id"), [*key, "_for"], F.desc("boost"), F.desc("is_internal"), F.col("id"))
        best_of = best_of.unionByName(near.select(*best_of.columns))
        wanted = wanted.withColumn("_for", F.explode(F.array_compact(F.array(F.lit(""), theirs))))
    else:
        wanted = wanted.withColumn("_for", F.lit(""))
    rows = wanted.join(best_of, [*key, "_for"])
    quality = F.element_at(F.create_map(*(F.lit(x) for kv in SPEAKER_QUALITY.items() for x in kv)), F.col("way"))
    rows = rows.withColumn("quality", quality).withColumn("score", F.col("quality") + F.col("boost"))
    best = latest(rows, ["label", "project_id"], F.desc("score"), F.desc("is_internal"), F.col("id"), F.desc("quality"))
    return best.select("label", *(["project_id"] if known else []), F.col("id").alias("contact_id"), "quality", F.col("way").alias("match_type"), "score")


def extract_claim_speakers(claims: DataFrame, resolved: DataFrame) -> DataFrame:
    """Claims with a speaker filled in where it is missing."""
    return claims.join(resolved.select(F.col("label").alias("speaker_label"), F.col("contact_id").alias("_r")), "speaker_label", "left").select("id", F.coalesce("speaker_contact_id", "_r").alias("speaker_contact_id"))


def fuzzy_alias_matches(terms: DataFrame, aliases: DataFrame, least: float = 0.4, most_edits: int = 2) -> DataFrame:
    """term, alias, score: exact 1.0, prefix 0.95, else trigram similarity or 1 - edits / 5, whichever is larger.

    Pairs meet on trigrams at half the threshold, or on the first four characters
    where an alias begins with the term; only words over 3 characters are fuzzy.
    """
    t, a = terms.select(F.lower("term").alias("term")).distinct(), aliases.select(F.lower("alias").alias("alias")).distinct()
    long = t.where(F.length("term") > 3)
    near = trigram_join(long, a, "term", "alias", least / 2)
    begins = long.join(a, (F.left("term", F.lit(4)) == F.left("alias", F.lit(4))) & F.col("alias").startswith(F.col("term"))).withColumn("similarity", F.lit(0.0))
    near = near.unionByName(begins).groupBy("term", "alias").agg(F.max("similarity").alias("similarity"))
    edits = F.levenshtein(F.col("term"), F.col("alias"), most_edits)
    score = F.when(F.col("term") == F.col("alias"), 1.0).when(F.col("alias").startswith(F.col("term")), 0.95).otherwise(F.greatest("similarity", F.when(edits >= 0, 1 - edits / 5.0).otherwise(0.0)))
    short = t.where(F.length("term") <= 3).join(a, F.col("term") == F.col("alias")).select("term", "alias", F.lit(1.0).alias("score"))
    return near.select("term", "alias", score.alias("score")).where(F.col("score") >= least).unionByName(short)


def expand_from_speakers(speakers: DataFrame, contacts: DataFrame, affinity: DataFrame) -> DataFrame:
    """Projects of resolved speakers: client 0.95, internal 0.7, other 0.6; the best per call and project.

    Projects are counted once for each different set of speakers and then
    joined to its calls, so pairs of calls and projects are never exchanged.
    """
    base = F.when(F.col("contact_type") == "client", 0.95).when(F.col("is_internal"), 0.7).otherwise(0.6)
    c = contacts.select(F.col("id").alias("contact_id"), base.alias("score")).groupBy("contact_id").agg(F.max("score").alias("score"))
    calls = speakers.groupBy("interaction_id").agg(F.array_sort(F.collect_set("contact_id")).alias("_who")).where(F.size("_who") > 0)
    edges = affinity.where("weight > 0").select("contact_id", "project_id").distinct()
    sets = calls.select("_who").distinct().select("_who", F.explode("_who").alias("contact_id")).join(c, "contact_id").join(edges, "contact_id")
    found = sets.groupBy("_who", "project_id").agg(F.max("score").alias("score"), F.count("*").alias("n_speakers"))
    return calls.join(found, "_who").select("interaction_id", "project_id", "score", "n_speakers")


def list_floaters(links: DataFrame, least: int = 3) -> DataFrame:
    """Contacts in ``least`` projects or more, with the ordered projects."""
    n = links.groupBy("contact_id").agg(F.countDistinct("project_id").alias("n_projects"), F.concat_ws(",", F.array_sort(F.collect_set("project_id"))).alias("projects"))
    return n.where(F.col("n_projects") >= least)


def contact_fanout(contacts: DataFrame, interactions: DataFrame, affinity: DataFrame, as_of: str, window: int = 90) -> DataFrame:
    """The larger of active projects in the window and positive edges, and its class."""
    active = interactions.where((F.col("event_at_utc") > at(as_of) - days(window)) & (F.col("event_at_utc") <= at(as_of)) & F.col("project_id").isNotNull()).groupBy("contact_id").agg(F.countDistinct("project_id").alias("_a"))
    edges = affinity.where("weight > 0").groupBy("contact_id").agg(F.countDistinct("project_id").alias("_e"))
    rows = contacts.select(F.col("id").alias("contact_id")).join(active, "contact_id", "left").join(edges, "contact_id", "left")
    n = F.greatest(F.coalesce("_a", F.lit(0)), F.coalesce("_e", F.lit(0)))
    return rows.select("contact_id", F.coalesce("_a", F.lit(0)).alias("active_project_count"), F.coalesce("_e", F.lit(0)).alias("affinity_project_count"), n.alias("effective_fanout"), F.when(n == 0, "unknown").when(n == 1, "anchored").when(n == 2, "semi").when(n <= 4, "drifter").otherwise("floater").alias("fanout_class"))


def project_alias_lookup(projects: DataFrame, aliases: DataFrame, blocked: DataFrame) -> DataFrame:
    """Distinct aliases of open client projects from the table and the projects' own names, without blocked projects."""
    fine = projects.where("project_kind = 'client' AND status IN ('active', 'warranty', 'estimating')").join(blocked.select(F.col("project_id").alias("id")), "id", "left_anti")
    both = aliases.where("active").select("project_id", F.lower(F.trim("alias")).alias("alias")).unionByName(fine.select(F.col("id").alias("project_id"), F.lower(F.trim("name")).alias("alias")))
    return both.join(fine.select(F.col("id").alias("project_id")), "project_id", "left_semi").where("alias <> ''").distinct()


def generate_client_aliases(links: DataFrame, contacts: DataFrame) -> DataFrame:
    """First and last names of the clients of a project."""
    w = F.split(F.trim("name"), r"[\s#]+")
    rows = links.where("weight > 0").join(contacts.select(F.col("id").alias("contact_id"), "name"), "contact_id").select("project_id", F.explode(F.array(F.get(w, F.lit(0)), F.element_at(w, -1))).alias("alias"))
    return rows.where("alias <> ''").distinct()


def generate_place_aliases(projects: DataFrame) -> DataFrame:
    """alias, confidence: the name's stem 0.95, city and county 0.80, street and its first two words 0.85."""
    stem = F.trim(F.regexp_replace("name", r"(?i)\s+(residence|house|home|project|remodel|addition)$", ""))
    street = F.regexp_replace("address", r"^\s*[0-9]+\s+", "")
    kinds = [(stem, 0.95, "name_stem"), (F.col("city"), 0.80, "city"), (F.col("county"), 0.80, "county"), (street, 0.85, "street"), (F.substring_index(street, " ", 2), 0.85, "street")]
    rows = projects.select(F.col("id").alias("project_id"), F.explode(F.array(*(F.struct(F.trim(a).alias("alias"), F.lit(c).alias("confidence"), F.lit(k).alias("alias_type")) for a, c, k in kinds))).alias("x")).select("project_id", "x.*")
    return rows.where("alias IS NOT NULL AND alias <> ''").groupBy("project_id", "alias").agg(F.max("confidence").alias("confidence"), F.min("alias_type").alias("alias_type"))


def alias_candidates_zero(projects: DataFrame, aliases: DataFrame, generic: tuple[str, ...] = ("residence", "house", "home", "project", "remodel")) -> DataFrame:
    """Suggestions for projects without any alias: first word 0.7, last word 0.6 unless generic."""
    bare = projects.join(aliases.select(F.col("project_id").alias("id")).distinct(), "id", "left_anti")
    w = F.split(F.trim("name"), r"\s+")
    last = F.when((F.size(w) > 1) & ~F.lower(F.element_at(w, -1)).isin(*generic), F.element_at(w, -1))
    rows = bare.select(F.col("id").alias("project_id"), F.explode(F.array(F.struct(F.get(w, F.lit(0)).alias("alias"), F.lit(0.7).alias("confidence")), F.struct(last.alias("alias"), F.lit(0.6).alias("confidence")))).alias("x")).select("project_id", "x.*")
    return rows.where("alias IS NOT NULL AND alias <> ''").groupBy("project_id", "alias").agg(F.max("confidence").alias("confidence"))


def alias_candidates_auto_only(projects: DataFrame, aliases: DataFrame) -> DataFrame:
    """For projects whose aliases are all automatic: the name and the street together, 0.5."""
    auto = aliases.groupBy(F.col("project_id").alias("id")).agg(F.bool_and(F.col("source") == "auto").alias("auto")).where("auto")
    return projects.where("address IS NOT NULL").join(auto, "id", "left_semi").select(F.col("id").alias("project_id"), F.concat_ws(" ", F.get(F.split("name", r"\s+"), F.lit(0)), F.regexp_replace("address", r"^\s*[0-9]+\s+", "")).alias("alias"), F.lit(0.5).alias("confidence"))


def alias_candidates_mined(texts: DataFrame, known: DataFrame, stop: DataFrame, least: int = 3) -> DataFrame:
    """Words of 4 characters or more in ``least`` interactions of a project or more that are no alias, name or stopword."""
    words = texts.where("project_id IS NOT NULL").select("project_id", "interaction_id", F.explode(F.array_distinct(tokens(F.col("text")))).alias("term")).where(F.length("term") >= 4)
    n = words.groupBy("project_id", "term").agg(F.countDistinct("interaction_id").alias("n"), F.concat_ws(",", F.slice(F.array_sort(F.collect_set("interaction_id")), 1, 3)).alias("samples")).where(F.col("n") >= least)
    free = n.join(known.select("term").distinct(), "term", "left_anti").join(stop.select("term").distinct(), "term", "left_anti")
    return free.select("project_id", "term", "n", F.least(F.lit(0.8), 0.4 + 0.1 * (F.col("n") - 3)).alias("confidence"), "samples")


def promote_aliases(suggestions: DataFrame, aliases: DataFrame) -> DataFrame:
    """Approved suggestions that are no active alias yet."""
    have = aliases.where("active").select("project_id", F.lower("alias").alias("_a")).distinct()
    new = suggestions.where("status = 'approved'").withColumn("_a", F.lower("alias")).join(have, ["project_id", "_a"], "left_anti")
    return latest(new, ["project_id", "_a"], F.desc("confidence"), F.col("alias")).select("project_id", "alias", "confidence")


def retire_closed_aliases(aliases: DataFrame, projects: DataFrame) -> DataFrame:
    ended = projects.where("status IN ('closed', 'inactive')").select(F.col("id").alias("project_id"), F.lit(True).alias("_e"))
    return aliases.join(ended, "project_id", "left").withColumn("retired", F.col("active") & F.coalesce("_e", F.lit(False))).withColumn("active", F.col("active") & F.col("_e").isNull()).drop("_e")


def expire_suggestions(suggestions: DataFrame, as_of: str, keep: int = 30) -> DataFrame:
    return suggestions.withColumn("status", F.when((F.col("status") == "pending") & (F.col("created_at") < at(as_of) - days(keep)), "rejected").otherwise(F.col("status")))


def alias_collisions(aliases: DataFrame) -> DataFrame:
    """Aliases, case aside, of more than one project."""
    return aliases.where("active").groupBy(F.lower("alias").alias("alias")).agg(F.countDistinct("project_id").alias("n"), F.concat_ws(",", F.array_sort(F.collect_set("project_id"))).alias("projects")).where("n > 1")


def contact_alias_collisions(proposed: DataFrame, contacts: DataFrame) -> DataFrame:
    """Proposed aliases that are a name, part of a name, an alias or a company of another contact."""
    key = lambda c: F.lower(F.trim(c))
    rows = [contacts.select("id", key(F.col("name")).alias("k"), F.lit("name").alias("kind")), contacts.select("id", F.explode(F.split(key(F.col("name")), r"[\s#]+")).alias("k"), F.lit("name_part").alias("kind")), contacts.select("id", key(F.col("company")).alias("k"), F.lit("company").alias("kind")), contacts.select("id", F.explode("aliases").alias("a")).select("id", key(F.col("a")).alias("k"), F.lit("alias").alias("kind"))]
    known = rows[0]
    for r in rows[1:]:
        known = known.unionByName(r)
    known = known.where("k <> '' AND id IS NOT NULL").distinct()
    # How many have a key is counted once; a contact that has it itself is taken off.
    counts = known.groupBy("k", "kind").agg(F.count("*").alias("_n"))
    asked = proposed.where("contact_id IS NOT NULL").select("contact_id", "alias", key(F.col("alias")).alias("k")).distinct()
    own = known.select(F.col("id").alias("contact_id"), "k", "kind", F.lit(1).alias("_own"))
    rows = asked.join(counts, "k").join(own, ["contact_id", "k", "kind"], "left")
    return rows.withColumn("n_contacts", F.col("_n") - F.coalesce("_own", F.lit(0))).where("n_contacts > 0").select("contact_id", "alias", "kind", "n_contacts")


def suggest_contact_aliases(texts: DataFrame, contacts: DataFrame, most: int = 2) -> DataFrame:
    """Words that are within ``most`` edits of a contact's name word; they share a trigram, and are no name themselves."""
    names = contacts.select("id", F.explode(F.split(F.lower("name"), r"[^a-z]+")).alias("part")).where(F.length("part") >= 4).distinct()
    words = texts.select(F.explode(F.regexp_extract_all("text", F.lit(r"\b([A-Z][a-z]{3,})\b"), F.lit(1))).alias("w")).select(F.lower("w").alias("word")).distinct()
    # Different words meet different name words, on trigrams, where their lengths allow so few edits.
    keyed = lambda df, c: df.select(c).distinct().withColumn("_k", F.explode(trigrams(F.col(c))))
    near = keyed(words, "word").join(keyed(names, "part"), "_k").where((F.abs(F.length("word") - F.length("part")) <= most) & (F.col("word") != F.col("part"))).select("word", "part").distinct()
    near = near.withColumn("edits", F.levenshtein(F.col("word"), F.col("part"), most)).where("edits >= 0").join(names.select(F.col("part").alias("word")), "word", "left_anti")
    return near.join(names, "part").select("word", "part", "id", "edits")


def alias_discovery_status(contacts: DataFrame) -> DataFrame:
    n = F.size("aliases")
    return contacts.select("id", F.when(F.col("notes").rlike(r"(?i)\b(aka|also known|goes by|nickname)\b"), "HAS_NOTES_VARIATIONS").when(F.col("company").isNotNull() & (F.size("company_aliases") == 0), "NEEDS_COMPANY_ALIASES").when(n == 0, "NO_ALIASES").otherwise("OK").alias("status"))


def identity_merge_gate(pairs: DataFrame, nicknames: DataFrame, least: float = 0.85) -> DataFrame:
    """AUTO_MERGE, SUGGEST, REJECT or BLOCK for pairs of names with anchor and conflict flags.

    ``pairs`` has pair_id, name_a, name_b, anchored, conflict. Equal names are
    exact; equal last names with first names of one nickname group, or of more
    than 3 letters and Jaro-Winkler similar, are near. Similarity is computed
    on the distinct pairs of first names.
    """
    w = lambda c: F.split(F.lower(F.trim(c)), r"\s+")
    rows = pairs.withColumn("_fa", F.get(w("name_a"), F.lit(0))).withColumn("_fb", F.get(w("name_b"), F.lit(0))).withColumn("_same_last", F.element_at(w("name_a"), -1) == F.element_at(w("name_b"), -1))

    @F.pandas_udf("double")
    def alike(a: pd.Series, b: pd.Series) -> pd.Series:
        return pd.Series([jaro_winkler(x, y) for x, y in zip(a, b)])

    close = rows.where("_fa IS NOT NULL AND _fb IS NOT NULL").select("_fa", "_fb").distinct().withColumn("_jw", alike("_fa", "_fb"))
    nick = nicknames.alias("x").join(nicknames.alias("y"), F.col("x.group") == F.col("y.group")).select(F.col("x.name").alias("_fa"), F.col("y.name").alias("_fb"), F.lit(True).alias("_nick")).distinct()
    out = rows.join(close, ["_fa", "_fb"], "left").join(nick, ["_fa", "_fb"], "left")
    exact = F.lower(F.trim("name_a")) == F.lower(F.trim("name_b"))
    near = F.col("_same_last") & (F.coalesce("_nick", F.lit(False)) | ((F.length("_fa") > 3) & (F.length("_fb") > 3) & (F.col("_jw") >= least)))
    gate = F.when(F.col("conflict"), "BLOCK").when(exact & F.col("anchored"), "AUTO_MERGE").when(near & F.col("anchored"), "AUTO_MERGE").when(exact | near, "SUGGEST").otherwise("REJECT")
    return out.select("pair_id", gate.alias("gate"), F.round("_jw", 4).alias("first_name_similarity"))


def jaro_winkler(a: str, b: str) -> float:
    """Jaro-Winkler similarity of two words; of characters out of place whole pairs are transpositions, as Winkler counts them."""
    if a == b:
        return 1.0
    reach = max(0, max(len(a), len(b)) // 2 - 1)
    # The free places of each character in b: those left of the reach are never in it again, so a long word takes one pass.
    free: dict[str, deque[int]] = {}
    for j, ch in enumerate(b):
        free.setdefault(ch, deque()).append(j)
    pairs = []
    for i, ch in enumerate(a):
        at = free.get(ch, ())
        while at and at[0] < i - reach:
            at.popleft()
        if at and at[0] <= i + reach:
            pairs.append((i, at.popleft()))
    if not pairs:
        return 0.0
    m = len(pairs)
    moved = sum(a[i] != b[j] for (i, _), j in zip(pairs, sorted(j for _, j in pairs))) // 2
    jaro = (m / len(a) + m / len(b) + (m - moved) / m) / 3
    prefix = next((k for k in range(min(4, len(a), len(b))) if a[k] != b[k]), min(4, len(a), len(b)))
    return jaro + 0.1 * prefix * (1 - jaro)


def link_vendors(links: DataFrame, projects: DataFrame) -> DataFrame:
    """ok or the error of each link: required fields, a known project, the first of repeats."""
    known = projects.select(F.col("id").alias("project_id"), F.lit(True).alias("_p"))
    rows = links.join(known, "project_id", "left").withColumn("_n", F.row_number().over(Window.partitionBy("project_id", "vendor_id").orderBy("row_id")))
    return rows.select("row_id", F.when(F.col("vendor_id").isNull() | F.col("project_id").isNull(), "missing_field").when(F.col("_p").isNull(), "unknown_project").when(F.col("_n") > 1, "repeated").otherwise("ok").alias("result"))


def external_contacts(contacts: DataFrame) -> DataFrame:
    return contacts.where("NOT is_internal AND interaction_count > 0").select("id", "name", "interaction_count", (F.col("interaction_count") + F.col("total_transcript_chars") / 150.0 * 0.5).alias("engagement_score"))


def pending_alias_review(suggestions: DataFrame, aliases: DataFrame) -> DataFrame:
    """Pending suggestions with the projects that have the alias already."""
    have = aliases.where("active").select(F.lower("alias").alias("_a"), F.col("project_id").alias("_p")).distinct()
    rows = suggestions.where("status = 'pending'").withColumn("_a", F.lower("alias")).join(have, "_a", "left").where("_p IS NULL OR _p <> project_id")
    return rows.groupBy("project_id", "alias", "created_at").agg(F.concat_ws(",", F.array_sort(F.collect_set("_p"))).alias("collides_with"))
