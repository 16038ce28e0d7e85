"""Who speaks in two-party calls, whom a text mentions, and where a span is bound for."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.basics import latest
from ..plans.match import find_terms, within_distance

#: Quality of a match by phone, and the most that one by name counts, by role.
BY_PHONE = {"owner": 88, "other_party": 86}
BY_NAME = {"owner": 82, "other_party": 80}


def resolve_diarized_speakers(words: DataFrame, calls: DataFrame, contacts: DataFrame, names: DataFrame) -> DataFrame:
    """interaction_id, speaker, role, contact_id, quality, match of the speakers of calls with exactly two.

    Who is called answers first: the owner in inbound calls, the other party in
    outbound ones; a call of neither direction is left alone. A role's phone
    decides, or else its name. ``words`` has speaker and start, ``names`` label,
    contact_id and quality.
    """
    said = words.where("speaker IS NOT NULL AND start IS NOT NULL")
    two = said.groupBy("interaction_id").agg(F.min_by("speaker", F.struct("start", "speaker")).alias("_first"), F.countDistinct("speaker").alias("_n")).where("_n = 2")
    inbound = F.when(F.lower("direction").startswith("in"), True).when(F.lower("direction").startswith("out"), False)
    ways = calls.select("interaction_id", inbound.alias("_in"), "owner_phone", "other_party_phone", "owner_name", "other_party_name").where("_in IS NOT NULL")
    rows = said.select("interaction_id", "speaker").distinct().join(two, "interaction_id").join(ways, "interaction_id")
    rows = rows.withColumn("role", F.when((F.col("speaker") == F.col("_first")) == F.col("_in"), "owner").otherwise("other_party"))
    digits = lambda c: F.right(F.regexp_replace(c, "[^0-9]", ""), F.lit(10))
    of_role = lambda a, b: F.when(F.col("role") == "owner", F.col(a)).otherwise(F.col(b))
    rows = rows.withColumn("_phone", digits(of_role("owner_phone", "other_party_phone"))).withColumn("_label", F.lower(F.trim(of_role("owner_name", "other_party_name"))))
    phones = contacts.select(digits(F.col("phone")).alias("_phone"), "id").where("length(_phone) = 10").groupBy("_phone").agg(F.min("id").alias("_by_phone"))
    known = latest(names.select(F.lower(F.trim("label")).alias("_label"), F.col("contact_id").alias("_by_name"), F.col("quality").alias("_q")), ["_label"], F.desc("_q"), F.col("_by_name"))
    rows = rows.join(phones, "_phone", "left").join(known, "_label", "left").where("_by_phone IS NOT NULL OR _by_name IS NOT NULL")
    most = lambda by: F.when(F.col("role") == "owner", by["owner"]).otherwise(by["other_party"])
    phone = F.col("_by_phone").isNotNull()
    return rows.select("interaction_id", "speaker", "role", F.coalesce("_by_phone", "_by_name").alias("contact_id"), F.when(phone, most(BY_PHONE)).otherwise(F.least(most(BY_NAME), F.col("_q"))).cast("int").alias("quality"), F.when(phone, "phone").otherwise("name").alias("match"))


def expand_from_mentions(texts: DataFrame, contacts: DataFrame, affinity: DataFrame, least: float = 0.9) -> DataFrame:
    """span_id, project_id, contact_id, weight, quality: projects of the contacts a text mentions, the best contact of each.

    Contacts count that don't float and have one project or an affinity of
    ``least``. Quality is 100 for the full name, 80 for first and last name
    apart, 60 for the first name alone unless the text has the full name of
    another contact with it. ``texts`` has span_id and text.

    Of the contacts that share a name only the best of each project is joined,
    so output grows with spans, however many bear a name.
    """
    named = contacts.withColumn("_full", F.lower("name")).withColumn("_w", F.split("_full", " ")).withColumn("_first", F.get("_w", F.lit(0))).withColumn("_last", F.coalesce(F.get("_w", F.lit(1)), F.lit("")))
    top = affinity.groupBy(F.col("contact_id").alias("id")).agg(F.countDistinct("project_id").alias("_n"), F.max("weight").alias("weight"), F.min_by("project_id", F.struct(-F.col("weight"), F.col("project_id"))).alias("project_id"))
    profile = named.where("NOT coalesce(floats_between_projects, false)").join(top, "id").where((F.col("weight") >= least) | (F.col("_n") == 1)).select(F.col("id").alias("contact_id"), "_full", "_first", "_last", "weight", "project_id")
    best = lambda *names: latest(profile, [*names, "project_id"], F.desc("weight"), F.col("contact_id")).select(*names, "project_id", "contact_id", "weight")
    # Each distinct word or name is looked for once.
    terms = named.select(F.explode(F.array("_full", "_first", "_last")).alias("term")).where("term <> ''").distinct()
    hits = find_terms(texts, terms, "span_id").select("span_id", "term").distinct()
    as_ = lambda c: hits.withColumnRenamed("term", c)
    names = profile.select("_first", "_last").distinct()
    # The last names with which a text has a first name in full: none, one, or several, of which none stands alone.
    whole = named.where("length(_first) >= 4 AND _last <> ''").select("_full", "_first", "_last").distinct()
    others = as_("_full").join(whole, "_full").groupBy("span_id", "_first").agg(F.countDistinct("_last").alias("_m"), F.min("_last").alias("_only"))
    alone = as_("_first").where("length(_first) >= 4").join(others, ["span_id", "_first"], "left")
    ways = [
        (100, as_("_full").join(best("_full"), "_full")),
        (80, as_("_first").join(names.where("length(_last) >= 3"), "_first").join(as_("_last"), ["span_id", "_last"]).join(best("_first", "_last"), ["_first", "_last"])),
        (60, alone.where("_m IS NULL").join(best("_first"), "_first")),
        (60, alone.where("_m = 1").withColumnRenamed("_only", "_last").join(best("_first", "_last"), ["_first", "_last"])),
    ]
    rows = reduce(DataFrame.unionByName, (df.select("span_id", "project_id", "contact_id", "weight", F.lit(q).alias("quality")) for q, df in ways))
    return latest(rows, ["span_id", "project_id"], F.desc("quality"), F.desc("weight"), F.col("contact_id")).select("span_id", "project_id", "contact_id", "weight", "quality")


def span_enroute(mentions: DataFrame, places: DataFrame, projects: DataFrame, km: float = 20_000.0) -> DataFrame:
    """span_id, origin_place_id, destination_place_id, confidence, project_id, miles: the best origin and destination of a span.

    The project is the nearest to the destination within ``km``; of ties the
    smallest id. Destinations are few, so each place meets the projects once.
    """
    best = lambda role: latest(mentions.where(F.col("role") == role), ["span_id"], F.desc_nulls_last("confidence"), F.desc("created_at"), F.col("place_id"))
    origin = best("origin").select("span_id", F.col("place_id").alias("origin_place_id"))
    dest = best("destination").select("span_id", F.col("place_id").alias("destination_place_id"), "verb_hint")
    used = dest.select(F.col("destination_place_id").alias("id")).distinct().join(places, "id")
    met = within_distance(used, projects.select(F.col("id").alias("project_id"), F.col("lat").alias("t_lat"), F.col("lon").alias("t_lon")), km)
    near = met.groupBy("id").agg(F.min(F.struct("distance", "project_id")).alias("_near")).select(F.col("id").alias("destination_place_id"), F.col("_near.project_id"), (F.col("_near.distance") * 3958.8 / 6371.0).alias("miles"))
    both = origin.join(dest, "span_id", "full").join(near, "destination_place_id", "left")
    return both.select("span_id", "origin_place_id", "destination_place_id", F.when(F.col("verb_hint").isNull(), "weak").otherwise("explicit").alias("confidence"), "project_id", "miles")
