"""Set-oriented matching plans: phrases, trigrams, prefixes and grid cells.

Each replaces a comparison of every text with every term by an equi-join on a
key both sides have, and verifies afterwards where the key is only necessary.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

SPLIT = r"[^\p{L}\p{N}_]+"
#: Phrases of a dictionary that are sent to every task; more are exchanged.
BROADCAST_TERMS = 50_000
#: Terms of a dictionary that are compared with each text where it lies.
FEW_TERMS = 100


def tokens(text: Column) -> Column:
    """Lower-case words; a possessive ends before its apostrophe."""
    return F.filter(F.split(F.lower(text), SPLIT), lambda w: w != "")


def phrase_key(text: Column) -> Column:
    return F.array_join(tokens(text), " ")


def ngrams(words: Column, n: int) -> Column:
    """The n-word phrases in order; none when there are fewer words."""
    all_ = F.transform(F.sequence(F.lit(0), F.size(words) - n), lambda i: F.array_join(F.slice(words, i + 1, F.lit(n)), " "))
    return F.when(F.size(words) >= n, all_).otherwise(F.array().cast("array<string>"))


def find_terms(texts: DataFrame, terms: DataFrame, key: str, longest: int | None = None, text: str = "text", term: str = "term") -> DataFrame:
    """Every row of ``terms`` with each text that has it as whole words: ``key``, first_token and hits.

    A place of a text is its word and those after it, as many as the longest
    term has, and not over ``longest`` if it is given. A dictionary of up to
    ``BROADCAST_TERMS`` phrases is broadcast and texts stay where they lie:
    only places that begin like a term, in one word or two, are made into
    phrases, of as many words as the terms that begin so have, and joined to the
    terms' word sequences. With a larger one all phrases are exchanged. It is
    counted first: the planner takes the phrases of a text for no larger than
    the file they come from, and would send them to the driver.
    """
    words = texts.where(F.col(text).isNotNull()).select(key, tokens(F.col(text)).alias("_w"))
    named = terms.withColumn("_phrase", phrase_key(F.col(term))).where(F.col("_phrase") != "")
    own = F.split("_phrase", " ")
    counts = named.groupBy(F.size(own).alias("n")).agg(F.count("*").alias("rows")).collect()
    sizes = sorted(r.n for r in counts if longest is None or r.n <= longest) or [1]
    at = [f"_{i}" for i in range(1, sizes[-1] + 1)]
    zipped = F.arrays_zip(F.col("_w").alias("_1"), *(F.slice("_w", i, F.size("_w")).alias(c) for i, c in enumerate(at[1:], 2)))
    places = words.select(key, F.posexplode(zipped).alias("_at", "_p")).select(key, "_at", "_p.*")
    small = sum(r.rows for r in counts) <= BROADCAST_TERMS
    if small:
        first = at[: min(2, sizes[0])]
        begins = named.where(F.size(own).isin(sizes)).groupBy(*(F.get(own, i).alias(c) for i, c in enumerate(first))).agg(F.collect_set(F.size(own)).alias("_sizes"))
        places = places.join(F.broadcast(begins), first)
    else:
        places = places.withColumn("_sizes", F.array(*map(F.lit, sizes)))
    # A text's last places have fewer words than some terms.
    grams = places.select(key, "_at", F.array(*at).alias("_ws"), F.explode("_sizes").alias("_n")).where(F.get("_ws", F.col("_n") - 1).isNotNull())
    grams = grams.select(key, "_at", F.array_join(F.slice("_ws", F.lit(1), F.col("_n")), " ").alias("_phrase"))
    found = grams.join(F.broadcast(named) if small else named.hint("merge"), "_phrase")
    return found.groupBy(key, *terms.columns).agg(F.min("_at").alias("first_token"), F.count("*").alias("hits"))


def named_groups(texts: DataFrame, terms: DataFrame, key: str, group: str, text: str = "text", term: str = "term") -> DataFrame:
    """Distinct ``key`` and ``group`` of the terms that each text has as whole words.

    Up to ``FEW_TERMS`` terms are looked for where the text lies, so a text
    gives one row a group and not one a term; more go the way of ``find_terms``.
    """
    named = terms.withColumn("_phrase", phrase_key(F.col(term))).where(F.col("_phrase") != "")
    counts = named.groupBy(F.size(F.split("_phrase", " ")).alias("n")).agg(F.count("*").alias("rows")).collect()
    if sum(r.rows for r in counts) > FEW_TERMS:
        return find_terms(texts, terms, key, None, text, term).select(key, group).distinct()
    words = texts.where(F.col(text).isNotNull()).select(key, tokens(F.col(text)).alias("_w"))
    phrases = words.select(key, F.array_distinct(F.concat(*(ngrams(F.col("_w"), n) for n in sorted(r.n for r in counts) or [1]))).alias("_g"))
    sets = named.groupBy(group).agg(F.collect_set("_phrase").alias("_ps"))
    return phrases.join(F.broadcast(sets), F.arrays_overlap("_g", "_ps")).select(key, group).distinct()


def with_members(rows: DataFrame, key: str, groups: DataFrame, group: str, member: str) -> DataFrame:
    """``rows`` joined to ``groups`` on ``group``, where few groups have many rows and many members each.

    The rows of a group are dealt out by ``key`` over all partitions, and each
    deal gets the group's members, in lists, which become rows where the rows of
    ``key`` lie. So nothing of the result is exchanged or sorted, and no task
    has a group alone. Other columns of ``groups`` are to be the same in all of
    a group.
    """
    spark = rows.sparkSession
    n = int(spark.conf.get("spark.sql.shuffle.partitions"))
    # A deal is a number that falls to a partition of its own: those from 0 on would leave a third of them empty.
    found = spark.range(32 * n).select(F.col("id").cast("int").alias("i")).groupBy(F.pmod(F.hash("i"), F.lit(n))).agg(F.min("i").alias("i")).collect()
    deals = F.array(*(F.lit(r.i) for r in sorted(found)))
    own = [c for c in groups.columns if c != member]
    lists = groups.groupBy(*own, F.pmod(F.xxhash64(member), F.lit(n)).alias("_part")).agg(F.collect_list(member).alias("_members")).drop("_part")
    lists = lists.withColumn("_deal", F.explode(deals)).repartition(n, "_deal")
    # The work lies in what is made, so partitions of little input are not to be taken together.
    dealt = rows.withColumn("_deal", F.get(deals, F.pmod(F.xxhash64(key), F.lit(len(found))).cast("int"))).repartition(n, "_deal")
    return dealt.join(lists, [group, "_deal"]).select(*rows.columns, *(c for c in own if c != group), F.explode("_members").alias(member))


def trigrams(text: Column) -> Column:
    """Distinct trigrams of a text with two spaces before and one after it."""
    return F.array_distinct(F.regexp_extract_all(F.concat(F.lit("  "), F.lower(text), F.lit(" ")), F.lit(r"(?s)(?=(...))"), F.lit(1)))


def word_trigrams(text: Column) -> Column:
    """Distinct trigrams of the words of a text, each with two spaces before and one after it."""
    padded = F.concat(F.lit("  "), F.regexp_replace(F.trim(F.lower(text)), r"\s+", "   "), F.lit(" "))
    return F.array_distinct(F.regexp_extract_all(padded, F.lit(r"(?=(  \S| \S[\S ]|\S\S[\S ]))"), F.lit(1)))


def similar(left: DataFrame, right: DataFrame, a: str, b: str, least: float, sets: Callable[[Column], Column] = word_trigrams, common: int = 24) -> DataFrame:
    """a, b, similarity of the pairs of distinct texts whose trigrams' Jaccard index is ``least`` or more.

    Sets are put in one order, in which the ``common`` trigrams that most sets
    of the right side have come last. Two sets that are similar enough share a
    trigram among the first few of both, so only these are joined, and only
    where the sizes and 64 bits of hashed trigrams allow the index; the pairs
    that are left are counted on full sets. The frequent trigrams, which most
    words have, are hardly ever joined.
    """
    grams = lambda df, c: df.where(F.col(c).isNotNull()).select(c).distinct().withColumn("_g", sets(F.col(c))).where(F.size("_g") > 0)
    x, y = grams(left, a), grams(right, b)
    often = [r[0] for r in y.select(F.explode("_g").alias("g")).groupBy("g").count().orderBy(F.desc("count"), "g").limit(common).collect()]
    last = F.lit(often) if often else F.array().cast("array<string>")

    def filed(df: DataFrame, c: str, to: str) -> DataFrame:
        """Each set under the trigrams of its beginning: one more than it may lose."""
        order = F.concat(F.sort_array(F.array_except("_g", last)), F.sort_array(F.array_intersect("_g", last)))
        size = F.size("_g")
        head = F.slice(order, F.lit(1), (size - F.ceil(size * F.lit(least) - 1e-9) + 1).cast("int"))
        bit = lambda g: F.call_function("shiftleft", F.lit(1).cast("long"), F.pmod(F.hash(g), F.lit(64)))
        bits = F.aggregate("_g", F.lit(0).cast("long"), lambda all_, g: all_.bitwiseOR(bit(g)))
        return df.select(c, size.alias(f"{to}n"), bits.alias(f"{to}b"), F.explode(head).alias("_k"))

    n, m = F.col("_xn"), F.col("_yn")
    # Trigrams in common have common bits, but for those that share a bit with others of their set.
    most = F.bit_count(F.col("_xb").bitwiseAND(F.col("_yb"))) + F.least(n - F.bit_count("_xb"), m - F.bit_count("_yb"))
    met = filed(x, a, "_x").join(filed(y, b, "_y"), "_k").where((n >= m * least - 1e-9) & (m >= n * least - 1e-9) & (most >= (n + m) * (least / (1 + least)) - 1e-9))
    # What is left is little: its sets are made again rather than carried through the join.
    left_pairs = met.select(a, b, "_xn", "_yn").distinct()
    both = F.size(F.array_intersect(sets(F.col(a)), sets(F.col(b))))
    return left_pairs.select(a, b, (both / (n + m - both)).alias("similarity")).where(F.col("similarity") >= least)


def trigram_join(left: DataFrame, right: DataFrame, a: str, b: str, least: float) -> DataFrame:
    """a, b, similarity of the pairs of distinct words whose trigrams' Jaccard index is ``least`` or more."""
    return similar(left, right, a, b, least, trigrams)


def haversine(lat1: Column, lon1: Column, lat2: Column, lon2: Column, unit: str = "km") -> Column:
    radius = {"km": 6371.0, "miles": 3958.8}[unit]
    h = F.pow(F.sin((F.radians(lat2) - F.radians(lat1)) / 2), 2) + F.cos(F.radians(lat1)) * F.cos(F.radians(lat2)) * F.pow(F.sin((F.radians(lon2) - F.radians(lon1)) / 2), 2)
    return 2 * radius * F.asin(F.sqrt(F.least(F.lit(1.0), h)))


def within_distance(places: DataFrame, targets: DataFrame, km: float) -> DataFrame:
    """Places (lat, lon) with the targets (t_lat, t_lon) within ``km``: an equi-join on grid cells.

    A cell is ``km`` high; a target is filed under its own and its neighbour
    rows, and under every column that ``km`` can reach at its latitude.
    """
    step = km / 111.0
    row = lambda c: F.floor(c / step).cast("long")
    # Columns are one step wide at the equator; nearer the poles the same distance spans more of them.
    reach = F.ceil(1 / F.greatest(F.cos(F.radians(F.least(F.lit(89.0), F.abs(F.col("t_lat")) + 2 * step))), F.lit(0.017))).cast("long")
    columns = F.lit(int(-(-360.0 // step)))
    filed = targets.withColumn("_r", F.explode(F.sequence(row(F.col("t_lat")) - 1, row(F.col("t_lat")) + 1)))
    filed = filed.withColumn("_c", F.explode(F.array_distinct(F.transform(F.sequence(row(F.col("t_lon")) - reach - 1, row(F.col("t_lon")) + reach + 1), lambda x: F.pmod(x, columns)))))
    here = places.withColumn("_r", row(F.col("lat"))).withColumn("_c", F.pmod(row(F.col("lon")), columns))
    met = here.join(filed, ["_r", "_c"]).withColumn("distance", haversine(F.col("lat"), F.col("lon"), F.col("t_lat"), F.col("t_lon")))
    return met.where(F.col("distance") <= km).drop("_r", "_c")
