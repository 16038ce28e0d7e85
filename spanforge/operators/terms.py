"""Terms of a text by class, from the most to the least specific."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import extract_proper_nouns
from .more import extract_compounds

#: The classes in the order in which a term takes one, and what a term of each counts in scores.
CLASS_WEIGHTS = {"dollar": 3.0, "compound": 2.5, "proper": 2.0, "domain": 1.5, "generic": 1.0}
DOLLARS = r"(\$(?:[0-9]{1,3}(?:,[0-9]{3})+|[0-9]+)(?:\.[0-9]+)?)"


def tagged_terms(texts: DataFrame, key: str, compounds: tuple[str, ...] = (), domain: Sequence[str] = (), stopwords: Sequence[str] = ()) -> DataFrame:
    """key, term, class, weight: every different term of a text under its most specific class.

    Amounts in dollars, phrases that ``compounds`` match, names within
    sentences, and single words of three letters or more that are no stopwords,
    those of ``domain`` apart. A text gives all its classes in one pass, and a
    term's class is the least of those it has.
    """
    names = list(CLASS_WEIGHTS)
    tag = lambda terms, name: F.transform(F.array_distinct(terms), lambda t: F.struct(F.lower(t).alias("term"), F.lit(names.index(name)).alias("c")))
    words = F.filter(F.split(F.regexp_replace(F.lower("text"), "[^a-z0-9$]+", " "), " "), lambda w: (F.length(w) >= 3) & ~_among(w, stopwords))
    # Words are made distinct before they get a class: an array of structs is compared pair by pair.
    single = F.transform(F.array_distinct(words), lambda w: F.struct(w.alias("term"), F.when(_among(w, domain), names.index("domain")).otherwise(names.index("generic")).alias("c")))
    all_ = F.concat(tag(F.regexp_extract_all("text", F.lit(DOLLARS), F.lit(1)), "dollar"), tag(extract_compounds(F.col("text"), compounds), "compound"), tag(extract_proper_nouns(F.col("text")), "proper"), single)
    rows = texts.where("text IS NOT NULL").select(key, F.explode(all_).alias("t")).groupBy(key, F.col("t.term").alias("term")).agg(F.min("t.c").alias("c"))
    at = F.col("c") + 1
    return rows.select(key, "term", F.element_at(F.lit(names), at).alias("class"), F.element_at(F.lit(list(CLASS_WEIGHTS.values())), at).alias("weight"))


def _among(word: Column, words: Sequence[str]) -> Column:
    return word.isin(*words) if words else F.lit(False)
