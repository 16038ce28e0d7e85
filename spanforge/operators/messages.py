"""Signals of e-mail messages, and the projects they name."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..plans.match import find_terms

AMOUNT = r"(\$(?:[0-9]{1,3}(?:,[0-9]{3})+|[0-9]+)(?:\.[0-9]+)?\s*[kK]?)"


def _mentions(messages: DataFrame, aliases: DataFrame) -> DataFrame:
    """message_id, project_id, alias: aliases of three letters or more that stand in subject or body as whole words."""
    named = aliases.where(F.length(F.trim("alias")) >= 3).select("project_id", F.lower(F.trim("alias")).alias("alias")).distinct()
    texts = messages.select("message_id", F.concat_ws(" ", "subject", "body").alias("text"))
    return find_terms(texts, named, "message_id", term="alias").select("message_id", "project_id", "alias")


def mentioned_projects(messages: DataFrame, aliases: DataFrame) -> DataFrame:
    """message_id, project_id of every project that a message names."""
    return _mentions(messages, aliases).where("project_id IS NOT NULL").select("message_id", "project_id").distinct()


def email_signals(messages: DataFrame, aliases: DataFrame, stopwords: Sequence[str] = (), most_amounts: int = 10, most_keywords: int = 12) -> DataFrame:
    """message_id, mentions, projects, keywords, amounts of every message.

    ``messages`` has message_id, subject and body. Amounts come from the body and
    keywords, words of three letters or more but stopwords, from the subject;
    both are distinct, in order, and the first few. Mentions and projects are sorted.
    """
    found = _mentions(messages, aliases).groupBy("message_id").agg(F.array_join(F.array_sort(F.collect_set("alias")), "|").alias("mentions"), F.array_join(F.array_sort(F.collect_set("project_id")), ",").alias("projects"))
    words = F.split(F.regexp_replace(F.lower(F.coalesce("subject", F.lit(""))), "[^a-z0-9]+", " "), " ")
    fine = F.filter(words, lambda w: (F.length(w) >= 3) & (~w.isin(*stopwords) if stopwords else F.lit(True)))
    amounts = F.array_distinct(F.regexp_extract_all(F.coalesce("body", F.lit("")), F.lit(AMOUNT), F.lit(1)))
    first = lambda c, n, by: F.array_join(F.slice(c, 1, n), by)
    rows = messages.select("message_id", first(F.array_distinct(fine), most_keywords, " ").alias("keywords"), first(amounts, most_amounts, "|").alias("amounts"))
    return rows.join(found, "message_id", "left").select("message_id", "mentions", "projects", "keywords", "amounts")
