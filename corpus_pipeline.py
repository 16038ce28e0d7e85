"""A corpus pipeline of five stages; each reads what the one before it kept.

All stages but the last return the columns of ``documents``: quality rules drop
the documents they reject, line dedup takes boilerplate lines out of the texts,
near-dedup keeps one document of each group, mixing repeats or leaves out
documents by source, and the last encodes what is left. Near-dedup links at a similarity
of 0.8 here, the least that a stage may take, where its own query takes 0.85.

Odd input: rows of null or empty text are rejected by the first stage, as they
have too few words; null ids and sources, repeated rows, ties, very long texts
and further columns are taken as each stage's module says. Empty documents give
no rows.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from spanforge.llm import bpe, line_dedup, near_dedup, quality_rules, source_mix
from spanforge.llm.tables import read, staged


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return quality_rules.keep_good(docs)


def lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return line_dedup.clean_lines(docs).select(*docs.columns)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return near_dedup.keep_one(docs, percent=80)


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return source_mix.mix(docs)


def tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return bpe.digests(docs, bpe.vocabulary())


STAGES = [("quality_rules", quality), ("line_dedup", lines), ("near_dedup", near_duplicates), ("source_mix", mix), ("bpe", tokens)]

#: The last stage runs a tokenizer, which SQL can't express.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = staged(stage(spark, docs, sf_dir), f"pipeline-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
