"""A corpus pipeline of five stages over ``documents``: quality, near-duplicates, decontamination, mixing, token output."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from skein.llm import decontaminate, mixing, nearcopies, quality, tokens
from skein.llm.common import stored, table

#: Share of the tokens that the mixing stage keeps.
KEEP_SHARE = 0.8


def good_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality classifier accepts.  It learns from the labelled documents of the table itself.

    Rows are judged by their texts alone, null and empty ones like empty texts, repeated rows alike; without labels all score
    0.5 and stay.  An empty table stays empty; other columns are kept, whatever their names."""
    trees = quality.train(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))
    return quality.accepted(docs, trees)


def no_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies: five-word shingles with a Jaccard similarity of 0.8 or more.

    The smallest id stays, rows without id last; null and empty texts are copies of each other.  Whole texts are compared; an empty
    table stays empty; other columns are kept, whatever their names."""
    return nearcopies.one_of_each(docs)


def no_benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in which no passage of the benchmark occurs: null and empty texts, and all with an empty benchmark.  Whole texts
    are searched, rows without id and repeated rows like others; other columns are kept, whatever their names."""
    return decontaminate.clean(docs, table(spark, sf_dir, "benchmark"))


def mixed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """A sample that draws sources, languages and topics towards the target weights.

    A null source or language is a value of its own, a text without words stays, rows of one id, or without id and with one text,
    share a decision; an empty table stays empty; other columns are kept, whatever their names."""
    return mixing.sampled(docs, keep_share=KEEP_SHARE)


def token_files(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids in ORC files, and what the files hold for each document: a null text the end id alone, rows without id first,
    repeated ids in the order of their texts, whole texts; of an empty table nothing."""
    return tokens.round_trip(docs)


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("quality", good_quality),
    ("near_dedup", no_near_copies),
    ("decontaminate", no_benchmark),
    ("mix", mixed),
    ("tokens", token_files),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``; each result but the last is written as Parquet and read again as the next one's documents.
    Nulls, empty and very long texts, repeated rows, empty tables and other columns are as the stages say."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = stored(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)


#: The classifier has no SQL form; the stages are tested against brute force instead.
ORACLE_SQL = None
