"""A training corpus from raw documents, stage by stage.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame; all but the last
return the columns of documents. Between stages the rows are written and read
again; what an earlier stage has shuffled needs no disk then (``settle``).
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from cliplane.llm import langid, mixing, packing, simhash, substring_dedup
from cliplane.llm.queries import vocabulary
from cliplane.llm.runtime import settle, stash, tables

COLUMNS = ("doc_id", "text", "lang", "source", "n_chars")


def known_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without a language that the classifier can tell go."""
    return langid.keep_known(docs.select(*COLUMNS))


def one_of_each(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near-duplicates stays."""
    settle(spark)
    return simhash.keep_one(docs.select(*COLUMNS))


def no_repeats(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Passages that occur more than once are removed from the texts."""
    settle(spark)
    return substring_dedup.without_repeats(docs.select(*COLUMNS))


def mixed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents are repeated so that the sources follow their target weights."""
    settle(spark)
    return mixing.mix(docs.select(*COLUMNS)).select(*COLUMNS)


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents' tokens in sequences of full length."""
    settle(spark)
    return packing.pack(docs, **vocabulary())


STAGES = [
    ("language_id", known_language),
    ("near_dedup", one_of_each),
    ("substring_dedup", no_repeats),
    ("mixing", mixed),
    ("packing", packed),
]

# SQL can't train the language classifier; tests hold run() against a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents of ``sf_dir``."""
    docs = tables(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = stash(stage(spark, docs, sf_dir), f"pipeline-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
