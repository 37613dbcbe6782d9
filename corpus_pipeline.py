"""A corpus pipeline of five stages, each written as Parquet and read again before the next.

Stages work on all rows and whole texts. All but the last return the columns of their input, extra ones included.
Null texts are empty texts, null doc_ids are documents, an empty table gives an empty table.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from corvane.llm import exact_dedup, mixing, ngram_join, packing, quality, queries
from corvane.llm.shared import settled, table, tidied


def keep_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents whose quality score reaches the cut, by the ranking that the labels' training folds teach; without labels all stay."""
    return quality.kept(docs, quality.train(docs, table(spark, sf_dir, "labels")))


def drop_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of documents with equal texts, A-Z lower-cased, the one with the largest doc_id; empty texts are equal as well."""
    return exact_dedup.drop_copies(docs)


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of documents that links join (five words, similarity 0.8) the one with the least doc_id; texts without words stay."""
    return ngram_join.drop_near(docs, 5, 80)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document as often as the mix takes it, none more than twice; texts without words are never taken."""
    return mixing.mixed(docs)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row for each piece of a document in a sequence; a document that the mix took twice is packed twice.

    Workers remember fewer chunks than by default, as the stages before have left the executors' heaps large.
    """
    return packing.pack(docs, queries.tokenizer(), remember=200_000)


STAGES = [("quality", keep_quality), ("exact_dedup", drop_copies), ("near_dedup", drop_near_copies), ("mix", mix_sources), ("pack", pack)]
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages on ``documents``; what a stage has made on its way is deleted once its result is written."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        with tidied(spark):
            docs = settled(stage(spark, docs, sf_dir), f"pipeline-{name}", keep=True)
    return STAGES[-1][1](spark, docs, sf_dir)
