"""A training corpus from raw documents: good, identified, distinct, uncontaminated and mixed to target weights.

Each stage takes (spark, docs, sf_dir), works on all rows of ``docs`` and returns the rows it keeps with the columns of
``documents``; the last returns the corpus: the documents taken, whole, with their copies and the words they take. Stages are
written as Parquet to the folder that the cluster shares and read back, so that a lost executor repeats one stage only.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from lodestone.llm import crf, decontam, mixing, quality, simhash
from lodestone.llm.common import stash, table


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that fail the base rules or that the trees reject go."""
    return quality.keep_good(docs, table(spark, sf_dir, "labels"))


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without letters, or whose words are not identified (in whatever languages) with half their posterior, go."""
    return crf.keep_identified(docs, crf.train(docs))


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The document with the smallest id of each near-duplicate group stays."""
    return simhash.keep_first(docs)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold a window of a benchmark item go."""
    return decontam.drop_contaminated(docs, table(spark, sf_dir, "benchmark"))


def source_mixing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents that the mix takes, with all their columns, ``copies`` and ``taken`` (words)."""
    return mixing.take(docs)


STAGES = [
    ("quality rules", quality_rules),
    ("language ID", language_id),
    ("near-dedup", near_dedup),
    ("decontamination", decontamination),
    ("source mixing", source_mixing),
]

#: Boosted trees, the random field and the pivotal rounding have no SQL form; tests hold run() against plain Python.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = stash(stage(spark, docs, sf_dir), name.replace(" ", "-"))
    return STAGES[-1][1](spark, docs, sf_dir)
