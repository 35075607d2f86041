"""A training corpus from raw documents in five stages of the ``llm`` operators.

Each stage takes (spark, docs, sf_dir) and returns the documents that it keeps,
with the columns of ``documents``; the last returns the mixed order of use.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from cohortloom.llm.decontaminate import drop_leaks
from cohortloom.llm.minhash import drop_near_duplicates
from cohortloom.llm.mixing import mix_sources
from cohortloom.llm.quality import keep_quality
from cohortloom.llm.repeats import cut_repeats
from cohortloom.llm.shared import table, written


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality classifier rejects go."""
    return keep_quality(docs, table(spark, sf_dir, "labels"))


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies (five-word shingles, 0.8) stays."""
    return drop_near_duplicates(docs, size=5, percent=80)


def repeats(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Byte windows of 100 that start earlier in the corpus are cut out of the texts."""
    return cut_repeats(docs, length=100)


def decontaminate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold a benchmark item go."""
    return drop_leaks(docs, table(spark, sf_dir, "benchmark"))


def mixing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Sources are mixed to the target entropy; a row for each use of a document."""
    return mix_sources(docs)


STAGES = [
    ("quality", quality),
    ("near_duplicates", near_duplicates),
    ("repeats", repeats),
    ("decontaminate", decontaminate),
    ("mixing", mixing),
]

#: SQL cannot express the classifier's training, the signatures or the index.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stages in order, each written and read again."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = written(stage(spark, docs, sf_dir), f"stage-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
