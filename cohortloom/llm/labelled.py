"""Bounded labelled samples for the classifiers, joined to the texts."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cohortloom.llm.shared import crc_mod


def labelled_sample(docs: DataFrame, labels: DataFrame, label: str, folds: int, held_out: int, max_rows: int) -> DataFrame:
    """(doc_id, text, y) of at most max_rows labelled documents outside the held-out fold.

    Rows are taken by the smallest hash of doc_id, so the sample is fixed and
    spread over the table. Null labels and ids are left out; of several label
    rows of one document the largest counts. The sample is bounded by max_rows,
    which is what lets it be broadcast to the scan of the texts.
    """
    y = (
        labels.select(F.col("doc_id").cast("long").alias("doc_id"), F.col(label).cast("int").alias("y"))
        .where(F.col("y").isNotNull() & F.col("doc_id").isNotNull() & (crc_mod(F.col("doc_id"), folds) != held_out))
        .groupBy("doc_id")
        .agg(F.max("y").alias("y"))
    )
    y = y.orderBy(F.xxhash64("doc_id"), "doc_id").limit(max_rows)
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").join(F.broadcast(y), "doc_id")
