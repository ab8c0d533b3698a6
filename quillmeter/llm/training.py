"""Bounded samples of labelled rows, for the classifiers."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import held_out

#: Most labelled documents that a model is fitted on
SAMPLE_ROWS = 20_000


def training_labels(labels: DataFrame, column: str, limit: int = SAMPLE_ROWS) -> DataFrame:
    """(id, label) of at most ``limit`` labelled rows outside the held-out fold, by hash order.

    Null labels and ids teach nothing; of labels that repeat an id the largest holds.
    """
    known = labels.where(F.col(column).isNotNull() & F.col("doc_id").isNotNull() & ~held_out(F.col("doc_id")))
    one = known.groupBy(F.col("doc_id").cast("long").alias("label_id")).agg(F.max(column).cast("int").alias("label"))
    return one.orderBy(F.xxhash64("label_id"), "label_id").limit(limit)


def labelled(docs: DataFrame, labels: DataFrame, column: str, limit: int = SAMPLE_ROWS) -> DataFrame:
    """(text, label): one row of each of at most ``limit`` labelled ids, which are broadcast.

    Of texts that repeat an id the one of the smallest hash holds.
    """
    few = F.broadcast(training_labels(labels, column, limit))
    rows = docs.select("doc_id", "text").join(few, F.col("doc_id").cast("long") == F.col("label_id"))
    return rows.groupBy("label_id", "label").agg(F.min_by("text", F.xxhash64("text")).alias("text")).select("text", "label")
