"""Quality rules: boosted trees over document statistics.

The statistics are exact counts of the whole text; the trees see them as rates.
More symbols, duplicate lines or repeated words can never raise a verdict.
Trees are flat node arrays; a batch is scored in one walk of all its rows down
all trees.  Fitted on at most SAMPLE_ROWS labelled documents outside the
held-out fold.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import trees
from .common import mapped, saved, work_dir
from .docstats import BASE, FEATURES, LOWERING, statistics
from .textkernel import pieces
from .training import labelled

#: Fixed values of the base rule
LEAST_WORDS, MOST_REPEATED = 50, 50
KEEP = 0.5


def lists_of(x: np.ndarray) -> pa.Array:
    return pa.FixedSizeListArray.from_arrays(pa.array(x.ravel()), x.shape[1]).cast(pa.list_(pa.float64()))


def sample_features(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """label and features of a sample's texts."""
    for p in pieces(batches, "text"):
        _, x = statistics(p.column("text"))
        yield pa.RecordBatch.from_arrays([p.column("label"), lists_of(x)], names=["label", "x"])


def matrix(sample: DataFrame) -> tuple[np.ndarray, np.ndarray]:
    """The rows of a bounded sample, in an order of their values."""
    rows = sample.select("label", "x").toArrow()
    if not rows.num_rows:
        return np.zeros((0, len(FEATURES))), np.zeros(0)
    x = pa.concat_arrays(rows.column("x").chunks).flatten().to_numpy().reshape(rows.num_rows, -1)
    y = rows.column("label").to_numpy().astype(float)
    order = np.lexsort([*x.T, y])
    return x[order], y[order]


def fit(docs: DataFrame, labels: DataFrame, folder: str | None = None) -> trees.Forest:
    folder = folder or work_dir(docs.sparkSession, "quality-rules")
    sample = saved(mapped(labelled(docs, labels, "quality"), sample_features, "label int, x array<double>"), f"{folder}/sample")
    x, y = matrix(sample)
    return trees.fit(x, y, np.array([-1 if f in LOWERING else 0 for f in FEATURES]))


def judged(docs: DataFrame, forest: trees.Forest) -> DataFrame:
    """Per row of ``docs`` (doc_id, text): the statistics, base_failed, score, kept.

    Null and empty texts have no words and fail the base rule; rows that repeat an
    id are each judged by their text; an empty table gives an empty one; further
    columns are not read.  A score of exactly KEEP is kept.
    """
    m = docs.sparkSession.sparkContext.broadcast(forest)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for p in pieces(batches, "text"):
            base, x = statistics(p.column("text"))
            failed = (base["n_words"] < LEAST_WORDS) | (100 * base["n_repeat_words"] > MOST_REPEATED * base["n_words"])
            score = m.value.score(x)
            cols = [pa.array(base[k], pa.int64()) for k in BASE]
            yield pa.RecordBatch.from_arrays([p.column("doc_id"), *cols, pa.array(failed), pa.array(score), pa.array(~failed & (score >= KEEP))], names=["doc_id", *BASE, "base_failed", "score", "kept"])

    return mapped(docs.select(F.col("doc_id").cast("long"), "text"), run, "doc_id long, " + ", ".join(f"{k} long" for k in BASE) + ", base_failed boolean, score double, kept boolean")


def op9_boosted_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, labels = spark.read.parquet(f"{sf_dir}/documents.parquet"), spark.read.parquet(f"{sf_dir}/labels.parquet")
    return judged(docs, fit(docs, labels)).select("doc_id", *BASE, "base_failed", "kept")
