"""Quality classifier: positive-unlabelled learning.

A small network over document statistics minimises the non-negative unbiased
risk  pi E_p[l(f)] + max(0, E_u[l(-f)] - pi E_p[l(-f)])  with the logistic
loss.  Where the negative part falls below zero its gradient is turned round.
Labelled bad documents are never used.

Positives: at most SAMPLE_ROWS labelled good documents.  Unlabelled: all rows
outside the held-out fold, at any size.  Their statistics are computed once and
written; means and scales are aggregates over all of them.  Training shards of
about SHARD_ROWS rows are dealt by the hash of a row, copies apart, and sorted, so
neither the cluster nor the files decide what a shard holds.  In each round every
shard goes on from the same weights, takes steps on its own rows and the
positives, and the weights are averaged by rows in an aggregation, so the
unlabelled risk is that of all rows.

The class prior is estimated from positives and unlabelled alone: whatever the
network scores above a threshold holds at least pi times the share of positives
above it, so pi is the least ratio of the two shares over thresholds, each taken
with its sampling error.  The first rounds use START; then the prior is
estimated and the last rounds run with it.  With the logistic loss the output
is the log-odds under the prior, so it needs no other scale.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import held_out, mapped, saved, work_dir
from .docstats import FEATURES, statistics
from .quality_rules import lists_of, matrix
from .textkernel import pieces
from .training import training_labels

HIDDEN, BATCH, RATE = 32, 128, 0.01
#: Rows of a training shard; copies of one row that are dealt at once
SHARD_ROWS, COPIES = 1 << 14, 4096
#: Rounds with the first prior and with the estimated one; least steps of a shard in a round; bins of scores
ROUNDS, STEPS, BINS = (2, 2), 400, 1000
START, ERROR = 0.5, 1.0  # the first prior; standard errors that a share is widened by
GOOD = 0.3
WIDTH = 2 * len(FEATURES)


def _inputs(x: np.ndarray) -> np.ndarray:
    """Rates near zero matter most: add their square roots."""
    return np.concatenate([x, np.sqrt(np.maximum(x, 0))], axis=1)


def _sigmoid(z: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(z, -30, 30)))


class Network:
    def __init__(self, mean: np.ndarray, scale: np.ndarray):
        rng = np.random.Generator(np.random.PCG64(8))
        self.mean, self.scale = mean, scale
        self.p = [rng.normal(0, len(mean) ** -0.5, (len(mean), HIDDEN)), np.zeros(HIDDEN), rng.normal(0, HIDDEN**-0.5, HIDDEN), np.zeros(1)]

    def raw(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        s = np.clip((_inputs(x) - self.mean) / self.scale, -8, 8)
        a = np.tanh(s @ self.p[0] + self.p[1])
        return a @ self.p[2] + self.p[3][0], a, s

    def score(self, x: np.ndarray) -> np.ndarray:
        return _sigmoid(self.raw(x)[0])

    def gradients(self, dz: np.ndarray, a: np.ndarray, s: np.ndarray) -> list[np.ndarray]:
        da = np.outer(dz, self.p[2]) * (1 - a * a)
        return [s.T @ da, da.sum(axis=0), a.T @ dz, np.array([dz.sum()])]

    def flat(self) -> np.ndarray:
        return np.concatenate([p.ravel() for p in self.p])

    def put(self, flat: np.ndarray) -> None:
        ends = np.cumsum([p.size for p in self.p])
        self.p = [part.reshape(p.shape).copy() for p, part in zip(self.p, np.split(flat, ends[:-1]))]

    def fit(self, positive: np.ndarray, other: np.ndarray, prior: float, rate: float, seed: int) -> None:
        """Passes over ``other``, of STEPS steps together at least, that lower the non-negative risk."""
        rng = np.random.Generator(np.random.PCG64(seed))
        m, v, t = [np.zeros_like(p) for p in self.p], [np.zeros_like(p) for p in self.p], 0
        a_pass = -(-len(other) // BATCH)
        for _ in range(-(-STEPS // a_pass)):
            order = rng.permutation(len(other))
            for at in range(0, len(order), BATCH):
                zu, au, su = self.raw(other[order[at : at + BATCH]])
                zp, ap, sp = self.raw(positive[rng.integers(0, len(positive), BATCH)])
                negative = np.logaddexp(0, zu).mean() - prior * np.logaddexp(0, zp).mean()
                du, dp = _sigmoid(zu) / len(zu), _sigmoid(zp) / len(zp)
                if negative >= 0:
                    parts = [(du, au, su), (prior * (dp - 1 / len(zp)) - prior * dp, ap, sp)]
                else:
                    parts = [(-du, au, su), (prior * dp, ap, sp)]
                t += 1
                for k, g in enumerate(x + y for x, y in zip(self.gradients(*parts[0]), self.gradients(*parts[1]))):
                    g = g + 1e-4 * self.p[k]
                    m[k] = 0.9 * m[k] + 0.1 * g
                    v[k] = 0.999 * v[k] + 0.001 * g * g
                    self.p[k] = self.p[k] - rate * (m[k] / (1 - 0.9**t)) / (np.sqrt(v[k] / (1 - 0.999**t)) + 1e-8)


def prior_of(positive: np.ndarray, other: np.ndarray) -> float:
    """The share of positives in the unlabelled, from counts of both by score (ascending bins)."""
    n, m = positive.sum(), other.sum()
    p, u = positive[::-1].cumsum() / n, other[::-1].cumsum() / m
    above = (u + ERROR * np.sqrt(u * (1 - u) / m)) / np.maximum(p - ERROR * np.sqrt(p * (1 - p) / n), 1e-9)
    return float(np.clip(above[p > 0.1].min(initial=1.0), 0.01, 0.99))


def featured(docs: DataFrame) -> DataFrame:
    """Per row of ``docs`` (doc_id, text): doc_id and its statistics."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for p in pieces(batches, "text"):
            yield pa.RecordBatch.from_arrays([p.column("doc_id"), lists_of(statistics(p.column("text"))[1])], names=["doc_id", "x"])

    return mapped(docs.select(F.col("doc_id").cast("long"), "text"), run, "doc_id long, x array<double>")


def _blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[np.ndarray]:
    for b in batches:
        if b.num_rows:
            yield b.column("x").flatten().to_numpy().reshape(b.num_rows, -1)


def sharded(web: DataFrame) -> DataFrame:
    """(shard, x): the rows of ``web`` (doc_id, x) in shards that depend on the rows alone.

    Rows that repeat are counted first and then dealt one by one, so no row, however often it is there, fills a shard.
    """
    shards = max(1, -(-web.count() // SHARD_ROWS))
    counted = web.groupBy("doc_id", "x").agg((F.count("*") - 1).alias("more"))
    some = counted.select("doc_id", "x", "more", F.explode(F.sequence(F.lit(0).cast("long"), F.floor(F.col("more") / COPIES))).alias("part"))
    each = some.select("doc_id", "x", F.explode(F.sequence(F.col("part") * COPIES, F.least(F.col("more"), (F.col("part") + 1) * COPIES - 1))).alias("copy"))
    return each.select(F.pmod(F.xxhash64("doc_id", "x", "copy"), F.lit(shards)).alias("shard"), "x")


def _round(shards: DataFrame, net: Network, positive: np.ndarray, prior: float, rate: float, seed: int) -> None:
    """One round over all shards: each learns on, their weights are averaged by rows."""
    sent = shards.sparkSession.sparkContext.broadcast((net, positive))

    def run(table: pa.Table) -> pa.Table:
        own, trusted = sent.value
        mine = Network(own.mean, own.scale)
        mine.put(own.flat())
        other = np.concatenate(list(_blocks(table.to_batches())))  # a hundred bytes for each document of the shard
        mine.fit(trusted, other[np.lexsort(other.T)], prior, rate, seed)
        return pa.table({"n": pa.array([len(other)], pa.int64()), "weights": pa.array([mine.flat().tolist()], pa.list_(pa.float64()))})

    learnt = shards.groupBy("shard").applyInArrow(run, "n long, weights array<double>").select("n", F.posexplode("weights").alias("k", "w"))
    mean = learnt.groupBy("k").agg((F.sum(F.col("w") * F.col("n")) / F.sum("n")).alias("w")).orderBy("k").collect()  # a row per weight
    if mean:
        net.put(np.round([r["w"] for r in mean], 9))


def _counts(rows: DataFrame, net: Network) -> np.ndarray:
    """Rows by score, in BINS bins."""
    sent = rows.sparkSession.sparkContext.broadcast(net)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(BINS, np.int64)
        for x in _blocks(batches):
            total += _binned(sent.value, x)
        some = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(some, pa.int64()), pa.array(total[some])], names=["bin", "n"])

    out = np.zeros(BINS)
    for r in mapped(rows.select("x"), run, "bin long, n long").groupBy("bin").agg(F.sum("n").alias("n")).collect():  # at most BINS
        out[r["bin"]] = r["n"]
    return out


def _binned(net: Network, x: np.ndarray) -> np.ndarray:
    return np.bincount(np.minimum((net.score(x) * BINS).astype(np.int64), BINS - 1), minlength=BINS)


def _moments(web: DataFrame) -> tuple[np.ndarray, np.ndarray]:
    """Mean and scale of each input over all rows."""
    each: list[Column] = [F.get("x", F.lit(k)) for k in range(len(FEATURES))]
    each += [F.sqrt(F.greatest(c, F.lit(0.0))) for c in each]
    row = web.agg(*[F.avg(c).alias(f"m{k}") for k, c in enumerate(each)], *[F.stddev_pop(c).alias(f"s{k}") for k, c in enumerate(each)]).first()
    got = np.array([np.nan if v is None else v for v in row], float)
    mean, scale = np.round(got[:WIDTH], 9), np.round(got[WIDTH:], 9)
    return np.where(np.isnan(mean), 0, mean), np.where(scale > 1e-9, scale, 1.0)


def fit(features: DataFrame, labels: DataFrame, folder: str | None = None) -> Network:
    """Fitted on rows of ``features`` (doc_id, x) outside the held-out fold.

    Without positives or rows it is the starting network.  Of rows that repeat a
    labelled id the one of the least statistics is the positive.  Rows that tie in
    all statistics are alike, so the number and order of partitions is of no account.
    """
    good = F.broadcast(training_labels(labels, "quality").where("label = 1"))
    known = features.join(good, F.col("doc_id") == F.col("label_id")).groupBy("label_id", "label").agg(F.min("x").alias("x"))
    positive, _ = matrix(known)
    web = features.where(~held_out(F.col("doc_id")))
    net = Network(*_moments(web))
    if not len(positive):
        return net
    shards = saved(sharded(web), f"{folder or work_dir(features.sparkSession, 'pu-quality')}/shards")
    prior, step, total = START, 0, sum(ROUNDS)
    for rounds in ROUNDS:
        for _ in range(rounds):
            _round(shards, net, positive, prior, RATE * (1 - step / total), step)
            step += 1
        if step < total:
            prior = prior_of(_binned(net, positive), _counts(web, net))
    return net


def written(docs: DataFrame, folder: str) -> DataFrame:
    """The statistics of all rows, written."""
    return saved(featured(docs), f"{folder}/features")


def scored(features: DataFrame, net: Network) -> DataFrame:
    """Per row of ``features`` (doc_id, x): score.

    Null and empty texts have the statistics of no words and a score of their own;
    rows that repeat an id each score by their text; an empty table gives an empty one.
    """
    m = features.sparkSession.sparkContext.broadcast(net)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for x in _blocks(iter([b])):
                yield pa.RecordBatch.from_arrays([b.column("doc_id"), pa.array(m.value.score(x))], names=["doc_id", "score"])

    return mapped(features.select("doc_id", "x"), run, "doc_id long, score double")


def op6_pu_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, labels = spark.read.parquet(f"{sf_dir}/documents.parquet"), spark.read.parquet(f"{sf_dir}/labels.parquet")
    folder = work_dir(spark, "pu-quality")
    features = written(docs, folder)
    out = scored(features, fit(features, labels, folder))
    return out.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", (F.col("score") >= GOOD).cast("int").alias("predicted"))
