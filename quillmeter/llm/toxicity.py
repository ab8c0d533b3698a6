"""Toxicity: a factorization machine over hashed terms.

Terms are lower-cased words (runs of ASCII letters, digits and non-ASCII bytes)
and their first five, seven and nine bytes, hashed to 2**18 buckets.  Every bucket is an
input of the machine.  score = sigmoid(bias + sum w_i x_i + sum over pairs
<v_i, v_j> x_i x_j), so that two terms together can weigh more, or less, than
each alone.  x_i is the bucket's value if the document has it: g / (g + CHANCE),
squared g = the log-likelihood ratio by which the sample's labels differ with the
bucket alone, plus 1 / sqrt(buckets of a mean document).  Terms that tell nothing
alone thus have together the weight of one that does, and still form pairs.

It is fitted on one text of each of at most SAMPLE_ROWS labelled ids, as many of
them, by hash order, as have SAMPLE_TERMS buckets together.  The bias is set apart:
a machine fitted without an inner fold of these documents scores that fold, and
where its F1 is highest is where a score is REJECT.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import held_out, mapped, saved, work_dir
from .textkernel import LOWER, gather, give_back, mix, pieces, span_hashes, split_spans, text_bytes
from .training import labelled

HASH_BITS, FACTORS, SAMPLE_TERMS, STEP_TERMS = 18, 8, 24_000_000, 400_000
BUCKETS = 1 << HASH_BITS
#: Prefixes, in bytes; log-likelihood ratio that counts half
PREFIXES, CHANCE = (5, 7, 9), 16.0
#: Passes over the sample, and steps at least; documents of a step; rate; weight of a toxic document; decays of w and v
EPOCHS, STEPS, BATCH, RATE, WEIGHT, DECAY, DECAY_PAIRS = 2, 150, 128, 0.15, 4.0, 1e-4, 1e-3
#: Of so many labelled documents one is of the inner fold, which sets where a score of REJECT lies
FOLDS, REJECT = 5, 0.5
_SEPARATOR = np.ones(256, bool)
_SEPARATOR[[*range(48, 58), *range(97, 123), *range(128, 256)]] = False


def term_buckets(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The distinct buckets of each row, one row after the other, and where each row's begin."""
    data, offsets = text_bytes(texts)
    data = LOWER[data]
    w = split_spans(data, offsets, _SEPARATOR)
    found, rows = [w.hashes()], [w.row]
    for cut in PREFIXES:
        long = np.flatnonzero(w.end - w.start > cut)
        found.append(mix(span_hashes(data, w.start[long], w.start[long] + cut) + np.uint64(cut)))
        rows.append(w.row[long])
    pair = np.unique((np.concatenate(rows) << HASH_BITS) | (np.concatenate(found) >> np.uint64(64 - HASH_BITS)).astype(np.int64))
    first = np.searchsorted(pair, np.arange(len(offsets), dtype=np.int64) << HASH_BITS)
    return (pair & (BUCKETS - 1)).astype(np.int32), first


def steps(order: np.ndarray, size: np.ndarray) -> Iterator[np.ndarray]:
    """The documents in order, up to BATCH and STEP_TERMS buckets (or one document) at once."""
    ends, at = np.cumsum(size[order]), 0
    while at < len(order):
        most = int(np.searchsorted(ends, STEP_TERMS + (ends[at - 1] if at else 0), side="right"))
        stop = max(at + 1, min(at + BATCH, most))
        yield order[at:stop]
        at = stop


def evidence(x: np.ndarray, first: np.ndarray, labels: np.ndarray, order: np.ndarray | None = None) -> np.ndarray:
    """Each bucket's log-likelihood ratio: how much better the labels are told with it than without."""
    order, size = np.arange(len(labels)) if order is None else order, np.diff(first)
    n, n1 = len(order), labels[order].sum()
    has, has1 = np.zeros(BUCKETS), np.zeros(BUCKETS)
    for docs in steps(order, size):
        own = gather(x, first[:-1], size, docs)
        has += np.bincount(own, minlength=BUCKETS)
        has1 += np.bincount(own, np.repeat(labels[docs], size[docs]), BUCKETS)

    def nats(part: np.ndarray, whole: np.ndarray) -> np.ndarray:
        return np.where(part > 0, part * np.log(np.where(part > 0, part, 1) / np.where(whole > 0, whole, 1)), 0)

    told = nats(has1, has) + nats(has - has1, has) + nats(n1 - has1, n - has) + nats(n - n1 - (has - has1), n - has)
    return np.maximum(0, 2 * (told - n1 * np.log(n1 / n) - (n - n1) * np.log((n - n1) / n)))


class Machine:
    """bias, w and v over all buckets, and the value of each bucket."""

    def __init__(self, bias: float, value: np.ndarray):
        rng = np.random.Generator(np.random.PCG64(5))
        self.bias, self.value = bias, value.astype(np.float32)
        self.w = np.zeros(BUCKETS, np.float32)
        self.v = rng.normal(0, 0.05, (BUCKETS, FACTORS)).astype(np.float32)

    def raw(self, x: np.ndarray, size: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """For documents of ``size`` buckets each: the sum before the sigmoid, factor sums, and each bucket's v and document."""
        n = len(size)
        row, value = np.repeat(np.arange(n), size), self.value[x]
        v = self.v[x] * value[:, None]
        total, some = np.zeros((n, FACTORS), np.float32), size > 0
        if len(x):
            total[some] = np.add.reduceat(v, (np.cumsum(size) - size)[some], axis=0)
        pairs = 0.5 * ((total * total).sum(axis=1) - np.bincount(row, (v * v).sum(axis=1), n))
        return self.bias + np.bincount(row, self.w[x] * value, n) + pairs, total, v, row

    def fit(self, x: np.ndarray, first: np.ndarray, labels: np.ndarray, order: np.ndarray, epochs: int = EPOCHS) -> None:
        """Logistic loss, in steps whose length per weight falls with its past gradients."""
        rng = np.random.Generator(np.random.PCG64(6))
        size, n = np.diff(first), len(order)
        weight = np.where(labels == 1, WEIGHT, 1.0)
        past_b, past_w, past_v = 1e-6, np.full(BUCKETS, 1e-6, np.float32), np.full((BUCKETS, 1), 1e-6, np.float32)
        for _ in range(max(epochs, -(-STEPS * BATCH // n))):
            for docs in steps(order[rng.permutation(n)], size):
                own = gather(x, first[:-1], size, docs)
                z, total, v, row = self.raw(own, size[docs])
                err = ((1 / (1 + np.exp(-np.clip(z, -30, 30))) - labels[docs]) * weight[docs] / len(docs)).astype(np.float32)
                past_b += float(err.sum()) ** 2
                self.bias -= RATE * float(err.sum()) / past_b**0.5
                if not len(own):
                    continue
                by_bucket = np.argsort(own, kind="stable")
                used, begin = np.unique(own[by_bucket], return_index=True)
                pull = err[row] * self.value[own]
                g = np.add.reduceat(pull[by_bucket], begin) + np.float32(DECAY) * self.w[used]
                past_w[used] += g * g
                self.w[used] -= RATE * g / np.sqrt(past_w[used])
                g = np.add.reduceat((pull[:, None] * (total[row] - v))[by_bucket], begin, axis=0) + np.float32(DECAY_PAIRS) * self.v[used]
                past_v[used] += (g * g).mean(axis=1, keepdims=True)
                self.v[used] -= RATE * g / np.sqrt(past_v[used])

    def score(self, texts: pa.Array) -> np.ndarray:
        x, first = term_buckets(texts)
        return 1 / (1 + np.exp(-np.clip(self.raw(x, np.diff(first))[0], -30, 30)))


def _terms(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for p in pieces(batches, "text"):
        x, first = term_buckets(p.column("text"))
        lists = pa.ListArray.from_arrays(pa.array(first, pa.int32()), pa.array(x, pa.int32()))
        marks = [zlib.crc32(x[a:b].tobytes()) for a, b in zip(first[:-1], first[1:])]
        yield pa.RecordBatch.from_arrays([p.column("label"), lists, pa.array(np.diff(first), pa.int64()), pa.array(marks, pa.int64())], names=["label", "terms", "size", "mark"])


def bounded(sample: DataFrame, limit: int = SAMPLE_TERMS) -> DataFrame:
    """The rows of a bounded sample, by (mark, size, label), that have ``limit`` terms together."""
    order = [np.array(c) for c in zip(*sample.select("mark", "size", "label").collect())]
    if not order or order[1].sum() <= limit:
        return sample
    by = np.lexsort(order[::-1])
    last = by[max(0, int(np.searchsorted(np.cumsum(order[1][by]), limit, side="right")) - 1)]
    return sample.where(F.struct("mark", "size", "label") <= F.struct(*[F.lit(int(c[last])).cast(t) for c, t in zip(order, ("long", "long", "int"))]))


def fit(docs: DataFrame, labels: DataFrame, folder: str | None = None) -> Machine:
    """Fitted on labelled rows outside the held-out fold; with one class or none, a constant.

    Of labelled rows the order is that of their terms' hash, size and label; rows that tie in these are alike to the fit.
    """
    folder = folder or work_dir(docs.sparkSession, "toxicity")
    sample = saved(mapped(labelled(docs, labels, "toxic"), _terms, "label int, terms array<int>, size long, mark long"), f"{folder}/sample")
    rows = bounded(sample).toArrow()  # at most SAMPLE_ROWS rows and SAMPLE_TERMS terms
    y = rows.column("label").to_numpy().astype(float)
    if not 0 < y.sum() < len(y):
        return trained(np.zeros(0, np.int32), np.zeros(1, np.int64), y, np.arange(len(y)))
    order = np.lexsort([rows.column(c).to_numpy() for c in ("label", "size", "mark")])
    lists = pa.concat_arrays(rows.column("terms").chunks)
    x, first = lists.values.to_numpy(), lists.offsets.to_numpy().astype(np.int64)
    del rows
    give_back()
    inner = np.arange(len(order)) % FOLDS == 0
    told, size = trained(x, first, y, order[~inner]), np.diff(first)
    z = np.concatenate([told.raw(gather(x, first[:-1], size, docs), size[docs])[0] for docs in steps(order[inner], size)])
    model = trained(x, first, y, order)
    model.bias -= cut(z, y[order[inner]])
    return model


def trained(x: np.ndarray, first: np.ndarray, y: np.ndarray, order: np.ndarray) -> Machine:
    """A machine fitted on the documents of ``order``; of one class, or of none, a constant."""
    n, n1 = len(order), y[order].sum()
    bias = float(np.log((n1 + 0.5) / (n - n1 + 0.5)))
    if not 0 < n1 < n:
        return Machine(bias, np.zeros(BUCKETS))
    g = evidence(x, first, y, order)
    model = Machine(bias, g**2 / (g**2 + CHANCE**2) + 1 / np.sqrt(max(1.0, np.diff(first)[order].mean())))
    model.fit(x, first, y, order)
    return model


def cut(z: np.ndarray, y: np.ndarray) -> float:
    """The sum from which a document of the inner fold is best called toxic: of the highest F1, midway to the next below.

    Of cuts that tie the lowest holds; without toxic documents, or with them alone, it is zero.
    """
    if not 0 < y.sum() < len(y):
        return 0.0
    order = np.argsort(-z, kind="stable")
    z, hit = z[order], np.cumsum(y[order])
    ends = np.flatnonzero(np.append(z[1:] < z[:-1], True))  # equal sums go together
    f1 = 2 * hit[ends] / (ends + 1 + y.sum())
    best = ends[len(f1) - 1 - np.argmax(f1[::-1])]
    return float(z[best] if best + 1 == len(z) else (z[best] + z[best + 1]) / 2)


def scored(docs: DataFrame, model: Machine) -> DataFrame:
    """Per row of ``docs`` (doc_id, text): score.

    Null and empty texts score by the bias; rows that repeat an id each score by
    their text; an empty table gives an empty one; further columns are not read.
    """
    m = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for p in pieces(batches, "text"):
            yield pa.RecordBatch.from_arrays([p.column("doc_id"), pa.array(m.value.score(p.column("text")))], names=["doc_id", "score"])

    return mapped(docs.select(F.col("doc_id").cast("long"), "text"), run, "doc_id long, score double")


def without_toxic(docs: DataFrame, model: Machine) -> DataFrame:
    """``docs`` without rows that score REJECT or more, all columns as they are, in one pass."""
    m = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for p in pieces(batches, "text"):
            yield p.filter(pa.array(m.value.score(p.column("text")) < REJECT))

    return mapped(docs, run, docs.schema)


def op10_factorization_machine(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, labels = spark.read.parquet(f"{sf_dir}/documents.parquet"), spark.read.parquet(f"{sf_dir}/labels.parquet")
    out = scored(docs, fit(docs, labels))
    return out.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", (F.col("score") >= REJECT).cast("int").alias("predicted"))
