"""Removal of repeated passages, by recompression.

A repeat is a window of WINDOW consecutive words that also starts in a document of
a smaller id; every word that such a window covers goes.

Names.  A round of recompression replaces runs of one symbol, or pairs of
neighbours, by names.  Here a name is a 64-bit hash of what it stands for, so all
tasks give one pair one name without a table of names, and two pairs that share a
name only add candidates.  The first round names runs of a repeated word; LEVELS
rounds then name pairs of a left and a right symbol, sides being a bit of the
symbol's hash in that round.  Whether two neighbours are paired depends on them
alone, so of two equal windows only symbols at the ends can differ: the first and
the last run, then in each round the first symbol if it is a right one (it may
belong to what stands before) and the last if it is a left one.  What remains is
the window's core, the same wherever the window stands.

Rounds over the corpus.
0. Whole documents are the highest symbols: of those with the same words the one
   of the smallest id is searched, the others go as they are.
1. Blocks of documents list their distinct level symbols.  The lists are cut by
   ranges of names; each range finds the names of two blocks or more and answers
   every block with a bit per name.
2. A window stays a candidate if all symbols of its core are shared (in the block
   or beyond), or if it has no core.  Candidates' 128-bit word hashes and the
   smallest id that has them in the block go by range again, and a bit comes back:
   a smaller id has this window elsewhere.
3. Covered words become spans, which documents meet by id.

Lists are distinct per block, so a passage that a third of all documents share is a
row per block.  Ranges grow in number with the words, so none grows with the data.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import mapped, saved, sized, work_dir
from .textkernel import _LANE, Words, mix, pieces, span_hashes, words_of

WINDOW, LEVELS = 13, 3
#: Bytes of texts in a block, and names in a range
BLOCK_BYTES, RANGE_NAMES, LEAST_RANGES = 2 << 20, 200_000, 64
#: Bytes of answers and spans up to which they are broadcast
ANSWER_BYTES = 64 << 20
#: A row of a block is some MB: written files are cut by bytes looked at with every row (by itself Parquet looks at each
#: hundredth), so that neither a writer nor a reader, which holds a row group, has many of them.  A writer keeps the least
#: and greatest value of each group up to the file's end, and here these are as long as rows
ROW_GROUPS = {"parquet.block.size": 8 << 20, "parquet.page.size.row.check.min": 1, "parquet.page.size.row.check.max": 1000, "parquet.column.statistics.enabled": "false"}
#: Rank of a row without doc_id: it comes after all others
LAST = (1 << 63) - 1

_rng = np.random.Generator(np.random.PCG64(1313))
_OTHER = _rng.permutation(256).astype(np.uint8)  # bytes as the second hash of words sees them
_RUN, _ROUND, _PAIR = (_rng.integers(1, 2**63, dtype=np.uint64) * np.uint64(2) + np.uint64(1) for _ in range(3))


def _sides(symbol: np.ndarray, level: int) -> np.ndarray:
    """Whether each symbol is a right one in this round."""
    seed = np.uint64(int(_ROUND) * (2 * level + 1) & (1 << 64) - 1)
    return (mix(symbol ^ seed) >> np.uint64(63)).astype(bool)


def parsed(words: np.ndarray, row: np.ndarray, window: int = WINDOW, levels: int = LEVELS) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Symbols after all rounds and their rows; the windows' first words, and the bounds of their cores.

    A core is the symbols [low, high); it is empty where nothing is sure to be alike.
    """
    n = len(words)
    start = np.flatnonzero(row[: n - window + 1] == row[window - 1 :]) if n >= window else np.zeros(0, np.int64)
    begins = np.ones(n, bool)
    begins[1:] = (words[1:] != words[:-1]) | (row[1:] != row[:-1])
    at = np.flatnonzero(begins)
    run = np.cumsum(begins) - 1
    size = np.diff(at, append=n)
    symbol, row = np.where(size > 1, mix(words[at] + size.astype(np.uint64) * _RUN), words[at]), row[at]
    low, high = run[start] + 1, run[start + window - 1]
    for level in range(levels):
        right = _sides(symbol, level)
        some = low < high
        low = low + (some & right[np.minimum(low, max(len(symbol) - 1, 0))]) if len(symbol) else low
        some &= low < high
        high = high - (some & ~right[high - 1]) if len(symbol) else high
        pair = np.flatnonzero(~right[:-1] & right[1:] & (row[:-1] == row[1:]))
        symbol = symbol.copy()
        symbol[pair] = mix(mix(symbol[pair] + _PAIR) + symbol[pair + 1])
        stay = np.ones(len(symbol), bool)
        stay[pair + 1] = False
        before = np.concatenate([[0], np.cumsum(stay)])
        low, high = before[low], before[high]
        symbol, row = symbol[stay], row[stay]
    return symbol, row, start, low, high


def second_hashes(w: Words) -> np.ndarray:
    """Hashes of the words that are independent of ``w.hashes()``."""
    return mix(span_hashes(_OTHER[w.data], w.start, w.end) ^ _ROUND)


def joined(w: Words, kept: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The bytes and row offsets of each row's kept words, joined by one space."""
    inside = np.zeros(len(w.data) + 1, np.int8)
    np.add.at(inside, w.start[kept], 1)
    np.add.at(inside, w.end[kept], -1)
    take = np.cumsum(inside[:-1], dtype=np.int8).astype(bool)
    which = np.flatnonzero(kept)
    followed = which[:-1][w.row[which[1:]] == w.row[which[:-1]]]
    data = w.data.copy()
    data[w.end[followed]] = 0x20  # what ends a word that another follows is a separator
    take[w.end[followed]] = True
    return data[take], np.concatenate([[0], np.cumsum(take, dtype=np.int64)])[w.offsets]


SIGNED = "rank long, version long, n_words long, cls binary"


def _sign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for p in pieces(batches, "text"):
        w = words_of(p.column("text"), lower=False)
        cls = _classes(w)
        yield pa.RecordBatch.from_arrays([p.column("rank"), p.column("version"), pa.array(w.counts, pa.int64()), pa.array(cls, pa.binary())], names=["rank", "version", "n_words", "cls"])


def _classes(w: Words) -> list[bytes]:
    """A digest of each row's words."""
    data, offsets = joined(w, np.ones(len(w.start), bool))
    view = memoryview(data.tobytes())
    return [hashlib.blake2b(view[a:b], digest_size=16).digest() for a, b in zip(offsets[:-1].tolist(), offsets[1:].tolist())]


def _cut(names: np.ndarray, bits: int) -> tuple[np.ndarray, np.ndarray]:
    """The ranges that hold some of the sorted names, and where each begins (and the end)."""
    of = (names >> np.uint64(64 - bits)).astype(np.int64)
    begin = np.flatnonzero(np.diff(of, prepend=-1))
    return of[begin], np.append(begin, len(names))


def _blobs(values: np.ndarray, bounds: np.ndarray) -> list[bytes]:
    return [values[a:b].tobytes() for a, b in zip(bounds[:-1].tolist(), bounds[1:].tolist())]


BLOCKS = "block long, ranks array<long>, classes array<binary>, texts array<string>, ranges array<long>, names array<binary>"
_LIST = pa.list_


def _listed(bits: int):
    """Documents to blocks with their distinct names by range."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seq = TaskContext.get().partitionId() << 32
        for p in pieces(batches, "text", BLOCK_BYTES):
            w = words_of(p.column("text"), lower=False)
            names = np.unique(parsed(w.hashes(), w.row)[0])
            ranges, bounds = _cut(names, bits)
            columns = [(p.column("rank"), pa.int64()), (_classes(w), pa.binary()), (p.column("text"), pa.string()), (ranges, pa.int64()), (_blobs(names, bounds), pa.binary())]
            lists = [pa.array([c.to_pylist() if isinstance(c, pa.Array) else list(c)], _LIST(k)) for c, k in columns]
            yield pa.RecordBatch.from_arrays([pa.array([seq], pa.int64()), *lists], names=[c.split()[0] for c in BLOCKS.split(", ")])
            seq += 1

    return run


def _answers(table: pa.Table, per_row: list[np.ndarray]) -> pa.Table:
    """Bits for each block of a range; blocks without one are left out."""
    some = [k for k, bits in enumerate(per_row) if bits.any()]
    packed = [np.packbits(per_row[k]).tobytes() for k in some]
    kept = table.take(pa.array(some, pa.int64()))
    return pa.table({"block": kept.column("block"), "range": kept.column("range"), "bits": pa.array(packed, pa.binary())})


def _together(table: pa.Table, column: str, kind: str = "<u8") -> list[np.ndarray]:
    return [np.frombuffer(x, kind) for x in table.column(column).to_pylist()]


def _shared(table: pa.Table) -> pa.Table:
    """Which names of each block another block of the range has, too."""
    each = _together(table, "names")
    names = np.concatenate(each)
    order = np.argsort(names, kind="stable")
    ranked = names[order]
    same = ranked[1:] == ranked[:-1]
    twice = np.zeros(len(names), bool)
    twice[order[1:][same]] = True
    twice[order[:-1][same]] = True
    return _answers(table, np.split(twice, np.cumsum([len(x) for x in each])[:-1]))


def _least(table: pa.Table) -> pa.Table:
    """For which windows of each block another block has a smaller rank."""
    each = _together(table, "first")
    first, second, rank = np.concatenate(each), np.concatenate(_together(table, "second")), np.concatenate(_together(table, "least", "<i8"))
    order = np.lexsort((rank, second, first))
    a, b, r = first[order], second[order], rank[order]
    new = np.ones(len(a), bool)
    new[1:] = (a[1:] != a[:-1]) | (b[1:] != b[:-1])
    smallest = r[np.flatnonzero(new)][np.cumsum(new) - 1]
    elsewhere = np.zeros(len(a), bool)
    elsewhere[order] = smallest < r
    return _answers(table, np.split(elsewhere, np.cumsum([len(x) for x in each])[:-1]))


def _said(ranges: np.ndarray, bounds: np.ndarray, answers: list[dict] | None) -> np.ndarray:
    """A block's bits, in the order of its sorted names."""
    out = np.zeros(int(bounds[-1]), bool)
    at = {int(r): k for k, r in enumerate(ranges)}
    for x in answers or []:
        a, b = bounds[at[x["range"]]], bounds[at[x["range"]] + 1]
        out[a:b] = np.unpackbits(np.frombuffer(x["bits"], np.uint8), count=int(b - a)).astype(bool)
    return out


OPEN = "block long, ranks array<long>, classes array<binary>, ends binary, starts binary, entry binary, least binary, ranges array<long>, firsts array<binary>, seconds array<binary>, leasts array<binary>"


def candidates(w: Words, words: np.ndarray, bits: int, answers: list[dict] | None) -> np.ndarray:
    """The first words of a block's windows that may be repeats."""
    symbol, row, start, low, high = parsed(words, w.row)
    names, number = np.unique(symbol, return_inverse=True)
    shared = _said(*_cut(names, bits), answers)
    order = np.argsort(number, kind="stable")
    begin = np.searchsorted(number[order], np.arange(len(names)))
    last = np.append(begin[1:], len(order)) - 1
    shared |= row[order[begin]] != row[order[last]] if len(names) else False
    alone = np.concatenate([[0], np.cumsum(~shared[number])])
    return start[(low >= high) | (alone[np.maximum(high, low)] == alone[low])]


def _windows(bits: int):
    """Blocks with their answers to candidate windows."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = [c.split()[0] for c in OPEN.split(", ")]
        for batch in batches:
            for k in range(batch.num_rows):
                w = words_of(batch.column("texts")[k].values, lower=False)
                words = w.hashes()
                ranks = np.array(batch.column("ranks")[k].as_py(), np.int64)
                start = candidates(w, words, bits, batch.column("answers")[k].as_py())
                other = second_hashes(w)
                first, second = np.zeros(len(start), np.uint64), np.zeros(len(start), np.uint64)
                for j in range(WINDOW):
                    first += words[start + j] * _LANE[j]
                    second += other[start + j] * _LANE[j]
                first, second = mix(first), mix(second)
                order = np.lexsort((second, first))
                a, b = first[order], second[order]
                new = np.ones(len(a), bool)
                new[1:] = (a[1:] != a[:-1]) | (b[1:] != b[:-1])
                entry = np.zeros(len(a), np.int32)
                entry[order] = np.cumsum(new) - 1
                a, b = a[new], b[new]
                least = np.full(len(a), LAST, np.int64)
                np.minimum.at(least, entry, ranks[w.row[start]])
                ranges, bounds = _cut(a, bits)
                values = [batch.column("block")[k].as_py(), ranks.tolist(), batch.column("classes")[k].as_py(), w.first[1:].astype("<i4").tobytes(), start.astype("<i4").tobytes(), entry.astype("<i4").tobytes(), least.astype("<i8").tobytes(), ranges.tolist(), *[_blobs(x, bounds) for x in (a, b, least)]]
                yield pa.RecordBatch.from_arrays([pa.array([v], t) for v, t in zip(values, (pa.int64(), _LIST(pa.int64()), _LIST(pa.binary()), pa.binary(), pa.binary(), pa.binary(), pa.binary(), _LIST(pa.int64()), _LIST(pa.binary()), _LIST(pa.binary()), _LIST(pa.binary())))], names=names)

    return run


SPANS = "rank long, cls binary, starts array<int>, sizes array<int>"


def _spans(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Answered windows to the spans of words that go, per document that has some."""
    for batch in batches:
        for k in range(batch.num_rows):
            get = lambda c, kind: np.frombuffer(batch.column(c)[k].as_py(), kind)  # noqa: B023, E731
            ends, start, entry, least = get("ends", "<i4"), get("starts", "<i4").astype(np.int64), get("entry", "<i4"), get("least", "<i8")
            ranges = np.array(batch.column("ranges")[k].as_py(), np.int64)
            bounds = np.cumsum([0, *[len(x) // 8 for x in batch.column("firsts")[k].as_py()]])
            ranks = np.array(batch.column("ranks")[k].as_py(), np.int64)
            row = np.searchsorted(ends, start, side="right")
            goes = start[_said(ranges, bounds, batch.column("answers")[k].as_py())[entry] | (least[entry] < ranks[row])]
            n = int(ends[-1]) if len(ends) else 0
            change = np.zeros(n + 1, np.int64)
            np.add.at(change, goes, 1)
            np.add.at(change, goes + WINDOW, -1)
            gone = np.cumsum(change)[:n] > 0
            edge = np.zeros(n + 1, bool)  # spans end with their document
            edge[ends] = True
            edge[0] = True
            begin = np.flatnonzero(gone & (edge[:n] | ~np.concatenate([[False], gone[:-1]])))
            end = np.flatnonzero(gone & (edge[1:] | ~np.concatenate([gone[1:], [False]]))) + 1
            of = np.searchsorted(ends, begin, side="right")
            docs, first = np.unique(of, return_index=True)
            base = np.concatenate([[0], ends])[of]
            lists = [np.split(x.astype(np.int32), first[1:]) if len(docs) else [] for x in (begin - base, end - begin)]
            classes = batch.column("classes")[k].as_py()
            yield pa.RecordBatch.from_arrays([pa.array(ranks[docs], pa.int64()), pa.array([classes[d] for d in docs.tolist()], pa.binary()), *[pa.array([x.tolist() for x in y], _LIST(pa.int32())) for y in lists]], names=["rank", "cls", "starts", "sizes"])


def _by_size(df: DataFrame, n_bytes: Column) -> DataFrame:
    """``df``, broadcast if its counted bytes are within ANSWER_BYTES."""
    total = df.agg(F.coalesce(F.sum(n_bytes), F.lit(0)).alias("n")).first()["n"]
    return F.broadcast(df) if total <= ANSWER_BYTES else df


def _answered(rows: DataFrame, answers: DataFrame, path: str) -> DataFrame:
    """``rows`` with the answers to their blocks."""
    held = _packed(answers.groupBy("block").agg(F.collect_list(F.struct("range", "bits")).alias("answers")), path)
    size = F.aggregate("answers", F.lit(64).cast("long"), lambda s, a: s + 48 + F.octet_length(a["bits"]))  # as a row in memory has them
    return rows.join(_by_size(held, size), "block", "left")


def _packed(df: DataFrame, path: str) -> DataFrame:
    """``df``, written and read again, of rows that are large."""
    df.write.options(compression="zstd", **ROW_GROUPS).parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def _keyed(docs: DataFrame, *more: Column) -> DataFrame:
    """(rank, version, text) and more: rows are known by id and text."""
    text = F.coalesce("text", F.lit(""))
    return docs.select(F.coalesce(F.col("doc_id").cast("long"), F.lit(LAST)).alias("rank"), F.xxhash64(text).alias("version"), text.alias("text"), *more)


def repeat_spans(docs: DataFrame, folder: str | None = None) -> DataFrame:
    """(rank, version, starts, sizes): the spans of words that go, of each row of ``docs`` that has some.

    Words are runs outside [\\x20\\x09-\\x0D] as they are.  ``rank`` is the doc_id;
    rows without one come after all others, and are no smaller than each other, as
    are rows that repeat an id.  Null and empty texts have no words; texts of fewer
    than WINDOW words no window.  An empty table has no spans.  Further columns are
    not read.  One text is held whole by a task.
    """
    spark: SparkSession = docs.sparkSession
    folder = folder or work_dir(spark, "repeats")
    keyed = _keyed(docs)
    signed = saved(mapped(keyed, _sign, SIGNED), f"{folder}/signed")
    worded = signed.where(F.col("n_words") >= WINDOW)
    # of rows with the same words the smallest rank is searched; what ranks higher goes whole
    same = worded.groupBy("cls").agg(F.min(F.struct("rank", "version")).alias("first"), F.count("*").alias("rows"))
    same = saved(same.where("rows > 1").select(F.col("cls").alias("c"), "first"), f"{folder}/same")
    n_same = same.count()
    twins = worded.join(sized(same, n_same), F.col("cls") == F.col("c"))
    higher = F.col("rank") > F.col("first.rank")
    copies = saved(twins.where(higher | (F.col("version") != F.col("first.version"))).select("rank", "version", "n_words", higher.alias("whole")).distinct(), f"{folder}/copies")
    n_words = worded.agg(F.coalesce(F.sum("n_words"), F.lit(0)).alias("n")).first()["n"]
    bits = max(LEAST_RANGES, n_words * 2 // 5 // RANGE_NAMES).bit_length()

    short = signed.where(F.col("n_words") < WINDOW).select("rank", "version")
    out = saved(copies.select("rank", "version").union(short).distinct().select(F.col("rank").alias("r"), F.col("version").alias("v")), f"{folder}/out")
    searched = keyed.join(sized(out, out.count()), (F.col("rank") == F.col("r")) & (F.col("version") == F.col("v")), "left_anti")
    blocks = _packed(mapped(searched, _listed(bits), BLOCKS), f"{folder}/blocks")
    by_range = blocks.select("block", F.explode(F.arrays_zip("ranges", "names")).alias("x")).select("block", F.col("x.ranges").alias("range"), F.col("x.names").alias("names"))
    shared = by_range.groupBy("range").applyInArrow(_shared, "block long, range long, bits binary")
    texts = _answered(blocks.select("block", "ranks", "classes", "texts"), shared, f"{folder}/shared")
    found = _packed(mapped(texts, _windows(bits), OPEN), f"{folder}/windows")
    zipped = found.select("block", F.explode(F.arrays_zip("ranges", "firsts", "seconds", "leasts")).alias("x"))
    by_range = zipped.select("block", F.col("x.ranges").alias("range"), F.col("x.firsts").alias("first"), F.col("x.seconds").alias("second"), F.col("x.leasts").alias("least"))
    least = by_range.groupBy("range").applyInArrow(_least, "block long, range long, bits binary")
    answered = _answered(found.select("block", "ranks", "classes", "ends", "starts", "entry", "least", "ranges", "firsts"), least, f"{folder}/least")
    spans = saved(mapped(answered, _spans, SPANS), f"{folder}/spans")
    # rows that share id and words share spans, whatever stands between their words
    spans = spans.dropDuplicates(["rank", "cls"]).select(F.col("rank").alias("r"), F.col("cls").alias("c"), "starts", "sizes")
    parts = signed.join(_by_size(spans, F.size("starts").cast("long") * 8 + 64), (F.col("rank") == F.col("r")) & (F.col("cls") == F.col("c"))).select("rank", "version", "starts", "sizes")
    whole = copies.where("whole").select("rank", "version", F.array(F.lit(0)).alias("starts"), F.array(F.col("n_words").cast("int")).alias("sizes"))
    return saved(parts.unionByName(whole).dropDuplicates(["rank", "version"]), f"{folder}/result")


def _keep(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for p in pieces(batches, "text"):
        w = words_of(p.column("text"), lower=False)
        starts, sizes = p.column("starts").fill_null([]), p.column("sizes").fill_null([])
        row = np.repeat(np.arange(p.num_rows), starts.value_lengths().to_numpy())
        at = w.first[row] + starts.flatten().to_numpy()
        change = np.zeros(len(w.start) + 1, np.int64)
        np.add.at(change, at, 1)
        np.add.at(change, at + sizes.flatten().to_numpy(), -1)
        kept = np.cumsum(change)[:-1] == 0
        data, offsets = joined(w, kept)
        left = pa.LargeStringArray.from_buffers(len(offsets) - 1, pa.py_buffer(np.ascontiguousarray(offsets, np.int64)), pa.py_buffer(data)).cast(pa.string())
        removed = np.bincount(w.row[~kept], minlength=p.num_rows)
        yield pa.RecordBatch.from_arrays([p.column("doc_id"), left, pa.array(w.counts, pa.int64()), pa.array(removed, pa.int64())], names=["doc_id", "kept_text", "n_words", "n_removed"])


def without_repeats(docs: DataFrame, folder: str | None = None) -> DataFrame:
    """Per row of ``docs`` (doc_id, text): kept_text (its words that stay, joined by one space), n_words, n_removed.

    See :func:`repeat_spans` for what goes and for odd rows.
    """
    spans = repeat_spans(docs, folder)
    spans = _by_size(spans, F.size("starts").cast("long") * 8 + 64)
    rows = _keyed(docs, F.col("doc_id").cast("long").alias("doc_id")).join(spans, ["rank", "version"], "left")
    return mapped(rows.select("doc_id", "text", "starts", "sizes"), _keep, "doc_id long, kept_text string, n_words long, n_removed long")


def op13_recompression(spark: SparkSession, sf_dir: str) -> DataFrame:
    kept = without_repeats(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    return kept.select("doc_id", "n_words", "n_removed", F.sha2("kept_text", 256).alias("kept_sha256"))


OP13_SQL = """
WITH w AS MATERIALIZED (SELECT doc_id, list_filter(regexp_split_to_array(coalesce(text, ''), '[\\x20\\x09-\\x0D]+'), lambda x: x <> '') AS ws FROM documents),
g AS MATERIALIZED (SELECT doc_id, i, array_to_string(ws[i:i + 12], ' ') AS s FROM (SELECT doc_id, ws, unnest(range(1, len(ws) - 11)) AS i FROM w)),
m AS (SELECT s, min(doc_id) AS least FROM g GROUP BY s),
h AS MATERIALIZED (SELECT DISTINCT doc_id, i + j AS k FROM g JOIN m USING (s), range(13) AS r(j) WHERE least < doc_id),
o AS (SELECT doc_id, list(k) AS ks FROM h GROUP BY doc_id),
e AS (SELECT doc_id, unnest(ws) AS word, unnest(range(1, len(ws) + 1)) AS k FROM w),
t AS (SELECT e.doc_id, string_agg(word, ' ' ORDER BY e.k) AS kept FROM e LEFT JOIN h ON h.doc_id = e.doc_id AND h.k = e.k WHERE h.k IS NULL GROUP BY e.doc_id)
SELECT w.doc_id, len(ws)::BIGINT AS n_words, coalesce(len(ks), 0)::BIGINT AS n_removed, sha256(coalesce(kept, '')) AS kept_sha256
FROM w LEFT JOIN o USING (doc_id) LEFT JOIN t USING (doc_id)
"""
