"""Alignment of the tokens of two tokenizers.

Every text is encoded by a byte-level tokenizer (A) and a sentencepiece model (B);
where tokens of both end at one byte, a group ends, and the two tokens are linked.
A pair of ids is one packed 64-bit key, B's id in the high half, so that the keys
of one B id stand together when sorted.

Texts are cut where neither tokenizer can join what stands on both sides: A's
pattern cuts between ASCII letters, digits, other symbols and before white space;
B cannot join two characters that stand side by side in none of its pieces.  A
distinct cut is encoded and aligned once per worker.

1. One scan aligns the texts.  A block of documents holds its links as codes into
   its sorted distinct keys, and how often each is used.
2. Partial counts: keys and uses of a task's blocks are summed with np.unique.
   They are range-partitioned by B id, sorted by key, and equal neighbours summed.
3. Each range writes shards: sorted keys, counts, and the highest count of each
   key's B id, one array after the other.  The list of shards names them; it has
   about a row per SHARD_KEYS keys, and a vocabulary has no more keys than ids of A
   times ids of B, so the list is bounded whatever the corpus is.
4. Blocks look their keys up by searchsorted in memory-mapped shards.
"""

from __future__ import annotations

import hashlib
import os
import tempfile
from collections.abc import Iterator
from itertools import islice

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import pyarrow.fs
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import mapped, saved, work_dir
from .textkernel import HashIndex, gather, give_back, numbered, pieces, span_hashes, text_bytes

#: Bytes of texts in a block; cuts, and bytes of their groups, that a worker remembers
BLOCK_BYTES, CACHE_CUTS, CACHE_BYTES = 1 << 19, 400_000, 32 << 20
#: Cuts that go to the libraries at once
ENCODED = 2048
#: Keys summed at once in a task, and about how many a shard holds
PARTIAL_KEYS, SHARD_KEYS = 1 << 21, 1 << 20
SPACE_MARK = "▁"
#: The byte-level alphabet writes printable Latin-1 for itself, other bytes from U+0100 on
PRINTABLE = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]

_LETTER, _DIGIT, _SYMBOL, _BLANK, _NONE = 1, 2, 3, 4, 0
_KIND = np.full(256, _NONE, np.uint8)
_KIND[0x21:0x7F] = _SYMBOL
_KIND[[*range(65, 91), *range(97, 123)]] = _LETTER
_KIND[48:58] = _DIGIT
_KIND[[0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D]] = _BLANK
_KIND[ord("'")] = _NONE  # may start a contraction


def byte_decoder() -> dict[str, int]:
    """The byte that each character of the byte-level alphabet stands for."""
    rest = [b for b in range(256) if b not in set(PRINTABLE)]
    return {chr(b): b for b in PRINTABLE} | {chr(0x100 + k): b for k, b in enumerate(rest)}


class Aligner:
    """Both tokenizers, and the alignment of cuts that were met before."""

    def __init__(self, byte_level: str, sentence_piece: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        import sentencepiece
        from tokenizers import Tokenizer

        self.a = Tokenizer.from_file(byte_level)
        self.a.encode_special_tokens = True
        self.b = sentencepiece.SentencePieceProcessor(model_file=sentence_piece)
        decode = byte_decoder()
        self.a_bytes = {i: bytes(decode[c] for c in s) if all(c in decode for c in s) else s.encode() for s, i in self.a.get_vocab(with_added_tokens=True).items()}
        self.b_bytes = [self._piece(i) for i in range(self.b.get_piece_size())]
        self.a_size = np.array([len(self.a_bytes.get(i, b"")) for i in range(max(self.a_bytes) + 1)], np.int64)
        self.b_size = np.array([len(x) for x in self.b_bytes], np.int64)
        self._learn_joins()
        self.clear()

    def _piece(self, i: int) -> bytes:
        s = self.b.id_to_piece(i)
        return bytes([int(s[3:5], 16)]) if self.b.is_byte(i) else s.replace(SPACE_MARK, " ").encode()

    def _learn_joins(self) -> None:
        """Which ASCII characters stand side by side in a piece, and whether a space follows any other."""
        self.joins = np.zeros((128, 128), bool)
        self.space_inside = self.line_feed = False
        for i in range(self.b.get_piece_size()):
            if self.b.is_control(i) or self.b.is_unknown(i) or self.b.is_byte(i):
                continue
            s = self.b.id_to_piece(i).replace(SPACE_MARK, " ")
            self.line_feed |= "\n" in s
            for x, y in zip(s, s[1:]):
                if x < "\x80" and y < "\x80":
                    self.joins[ord(x), ord(y)] = True
                self.space_inside |= y == " " and x != " "

    def clear(self) -> None:
        self.known, self.held = HashIndex(), 0
        self.n_a, self.n_b, self.n_links = (np.zeros(1 << 16, np.int32) for _ in range(3))
        self.first, self.fits = np.zeros(1 << 16, np.int64), np.zeros(1 << 16, bool)
        self.links, self.used = np.zeros(1 << 18, np.int64), 0
        self.groups: list[bytes] = []

    def cuts(self, data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Start and end of the cuts of rows, none across rows."""
        n = len(data)
        if not n:
            return np.zeros(0, np.int64), np.zeros(0, np.int64)
        cut = np.zeros(n + 1, bool)
        if not self.line_feed:
            left, right = data[:-1], data[1:]
            kl, kr = _KIND[left], _KIND[right]
            plain = (kl != _NONE) & (kl != _BLANK) & (kr != _NONE) & (kl != kr)
            at = np.flatnonzero(plain)
            cut[at[~self.joins[left[at], right[at]]] + 1] = True
            if not self.space_inside:
                # the last byte of a character that is surely no white space, then a space
                at = np.flatnonzero((left >= 0x80) & (right == 0x20))
                two, three = data[at - 1], data[at - 2]
                letter = (at >= 1) & (two >= 0xC3) & (two <= 0xDF) | (at >= 2) & ((three == 0xE0) | (three >= 0xE4) & (three <= 0xEF))
                cut[at[letter] + 1] = True
        cut[offsets] = True
        bound = np.flatnonzero(cut)
        return bound[:-1], bound[1:]

    def _learn(self, keys: np.ndarray, cuts: list[bytes]) -> None:
        texts = [c.decode("utf-8", "replace") for c in cuts]
        a_ids, b_ids = [], []
        for k in range(0, len(texts), ENCODED):  # what the library holds for a text is much larger than its ids
            part = texts[k : k + ENCODED]
            a_ids += [e.ids for e in self.a.encode_batch(part, add_special_tokens=False)]
            # B puts a space before a text; nothing joins a line feed, so what follows it stands as in the middle of a text
            b_ids += [x[2:] for x in self.b.encode(["\n" + t for t in part], num_threads=1)] if not self.line_feed else [self.b.encode(t[1:]) for t in part]
        n_a, n_b = np.array([len(x) for x in a_ids], np.int64), np.array([len(x) for x in b_ids], np.int64)
        a, b = (np.array([i for x in ids for i in x], np.int64) for ids in (a_ids, b_ids))
        size = np.array([len(c) for c in cuts], np.int64)
        fits = [b"".join(map(self.a_bytes.__getitem__, x)) == c and b"".join(map(self.b_bytes.__getitem__, y)) == c for x, y, c in zip(a_ids, b_ids, cuts)]
        # ends of both, in one line of all cuts that fit
        fit = np.array(fits, bool)
        base = np.cumsum(np.where(fit, size, 0)) - np.where(fit, size, 0)
        live_a, live_b = np.repeat(fit, n_a), np.repeat(fit, n_b)
        a, b = a[live_a], b[live_b]
        ends_a, ends_b = np.cumsum(self.a_size[a]), np.cumsum(self.b_size[b])
        common, at_a, at_b = np.intersect1d(ends_a, ends_b, assume_unique=True, return_indices=True)
        link = b[at_b] << 32 | a[at_a]
        of = np.searchsorted(base[fit], common - 1, side="right") - 1 if fit.any() else np.zeros(0, np.int64)
        per = np.zeros(len(cuts), np.int64)
        per[fit] = np.bincount(of, minlength=int(fit.sum()))
        # the ids of each group, in decimals
        text_a, text_b = iter(map(str, a.tolist())), iter(map(str, b.tolist()))
        size_a, size_b = np.diff(at_a, prepend=-1).tolist(), np.diff(at_b, prepend=-1).tolist()
        groups = iter([",".join(islice(text_a, x)) + "|" + ",".join(islice(text_b, y)) for x, y in zip(size_a, size_b)])
        new = [";".join(islice(groups, k)).encode() for k in per.tolist()]
        n = self.known.count
        while len(self.first) < n + len(cuts):
            self.n_a, self.n_b, self.n_links, self.first, self.fits = (np.concatenate([x, np.zeros_like(x)]) for x in (self.n_a, self.n_b, self.n_links, self.first, self.fits))
        while len(self.links) < self.used + len(link):
            self.links = np.concatenate([self.links, np.zeros_like(self.links)])
        to = slice(n, n + len(cuts))
        self.n_a[to], self.n_b[to], self.n_links[to], self.fits[to] = n_a, n_b, per, fit
        self.first[to] = self.used + np.cumsum(per) - per
        self.links[self.used : self.used + len(link)] = link
        self.used += len(link)
        self.groups += new
        self.held += sum(map(len, new))
        self.known.add(keys, np.arange(n, n + len(cuts), dtype=np.int32))

    def align(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, list[bytes]]:
        """Tokens of A and B and links of each row, all links in order, and each row's groups.

        A row that is null or empty, or that a tokenizer does not give back byte by byte, has none.
        """
        if isinstance(texts, pa.ChunkedArray):
            texts = texts.combine_chunks()
        texts = pc.fill_null(texts.cast(pa.large_string()), "")
        full = pc.not_equal(texts, "")
        texts = pc.if_else(full, pc.binary_join_element_wise(pa.scalar(" ", pa.large_string()), texts, pa.scalar("", pa.large_string())), texts)
        data, offsets = text_bytes(texts)
        start, end = self.cuts(data, offsets)
        codes, distinct = numbered(span_hashes(data, start, end))
        if self.known.count + len(distinct) > CACHE_CUTS or self.held > CACHE_BYTES:
            self.clear()
        at = self.known.find(distinct).astype(np.int64)
        if len(new := np.flatnonzero(at < 0)):
            first = np.zeros(len(distinct), np.int64)
            first[codes[::-1]] = np.arange(len(codes))[::-1]
            first = first[new]
            raw = data.tobytes()
            at[new] = np.arange(self.known.count, self.known.count + len(new))
            self._learn(distinct[new], [raw[a:b] for a, b in zip(start[first].tolist(), end[first].tolist())])
            del raw, first
            give_back()  # what the libraries held for the new cuts
        which = at[codes] if len(codes) else np.zeros(0, np.int64)
        bounds = np.searchsorted(start, offsets)
        n = len(offsets) - 1
        row = np.repeat(np.arange(n), np.diff(bounds))
        bad = np.bincount(row[~self.fits[which]], minlength=n) > 0
        live = ~bad[row]
        row, which = row[live], which[live]
        count = [np.bincount(row, x[which], n).astype(np.int64) for x in (self.n_a, self.n_b, self.n_links)]
        links = gather(self.links, self.first, self.n_links, which) if len(which) else np.zeros(0, np.int64)
        each, groups, at = self.groups.__getitem__, [], 0
        which = which.tolist()
        for size in np.bincount(row, minlength=n).tolist():
            groups.append(b";".join(map(each, which[at : at + size])))
            at += size
        return *count, links, groups


_loaded: dict[tuple[str, str], Aligner] = {}


def _aligner(byte_level: str, sentence_piece: str) -> Aligner:
    if (byte_level, sentence_piece) not in _loaded:
        _loaded.clear()
        _loaded[byte_level, sentence_piece] = Aligner(byte_level, sentence_piece)
    return _loaded[byte_level, sentence_piece]


def _forget() -> None:
    """A worker that aligned would keep its tokenizers and cuts beside the counts."""
    _loaded.clear()
    give_back()


BLOCKS = "doc_ids array<long>, n_a array<long>, n_b array<long>, n_links array<long>, shas array<string>, codes binary, keys binary, uses binary"


def _blocks(byte_level: str, sentence_piece: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        aligner = _aligner(byte_level, sentence_piece)
        for p in pieces(batches, "text", BLOCK_BYTES):
            n_a, n_b, n_links, links, groups = aligner.align(p.column("text"))
            codes, keys = numbered(links)
            order = np.argsort(keys)
            place = np.empty(len(keys), np.uint32)
            place[order] = np.arange(len(keys), dtype=np.uint32)
            codes, keys = place[codes], keys[order]
            shas = [hashlib.sha256(g).hexdigest() if a else "" for g, a in zip(groups, n_a.tolist())]
            lists = [p.column("doc_id").to_pylist(), n_a.tolist(), n_b.tolist(), n_links.tolist()]
            blobs = [codes.astype("<u4").tobytes(), keys.astype("<i8").tobytes(), np.bincount(codes, minlength=len(keys)).astype("<i8").tobytes()]
            yield pa.RecordBatch.from_arrays([*[pa.array([x], pa.list_(pa.int64())) for x in lists], pa.array([shas], pa.list_(pa.string())), *[pa.array([x], pa.binary()) for x in blobs]], names=[c.split()[0] for c in BLOCKS.split(", ")])

    return run


def aligned_groups(docs: DataFrame, byte_level: str, sentence_piece: str) -> DataFrame:
    """Per row of ``docs``: doc_id, n_a, n_b, and its groups as text: ``a1,a2|b1;a3|b2,b3``, ids of A and B in order."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        aligner = _aligner(byte_level, sentence_piece)
        for p in pieces(batches, "text", BLOCK_BYTES):
            n_a, n_b, _, _, groups = aligner.align(p.column("text"))
            yield pa.RecordBatch.from_arrays([p.column("doc_id"), pa.array(n_a), pa.array(n_b), pa.array([g.decode() for g in groups])], names=["doc_id", "n_a", "n_b", "groups"])

    return mapped(docs.select(F.col("doc_id").cast("long"), "text"), run, "doc_id long, n_a long, n_b long, groups string")


def _summed(keys: list[np.ndarray], uses: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    key, at = np.unique(np.concatenate(keys), return_inverse=True)
    total = np.zeros(len(key), np.int64)
    np.add.at(total, at, np.concatenate(uses))
    return key, total


def _partial(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Counts of a task's blocks, summed each time PARTIAL_KEYS are held."""
    _forget()
    keys, uses, held = [], [], 0

    def table(key: np.ndarray, total: np.ndarray) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array((key >> 32).astype(np.int32)), pa.array(key), pa.array(total)], names=["b_id", "key", "n"])

    for batch in batches:
        for k, u in zip(batch.column("keys").to_pylist(), batch.column("uses").to_pylist()):
            keys.append(np.frombuffer(k, "<i8"))
            uses.append(np.frombuffer(u, "<i8"))
            held += len(keys[-1])
        if held >= PARTIAL_KEYS:
            one = _summed(keys, uses)
            keys, uses, held = [one[0]], [one[1]], len(one[0])
            if held >= PARTIAL_KEYS // 2:
                yield table(*one)
                keys, uses, held = [], [], 0
    if held:
        yield table(*_summed(keys, uses))
    give_back()


def _shard_writer(folder: str):
    """Sorted (b_id, key, n) rows to shard files; a row per file of where it is and what it holds."""

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        task = TaskContext.get()
        store, root = pyarrow.fs.FileSystem.from_uri(folder)
        keys, totals, held, seq = [], [], 0, 0

        def put(key: np.ndarray, total: np.ndarray) -> pa.RecordBatch:
            nonlocal seq
            name = f"{task.partitionId()}-{seq}-{task.taskAttemptId()}"  # only what a finished attempt wrote is listed
            seq += 1
            b = key >> 32
            begin = np.flatnonzero(np.diff(b, prepend=-1))
            best = np.maximum.reduceat(total, begin)[np.cumsum(np.diff(b, prepend=-1) != 0) - 1]
            with store.open_output_stream(f"{root}/{name}") as out:
                for x in (key, total, best):
                    out.write(x.astype("<i8").tobytes())
            return pa.RecordBatch.from_arrays([pa.array([v], t) for v, t in ((name, pa.string()), (int(key[0]), pa.int64()), (int(key[-1]), pa.int64()), (len(key), pa.int64()))], names=["name", "low", "high", "n"])

        for batch in batches:
            keys.append(batch.column("key").to_numpy())
            totals.append(batch.column("n").to_numpy())
            held += batch.num_rows
            if held >= SHARD_KEYS:
                key, total = _runs(np.concatenate(keys), np.concatenate(totals))
                cut = int(np.searchsorted(key, key[-1] >> 32 << 32))  # an id of B stays in one shard
                if cut >= SHARD_KEYS // 2:
                    yield put(key[:cut], total[:cut])
                    key, total = key[cut:], total[cut:]
                keys, totals, held = [key], [total], len(key)
        if held:
            yield put(*_runs(np.concatenate(keys), np.concatenate(totals)))
        give_back()

    return write


def _runs(key: np.ndarray, n: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Sorted keys with their neighbours summed."""
    begin = np.flatnonzero(np.diff(key, prepend=-1))
    return key[begin], np.add.reduceat(n, begin)


def count_shards(blocks: DataFrame, folder: str) -> DataFrame:
    """The written shards of pair counts: name (a file below ``folder``), low and high key, n keys."""
    spark = blocks.sparkSession
    path = spark._jvm.org.apache.hadoop.fs.Path(f"{folder}/shards")
    path.getFileSystem(spark._jsc.hadoopConfiguration()).mkdirs(path)
    partial = saved(mapped(blocks.select("keys", "uses"), _partial, "b_id int, key long, n long"), f"{folder}/partial")
    ranged = partial.repartitionByRange("b_id").sortWithinPartitions("key")
    return saved(mapped(ranged, _shard_writer(f"{folder}/shards"), "name string, low long, high long, n long"), f"{folder}/list")


class Shards:
    """Pair counts looked up in memory-mapped files.

    A file of a store that is not mounted is copied to the task's temporary folder
    first, and unlinked as soon as it is mapped.
    """

    def __init__(self, folder: str, listed: list[tuple[str, int, int, int]]):
        self.folder, self.listed = folder, sorted(listed, key=lambda x: x[1])
        self.low = np.array([x[1] for x in self.listed], np.int64)
        self.open: dict[int, np.ndarray] = {}

    def _mapped(self, k: int) -> np.ndarray:
        if k not in self.open:
            store, root = pyarrow.fs.FileSystem.from_uri(self.folder)
            name, _, _, n = self.listed[k]
            if isinstance(store, pyarrow.fs.LocalFileSystem):
                buffer = pa.memory_map(f"{root}/{name}").read_buffer()
            else:
                with tempfile.NamedTemporaryFile() as copy, store.open_input_stream(f"{root}/{name}") as source:
                    while part := source.read(1 << 22):
                        copy.write(part)
                    copy.flush()
                    buffer = pa.memory_map(copy.name).read_buffer()
            self.open[k] = np.frombuffer(buffer, "<i8").reshape(3, n)
        return self.open[k]

    def find(self, keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The counts of sorted keys, all of which are there, and the highest counts of their B ids."""
        count, best = np.zeros(len(keys), np.int64), np.zeros(len(keys), np.int64)
        of = np.searchsorted(self.low, keys, side="right") - 1
        for k in np.unique(of).tolist():
            mine = of == k
            shard = self._mapped(k)
            at = np.searchsorted(shard[0], keys[mine])
            count[mine], best[mine] = shard[1][at], shard[2][at]
        return count, best


RESULT = "doc_id long, n_a long, n_b long, n_groups long, n_links long, n_best long, count_sum long, groups_sha256 string"


def alignment(docs: DataFrame, byte_level: str, sentence_piece: str, folder: str | None = None) -> DataFrame:
    """Per row of ``docs`` (doc_id, text): tokens of A and B, groups, links, those whose
    count is their B id's highest (ties too), the sum of the links' counts, the groups' digest.

    Null and empty texts, and texts that either tokenizer does not give back byte by
    byte, have no tokens: zeros and an empty digest.  Rows that repeat an id are each
    aligned and counted.  An empty table gives an empty one; further columns are not
    read.  One text is held whole by a task.
    """
    spark: SparkSession = docs.sparkSession
    folder = folder or work_dir(spark, "alignment")
    blocks = saved(mapped(docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text"), _blocks(byte_level, sentence_piece), BLOCKS), f"{folder}/blocks")
    listed = [tuple(r) for r in count_shards(blocks, folder).select("name", "low", "high", "n").collect()]  # bounded by the vocabularies
    where = f"{folder}/shards"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        _forget()
        shards = Shards(where, listed)
        for batch in batches:
            for k in range(batch.num_rows):
                value = lambda c: batch.column(c)[k].as_py()  # noqa: B023, E731
                codes = np.frombuffer(value("codes"), "<u4")
                count, best = shards.find(np.frombuffer(value("keys"), "<i8"))
                n_links = np.array(value("n_links"), np.int64)
                ends = np.cumsum(n_links)
                sums = [np.concatenate([[0], np.cumsum(x[codes], dtype=np.int64)]) for x in (count == best, count)]
                n_best, total = (s[ends] - s[ends - n_links] for s in sums)
                columns = [pa.array(value(c), pa.int64()) for c in ("doc_ids", "n_a", "n_b")]
                yield pa.RecordBatch.from_arrays([*columns, pa.array(n_links), pa.array(n_links), pa.array(n_best), pa.array(total), pa.array(value("shas"), pa.string())], names=[c.split()[0] for c in RESULT.split(", ")])

    return mapped(blocks.select("doc_ids", "n_a", "n_b", "n_links", "shas", "codes", "keys"), run, RESULT)


def default_tokenizers() -> tuple[str, str]:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model")


def op11_token_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    return alignment(spark.read.parquet(f"{sf_dir}/documents.parquet"), *default_tokenizers())
