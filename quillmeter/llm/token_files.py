"""Token ids in Re-Pair compressed shard files.

Encoding.  Texts are cut, on their bytes, into pre-token pieces at places where
the tokenizer's own pattern must cut (white space; between ASCII letters,
digits and symbols), and each distinct piece is encoded once per worker by the
tokenizers library.  Rows with a special token's opening string and pieces with
any other character go to the library uncut, the rows in their own case, so ids equal
those of the whole text.

Format.  A row of the Parquet files is a shard of consecutive documents, with a
grammar of its own: ``part, seq, n_docs, n_tokens, block``.  A block holds, little
endian: magic; int64 numbers of documents, rules, symbols and terminals, bits of a
symbol, bytes of a length; the terminals (the ids in use, ascending, int32); rules
(left, right) and symbols, packed to that many bits; the expansion length of each
rule; tokens and symbols of each document, int32; doc_ids, int64, with a validity
byte each.  Symbols from the number of terminals on are nonterminals.
Re-Pair: in rounds, pairs of neighbouring symbols become nonterminals, the more
frequent of overlapping ones first, until no pair is there twice.  The end id stays
out of pairs, so a document's symbols are its own; expansion lengths find any token
span without expanding what lies before it.

Documents are range-partitioned and sorted by doc_id; parts and blocks are in
ascending order.
"""

from __future__ import annotations

import os
import zlib
from codecs import charmap_decode
from collections.abc import Iterator
from itertools import chain
from operator import attrgetter

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import mapped, saved, work_dir
from .textkernel import LOWER, SPACE, HashIndex, give_back, numbered, pieces, span_hashes, text_bytes

END_ID = 2
END, FIRST_RULE = 1 << 19, 1 << 20  # how a block holds the end id; its first nonterminal
BLOCK_TOKENS, LEAST_USES, DENSE_ROUNDS = 2_000_000, 2, 3
PLACE_BITS, SYMBOL_BITS = 22, 21  # of a sorted number that holds a pair and a place
STEP = 1 << 17  # positions that are worked on at once, so that temporary arrays stay small
READ_TOKENS = 1 << 18  # tokens that are expanded at once when a block is read
CACHE_PIECES, ENCODED_BYTES = 1_500_000, 1 << 17
MAGIC = b"QMRP0002"

_LETTER, _DIGIT, _SYMBOL, _OTHER, _BLANK = 1, 2, 3, 4, 0
_CLASS = np.full(256, _SYMBOL, np.uint8)
_CLASS[128:] = _OTHER
_CLASS[ord("'")] = _OTHER
_CLASS[:32] = _OTHER
_CLASS[127] = _OTHER
_CLASS[[*range(65, 91), *range(97, 123)]] = _LETTER
_CLASS[48:58] = _DIGIT
_CLASS[SPACE] = _BLANK
_CLASS[[0x0B, 0x0C]] = _OTHER


def _through(table: np.ndarray, data: np.ndarray) -> np.ndarray:
    """table[data] for bytes of both."""
    return np.frombuffer(bytearray(data).translate(table.tobytes()), np.uint8)


def _classes(data: np.ndarray) -> np.ndarray:
    cls = _through(_CLASS, data)
    if len(data) > 1:
        # two-byte letters of the Latin blocks, but for the signs U+00D7 and U+00F7,
        # and U+0130, which lower case takes apart
        lead = (data[:-1] >= 0xC3) & (data[:-1] <= 0xC9)
        lead &= ~((data[:-1] == 0xC3) & ((data[1:] == 0x97) | (data[1:] == 0xB7)))
        lead &= ~((data[:-1] == 0xC4) & (data[1:] == 0xB0))
        at = np.flatnonzero(lead)
        cls[at] = _LETTER
        cls[at + 1] = _LETTER
    return cls


def opened_rows(data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """The rows that hold a special token's opening."""
    opening = np.flatnonzero((data[:-1] == ord("<")) & (data[1:] == ord("|")))
    return np.unique(np.searchsorted(offsets, opening, side="right") - 1)


def piece_spans(data: np.ndarray, offsets: np.ndarray, special: bool = False) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Start, end and row of the pieces of rows, and whether each is of one class.  Rows hold ascending pieces.

    With ``special``, rows that hold a special token's opening stay whole.
    """
    n = len(data)
    if not n:
        none = np.zeros(0, np.int64)
        return none, none, none, none.astype(bool)
    cls = _classes(data)
    left, right = cls[:-1], cls[1:]
    plain = (left < _OTHER) & (right < _OTHER)
    cut = np.ones(n + 1, bool)
    cut[1:-1] = (left == _BLANK) | (right == _BLANK) | (plain & ((left != right) | (left == _DIGIT)))
    cut[offsets] = True
    for r in opened_rows(data, offsets) if special else ():
        cut[offsets[r] + 1 : offsets[r + 1]] = False
        cls[offsets[r] : offsets[r + 1]] = _OTHER
    bound = np.flatnonzero(cut)
    start, end = bound[:-1], bound[1:]
    full = cls[start] != _BLANK
    start, end = start[full], end[full]
    pure = np.ones(len(start), bool)
    pure[np.searchsorted(start, np.flatnonzero(cls == _OTHER), side="right") - 1] = False
    row = np.repeat(np.arange(len(offsets) - 1), np.diff(np.searchsorted(start, offsets)))
    return start, end, row, pure


def _byte_chars() -> str:
    """The characters that a byte-level pre-tokenizer writes for bytes 0 to 255: printable
    Latin-1 for themselves, the others from U+0100 on in order."""
    own = {*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)}
    rest = iter(range(0x100, 0x200))
    return "".join(chr(b if b in own else next(rest)) for b in range(256))


_BYTE_CHARS = _byte_chars()


class Encoder:
    """Piece hashes to ids, by the tokenizers library, remembered up to CACHE_PIECES."""

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.model = self.tokenizer.model
        self.clear()

    def clear(self) -> None:
        self.known = HashIndex()
        self.ids = np.zeros(1 << 16, np.int32)
        self.start, self.size, self.used = np.zeros(1 << 16, np.int32), np.zeros(1 << 16, np.int32), 0

    def _ids(self, pieces: list[bytes], pure: np.ndarray) -> list[list[int]]:
        """Ids of pieces.  One of a single class is one pre-token: it goes to the
        library's model in lower case, bytes as the byte-level characters; the rest
        go through the whole library."""
        found: list[list[int]] = [[]] * len(pieces)
        whole, single = np.flatnonzero(~pure).tolist(), np.flatnonzero(pure).tolist()
        if single:
            # at once, as no piece of a single class holds a line feed
            joined = b"\n".join(map(pieces.__getitem__, single)).decode().lower().encode()
            words = charmap_decode(joined, "strict", _BYTE_CHARS)[0].split(_BYTE_CHARS[10])
            tokenize, ident = self.model.tokenize, attrgetter("id")
            for k, word in zip(single, words):
                found[k] = [*map(ident, tokenize(word))]
        for k, e in zip(whole, self.tokenizer.encode_batch([pieces[k].decode("utf-8", "replace") for k in whole], add_special_tokens=False)):
            found[k] = e.ids
        return found

    def _learn(self, keys: np.ndarray, pieces: list[bytes], pure: np.ndarray) -> None:
        new = self._ids(pieces, pure)
        sizes = np.fromiter(map(len, new), np.int64, len(new))
        n, at = self.known.count, self.used
        while len(self.start) < n + len(new):
            self.start, self.size = (np.concatenate([x, np.zeros(len(x), np.int32)]) for x in (self.start, self.size))
        while len(self.ids) < at + sizes.sum():
            self.ids = np.concatenate([self.ids, np.zeros(len(self.ids), np.int32)])
        self.start[n : n + len(new)] = at + np.cumsum(sizes) - sizes
        self.size[n : n + len(new)] = sizes
        self.ids[at : at + sizes.sum()] = np.fromiter(chain.from_iterable(new), np.int32, int(sizes.sum()))
        self.used += int(sizes.sum())
        self.known.add(keys, np.arange(n, n + len(new), dtype=np.int32))

    def encode(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """All ids of the rows, each followed by END, and the number of each row's."""
        data, offsets = text_bytes(texts)
        raw, data = data, _through(LOWER, data)
        # the library matches special tokens before it lowers case
        for r in opened_rows(raw, offsets):
            data[offsets[r] : offsets[r + 1]] = raw[offsets[r] : offsets[r + 1]]
        start, end, row, pure = piece_spans(data, offsets, special=True)
        codes, distinct = numbered(span_hashes(data, start, end))
        if self.known.count + len(distinct) > CACHE_PIECES:
            self.clear()
        at = self.known.find(distinct)
        if len(new := np.flatnonzero(at < 0)):
            # codes are by first appearance: where one exceeds all before, it is new
            first = np.flatnonzero(np.diff(np.maximum.accumulate(codes), prepend=np.int32(-1)))[new]
            raw = data.tobytes()
            at[new] = np.arange(self.known.count, self.known.count + len(new))
            self._learn(distinct[new], [raw[a:b] for a, b in zip(start[first].tolist(), end[first].tolist())], pure[first])
        which = at[codes]
        size = np.take(self.size, which)
        ends = np.zeros(len(which) + 1, np.int64)
        np.cumsum(size, out=ends[1:])
        per_row = np.diff(ends[np.searchsorted(start, offsets)]).astype(np.int64)
        at = np.repeat(np.take(self.start, which) - ends[:-1], size)
        at += np.arange(len(at), dtype=at.dtype)
        ids = np.take(self.ids, at)
        return np.insert(ids, np.cumsum(per_row), END).astype(np.int32, copy=False) if len(per_row) else ids, per_row + 1


def repair(a: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Symbols, rules (left, right) and each rule's expansion length.

    Rounds go on until no pair is found LEAST_USES times, overlaps aside.  The
    first rounds, which replace much, count all pairs and close the gaps.  Then
    pairs are counted exactly by change: a pair of old symbols never becomes more
    frequent, so its places are counted again only while it repeats, and new
    pairs stand only beside symbols that the last round put in.
    """
    grammar = _Grammar()
    symbol = np.empty(len(a) + 1, np.int32)
    symbol[:-1], symbol[-1] = a, END
    for _ in range(DENSE_ROUNDS):
        if len(symbol) > 1 << PLACE_BITS or len(symbol) < 3 or symbol.max() >= 1 << SYMBOL_BITS:
            break
        first, which = _all_chosen(symbol)
        if not len(first):
            break
        symbol[first] = grammar.add(symbol[first], symbol[first + 1], which)
        stay = np.ones(len(symbol), bool)
        stay[first + 1] = False
        symbol = symbol[stay]
        del first, which, stay
    n = len(symbol) - 1
    after = np.arange(1, n + 2, dtype=np.int32)
    after[n] = n
    before = np.arange(-1, n, dtype=np.int32)
    before[0] = n
    there = np.ones(n, bool)
    nxt, prv = after.__getitem__, before.__getitem__
    at, code, n_codes = np.zeros(0, np.int32), np.zeros(0, np.int32), 0
    fresh = np.arange(n, dtype=np.int32)
    while True:
        fresh = fresh[(symbol[fresh] != END) & (symbol[after[fresh]] != END)]
        more, known, n_known = _repeated(symbol, nxt, fresh)
        at, code = np.concatenate([at, more]), np.concatenate([code, known + np.int32(n_codes)])
        del more, known, fresh
        # codes stay small: those no longer in use go
        used = np.bincount(code, minlength=n_codes + n_known) > 0
        code, n_codes = (np.cumsum(used, dtype=np.int32) - 1)[code], int(used.sum())
        at, code, hit, which = _chosen(symbol, at, code, n_codes, nxt, prv)
        if not len(at):
            break
        first = at[hit]
        second = after[first]
        symbol[first] = grammar.add(symbol[first], symbol[second], which)
        there[second] = False
        after[first] = after[second]
        before[after[first]] = first
        left = before[first]
        new = np.zeros(n + 1, bool)
        new[first] = True
        fresh = np.concatenate([first, left[~new[left]]])
        new[left] = True
        new[second] = True
        stay = ~new[at]
        at, code = at[stay], code[stay]
    return symbol[:n][there], *grammar.tables()


def _all_chosen(symbol: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Of a whole sequence: the places whose pairs a rule replaces, and the rule's number at each."""
    left, right = symbol[:-1], symbol[1:]
    # pair and place in one number: sorted, equal pairs are neighbours
    key, place, mask = np.empty(len(left), np.uint64), np.empty(len(left), np.int32), np.uint64((1 << PLACE_BITS) - 1)
    for a in range(0, len(key), STEP):
        part, here = key[a : a + STEP], slice(a, a + STEP)
        part[:] = left[here]
        part <<= np.uint64(SYMBOL_BITS)
        part |= right[here].view(np.uint32)
        part <<= np.uint64(PLACE_BITS)
        part |= np.arange(a, a + len(part), dtype=np.uint64)
    key.sort()
    for a in range(0, len(key), STEP):
        part = key[a : a + STEP]
        place[a : a + STEP] = part & mask
        part >>= np.uint64(PLACE_BITS)
    edge = np.ones(len(key), bool)
    np.not_equal(key[1:], key[:-1], out=edge[1:])
    begin = np.flatnonzero(edge).astype(np.int32)
    size = np.diff(begin, append=np.int32(len(key))).astype(np.int32)
    many = size > 1
    pairs, uses = key[begin[many]], size[many].astype(np.int64)
    del key, edge, begin
    # of a run of one symbol, every other position from the left is a use
    same = np.flatnonzero(left == right)
    if len(same):
        run = np.ones(len(same), bool)
        run[1:] = same[1:] != same[:-1] + 1
        start = np.maximum.accumulate(np.where(run, np.arange(len(same)), 0))
        same = same[((np.arange(len(same)) - start) & 1) == 1]
        own = (left[same].astype(np.uint64) << np.uint64(SYMBOL_BITS)) | right[same].astype(np.uint64)
        uses -= np.bincount(np.searchsorted(pairs, own), minlength=len(uses))
    # of overlapping pairs the more frequent goes first; the most frequent keeps all its uses
    order = np.empty(len(uses), np.int32)
    by_uses = (uses << 32) | np.arange(len(uses))
    by_uses.sort()
    order[by_uses & np.int64(0xFFFFFFFF)] = np.arange(1, len(uses) + 1, dtype=np.int32)
    end, low = np.uint64(END), np.uint64((1 << SYMBOL_BITS) - 1)
    order[(uses < LEAST_USES) | (pairs >> np.uint64(SYMBOL_BITS) == end) | (pairs & low == end)] = 0
    each = np.zeros(len(size), np.int32)
    each[many] = order
    rank = np.zeros(len(symbol) + 1, np.int32)  # the last two places, and what stands before the first, are no pairs
    rank[place] = np.repeat(each, size)
    rank[same] = 0
    del place, each, size
    hit = rank[:-2] > rank[1:-1]
    hit[1:] &= rank[1:-2] > rank[:-3]
    first = np.flatnonzero(hit).astype(np.int32)
    pair = rank[first]
    good = np.bincount(pair, minlength=len(uses) + 1) >= LEAST_USES
    keep = good[pair]
    return first[keep], (np.cumsum(good, dtype=np.int32) - 1)[pair[keep]]


class _Grammar:
    """Rules in the order in which they came, with their expansion lengths."""

    def __init__(self) -> None:
        self.rules, self.length = [np.zeros((0, 2), np.int32)], np.zeros(0, np.int32)

    def add(self, left: np.ndarray, right: np.ndarray, which: np.ndarray) -> np.ndarray:
        """Rules for the pairs that have the numbers ``which``; the symbols that stand for them."""
        pair = np.empty((int(which.max()) + 1, 2), np.int32)
        pair[which, 0], pair[which, 1] = left, right
        deep = pair >= FIRST_RULE
        part = np.ones(pair.shape, np.int32)
        part[deep] = self.length[pair[deep] - FIRST_RULE]
        begin = FIRST_RULE + len(self.length)
        self.rules.append(pair)
        self.length = np.concatenate([self.length, part.sum(axis=1, dtype=np.int32)])
        return begin + which

    def tables(self) -> tuple[np.ndarray, np.ndarray]:
        return np.concatenate(self.rules), self.length


def _chosen(symbol: np.ndarray, at: np.ndarray, code: np.ndarray, n_codes: int, nxt, prv) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Of places and their pairs' numbers: those of pairs that repeat, which places a
    rule replaces, and the rule's number at each of these."""
    none = np.zeros(0, bool)
    if not len(at):
        return at, code, none, code
    # of a run of one symbol, every other position from the left is a use
    own = np.ones(len(at), bool)
    same = np.flatnonzero(symbol[at] == symbol[nxt(at)])
    uses = np.bincount(code, minlength=n_codes)
    if len(same):
        same = same[np.argsort(at[same])]
        run = np.ones(len(same), bool)
        run[1:] = nxt(at[same[:-1]]) != at[same[1:]]
        begin = np.maximum.accumulate(np.where(run, np.arange(len(same)), 0))
        other = same[((np.arange(len(same)) - begin) & 1) == 1]
        own[other] = False
        uses -= np.bincount(code[other], minlength=n_codes)
    few = uses < LEAST_USES
    if few.any():
        live = ~few[code]
        at, code, own = at[live], code[live], own[live]
    if not len(at):
        return at, code, none, code
    # of overlapping pairs the more frequent goes first; the most frequent keeps all its uses
    place = np.empty(len(uses), np.int32)
    by_uses = (uses << 32) | np.arange(len(uses))
    by_uses.sort()
    place[by_uses & np.int64(0xFFFFFFFF)] = np.arange(1, len(uses) + 1, dtype=np.int32)
    mine = place[code]
    if len(same):
        mine[~own] = 0
    rank = np.zeros(len(symbol), np.int32)
    rank[at] = mine
    hit = np.empty(len(at), bool)
    for a in range(0, len(at), STEP):
        here = at[a : a + STEP]
        hit[a : a + STEP] = (mine[a : a + STEP] > rank[prv(here)]) & (mine[a : a + STEP] > rank[nxt(here)])
    good = np.bincount(code[hit], minlength=len(uses)) >= LEAST_USES
    hit &= good[code]
    return at, code, hit, (np.cumsum(good, dtype=np.int32) - 1)[code[hit]]


def _repeated(symbol: np.ndarray, nxt, first: np.ndarray) -> tuple[np.ndarray, np.ndarray, int]:
    """The places, of those given, whose pairs are there more than once; numbers of their pairs; how many numbers."""
    none = np.zeros(0, np.int32)
    if not len(first):
        return none, none, 0
    left, right = symbol[first], symbol[nxt(first)]
    if len(first) > 1 << PLACE_BITS or max(left.max(), right.max()) >= 1 << SYMBOL_BITS:
        code = numbered((left.astype(np.uint64) << np.uint64(32)) | right.astype(np.uint32))[0]
        size = np.bincount(code)
        some = size[code] > 1
        return first[some], code[some], len(size)
    # pair and place in one number: sorted, equal pairs are neighbours, in the order of their places
    key = left.astype(np.uint64)
    key <<= np.uint64(SYMBOL_BITS)
    key |= right.astype(np.uint32)
    key <<= np.uint64(PLACE_BITS)
    key |= np.arange(len(first), dtype=np.uint32)
    del left, right
    key.sort()
    place = (key & np.uint64((1 << PLACE_BITS) - 1)).astype(np.int32)
    key >>= np.uint64(PLACE_BITS)
    same = key[1:] == key[:-1]
    del key
    some = np.zeros(len(place), bool)
    some[1:] = same
    begins = np.ones(len(place), bool)
    begins[1:] = ~same
    some[:-1] |= same
    begins &= some
    code = np.full(len(first), -1, np.int32)
    code[place[some]] = np.cumsum(begins[some], dtype=np.int32) - 1
    some = code >= 0
    return first[some], code[some], int(begins.sum())


def _lengths(rules: np.ndarray) -> np.ndarray:
    """Tokens that each rule stands for; a rule uses earlier ones only."""
    size = np.zeros(len(rules), np.int32)
    deep = rules >= FIRST_RULE
    todo = np.ones(len(rules), bool)
    while todo.any():
        inner = np.where(deep, rules - FIRST_RULE, 0)
        ready = todo & ~(deep & todo[inner]).any(axis=1)
        size[ready] = np.where(deep[ready], size[inner[ready]], 1).sum(axis=1)
        todo &= ~ready
    return size


def _lefts(rules: np.ndarray, length: np.ndarray) -> np.ndarray:
    """Tokens that each rule's left symbol stands for."""
    half, deep = np.ones(len(rules), np.int32), rules[:, 0] >= FIRST_RULE
    half[deep] = length[rules[deep, 0] - FIRST_RULE]
    return half


def expand(symbols: np.ndarray, rules: np.ndarray, length: np.ndarray | None = None, half: np.ndarray | None = None) -> np.ndarray:
    """Tokens of symbols, END as it is."""
    length = _lengths(rules) if length is None else length
    half = _lefts(rules, length) if half is None else half
    size = np.ones(len(symbols), np.int64)
    deep = symbols >= FIRST_RULE
    size[deep] = length[symbols[deep] - FIRST_RULE]
    ends = np.cumsum(size)
    start = (ends - size).astype(np.int32 if not len(ends) or ends[-1] < 1 << 31 else np.int64)
    out = np.empty(int(ends[-1]) if len(ends) else 0, symbols.dtype)
    out[start] = symbols
    at, rule = start[deep], symbols[deep] - FIRST_RULE
    while len(at):
        # a nonterminal's place is written again by what it stands for
        other = at + half[rule]
        left, right = rules[rule, 0], rules[rule, 1]
        out[at], out[other] = left, right
        first, second = left >= FIRST_RULE, right >= FIRST_RULE
        at, rule = np.concatenate([at[first], other[second]]), np.concatenate([left[first], right[second]]) - FIRST_RULE
    return out


def pack_bits(values: np.ndarray, width: int) -> bytes:
    """Values below 2**width, that many bits each, the highest first."""
    step = STEP >> 3 << 3  # whole bytes
    parts = [np.packbits(np.unpackbits(values[a : a + step].astype(">u4").view(np.uint8).reshape(-1, 4), axis=1)[:, 32 - width :].ravel()) for a in range(0, len(values), step)]
    return b"".join(p.tobytes() for p in parts)


def unpack_bits(raw: np.ndarray, width: int, count: int) -> np.ndarray:
    out, step = np.zeros(count, np.int32), STEP >> 3 << 3
    for a in range(0, count, step):
        n = min(step, count - a)
        whole = np.zeros((n, 32), np.uint8)
        whole[:, 32 - width :] = np.unpackbits(raw[a // 8 * width : a // 8 * width + (n * width + 7) // 8], count=n * width).reshape(n, width)
        out[a : a + n] = np.packbits(whole).view(">u4")
    return out


def pack(ids: np.ndarray, n_tokens: np.ndarray, doc_ids: pa.Array) -> bytes:
    symbols, rules, length = repair(ids)
    ends = np.flatnonzero(symbols == END)
    n_symbols = np.diff(np.concatenate([[-1], ends])).astype(np.int32)
    terminals = np.unique(np.concatenate([symbols[symbols < FIRST_RULE], rules[rules < FIRST_RULE]])).astype(np.int32)

    code = np.zeros(int(terminals[-1]) + 1 if len(terminals) else 1, np.int32)
    code[terminals] = np.arange(len(terminals), dtype=np.int32)

    def coded(x: np.ndarray) -> np.ndarray:
        return np.where(x < FIRST_RULE, np.take(code, x, mode="clip"), x - np.int32(FIRST_RULE - len(terminals)))

    width = max(1, int(len(terminals) + len(rules) - 1).bit_length())
    kind = next(k for k in ("<u1", "<u2", "<u4") if length.max(initial=0) < 1 << 8 * np.dtype(k).itemsize)
    valid = np.asarray(doc_ids.is_valid()).astype(np.uint8)
    ids64 = np.asarray(doc_ids.fill_null(0), np.int64)
    head = np.array([len(n_tokens), len(rules), len(symbols), len(terminals), width, np.dtype(kind).itemsize], "<i8")
    packed = [pack_bits(coded(x), width) for x in (rules.ravel(), symbols)]
    return b"".join([MAGIC, head.tobytes(), terminals.astype("<i4").tobytes(), *packed, length.astype(kind).tobytes(), n_tokens.astype("<i4").tobytes(), n_symbols.astype("<i4").tobytes(), ids64.astype("<i8").tobytes(), valid.tobytes()])


class Block:
    """A packed block, opened: whole documents or any span of their tokens."""

    def __init__(self, raw: bytes):
        if raw[:8] != MAGIC:
            raise ValueError("not a token block")
        n, r, s, t, width, size = (int(x) for x in np.frombuffer(raw, "<i8", 6, 8))
        at = 56

        def take(kind: str, count: int) -> np.ndarray:
            nonlocal at
            out = np.frombuffer(raw, kind, count, at)
            at += out.nbytes
            return out

        terminals = take("<i4", t)

        def symbols(count: int) -> np.ndarray:
            x = unpack_bits(take("u1", (count * width + 7) // 8), width, count)
            if not t:
                return x + FIRST_RULE
            return np.where(x < t, terminals[np.minimum(x, t - 1)], x - t + FIRST_RULE).astype(np.int32)

        self.rules, self.symbols = symbols(2 * r).reshape(-1, 2), symbols(s)
        self.length = take(f"<u{size}", r).astype(np.int32)
        self.n_tokens, self.n_symbols = take("<i4", n), take("<i4", n)
        self.doc_ids, self.valid = take("<i8", n), take("u1", n).astype(bool)

    def tokens(self) -> np.ndarray:
        ids = expand(self.symbols, self.rules, self.length)
        return np.where(ids == END, END_ID, ids).astype(np.uint32)

    def runs(self) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """All documents in order, some at once: their tokens and the number of each one's, about READ_TOKENS together or one document."""
        group = (np.cumsum(self.n_tokens, dtype=np.int64) - self.n_tokens) // READ_TOKENS
        cuts = (np.flatnonzero(np.diff(group)) + 1).tolist()
        first, half = np.concatenate([[0], np.cumsum(self.n_symbols, dtype=np.int64)]), _lefts(self.rules, self.length)
        for a, b in zip([0, *cuts], [*cuts, len(group)]):
            ids = expand(self.symbols[first[a] : first[b]], self.rules, self.length, half)
            ids[ids == END] = END_ID
            yield ids.view(np.uint32), self.n_tokens[a:b]

    def document(self, k: int, start: int = 0, stop: int | None = None) -> np.ndarray:
        """Tokens [start, stop) of the k-th document, expanding only the symbols that hold them."""
        first = int(self.n_symbols[:k].sum(dtype=np.int64))
        own = self.symbols[first : first + int(self.n_symbols[k])]
        size = np.ones(len(own), np.int64)
        deep = own >= FIRST_RULE
        size[deep] = self.length[own[deep] - FIRST_RULE]
        ends = np.cumsum(size)
        stop = int(ends[-1]) if stop is None else min(stop, int(ends[-1]))
        if start >= stop:
            return np.zeros(0, np.uint32)
        a, b = int(np.searchsorted(ends, start, side="right")), int(np.searchsorted(ends, stop, side="left")) + 1
        before = int(ends[a] - size[a])
        ids = expand(own[a:b], self.rules, self.length)[start - before : stop - before]
        return np.where(ids == END, END_ID, ids).astype(np.uint32)


_encoders: dict[str, Encoder] = {}


def _writer(path: str):
    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        if path not in _encoders:
            _encoders.clear()
            _encoders[path] = Encoder(path)
        encoder = _encoders[path]
        part, seq = TaskContext.get().partitionId(), 0
        ids, sizes, docs, held = [], [], [], 0

        def block() -> pa.RecordBatch:
            nonlocal ids, sizes, docs, held
            n, all_ids, all_docs = np.concatenate(sizes), np.concatenate(ids), pa.concat_arrays(docs)
            ids, sizes, docs, held = [], [], [], 0
            give_back()  # what the encoder freed
            raw = pack(all_ids, n, all_docs)
            give_back()
            return pa.RecordBatch.from_arrays([pa.array([part], pa.int32()), pa.array([seq], pa.int32()), pa.array([len(n)], pa.int64()), pa.array([int(n.sum())], pa.int64()), pa.array([raw], pa.binary())], names=["part", "seq", "n_docs", "n_tokens", "block"])

        for p in pieces(batches, "text", ENCODED_BYTES):
            a, n = encoder.encode(p.column("text"))
            ids.append(a)
            sizes.append(n)
            docs.append(p.column("doc_id"))
            held += len(a)
            if held >= BLOCK_TOKENS:
                yield block()
                seq += 1
        if docs:
            yield block()

    return write


def write_tokens(docs: DataFrame, tokenizer: str, path: str) -> DataFrame:
    """Write ``docs`` (doc_id, text) to token files at ``path``; returns the files' rows.

    Null and empty texts are the end id alone.  A null doc_id comes first; rows
    that repeat an id are all written, by text.  An empty table writes no block.
    """
    slim = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text"))
    order = [F.col("doc_id").asc_nulls_first(), F.col("text")]
    ranged = slim.repartitionByRange(F.col("doc_id").asc_nulls_first()).sortWithinPartitions(*order)
    return saved(mapped(ranged, _writer(tokenizer), "part int, seq int, n_docs long, n_tokens long, block binary"), path)


def _read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    _encoders.clear()  # a worker that wrote would keep what it learnt beside the blocks
    give_back()
    for batch in batches:
        for part, seq, raw in zip(batch.column("part").to_pylist(), batch.column("seq").to_pylist(), batch.column("block")):
            block, crc = Block(raw.as_py()), []
            for ids, sizes in block.runs():
                view = memoryview(ids.astype("<u4", copy=False).tobytes())
                crc += [zlib.crc32(view[4 * (e - k) : 4 * e]) for e, k in zip(np.cumsum(sizes).tolist(), sizes.tolist())]
                del ids, view
            n = block.n_tokens.astype(np.int64)
            ends = np.cumsum(n)
            doc = pa.array(block.doc_ids, mask=~block.valid)
            yield pa.RecordBatch.from_arrays([pa.array([part] * len(n), pa.int32()), pa.array([seq] * len(n), pa.int32()), doc, pa.array(ends - n), pa.array(n), pa.array(crc, pa.int64())], names=["part", "seq", "doc_id", "inner", "n_tokens", "ids_crc32"])


def read_digests(blocks: DataFrame) -> DataFrame:
    """Per document, decoded from token files: doc_id, start, n_tokens, ids_crc32."""
    sizes = blocks.select("part", "seq", "n_tokens")
    in_part = F.coalesce(F.sum("n_tokens").over(Window.partitionBy("part").orderBy("seq").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    # one row per part goes through a single task
    parts = sizes.groupBy("part").agg(F.sum("n_tokens").alias("held")).withColumn("base", F.coalesce(F.sum("held").over(Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
    at = sizes.withColumn("in_part", in_part).join(parts.select("part", "base"), "part").select("part", "seq", (F.col("base") + F.col("in_part")).alias("offset"))
    read = mapped(blocks.select("part", "seq", "block"), _read, "part int, seq int, doc_id long, inner long, n_tokens long, ids_crc32 long")
    return read.join(at, ["part", "seq"]).select("doc_id", (F.col("offset") + F.col("inner")).alias("start"), "n_tokens", "ids_crc32")


def default_tokenizer() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


def op2_repair_tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    blocks = write_tokens(spark.read.parquet(f"{sf_dir}/documents.parquet"), default_tokenizer(), f"{work_dir(spark, 'tokens')}/blocks")
    return read_digests(blocks)
