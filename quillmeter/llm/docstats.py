"""Statistics of whole documents, a fixed number of numpy passes per batch."""

from __future__ import annotations

import numpy as np
import pyarrow as pa

from .textkernel import SPACE, mix, ngrams, span_hashes, split_spans, text_bytes

#: Counted symbols
SYMBOLS = b"#*$%&|<>"
_ROW = np.uint64(0xD6E8FEB86659FD93)


def _table(chars: bytes) -> np.ndarray:
    t = np.zeros(256, bool)
    t[list(chars)] = True
    return t


_SYMBOL, _LINE = _table(SYMBOLS), _table(b"\n")
_UPPER, _DIGIT, _STOP, _CRY = _table(bytes(range(65, 91))), _table(bytes(range(48, 58))), _table(b".,;:"), _table(b"!?")
_HIGH = np.arange(256) >= 0x80
_FOLLOW = (np.arange(256) & 0xC0) == 0x80

BASE = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")
FEATURES = ("log_words", "word_length", "symbols", "dup_lines", "repeat_words", "upper", "digits", "stops", "cries", "high", "distinct_words", "same_as_last", "words_a_line")
#: Features of which more can only lower the quality
LOWERING = ("symbols", "dup_lines", "repeat_words")


def _per_row(keys: np.ndarray, row: np.ndarray, n: int) -> np.ndarray:
    """How many distinct keys each row has."""
    _, at = np.unique(mix(keys + row.astype(np.uint64) * _ROW), return_index=True)
    return np.bincount(row[at], minlength=n)


def statistics(texts: pa.Array) -> tuple[dict[str, np.ndarray], np.ndarray]:
    """The exact counts of BASE, and a row of FEATURES for each text; null is empty."""
    data, offsets = text_bytes(texts)
    n = len(offsets) - 1
    w = split_spans(data, offsets, SPACE)
    words = w.counts

    def count(flags: np.ndarray) -> np.ndarray:
        total = np.concatenate([[0], np.cumsum(flags, dtype=np.int64)])
        return total[offsets[1:]] - total[offsets[:-1]]

    shown = ~SPACE[data]
    chars = count(shown & ~_FOLLOW[data])
    symbols = count(_SYMBOL[data])
    lines = split_spans(data, offsets, _LINE)
    seen = np.concatenate([[0], np.cumsum(shown, dtype=np.int64)])
    worded = seen[lines.end] > seen[lines.start]
    start, end, row = lines.start[worded], lines.end[worded], lines.row[worded]
    n_lines = np.bincount(row, minlength=n)
    dup_lines = n_lines - _per_row(span_hashes(data, start, end), row, n)

    hashes = w.hashes()
    grams, bounds = ngrams(hashes, w.first, 3, short=False)
    k = np.diff(bounds)
    of = np.repeat(np.arange(n), k)
    order = np.argsort(key := mix(grams + of.astype(np.uint64) * _ROW))
    ranked = key[order]
    same = np.zeros(len(ranked), bool)
    if len(ranked) > 1:
        eq = ranked[1:] == ranked[:-1]
        same[1:] |= eq
        same[:-1] |= eq
    hit = order[same]
    first = w.first[:-1][of[hit]] + hit - bounds[:-1][of[hit]]
    covered = np.zeros(len(hashes) + 2, bool)
    for j in range(3):
        covered[first + j] = True
    repeats = np.bincount(w.row[covered[: len(hashes)]], minlength=n)

    distinct = _per_row(hashes, w.row, n)
    again = np.zeros(len(hashes), bool)
    again[1:] = (hashes[1:] == hashes[:-1]) & (w.row[1:] == w.row[:-1])
    per_char, per_word = np.maximum(chars, 1), np.maximum(words, 1)
    features = [np.log1p(words), chars / per_word, symbols / per_char, dup_lines / np.maximum(n_lines, 1), repeats / per_word]
    features += [count(t[data]) / per_char for t in (_UPPER, _DIGIT, _STOP, _CRY, _HIGH)]
    features += [distinct / per_word, np.bincount(w.row[again], minlength=n) / per_word, words / np.maximum(n_lines, 1)]
    base = dict(zip(BASE, (words, chars, symbols, dup_lines, repeats)))
    return base, np.stack([np.asarray(f, np.float64) for f in features], axis=1) if n else np.zeros((0, len(FEATURES)))
