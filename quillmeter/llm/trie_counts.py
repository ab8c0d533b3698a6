"""Token counts by dynamic programming over a trie of distinct pre-tokens.

Vocabulary: the pieces of a public sentencepiece model, in its order; piece r
has log-probability -log(r + 2), Zipf's law, as the file's own scores are merge
ranks and no tokenizer is trained here.  A character without a piece costs one
token per UTF-8 byte.  A pre-token is a run between the places where ASCII
letters, digits, symbols and white space meet; one that starts a word is led by
U+2581.

The count of a pre-token is that of its best segmentation.  Distinct pre-tokens
are inserted in a trie; a node holds the best score of its prefix, the tokens of
that segmentation, and the pieces that are under way there: where in the
vocabulary's own trie they stand, and with which score and tokens they began.  A
child follows from its parent alone, so each shared prefix is computed once, and
a pre-token's count is what its terminal node holds.  The trie keeps MOST_NODES
nodes of DEPTH characters at most (about 400 bytes each) and begins anew beyond;
what is deeper is computed without being kept.  Counts stay with the worker, up to
CACHE_COUNTS.
"""

from __future__ import annotations

import gc
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import mapped
from .textkernel import SPACE, HashIndex, numbered, pieces, span_hashes, text_bytes
from .token_files import piece_spans

CACHE_COUNTS, MOST_NODES, DEPTH = 1_500_000, 300_000, 48
BYTE_COST = 14.0
MARK = "▁"


#: What a node of the trie holds: children by character (None: none yet), best score,
#: its tokens, pieces under way as (place in the vocabulary, score and tokens where it began),
#: the count of the pre-token that ends here (None: none does)
CHILDREN, BEST, TOKENS, OPEN, TERMINAL = range(5)


class Unigram:
    def __init__(self, scores: dict[str, float]):
        self.scores = scores
        self.vocabulary: dict = {}  # nested by character; a piece's score stands under the empty string
        for piece, score in scores.items():
            at = self.vocabulary
            for c in piece:
                at = at.setdefault(c, {})
            at[""] = score
        self.known = HashIndex()
        self.sizes: dict[str, int] = {}  # UTF-8 bytes of characters, where more than one
        self.clear()

    def clear(self) -> None:
        self.root, self.nodes = [None, 0.0, 0, (), None], 0

    def _size(self, c: str) -> int:
        if c not in self.sizes:
            self.sizes[c] = len(c.encode("utf-8", "surrogatepass"))
        return self.sizes[c]

    def insert(self, word: str) -> int:
        """The tokens of a pre-token, from its terminal node."""
        node, start, depth = self.root, self.vocabulary, 0
        for c in word:
            depth += 1
            children = node[CHILDREN]
            after = children.get(c) if children is not None else None
            if after is None:
                best, tokens = node[BEST], node[TOKENS]
                n_bytes = 1 if c < "\x80" else self._size(c)
                top, count, under_way = best - BYTE_COST * n_bytes, tokens + n_bytes, []
                for at, began, begun in node[OPEN]:
                    at = at.get(c)
                    if at is not None:
                        under_way.append((at, began, begun))
                        score = at.get("")
                        if score is not None:
                            score += began
                            if score > top or (score == top and begun + 1 < count):
                                top, count = score, begun + 1
                at = start.get(c)
                if at is not None:
                    under_way.append((at, best, tokens))
                    score = at.get("")
                    if score is not None:
                        score += best
                        if score > top or (score == top and tokens + 1 < count):
                            top, count = score, tokens + 1
                after = [None, top, count, under_way, None]
                if depth <= DEPTH:  # what is deeper is not kept
                    if children is None:
                        node[CHILDREN] = {c: after}
                    else:
                        children[c] = after
                    self.nodes += 1
            node = after
        node[TERMINAL] = node[TOKENS]
        return node[TERMINAL]

    def counts(self, pretokens: list[str]) -> list[int]:
        """Tokens of each of the distinct pre-tokens."""
        out = []
        for word in pretokens:
            if self.nodes > MOST_NODES:
                self.clear()
            out.append(self.insert(word))
        return out

    @classmethod
    def load(cls, path: str) -> Unigram:
        import sentencepiece

        model = sentencepiece.SentencePieceProcessor(model_file=path)
        usable = [model.id_to_piece(i) for i in range(model.get_piece_size()) if not (model.is_control(i) or model.is_unknown(i) or model.is_byte(i))]
        return cls({p: -math.log(r + 2) for r, p in enumerate(usable)})

    def per_row(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """Pre-tokens and tokens of each row."""
        data, offsets = text_bytes(texts)
        n = len(offsets) - 1
        start, end, row, _ = piece_spans(data, offsets)
        if not len(start):
            return np.zeros(n, np.int64), np.zeros(n, np.int64)
        leads = np.ones(len(start), bool)
        inner = start > offsets[row]
        leads[inner] = SPACE[data[start[inner] - 1]]
        codes, distinct = numbered(span_hashes(data, start, end) ^ leads.astype(np.uint64))
        if self.known.count + len(distinct) > CACHE_COUNTS:
            self.known = HashIndex()
        size = self.known.find(distinct).astype(np.int64)
        if len(new := np.flatnonzero(size < 0)):
            first = np.zeros(len(distinct), np.int64)
            first[codes[::-1]] = np.arange(len(codes))[::-1]
            raw, first = data.tobytes(), first[new]
            words = [(MARK if lead else "") + raw[a:b].decode("utf-8", "replace") for a, b, lead in zip(start[first].tolist(), end[first].tolist(), leads[first].tolist())]
            size[new] = self.counts(words)
            self.known.add(distinct[new], size[new].astype(np.int32))
        return np.bincount(row, minlength=n), np.bincount(row, size[codes], n).astype(np.int64)


_loaded: dict[str, Unigram] = {}


def token_counts(docs: DataFrame, model: str) -> DataFrame:
    """Per row of ``docs`` (doc_id, text): n_pretokens, n_tokens.

    Null and empty texts have none; rows that repeat an id are each counted; of
    segmentations that tie the one of fewest tokens counts; an empty table gives
    an empty one; further columns are not read.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        if model not in _loaded:
            _loaded[model] = Unigram.load(model)
        gc.disable()  # nodes form no cycles, and the collector would walk the whole trie again and again
        try:
            for p in pieces(batches, "text"):
                pre, tokens = _loaded[model].per_row(p.column("text"))
                yield pa.RecordBatch.from_arrays([p.column("doc_id"), pa.array(pre, pa.int64()), pa.array(tokens, pa.int64())], names=["doc_id", "n_pretokens", "n_tokens"])
        finally:
            gc.enable()

    return mapped(docs.select(F.col("doc_id").cast("long"), "text"), run, "doc_id long, n_pretokens long, n_tokens long")


def default_model() -> str:
    import public_tokenizers

    return public_tokenizers.path("piece_bpe_32k.model")


def op7_trie_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_counts(spark.read.parquet(f"{sf_dir}/documents.parquet"), default_model())
