"""Token alignment, prefix trie and repeated passages against brute force."""

import hashlib
import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
import pyarrow.parquet as pq
import pytest
from pyspark.sql import functions as F

from conftest_llm import ODD, prose
from quillmeter.llm import alignment, prefix_trie, recompression
from quillmeter.llm.textkernel import words_of

# alignment


def brute_alignment(rows):
    import sentencepiece
    from tokenizers import Tokenizer

    a_path, b_path = alignment.default_tokenizers()
    a, b = Tokenizer.from_file(a_path), sentencepiece.SentencePieceProcessor(model_file=b_path)
    a.encode_special_tokens = True
    decode = alignment.byte_decoder()
    piece = lambda i: bytes([int(b.id_to_piece(i)[3:5], 16)]) if b.is_byte(i) else b.id_to_piece(i).replace("▁", " ").encode()
    found, counts = [], Counter()
    for doc, text in rows:
        x = a.encode(" " + text, add_special_tokens=False).ids if text else []
        y = b.encode(text) if text else []
        xs, ys = [bytes(decode[c] for c in a.id_to_token(i)) for i in x], [piece(i) for i in y]
        if not text or b"".join(xs) != (" " + text).encode() or b"".join(ys) != (" " + text).encode():
            found.append((doc, 0, 0, [], ""))
            continue
        ends_x, ends_y = np.cumsum([len(t) for t in xs]).tolist(), np.cumsum([len(t) for t in ys]).tolist()
        common = sorted(set(ends_x) & set(ends_y))
        at_x, at_y = {e: k for k, e in enumerate(ends_x)}, {e: k for k, e in enumerate(ends_y)}
        groups, i, j = [], 0, 0
        for e in common:
            groups.append(",".join(map(str, x[i : at_x[e] + 1])) + "|" + ",".join(map(str, y[j : at_y[e] + 1])))
            i, j = at_x[e] + 1, at_y[e] + 1
        links = [(x[at_x[e]], y[at_y[e]]) for e in common]
        counts.update(links)
        found.append((doc, len(x), len(y), links, hashlib.sha256(";".join(groups).encode()).hexdigest()))
    best = defaultdict(int)
    for (_, y), n in counts.items():
        best[y] = max(best[y], n)
    return Counter((d, nx, ny, len(k), len(k), sum(counts[p] == best[p[1]] for p in k), sum(counts[p] for p in k), s) for d, nx, ny, k, s in found)


def texts_to_align():
    r = random.Random(11)
    parts = ["word", "Ünïcode", "it's", "they'll", "'", "''s", "3.14", "1234567", "();\r\n", ");\r", "\n\n", "  ", "\t", " ", "　", "日本語", "é", "😀", "<|endoftext|>", "<s>", "</s>", "<unk>", "<0x0A>", "▁", "x▁y", ".", "...", "foo_bar", "http://a.b/c?d=e", "\x00", "\x1c", "é ", "ß,", "—", "”", "ﬁ"]
    mixed = ["".join(r.choice(parts) + r.choice(["", " ", "  ", "\n", " "]) for _ in range(r.randrange(1, 40))) for _ in range(250)]
    return [*mixed, *parts, " ", "  ", "\n", "a", " a", "a ", "x" * 3000, ". " * 2000, "é" * 500]


def test_alignment(spark):
    rows = [(k, t) for k, t in enumerate(texts_to_align())] + [(None, "no id"), (3, "again"), (3, "again"), (10_001, ""), (10_002, None)]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(5).withColumns({c: F.lit("x") for c in ("codes", "keys", "n_a", "b_id", "n")})
    got = Counter(tuple(r) for r in alignment.alignment(df, *alignment.default_tokenizers()).collect())
    assert got == brute_alignment(rows)


def test_workers_give_back_what_aligning_took(monkeypatch):
    calls = []
    monkeypatch.setattr(alignment, "give_back", lambda: calls.append(1))
    aligner, texts = alignment.Aligner(*alignment.default_tokenizers()), pa.array(["one text, of few words", None])
    first = aligner.align(texts)
    assert len(calls) == 1
    again = aligner.align(texts)
    assert len(calls) == 1 and all(list(x) == list(y) for x, y in zip(first, again))
    alignment._loaded["a", "b"] = aligner
    assert list(alignment._partial(iter([]))) == [] and not alignment._loaded


def test_alignment_odd(spark, odd, none):
    assert Counter(tuple(r) for r in alignment.alignment(odd, *alignment.default_tokenizers()).collect()) == brute_alignment([(d, t) for d, t, _ in ODD])
    assert alignment.alignment(none, *alignment.default_tokenizers()).count() == 0
    groups = {r["doc_id"]: r["groups"] for r in alignment.aligned_groups(odd.where("doc_id = 8"), *alignment.default_tokenizers()).collect()}
    assert re.fullmatch(r"[\d,]+\|[\d,]+(;[\d,]+\|[\d,]+)*", groups[8])


def test_shards_of_many_ranges(tmp_path):
    r = np.random.Generator(np.random.PCG64(3))
    keys = np.unique(r.integers(0, 40, 3000) << 32 | r.integers(0, 500, 3000))
    counts = r.integers(1, 99, len(keys))
    best = np.array([counts[keys >> 32 == b].max() for b in keys >> 32])
    listed = []
    for k, part in enumerate(np.array_split(np.arange(40), 7)):
        mine = np.isin(keys >> 32, part)
        (tmp_path / f"{k}").write_bytes(b"".join(x[mine].astype("<i8").tobytes() for x in (keys, counts, best)))
        listed.append((f"{k}", int(keys[mine][0]), int(keys[mine][-1]), int(mine.sum())))
    some = np.sort(r.choice(keys, 200, replace=False))
    found = alignment.Shards(str(tmp_path), listed).find(some)
    at = np.searchsorted(keys, some)
    assert (found[0] == counts[at]).all() and (found[1] == best[at]).all()


# prefix trie


def label(role, text):
    return hashlib.md5(f"{len(role)}:{role}{text}".encode()).digest()


def brute_trie(rows, rebuild=True):
    own = defaultdict(list)
    for c, turn, role, text in rows:
        if c is not None:
            role, text = role or "", text or ""
            own[c].append((turn is not None, turn or 0, label(role, text), (role, text)))
    own = {c: [t[3] for t in sorted(v)] for c, v in own.items()}
    if rebuild:
        paths = {c: [*own.get(c - c % 5, [])[: (h := zlib.crc32(str(c).encode()) % 9)], *own[c][h:]] for c in own}
    else:
        paths = own
    members = defaultdict(list)
    for c, path in paths.items():
        for d in range(len(path) + 1):
            members[tuple(path[:d])].append(c)
    out = []
    for node, cs in members.items():
        below = [n for n in members if n[: len(node)] == node]
        leaves = [n for n in below if not any(len(m) == len(n) + 1 and m[: len(n)] == n for m in members)]
        kept = sum((len(members[n]) - 1) * len(n[-1][1].encode()) for n in below if n)
        ends = ",".join(map(str, sorted(c for c in cs if len(paths[c]) == len(node))))
        out.append((min(cs), len(node), min(members[node[:-1]]) if node else None, len(cs), sum(len(n) == len(node) + 1 for n in below), len(leaves), kept, hashlib.sha256(ends.encode()).hexdigest()))
    return Counter(out)


def talk(seed, n):
    r = random.Random(seed)
    rows = []
    for c in range(n):
        if c % 7 == 3:
            continue
        for t in range(r.randrange(1, 12)):
            rows.append((c, t, r.choice(["user", "assistant", None]), r.choice(["hi", "ho", "é", "", None, "long text " * 3])))
    return rows + [(0, None, "user", "first"), (0, None, "user", "first"), (5, 1, "user", "tie"), (5, 1, "user", "tie two"), (None, 1, "user", "nobody"), (10**12 + 1, 0, "a", "bc"), (10**12 + 2, 0, "ab", "c")]


@pytest.mark.parametrize("shard_paths", [1, 3, 1024])
def test_trie(spark, shard_paths):
    rows = talk(shard_paths, 60)
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").repartition(6).withColumns({c: F.lit(1) for c in ("key", "keys", "turns", "depth", "upper", "shard")})
    turns = prefix_trie.rebuilt(prefix_trie.conversations_in_order(df))
    assert Counter(tuple(r) for r in prefix_trie.prefix_trie(turns, shard_paths=shard_paths).collect()) == brute_trie(rows)


def test_trie_of_copies_and_none(spark):
    rows = [(c, t, "user", f"turn {t}") for c in range(300) for t in range(3)] + [(1000, 0, "user", "else")]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").repartition(4)
    turns = prefix_trie.conversations_in_order(df)
    assert Counter(tuple(r) for r in prefix_trie.prefix_trie(turns, shard_paths=1).collect()) == brute_trie(rows, rebuild=False)
    assert prefix_trie.prefix_trie(prefix_trie.rebuilt(turns.where("false"))).count() == 0


def test_chunks_of_ids_are_streamed(monkeypatch):
    import pyarrow as pa

    monkeypatch.setattr(prefix_trie, "CHUNK_IDS", 3)
    keys = [b"a"] * 8 + [b"b"] + [b"c"] * 3
    ids = [1, 2, 3, 10, 11, 12, 13, 14, 7, 5, 6, 7]
    batches = [pa.record_batch([pa.array(keys[k : k + 5], pa.binary()), pa.array(ids[k : k + 5])], names=["key", "conv_id"]) for k in range(0, 12, 5)]
    chunks = list(prefix_trie._joined(iter(batches)))
    assert max(n for c in chunks for n in c.column("n").to_pylist()) == 3
    found = [tuple(r.values()) for b in prefix_trie._hashed(iter(chunks)) for r in b.to_pylist()]
    sha = lambda s: hashlib.sha256(s.encode()).hexdigest()
    assert found == [(b"a", 1, 8, sha("1,2,3,10,11,12,13,14")), (b"b", 7, 1, sha("7")), (b"c", 5, 3, sha("5,6,7"))]


def test_louds():
    keys = [np.array([[0] * 16, *[[x] * 16 for x in path]], np.uint8) for path in ([1, 2, 3], [1, 4], [5], [1, 2, 6], [])]
    trie, places = prefix_trie.build(keys)
    assert "".join("1" if b else "0" for b in trie.louds) == "10110110" + "0110" + "000"
    assert trie.parents().tolist() == [-1, 0, 0, 1, 1, 3, 3] and trie.children().tolist() == [2, 2, 0, 2, 0, 0, 0]
    assert [(x.start, x.stop) for x in trie.levels()] == [(0, 1), (1, 3), (3, 5), (5, 7)]
    assert [p.tolist() for p in places] == [[0] * 5, [1, 1, 2, 1, -1], [3, 4, -1, 3, -1], [5, -1, -1, 6, -1]]


# repeated passages


def brute_repeats(rows, window=13):
    last = 1 << 63
    split = [(d, re.findall(r"[^\x20\x09-\x0D]+", t or "")) for d, t in rows]
    least = {}
    for d, w in split:
        for i in range(len(w) - window + 1):
            k = tuple(w[i : i + window])
            least[k] = min(least.get(k, last), last if d is None else d)
    out = []
    for d, w in split:
        gone = set()
        for i in range(len(w) - window + 1):
            if least[tuple(w[i : i + window])] < (last - 1 if d is None else d):
                gone.update(range(i, i + window))
        kept = " ".join(x for i, x in enumerate(w) if i not in gone)
        out.append((d, len(w), len(gone), hashlib.sha256(kept.encode()).hexdigest()))
    return Counter(out)


def found_repeats(df):
    kept = recompression.without_repeats(df)
    return Counter((r["doc_id"], r["n_words"], r["n_removed"], hashlib.sha256(r["kept_text"].encode()).hexdigest()) for r in kept.collect())


def test_repeats_odd(odd, none):
    clash = odd.withColumns({c: F.lit("x") for c in ("rank", "cls", "starts", "sizes", "ranges", "r", "c")})
    assert found_repeats(clash) == brute_repeats([(d, t) for d, t, _ in ODD])
    assert recompression.without_repeats(none).count() == 0


def test_repeats(spark):
    r = random.Random(13)
    pool = [prose(100 + k, r.randrange(8, 60)) for k in range(25)]
    few = ["a", "b", "ab"]
    rows = []
    for d in range(400):
        kind = d % 8
        parts = [prose(d, r.randrange(0, 30))]
        if kind < 4:
            parts += [r.choice(pool), prose(1000 + d, r.randrange(0, 20))]
        elif kind == 4:
            parts = [" ".join(r.choice(few) for _ in range(r.randrange(5, 60)))]
        elif kind == 5:
            parts = ["same " * r.randrange(5, 40), prose(d, 5)]
        elif kind == 6:
            w = pool[d % 3].split()
            a = r.randrange(len(w))
            parts = [prose(d, 3), " ".join(w[a:]), "X", " ".join(w[:a])]
        rows.append((d, r.choice(["\n", " ", "\t "]).join(parts)))
    rows += [(d + 1, t.replace(" ", "  ")) for d, t in rows[:40]] + [(None, rows[1][1]), (None, prose(7, 40)), (7, prose(7, 40)), (7, prose(7, 40)), (7, prose(7, 40) + "\n")]
    for n in (1, 9):
        df = spark.createDataFrame(rows, "doc_id long, text string").repartition(n)
        assert found_repeats(df) == brute_repeats(rows)


@pytest.mark.parametrize("seed", range(6))
def test_cores_stand_alike_everywhere(seed):
    """A window's core has the same symbols wherever the window stands."""
    r = random.Random(seed)
    vocabulary = [f"w{k}" for k in range((2, 3, 8, 50, 500, 5)[seed])]
    window = [r.choice(vocabulary) for _ in range(recompression.WINDOW)]
    texts = [" ".join([*(r.choice(vocabulary) for _ in range(r.randrange(12))), *window, *(r.choice(vocabulary) for _ in range(r.randrange(12)))]) for _ in range(60)]
    import pyarrow as pa

    w = words_of(pa.array(texts), lower=False)
    words = w.hashes()
    want = words_of(pa.array([" ".join(window)]), lower=False).hashes()
    for levels in range(5):
        symbol, _, start, low, high = recompression.parsed(words, w.row, levels=levels)
        cores = {tuple(symbol[a:b].tolist()) if b > a else () for s, a, b in zip(start, low, high) if (words[s : s + recompression.WINDOW] == want).all()}
        assert len(cores) == 1


def test_files_of_blocks_are_cut_by_bytes(spark, tmp_path):
    """Neither a row group nor what a writer keeps of it grows with the rows of a task."""
    r = random.Random(5)
    rows = spark.createDataFrame([(k, r.randbytes(1 << 20)) for k in range(30)], "id long, held binary").coalesce(1)
    back = recompression._packed(rows, str(tmp_path / "packed"))
    assert back.agg({"id": "sum"}).first()[0] == 435
    (path,) = (tmp_path / "packed").glob("*.parquet")
    meta = pq.ParquetFile(path).metadata
    groups = [meta.row_group(k) for k in range(meta.num_row_groups)]
    assert sum(g.num_rows for g in groups) == 30 and max(g.num_rows for g in groups) <= 12
    assert all(g.column(1).statistics is None for g in groups)
