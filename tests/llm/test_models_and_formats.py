"""Classifiers, token files, token counts and chat formatting."""

import random
import tracemalloc
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from conftest_llm import ODD, prose
from quillmeter.llm import chat_format, docstats, pu_quality, quality_rules, textkernel, token_files, toxicity, trees, trie_counts


def plain_statistics(text):
    import re

    words = re.findall(r"[^\x20\x09-\x0D]+", text or "")
    seen, dup = set(), 0
    for line in (text or "").split("\n"):
        if re.search(r"[^\x20\x09-\x0D]", line):
            dup += line in seen
            seen.add(line)
    grams = [tuple(words[i : i + 3]) for i in range(len(words) - 2)]
    twice = {g for g, n in Counter(grams).items() if n > 1}
    covered = {i + j for i, g in enumerate(grams) if g in twice for j in range(3)}
    return len(words), sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text or "")), dup, len(covered)


TEXTS = [None, "", " ", "a", "a b c a b c", "x y z w x y z\nq\nq\n\nq ", "é日本 #$ <a|b>\r\né日本 #$ <a|b>\r\n", "a a a a", "one\ntwo\none\n one", prose(1, 300), "\n".join([prose(2, 9)] * 4), "y" * 5000, prose(3, 6000) + " " + prose(1, 40), " ".join(["a b"] * 4000)]


def test_statistics():
    base, x = docstats.statistics(pa.array(TEXTS, pa.string()))
    assert list(zip(*(base[k].tolist() for k in docstats.BASE))) == [plain_statistics(t) for t in TEXTS]
    assert np.isfinite(x).all()
    base, x = docstats.statistics(pa.array([], pa.string()))
    assert len(x) == 0 and len(base["n_words"]) == 0


def test_kernel_slices_and_hashes():
    whole = pa.array(["zz", "one two three four five six", None, "One"])
    w = textkernel.words_of(whole.slice(1, 3), lower=True)
    assert w.counts.tolist() == [6, 0, 1] and w.hashes()[0] == w.hashes()[6]
    g, b = textkernel.ngrams(w.hashes(), w.first, 5, short=True)
    assert b.tolist() == [0, 2, 2, 3] and len(set(g.tolist())) == 3
    index = textkernel.HashIndex(4)
    keys = np.unique(np.random.default_rng(0).integers(0, 2**63, 5000, dtype=np.uint64)) << np.uint64(1)
    for part in np.array_split(keys, 7):
        index.add(part, np.arange(index.count, index.count + len(part), dtype=np.int32))
    assert (index.find(keys) == np.arange(len(keys))).all() and (index.find(keys + np.uint64(1)) == -1).all()


def test_trees_keep_their_signs():
    rng = np.random.default_rng(2)
    x = rng.uniform(0, 1, (3000, 3))
    y = ((x[:, 0] < 0.5) ^ (rng.uniform(size=3000) < 0.05)).astype(float)
    y[x[:, 0] > 0.9] = 1  # against the sign
    f = trees.fit(x, y, np.array([-1, 0, 0]))
    grid = np.stack([np.linspace(0, 1, 200), np.full(200, 0.3), np.full(200, 0.6)], 1)
    assert (np.diff(f.raw(grid)) <= 1e-12).all()
    assert ((f.score(x) > 0.5) == (x[:, 0] < 0.5)).mean() > 0.85
    free = trees.fit(x, y, np.zeros(3))
    assert (np.diff(free.raw(grid)) > 0).any()
    assert trees.fit(x[:0], y[:0], np.zeros(3)).score(x).shape == (3000,)


def labelled_docs(spark, column):
    rng, rows, labels = random.Random(1), [], []
    for k in range(700):
        bad = k % 4 == 0
        text = prose(k, 60 + k % 50)
        if column == "toxic" and bad:
            w = text.split()
            w[rng.randrange(len(w))] = rng.choice(["Idiot,", "moron", "vequxyz", "veques"])
            text = " ".join(w)
        if column == "quality" and bad:
            text = " ".join(f"{w}***" if k % 8 else w.upper() + "!!" for w in text.split())
        rows.append((k, text))
        labels.append((k, int(bad) if column == "toxic" else int(not bad)))
    return spark.createDataFrame(rows, "doc_id long, text string"), spark.createDataFrame(labels, f"doc_id long, {column} int")


def held_out_accuracy(out, labels, column):
    rows = out.join(labels, "doc_id").where(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 5 == 0).collect()
    return sum((r["score"] >= 0.5) == bool(r[column]) for r in rows) / len(rows)


def test_toxicity(spark, odd, none):
    docs, labels = labelled_docs(spark, "toxic")
    model = toxicity.fit(docs, labels)
    assert held_out_accuracy(toxicity.scored(docs, model), labels, "toxic") > 0.95
    again = toxicity.fit(docs, labels)
    assert (again.w == model.w).all() and again.bias == model.bias
    out = toxicity.scored(odd, model).collect()
    assert len(out) == len(ODD) and all(0 <= r["score"] <= 1 for r in out)
    assert toxicity.without_toxic(none, model).count() == 0
    assert toxicity.without_toxic(odd, model).columns == odd.columns
    constant = toxicity.fit(odd, labels.where("false"))
    assert len({r["score"] for r in toxicity.scored(odd, constant).collect()}) == 1


def pair_docs(spark, kind):
    """Two words, each in half of the documents, that tell the label only together."""
    rng, rows, labels = random.Random(7), [], []
    for k in range(1500):
        a, b = rng.random() < 0.5, rng.random() < 0.5
        words = prose(k % 40, 8).split() + ["zorblat"] * a + ["quimper"] * b
        rng.shuffle(words)
        rows.append((k, " ".join(words)))
        labels.append((k, int(a != b if kind == "either" else a and b)))
    return spark.createDataFrame(rows, "doc_id long, text string"), spark.createDataFrame(labels, "doc_id long, toxic int")


@pytest.mark.parametrize("kind", ["either", "both"])
def test_pairs_are_learnt(spark, kind):
    """Through fit itself: with "either" neither word alone tells anything, so no linear weights do."""
    docs, labels = pair_docs(spark, kind)
    assert held_out_accuracy(toxicity.scored(docs, toxicity.fit(docs, labels)), labels, "toxic") > 0.95


def test_machine_is_the_sum_over_pairs():
    rng = np.random.default_rng(4)
    m = toxicity.Machine(0.3, rng.uniform(0, 1, toxicity.BUCKETS))
    m.w = rng.normal(0, 1, toxicity.BUCKETS).astype(np.float32)
    size = np.array([0, 1, 5, 12, 0, 3])
    x = np.concatenate([np.sort(rng.choice(toxicity.BUCKETS, n, replace=False)) for n in size]).astype(np.int32)
    at, want = 0, []
    for n in size.tolist():
        own, z = x[at : at + n].tolist(), 0.3
        for i, a in enumerate(own):
            z += float(m.w[a] * m.value[a])
            for b in own[:i]:
                z += float(m.v[a].astype(float) @ m.v[b].astype(float)) * float(m.value[a]) * float(m.value[b])
        want.append(z)
        at += n
    assert np.allclose(m.raw(x, size)[0], want, atol=1e-4)


def test_terms_and_evidence(spark, monkeypatch):
    x, first = toxicity.term_buckets(pa.array(["Idiot idiot, abc", None, "", "abcdefghij"], pa.string()))
    assert np.diff(first).tolist() == [2, 0, 0, 4]  # idiot, abc; the word and its prefixes of 5, 7 and 9 bytes
    labels = np.array([1.0, 0, 0, 1])
    g = toxicity.evidence(x, first, labels)
    told = lambda n, k: sum(c * np.log(c / n) for c in (k, n - k) if c)
    assert np.allclose(g[x], 2 * (told(1, 1) + told(3, 1) - told(4, 2)))
    monkeypatch.setattr(toxicity, "STEP_TERMS", 3)
    assert [s.tolist() for s in toxicity.steps(np.array([3, 0, 1, 2]), np.diff(first))] == [[3], [0, 1, 2]]
    docs, labels = labelled_docs(spark, "toxic")
    sample = docs.join(labels, "doc_id").select(F.col("toxic").alias("label"), F.lit(10).cast("long").alias("size"), F.col("doc_id").alias("mark"))
    assert sorted(r["mark"] for r in toxicity.bounded(sample, 95).collect()) == list(range(9)) and toxicity.bounded(sample, 7000).count() == 700


def test_quality_models(spark, odd, none):
    docs, labels = labelled_docs(spark, "quality")
    features = pu_quality.featured(docs).persist()
    net = pu_quality.fit(features, labels)
    assert held_out_accuracy(pu_quality.scored(features, net), labels, "quality") > 0.95
    only_good = pu_quality.fit(features, labels.where("quality = 1"))  # bad labels are never used
    assert all((a == b).all() for a, b in zip(net.p, only_good.p))
    forest = quality_rules.fit(docs, labels)
    assert held_out_accuracy(quality_rules.judged(docs, forest).select("doc_id", "score"), labels, "quality") > 0.95
    for rows, n in ((odd, len(ODD)), (none, 0)):
        assert quality_rules.judged(rows, forest).count() == n
        net = pu_quality.fit(pu_quality.featured(rows), labels.where("false"))
        scores = pu_quality.scored(pu_quality.featured(rows), net).collect()
        assert len(scores) == n and all(0 <= r["score"] <= 1 for r in scores)
    assert not any(r["kept"] for r in quality_rules.judged(odd, forest).where("n_words < 50").collect())


def test_cut_has_the_highest_f1():
    rng = np.random.default_rng(21)
    for n in (2, 3, 10, 200):
        y = (rng.uniform(size=n) < 0.4).astype(float)
        y[:2] = 0, 1
        z = np.round(rng.normal(0, 1, n) + y, 1)
        f1 = lambda c: 2 * (y[z >= c] == 1).sum() / ((z >= c).sum() + y.sum())
        assert abs(f1(toxicity.cut(z, y)) - max(f1(c) for c in z)) < 1e-12
    assert toxicity.cut(np.ones(3), np.zeros(3)) == toxicity.cut(np.ones(3), np.ones(3)) == 0


def test_quality_does_not_depend_on_partitions(spark, monkeypatch):
    monkeypatch.setattr(pu_quality, "SHARD_ROWS", 150)
    monkeypatch.setattr(pu_quality, "COPIES", 2)
    docs, labels = labelled_docs(spark, "quality")
    docs = docs.unionByName(docs.where("doc_id = 1")).unionByName(docs.where("doc_id = 1").crossJoin(spark.range(5)).drop("id"))
    before, nets = spark.conf.get("spark.sql.shuffle.partitions"), []
    try:
        for n in (2, 4, 7):
            spark.conf.set("spark.sql.shuffle.partitions", n)
            nets.append(pu_quality.fit(pu_quality.featured(docs.repartition(n)), labels).flat())
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)
    assert np.abs(nets[0] - nets[1]).max() < 1e-6 and np.abs(nets[0] - nets[2]).max() < 1e-6


def test_a_round_is_the_mean_of_its_shards(spark):
    rng = np.random.default_rng(12)
    width = len(docstats.FEATURES)
    rows = [(k, rng.uniform(0, 2, width).tolist()) for k in range(90)]
    web = spark.createDataFrame([*rows, *[rows[0]] * 4], "doc_id long, x array<double>")
    assert pu_quality.sharded(web).count() == 94
    shards = web.selectExpr("doc_id % 3 as shard", "x")
    positive = rng.uniform(1, 2, (40, width))
    net, own = (pu_quality.Network(np.ones(2 * width), np.ones(2 * width)) for _ in range(2))
    pu_quality._round(shards, net, positive, 0.4, 0.01, 3)
    total = 0
    for s in range(3):
        other = np.array([x for k, x in [*rows, *[rows[0]] * 4] if k % 3 == s])
        mine = pu_quality.Network(own.mean, own.scale)
        mine.fit(positive, other[np.lexsort(other.T)], 0.4, 0.01, 3)
        total = total + mine.flat() * len(other) / 94
    assert np.abs(net.flat() - total).max() < 1e-8


def test_prior_is_estimated_without_negatives():
    """From scores of positives and a mixture, whatever the share of positives in it."""
    rng = np.random.default_rng(8)
    for share in (0.1, 0.5, 0.9):
        good, bad = rng.beta(5, 2, 40_000), rng.beta(2, 8, 40_000)
        mixed = np.where(rng.uniform(size=40_000) < share, good, bad)
        counts = [np.histogram(s, pu_quality.BINS, (0, 1))[0].astype(float) for s in (rng.beta(5, 2, 5000), mixed)]
        assert abs(pu_quality.prior_of(*counts) - share) < 0.06


def test_risk_gradient_lowers_the_risk():
    rng = np.random.default_rng(9)
    good = rng.normal(1, 0.5, (500, len(docstats.FEATURES)))
    web = np.concatenate([rng.normal(1, 0.5, (900, good.shape[1])), rng.normal(-1, 0.5, (600, good.shape[1]))])
    inputs = pu_quality._inputs(web)
    net = pu_quality.Network(inputs.mean(axis=0), inputs.std(axis=0) + 1e-9)
    net.fit(good, web, 0.6, 0.01, 0)
    assert ((net.score(web) > 0.5) == (np.arange(1500) < 900)).mean() > 0.97
    again = pu_quality.Network(net.mean, net.scale)
    again.put(net.flat())
    assert (again.score(web) == net.score(web)).all()


def test_flat_trees_equal_a_walk():
    rng = np.random.default_rng(10)
    x = rng.uniform(0, 1, (800, 3))
    f = trees.fit(x, (x[:, 0] + x[:, 1] * x[:, 2] > 0.8).astype(float), np.array([1, 0, 0]), trees=9)
    for row, got in zip(x[:60], f.raw(x[:60])):
        total = f.bias
        for feature, cut, value in zip(f.feature, f.cut, f.value):
            k = 0
            while k < len(feature):
                k = 2 * k + 1 + int(row[feature[k]] > cut[k])
            total += value[k - len(feature)]
        assert abs(total - got) < 1e-12


def test_repair_round_trip():
    rng = np.random.default_rng(3)
    for n in (0, 1, 2, 10, 50_000):
        ids = rng.zipf(1.3, n).clip(1, 60_000).astype(np.int32)
        ids[rng.integers(0, max(n, 1), n // 50)] = token_files.END
        ids = np.append(ids, token_files.END).astype(np.int32)
        symbols, rules, length = token_files.repair(ids)
        assert (token_files.expand(symbols, rules) == ids).all()
        assert all(len(token_files.expand(np.array([token_files.FIRST_RULE + k], np.int32), rules)) == length[k] for k in range(min(len(rules), 50)))
    runs = np.append(np.full(999, 7), token_files.END).astype(np.int32)
    symbols, rules, _ = token_files.repair(runs)
    assert (token_files.expand(symbols, rules) == runs).all() and len(symbols) < 200


def repeats(symbols):
    """Uses of each pair, overlaps and the end id aside."""
    found, last = Counter(), {}
    for i, pair in enumerate(zip(symbols[:-1].tolist(), symbols[1:].tolist())):
        if token_files.END not in pair and last.get(pair) != i - 1:
            found[pair] += 1
            last[pair] = i
    return found


def test_repair_leaves_no_pair_twice():
    rng = np.random.default_rng(5)
    cases = [rng.integers(0, 4, n) for n in range(60)] + [np.tile(rng.integers(0, 50_000, 3000), 2), rng.zipf(1.3, 20_000).clip(1, 60_000)]
    for case in cases:
        ids = np.append(case, token_files.END).astype(np.int32)
        ids[rng.random(len(ids)) < 0.0005] = token_files.END
        symbols, rules, length = token_files.repair(ids)
        assert (token_files.expand(symbols, rules) == ids).all() and (length == token_files._lengths(rules)).all()
        assert max(repeats(symbols).values(), default=0) < 2
    copies = np.concatenate([np.append(rng.permutation(40_000)[:5000], token_files.END)] * 2).astype(np.int32)
    copies[5001:] = copies[:5001]
    symbols, _, length = token_files.repair(copies)
    assert len(symbols) == 4 and length.max() == 5000


def test_blocks_are_smaller_than_plain_ids():
    """Symbols, rules and lengths together take less than two bytes a token, and come back."""
    rng = np.random.default_rng(6)
    for width in (1, 2, 7, 8, 17, 20):
        values = rng.integers(0, 1 << width, 300_001).astype(np.int32)
        raw = np.frombuffer(token_files.pack_bits(values, width), np.uint8)
        assert len(raw) == (len(values) * width + 7) // 8 and (token_files.unpack_bits(raw, width, len(values)) == values).all()
    phrases = [rng.integers(0, 49_000, rng.integers(1, 9)) for _ in range(4000)]
    docs = [np.append(np.concatenate([phrases[k] for k in rng.zipf(1.2, 300).clip(1, 4000) - 1]), token_files.END) for _ in range(200)]
    ids, sizes = np.concatenate(docs).astype(np.int32), np.array([len(d) for d in docs])
    raw = token_files.pack(ids, sizes, pa.array([None, *range(1, 200)], pa.int64()))
    assert len(raw) < 2 * len(ids)
    block = token_files.Block(raw)
    assert (block.tokens() == np.where(ids == token_files.END, token_files.END_ID, ids)).all() and block.n_tokens.tolist() == sizes.tolist()
    assert block.valid.tolist() == [False] + [True] * 199 and (block.document(7) == np.where(docs[7] == token_files.END, token_files.END_ID, docs[7])).all()
    for few in ([], [token_files.END], [5, 5, 5, 5, token_files.END]):
        own = np.array(few, np.int32)
        assert token_files.Block(token_files.pack(own, np.array([len(own)] if few else []), pa.array([1] if few else [], pa.int64()))).tokens().tolist() == [2 if x == token_files.END else x for x in few]


def test_a_block_is_read_in_runs_of_documents():
    """What is held beside an opened block does not grow with its tokens, nor is it kept beside what a writer learnt."""
    rng, peaks = np.random.default_rng(9), []
    for n_docs in (1000, 3000):
        sizes = np.full(n_docs, 400)
        sizes[5] = 1
        ids = np.concatenate([np.append(rng.integers(3, 60, n - 1) // rng.integers(1, 9, n - 1) + 3, token_files.END) for n in sizes]).astype(np.int32)
        raw = token_files.pack(ids, sizes, pa.array(range(n_docs), pa.int64()))
        blocks = [pa.RecordBatch.from_arrays([pa.array([0], pa.int32()), pa.array([0], pa.int32()), pa.array([raw], pa.binary())], names=["part", "seq", "block"])]
        token_files._encoders["learnt"] = None
        tracemalloc.start()
        (read,) = token_files._read(iter(blocks))
        peaks.append(tracemalloc.get_traced_memory()[1])
        tracemalloc.stop()
        assert not token_files._encoders
        want = np.where(ids == token_files.END, token_files.END_ID, ids).astype("<u4")
        assert read.column("ids_crc32").to_pylist() == [zlib.crc32(x.tobytes()) for x in np.split(want, np.cumsum(sizes)[:-1])]
        assert read.column("n_tokens").to_pylist() == sizes.tolist() and read.column("inner").to_pylist() == (np.cumsum(sizes) - sizes).tolist()
    assert (peaks[1] - peaks[0]) / 800_000 < 15  # bytes a token


class _Once(bytes):
    """A piece that may not be taken apart alone."""

    def decode(self, *_):
        raise AssertionError("decoded alone")


def test_pieces_of_one_class_are_decoded_together():
    import tokenizers

    library, encoder = tokenizers.Tokenizer.from_file(token_files.default_tokenizer()), token_files.Encoder(token_files.default_tokenizer())
    words = ["a", "word", "7", "<>&", "Ċ", "ĠĊčß", "ÉÀÖŁƒ", "Ɏȿɀ", "".join(map(chr, range(0x180, 0x1C0))), "x" * 300]
    got = encoder._ids([_Once(w.encode()) for w in words], np.ones(len(words), bool))
    assert got == [library.encode(w, add_special_tokens=False).ids for w in words]
    assert encoder._ids([], np.zeros(0, bool)) == []


def test_token_files(spark, odd, none, tmp_path):
    tokenizers = pytest.importorskip("tokenizers")
    path = token_files.default_tokenizer()
    library = tokenizers.Tokenizer.from_file(path)
    blocks = token_files.write_tokens(odd, path, str(tmp_path / "b"))
    rows = sorted(token_files.read_digests(blocks).collect(), key=lambda r: r["start"])
    order = sorted(ODD, key=lambda r: (r[0] is not None, r[0] or 0, r[1] or ""))
    at = 0
    for r, (doc, text, _) in zip(rows, order, strict=True):
        ids = [*library.encode(text or "", add_special_tokens=False).ids, 2]
        assert (r["doc_id"], r["start"], r["n_tokens"], r["ids_crc32"]) == (doc, at, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes()))
        at += len(ids)
    block = token_files.Block(bytes(blocks.orderBy("part", "seq").first()["block"]))
    whole = block.tokens()
    ends = np.cumsum(block.n_tokens)
    for k in range(len(ends)):
        own = whole[ends[k] - block.n_tokens[k] : ends[k]]
        assert (block.document(k) == own).all() and (block.document(k, 3, 9) == own[3:9]).all()
    assert token_files.read_digests(token_files.write_tokens(none, path, str(tmp_path / "e"))).count() == 0


def test_pieces_equal_the_library():
    tokenizers = pytest.importorskip("tokenizers")
    library, encoder = tokenizers.Tokenizer.from_file(token_files.default_tokenizer()), token_files.Encoder(token_files.default_tokenizer())
    texts = ["it's a TEST's l'été d'un <|endoftext|> x", "Ａ１２ ½ İstanbul ΣΑΣ", "a b c\x0be\x0cf", "né́e … “q”,”", "12ab3 don't x'S ''s", "×÷é, ß!¡ ñ́ é,a", "<|startoftext|>hi<|x", "日本語、。a", "\x00a\x01b\x7f!", ""]
    texts += [f"x{chr(c)}a {chr(c)}9.{chr(c)}{chr(c)}A{chr(c)}! {chr(c)}́" for c in range(0x21, 0x250)]
    ids, size = encoder.encode(pa.array(texts))
    at = 0
    for t, n in zip(texts, size.tolist()):
        assert ids[at : at + n - 1].tolist() == library.encode(t, add_special_tokens=False).ids, t
        at += n


def test_special_tokens_keep_their_case():
    tokenizers = pytest.importorskip("tokenizers")
    library, encoder = tokenizers.Tokenizer.from_file(token_files.default_tokenizer()), token_files.Encoder(token_files.default_tokenizer())
    texts = ["A <|ENDOFTEXT|> b", "a <|endoftext|> b", "<|StartOfText|>Hi", "<|startoftext|>Hi", "IT <| x", "it <| X", "A <|EndOfText|> b", "plain A"]
    for rows in (texts, texts[::-1]):
        ids, size = encoder.encode(pa.array(rows))
        assert [x.tolist() for x in np.split(ids, np.cumsum(size))[:-1]] == [[*library.encode(t, add_special_tokens=False).ids, token_files.END] for t in rows]


def brute_tokens(model, word):
    best = [(0.0, 0)] + [(-1e18, 0)] * len(word)
    for d in range(1, len(word) + 1):
        n = len(word[d - 1].encode())
        options = [(best[d - 1][0] - trie_counts.BYTE_COST * n, -(best[d - 1][1] + n))]
        options += [(best[a][0] + model.scores[word[a:d]], -(best[a][1] + 1)) for a in range(d) if word[a:d] in model.scores]
        top = max(options)
        best[d] = (top[0], -top[1])
    return best[-1][1]


def test_trie_counts(spark, odd, none):
    scores = {p: -float(k + 1) for k, p in enumerate(["▁", "a", "▁al", "pha", "be", "ta", "ga", "mma", "l", "m", "al", "▁alp", "ha", "alpha1", "1", "2"])}
    model = trie_counts.Unigram(scores)
    words = sorted({"▁" + w for w in prose(1, 300).split()} | {"▁", "é", "▁alpha12", "▁alpha1", "zz"})
    assert model.counts(words) == [brute_tokens(model, w) for w in words]
    prefixes = {w[:d] for w in words for d in range(1, min(len(w), trie_counts.DEPTH) + 1)}
    assert model.nodes == len(prefixes)  # a shared prefix is one node

    def terminals(node):
        return (node[trie_counts.TERMINAL] is not None) + sum(map(terminals, (node[trie_counts.CHILDREN] or {}).values()))

    assert terminals(model.root) == len(words)
    kept, trie_counts.MOST_NODES = trie_counts.MOST_NODES, 20
    try:
        assert model.counts(words[::-1]) == [brute_tokens(model, w) for w in words[::-1]] and model.nodes < 40
    finally:
        trie_counts.MOST_NODES = kept
    deep = "▁al" * 40 + "é" * 30
    assert model.counts([deep, deep[:-1]]) == [brute_tokens(model, deep), brute_tokens(model, deep[:-1])]
    pytest.importorskip("sentencepiece")
    path = trie_counts.default_model()
    public = trie_counts.Unigram.load(path)
    rows = trie_counts.token_counts(odd, path).collect()
    assert len(rows) == len(ODD)
    got = {r["doc_id"]: r for r in rows if r["doc_id"] in (8, 2, 5)}
    want = sum(brute_tokens(public, w) for w in ("▁one", "▁two"))
    assert (got[8]["n_pretokens"], got[8]["n_tokens"], got[5]["n_tokens"]) == (2, want, 0)
    assert trie_counts.token_counts(none, path).count() == 0


def brute_pretokens(text):
    """Cut byte by byte where the classes of two neighbours differ."""

    def kind(c):
        if c in " \t\n\r":
            return "blank"
        if c.isascii() and c.isalnum():
            return "digit" if c.isdigit() else "letter"
        if "\u00c0" <= c <= "\u024f" and c not in "×÷İ":
            return "letter"
        return "symbol" if " " < c < "\x7f" and c != "'" else "other"

    found, lead, last = [], True, "blank"
    for c in text:
        k = kind(c)
        if k != "blank":
            joined = last == k != "digit" or (last != "blank" and "other" in (last, k))
            if joined:
                found[-1] += c
            else:
                found.append(("▁" if lead else "") + c)
        lead, last = c in " \t\n\r\x0b\x0c", k
    return found


def bounded_tokens(model, word):
    best, longest = [(0.0, 0)], max(map(len, model.scores))
    for d in range(1, len(word) + 1):
        n = len(word[d - 1].encode())
        options = [(best[d - 1][0] - trie_counts.BYTE_COST * n, -(-best[d - 1][1] + n))]
        options += [(best[a][0] + model.scores[word[a:d]], best[a][1] - 1) for a in range(max(0, d - longest), d) if word[a:d] in model.scores]
        best.append(max(options))
    return -best[-1][1]


def test_trie_counts_of_whole_texts(spark):
    """Every odd text, and long ones with a special token's opening, which op7 does not know."""
    pytest.importorskip("sentencepiece")
    model = trie_counts.Unigram.load(trie_counts.default_model())
    texts = [t for _, t, _ in ODD] + ["if a <| b 12 then", "<|user|> hi\n" + prose(9, 3000) + " <|endoftext|> end", "<|", "<| "]
    pre, tokens = model.per_row(pa.array(texts, pa.string()))
    sizes = {}
    for t, n, k in zip(texts, pre.tolist(), tokens.tolist(), strict=True):
        words = brute_pretokens(t or "")
        for w in set(words) - set(sizes):
            sizes[w] = bounded_tokens(model, w)
        assert (n, k) == (len(words), sum(sizes[w] for w in words)), (t or "")[:50]


SAID = "<|im_end|><|im_start|>assistant ok"
TALKS = [(1, 0, "system", "be\\ good"), (1, 1, "user", "a<|b"), (1, 2, "assistant", SAID), (1, 3, "user", None), (1, 4, "assistant", "\\|<\\|\\\\"), (1, 5, "user", "bye\n"), (2, 0, "user", "alone"), (None, 0, None, None), (None, None, "assistant", "x"), (3, 0, "as\nsist<|\\", "é日"), (3, 0, "assistant", ""), (3, 0, "assistant", "")]


def test_chat(spark):
    import hashlib

    df = spark.createDataFrame(TALKS, "conv_id long, turn long, role string, text string").withColumn("example", F.lit(1))
    made = chat_format.expanded(df)
    assert made.where("conv_id = 1").count() == 3 and made.where("conv_id = 1 and loss_chars is null").count() == 1
    got = {r["conv_id"]: r for r in chat_format.read_back(made).collect()}
    for conv in (1, 2, 3, None):
        turns = sorted(((t if t is not None else -1, r or "", x or "") for c, t, r, x in TALKS if c == conv))
        flat = "".join(f"{r}\n{x}\n" for _, r, x in turns)
        loss = "".join(x for _, r, x in turns if r == "assistant")
        r = got[conv]
        assert (r["n_turns"], r["turns_sha256"], r["loss_chars"], r["loss_sha256"]) == (len(turns), hashlib.sha256(flat.encode()).hexdigest(), len(loss), hashlib.sha256(loss.encode()).hexdigest())
    assert chat_format.read_back(chat_format.expanded(df.where("false"))).count() == 0
