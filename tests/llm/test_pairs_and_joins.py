"""Near duplicates, decontamination, url rules and mixing against brute force."""

import hashlib
import random
import re
from collections import Counter
from itertools import combinations

import numpy as np
import pytest
from pyspark.sql import functions as F

from conftest_llm import ODD, prose
from quillmeter.llm import bloom_cascade, circulant_minhash, components, mixing, prefix_join

LOW = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def shingles(text):
    w = re.findall(r"[^\x20\x09-\x0D]+", (text or "").translate(LOW))
    return {tuple(w)} if 0 < len(w) < 5 else {tuple(w[i : i + 5]) for i in range(len(w) - 4)}


def brute_groups(rows):
    sets = [shingles(t) for _, t in rows]
    root = list(range(len(rows)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for i, j in combinations(range(len(rows)), 2):
        both = len(sets[i] & sets[j])
        if both and 100 * both >= 75 * len(sets[i] | sets[j]):
            root[max(find(i), find(j))] = min(find(i), find(j))
    least = {}
    for i, (d, _) in enumerate(rows):
        if sets[i] and d is not None:
            least[find(i)] = min(d, least.get(find(i), d))
    return Counter((d, len(sets[i]), least.get(find(i)) if sets[i] else d) for i, (d, _) in enumerate(rows))


def found_groups(df):
    return Counter((r["doc_id"], r["n_shingles"], r["component_id"]) for r in circulant_minhash.near_duplicates(df).collect())


def test_near_duplicates_odd(odd, none):
    assert found_groups(odd) == brute_groups([(d, t) for d, t, _ in ODD])
    assert circulant_minhash.near_duplicates(none).count() == 0
    kept = circulant_minhash.one_of_each(odd)
    assert kept.columns == odd.columns
    ids = Counter(r["doc_id"] for r in kept.collect())
    clash = odd.withColumns({c: F.lit(c) for c in ("id", "row", "blank", "_gone", "_twice", "_gone_version")})
    again = circulant_minhash.one_of_each(clash)
    assert again.columns == clash.columns and all(r["_gone"] == "_gone" and r["row"] == "row" for r in again.collect())
    assert Counter(r["doc_id"] for r in again.collect()) == ids
    assert ids[1] == 1 and ids[2] == 0 and ids[9] == ids[10] == 0 and ids[8] == 1 and ids[3] == 2 and ids[4] == 1


def test_one_of_each_judges_rows_not_ids(spark):
    """Null and repeated ids lose only the rows that are copies."""
    rows = [(d, t) for d, t, _ in ODD] + [(None, prose(50, 40)), (None, ""), (2, prose(51, 40)), (2, None), (20, prose(52, 40)), (30, prose(52, 40)), (30, prose(53, 45))]
    left = circulant_minhash.one_of_each(spark.createDataFrame(rows, "doc_id long, text string"))
    groups = {(d, len(shingles(t)), c) for d, t in rows for (e, n, c) in brute_groups(rows) if (d, len(shingles(t))) == (e, n)}
    ambiguous = Counter((d, n) for d, n, _ in groups)
    assert max(ambiguous.values()) == 1
    least = {(d, n): c for d, n, c in groups}
    want = {(d, t) for d, t in rows if least[d, len(shingles(t))] == d}
    assert Counter((r["doc_id"], r["text"]) for r in left.collect()) == Counter(want)
    assert (None, None) in want and (None, prose(50, 40)) in want and (None, prose(2, 30)) not in want


def test_decontamination_judges_rows_not_ids(spark):
    item = prose(60, 12)
    clean = [(None, None), (None, ""), (None, prose(61, 30)), (1, prose(62, 30)), (1, None), (2, prose(63, 30))]
    dirty = [(None, f"a {item} b"), (1, item), (3, item.upper())]
    docs = spark.createDataFrame(clean + dirty, "doc_id long, text string")
    left = prefix_join.without_contaminated(docs, spark.createDataFrame([(1, item)], "item_id long, text string"))
    assert Counter((r["doc_id"], r["text"]) for r in left.collect()) == Counter(clean)


@pytest.mark.parametrize("small", [False, True])
def test_near_duplicates_chains_and_groups(spark, monkeypatch, small):
    """Also with hubs of few members, small blocks and no broadcast."""
    if small:
        monkeypatch.setattr(circulant_minhash, "HUB_MEMBERS", 3)
        monkeypatch.setattr(circulant_minhash, "BLOCK", 4)
        monkeypatch.setattr(circulant_minhash, "sized", lambda df, rows, limit=0: df)
    rng, rows = random.Random(3), []
    base = prose(99, 120).split()
    for k in range(60):  # edited copies, some near each other only through others
        w = base[:]
        for _ in range(rng.randrange(0, 9)):
            w[rng.randrange(len(w))] = f"new{rng.randrange(1000)}"
        rows.append((1000 - k, " ".join(w)))
    chain = prose(5, 100).split()
    for k in range(12):
        rows.append((k, " ".join(chain)))
        chain[8 * k % 100] = f"c{k}"
        chain[(8 * k + 4) % 100] = f"d{k}"
    rows += [(2000 + k, prose(k, 40)) for k in range(30)] + [(3000 + k, prose(7, 50)) for k in range(20)]
    assert found_groups(spark.createDataFrame(rows, "doc_id long, text string")) == brute_groups(rows)


def test_circulant_signature():
    """Coordinates are minima under one table shifted circularly, and estimate similarity."""
    rng = np.random.default_rng(1)
    a = np.unique(rng.integers(0, 2**63, 900, dtype=np.uint64) * np.uint64(2))
    b = np.unique(np.concatenate([a[:750], rng.integers(0, 2**63, 150, dtype=np.uint64)]))
    size = 1 << circulant_minhash.UNIVERSE_BITS
    pi = circulant_minhash._pi(64)[:size, 0]
    assert sorted(pi.tolist()) == list(range(size))
    slot = (a >> np.uint64(44)).astype(np.int64)
    low = circulant_minhash.signature(a, 64)
    assert all(low[k] == pi[(slot + k) % size].min().astype(np.uint8) for k in (0, 1, 37, 63))
    same = (circulant_minhash.signature(a, 1024) == circulant_minhash.signature(b, 1024)).mean()
    true = len(np.intersect1d(a, b)) / len(np.union1d(a, b))
    assert abs(same - true) < 0.08


def test_components(spark, tmp_path):
    edges = [(k, k + 1) for k in range(40)] + [(100, 300), (300, 200), (500, 501)]
    got = {r["node"]: r["label"] for r in components.components(spark.createDataFrame(edges, "a long, b long"), str(tmp_path / "c")).collect()}
    assert got == {**dict.fromkeys(range(41), 0), 100: 100, 200: 100, 300: 100, 500: 500, 501: 500}
    assert components.components(spark.createDataFrame([], "a long, b long"), str(tmp_path / "d")).count() == 0


WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def brute_hits(docs, items):
    windows = []
    for item, t in items:
        w = WORD.findall((t or "").translate(LOW))
        windows += [(item, tuple(w[i : i + min(10, len(w))])) for i in range(max(1, len(w) - 9)) if w]
    out = Counter()
    for d, t in docs:
        w, hit, ids = WORD.findall((t or "").translate(LOW)), set(), set()
        for item, g in set(windows):
            for i in range(len(w) - len(g) + 1):
                if tuple(w[i : i + len(g)]) == g:
                    hit.update(range(i, i + len(g)))
                    ids.add(str(item))
        out[d, len(w), len(hit), ",".join(sorted(ids - {"None"}))] += 1
    return out


def found_hits(docs, bench):
    return Counter((r["doc_id"], r["n_words"], r["n_hit"], ",".join(r["item_ids"])) for r in prefix_join.contamination(docs, bench).collect())


@pytest.mark.parametrize("lengths", [(14, 30, 12), (1, 2, 3, 9, 10, 11, 40)])
def test_decontamination(spark, lengths, monkeypatch):
    rng = random.Random(len(lengths))
    items = [(k, prose(1000 + k, n).upper() if k % 2 else prose(1000 + k, n)) for k, n in enumerate(lengths)]
    items += [(90, items[0][1]), (91, None), (92, "..."), (None, prose(77, 15))]
    docs = [(d, t) for d, t, _ in ODD if t is None or len(t) < 5000]
    for k in range(40):
        w = prose(k, 60).split()
        piece = rng.choice(items)[1] or ""
        cut = piece.split()[: rng.choice((8, 10, 12, 40))]
        at = rng.randrange(0, 61)
        docs.append((100 + k, rng.choice((" ", ", ", "\n")).join(w[:at] + cut + w[at:] + cut)))
    docs += docs[-3:] + [(None, docs[-1][1])] * 2
    d, b = spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string")
    want = brute_hits(docs, items)
    assert found_hits(d, b) == want
    monkeypatch.setattr(prefix_join, "INDEX_ROWS", 0)  # everything is shuffled
    monkeypatch.setattr(prefix_join, "HIT_ROWS", 0)
    assert found_hits(d, b) == want
    clash = {c: F.lit(c) for c in ("k", "version", "id", "row", "n_words", "start", "p", "_hit")}
    left = prefix_join.without_contaminated(d.withColumns(clash), b)
    clean = [(doc, t) for doc, t in docs if all(not n for (_, _, n, _) in brute_hits([(doc, t)], items))]
    assert left.columns == ["doc_id", "text", *clash] and Counter((r["doc_id"], r["text"]) for r in left.collect()) == Counter(clean)
    assert all(r[c] == c for r in left.collect() for c in clash)


def test_decontamination_empty(spark, odd, none):
    b = spark.createDataFrame([(1, prose(1, 12))], "item_id long, text string")
    assert prefix_join.contamination(none, b).count() == 0
    assert prefix_join.contamination(odd, b.where("false")).where("contaminated").count() == 0
    assert prefix_join.contamination(odd, b).count() == len(ODD)


URLS = [None, "", "no scheme", "http://", "https://Example.COM", "http://a.example.com/en/x?q=1", "http://www.example.com/en/", "http://x.www.example.com/en/a", "http://notexample.com/en/", "http://example.com/e", "ftp://u@h.net:8080/es/a#b", "http://m.net/es/", "http://net/fr/x", "http://netx/fr/", "x://com/", "http://com?x", "http://É.com/é/", "a://b://c.com/d", "http://a.\n.com/x\ny"]


def brute_rule(url):
    rest = url.split("://", 1)[1] if url and "://" in url else ""
    host = re.match(r"[^/?#]*", rest)[0]
    path = re.match(r"[^?#]*", rest[len(host) :])[0] if rest[len(host) : len(host) + 1] == "/" else ""
    host = host.translate(LOW)
    fits = [(len(h + p), len(h), h + p, v) for h, p, v in bloom_cascade.RULES if (host == h or host.endswith("." + h)) and path.startswith(p)]
    best = max(fits, default=(0, 0, None, "allow"))
    return host, path, best[2], best[3]


def rule_table(spark):
    return spark.createDataFrame(list(bloom_cascade.RULES), "host string, path string, verdict string")


@pytest.mark.parametrize(("keys", "size"), [(1 << 17, 64 << 20), (2, 64 << 20), (2, 0)])
def test_url_rules(spark, monkeypatch, keys, size):
    """One shard in the plan, several broadcast, several shuffled: the same cascade."""
    monkeypatch.setattr(bloom_cascade, "SHARD_KEYS", keys)
    monkeypatch.setattr(bloom_cascade, "FILTER_BYTES", size)
    pages = spark.createDataFrame([(k, u, 1) for k, u in enumerate(URLS)], "page_id long, url string, rule int")
    got = {r["page_id"]: (r["host"], r["path"], r["rule"], r["verdict"]) for r in bloom_cascade.judge(pages, rule_table(spark)).collect()}
    assert got == {k: brute_rule(u) for k, u in enumerate(URLS)}
    assert bloom_cascade.judge(pages.where("false"), rule_table(spark)).count() == 0
    assert {r["verdict"] for r in bloom_cascade.judge(pages, rule_table(spark).where("false")).collect()} == {"allow"}


@pytest.mark.parametrize("keys", [1 << 17, 300])
def test_cascade_is_exact(spark, tmp_path, monkeypatch, keys):
    """Many keys, so that several levels are needed, in one shard and in ten."""
    monkeypatch.setattr(bloom_cascade, "SHARD_KEYS", keys)
    universe = spark.range(20_000).select(F.concat(F.lit("k"), "id").alias("key"))
    listed = universe.where("crc32(cast(key as binary)) % 7 = 0")
    found = bloom_cascade.cascade(listed, universe, str(tmp_path / "l"))
    assert found.levels > 2 and found.shards == (1 if keys > 3000 else -(-listed.count() // keys))
    wrong = found.marked(universe, F.col("key"), "found").where("found != (crc32(cast(key as binary)) % 7 = 0)")
    assert wrong.count() == 0
    none = bloom_cascade.cascade(listed.where("false"), universe, str(tmp_path / "n"))
    assert none.marked(universe, F.col("key"), "found").where("found").count() == 0


def brute_targets(sizes):
    order = sorted(s for s in sizes if s is not None) + ([None] if None in sizes else [])
    weight = {s: (5, 2, 1)[k % 3] for k, s in enumerate(order)}
    capped, total = {}, sum(sizes.values())
    while True:
        free = [s for s in order if s not in capped]
        if not free:
            return capped
        level = (total - sum(capped.values())) / sum(weight[s] for s in free)
        over = [s for s in free if level * weight[s] > 3 * sizes[s]]
        if not over:
            return capped | {s: level * weight[s] for s in free}
        capped |= {s: 3.0 * sizes[s] for s in over}


def test_mix(spark, odd, none):
    rows = [(k, prose(k, 20 + k % 90), f"s{k % 5}" if k % 11 else None) for k in range(400)] + [(1000, None, "s0"), (1001, "", "s9"), (1, prose(1, 21), "s1")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string")
    placed, sources, slots = mixing.mix(docs)
    sizes = Counter()
    for _, t, s in rows:
        sizes[s] += len((t or "").split())
    want = brute_targets(dict(sizes))
    got = {r["source"]: r for r in sources.collect()}
    assert {s: r["source_size"] for s, r in got.items()} == dict(sizes)
    assert all(abs(got[s]["target"] - want[s]) < 1e-6 for s in want)
    used = mixing.usage(placed, slots).collect()
    assert len(used) == len(rows) and all(0 <= r["taken"] <= 3 * r["size"] for r in used)
    by_source = Counter()
    for r in used:
        by_source[r["source"]] += r["taken"]
    assert all(abs(by_source[s] - want[s]) <= 4 * mixing.BLOCK_WORDS for s in want)
    spans = sorted((str(r["source"]), r["first"], r["first"] + r["size"]) for r in placed.collect() if r["size"])
    assert all(a[2] == b[1] for a, b in zip(spans, spans[1:]) if a[0] == b[0])
    took = slots.collect()
    assert sorted(r["slot"] for r in took) == list(range(len(took)))
    each = Counter((r["source"], r["epoch"], r["block"]) for r in took)
    assert max(each.values()) == 1
    assert sorted((r["doc_id"], r["taken"]) for r in mixing.usage(*mixing.mix(docs)[::2]).collect()) == sorted((r["doc_id"], r["taken"]) for r in used)
    texts = mixing.mixed_documents(docs).groupBy("doc_id").agg(F.sum(F.size(F.split(F.trim("text"), r"\s+"))).alias("n"))
    words = Counter()
    for r in used:
        words[r["doc_id"]] += r["taken"]
    assert {r["doc_id"]: r["n"] for r in texts.collect()} == {d: n for d, n in words.items() if n}
    clash = odd.withColumns({c: F.lit(c) for c in ("_p_n", "_p_taken", "_p_cuts", "row", "id", "nth", "cuts", "whole", "sid")})
    mixed = mixing.mixed_documents(clash)
    assert mixed.columns == clash.columns and mixed.count() > 0
    assert all(r["row"] == "row" and r["_p_n"] == "_p_n" and r["n_chars"] == len(r["text"]) for r in mixed.collect())
    assert mixing.mixed_documents(none).count() == 0


def test_shards_are_multinomial_draws(spark):
    """Counts of a source in a shard have the mean and variance of the multinomial, and totals are the quotas."""
    rows = [(k, prose(k, 4000), f"s{k % 3}") for k in range(120)]
    placed, sources, slots = mixing.mix(spark.createDataFrame(rows, "doc_id long, text string, source string"))
    took = slots.groupBy("source", "shard").count().toPandas()
    total, quota = took["count"].sum(), took.groupby("source")["count"].sum()
    assert {r["source"]: -(-round(r["target"]) // 128) for r in sources.collect()} == pytest.approx(quota.to_dict(), abs=4)
    one = mixing.SHARD_SLOTS
    full = took[took["shard"] < total // one]
    for source, own in full.groupby("source"):
        p = quota[source] / total
        assert abs(own["count"].mean() - one * p) < 5 * (one * p * (1 - p) / len(own)) ** 0.5
    p = quota / total
    chi = sum((r["count"] - one * p[r["source"]]) ** 2 / (one * p[r["source"]]) for _, r in full.iterrows())
    free = 2 * (total // one)  # sources less one, for each full shard
    assert abs(chi - free) < 5 * (2 * free) ** 0.5 + 5


def test_running_totals(spark, monkeypatch):
    rows = [(k % 3, k, (7 * k) % 11) for k in range(200)]
    monkeypatch.setattr(mixing, "SPAN", 8)
    got = mixing.running(spark.createDataFrame(rows, "g long, at long, v long"), ["g"], "at", "v", "before").collect()
    assert len(got) == 200 and all(r["before"] == sum(v for g, at, v in rows if g == r["g"] and at < r["at"]) for r in got)


def test_mix_of_small_sources(spark):
    """Sources of 1 to 300 words come as near their targets as large ones."""
    sizes = {f"t{n:03}": n for n in range(1, 301, 13)} | {"t128": 128, "t129": 129, "t256": 256, "z": 40_000}
    rows = [(k, prose(k, n - n // 3), s) for k, (s, n) in enumerate(sizes.items())] + [(1000 + k, prose(k, n // 3), s) for k, (s, n) in enumerate(sizes.items())]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string")
    placed, sources, slots = mixing.mix(docs)
    taken, texts = Counter(), Counter()
    for r in mixing.usage(placed, slots).collect():
        taken[r["source"]] += r["taken"]
    for r in mixing.mixed_documents(docs).collect():
        texts[r["source"]] += len(r["text"].split())
    assert taken == texts
    for r in sources.collect():
        assert abs(taken[r["source"]] - r["target"]) <= max(0.5, 0.001 * r["target"])


def test_permutation(spark):
    for n in (1, 2, 7, 1000):
        got = [r[0] for r in spark.range(n).select(mixing.permuted(F.col("id"), F.lit(n), F.lit("t"))).collect()]
        assert sorted(got) == list(range(n))
    assert got != list(range(1000))
    assert hashlib.sha256(str(got).encode()).hexdigest() == hashlib.sha256(str([r[0] for r in spark.range(1000).select(mixing.permuted(F.col("id"), F.lit(1000), F.lit("t"))).collect()]).encode()).hexdigest()
