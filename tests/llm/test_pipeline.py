"""The five stages over small tables, and the registered queries against their SQL."""

import os
import re
import zlib
from collections import Counter

import duckdb
import pandas as pd
import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from conftest_llm import prose
from quillmeter.llm import registry, token_files, toxicity
from test_pairs_and_joins import brute_groups, brute_targets, shingles

DATA = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(DATA), reason="no test tables")


LOW = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
CLASH = ("row", "id", "version", "_hit", "_gone", "_twice", "_p_n", "_p_taken", "whole", "cuts")


def clean_of(rows, items):
    """Rows that hold no window of an item."""
    cut = lambda t: re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", (t or "").translate(LOW))
    windows = {tuple(w[i : i + 10]) for w in map(cut, items) for i in range(max(1, len(w) - 9)) if w}
    lengths = {len(w) for w in windows}
    hit = lambda w: any(tuple(w[i : i + n]) in windows for n in lengths for i in range(len(w) - n + 1))
    return [r for r in rows if not hit(cut(r["text"]))]


def firsts_of(rows):
    """The rows that stay of each near-duplicate group, once each."""
    least = {}
    for (d, n, c), times in brute_groups([(r["doc_id"], r["text"]) for r in rows]).items():
        least.setdefault((d, n), set()).add(c)
    assert all(len(c) == 1 for c in least.values())
    return {(r["doc_id"], r["text"]) for r in rows if least[r["doc_id"], len(shingles(r["text"]))] == {r["doc_id"]}}


def test_stages_against_brute_force(spark, tmp_path):
    """Each stage on what the one before kept, with odd rows and columns whose names operators use."""
    tokenizers = pytest.importorskip("tokenizers")
    docs = spark.read.parquet(f"{DATA}/documents.parquet")
    odd = [(9000, "", "s"), (9001, None, None), (None, prose(70, 30), "s"), (None, None, None), (9002, prose(71, 40), "s"), (9003, prose(71, 40), "s"), (9002, prose(72, 45), "s"), (9004, "Is it\t so?\n no", "")]
    extra = spark.createDataFrame([(d, t, "en", s, len(t or "")) for d, t, s in odd], "doc_id long, text string, lang string, source string, n_chars long").select(*[F.col(c).cast(docs.schema[c].dataType) for c in docs.columns])
    docs = docs.unionByName(extra).withColumns({c: F.lit(c) for c in CLASH})
    names, columns = [n for n, _ in corpus_pipeline.STAGES], docs.columns
    assert names == ["toxicity", "near_dedup", "decontamination", "mixing", "token_ids"]
    before = [r.asDict() for r in docs.collect()]
    shown = lambda rows: Counter((r["doc_id"], r["text"], r["source"]) for r in rows)
    for name, stage in corpus_pipeline.STAGES:
        stage(spark, docs, DATA).write.parquet(str(tmp_path / name))
        docs = spark.read.parquet(str(tmp_path / name))
        after = [r.asDict() for r in docs.collect()]
        if name != "token_ids":
            assert docs.columns == columns and all(r[c] == c for r in after for c in CLASH)
        if name == "toxicity":
            labels = spark.read.parquet(f"{DATA}/labels.parquet")
            model = toxicity.fit(spark.createDataFrame([(r["doc_id"], r["text"]) for r in before], "doc_id long, text string"), labels)
            scores = model.score(pa.array([r["text"] for r in before], pa.string()))
            assert shown(after) == shown([r for r, s in zip(before, scores) if s < toxicity.REJECT]) and 0 < len(after) < len(before)
        if name == "near_dedup":
            assert Counter((r["doc_id"], r["text"]) for r in after) == Counter(firsts_of(before)) and 0 < len(after) < len(before)
        if name == "decontamination":
            items = [r["text"] for r in spark.read.parquet(f"{DATA}/benchmark.parquet").collect()]
            assert shown(after) == shown(clean_of(before, items)) and 0 < len(after) < len(before)
        if name == "mixing":
            sizes = Counter()
            for r in before:
                sizes[r["source"]] += len((r["text"] or "").split())
            want, took, words = brute_targets(dict(sizes)), Counter(), {}
            for r in before:
                words[r["doc_id"], r["source"]] = words.get((r["doc_id"], r["source"]), Counter()) + Counter((r["text"] or "").split())
            for r in after:
                took[r["source"]] += len(r["text"].split())
                assert r["n_chars"] == len(r["text"])
                assert not Counter(r["text"].split()) - words[r["doc_id"], r["source"]]  # an epoch takes a word of a document once at most
            assert all(abs(took[s] - want[s]) <= 1 for s in want)
        if name == "token_ids":
            library, at = tokenizers.Tokenizer.from_file(token_files.default_tokenizer()), 0
            want = sorted(before, key=lambda r: (r["doc_id"] is not None, r["doc_id"] or 0, r["text"] or ""))
            for r, d in zip(sorted(after, key=lambda r: r["start"]), want, strict=True):
                ids = [*library.encode(d["text"] or "", add_special_tokens=False).ids, 2]
                assert (r["doc_id"], r["start"], r["n_tokens"], r["ids_crc32"]) == (d["doc_id"], at, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes()))
                at += len(ids)
        before = after


def test_stages_on_nothing(spark):
    for _, stage in corpus_pipeline.STAGES:
        assert stage(spark, spark.read.parquet(f"{DATA}/documents.parquet").where("false"), DATA).count() == 0


@pytest.mark.parametrize("name", sorted(registry.oracle_sql()))
def test_sql(spark, name):
    c = duckdb.connect()
    for f in os.listdir(DATA):
        c.execute(f"CREATE VIEW {f.split('.')[0]} AS SELECT * FROM '{DATA}/{f}'")
    want = c.execute(registry.oracle_sql()[name]).df()
    got = registry.queries()[name](spark, DATA).toPandas()[list(want.columns)]
    cell = lambda v: None if pd.isna(v) else float(v) if isinstance(v, (int, float)) and not isinstance(v, bool) else v
    plain = lambda df: sorted(str(tuple(cell(v) for v in r)) for r in df.astype(object).itertuples(index=False, name=None))
    assert plain(got) == plain(want)
