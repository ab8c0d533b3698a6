"""Homes written by queries: of bounded size, and read side by side."""

import glob
import json
import os
import sqlite3

import duckdb
import pandas as pd
import pytest

from quillmeter.plans import homes, record_queries, testdata
from quillmeter.plans.read_usage import read_usage
from quillmeter.plans.testdata import usage
from quillmeter.sources import scan
from quillmeter.sources.kit import Context, Reader
from quillmeter.sources.readers import REGISTRY

DATA = "/root/testdata/sf0.001"
WHOLE = sorted(a for a, h in homes.HOMES.items() if h.whole)
have_data = pytest.mark.skipif(not os.path.isdir(DATA), reason="no test tables")


@have_data
@pytest.mark.parametrize("agent", WHOLE)
def test_stores_have_a_bounded_number_of_sessions(spark, tmp_path, monkeypatch, agent):
    monkeypatch.setattr(homes, "HOME_EVENTS", 300)
    events = usage(spark, DATA)
    roots = homes.write_home(events, agent, str(tmp_path))
    assert len(roots) == -(-events.count() // 300) > 1
    stores = [p for p in glob.glob(f"{tmp_path}/**", recursive=True, include_hidden=True) if p.endswith((".db", ".sqlite", ".sqlite3"))]
    assert len(stores) >= len(roots) and not glob.glob(f"{tmp_path}/**/*.part", recursive=True, include_hidden=True)
    found = read_usage(spark, [Context(r, cwd=r) for r in roots], [agent]).events
    assert found.select("session_id").distinct().count() >= events.select("session_id").distinct().count()


def test_kimi_logs_are_units_with_the_configuration(spark, tmp_path):
    line = {"type": "usage.record", "usageScope": "turn", "id": "m", "time": 1_700_000_000_000, "usage": {"input": 1, "output": 2}}
    for s in ("a", "b"):
        at = tmp_path / ".kimi" / "sessions" / "h" / s / "wire.jsonl"
        at.parent.mkdir(parents=True)
        at.write_text(json.dumps(line))
    (tmp_path / ".kimi" / "config.json").write_text('{"model": "x/k-9"}')
    files = REGISTRY["kimi"].find(Context(str(tmp_path)))
    assert len({f.unit for f in files}) == 2
    assert sorted((r.session_id, r.model) for r in read_usage(spark, Context(str(tmp_path)), ["kimi"]).events.collect()) == [("a", "k-9"), ("b", "k-9")]


def test_kiro_turns_of_other_projects_are_no_copies(spark, tmp_path):
    at = tmp_path / ".kiro" / "data.sqlite3"
    at.parent.mkdir()
    turn = {"user": {"content": {"Prompt": {"prompt": "p" * 80}}, "timestamp": "2026-01-01T00:00:00Z"}, "assistant": {"Response": {"content": "ok" * 40}}}
    with sqlite3.connect(at) as c:
        c.execute("CREATE TABLE conversations (key, value)")
        c.executemany("INSERT INTO conversations VALUES (?, ?)", [(k, json.dumps({"model": "m", "history": [turn, turn]})) for k in ("/w/a", "/w/b")])
    c.close()
    assert read_usage(spark, Context(str(tmp_path)), ["kiro"]).events.count() == 4


@have_data
def test_catalogs_are_of_bounded_size(spark, monkeypatch):
    monkeypatch.setattr(record_queries, "CATALOG_USERS", 5)
    for kind in ("litellm", "openrouter"):
        sizes = [len(json.loads(r.payload)) if kind == "litellm" else len(json.loads(r.payload)["data"]) for r in record_queries._payloads(spark, DATA, kind).collect()]
        assert max(sizes) <= 5 and len(sizes) > 5


IDLE = ["augment", "cline", "codebuff", "deepseek", "fx", "gemini", "grok", "jcode", "kilocode", "reasonix", "roo", "zcode", "junie", "codex", "qwen", "openclaw", "kimi", "devin", "cherrystudio", "mux"]


@pytest.fixture(scope="module")
def idle_events(tmp_path_factory):
    """Events of which some saw nothing: larger tables have a few."""
    folder = tmp_path_factory.mktemp("idle")
    k = "CASE WHEN event_id % 74 = 0 THEN '{\"k\": 0}' ELSE props END"
    duckdb.sql(f"COPY (SELECT event_id, ts, user_id, event_type, CASE WHEN event_id % 37 = 0 THEN 0.0 ELSE value END AS value, {k} AS props FROM '{DATA}/events.parquet') TO '{folder}/events.parquet' (FORMAT parquet)")
    return str(folder)


@have_data
@pytest.mark.parametrize("agent", IDLE)
def test_records_of_no_tokens_are_events_where_asked_for(spark, idle_events, agent):
    c = duckdb.connect()
    c.execute(f"CREATE VIEW events AS SELECT * FROM '{idle_events}/events.parquet'")
    got, owed = testdata.queries()[f"reader_{agent}"](spark, idle_events).toPandas(), c.execute(testdata.oracle_sql()[f"reader_{agent}"]).df()
    plain = lambda df: sorted(str([None if pd.isna(v) else v for v in r]) for r in df[sorted(owed.columns)].astype(object).itertuples(index=False, name=None))
    assert plain(got) == plain(owed)


@have_data
def test_grok_events_of_one_instant_are_told_apart(spark, tmp_path):
    """A session with the same events again, at the same instants and under ids of their own, has them all."""
    duckdb.sql(f"COPY (SELECT event_id + r * 1000000 AS event_id, ts, user_id, event_type, value, props FROM '{DATA}/events.parquet', range(2) t(r) WHERE event_id < 300) TO '{tmp_path}/events.parquet' (FORMAT parquet)")
    got = testdata.queries()["reader_grok"](spark, str(tmp_path))
    owed = usage(spark, str(tmp_path))
    assert got.count() == owed.count() == 600 and got.where("turn").count() == owed.where("turn").count()


def test_records_of_no_tokens_are_left_out_else(spark, tmp_path):
    at = tmp_path / ".zcode" / "projects" / "p" / "s.jsonl"
    at.parent.mkdir(parents=True)
    at.write_text(json.dumps({"role": "assistant", "id": "m", "timestamp": "2026-01-01T00:00:00Z", "usage": {"input": 0, "output": 0}}))
    counts = [read_usage(spark, Context(str(tmp_path)), ["zcode"], idle=i).events.count() for i in (False, True)]
    assert counts == [0, 1]


def test_many_small_logs_are_few_tasks(spark, tmp_path):
    """A task reads more than the 32 files that Spark's own cost of opening one allows, and listing changes no setting."""
    name = "spark.sql.sources.parallelPartitionDiscovery.parallelism"
    before = spark.conf.get(name)
    for k in range(400):
        at = tmp_path / ".zcode" / "projects" / "p" / f"s{k}.jsonl"
        at.parent.mkdir(parents=True, exist_ok=True)
        at.write_text(json.dumps({"role": "assistant", "id": f"m{k}", "timestamp": "2026-01-01T00:00:00Z", "usage": {"input": 1, "output": k}}))
    rows = scan.parsed(spark, REGISTRY["zcode"], Context(str(tmp_path)))
    assert rows.rdd.getNumPartitions() <= 8 and rows.count() == 400
    assert spark.conf.get(name) == before


SESSION_LOGS = ["codex", "kilocode", "codebuddy", "pi", "omp", "kimchi", "claude", "grok", "cline"]


@have_data
@pytest.mark.parametrize("agent", SESSION_LOGS)
def test_logs_are_dealt_to_homes_that_the_driver_does_not_list(spark, monkeypatch, agent):
    monkeypatch.setattr(homes, "HOME_EVENTS", 300)

    def listed(*_):
        raise AssertionError("the driver holds a list of all files")

    monkeypatch.setattr(Reader, "files", listed)
    c = duckdb.connect()
    c.execute(f"CREATE VIEW events AS SELECT * FROM '{DATA}/events.parquet'")
    got, owed = testdata.queries()[f"reader_{agent}"](spark, DATA).toPandas(), c.execute(testdata.oracle_sql()[f"reader_{agent}"]).df()
    plain = lambda df: sorted(str([None if pd.isna(v) else v for v in r]) for r in df[sorted(owed.columns)].astype(object).itertuples(index=False, name=None))
    assert plain(got) == plain(owed)


def test_lines_of_several_homes_are_those_of_their_logs(spark, tmp_path):
    """Broken bytes, blank lines and a folder without logs are as in one home."""
    said = json.dumps({"type": "message", "id": "m", "timestamp": "2026-01-01T00:00:00Z", "message": {"role": "assistant", "model": "x", "usage": {"input": 1, "output": 2, "cacheRead": 0, "cacheWrite": 0}}})
    for k, data in enumerate((said.encode() + b"\n\n\xff\xfe{\n", b"", said.encode().replace(b'"m"', b'"n"'))):
        at = tmp_path / f"h{k}" / ".pi" / "agent" / "sessions" / "s +%.jsonl"
        at.parent.mkdir(parents=True)
        at.write_bytes(data)
    (tmp_path / "h3").mkdir()
    each = [Context(str(tmp_path / f"h{k}")) for k in range(4)]
    plain = lambda df: sorted(map(str, df.drop("seq").collect() if "seq" in df.columns else df.collect()))
    whole, parts = read_usage(spark, each, ["pi"]), [read_usage(spark, h, ["pi"]) for h in each]
    assert plain(whole.events) == sorted(x for p in parts for x in plain(p.events)) and whole.events.count() == 2
    assert plain(whole.diagnostics) == sorted(x for p in parts for x in plain(p.diagnostics)) and whole.skipped.count() == 1
