"""Readers over small home folders with hand-made stores."""

import json
import sqlite3

import pytest

from quillmeter.operators.rollup import rollup
from quillmeter.plans.read_usage import bound_ms, detect, detect_by_read, read_usage
from quillmeter.plans.wire import envelope, event_json
from quillmeter.sources.kit import Context
from quillmeter.sources.readers import IDS, REGISTRY


def put(path, *rows, raw=None):
    path.parent.mkdir(parents=True, exist_ok=True)
    path.write_text(raw if raw is not None else "\n".join(r if isinstance(r, str) else json.dumps(r) for r in rows))


def claude_row(ident, stamp, **more):
    usage = {"input_tokens": 10, "output_tokens": 5, "cache_read_input_tokens": 3} | more.pop("usage", {})
    return {"type": "assistant", "sessionId": "s1", "timestamp": stamp, "message": {"id": ident, "model": "claude-x", "usage": usage}, **more}


def test_registry():
    assert len(IDS) == 40 and list(REGISTRY) == IDS


def test_claude(spark, tmp_path):
    a = tmp_path / ".claude/projects/p/a.jsonl"
    put(a, {"type": "user", "message": {"content": "hi"}}, claude_row("m1", "2026-08-01T10:00:00Z", cwd="/w/"), "not json", claude_row("m2", "2026-08-01T10:00:01Z", isSidechain=True), {"type": "user", "message": {"content": [{"type": "tool_result"}]}}, claude_row("m3", "2026-08-01T10:00:02Z", usage={"input_tokens": "x"}))
    put(tmp_path / ".claude/projects/q/b.jsonl", claude_row("m1", "2026-08-01T11:00:00Z"), claude_row("m4", "nonsense"))
    u = read_usage(spark, Context(str(tmp_path)), ["claude"], tz="UTC")
    rows = {r["message_id"]: r for r in u.events.collect()}
    assert sorted(rows) == ["m1", "m2"]
    assert rows["m1"]["turn"] and rows["m1"]["workspace"] == "/w" and rows["m1"]["timestamp"].startswith("2026-08-01T10")
    assert rows["m2"]["subagent"] and not rows["m2"]["turn"]
    assert u.diagnostics.count() == 3 and u.skipped.count() == 3
    assert rollup(u.events, "model").first()["input"] == 20
    assert read_usage(spark, Context(str(tmp_path)), ["claude"], subagents="exclude").events.count() == 1
    sent = json.loads(event_json(u.events.where("message_id = 'm1'")).first()["event"])
    parts = {p: [json.loads(r["value"]) for r in envelope(u).where(f"part = '{p}'").collect()] for p in ("events", "diagnostics", "skipped")}
    assert [len(v) for v in parts.values()] == [2, 3, 3] and all(list(x) == ["claude"] for x in parts["skipped"])
    assert sorted(d["message"].split(" /")[0] for d in parts["diagnostics"]) == ["skipping malformed assistant record"] * 2 + ["skipping malformed line"]
    assert "costUsd" not in sent and sent["tokens"]["cacheRead"] == 3
    bounded = read_usage(spark, Context(str(tmp_path)), ["claude"], since="2026-08-01T10:00:01Z", until="2026-08-01", tz="UTC")
    assert [r["message_id"] for r in bounded.events.collect()] == ["m2"]


def test_codex_replay(spark, tmp_path):
    def count(stamp, i):
        return {"timestamp": stamp, "type": "event_msg", "payload": {"type": "token_count", "info": {"total_token_usage": {"input_tokens": i, "output_tokens": i // 10, "cached_input_tokens": 0}}}}

    head = {"type": "turn_context", "payload": {"model": "gpt-5"}}
    first = [head, count("2026-08-01T10:00:00Z", 100), count("2026-08-01T10:01:00Z", 150), count("2026-08-01T10:02:00Z", 150)]
    put(tmp_path / ".codex/sessions/rollout-1.jsonl", *first)
    put(tmp_path / ".codex/sessions/rollout-2.jsonl", *first[:3], count("2026-08-01T12:00:00Z", 180))
    put(tmp_path / ".codex/sessions/rollout-3.jsonl", count("2026-08-01T13:00:00Z", 7))
    u = read_usage(spark, Context(str(tmp_path)), ["codex"], tz="UTC")
    assert sorted(r["tokens"]["input"] for r in u.events.collect()) == [30, 50, 100]
    assert [r["message"] for r in u.diagnostics.collect()] == [f"codex session without turn_context model: {tmp_path}/.codex/sessions/rollout-3.jsonl"]
    # a file that only replays gives nothing, and its own keys do not count against later files
    put(tmp_path / ".codex/sessions/rollout-2a.jsonl", head, *first[1:3], {"timestamp": "2026-08-01T14:00:00Z", "type": "event_msg", "payload": first[2]["payload"]})
    put(tmp_path / ".codex/sessions/rollout-4.jsonl", head, {"timestamp": "2026-08-01T14:00:00Z", "type": "event_msg", "payload": first[2]["payload"]})
    put(tmp_path / ".codex/sessions/rollout-5.jsonl", {"type": "session_meta", "payload": {"id": "x"}})
    u = read_usage(spark, Context(str(tmp_path)), ["codex"], tz="UTC")
    assert sorted(r["tokens"]["input"] for r in u.events.collect()) == [30, 50, 100, 150] and u.diagnostics.count() == 2


def test_sqlite_and_log_lanes(spark, tmp_path):
    db = tmp_path / ".zcode/cli/db/db.sqlite"
    db.parent.mkdir(parents=True)
    with sqlite3.connect(db) as c:
        c.execute("CREATE TABLE model_usage(id, session_id, turn_id, model_id, started_at, completed_at, duration_ms, input_tokens, output_tokens, reasoning_tokens, cache_read_input_tokens, cache_creation_input_tokens)")
        c.executemany("INSERT INTO model_usage VALUES (?, 's1', 't', 'GLM-5', ?, ?, 1, 10, 6, 2, 4, 0)", [("a", 1769900000000, 1769900001000), ("b", 1769900002000, 1769900003000)])
    c.close()
    row = {"role": "assistant", "timestamp": "2026-08-01T00:00:00Z", "usage": {"input": 5, "output": 1}}
    put(tmp_path / ".zcode/projects/x.jsonl", row | {"sessionId": "s1"}, row | {"sessionId": "s2"})
    rows = read_usage(spark, Context(str(tmp_path)), ["zcode"], tz="UTC").events.collect()
    assert sorted((r["session_id"], r["tokens"]["input"], r["turn"]) for r in rows) == [("s1", 6, False), ("s1", 6, True), ("s2", 5, False)]


def test_databases(spark, tmp_path):
    kilo = tmp_path / ".local/share/kilo/kilo.db"
    kilo.parent.mkdir(parents=True)
    with sqlite3.connect(kilo) as c:
        c.execute("CREATE TABLE message(id, session_id, data)")
        m = {"role": "assistant", "modelID": "m", "time": {"created": 1769900000}, "tokens": {"input": 1, "output": 2}}
        c.executemany("INSERT INTO message VALUES (?, 's', ?)", [("1", json.dumps({"role": "user", "time": {"created": 1769899999}})), ("2", json.dumps(m)), ("3", "{"), ("4", json.dumps(m | {"tokens": {"input": -1, "output": 2}}))])
    c.close()
    goose = tmp_path / ".local/share/goose/sessions/sessions.db"
    goose.parent.mkdir(parents=True)
    with sqlite3.connect(goose) as c:
        c.execute("CREATE TABLE sessions(id, model_config_json, created_at, input_tokens, output_tokens, total_tokens, accumulated_input_tokens)")
        c.execute("INSERT INTO sessions VALUES ('g', '{\"model_name\": \"gpt\"}', '2026-01-01 00:00:00', 1, 20, 130, 100)")
    c.close()
    kiro = tmp_path / ".kiro/data.sqlite3"
    kiro.parent.mkdir(parents=True)
    with sqlite3.connect(kiro) as c:
        c.execute("CREATE TABLE conversations(key, value)")
        turn = {"user": {"content": {"Prompt": {"prompt": "x" * 400}}, "timestamp": "2026-01-01T00:00:00Z"}, "assistant": {"Response": {"content": "y" * 80}}}
        c.execute("INSERT INTO conversations VALUES ('/w', ?)", (json.dumps({"history": [turn], "model": "k"}),))
    c.close()
    ctx = Context(str(tmp_path))
    u = read_usage(spark, ctx, ["kilo", "goose", "kiro"], tz="UTC")
    got = {r["harness"]: (r["tokens"]["input"], r["tokens"]["output"], r["tokens"]["reasoning"], r["turn"]) for r in u.events.collect()}
    assert got == {"kilo": (1, 2, 0, True), "goose": (100, 20, 10, False), "kiro": (100, 20, 0, True)}
    assert u.diagnostics.count() == 2
    assert [k for k, v in detect(ctx).items() if v] == ["kilo", "goose", "kiro"]


def test_write_ahead_log(spark, tmp_path):
    """Rows that a running agent has committed to the log only."""
    kilo = tmp_path / ".local/share/kilo/kilo.db"
    kilo.parent.mkdir(parents=True)
    c = sqlite3.connect(kilo)
    c.execute("PRAGMA journal_mode = WAL")
    c.execute("CREATE TABLE message(id, session_id, data)")
    data = lambda n: json.dumps({"role": "assistant", "modelID": "m", "time": {"created": 1769900000 + n}, "tokens": {"input": n, "output": 2}})
    c.execute("INSERT INTO message VALUES ('1', 's', ?)", (data(1),))
    c.commit()
    c.execute("PRAGMA wal_checkpoint(TRUNCATE)")
    c.execute("INSERT INTO message VALUES ('2', 's', ?)", (data(2),))
    c.commit()
    try:
        assert (tmp_path / ".local/share/kilo/kilo.db-wal").stat().st_size
        u = read_usage(spark, Context(str(tmp_path)), ["kilo"], tz="UTC")
        assert sorted(r["tokens"]["input"] for r in u.events.collect()) == [1, 2] and u.diagnostics.count() == 0
    finally:
        c.close()
    assert detect_by_read(spark, Context(str(tmp_path)))["kilo"]


def test_hermes_across_stores(spark, tmp_path):
    """Models of one session in two stores: calls once, with the larger count; totals only where no store has models."""
    names = "input_tokens, output_tokens, cache_read_tokens, cache_write_tokens, reasoning_tokens"
    for place, count, usage in (("state.db", 4, [("s", "m-b", 5)]), ("profiles/p/state.db", 9, [("s", "m-a", 7), ("s", "m-b", 6), ("bad", "m-a", 1)])):
        db = tmp_path / ".hermes" / place
        db.parent.mkdir(parents=True, exist_ok=True)
        with sqlite3.connect(db) as c:
            c.execute(f"CREATE TABLE sessions(id, model, billing_provider, started_at, message_count, {names})")
            c.execute(f"CREATE TABLE session_model_usage(session_id, model, billing_provider, {names}, actual_cost_usd, estimated_cost_usd)")
            c.executemany("INSERT INTO sessions VALUES (?, 'm-a', 'pr', ?, ?, ?, 0, 0, 0, 0)", [("s", 1769900000, count, 100), ("t", 1769900000, count, 30), ("bad", None, 1, 0), ("zero", 1769900000, 1, 0)])
            c.executemany("INSERT INTO session_model_usage VALUES (?, ?, 'pr', ?, 0, 0, 0, 0, 0, 0)", usage)
        c.close()
    u = read_usage(spark, Context(str(tmp_path)), ["hermes"], tz="UTC")
    rows = sorted((r["session_id"], r["model"], r["tokens"]["input"], r["calls"]) for r in u.events.collect())
    assert rows == [("s", "pr/m-a", 7, 0), ("s", "pr/m-b", 5, 9), ("t", "pr/m-a", 30, 9)]
    assert [r["message"].split(" /")[0] for r in u.diagnostics.collect()] == ["skipping malformed hermes session"]


def test_best_of_readers(spark, tmp_path):
    for name, n in (("a", 5), ("b", 9)):
        put(tmp_path / f".reasonix/projects/p/{name}.acp.json", {"sessionId": "s", "model": "m", "updatedAt": f"2026-01-0{n}T00:00:00Z", "status": {"cumulative": {"promptTokens": n, "completionTokens": 2, "cacheMissTokens": n}}})
    put(tmp_path / ".mux/sessions/w/session-usage.json", {"byModel": {"anthropic:claude": {"input": {"tokens": 4}, "output": {"tokens": 1}}, "x": {}}, "lastRequest": {"timestamp": 1769900000000}})
    rows = read_usage(spark, Context(str(tmp_path)), ["reasonix", "mux"], tz="UTC").events.collect()
    assert sorted((r["harness"], r["model"], r["tokens"]["input"]) for r in rows) == [("mux", "claude", 4), ("reasonix", "m", 9)]


def test_nothing_there(spark, tmp_path):
    u = read_usage(spark, Context(str(tmp_path)))
    assert u.events.count() == u.diagnostics.count() == u.skipped.count() == 0
    with pytest.raises(ValueError):
        read_usage(spark, Context(str(tmp_path)), ["someone"])


def test_bounds():
    assert bound_ms("2026-08-01", "UTC", end=True) == 1785628800000
    assert bound_ms("2026-03-29", "Africa/Cairo") and bound_ms("2026-08-01T00:00:00Z", "UTC") == 1785542400000
    assert bound_ms("2024-09-08", "America/Santiago") % 3_600_000 == 0  # midnight is skipped that day
    with pytest.raises(ValueError):
        bound_ms("2026-02-30", "UTC")


def test_amp_ledger_of_a_long_thread():
    """Messages meet their own ledger rows by id, else the first free one of equal use; the search does not grow with the thread."""
    import time

    from quillmeter.sources.kit import Loaded

    n, at = 20_000, "2026-08-01T00:00:00.000Z"
    said = [{"role": "assistant", **({"messageId": f"e{k}"} if k % 2 else {}), "usage": {"model": "m", "inputTokens": 1, "outputTokens": 1, "timestamp": at}} for k in range(n)]
    ledger = [{**({"toMessageId": f"e{k}"} if k % 2 else {"id": f"l{k}"}), "timestamp": at, "model": "m", "tokens": {"input": 1, "output": 1}} for k in range(n)]
    doc = json.dumps({"id": "s", "messages": said, "usageLedger": {"events": ledger}}).encode()
    began = time.process_time()
    found = list(REGISTRY["amp"].parse([Loaded("T-s.json", 0, 0, doc, 0)]))
    assert time.process_time() - began < 10
    assert len({e.message_id for e in found}) == len(found) and {f"e{k}" for k in range(1, n, 2)} <= {e.message_id for e in found}
