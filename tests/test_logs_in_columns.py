"""Logs read in columns against the parsers of the same agents, line by line."""

import json
from collections import Counter

import pytest
from pyspark.sql import functions as F

from quillmeter.sources import scan
from quillmeter.sources.kit import File, Loaded
from quillmeter.sources.logs_in_columns import claude_events, codebuddy_events, commandcode_events, junie_events, log_lines, openclaw_events, opencodereview_events, pi_events, qwen_events
from quillmeter.sources.readers import logs

USAGE = {"input_tokens": 5, "output_tokens": 7, "cache_read_input_tokens": 1, "cache_creation_input_tokens": 2}


def claude(ident, when="2026-08-01T10:00:00Z", model="m", usage=USAGE, **more):
    return {"type": "assistant", "sessionId": "s", "timestamp": when, "message": {"id": ident, "role": "assistant", "model": model, "usage": usage}, **more}


CLAUDE = [
    {"type": "user", "message": {"role": "user", "content": "hi"}}, claude("a"), claude("b", 1_785_000_000), claude("c", "1785000000123", cwd="C:\\W\\", isSidechain=True, costUSD=0.5),
    {"type": "user", "message": {"content": [{"type": "tool_result"}]}}, claude("d", "2026-08-01 10:00", isSidechain="true"), {"type": "user", "message": {"content": [{"type": "tool_result"}, {"type": "text"}]}}, claude("e", "never"),
    {"type": "user", "content": []}, claude(None, model="<synthetic>"), claude(None, uuid="u1"), {"role": "user", "type": "note", "content": "x"}, claude(None, sessionId=" "), "{broken", "", "  ", "null", "[1]", "7", '"text"',
    claude("f", usage=None), claude("g", usage={}), claude("h", usage="none"), claude("i", usage=USAGE | {"output_tokens": -1}), claude("j", usage=USAGE | {"input_tokens": 2.9, "cache_read_input_tokens": None}), claude("k", usage=USAGE | {"cache_read_input_tokens": "3"}),
    claude("l", usage=USAGE | {"cache_creation": {"ephemeral_1h_input_tokens": 4}}), claude("m", usage=USAGE | {"cache_creation": {"ephemeral_1h_input_tokens": "4"}}), claude("n", model=" "), claude("o", model=5), claude("a", "2026-08-02T00:00:00Z"),
    {"type": "user", "message": None, "content": "x"}, claude("p", "2026-08-01T10:00:00.5+02:00", message_=1), {"type": "system"}, claude("q", True), claude("r", costUSD="1"), claude("s", 0), claude("é\u2028", sessionId="ünï"), claude("t", usage=USAGE | {"output_tokens": 9007199254740993}),
]
PI_USAGE = {"input": 5, "output": 9, "cacheRead": 1, "cacheWrite": 2, "reasoning": 4}


def pi(ident, usage=PI_USAGE, when="2026-08-01T10:00:00Z", role="assistant", model="m", **more):
    return {"type": "message", "id": ident, "timestamp": when, "message": {"role": role, "model": model, "usage": usage}, **more}


PI = [
    pi("before"), {"type": "session", "id": "s1"}, pi("u", role="user"), pi("a"), pi("a"), pi("b", None), {"type": "session", "id": " ", "rlmDepth": 2}, pi("c"), {"type": "session", "id": "s2"}, pi("d", PI_USAGE | {"reasoning": 20}), pi("e", PI_USAGE | {"reasoning": None}),
    pi("f", PI_USAGE | {"reasoning": "x"}), pi("g", PI_USAGE | {"cacheWrite1h": 2}), pi("h", PI_USAGE | {"cacheWrite1h": "2"}), pi("i", PI_USAGE | {"cacheWrite1h": None}), pi(None), pi("j", when=None), pi("k", model=None), pi("u2", role="user"), pi("l", None), pi("m"),
    {"type": "message", "message": "text"}, "nonsense}", {"type": "message", "id": "n", "message": {"role": "assistant", "model": "m", "timestamp": 1_785_000_000_000, "usage": PI_USAGE}}, pi("o", {"input": 1}), {"type": "session", "id": "s3", "rlmDepth": "3"}, pi("p"),
]

ODD = ["{broken", "", "null", "[1]", "7", '"text"']
T1, T2 = "2026-08-01T10:00:00Z", 1_785_000_000


def buddy(ident, type_="assistant", usage=USAGE, **more):
    return {"type": type_, "sessionId": "s", "timestamp": T1, "message": {"id": ident, "role": "assistant", "model": "m", "usage": usage}, **more}


HI = {"type": "user", "message": {"role": "user", "content": "hi"}}
BUDDY = [
    HI, buddy("a", "function_call", None), buddy("b"), buddy("c", "message"), HI, buddy("d", usage=None), buddy("e"), HI, {"type": "function_call", "timestamp": T1, "id": "f", "providerData": {"usage": USAGE, "model": "pm"}}, buddy("g", "system"),
    {"type": "message", "timestamp": T1, "id": "h", "usage": USAGE, "message": {"model": "m"}, "providerData": {"usage": {}}}, buddy("i", providerData={"rawUsage": {"prompt_tokens": 9}}), buddy("j", usage=USAGE | {"input_tokens": 0}, providerData={"rawUsage": {"prompt_tokens": 9}}),
    buddy("k", providerData={"rawUsage": {"prompt_tokens": "9"}}), buddy("l", usage=None, providerData={"usage": "odd", "model": "pm"}), buddy("m", usage=None, usage_=1, providerData={"model": "pm"}), *ODD, buddy("n", "function_call", USAGE | {"output_tokens": None}),
]


def review(ident, usage={"prompt_tokens": 5, "completion_tokens": 2, "cache_read_tokens": 1}, **more):
    return {"type": "llm_response", "uuid": ident, "usage": usage, **more}


REVIEW = [
    review("a", timestamp=T1, model="m"), review("b", model="m"), {"type": "session_start", "sessionId": "s1", "timestamp": T2, "model": "hm", "cwd": "/w/"}, review("c"), review("d", timestamp="never", model=" "), review(None, timestamp=T1), review("e", None), review("f", {}), review("g", 5),
    {"type": "session_start", "session_id": "s2", "model": "hm2"}, review("h"), review("i", timestamp=T1), {"type": "session_end", "usage": {"prompt_tokens": 9}}, *ODD, review("j", {"prompt_tokens": -1, "completion_tokens": 2}, timestamp=T1), review("k", {"prompt_tokens": 1, "completion_tokens": 2, "cache_write_tokens": "x"}, timestamp=T1),
]


def command(ident, output=3, when=T1, **more):
    return {"id": ident, "timestamp": when, "usage": {"inputTokens": 9, "outputTokens": output, "cacheReadTokens": 4}, **more}


COMMAND = [
    command("a", 0), {"type": "session", "cwd": "/w//x/"}, command("a", 1), command("b", sessionId="s9", model="m"), {"type": "session", "cwd": " "}, command("a", 7), command("a", "bad"), command(None), command(None), command("c", when=None), command("d", usage=[1]), *ODD,
    command("e", usage={"inputTokens": 1, "outputTokens": 2, "cacheReadTokens": 4, "cacheWriteTokens": 5}), {"type": "session", "cwd": "C:\\A", "usage": {"inputTokens": 1, "outputTokens": 2}, "timestamp": T2, "id": "f"},
]


def qwen(ident, session="s", n=(5, 2, 1, 3), **more):
    return {"type": "assistant", "uuid": ident, "sessionId": session, "timestamp": T1, "model": "m", "usageMetadata": dict(zip(("promptTokenCount", "candidatesTokenCount", "cachedContentTokenCount", "thoughtsTokenCount"), n)), **more}


ASK = {"type": "user", "sessionId": "s"}
QWEN = [
    qwen("a"), ASK, ASK | {"sessionId": "t"}, qwen("z", n=(0, 0, 0, 0)), qwen("bad", n=("x", 1)), qwen("b"), qwen("c", "t", cwd="/w"), ASK, qwen(None, None), qwen("d", " ", model=None), {"type": "user"}, qwen("e", None), qwen("f", usageMetadata="x"), qwen("g", timestamp=None), *ODD,
    qwen("h", n=(5,)), ASK, qwen("i", n=(1, None, 0, -2)), qwen("last", "t"), ASK,
]


def claw(ident, usage={"input": 5, "output": 2, "cacheRead": 1}, when=T1, row=None, **message):
    return {"type": "message", "id": ident, "message": {"role": "assistant", "timestamp": when, "usage": usage, **message}, **(row or {})}


CLAW = [
    claw("a"), claw("b", model="m"), {"type": "session", "id": "s1", "cwd": "/w/"}, {"type": "model_change", "modelId": "mm", "provider": "pp"}, claw("c"), claw("d", model="x/y"), claw("e", provider="q"), {"type": "custom", "customType": "model-snapshot", "data": {"modelId": "m3"}}, claw("f"),
    {"type": "model-snapshot", "data": [1], "modelId": "m4", "provider": " "}, claw("g", {"input": 1, "totalTokens": 9}), claw("h", {"input": 1, "totalTokens": 1}), claw("i", {}), claw("j", {"input": "x"}), claw("k", when="never", row={"timestamp": T2}), claw("l", when=None), claw("m", 5), claw(None), {"type": "session", "id": " ", "cwd": ""},
    claw("n", row={"customType": "model-snapshot", "modelId": "m5"}), *ODD, claw("o", role="user"), claw("c"), {"type": "session", "id": "s2"}, claw("p", {"output": 3, "totalTokens": 50}),
]


def junie(*used, when=1_785_000_000_123, **more):
    return {"kind": "AgentEvent", "timestampMs": when, "event": {"agentEvent": {"modelUsage": list(used)}}, **more}


def spent(model="m", **n):
    return {"model": model, "inputTokens": 5, "outputTokens": 2, **n}


JUNIE = [
    junie(spent()), {"kind": "UserPromptEvent"}, junie(spent()), junie(spent("n"), spent("m", outputTokens=9)), junie(spent("q"), kind="UserPromptEvent"), junie(spent("r", inputTokens="x", input_tokens=7), spent(None), spent(" "), 5, spent("s", inputTokens=-3, outputTokens=0), {"kind": "UserPromptEvent"}),
    {"kind": "UserPromptEvent"}, junie(spent("z", inputTokens=0, outputTokens=0)), junie(spent("t"), when=None, timestamp=T1), junie(spent("u"), when=-1), junie(spent("v"), when=0, timestamp="never"), junie(spent("w", cacheReadTokens=2.9, cacheCreateTokens=4, reasoningTokens=1), when=5), *ODD, {"event": {"agentEvent": {"modelUsage": {"model": "m"}}}}, junie(),
]


def written(path, rows):
    path.parent.mkdir(parents=True, exist_ok=True)
    path.write_bytes(b"\n".join((r if isinstance(r, str) else json.dumps(r, ensure_ascii=False)).encode() for r in rows) + b"\n\xff{\n")
    return File(str(path), 1, 0)


def shown(rows):
    skip = ("key", "rank", "src_ord")
    return Counter(tuple(sorted((k, str(v)) for k, v in r.items() if k not in skip)) for r in rows)


CASES = [
    ("claude", CLAUDE, claude_events), ("pi", PI, pi_events), ("codebuddy", BUDDY, codebuddy_events), ("opencodereview", REVIEW, opencodereview_events), ("commandcode", COMMAND, commandcode_events), ("qwen", QWEN, qwen_events), ("openclaw", CLAW, openclaw_events), ("junie", JUNIE, junie_events),
]


@pytest.mark.parametrize("agent, rows, columns", CASES, ids=[c[0] for c in CASES])
def test_same_rows_as_the_parser(spark, tmp_path, agent, rows, columns):
    reader = next(r for r in logs.READERS if r.id == agent)
    assert reader.columns is columns
    files = [written(tmp_path / "a b+c" / f"{k}%20é.x.jsonl", part) for k, part in enumerate((rows, rows[5:], []))]
    found = columns(log_lines(spark, files))
    plan = found._jdf.queryExecution().toString()
    assert "Python" not in plan and "Arrow" not in plan and "Pandas" not in plan
    loaded = [Loaded(f.path, f.root, f.lane, open(f.path, "rb").read(), 0) for f in files]
    units = [loaded] if agent == "qwen" else [[f] for f in loaded]  # the parser's unit is a folder, all of whose rows it gives to the first file
    parsed = [r for unit in units for r in scan._rows(reader, unit).to_pylist()]
    got = [r.asDict() for r in found.orderBy("src_path", "src_ord").collect()]
    for r in parsed + got:
        if agent == "qwen":
            r["src_path"] = None
    assert shown(got) == shown(parsed)
    # the parser's keys and order, which decide whose repeat counts, are kept
    keys = lambda rs: [sorted(map(str, v)) for v in _groups(rs)]
    assert keys(parsed) == keys(got)


def test_files_of_a_record_are_in_order(spark, tmp_path):
    """A message's last record stands in the place of its first, and a prompt of one file opens the turn of a later one."""
    found = commandcode_events(log_lines(spark, [written(tmp_path / "x.jsonl", [command("a", 1), command("b", 2), command("a", 3)])])).where("kind = 'event'").orderBy("src_ord").collect()
    assert [(r.message_id, r.output, r.src_ord) for r in found] == [("a", 3, 0), ("b", 2, 1)]
    files = [written(tmp_path / "p" / "chats" / f"{n}.jsonl", rows) for n, rows in (("1", [ASK]), ("2", [qwen("a"), qwen("b")]))]
    assert {r.message_id: r.turn for r in qwen_events(log_lines(spark, files)).where("kind = 'event'").collect()} == {"a": True, "b": False}


def _groups(rows):
    found = {}
    for r in rows:
        if r["kind"] == "event":
            found.setdefault(r["key"], []).append((r["src_path"], r["message_id"], r["timestamp"]))
    return sorted(found.values())


def test_no_lines(spark, tmp_path):
    lines = log_lines(spark, [written(tmp_path / "x.jsonl", [])]).where(F.lit(False))
    assert not any(columns(lines).count() for _, _, columns in CASES)
