"""Homes of every agent, written from a usage view, and what their readers must find in them.

Each agent's writer turns the rows of a session (or of a whole store) into the
files that the agent keeps.  There is a home for every so many events, as on as many
machines, each with one writer, so that no one lists or holds all files.  The SQL beside a writer says which events the reader owes for
the same rows.
"""

from __future__ import annotations

import atexit
import json
import os
import shutil
import sqlite3
import tempfile
import uuid
from collections.abc import Callable, Iterator
from dataclasses import dataclass, field
from urllib.parse import unquote

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..sources.kit import Context, iso
from .read_usage import read_usage

Rows = list[dict]
Files = Iterator[tuple[str, str | bytes]]

#: Events of a home, of whole sessions dealt by their hash
HOME_EVENTS = 20_000
COLUMNS = ("session_id", "message_id", "ts_ms", "model", "input", "output", "cache_read", "cache_write", "reasoning", "turn", "calls")
TAIL = "regexp_replace(model, '^[^/]*/', '')"


@dataclass(frozen=True)
class Home:
    """How an agent's home is written, and the SQL of what is read: columns that
    differ from the view's, the rows, or a query of its own over ``u``."""

    write: Callable[[str, Rows], Files] | Callable[[Rows, str], None]
    own: dict[str, str] = field(default_factory=dict)
    whole: bool = False  # one writer for all sessions of a home, into files of its own
    query: str | None = None
    placed: bool = False  # message ids name files and lines, and are not compared

    def sql(self, usage: str) -> str:
        if self.query is not None:
            return f"WITH u AS ({usage}) {self.query}"
        own = {"calls": "NULL", **({"message_id": "NULL"} if self.placed else {}), **self.own}
        kinds = {"session_id": "VARCHAR", "message_id": "VARCHAR", "model": "VARCHAR", "turn": "BOOLEAN"}
        return f"WITH u AS ({usage}) SELECT " + ", ".join(f"CAST({own.get(c, c)} AS {kinds.get(c, 'BIGINT')}) AS {c}" for c in COLUMNS) + " FROM u"


def lines(*rows: dict | str) -> str:
    return "\n".join(r if isinstance(r, str) else json.dumps(r) for r in rows) + "\n"


def stamped(r: dict) -> str:
    return iso(r["ts_ms"])


def _claude(root: str, epoch: bool = False):
    def write(s: str, rows: Rows) -> Files:
        def entry(r: dict) -> dict:
            used = {"input_tokens": r["input"], "output_tokens": r["output"], "cache_read_input_tokens": r["cache_read"], "cache_creation_input_tokens": r["cache_write"]}
            return {"type": "assistant", "sessionId": s, "timestamp": r["ts_ms"] if epoch else stamped(r), "isSidechain": r["subagent"], "cwd": r["workspace"], "message": {"id": r["message_id"], "role": "assistant", "model": r["model"], "usage": used}}

        user, tool = {"type": "user", "message": {"role": "user", "content": "go on"}}, {"type": "user", "message": {"role": "user", "content": [{"type": "tool_result"}]}}
        yield f"{root}/projects/p/{s}.jsonl", lines(*(x for r in rows for x in (user if r["turn"] else tool, entry(r))), "{broken")
        # a resumed session repeats messages in a later file; the first of them counts
        yield f"{root}/projects/q/{s}-again.jsonl", lines(*(entry(r | {"output": 1}) for r in rows if r["k"] % 10 == 0))

    return write


def _pi(root: str):
    def write(s: str, rows: Rows) -> Files:
        def entry(r: dict) -> dict:
            used = {"input": r["input"], "output": r["output"] + r["reasoning"], "cacheRead": r["cache_read"], "cacheWrite": r["cache_write"], "reasoning": r["reasoning"]}
            return {"type": "message", "id": r["message_id"], "timestamp": stamped(r), "message": {"role": "assistant", "model": r["model"], "usage": used}}

        user = {"type": "message", "message": {"role": "user"}}
        yield f"{root}/{s}.jsonl", lines({"type": "session", "id": s}, *(x for r in rows for x in ([user] if r["turn"] else []) + [entry(r)]))
        yield f"{root}/{s}.z.jsonl", lines({"type": "session", "id": s}, *(entry(r) for r in rows[:5]))

    return write


def _codex(s: str, rows: Rows) -> Files:
    """Totals that only grow, the last count beside every other; a second file replays the first ones."""
    out, model, sums = [{"type": "session_meta", "payload": {"id": s}}], None, [0, 0, 0, 0, 0]
    names = ("input_tokens", "output_tokens", "cached_input_tokens", "cache_write_input_tokens", "reasoning_output_tokens")
    for r in rows:
        if r["model"] != model:
            model = r["model"]
            out.append({"type": "turn_context", "payload": {"model": model}})
        if r["turn"]:
            out.append({"type": "event_msg", "payload": {"type": "user_message"}})
        own = (r["input"] + r["cache_read"] + r["cache_write"], r["output"] + r["reasoning"], r["cache_read"], r["cache_write"], r["reasoning"])
        sums = [a + b for a, b in zip(sums, own)]
        info = {"total_token_usage": dict(zip(names, sums))} | ({"last_token_usage": dict(zip(names, own))} if r["k"] % 2 else {})
        out.append({"timestamp": stamped(r), "type": "event_msg", "payload": {"type": "token_count", "info": info}})
    yield f".codex/sessions/a/rollout-{s}.jsonl", lines(*out)
    yield f".codex/sessions/b/rollout-{s}-fork.jsonl", lines(*out[: len(out) // 2])


def _gemini(s: str, rows: Rows) -> Files:
    said = []
    for r in rows:
        tool, given = r["k"] % 3, r["input"] + r["cache_read"]
        n = {"input": given, "output": r["output"], "cached": r["cache_read"], "thoughts": r["reasoning"], "tool": tool, "total": given + r["output"] + r["reasoning"] + tool}
        said += [{"type": "user"}] * r["turn"] + [{"type": "gemini", "id": r["message_id"], "timestamp": stamped(r), "model": r["model"], "tokens": n}]
    yield f".gemini/tmp/h/chats/session-{s}.json", json.dumps({"sessionId": s, "messages": said})


def _commandcode(s: str, rows: Rows) -> Files:
    def entry(r: dict, output: int) -> dict:
        return {"id": r["message_id"], "sessionId": s, "timestamp": stamped(r), "model": r["model"], "usage": {"inputTokens": r["input"] + r["cache_read"], "outputTokens": output, "cacheReadTokens": r["cache_read"], "cacheWriteTokens": r["cache_write"]}}

    yield f".commandcode/projects/p/{s}.jsonl", lines({"type": "session", "cwd": "/w"}, *(entry(r, 0) for r in rows), *(entry(r, r["output"]) for r in rows))


def _copilot(s: str, rows: Rows) -> Files:
    def entry(r: dict) -> dict:
        used = {"model": r["model"], "inputTokens": r["input"] + r["cache_read"], "outputTokens": r["output"], "cacheReadTokens": r["cache_read"], "cacheWriteTokens": r["cache_write"]}
        return {"type": "session.usage_record", "id": r["message_id"], "timestamp": stamped(r), "data": {"usage": used}}

    yield f".copilot/session-state/{s}/events.jsonl", lines({"type": "session.start", "data": {"sessionId": s}}, *map(entry, rows))


def _amp(s: str, rows: Rows) -> Files:
    said, ledger = [], []
    for r in rows:
        used = {"model": r["model"], "inputTokens": r["input"], "outputTokens": r["output"], "cacheReadInputTokens": r["cache_read"], "cacheCreationInputTokens": r["cache_write"], "timestamp": stamped(r)}
        said += [{"role": "user"}] * r["turn"] + [{"role": "assistant", "messageId": r["message_id"], "usage": used}]
        if r["k"] % 2:
            ledger.append({"toMessageId": r["message_id"], "timestamp": stamped(r), "model": r["model"], "tokens": {"input": r["input"], "output": r["output"]}})
    yield f".local/share/amp/threads/T-{s}.json", json.dumps({"id": s, "messages": said, "usageLedger": {"events": ledger}})


def _sums(rows: Rows) -> dict[str, int]:
    return {c: sum(r[c] for r in rows) for c in ("input", "output", "cache_read", "cache_write", "reasoning")}


def _grouped(by: str, model: str, message: str, **own: str) -> str:
    """One event for each ``by``: sums, at the session's last instant."""
    cells = {c: f"sum({c})" for c in ("input", "output", "cache_read", "cache_write", "reasoning")} | {"turn": "false", "calls": "NULL::BIGINT"} | own
    return f"SELECT session_id, {message} AS message_id, max(last) AS ts_ms, {model} AS model, " + ", ".join(f"({e}){'::BIGINT' if c not in ('turn', 'calls') else ''} AS {c}" for c, e in cells.items()) + f" FROM (SELECT *, max(ts_ms) OVER (PARTITION BY session_id) AS last FROM u) GROUP BY {by}"


def _droid(s: str, rows: Rows) -> Files:
    n = _sums(rows)
    used = {"inputTokens": n["input"], "outputTokens": n["output"], "cacheReadTokens": n["cache_read"], "cacheCreationTokens": n["cache_write"], "thinkingTokens": n["reasoning"]}
    yield f".factory/sessions/{s}.settings.json", json.dumps({"session_id": s, "model": "custom:GPT-5.1 Codex [fast]", "providerLockTimestamp": iso(max(r["ts_ms"] for r in rows)), "tokenUsage": used})


def _qwen(s: str, rows: Rows) -> Files:
    def entry(r: dict) -> dict:
        return {"type": "assistant", "uuid": r["message_id"], "sessionId": s, "timestamp": stamped(r), "model": r["model"], "usageMetadata": {"promptTokenCount": r["input"], "candidatesTokenCount": r["output"], "cachedContentTokenCount": r["cache_read"], "thoughtsTokenCount": r["reasoning"]}}

    yield f".qwen/projects/p/chats/{s}.jsonl", lines(*(x for r in rows for x in [{"type": "user", "sessionId": s}] * r["turn"] + [entry(r)]))


def _grok(s: str, rows: Rows) -> Files:
    """Records of one instant with equal counts differ in the loop's index, which is at most 1 at a turn's begin."""
    def entry(r: dict) -> dict:
        used = {"prompt_tokens": r["input"] + r["cache_read"], "cached_prompt_tokens": r["cache_read"], "completion_tokens": r["output"] + r["reasoning"], "reasoning_tokens": r["reasoning"], "loop_index": -r["seq"] if r["turn"] else 2 + r["seq"]}
        return {"sid": s, "ts": stamped(r), "msg": "shell.turn.inference_done", "ctx": used}

    changed = lambda r: {"sid": s, "msg": "model changed", "ctx": {"model": r["model"]}}
    yield f".grok/logs/{s}/unified.jsonl", lines(*(x for r in rows for x in (changed(r), entry(r))))
    # the older log of a session that the new one has is not read again
    yield f".grok/sessions/{s}/updates.jsonl", lines(*({"params": {"_meta": {"totalTokens": 100 * k}}} for k in range(3)))


def _augment(s: str, rows: Rows) -> Files:
    def turn(r: dict) -> dict:
        used = {"input_tokens": r["input"], "output_tokens": r["output"], "cache_read_input_tokens": r["cache_read"], "cache_creation_input_tokens": r["cache_write"]}
        return {"exchange": {"request_id": r["message_id"], "model_id": r["model"], "response_nodes": [{"token_usage": {"input_tokens": 1}}, {"token_usage": used}, {}]}, "completed": True, "finishedAt": stamped(r)}

    yield f".augment/sessions/{s}.json", json.dumps({"sessionId": s, "chatHistory": [t for r in rows for t in (turn(r), turn(r) | {"completed": False})]})


def _codebuff(s: str, rows: Rows) -> Files:
    def entry(r: dict) -> dict:
        head, rest = {"inputTokens": r["input"]}, {"inputTokens": 7 if r["input"] else 0, "outputTokens": r["output"], "cacheReadInputTokens": r["cache_read"], "cacheCreationInputTokens": r["cache_write"]}
        return {"variant": "ai", "id": r["message_id"], "metadata": {"model": r["model"], "timestamp": stamped(r), "usage": head, "codebuff": {"usage": rest}}}

    yield f".config/manicode/projects/proj/chats/{s}/chat-messages.json", json.dumps([{"variant": "user"}, *map(entry, rows)])


def _jcode(s: str, rows: Rows) -> Files:
    def entry(r: dict) -> dict:
        used = {"prompt_tokens": r["input"] + r["cache_read"] + r["cache_write"], "completion_tokens": r["output"], "cache_read_input_tokens": r["cache_read"], "cache_creation_input_tokens": r["cache_write"], "reasoning_tokens": r["reasoning"]}
        return {"id": r["message_id"], "model": r["model"], "timestamp": stamped(r), "token_usage": used}

    half = {"session_id": s, "messages": [entry(r) for r in rows[: len(rows) // 2]]}
    yield f".jcode/sessions/{s}.json", json.dumps(half if rows[0]["k"] % 2 else half | {"messages": [entry(r) for r in rows]})
    if rows[0]["k"] % 2:  # a journal replaces its snapshot
        yield f".jcode/sessions/{s}.journal.jsonl", lines(*({"session_id": s, "message": entry(r)} for r in rows))


def _mux(s: str, rows: Rows) -> Files:
    by: dict[str, dict] = {}
    for model in {r["model"] for r in rows}:
        n = _sums([r for r in rows if r["model"] == model])
        by[f"x:{model}"] = {"input": {"tokens": n["input"]}, "output": {"tokens": n["output"]}, "cached": {"tokens": n["cache_read"]}, "cacheCreate": {"tokens": n["cache_write"]}, "reasoning": {"tokens": n["reasoning"]}}
    yield f".mux/sessions/{s}/session-usage.json", json.dumps({"byModel": by, "lastRequest": {"timestamp": max(r["ts_ms"] for r in rows)}})


def _zcode(s: str, rows: Rows) -> Files:
    def entry(r: dict) -> dict:
        used = {"input": r["input"] + r["cache_read"] + r["cache_write"], "output": r["output"] + r["reasoning"], "input_cache_read": r["cache_read"], "input_cache_creation": r["cache_write"], "reasoning": r["reasoning"]}
        return {"role": "assistant", "id": r["message_id"], "sessionId": s, "timestamp": stamped(r), "model": r["model"], "usage": used}

    yield f".zcode/projects/p/{s}.jsonl", lines(*(x for r in rows for x in [{"role": "user"}] * r["turn"] + [entry(r)]))


def _extension(folder: str):
    def write(s: str, rows: Rows) -> Files:
        def entry(r: dict) -> dict:
            used = {"apiProtocol": "anthropic", "tokensIn": r["input"], "tokensOut": str(r["output"]), "cacheReads": r["cache_read"], "cacheWrites": r["cache_write"]}
            return {"type": "say", "say": "api_req_started", "ts": r["ts_ms"], "text": json.dumps(used)}

        root = f".config/Code/User/globalStorage/{folder}/tasks/{s}"
        yield f"{root}/ui_messages.json", json.dumps([{"type": "say", "say": "text"}, *map(entry, rows)])
        yield f"{root}/api_conversation_history.json", json.dumps([{"content": "<environment_details><model>old</model><model>m-1</model></environment_details>"}])

    return write


def _task(agent: str) -> dict[str, str]:
    nth = "row_number() OVER (PARTITION BY session_id ORDER BY seq) - 1"
    return {"message_id": f"concat('{agent}:', session_id, ':', {nth})", "model": "'anthropic/m-1'", "reasoning": "0", "turn": "false"}


def _openclaw(s: str, rows: Rows) -> Files:
    def entry(r: dict) -> dict:
        used = {"input": r["input"], "output": r["output"] if r["k"] % 2 else 0, "cacheRead": r["cache_read"], "cacheWrite": r["cache_write"], "totalTokens": r["input"] + r["output"] + r["cache_read"] + r["cache_write"]}
        return {"type": "message", "id": r["message_id"], "message": {"role": "assistant", "timestamp": r["ts_ms"], "usage": used}}

    changed = lambda r: {"type": "model_change", "modelId": r["model"], "provider": "prov"}
    yield f".openclaw/agents/a/{s}.jsonl", lines({"type": "session", "id": s, "cwd": "/w"}, *(x for r in rows for x in (changed(r), entry(r))))


def _kimi(s: str, rows: Rows) -> Files:
    def entry(r: dict) -> dict:
        return {"type": "usage.record", "usageScope": "turn", "id": r["message_id"], "time": r["ts_ms"], "usage": {"input_other": r["input"], "output": r["output"], "input_cache_read": r["cache_read"], "input_cache_creation": r["cache_write"]}}

    yield f".kimi/sessions/h/{s}/wire.jsonl", lines(*(x for r in rows for x in ({"type": "llm.request", "model": r["model"]}, entry(r))))


def _junie(s: str, rows: Rows) -> Files:
    def entry(r: dict) -> dict:
        used = {"model": r["model"], "inputTokens": r["input"], "outputTokens": r["output"], "cacheInputTokens": r["cache_read"], "cacheCreateTokens": r["cache_write"], "reasoningTokens": r["reasoning"]}
        return {"kind": "AgentEvent", "timestampMs": r["ts_ms"], "event": {"agentEvent": {"modelUsage": [used]}}}

    yield f".junie/sessions/{s}/events.jsonl", lines(*(x for r in rows for x in [{"kind": "UserPromptEvent"}] * r["turn"] + [entry(r), entry(r)]))


def _opencodereview(s: str, rows: Rows) -> Files:
    def entry(r: dict) -> dict:
        return {"type": "llm_response", "uuid": r["message_id"], "timestamp": stamped(r), "model": r["model"], "usage": {"prompt_tokens": r["input"], "completion_tokens": r["output"], "cache_read_tokens": r["cache_read"], "cache_write_tokens": r["cache_write"]}}

    yield f".opencodereview/sessions/{s}.jsonl", lines({"type": "session_start", "sessionId": s}, *map(entry, rows), {"type": "session_end", "usage": {"prompt_tokens": 9}})


def _trae(s: str, rows: Rows) -> Files:
    def entry(r: dict) -> dict:
        used = {"input_tokens": r["input"], "output_tokens": r["output"], "cache_read_input_tokens": r["cache_read"], "cache_creation_input_tokens": r["cache_write"], "reasoning_tokens": r["reasoning"]}
        return {"timestamp": stamped(r), "response": {"model": r["model"], "usage": used}}

    yield f"trajectories/trajectory_{s}.json", json.dumps({"llm_interactions": [entry(r) for r in rows], "agent_steps": [{}]})


def _deepseek(s: str, rows: Rows) -> Files:
    """The highest readable generation counts, in zstd for half of the sessions."""
    def entry(r: dict) -> dict:
        used = {"inputTokens": r["input"], "outputTokens": r["output"], "cacheReadTokens": r["cache_read"], "cacheWriteTokens": r["cache_write"], "reasoningTokens": r["reasoning"]}
        return {"type": "assistant/message", "seq": r["seq"], "time": r["ts_ms"], "data": {"model": r["model"], "usage": used}}

    head, root = {"type": "session", "id": s, "cwd": "/w"}, f".dsh/sessions/{s}"
    yield f"{root}/session.jsonl", lines(head, *(entry(r) for r in rows[:1]))
    text = lines(head, *map(entry, rows))
    yield (f"{root}/session.v2.jsonl", text) if rows[0]["k"] % 2 else (f"{root}/session.v3.jsonl.zstd", pa.compress(text.encode(), "zstd", asbytes=True))


def _reasonix(s: str, rows: Rows) -> Files:
    def entry(r: dict) -> dict:
        return {"ts": stamped(r), "model": r["model"], "session": s, "completion": r["output"] + r["reasoning"], "reasoning": r["reasoning"], "cache_miss": r["input"], "cache_hit": r["cache_read"]}

    yield f".reasonix/stats/{s}.jsonl", lines(*map(entry, rows))
    yield f".reasonix/projects/p/{s}.acp.json", json.dumps({"sessionId": s, "model": "m", "cumulative": {"promptTokens": 5, "completionTokens": 1}})  # not read beside a ledger


def _fx(s: str, rows: Rows) -> Files:
    """A running total that starts anew in the middle."""
    out, sums = [], [0, 0, 0, 0, 0]
    names, cells = ("input_tokens", "output_tokens", "cache_read_tokens", "cache_write_tokens", "reasoning_tokens"), ("input", "output", "cache_read", "cache_write", "reasoning")
    for k, r in enumerate(rows):
        now = [r[c] for c in cells]
        sums = now if k == len(rows) // 2 and any(a < b for a, b in zip(now, sums)) else [a + b for a, b in zip(sums, now)]
        out += [{"kind": "set", "key": "model", "value": r["model"]}, {"kind": "set", "key": "usage", "ts": r["ts_ms"], "value": dict(zip(names, sums))}] + [{"kind": "turn_committed"}] * r["turn"]
    yield f".fx/sessions/v2/{s}/log.jsonl", lines(*out)


# stores with one database


def _store(path: str, tables: dict[str, str], fill: Callable[[Rows], Iterator[tuple[str, list[tuple]]]]):
    def write(rows: Rows, home: str) -> None:
        at = os.path.join(home, path)
        os.makedirs(os.path.dirname(at), exist_ok=True)
        made = f"{at}.{uuid.uuid4().hex[:8]}.part"  # a repeated attempt begins its own
        with sqlite3.connect(made) as c:
            for name, columns in tables.items():
                c.execute(f"CREATE TABLE {name} ({columns})")
            for name, values in fill(rows):
                if values:
                    c.executemany(f"INSERT INTO {name} VALUES ({', '.join('?' * len(values[0]))})", values)
        c.close()
        os.replace(made, at)

    return write


def _sessions(rows: Rows) -> dict[str, Rows]:
    out: dict[str, Rows] = {}
    for r in rows:
        out.setdefault(r["session_id"], []).append(r)
    return out


def _talk(made: Callable[[dict], dict]):
    """Messages with their users', whose ids come first at one instant."""

    def fill(rows: Rows) -> Iterator[tuple[str, list[tuple]]]:
        yield "message", [x for r in rows for x in [(f"a{r['seq']}", r["session_id"], json.dumps({"role": "user", "time": {"created": r["ts_ms"]}}))] * r["turn"] + [(r["message_id"], r["session_id"], json.dumps(made(r)))]]

    return fill


def _opencode(path: str):
    def made(r: dict) -> dict:
        n = {"input": r["input"], "output": r["output"], "reasoning": r["reasoning"], "cache": {"read": r["cache_read"], "write": r["cache_write"]}}
        return {"role": "assistant", "providerID": "p", "modelID": r["model"], "time": {"created": r["ts_ms"]}, "tokens": n}

    def fill(rows: Rows) -> Iterator[tuple[str, list[tuple]]]:
        yield "session", [(s, None, "/w", "title") for s in _sessions(rows)]
        yield from _talk(made)([r | {"turn": True} for r in rows])

    return _store(path, {"session": "id, parent_id, directory, title", "message": "id, session_id, data"}, fill)


def _kilo(r: dict) -> dict:
    n = {"input": r["input"], "output": r["output"], "reasoning": r["reasoning"], "cache": {"read": r["cache_read"], "write": r["cache_write"]}}
    return {"role": "assistant", "modelID": r["model"], "time": {"created": r["ts_ms"]}, "tokens": n}


def _hermes(rows: Rows, home: str) -> None:
    """Half of the models in a profile's store; the session's totals and larger message counts in the home's."""
    cells = ("input", "output", "cache_read", "cache_write", "reasoning")
    names = ", ".join(f"{c}_tokens" for c in cells)
    tables = {"sessions": f"id, model, billing_provider, started_at, message_count, {names}", "session_model_usage": f"session_id, model, billing_provider, {names}, actual_cost_usd, estimated_cost_usd"}

    def part(keep: Callable[[dict], bool], count: int) -> Callable[[Rows], Iterator[tuple[str, list[tuple]]]]:
        def fill(all_rows: Rows) -> Iterator[tuple[str, list[tuple]]]:
            yield "sessions", [(s, "gpt-5", "prov", max(r["ts_ms"] for r in own), count + len(own), *(1,) * 5) for s, own in _sessions(all_rows).items()]
            yield "session_model_usage", [(r["session_id"], r["model"], "prov", *(r[c] for c in cells), 0, r["cost_usd"]) for r in all_rows if keep(r)]

        return fill

    _store(".hermes/state.db", tables, part(lambda r: "gpt" in r["model"], 3))(rows, home)
    _store(".hermes/profiles/p/state.db", tables, part(lambda r: "gpt" not in r["model"], 1))(rows, home)


def _goose(rows: Rows) -> Iterator[tuple[str, list[tuple]]]:
    out = []
    for s, own in _sessions(rows).items():
        n = _sums(own)
        given = n["input"] + n["cache_read"] + n["cache_write"]
        out.append((s, '{"model_name": "m-1"}', iso(max(r["ts_ms"] for r in own)), given, n["output"], given + n["output"] + n["reasoning"], n["cache_read"], n["cache_write"], 5))
    yield "sessions", out


def _zed(rows: Rows) -> Iterator[tuple[str, list[tuple]]]:
    out = []
    for k, (s, own) in enumerate(_sessions(rows).items()):
        used = [{"input_tokens": r["input"], "output_tokens": r["output"], "cache_read_input_tokens": r["cache_read"], "cache_creation_input_tokens": r["cache_write"]} for r in own]
        raw = json.dumps({"model": {"provider": "zed.dev", "model": "m-1"}, "request_token_usage": used if k % 2 else {str(j): u for j, u in enumerate(used)}}).encode()
        kind = "zstd" if k % 3 else "json"
        out.append((s, iso(max(r["ts_ms"] for r in own)), kind, pa.compress(raw, "zstd", asbytes=True) if kind == "zstd" else raw))
    yield "threads", [*out, ("other", "2024-01-01T00:00:00Z", "json", b'{"model": {"provider": "else", "model": "x"}}')]


def _cherry(rows: Rows) -> Iterator[tuple[str, list[tuple]]]:
    yield "ai_usage_record", [(r["message_id"], r["model"], r["ts_ms"], r["input"], r["output"], r["cache_read"], r["cache_write"], r["reasoning"]) for r in rows]


def _devin(rows: Rows) -> Iterator[tuple[str, list[tuple]]]:
    def entry(r: dict) -> str:
        n = {"input_tokens": r["input"], "output_tokens": r["output"], "cache_read_tokens": r["cache_read"], "cache_creation_tokens": r["cache_write"], "total_time_ms": 250}
        return json.dumps({"role": "assistant", "metadata": {"generation_model": r["model"], "metrics": n}})

    yield "sessions", [(s, f"title {s}", "adaptive", "/w") for s in _sessions(rows)]
    yield "message_nodes", [(r["seq"], r["session_id"], entry(r), r["ts_ms"] // 1000) for r in rows]


def _kiro(rows: Rows) -> Iterator[tuple[str, list[tuple]]]:
    def turn(r: dict) -> dict:
        return {"user": {"content": {"Prompt": {"prompt": "p" * (4 * r["k"])}}, "timestamp": stamped(r)}, "assistant": {"Response": {"content": "é" * 80}}}

    yield "conversations", [(f"/w/{s}", json.dumps({"model": "m-1", "history": [turn(r) for r in own]})) for s, own in _sessions(rows).items()]


_BARE = {"cache_write": "0", "reasoning": "0"}
_NO_REASON = {"reasoning": "0"}
_ONE_TURN = {"turn": "true"}
HOMES: dict[str, Home] = {
    "claude": Home(_claude(".claude"), _NO_REASON),
    "codex": Home(_codex, placed=True),
    "gemini": Home(_gemini, {"input": "input + k % 3", "cache_write": "0"}),
    "opencode": Home(_opencode(".local/share/opencode/opencode.db"), {"model": "concat('p/', model)", **_ONE_TURN}, whole=True),
    "mimocode": Home(_opencode(".local/share/mimocode/mimocode.db"), {"model": "concat('p/', model)", **_ONE_TURN}, whole=True),
    "commandcode": Home(_commandcode, _NO_REASON | _ONE_TURN),
    "copilot": Home(_copilot, _NO_REASON | {"turn": "false"}),
    "amp": Home(_amp, _NO_REASON),
    "droid": Home(_droid, query=_grouped("session_id", "'gpt-5-1-codex'", "session_id")),
    "qwen": Home(_qwen, {"cache_write": "0"}),
    "pi": Home(_pi(".pi/agent/sessions")),
    "omp": Home(_pi(".omp/agent/sessions")),
    "prime": Home(_pi(".prime/agent/sessions")),
    "gajae": Home(_pi(".gjc/agent/sessions")),
    "kimchi": Home(_pi(".config/kimchi/harness/sessions")),
    "grok": Home(_grok, {"cache_write": "0"}, placed=True),
    "augment": Home(_augment, _NO_REASON | _ONE_TURN | {"message_id": "concat('augment:', session_id, ':req:', message_id)"}),
    "codebuff": Home(_codebuff, _NO_REASON | _ONE_TURN | {"session_id": "concat('manicode/proj/', session_id)"}),
    "codebuddy": Home(_claude(".codebuddy", epoch=True), _NO_REASON),
    "jcode": Home(_jcode, _ONE_TURN),
    "mux": Home(_mux, query=_grouped("session_id, model", "model", "concat('mux:', session_id, ':x:', model)")),
    "zcode": Home(_zcode, {"model": "concat('zhipu/', lower(regexp_replace(model, '^.*/', '')))"}),
    "roo": Home(_extension("rooveterinaryinc.roo-cline"), _task("roo")),
    "cline": Home(_extension("saoudrizwan.claude-dev"), _task("cline")),
    "kilo": Home(_store(".local/share/kilo/kilo.db", {"message": "id, session_id, data"}, lambda rows: _talk(_kilo)([r | {"turn": True} for r in rows])), _ONE_TURN, whole=True),
    "kilocode": Home(_extension("kilocode.kilo-code"), _task("kilocode")),
    "openclaw": Home(_openclaw, _NO_REASON | _ONE_TURN | {"model": "CASE WHEN contains(model, '/') THEN model ELSE concat('prov/', model) END"}),
    "kimi": Home(_kimi, _NO_REASON | _ONE_TURN | {"model": TAIL}),
    "junie": Home(_junie, placed=True),
    "devin": Home(_store(".local/share/devin/cli/sessions.db", {"sessions": "id, title, model, working_directory", "message_nodes": "row_id, session_id, chat_message, created_at"}, _devin), _NO_REASON | _ONE_TURN | {"message_id": "concat(session_id, ':', seq)", "ts_ms": "ts_ms // 1000 * 1000 - 250"}, whole=True),
    "hermes": Home(
        _hermes, whole=True,
        query="SELECT session_id, session_id AS message_id, last AS ts_ms, concat('prov/', model) AS model, input, output, cache_read, cache_write, reasoning, false AS turn, "
        "CASE WHEN row_number() OVER (PARTITION BY session_id ORDER BY NOT contains(model, 'gpt'), model <> 'gpt-5', model) = 1 THEN most + 3 ELSE 0 END AS calls "
        "FROM (SELECT session_id, model, max(last) AS last, max(most) AS most, sum(input)::BIGINT AS input, sum(output)::BIGINT AS output, sum(cache_read)::BIGINT AS cache_read, sum(cache_write)::BIGINT AS cache_write, sum(reasoning)::BIGINT AS reasoning "
        "FROM (SELECT *, max(ts_ms) OVER (PARTITION BY session_id) AS last, count(*) OVER (PARTITION BY session_id) AS most FROM u) GROUP BY 1, 2 "
        "HAVING sum(input) > 0 OR sum(output) > 0 OR sum(cache_read) > 0 OR sum(cache_write) > 0 OR sum(reasoning) > 0 OR sum(coalesce(cost_usd, 0)) > 0)",
    ),
    "goose": Home(_store(".local/share/goose/sessions/sessions.db", {"sessions": "id, model_config_json, created_at, accumulated_input_tokens, accumulated_output_tokens, accumulated_total_tokens, accumulated_cache_read_tokens, accumulated_cache_write_tokens, input_tokens"}, _goose), whole=True, query=_grouped("session_id", "'m-1'", "session_id")),
    "zed": Home(_store(".local/share/zed/threads/threads.db", {"threads": "id, updated_at, data_type, data"}, _zed), whole=True, query=_grouped("session_id", "'m-1'", "session_id", reasoning="0", calls="count(*)")),
    "cherrystudio": Home(_store(".config/CherryStudio/cherrystudio.sqlite", {"ai_usage_record": "id, model_id, created_at, input_tokens, output_tokens, cache_read_tokens, cache_write_tokens, reasoning_tokens"}, _cherry), {"session_id": "message_id", "turn": "false"}, whole=True),
    "opencodereview": Home(_opencodereview, _NO_REASON | _ONE_TURN),
    "trae": Home(_trae, _ONE_TURN | {"session_id": "concat('trajectory_', session_id)"}, placed=True),
    "deepseek": Home(_deepseek, _ONE_TURN, placed=True),
    "reasonix": Home(_reasonix, {"cache_write": "0", **_ONE_TURN}, placed=True),
    "kiro": Home(_store(".kiro/data.sqlite3", {"conversations": "key, value"}, _kiro), _BARE | _ONE_TURN | {"session_id": "concat('/w/', session_id)", "message_id": "concat('/w/', session_id, ':', row_number() OVER (PARTITION BY session_id ORDER BY seq) - 1)", "model": "'m-1'", "input": "(k + 5) // 10 * 10", "output": "40", "cache_read": "0"}, whole=True),
    "fx": Home(_fx, {"calls": "1"}, placed=True),
}


def home_dir(spark: SparkSession) -> str:
    """A new folder that every executor can write and the driver can list: below
    spark.checkpoint.dir, or for a local session a temporary one."""
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
        base = tempfile.mkdtemp(prefix="quillmeter-")
        atexit.register(shutil.rmtree, base, ignore_errors=True)
    if "://" in base and not base.startswith("file:"):
        raise ValueError("agents keep their stores in a file system that can be listed")
    path = unquote(base.split("://", 1)[-1].removeprefix("file:"))
    return os.path.join(path, "quillmeter", f"home-{uuid.uuid4().hex[:12]}")


def write_home(usage: DataFrame, agent: str, root: str) -> list[str]:
    """Write as many homes of the agent below ``root`` as the events of the usage view fill; the homes."""
    home = HOMES[agent]
    shards = max(1, -(-usage.count() // HOME_EVENTS))
    roots = [os.path.join(root, f"m{k:06d}") for k in range(shards)]
    cells = ["input", "output", "cache_read", "cache_write", "reasoning"]
    rows = usage.select("seq", "session_id", "message_id", "ts_ms", "model", "turn", "subagent", "cost_usd", "workspace", "k", *[F.col("tokens")[c].alias(c) for c in cells])
    rows = rows.withColumn("part", F.format_string("m%06d", F.pmod(F.hash("session_id"), F.lit(shards))))

    def write(part: pa.Table) -> pa.Table:
        at, own = os.path.join(root, part["part"][0].as_py()), part.drop_columns("part").sort_by("seq").to_pylist()
        for r in own:
            r.update(turn=bool(r["turn"]), subagent=bool(r["subagent"]))
        if home.whole:
            home.write(own, at)
        else:
            for s, mine in _sessions(own).items():
                for path, data in home.write(s, mine):
                    to = os.path.join(at, path)
                    os.makedirs(os.path.dirname(to), exist_ok=True)
                    with open(to, "wb") as f:
                        f.write(data if isinstance(data, bytes) else data.encode())
        return pa.table({"n": [len(own)]})

    rows.groupBy("part").applyInArrow(write, "n long").write.format("noop").mode("overwrite").save()
    return roots


def read_home(usage: DataFrame, agent: str) -> DataFrame:
    """What the agent's reader finds in a home written from the usage view."""
    root = home_dir(usage.sparkSession)
    os.makedirs(root, exist_ok=True)
    homes = [Context(r, cwd=r) for r in write_home(usage, agent, root)]
    found = read_usage(usage.sparkSession, homes, [agent], tz="UTC", idle=True).events
    message = F.lit(None).cast("string") if HOMES[agent].placed else F.col("message_id")
    return found.select("session_id", message.alias("message_id"), "ts_ms", "model", *[F.col("tokens")[c].alias(c) for c in ("input", "output", "cache_read", "cache_write", "reasoning")], "turn", "calls")
