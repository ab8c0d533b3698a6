"""Readers of JSON-lines session logs."""

from __future__ import annotations

import os
import re
from collections.abc import Callable, Iterator
from functools import partial

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..logs_in_columns import claude_events, codebuddy_events, commandcode_events, junie_events, openclaw_events, opencodereview_events, pi_events, qwen_events
from ..kit import Context, Event, File, Loaded, Malformed, Parsed, Reader, Skip, Warn, cell, counter, ends, epoch, finite, get, lines, objects, optional, split_input, stamp, stem, text, tokens_key, under, workspace

JSONL = ends(".jsonl")


def guarded(f: Loaded, handle: Callable[[int, dict], Event | None]) -> Parsed:
    """Events of a file's objects, in order; lines that do not fit are skips."""
    for item in objects(f):
        if isinstance(item, Skip):
            yield item
            continue
        try:
            event = handle(*item)
        except Malformed:
            yield Skip(f"{f.path}:{item[0] + 1}", "malformed usage record")
            continue
        if event is not None:
            yield event


# claude, codebuddy


def _human(content: object) -> bool:
    """A user's own words: not (only) the results of tools."""
    if isinstance(content, list):
        return any(get(part, "type") != "tool_result" for part in content)
    return True


def _claude(agent: str) -> Callable[[list[Loaded]], Parsed]:
    buddy = agent == "codebuddy"

    def parse(files: list[Loaded]) -> Parsed:
        f = files[0]
        human = False

        def handle(k: int, row: dict) -> Event | None:
            nonlocal human
            message = row.get("message")
            role = get(message, "role") or row.get("role") or row.get("type")
            if row.get("type") == "user" or role == "user":
                human = _human(get(message, "content") if message is not None else row.get("content"))
                return None
            if row.get("type") not in ("assistant", *(("function_call", "message") if buddy else ())):
                return None
            after, human = human, False
            usage, model = get(message, "usage"), text(get(message, "model"))
            if usage is None and buddy:
                usage = get(row, "providerData", "usage") or get(row, "usage")
                model = model or text(get(row, "providerData", "model"))
            if usage is None:
                human = after if row.get("type") == "function_call" else False
                return None
            if model == "<synthetic>":
                return None
            when = stamp(row.get("timestamp"))
            if not isinstance(usage, dict) or model is None or when is None:
                raise Malformed
            fresh = cell(usage.get("input_tokens"))
            read = optional(usage.get("cache_read_input_tokens"))
            if buddy and finite(get(row, "providerData", "rawUsage", "prompt_tokens")) is not None:
                fresh = split_input(fresh, read)
            hour = finite(get(usage, "cache_creation", "ephemeral_1h_input_tokens"))  # of any other kind it is not reported
            ident = text(get(message, "id")) or text(row.get("requestId")) or text(row.get("uuid")) or text(row.get("id")) or f"{f.path}:{k}"
            cost = finite(row.get("costUSD"))
            return Event(text(row.get("sessionId")) or stem(f.path), ident, when, model, fresh, cell(usage.get("output_tokens")), read, optional(usage.get("cache_creation_input_tokens")), 0, int(hour) if hour is not None and hour >= 0 else None, after, row.get("isSidechain") is True, cost_usd=cost, workspace=workspace(row.get("cwd")), key=ident)

        yield from guarded(f, handle)

    return parse


def _claude_files(ctx: Context) -> list[File]:
    roots = ctx.many("CLAUDE_CONFIG_DIR") or [ctx.at(".claude"), ctx.at(".config", "claude")]
    return under([os.path.join(r, "projects") for r in roots], JSONL)


# the pi family


def _pi(files: list[Loaded]) -> Parsed:
    f = files[0]
    session, depth, pending = stem(f.path), 0.0, False

    def handle(k: int, row: dict) -> Event | None:
        nonlocal session, depth, pending
        if row.get("type") == "session":
            session, depth = text(row.get("id")) or session, finite(row.get("rlmDepth")) or 0.0
            return None
        message = row.get("message")
        if row.get("type") != "message" or not isinstance(message, dict):
            return None
        if message.get("role") == "user":
            pending = True
            return None
        if message.get("role") != "assistant":
            return None
        turn, pending = pending, False
        usage = message.get("usage")
        if usage is None:
            return None
        ident, model, when = text(row.get("id")), text(message.get("model")), stamp(row.get("timestamp")) or stamp(message.get("timestamp"))
        if ident is None or model is None or when is None:
            raise Malformed
        hour = get(usage, "cacheWrite1h")
        e = Event(session, ident, when, model, cell(get(usage, "input")), cell(get(usage, "output")), cell(get(usage, "cacheRead")), cell(get(usage, "cacheWrite")), optional(get(usage, "reasoning")), None if hour is None else cell(hour), turn, depth > 0)
        e.output = split_input(e.output, e.reasoning)
        e.key = f"{session}:{ident}:{model}:{tokens_key(e)}"
        return e

    yield from guarded(f, handle)


def _pi_reader(name: str, roots: Callable[[Context], list[str]]) -> Reader:
    return Reader(name, lambda ctx: under(roots(ctx), JSONL), _pi, columns=pi_events)


def _below(ctx: Context, env: str, sub: str, *default: str) -> list[str]:
    return [os.path.join(ctx.get(env) or ctx.at(*default), sub)]


def _prime_roots(ctx: Context) -> list[str]:
    chosen = [ctx.get("PRIME_AGENT_SESSION_DIR"), os.path.join(ctx.get("PRIME_AGENT_CODING_AGENT_DIR"), "sessions") if ctx.get("PRIME_AGENT_CODING_AGENT_DIR") else None]
    return [p for p in chosen if p] or [ctx.at(".prime", "agent", "sessions")]


def _gajae_roots(ctx: Context) -> list[str]:
    if ctx.get("GJC_CODING_AGENT_DIR"):
        return [os.path.join(ctx.get("GJC_CODING_AGENT_DIR"), "sessions")]
    if ctx.get("GJC_CONFIG_DIR"):
        return [os.path.join(ctx.get("GJC_CONFIG_DIR"), "agent", "sessions")]
    return [ctx.at(".gjc", "agent", "sessions"), os.path.join(ctx.get("XDG_STATE_HOME") or ctx.at(".local", "state"), "gjc", "sessions")]


# commandcode


def _commandcode(files: list[Loaded]) -> Parsed:
    """The last record of a message id counts, at the place of its first."""
    f = files[0]
    where, kept, rest = None, {}, []
    for item in objects(f):
        if isinstance(item, Skip):
            rest.append(item)
            continue
        k, row = item
        if row.get("type") == "session":
            where = workspace(row.get("cwd")) or where
        usage = row.get("usage")
        if not isinstance(usage, dict):
            continue
        try:
            when = stamp(row.get("timestamp"))
            if when is None:
                raise Malformed
            read = optional(usage.get("cacheReadTokens"))
            ident = text(row.get("id")) or f"{f.path}:{k}"
            kept[ident] = Event(text(row.get("sessionId")) or stem(f.path), ident, when, text(row.get("model")) or "commandcode-unknown", split_input(cell(usage.get("inputTokens")), read), cell(usage.get("outputTokens")), read, optional(usage.get("cacheWriteTokens")), turn=True, workspace=where)
        except Malformed:
            rest.append(Skip(f"{f.path}:{k + 1}", "malformed usage record"))
    yield from kept.values()
    yield from rest


# qwen, opencodereview


def _qwen(files: list[Loaded]) -> Parsed:
    """The unit is a project: a user's prompt may stand in another file of the session."""
    pending: dict[str, bool] = {}
    for f in files:
        for item in objects(f):
            if isinstance(item, Skip):
                yield item
                continue
            k, row = item
            session = text(row.get("sessionId")) or f"{os.path.basename(os.path.dirname(os.path.dirname(f.path)))}-{stem(f.path)}"
            if row.get("type") == "user":
                pending[session] = True
            usage = row.get("usageMetadata")
            if row.get("type") != "assistant" or not isinstance(usage, dict):
                continue
            try:
                n = {c: optional(usage.get(f"{c}TokenCount")) for c in ("prompt", "candidates", "cachedContent", "thoughts")}
                when, model = stamp(row.get("timestamp")), text(row.get("model")) or "unknown"
                if when is None:
                    raise Malformed
            except Malformed:
                yield Skip(f"{f.path}:{k + 1}", "malformed usage record")
                continue
            e = Event(session, text(row.get("uuid")) or f"{f.path}:{k}", when, model, n["prompt"], n["candidates"], n["cachedContent"], 0, n["thoughts"], workspace=workspace(row.get("cwd")))
            if e.total or f.idle:
                e.turn = pending.pop(session, False)
                yield e


def _opencodereview(files: list[Loaded]) -> Parsed:
    f = files[0]
    head: dict = {}

    def handle(k: int, row: dict) -> Event | None:
        nonlocal head
        if row.get("type") == "session_start":
            head = row
            return None
        if row.get("type") != "llm_response" or row.get("usage") is None:
            return None
        u = row["usage"]
        when, model = stamp(row.get("timestamp")) or stamp(head.get("timestamp")), text(row.get("model")) or text(head.get("model"))
        if when is None or model is None:
            raise Malformed
        session = text(head.get("sessionId")) or text(head.get("session_id")) or stem(f.path)
        return Event(session, text(row.get("uuid")) or f"{f.path}:{k}", when, model, cell(get(u, "prompt_tokens")), cell(get(u, "completion_tokens")), optional(get(u, "cache_read_tokens")), optional(get(u, "cache_write_tokens")), turn=True, workspace=workspace(head.get("cwd")))

    yield from guarded(f, handle)


# openclaw


def _openclaw(files: list[Loaded]) -> Parsed:
    f = files[0]
    session, model, provider, cwd = re.sub(r"\.jsonl(\..*)?$", "", os.path.basename(f.path)), None, None, None

    def handle(k: int, row: dict) -> Event | None:
        nonlocal session, model, provider, cwd
        if row.get("type") == "session":
            session, cwd = text(row.get("id")) or session, row.get("cwd") or cwd
        if row.get("type") in ("model_change", "model-snapshot") or row.get("customType") == "model-snapshot":
            data = row.get("data") if isinstance(row.get("data"), dict) else row
            model, provider = text(data.get("modelId")) or model, text(data.get("provider")) or provider
        message = row.get("message")
        if row.get("type") != "message" or get(message, "role") != "assistant" or not isinstance(get(message, "usage"), dict):
            return None
        u = message["usage"]
        own, by = text(message.get("model")) or model, text(message.get("provider")) or provider
        when = stamp(message.get("timestamp")) or stamp(row.get("timestamp"))
        if own is None or when is None:
            raise Malformed
        n = [optional(u.get(c)) for c in ("input", "output", "cacheRead", "cacheWrite", "totalTokens")]
        if not n[1] and n[4] > n[0] + n[2] + n[3]:
            n[1] = n[4] - n[0] - n[2] - n[3]
        e = Event(session, text(row.get("id")) or f"{f.path}:{k}", when, own if "/" in own or not by else f"{by}/{own}", *n[:4], turn=True, workspace=workspace(cwd))
        e.key = f"{session}:{when}:{e.model}:{tokens_key(e)}"
        return e if e.total or f.idle else None

    yield from guarded(f, handle)


# kimi


def _kimi_counts(u: dict) -> tuple[int, int, int, int, int]:
    i, o = counter(u, "input_other", "inputOther", "input"), counter(u, "output")
    r, w = counter(u, "input_cache_read", "inputCacheRead"), counter(u, "input_cache_creation", "inputCacheCreation")
    extra = counter(u, "total") - i - o - r - w
    return (i, o, r, w, 0) if extra <= 0 else (i, extra, r, w, 0) if not o else (i, o, r, w, extra)


def _kimi(files: list[Loaded]) -> Parsed:
    """Direct usage first, then the best status of each message."""
    logs = [f for f in files if f.path.endswith("wire.jsonl")]
    config = next((f.json() for f in files if f.path.endswith("config.json")), None)
    clean = lambda m: None if m is None or re.fullmatch("__.*__", m) else m.split("/", 1)[-1]
    for f in logs:
        session = os.path.basename(os.path.dirname(f.path))
        model, slots = clean(text(get(config, "model")) or text(get(config, "default_model"))), {}
        for item in objects(f):
            if isinstance(item, Skip):
                yield item
                continue
            k, row = item
            if row.get("type") == "llm.request":
                model = clean(text(row.get("model"))) or model
            if row.get("type") == "usage.record" and row.get("usageScope") == "turn" and isinstance(row.get("usage"), dict):
                i, o, r, w, z = _kimi_counts(row["usage"])
                when = epoch(row.get("time")) or f.mtime_iso
                e = Event(session, text(row.get("id")) or f"{f.path}:{k}", when, clean(text(row.get("model"))) or model or "kimi-for-coding", i, o, r, w, z, turn=True)
                e.key = f"{session}:{e.message_id}:{e.model}:{tokens_key(e)}"
                if e.total or f.idle:
                    yield e
            message = row.get("message")
            if get(message, "type") == "StatusUpdate" and isinstance(get(message, "payload", "token_usage"), dict):
                i, o, r, w, z = _kimi_counts(message["payload"]["token_usage"])
                ident = text(message["payload"].get("message_id")) or f"{f.path}:{k}"
                wired = epoch(row.get("timestamp"))
                e = Event(session, ident, wired or f.mtime_iso, model or "kimi-for-coding", i, o, r, w, z, turn=True)
                best = slots.get(ident)
                if (e.total or f.idle) and (best is None or (e.total, wired is not None, e.timestamp) >= (best[0].total, best[1], best[0].timestamp)):
                    slots[ident] = (e, wired is not None)
        for e, _ in slots.values():
            e.key = f"{e.session_id}:{e.message_id}:{e.model}:{tokens_key(e)}"
            yield e


def _kimi_files(ctx: Context) -> list[File]:
    found = []
    for k, root in enumerate(ctx.many("KIMI_DATA_DIR") or [ctx.at(".kimi"), ctx.at(".kimi-code")]):
        config = os.path.join(root, "config.json")
        for f in under([os.path.join(root, "sessions")], ends("wire.jsonl")):
            found.append(File(f.path, k, 0, f.path))
            if os.path.isfile(config):  # each log is a unit of its own, with the configuration beside it
                found.append(File(config, k, 1, f.path))
    return found


# junie


def _junie(files: list[Loaded]) -> Parsed:
    f = files[0]
    session, prompted, seen = os.path.basename(os.path.dirname(f.path)), False, set()
    for item in objects(f):
        if isinstance(item, Skip):
            yield item
            continue
        k, row = item
        if row.get("kind") == "UserPromptEvent":
            prompted = True
        used = get(row, "event", "agentEvent", "modelUsage")
        for j, u in enumerate(used if isinstance(used, list) else []):
            model = text(get(u, "model"))
            when = epoch(finite(row.get("timestampMs")), "ms") or stamp(row.get("timestamp"))
            if model is None or when is None:
                yield Skip(f"{f.path}:{k + 1}", "malformed usage record")
                continue
            e = Event(session, f"{f.path}:{k}:{j}", when, model, counter(u, "inputTokens", "input_tokens"), counter(u, "outputTokens", "output_tokens"), counter(u, "cacheInputTokens", "cacheReadTokens"), counter(u, "cacheCreateTokens", "cacheWriteTokens"), counter(u, "reasoningTokens"))
            e.key = f"{session}:{when}:{model}:{tokens_key(e)}"
            if (e.total or f.idle) and e.key not in seen:
                seen.add(e.key)
                e.turn, prompted = prompted, False
                yield e


# codex


def _codex_counts(u: object) -> tuple[int, ...] | None:
    if not isinstance(u, dict):
        return None
    cached, wrote = counter(u, "cached_input_tokens"), counter(u, "cache_write_input_tokens")
    return split_input(counter(u, "input_tokens"), cached, wrote), counter(u, "output_tokens"), cached, wrote, counter(u, "reasoning_output_tokens")


EMITTED, SEEN = 0.0, 1.0  # ranks: counts that make an event, and counts that only a later replay can repeat


def _codex(files: list[Loaded]) -> Parsed:
    """Every count of a file with its replay key; which are replays of other files is found after."""
    f = files[0]
    model, before, user, early, out = None, None, False, 0, []
    session = stem(f.path)
    for item in objects(f):
        if isinstance(item, Skip):
            yield item
            continue
        k, row = item
        body, kind = row.get("payload"), row.get("type")
        if kind == "session_meta":
            session = text(get(body, "id")) or session
        elif kind == "turn_context":
            model = text(get(body, "model")) or model
        elif kind == "event_msg" and get(body, "type") == "user_message":
            user = True
        elif kind == "response_item" and get(body, "type") == "message" and get(body, "role") == "user":
            user = True
        elif kind == "event_msg" and get(body, "type") == "token_count":
            totals, last = _codex_counts(get(body, "info", "total_token_usage")), _codex_counts(get(body, "info", "last_token_usage"))
            if totals is None and last is None:
                continue
            when = text(row.get("timestamp")) or f.mtime_iso
            counts = None
            if totals is None or totals != before:
                counts = last
                if counts is None and totals is not None:
                    falls = before is None or any(a < b for a, b in zip(totals, before))
                    counts = totals if falls else tuple(a - b for a, b in zip(totals, before))
            if totals is not None:
                before = totals
            turn, user = user, False
            # a count that repeats the total is an event of no tokens
            some = f.idle or counts is not None and any(counts)
            early += some and model is None
            i, o, r, w, z = counts or (0, 0, 0, 0, 0)
            own = some and model is not None
            out.append(Event(session, f"{f.path}:{k}", when, model or "", i, split_input(o, z), r, w, z, turn=turn, key=f"{when}:{totals or last}", rank=EMITTED if own else SEEN))
    if model is None:
        yield Skip(f.path, "no model context")
        return
    if early:
        yield Warn(f"skipping {early} codex token event(s) before the first turn_context in {f.path}", f.path)
    for e in out:
        e.session_id = session
    yield from out


def without_replays(df: DataFrame) -> DataFrame:
    """Events whose key no earlier file has that gave an event of its own.

    A key of an earlier file counts if it made an event there (had that been a
    replay, a still earlier file would have it) or if that file gave any event.
    The second depends on what was a replay before, so it is settled in rounds,
    over the keys that several files have, until no file's standing changes.
    """
    files = ["lane", "root_ord", "src_path"]
    keys = df.groupBy("key", *files).agg(F.min("rank").alias("rank"))
    first = Window.partitionBy("key").orderBy(*files).rowsBetween(Window.unboundedPreceding, -1)
    shared = keys.withColumn("n", F.count("*").over(Window.partitionBy("key"))).where("n > 1").drop("n")
    shared = shared.withColumn("made", F.coalesce(F.max((F.col("rank") == EMITTED).cast("int")).over(first), F.lit(0))).persist()
    own = df.where(F.col("rank") == EMITTED)
    if shared.isEmpty():
        return own.withColumn("key", F.lit(None).cast("string"))
    giving, before = None, None
    while True:
        stands = shared if giving is None else shared.join(giving.withColumn("gives", F.lit(1)), files, "left")
        told = F.lit(0) if giving is None else F.coalesce(F.max("gives").over(first), F.lit(0))
        replays = stands.withColumn("replay", F.greatest(F.col("made"), told)).where("replay = 1").select("key", *files).persist()
        giving = own.join(replays, ["key", *files], "left_anti").select(*files).distinct().persist()
        now = giving.count()
        if now == before:
            return own.join(replays, ["key", *files], "left_anti").withColumn("key", F.lit(None).cast("string"))
        before = now


def _codex_files(ctx: Context) -> list[File]:
    root = ctx.get("CODEX_HOME") or ctx.at(".codex")
    keep = lambda p: os.path.basename(p).startswith("rollout-") and p.endswith(".jsonl")
    found = under([os.path.join(root, "sessions"), os.path.join(root, "archived_sessions")], keep)
    return found


# copilot


def _attr(attributes: object, *names: str) -> object:
    for n in names:
        v = get(attributes, n)
        v = v.get("value", next(iter(v.values()), None)) if isinstance(v, dict) else v
        if v is not None:
            return v
    return None


def _copilot(files: list[Loaded]) -> Parsed:
    f = files[0]
    if f.lane == 0:
        session, cwd = os.path.basename(os.path.dirname(f.path)), None

        def handle(k: int, row: dict) -> Event | None:
            nonlocal session, cwd
            data = row.get("data")
            if row.get("type") == "session.start":
                session, cwd = text(get(data, "sessionId")) or session, get(data, "context", "cwd") or cwd
            usage = get(data, "usage")
            if row.get("type") != "session.usage_record" or not isinstance(usage, dict):
                return None
            when, model = stamp(row.get("timestamp")), text(usage.get("model"))
            if when is None or model is None:
                raise Malformed
            read = optional(usage.get("cacheReadTokens"))
            return Event(session, text(row.get("id")) or f"{f.path}:{k}", when, model, split_input(cell(usage.get("inputTokens")), read), cell(usage.get("outputTokens")), read, optional(usage.get("cacheWriteTokens")), workspace=cwd if isinstance(cwd, str) else None)

        yield from guarded(f, handle)
        return
    yield from _otel(f)


def _otel(f: Loaded) -> Parsed:
    found: dict[str, dict] = {}
    real = lambda x: isinstance(x, str) and x.strip("0") != ""
    for item in objects(f):
        if isinstance(item, Skip):
            yield item
            continue
        k, row = item
        a = row.get("attributes")
        if not isinstance(a, dict) or not any(n.startswith("gen_ai.usage.") for n in a):
            continue
        name, op = str(row.get("name") or get(row, "body") or ""), _attr(a, "gen_ai.operation.name")
        event = str(_attr(a, "event.name") or "")
        rank = 0 if op == "chat" and row.get("type") in ("span", None) and "invoke_agent" not in name else 1 if "inference" in event + name else 2 if "agent.turn" in event + name else 3 if op == "invoke_agent" else None
        if rank is None:
            continue
        trace, span = row.get("traceId") or get(row, "spanContext", "traceId"), row.get("spanId") or get(row, "spanContext", "spanId")
        i, o = finite(_attr(a, "gen_ai.usage.input_tokens")), finite(_attr(a, "gen_ai.usage.output_tokens"))
        if not real(trace) or not real(span) or i is None or o is None:
            yield Skip(f"{f.path}:{k + 1}", "malformed usage record")
            continue
        when = row.get("endTime") or row.get("startTime") or row.get("timestamp") or row.get("hrTime")
        when = epoch(when[0] * 1000 + when[1] / 1e6, "ms") if isinstance(when, list) and len(when) == 2 else stamp(when)
        response = _attr(a, "gen_ai.response.id")
        c = {
            "rank": rank, "trace": trace, "span": span, "when": when or f.mtime_iso, "model": text(_attr(a, "gen_ai.response.model", "gen_ai.request.model")), "response": response, "line": k,
            "in": i, "out": o, "read": finite(_attr(a, "gen_ai.usage.cache_read.input_tokens", "gen_ai.usage.cache_read_input_tokens")) or 0, "write": finite(_attr(a, "gen_ai.usage.cache_creation.input_tokens", "gen_ai.usage.cache_write.input_tokens", "gen_ai.usage.cache_creation_input_tokens")) or 0,
            "think": finite(_attr(a, "gen_ai.usage.reasoning.output_tokens", "gen_ai.usage.reasoning_tokens")) or 0,
            "session": next((str(x) for x in (_attr(a, "gen_ai.conversation.id"), _attr(a, "copilot_chat.session_id", "session.id"), _attr(a, "interaction.id"), response, trace) if x), trace),
        }
        old = found.get(f"{trace}:{span}")
        if old is None or rank < old["rank"]:
            found[f"{trace}:{span}"] = c
        elif rank == old["rank"]:
            for n in ("in", "out", "read", "write", "think"):
                old[n] = max(old[n], c[n])
            old["model"] = old["model"] or c["model"]
    least: dict[tuple, int] = {}
    for c in found.values():
        if c["model"]:
            for name in ("trace", "response"):
                if c[name]:
                    least[name, c[name]] = min(least.get((name, c[name]), 9), c["rank"])
    for c in found.values():
        if any(c[n] and least.get((n, c[n]), 9) < c["rank"] for n in ("trace", "response")):
            continue
        if not c["model"]:
            yield Skip(f"{f.path}:{c['line'] + 1}", "usage without a model")
            continue
        yield Event(c["session"], f"{c['trace']}:{c['span']}", c["when"], c["model"], split_input(int(c["in"]), int(c["read"])), split_input(int(c["out"]), int(c["think"])), int(c["read"]), int(c["write"]), int(c["think"]), key=f"{c['trace']}:{c['span']}")


def _copilot_files(ctx: Context) -> list[File]:
    own = under([ctx.at(".copilot", "session-state")], ends("events.jsonl"))
    export = ctx.get("COPILOT_OTEL_FILE_EXPORTER_PATH") or ctx.at(".copilot", "otel")
    return own + under([export], lambda p: p.endswith((".jsonl", ".json")) or p == export, lane=1)


def uncovered(df: DataFrame) -> DataFrame:
    """Later lanes give up the sessions that the first lane has."""
    from ...operators.windows import without_covered

    first = df.where("lane = 0")
    return first.unionByName(without_covered(df.where("lane > 0"), first, "session_id"))


# fx


def _fx(files: list[Loaded]) -> Parsed:
    f = files[0]
    if f.lane == 0:
        yield from _fx_sidecar(f)
        return
    session, model, before, pending, out, title, where = os.path.basename(os.path.dirname(f.path)), None, None, None, [], None, None
    for k, row in lines(f):
        if not isinstance(row, dict):
            yield Skip(f"{f.path}:{k + 1}", "malformed JSON line")
            continue
        if row.get("kind") == "turn_committed" and pending is not None:
            pending.turn, pending = True, None
        if row.get("kind") != "set":
            continue
        value, name = row.get("value"), row.get("key")
        if name == "model":
            model = text(value) or text(get(value, "id")) or model
        elif name == "title":
            title = text(value) or title
        elif name in ("cwd", "workspace"):
            where = value if isinstance(value, str) else where
        elif name == "usage" and isinstance(value, dict):
            now = tuple(counter(value, n) for n in ("input_tokens", "output_tokens", "cache_read_tokens", "cache_write_tokens", "reasoning_tokens"))
            step = now if before is None or any(a < b for a, b in zip(now, before)) else tuple(a - b for a, b in zip(now, before))
            before = now
            when = epoch(row.get("ts"), "ms")
            if not any(step) and not f.idle:
                continue
            if when is None or (text(value.get("model")) or model) is None:
                yield Skip(f"{f.path}:{k + 1}", "malformed usage record")
                continue
            pending = Event(session, f"{session}:{k + 1}", when, text(value.get("model")) or model, *step, calls=1)
            out.append(pending)
    for e in out:
        e.title, e.workspace = title, where
        yield e


_FX_ID = re.compile(r"(\d+)-\d+-[0-9a-f]{16}")


def _fx_sidecar(f: Loaded) -> Parsed:
    doc, folder = f.json(), os.path.basename(os.path.dirname(f.path))
    snap, named = get(doc, "snapshot"), _FX_ID.fullmatch(folder)
    when = epoch(int(named[1]), "ms") if named else None
    models = get(snap, "models")
    if get(doc, "schema_version") != 1 or get(snap, "schema_version") != 1 or doc.get("session_id") != folder or when is None or not isinstance(models, list):
        raise Malformed
    out = []
    for k, m in enumerate(models):
        name = text(get(m, "model"))
        if name is None:
            raise Malformed
        cost = m.get("total_cost")
        if cost is not None and (finite(cost) is None or cost < 0):
            raise Malformed
        n = [cell(m.get(c)) for c in ("input_tokens", "output_tokens", "cache_read_tokens", "cache_write_tokens")]
        out.append(Event(folder, f"{folder}:{k}", when, name, *n, optional(m.get("reasoning_tokens")), calls=None if m.get("request_count") is None else cell(m["request_count"]), cost_usd=cost))
    yield from (e for e in out if e.total or f.idle)


def _fx_files(ctx: Context) -> list[File]:
    root = ctx.at(".fx", "sessions")
    v2 = os.path.join(root, "v2")
    return [f for f in under([root], ends("usage-v2.json")) if not f.path.startswith(v2 + os.sep)] + under([v2], ends("log.jsonl"), lane=1)


def _by_project(files: list[File], root_of: Callable[[str], str]) -> Iterator[File]:
    for f in files:
        yield File(f.path, f.root, f.lane, root_of(f.path))


def _openclaw_roots(ctx: Context) -> list[str]:
    return ctx.many("OPENCLAW_DIR") or [ctx.at(d) for d in (".openclaw", ".clawdbot", ".moltbot", ".moldbot")]


def _qwen_files(ctx: Context) -> list[File]:
    return list(_by_project(under(_below(ctx, "QWEN_DATA_DIR", "projects", ".qwen"), JSONL), lambda p: os.path.dirname(p)))


READERS = [
    Reader("claude", _claude_files, _claude("claude"), columns=claude_events),
    Reader("codebuddy", lambda c: under([os.path.join(c.get("CODEBUDDY_CONFIG_DIR") or c.at(".codebuddy"), "projects")], JSONL), _claude("codebuddy"), columns=codebuddy_events),
    Reader("codex", _codex_files, _codex, without_replays),
    Reader("commandcode", lambda c: under([c.at(".commandcode", "projects")], lambda p: p.endswith(".jsonl") and re.fullmatch(r"[^.]+\.jsonl", os.path.basename(p)) is not None), _commandcode, columns=commandcode_events),
    Reader("copilot", _copilot_files, _copilot, uncovered),
    Reader("qwen", _qwen_files, _qwen, columns=qwen_events, idle_columns=partial(qwen_events, idle=True)),
    _pi_reader("pi", lambda c: _below(c, "PI_AGENT_DIR", "sessions", ".pi", "agent")),
    _pi_reader("omp", lambda c: [c.at(".omp", "agent", "sessions")]),
    _pi_reader("prime", _prime_roots),
    _pi_reader("gajae", _gajae_roots),
    _pi_reader("kimchi", lambda c: _below(c, "KIMCHI_CODING_AGENT_DIR", "sessions", ".config", "kimchi", "harness")),
    Reader("openclaw", lambda c: under(_openclaw_roots(c), lambda p: re.search(r"\.jsonl(\.(deleted|reset)\..*)?$", os.path.basename(p)) is not None), _openclaw, columns=openclaw_events, idle_columns=partial(openclaw_events, idle=True)),
    Reader("kimi", _kimi_files, _kimi),
    Reader("junie", lambda c: under([c.get("JUNIE_SESSIONS_DIR") or c.at(".junie", "sessions")], ends("events.jsonl")), _junie, columns=junie_events, idle_columns=partial(junie_events, idle=True)),
    Reader("opencodereview", lambda c: under([c.at(".opencodereview", "sessions")], JSONL), _opencodereview, columns=opencodereview_events),
    Reader("fx", _fx_files, _fx),
]

