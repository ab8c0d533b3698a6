"""Readers of whole JSON documents."""

from __future__ import annotations

import os
import re
from collections import deque

from ..kit import Context, Event, File, Loaded, Malformed, Parsed, Reader, Skip, Warn, cell, counter, ends, epoch, finite, get, lenient, lines, loads, optional, parse_ms, scalar, split_input, stamp, stem, text, tokens_key, under, units, walk, workspace

JSON = ends(".json")


def items(value: object) -> list:
    return value if isinstance(value, list) else []


# gemini


def _gemini(files: list[Loaded]) -> Parsed:
    f = files[0]
    if f.path.endswith(".jsonl"):
        rows = []
        for k, v in lines(f):
            if v is None:
                yield Skip(f"{f.path}:{k + 1}", "malformed JSON line")
            else:
                rows.append((f"{f.path}:{k + 1}", v))
        session = next((text(get(v, "sessionId")) for _, v in rows if text(get(v, "sessionId"))), None) or f.path
    else:
        doc = f.json()
        if not isinstance(doc, dict):
            yield Skip(f.path, "malformed JSON")
            return
        session = text(doc.get("sessionId")) or stem(f.path)
        rows = [(f"{f.path}:{k}", m) for k, m in enumerate(items(doc.get("messages")))]
    pending = False
    for k, (place, m) in enumerate(rows):
        kind = get(m, "type")
        if kind == "user":
            pending = True
        n = get(m, "tokens")
        if kind != "gemini" or n is None:
            continue
        try:
            i, o, cached = (cell(get(n, c)) for c in ("input", "output", "cached"))
            thoughts, tool, total = (optional(get(n, c)) for c in ("thoughts", "tool", "total"))
            when, model = stamp(get(m, "timestamp")), text(get(m, "model"))
            if when is None or model is None:
                raise Malformed
        except Malformed:
            yield Skip(place, "malformed usage record")
            continue
        if total == i + o + thoughts + tool:
            i = split_input(i, cached)
        e = Event(session, text(get(m, "id")) or f"{f.path}:{k}", when, model, i + tool, o, cached, 0, thoughts, turn=pending)
        if e.total or f.idle:
            pending = False
            yield e


# amp


def _amp(files: list[Loaded]) -> Parsed:
    f = files[0]
    doc = f.json()
    if not isinstance(doc, dict):
        yield Skip(f.path, "malformed JSON")
        return
    session, created, where = text(doc.get("id")) or stem(f.path), finite(doc.get("created")), workspace(str(get(doc, "env", "initial", "trees", "0", "uri") or "").removeprefix("file://"))

    def when(own: object, ident: object) -> str:
        if isinstance(own, str) and parse_ms(own) is not None:
            return own
        late = epoch(created + finite(ident) * 1000, "ms") if created is not None and finite(ident) is not None else None
        return stamp(own) or late or f.mtime_iso

    ledger: list[Event] = []
    for k, row in enumerate(items(get(doc, "usageLedger", "events"))):
        model, n = text(get(row, "model")), get(row, "tokens")
        if model is None or not isinstance(n, dict):
            yield Skip(f"{f.path}:ledger:{k}", "malformed usage record")
            continue
        ident = scalar(row.get("toMessageId")) or text(row.get("id")) or f"{f.path}:ledger:{k}"
        ledger.append(Event(session, ident, when(row.get("timestamp"), row.get("toMessageId")), model, counter(n, "input"), counter(n, "output"), counter(n, "cacheReadInputTokens"), counter(n, "cacheCreationInputTokens"), workspace=where))
    used: set[int] = set()
    by_id, by_use = {}, {}
    for j, own in enumerate(ledger):
        by_id.setdefault(own.message_id, deque()).append(j)
        by_use.setdefault((own.model, own.input, own.output), deque()).append(j)

    def first_free(queue: deque[int] | None) -> int | None:
        while queue and queue[0] in used:
            queue.popleft()
        return queue[0] if queue else None

    pending, out = False, []
    for k, m in enumerate(items(doc.get("messages"))):
        if get(m, "role") == "user":
            pending = True
        u = get(m, "usage")
        if get(m, "role") != "assistant" or not isinstance(u, dict):
            continue
        turn, pending = pending, False
        model = text(u.get("model")) or text(m.get("model"))
        if model is None:
            yield Skip(f"{f.path}:{k}", "malformed usage record")
            continue
        ident = scalar(m.get("messageId"))
        e = Event(session, ident or f"{f.path}:{k}", when(u.get("timestamp") or m.get("timestamp"), m.get("messageId")), model, counter(u, "inputTokens"), counter(u, "outputTokens"), counter(u, "cacheReadInputTokens"), counter(u, "cacheCreationInputTokens"), turn=turn, workspace=where)
        match = first_free(by_id.get(ident)) if ident is not None else None
        if match is None:
            match = first_free(by_use.get((e.model, e.input, e.output)))
        if match is not None:
            used.add(match)
            own = ledger[match]
            own.turn, own.message_id, own.cache_read, own.cache_write = turn, ident or own.message_id, e.cache_read, e.cache_write
            e = own
        out.append(e)
    for e in [*out, *(ledger[j] for j in range(len(ledger)) if j not in used)]:
        e.key = f"{e.session_id}:{e.message_id}"
        yield e


# droid


def _droid_model(raw: str) -> str:
    m = re.sub(r"\[.*?\]", "", raw.removeprefix("custom:")).strip()
    return re.sub(r"-+", "-", re.sub(r"[.\s]+", "-", m)).strip("-").lower()


def _droid(files: list[Loaded]) -> Parsed:
    f = next((x for x in files if x.path.endswith(".settings.json")), None)
    if f is None:
        return
    doc = f.json()
    n = get(doc, "tokenUsage")
    if not isinstance(doc, dict):
        yield Skip(f.path, "malformed JSON")
        return
    if not isinstance(n, dict):
        yield Skip(f.path, "session without usage")
        return
    raw = text(doc.get("model"))
    if raw is None:
        side = next((x for x in files if x.path.endswith(".jsonl")), None)
        told = re.search(r"Model:\s*([^\n\"\\]+)", side.text) if side else None
        raw = told[1].strip() if told else {"anthropic": "claude-unknown", "openai": "gpt-unknown", "google": "gemini-unknown"}.get(str(doc.get("providerLock")), "droid-unknown")
    session = text(doc.get("session_id")) or os.path.basename(f.path).removesuffix(".settings.json")
    e = Event(session, session, stamp(doc.get("providerLockTimestamp")) or f.mtime_iso, _droid_model(raw), counter(n, "inputTokens"), counter(n, "outputTokens"), counter(n, "cacheReadTokens"), counter(n, "cacheCreationTokens"), counter(n, "thinkingTokens"), rank=float(f.mtime_ms))
    if e.total or f.idle:
        yield e


def _latest(df):
    """Per session the row of the highest rank; among equals the last."""
    from pyspark.sql import functions as F

    from ...operators.windows import best_of

    return best_of(df, ["session_id"], F.col("rank").desc(), F.col("lane").desc(), F.col("root_ord").desc(), F.col("src_path").desc(), F.col("src_ord").desc())


# augment


def _augment(files: list[Loaded]) -> Parsed:
    f = files[0]
    doc = f.json()
    if not isinstance(doc, dict):
        yield Skip(f.path, "malformed JSON")
        return
    session = text(doc.get("sessionId")) or stem(f.path)
    for k, t in enumerate(items(doc.get("chatHistory"))):
        x = get(t, "exchange")
        u = next((n["token_usage"] for n in reversed(items(get(x, "response_nodes"))) if isinstance(get(n, "token_usage"), dict) and n["token_usage"]), None)
        if get(t, "completed") is not True or u is None:
            continue
        model, when = text(get(x, "model_id")) or text(get(doc, "agentState", "modelId")), stamp(t.get("finishedAt")) or stamp(get(doc, "modified"))
        if model is None or when is None:
            yield Skip(f"{f.path}:{k}", "malformed usage record")
            continue
        ident = text(get(x, "request_id")) or scalar(t.get("sequenceId")) or str(k)
        name = f"augment:{session}:req:{ident}"
        e = Event(session, name, when, model, counter(u, "input_tokens"), counter(u, "output_tokens"), counter(u, "cache_read_input_tokens"), counter(u, "cache_creation_input_tokens"), turn=True, key=name)
        if e.total or f.idle:
            yield e


# codebuff

_BUFF = {"input": ("inputTokens", "input_tokens", "promptTokens", "prompt_tokens"), "output": ("outputTokens", "output_tokens", "completionTokens", "completion_tokens"), "cache_read": ("cacheReadInputTokens", "cache_read_input_tokens", "cachedInputTokens", "cacheReadTokens"), "cache_write": ("cacheCreationInputTokens", "cache_creation_input_tokens", "cacheCreationTokens", "cacheWriteTokens")}


def _codebuff(files: list[Loaded]) -> Parsed:
    f = files[0]
    rows = f.json()
    if not isinstance(rows, list):
        yield Skip(f.path, "malformed JSON")
        return
    chat = os.path.basename(os.path.dirname(f.path))
    session = "/".join([*f.path.replace("\\", "/").split("/")[-6:-5], *f.path.replace("\\", "/").split("/")[-4:-3], chat])
    started = stamp(re.sub(r"T(\d{2})-(\d{2})-(\d{2})", r"T\1:\2:\3", chat))
    for k, m in enumerate(rows):
        meta = get(m, "metadata")
        if get(m, "variant") not in ("ai", "agent") and get(m, "role") != "assistant":
            continue
        history = items(get(meta, "runState", "sessionState", "mainAgentState", "messageHistory"))
        sides = [get(h, "providerOptions") or get(h, "metadata") or h for h in reversed(history)]
        options = [x for s in sides for x in (s, get(s, "codebuff"))]
        chain = [get(meta, "usage"), get(meta, "codebuff", "usage"), *(get(o, "usage") for o in options)]
        e = Event(session, "", "", "")
        for u in chain:
            for bucket, names in _BUFF.items():
                if not getattr(e, bucket):
                    nested = get(u, "promptTokensDetails", "cachedTokens") or get(u, "prompt_tokens_details", "cached_tokens")
                    setattr(e, bucket, counter(u, *names) or (counter({"n": nested}, "n") if bucket == "cache_read" else 0))
        if not e.total and not f.idle:
            continue
        models = [get(meta, "model"), get(meta, "codebuff", "model"), *(get(o, "model") for o in options)]
        e.model = next((x for x in models if text(x)), "codebuff-unknown")
        e.timestamp = stamp(get(meta, "timestamp")) or stamp(m.get("timestamp")) or started or f.mtime_iso
        upstream = text(get(meta, "messageId")) or text(m.get("id"))
        e.message_id, e.turn = upstream or f"{f.path}:{k}", True
        e.key = f"{session}:{upstream}" if upstream else f"{session}:{e.timestamp}:{e.model}:{tokens_key(e)}"
        yield e


# jcode


def _jcode(files: list[Loaded]) -> Parsed:
    """A session's journal replaces its snapshot."""
    journal = next((f for f in files if f.path.endswith(".journal.jsonl")), None)
    snap = next((f for f in files if f.path.endswith(".json")), None)
    head = snap.json() if snap else None
    f = journal or snap
    if f is None:
        return
    if journal is None and not isinstance(head, dict):
        yield Skip(f.path, "malformed JSON")
        return
    model, session, where = text(get(head, "model")), text(get(head, "session_id")) or text(get(head, "id")), workspace(get(head, "working_dir"))
    rows: list[tuple[str, dict]] = []
    if journal:
        for k, v in lines(journal):
            if not isinstance(v, dict):
                yield Skip(f"{journal.path}:{k + 1}", "malformed JSON line")
                continue
            model, session = text(get(v, "meta", "model")) or text(v.get("model")) or model, text(v.get("session_id")) or session
            own = [v["message"]] if isinstance(v.get("message"), dict) else items(v.get("append_messages"))
            rows += [(f"{journal.path}:{k}", m) for m in own]
    else:
        rows = [(f"{f.path}:{k}", m) for k, m in enumerate(items(head.get("messages")))]
    session = session or stem(f.path).removesuffix(".journal")
    for place, m in rows:
        u = get(m, "token_usage") or get(m, "usage")
        if not isinstance(u, dict):
            continue
        own, when = text(m.get("model")) or model, stamp(m.get("timestamp")) or f.mtime_iso
        read, write = counter(u, "cache_read_input_tokens", "cached_tokens"), counter(u, "cache_creation_input_tokens")
        fresh = split_input(counter(u, "prompt_tokens"), read, write) if finite(u.get("prompt_tokens")) is not None else counter(u, "input_tokens")
        e = Event(session, text(m.get("id")) or place, when, own or "jcode-unknown", fresh, counter(u, "output_tokens", "completion_tokens"), read, write, counter(u, "reasoning_tokens"), turn=True, workspace=where)
        if e.total or f.idle:
            yield e


# mux


def _mux(files: list[Loaded]) -> Parsed:
    f = files[0]
    doc = f.json()
    if not isinstance(doc, dict):
        yield Skip(f.path, "malformed JSON")
        return
    session, when = os.path.basename(os.path.dirname(f.path)), epoch(get(doc, "lastRequest", "timestamp")) or f.mtime_iso
    for name, m in sorted((doc.get("byModel") or {}).items()):
        n = [counter(get(m, c), "tokens") for c in ("input", "output", "cached", "cacheCreate", "reasoning")]
        e = Event(session, f"mux:{session}:{name}", when, name.split(":", 1)[-1], *n, key=f"mux:{session}:{name}")
        if e.total or f.idle:
            yield e


# VS Code extensions


def code_roots(ctx: Context, extension: str) -> list[str]:
    base = [ctx.at(".config", "Code"), ctx.at("Library", "Application Support", "Code"), ctx.at(".vscode-server", "data"), ctx.at("AppData", "Roaming", "Code")]
    if ctx.get("APPDATA"):
        base.append(os.path.join(ctx.get("APPDATA"), "Code"))
    return [os.path.join(b, "User", "globalStorage", extension, "tasks") for b in base]


def extension_files(ctx: Context, extension: str) -> list[File]:
    keep = ends("ui_messages.json", "api_conversation_history.json")
    return units(under(code_roots(ctx, extension), keep), os.path.dirname)


def extension_parser(agent: str):
    def parse(files: list[Loaded]) -> Parsed:
        f = next((x for x in files if x.path.endswith("ui_messages.json")), None)
        if f is None:
            return
        rows = f.json()
        if not isinstance(rows, list):
            yield Skip(f.path, "malformed JSON")
            return
        side = next((x.text for x in files if x.path.endswith("api_conversation_history.json")), "")
        details = re.findall(r"<environment_details>(.*?)</environment_details>", side, re.S)
        models = [m for d in details for m in re.findall(r"<model>(.*?)</model>", d, re.S)]
        task, index = os.path.basename(os.path.dirname(f.path)), -1
        for r in rows:
            if get(r, "type") != "say" or get(r, "say") != "api_req_started":
                continue
            u = loads(r["text"]) if isinstance(r.get("text"), str) else None
            when = epoch(r.get("ts"))
            if not isinstance(u, dict) or when is None:
                yield Skip(f"{f.path}", "malformed usage record")
                continue
            index += 1
            by = text(u.get("apiProtocol"))
            model = text(u.get("model")) or (models[-1].strip() if models else "unknown")
            e = Event(task, f"{agent}:{task}:{index}", when, f"{by}/{model}" if by and "/" not in model else model, lenient(u.get("tokensIn")), lenient(u.get("tokensOut")), lenient(u.get("cacheReads")), lenient(u.get("cacheWrites")), key=f"{agent}:{task}:{index}")
            if e.total or f.idle:
                yield e

    return parse


def _extension(agent: str, extension: str) -> Reader:
    return Reader(agent, lambda c: extension_files(c, extension), extension_parser(agent))


# trae


def _trae(files: list[Loaded]) -> Parsed:
    """Naive local times are shifted by the offset that brings the latest one to the file's own time."""
    f = files[0]
    doc = f.json()
    if not isinstance(doc, dict):
        yield Skip(f.path, "malformed JSON")
        return
    naive = lambda v: isinstance(v, str) and re.search(r"(Z|[+-]\d{2}:?\d{2})$", v) is None
    cut = lambda v: re.sub(r"(\.\d{3})\d+", r"\1", v)
    rows = items(doc.get("llm_interactions"))
    stamps = [doc.get("start_time"), doc.get("end_time"), *(get(r, "timestamp") for r in rows), *(get(r, "timestamp") for r in items(doc.get("agent_steps")))]
    known = [ms for v in stamps if naive(v) and (ms := parse_ms(cut(v))) is not None]
    shift = 0
    if known:
        gap = f.mtime_ms - max(known)
        grid = round(gap / 900_000) * 900_000
        if abs(grid) <= 14 * 3_600_000 and abs(gap - grid) < 120_000:
            shift = grid
        else:
            yield Warn("time zone not found", f.path)
    for k, r in enumerate(rows):
        u = get(r, "response", "usage")
        if not isinstance(u, dict):
            continue
        own = get(r, "timestamp")
        ms = parse_ms(cut(own)) if isinstance(own, str) else None
        model = text(get(r, "response", "model")) or text(get(r, "model")) or text(doc.get("model"))
        try:
            if ms is None or model is None:
                raise Malformed
            n = [cell(u.get("input_tokens")), cell(u.get("output_tokens")), optional(u.get("cache_read_input_tokens")), optional(u.get("cache_creation_input_tokens")), optional(u.get("reasoning_tokens"))]
        except Malformed:
            yield Skip(f"{f.path}:{k}", "malformed usage record")
            continue
        from ..kit import iso

        yield Event(stem(f.path), f"{f.path}:{k}", iso(ms + (shift if naive(own) else 0)) or f.mtime_iso, model, *n, turn=True)


def _trae_files(ctx: Context) -> list[File]:
    return walk(os.path.join(ctx.cwd or os.getcwd(), "trajectories"), lambda p: re.fullmatch(r"trajectory_.*\.json", os.path.basename(p)) is not None, deep=False)


# reasonix


def _reasonix(files: list[Loaded]) -> Parsed:
    f = files[0]
    if f.lane == 0:
        for k, row in lines(f):
            try:
                when, model = stamp(get(row, "ts")), text(get(row, "model"))
                if when is None or model is None:
                    raise Malformed
                done, think = cell(row.get("completion")), optional(row.get("reasoning"))
                if think > done:
                    raise Malformed
                e = Event(text(row.get("session")) or stem(f.path), f"{f.path}:{k + 1}", when, model, optional(row.get("cache_miss")), done - think, optional(row.get("cache_hit")), 0, think, turn=True)
            except Malformed:
                yield Skip(f"{f.path}:{k + 1}", "malformed usage record")
                continue
            if e.total or f.idle:
                yield e
        return
    meta = next((x.json() for x in files if x.path.endswith(".meta")), None)
    for x in files:
        if x.path.endswith(".meta"):
            continue
        doc = x.json()
        if x.path.endswith(".telemetry.json") and meta is None:
            continue
        if not isinstance(doc, dict):
            yield Skip(x.path, "malformed JSON")
            continue
        head = doc if x.path.endswith(".acp.json") else {**(meta or {}), **{k: v for k, v in doc.items() if v is not None}}
        c = get(doc, "status", "cumulative") or get(doc, "cumulative") or get(doc, "usage")
        model, session = text(head.get("model")), text(head.get("sessionId")) or text(head.get("id")) or os.path.basename(x.path).split(".")[0]
        when = stamp(head.get("updatedAt")) or stamp(head.get("updated_at")) or x.mtime_iso
        done, think = counter(c, "completionTokens"), counter(c, "reasoningTokens")
        if not isinstance(c, dict) or model is None or think > done:
            yield Skip(x.path, "malformed usage record")
            continue
        hit = counter(c, "cacheHitTokens")
        fresh = counter(c, "cacheMissTokens") if finite(c.get("cacheMissTokens")) is not None else split_input(counter(c, "promptTokens"), hit)
        e = Event(session, x.path, when, model, fresh, done - think, hit, 0, think, turn=True, workspace=workspace(head.get("cwd") or head.get("workspace")), title=text(head.get("title")) or text(head.get("preview")), rank=float(parse_ms(when) or 0))
        if e.total or x.idle:
            yield e


def _reasonix_files(ctx: Context) -> list[File]:
    roots = [p for p in (ctx.get("REASONIX_HOME"), os.path.join(ctx.get("APPDATA"), "reasonix") if ctx.get("APPDATA") else None, ctx.at(".reasonix")) if p]
    ledger = under([os.path.join(r, "stats") for r in roots], ends(".jsonl"))
    if ledger:
        return ledger
    side = under([os.path.join(r, "projects") for r in roots], ends(".acp.json", ".jsonl.telemetry.json", ".jsonl.meta"), lane=1)
    return units(side, lambda p: re.sub(r"\.(telemetry\.json|meta)$", "", p))


def _first_best(df):
    """Sidecars are cumulative: per session the latest, the first among equals.  Ledgers stay as they are."""
    from pyspark.sql import functions as F

    from ...operators.windows import best_of

    side = best_of(df.where("lane > 0"), ["session_id"], F.col("rank").desc(), F.col("root_ord"), F.col("src_path"))
    return df.where("lane = 0").unionByName(side)


def _gemini_files(ctx: Context) -> list[File]:
    root = ctx.get("GEMINI_DATA_DIR") or ctx.at(".gemini")
    return under([os.path.join(root, "tmp")], lambda p: p.endswith((".json", ".jsonl")) and "chats" in p.split(os.sep))


def _buff_roots(ctx: Context) -> list[str]:
    return ctx.many("CODEBUFF_DATA_DIR") or [ctx.at(".config", f"manicode{x}") for x in ("", "-dev", "-staging")]


READERS = [
    Reader("gemini", _gemini_files, _gemini),
    Reader("amp", lambda c: under([os.path.join(c.get("AMP_DATA_DIR") or c.at(".local", "share", "amp"), "threads")], lambda p: re.fullmatch(r"T-.*\.json", os.path.basename(p)) is not None), _amp),
    Reader("droid", lambda c: units(under([c.get("DROID_SESSIONS_DIR") or c.at(".factory", "sessions")], ends(".settings.json", ".jsonl")), lambda p: re.sub(r"(\.settings\.json|\.jsonl)$", "", p)), _droid, _latest),
    Reader("augment", lambda c: under([c.get("AUGMENT_SESSIONS_DIR") or c.at(".augment", "sessions")], JSON), _augment),
    Reader("codebuff", lambda c: under([r if os.path.basename(r) == "projects" else os.path.join(r, "projects") for r in _buff_roots(c)], ends("chat-messages.json")), _codebuff),
    Reader("jcode", lambda c: units(under([os.path.join(c.get("JCODE_HOME") or c.at(".jcode"), "sessions")], ends(".json", ".journal.jsonl")), lambda p: re.sub(r"(\.journal\.jsonl|\.json)$", "", p)), _jcode),
    Reader("mux", lambda c: under([c.get("MUX_SESSIONS_DIR") or c.at(".mux", "sessions")], ends("session-usage.json")), _mux),
    _extension("roo", "rooveterinaryinc.roo-cline"),
    _extension("kilocode", "kilocode.kilo-code"),
    Reader("trae", _trae_files, _trae),
    Reader("reasonix", _reasonix_files, _reasonix, _first_best),
]
