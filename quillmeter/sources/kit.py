"""What log parsers share: strict JSON cells, timestamps, the parse context and results.

A parser sees the files of one unit (mostly one file), as bytes that Spark has
read, and yields events, skips and warnings in file order.  Parsers run on the
executors, unit by unit; whatever spans units is done on the resulting DataFrame.
"""

from __future__ import annotations

import json
import math
import os
import re
from collections.abc import Callable, Iterable, Iterator, Sequence
from dataclasses import dataclass, field
from datetime import date
from pathlib import Path
from typing import Any

from pyspark.sql import DataFrame

MAX_MS = 8_640_000_000_000_000
_ISO = re.compile(r"(\d{4})-(\d{2})-(\d{2})(?:[T ](\d{2}):(\d{2})(?::(\d{2})(?:\.(\d+))?)?(Z|[+-]\d{2}:\d{2})?)?", re.A)


class Malformed(Exception):
    """A record that has usage but not in the expected shape."""


@dataclass(frozen=True)
class Context:
    """Where to look: home, environment (empty values are unset), current folder."""

    home: str
    env: dict[str, str] = field(default_factory=dict)
    cwd: str | None = None

    @classmethod
    def of_process(cls) -> Context:
        return cls(str(Path.home()), dict(os.environ), os.getcwd())

    def get(self, name: str) -> str | None:
        return self.env.get(name) or None

    def at(self, *parts: str) -> str:
        return os.path.join(self.home, *parts)

    def many(self, name: str) -> list[str]:
        return [p.strip() for p in (self.get(name) or "").split(",") if p.strip()]


#: One home, or those of several machines, in order
Contexts = Context | Sequence[Context]


@dataclass(frozen=True)
class File:
    path: str
    root: int = 0
    lane: int = 0
    unit: str | None = None


@dataclass(frozen=True)
class Loaded:
    path: str
    root: int
    lane: int
    data: bytes
    mtime_ms: int
    log: bytes = b""  # the write-ahead log beside a SQLite store
    idle: bool = False  # records that used no tokens are events too

    @property
    def text(self) -> str:
        return self.data.decode("utf-8", "replace")

    def json(self) -> Any:
        """The document, or None."""
        return loads(self.text)

    @property
    def mtime_iso(self) -> str:
        return iso(self.mtime_ms) or "1970-01-01T00:00:00.000Z"


@dataclass
class Event:
    session_id: str
    message_id: str
    timestamp: str
    model: str
    input: int = 0
    output: int = 0
    cache_read: int = 0
    cache_write: int = 0
    reasoning: int = 0
    cache_write_1h: int | None = None
    turn: bool = False
    subagent: bool = False
    calls: int | None = None
    cost_usd: float | None = None
    workspace: str | None = None
    title: str | None = None
    key: str | None = None  # repeats of it are dropped, the first stays
    rank: float = 0.0  # for readers that keep the best of a key

    @property
    def total(self) -> int:
        return self.input + self.output + self.cache_read + self.cache_write + self.reasoning


@dataclass
class Skip:
    """A location that was not read, with a warning."""

    location: str
    message: str = "malformed record"


@dataclass
class Warn:
    message: str
    location: str


Parsed = Iterator[Event | Skip | Warn]


@dataclass(frozen=True)
class Reader:
    id: str
    find: Callable[[Context], list[File]]
    parse: Callable[[list[Loaded]], Parsed]
    finish: Callable[[DataFrame], DataFrame] | None = None
    columns: Callable[[DataFrame], DataFrame] | None = None  # of the lines of logs; then nothing is parsed in Python
    idle_columns: Callable[[DataFrame], DataFrame] | None = None  # the same with records of no tokens, where columns leaves them out

    def files(self, ctx: Contexts) -> list[File]:
        """The files of one home, or of several."""
        return [f for c in ([ctx] if isinstance(ctx, Context) else ctx) for f in self.find(c)]

    def any(self, ctx: Contexts) -> bool:
        """Whether a home has files; those after it are not looked at."""
        return any(self.find(c) for c in ([ctx] if isinstance(ctx, Context) else ctx))


def loads(text: str) -> Any:
    def never(_: str) -> None:
        raise ValueError

    try:
        return json.loads(text, parse_constant=never)
    except (ValueError, RecursionError):
        return None


def lines(f: Loaded) -> Iterator[tuple[int, Any]]:
    """(0-based physical line, value); the value is None for a line that is no JSON."""
    for k, line in enumerate(f.text.split("\n")):
        if line.strip():
            yield k, loads(line.strip())


def objects(f: Loaded) -> Iterator[tuple[int, dict] | Skip]:
    """Objects of a JSON-lines file; other lines are skips."""
    for k, value in lines(f):
        if isinstance(value, dict):
            yield k, value
        elif value is None:
            yield Skip(f"{f.path}:{k + 1}", "malformed JSON line")


def finite(value: Any) -> float | None:
    if isinstance(value, bool) or not isinstance(value, (int, float)):
        return None
    return value if math.isfinite(value) else None


def cell(value: Any) -> int:
    """A required counter: a number of zero or more."""
    v = finite(value)
    if v is None or v < 0:
        raise Malformed
    return int(v)


def optional(value: Any) -> int:
    return 0 if value is None else cell(value)


def lenient(value: Any) -> int:
    """A counter where anything else counts as zero; numeric strings count."""
    if isinstance(value, str):
        try:
            value = float(value)
        except ValueError:
            return 0
    v = finite(value)
    return int(v) if v is not None and v > 0 else 0


def pick(obj: Any, *names: str) -> float | None:
    """The first of the names that is a finite number."""
    for n in names:
        v = finite(get(obj, n))
        if v is not None:
            return v
    return None


def counter(obj: Any, *names: str) -> int:
    return max(0, int(pick(obj, *names) or 0))


def get(obj: Any, *path: str) -> Any:
    for name in path:
        if not isinstance(obj, dict):
            return None
        obj = obj.get(name)
    return obj


def text(value: Any) -> str | None:
    """A string that is not blank."""
    return value if isinstance(value, str) and value.strip() else None


def scalar(value: Any) -> str | None:
    """A string or number as text."""
    if isinstance(value, str):
        return value or None
    v = finite(value)
    return None if v is None else str(int(v)) if v == int(v) else repr(v)


def parse_ms(value: str) -> int | None:
    m = _ISO.fullmatch(value)
    if not m:
        return None
    y, mo, d, h, mi, s = (int(x or 0) for x in m.groups()[:6])
    if not (1 <= mo <= 12 and 1 <= d <= 31 and h < 24 and mi < 60 and s < 60 and y >= 1):
        return None
    zone = m[8] or "Z"
    offset = 0 if zone == "Z" else (int(zone[1:3]) * 60 + int(zone[4:6])) * (-1 if zone[0] == "-" else 1)
    days = date(y, mo, 1).toordinal() - date(1970, 1, 1).toordinal() + d - 1
    return ((days * 24 + h) * 60 + mi - offset) * 60_000 + s * 1000 + int(((m[7] or "") + "000")[:3])


def iso(ms: float | None) -> str | None:
    if ms is None or not math.isfinite(ms) or abs(ms) > MAX_MS:
        return None
    days, rest = divmod(int(ms), 86_400_000)
    try:
        day = date.fromordinal(date(1970, 1, 1).toordinal() + days)
    except (ValueError, OverflowError):
        return None
    s, milli = divmod(rest, 1000)
    return f"{day.isoformat()}T{s // 3600:02d}:{s // 60 % 60:02d}:{s % 60:02d}.{milli:03d}Z"


def epoch(value: Any, unit: str = "auto") -> str | None:
    """ISO of an epoch number in "ms" or "s"; "auto": milliseconds from 1e12 on."""
    v = finite(value)
    if v is None or v <= 0:
        return None
    return iso(v if unit == "ms" or (unit == "auto" and v >= 1e12) else v * 1000)


def stamp(value: Any) -> str | None:
    """ISO of a number, numeric string or ISO string."""
    if isinstance(value, str):
        ms = parse_ms(value.strip())
        if ms is not None:
            return iso(ms)
        try:
            return epoch(float(value))
        except ValueError:
            return None
    return epoch(value)


def workspace(raw: Any) -> str | None:
    """The Python twin of functions.paths.normalize_workspace."""
    if not isinstance(raw, str) or not raw.strip():
        return None
    p = raw.strip().replace("\\", "/")
    unc, drive = p.startswith("//"), re.match(r"[A-Za-z]:(/|$)", p)
    p = ("/" if unc else "") + re.sub("/+", "/", p)
    p = p.rstrip("/") or "/"
    if re.fullmatch("[A-Za-z]:", p):
        p += "/"
    return p.lower() if unc or drive else p


def split_input(total: int, *parts: int) -> int:
    """What is left of a total, at least zero."""
    return max(0, total - sum(parts))


def walk(root: str, keep: Callable[[str], bool], order: int = 0, lane: int = 0, deep: bool = True) -> list[File]:
    """Files below a folder, hidden ones too, sorted by path; unreadable folders are passed over."""
    if os.path.isfile(root):
        return [File(root, order, lane)] if keep(root) else []
    found = []
    for folder, dirs, names in os.walk(root):
        found += [os.path.join(folder, n) for n in names if keep(os.path.join(folder, n))]
        if not deep:
            dirs.clear()
    return [File(p, order, lane) for p in sorted(found)]


def under(roots: Iterable[str], keep: Callable[[str], bool], lane: int = 0) -> list[File]:
    return [f for k, r in enumerate(dict.fromkeys(roots)) for f in walk(r, keep, k, lane)]


def ends(*suffixes: str) -> Callable[[str], bool]:
    return lambda p: p.endswith(suffixes)


def stem(path: str) -> str:
    name = os.path.basename(path)
    return name[: name.rindex(".")] if "." in name[1:] else name


def units(files: list[File], of: Callable[[str], str]) -> list[File]:
    """The files with their unit: what is parsed together."""
    return [File(f.path, f.root, f.lane, of(f.path)) for f in files]


def tokens_key(e: Event) -> str:
    return json.dumps([e.input, e.output, e.cache_read, e.cache_write, e.cache_write_1h, e.reasoning])
