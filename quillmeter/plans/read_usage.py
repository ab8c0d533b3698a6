"""Reading usage: chosen readers, instants, bounds, and what was left out."""

from __future__ import annotations

from collections.abc import Iterable
from dataclasses import dataclass
from datetime import UTC, date, datetime, timedelta
from functools import reduce
from zoneinfo import ZoneInfo

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.instants import zone
from ..schema import DIAGNOSTIC, SEQ, SKIPPED, USAGE_EVENT
from ..sources import scan
from ..sources.kit import Context, Contexts, parse_ms
from ..sources.readers import IDS, REGISTRY

#: Agents that are known but keep no usage on disk
UNSUPPORTED = ("cursor", "windsurf", "antigravity", "warp")


@dataclass(frozen=True)
class Usage:
    events: DataFrame
    diagnostics: DataFrame
    skipped: DataFrame


def zoned_midnight(day: date, tz: str) -> int:
    """Epoch milliseconds at which a local day begins: the first valid instant in a gap, the first in a fold."""
    where = ZoneInfo(tz)
    naive = datetime(day.year, day.month, day.day)
    at = naive.replace(tzinfo=where, fold=0).astimezone(UTC)
    back = at.astimezone(where).replace(tzinfo=None)
    if back != naive:  # midnight is skipped: seek the change within the next hours
        lo, hi = at - timedelta(hours=6), at + timedelta(hours=6)
        while hi - lo > timedelta(milliseconds=1):
            mid = lo + (hi - lo) / 2
            lo, hi = (mid, hi) if mid.astimezone(where).date() < day else (lo, mid)
        at = hi.replace(microsecond=hi.microsecond // 1000 * 1000)
    return round(at.timestamp() * 1000)


def bound_ms(text: str, tz: str, end: bool = False) -> int:
    """A bound: an instant, or a date, which as an end means the next local midnight."""
    if len(text) == 10:
        day = date.fromisoformat(text)
        return zoned_midnight(day + timedelta(days=1) if end else day, tz)
    ms = parse_ms(text)
    if ms is None:
        raise ValueError(f"unusable bound {text!r}")
    return ms


def empty(spark: SparkSession, schema: str) -> DataFrame:
    return spark.createDataFrame([], schema)


def bounded(events: DataFrame, since_ms: int | None = None, until_ms: int | None = None, subagents: str = "include") -> DataFrame:
    """Events with an instant in [since, until), with ``subagents="exclude"`` without those of subagents."""
    kept = events.where(F.col("ts_ms").isNotNull())
    if since_ms is not None:
        kept = kept.where(F.col("ts_ms") >= since_ms)
    if until_ms is not None:
        kept = kept.where(F.col("ts_ms") < until_ms)
    return kept.where(~F.col("subagent")) if subagents == "exclude" else kept


def read_usage(spark: SparkSession, ctx: Contexts | None = None, harnesses: Iterable[str] | None = None, since: str | None = None, until: str | None = None, subagents: str = "include", tz: str | None = None, idle: bool = False) -> Usage:
    """Events of the chosen readers (all by default), in [since, until), with diagnostics.

    ``ctx`` is a home, or several of as many machines, whose stores are
    listed and read side by side, by executors.
    With ``idle`` records that used no tokens, which many readers leave out, are events too.
    Only the chosen readers' scans are built.  Events without a usable instant
    are dropped with a diagnostic, bounds or not.  ``seq`` is an event's place in
    the order in which the readers read.
    """
    ctx = ctx or Context.of_process()
    chosen = list(IDS if harnesses is None else harnesses)
    unknown = [h for h in chosen if h not in REGISTRY and h not in UNSUPPORTED]
    if unknown:
        raise ValueError(f"unknown harness {', '.join(unknown)}")
    parts = [(k, scan.read(spark, REGISTRY[h], ctx, idle)) for k, h in enumerate(IDS) if h in chosen and REGISTRY[h].any(ctx)]
    if not parts:
        return Usage(empty(spark, f"{USAGE_EVENT}, {SEQ}"), empty(spark, DIAGNOSTIC), empty(spark, SKIPPED))
    place = lambda k: F.struct(F.lit(k).alias("reader"), *[F.col(c) for c in scan.ORDER]).alias("seq")
    events = reduce(DataFrame.unionByName, (e.select("*", place(k)) for k, (e, _) in parts))
    notes = reduce(DataFrame.unionByName, (n for _, (_, n) in parts))
    quoted = F.regexp_extract(F.to_json(F.struct(F.coalesce("timestamp", F.lit("")).alias("t"))), r"^\{\"t\":(.*)\}$", 1)
    lost = events.where("ts_ms is null").select(F.lit("warning").alias("severity"), F.concat(F.lit("dropping event "), "message_id", F.lit(" with unusable timestamp "), quoted).alias("message"), "harness", F.col("src_path").alias("path"))
    where = zone(tz)
    kept = bounded(events, None if since is None else bound_ms(since, where), None if until is None else bound_ms(until, where, end=True), subagents)
    names = [c.name for c in empty(spark, USAGE_EVENT).schema]
    diagnostics = notes.select("severity", "message", "harness", "path").unionByName(lost)
    skipped = notes.where("skipped").select("harness", F.col("path").alias("location"))
    return Usage(kept.select(*names, "seq"), diagnostics, skipped)


def detect(ctx: Context | None = None) -> dict[str, bool]:
    """Which agents have a store: by paths alone, without reading any."""
    ctx = ctx or Context.of_process()
    return {name: bool(REGISTRY[name].find(ctx)) for name in IDS} | dict.fromkeys(UNSUPPORTED, False)


def detect_by_read(spark: SparkSession, ctx: Context | None = None) -> dict[str, bool]:
    """Which agents' stores give at least one event."""
    ctx = ctx or Context.of_process()
    found = {name: bool(REGISTRY[name].find(ctx)) and not scan.read(spark, REGISTRY[name], ctx)[0].isEmpty() for name in IDS}
    return found | dict.fromkeys(UNSUPPORTED, False)
