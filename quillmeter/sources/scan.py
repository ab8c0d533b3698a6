"""From a reader to DataFrames: Spark reads the files, executors parse the units.

Of several homes each is listed and read by a task: the driver knows homes, not files.
"""

from __future__ import annotations

import os
from collections.abc import Callable, Iterator, Sequence
from dataclasses import replace

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.instants import parse_ms
from ..operators.windows import first_wins
from .kit import Context, Contexts, Event, File, Loaded, Malformed, Reader, Skip
from .logs_in_columns import LISTED, few_listing_tasks, log_lines, plain_path, split_logs
from .messages import worded
from .sqlite import LOG

#: What opening a file is held to cost, in bytes, and Spark's own value, which it stands for: logs are many and small,
#: and at Spark's own at most 32 of them make a task
OPEN_BYTES, _OPEN, _SPARKS_OWN = 64 << 10, "spark.sql.files.openCostInBytes", ("4194304", "4194304b", "4MB")
#: How SQLite stores are named
STORES = (".db", ".sqlite", ".sqlite3")
ORDER = ["lane", "root_ord", "src_path", "src_ord"]
_EVENT = "session_id string, message_id string, timestamp string, model string, input bigint, output bigint, cache_read bigint, cache_write bigint, reasoning bigint, cache_write_1h bigint, turn boolean, subagent boolean, calls bigint, cost_usd double, workspace string, title string, key string, rank double"
PARSED = f"kind string, message string, location string, lane int, root_ord int, src_path string, src_ord bigint, {_EVENT}"


_KINDS = {"string": pa.string(), "int": pa.int32(), "bigint": pa.int64(), "boolean": pa.bool_(), "double": pa.float64()}
_SCHEMA = pa.schema([(n, _KINDS[k]) for n, k in (c.split() for c in PARSED.split(", "))])


def _rows(reader: Reader, files: list[Loaded]) -> pa.Table:
    out, first = [], files[0] if files else None
    if first is None:
        return pa.Table.from_pylist(out, schema=_SCHEMA)
    place = {"lane": first.lane, "root_ord": first.root, "src_path": first.path}
    try:
        for k, item in enumerate(reader.parse(files)):
            if isinstance(item, Event):
                out.append({"kind": "event", **place, "src_ord": k, **vars(item)})
            else:
                out.append({"kind": "skip" if isinstance(item, Skip) else "warning", "message": item.message, "location": item.location, **place, "src_ord": k})
    except Malformed:
        out.append({"kind": "skip", "message": "malformed file", "location": first.path, **place, "src_ord": 0})
    return pa.Table.from_pylist(out, schema=_SCHEMA)


def with_logs(files: list[File]) -> list[File]:
    """The files, and the write-ahead logs beside SQLite stores, in their stores' units."""
    out = []
    for f in files:
        log = f.path + LOG
        if f.path.endswith(STORES) and os.path.isfile(log) and os.path.getsize(log):
            f = File(f.path, f.root, f.lane, f.unit or f.path)
            out.append(File(log, f.root, f.lane, f.unit))
        out.append(f)
    return out


def _loaded(batch: pa.Table | pa.RecordBatch, idle: bool = False) -> list[Loaded]:
    """The files of a batch in order, stores with their logs."""
    return _ordered([Loaded(*row, idle=idle) for row in zip(*(batch.column(c).to_pylist() for c in ("path", "root", "lane", "content", "mtime")))])


def _ordered(found: list[Loaded]) -> list[Loaded]:
    logs = {x.path: x.data for x in found if x.path.endswith(LOG)}
    rest = [replace(x, log=logs[x.path + LOG]) if x.path + LOG in logs else x for x in found if x.path not in logs]
    return sorted(rest, key=lambda x: (x.lane, x.root, x.path))


def _opened(f: File, idle: bool = False) -> Loaded:
    with open(f.path, "rb") as h:
        return Loaded(f.path, f.root, f.lane, h.read(), os.fstat(h.fileno()).st_mtime_ns // 1_000_000, idle=idle)


def _each_home(spark: SparkSession, homes: Sequence[Context], run: Callable[[Context], Iterator[pa.RecordBatch]], schema: str) -> DataFrame:
    """What ``run`` gives for each home, on the executors, a task for a home."""

    def tasks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k in batch.column("id").to_pylist():
                yield from run(homes[k])

    return spark.range(0, len(homes), 1, len(homes)).mapInArrow(tasks, schema)


def _homes_rows(spark: SparkSession, reader: Reader, homes: Sequence[Context], idle: bool) -> DataFrame:
    def run(home: Context) -> Iterator[pa.RecordBatch]:
        units: dict[str, list[File]] = {}
        for f in with_logs(reader.find(home)):
            units.setdefault(f.unit or f.path, []).append(f)
        for files in units.values():  # one unit at a time is read and parsed
            yield from _rows(reader, _ordered([_opened(f, idle) for f in files])).to_batches()

    return _each_home(spark, homes, run, PARSED)


def _homes_lines(spark: SparkSession, reader: Reader, homes: Sequence[Context]) -> DataFrame:
    """``log_lines`` of the logs of some homes."""

    def run(home: Context) -> Iterator[pa.RecordBatch]:
        for f in reader.find(home):
            one = _opened(f)
            yield pa.RecordBatch.from_arrays([pa.array([x], k) for x, k in ((f.lane, pa.int32()), (f.root, pa.int32()), (f.path, pa.string()), (one.data, pa.binary()))], names=["lane", "root_ord", "src_path", "log"])

    logs = _each_home(spark, homes, run, "lane int, root_ord int, src_path string, log binary")
    return split_logs(logs.withColumn("log", F.make_valid_utf8(F.col("log").cast("string"))))


def _many_in_a_task(spark: SparkSession) -> None:
    """Set for the session, unless it was changed: a scan's tasks are made when it runs."""
    if spark.conf.get(_OPEN) in _SPARKS_OWN:
        spark.conf.set(_OPEN, str(OPEN_BYTES))


def parsed(spark: SparkSession, reader: Reader, ctx: Contexts, idle: bool = False) -> DataFrame:
    """All rows of a reader, before what spans its units."""
    found = reader.idle_columns if idle and reader.idle_columns is not None else reader.columns
    if not isinstance(ctx, Context) and len(ctx) > 1:
        return _homes_rows(spark, reader, ctx, idle) if found is None else found(_homes_lines(spark, reader, ctx))
    files = with_logs(reader.files(ctx))
    if not files:
        return spark.createDataFrame([], PARSED)
    _many_in_a_task(spark)
    if found is not None:
        return found(log_lines(spark, files))
    grouped = any(f.unit is not None for f in files)
    listed = spark.createDataFrame([(f.path, f.root, f.lane, f.unit or f.path) for f in files], "path string, root int, lane int, unit string")
    with few_listing_tasks(spark):
        read = spark.read.format("binaryFile").load(list(dict.fromkeys(f.path for f in files)))
    raw = read.select(plain_path(F.col("path")).alias("path"), "content", F.unix_millis("modificationTime").alias("mtime"))
    # the list is rows of short texts that the driver has anyway
    raw = raw.join(F.broadcast(listed) if len(files) <= LISTED else listed, "path")
    if grouped:
        return raw.groupBy("unit").applyInArrow(lambda t: _rows(reader, _loaded(t, idle)), PARSED)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k in range(batch.num_rows):
                # one file at a time is copied and parsed
                yield from _rows(reader, _loaded(batch.slice(k, 1), idle)).to_batches()

    return raw.drop("unit").mapInArrow(run, PARSED)


def read(spark: SparkSession, reader: Reader, ctx: Contexts, idle: bool = False) -> tuple[DataFrame, DataFrame]:
    """(events in the normalized schema and order columns, diagnostics)."""
    rows = parsed(spark, reader, ctx, idle)
    if reader.columns is None:
        rows = rows.persist()  # what Python parsed is kept; columns are cheaper to read again, and events need no skips then
    events = rows.where("kind = 'event'")
    if reader.finish is not None:
        events = reader.finish(events)
    # an event without a key is the only one of its place: all are read once
    alone = F.when(F.col("key").isNull(), F.struct(*ORDER))
    events = first_wins(events.withColumn("alone", alone), ["key", "alone"], ORDER).drop("alone")
    tokens = F.struct("input", "output", "cache_read", "cache_write", "cache_write_1h", "reasoning").alias("tokens")
    shaped = events.select(F.lit(reader.id).alias("harness"), "timestamp", parse_ms(F.col("timestamp")).alias("ts_ms"), "session_id", "message_id", "turn", "subagent", "model", tokens, "calls", "cost_usd", "workspace", "title", *ORDER)
    notes = rows.where("kind <> 'event'").select(F.lit("warning").alias("severity"), worded(reader.id).alias("message"), F.lit(reader.id).alias("harness"), F.col("location").alias("path"), (F.col("kind") == "skip").alias("skipped"))
    return shaped, notes


