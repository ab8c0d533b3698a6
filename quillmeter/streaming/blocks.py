"""Billing blocks of a stream: opened, extended and closed as events arrive.

State of a key (a session, a harness): the events that the watermark has not
passed, summed by instant, as an earlier one may still come; and the open block.
Once the watermark has passed an instant its place in the order is final: it joins
the open block or closes it and opens the next.  A block is given out once, when
the watermark has passed its end, so its row never changes.  What a key holds is
bounded by the lateness and one block.

The session must use the RocksDB state store:
``spark.sql.streaming.stateStore.providerClass`` = PROVIDER.
"""

from __future__ import annotations

from collections.abc import Iterator
from datetime import datetime, timezone
from zoneinfo import ZoneInfo

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle

from ..functions.instants import zone
from ..operators.blocks import DEFAULT_BLOCK_MS, HOUR_MS
from ..schema import COUNTERS
from .ingest import with_event_time

PROVIDER = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
_SUMS = ("events", *COUNTERS)
_STATE = ", ".join(f"{c} BIGINT" for c in _SUMS)


class Blocks(StatefulProcessor):
    def __init__(self, tz: str, width: int):
        self.zone, self.width = ZoneInfo(tz), width

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.pending = handle.getMapState("pending", "ts_ms BIGINT", _STATE)
        self.open = handle.getValueState("open", f"start BIGINT, {_STATE}")

    def start_of(self, ms: int) -> int:
        local = datetime.fromtimestamp(ms // 1000, timezone.utc).astimezone(self.zone)
        return ms - ((local.minute * 60 + local.second) * 1000 + ms % 1000) % min(self.width, HOUR_MS)

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:  # noqa: N802, N803  Spark's names
        for part in rows:
            for ms, sums in part.groupby("ts_ms")[list(_SUMS)].sum().iterrows():
                at = (int(ms),)
                held = self.pending.getValue(at) if self.pending.containsKey(at) else (0,) * len(_SUMS)
                self.pending.updateValue(at, tuple(int(a) + int(b) for a, b in zip(held, sums)))
        yield from self._advance(key, timerValues)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        yield from self._advance(key, timerValues)

    def _advance(self, key, timer_values) -> Iterator[pd.DataFrame]:
        """Place what the watermark has passed, give out closed blocks, ask to be called for the rest."""
        passed, out = timer_values.getCurrentWatermarkInMs(), []
        block = self.open.get() if self.open.exists() else None
        waiting = sorted(((k[0], tuple(v)) for k, v in self.pending.iterator()))
        for ms, sums in waiting:
            if ms >= passed:
                break
            if block is not None and ms >= block[0] + self.width:
                out.append(block)
                block = None
            block = (self.start_of(ms), *sums) if block is None else (block[0], *[a + b for a, b in zip(block[1:], sums)])
            self.pending.removeKey((ms,))
        if block is not None and block[0] + self.width <= passed:
            out.append(block)
            block = None
        if block is None:
            self.open.clear()
        else:
            self.open.update(tuple(block))
        due = [ms + 1 for ms, _ in waiting if ms >= passed][:1] + ([block[0] + self.width] if block is not None else [])
        for at in due:
            self.handle.registerTimer(at)
        if out:
            yield pd.DataFrame([(*key, *b) for b in out], columns=["key", "block_start", *_SUMS])

    def close(self) -> None:
        pass


def block_stream(events: DataFrame, by: str = "session_id", tz: str | None = None, block_ms: int = DEFAULT_BLOCK_MS, late: str = "1 hour") -> DataFrame:
    """(key, block_start, events, token sums) of the closed blocks of each ``by``, as in a batch over its events.

    Events later than ``late`` behind the latest are dropped, as are those without
    an instant; null keys are one key.  Null counters count as zero.
    """
    timed = with_event_time(events.where("ts_ms is not null")).withWatermark("event_time", late)
    counts = [F.lit(1).cast("bigint").alias("events"), *[F.coalesce(F.col("tokens")[c], F.lit(0)).cast("bigint").alias(c) for c in COUNTERS]]
    keyed = timed.select(F.coalesce(F.col(by).cast("string"), F.lit("(unknown)")).alias("key"), "ts_ms", "event_time", *counts).groupBy("key")
    width = block_ms if block_ms > 0 else DEFAULT_BLOCK_MS
    return keyed.transformWithStateInPandas(Blocks(zone(tz), width), f"key STRING, block_start BIGINT, {_STATE}", "Append", "EventTime")
