"""Rollups of usage events on six dimensions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.cost import one_hour_writes
from ..functions.instants import day_key, iso, zone
from ..schema import COUNTERS
from .blocks import DEFAULT_BLOCK_MS, with_block

#: Where counters stop, as unsigned and as signed 64-bit numbers
MOST, MOST_LONG = "18446744073709551615", "9223372036854775807"
LOW_BITS = 24
DIMENSIONS = ("model", "day", "session", "harness", "workspace", "block")


def key_column(by: str, tz: str | None) -> Column:
    if by == "day":
        return day_key(F.col("ts_ms"), zone(tz))
    if by == "workspace":
        return F.coalesce("workspace", F.lit("(unknown)"))
    return F.col({"model": "model", "session": "session_id", "harness": "harness"}[by])


def saturating_sum(c: Column, unsigned: bool = False) -> Column:
    """The sum of counters, stopping at the largest 64-bit number instead of failing.

    High and low parts are summed as longs, so rows cost no decimals; a group's
    parts meet in one.  As a BIGINT, or with ``unsigned`` as a decimal.
    """
    low = F.sum(c.bitwiseAND(F.lit((1 << LOW_BITS) - 1)))
    high = F.try_sum(F.call_function("shiftright", c, F.lit(LOW_BITS)))
    most = F.lit(MOST if unsigned else MOST_LONG).cast("decimal(38,0)")
    total = high.cast("decimal(28,0)") * F.lit(1 << LOW_BITS).cast("decimal(9,0)") + low.cast("decimal(28,0)")
    held = F.when(low.isNotNull(), F.coalesce(F.least(total.cast("decimal(38,0)"), most), most))
    return held if unsigned else held.cast("bigint")


def aggregates(saturate: bool = False) -> list[Column]:
    """Token sums (with ``saturate`` as unsigned decimals), events, turns, calls, cost."""
    t = F.col("tokens")
    zero = F.lit(0).cast("decimal(38,0)" if saturate else "bigint")
    sums = [F.coalesce(saturating_sum(t[c], saturate), zero).alias(c) for c in COUNTERS]
    finite = F.when(F.abs("cost_usd") < float("inf"), F.col("cost_usd"))
    return [
        *sums,
        saturating_sum(one_hour_writes(t), saturate).alias("cache_write_1h"),
        F.count("*").alias("events"),
        F.count_if(F.coalesce("turn", F.lit(False))).alias("turns"),
        saturating_sum(F.coalesce("calls", F.lit(1).cast("bigint"))).alias("calls"),
        F.sum(finite).alias("cost_usd"),
    ]


def rollup(events: DataFrame, by: str = "model", tz: str | None = None, block_ms: int = DEFAULT_BLOCK_MS, saturate: bool = False) -> DataFrame:
    """One row per key; days and blocks are of ``tz``, by default the system's zone.  ``block`` keys are the ISO starts of greedy fixed windows;
    events without an instant share ``invalid-date``.  Rows come in key order
    from :func:`ordered`."""
    if by not in DIMENSIONS:
        raise ValueError(f"unknown dimension {by!r}; one of {', '.join(DIMENSIONS)}")
    if by == "block":
        keyed = with_block(events, zone(tz), block_ms).withColumn("key", F.coalesce(iso(F.col("block_start")), F.lit("invalid-date")))
    else:
        keyed = events.withColumn("key", key_column(by, tz))
    return keyed.groupBy("key").agg(*aggregates(saturate))


def canonical(events: DataFrame) -> DataFrame:
    """Events in the order in which results are compared."""
    return events.orderBy("timestamp", "session_id", "message_id", "model")


def ordered(rows: DataFrame) -> DataFrame:
    """Bytewise by key, the invalid date last."""
    return rows.orderBy(F.col("key") == "invalid-date", "key")
