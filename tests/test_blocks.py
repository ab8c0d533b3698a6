"""Billing blocks against a walk over the events."""

import random
from datetime import datetime, timezone
from zoneinfo import ZoneInfo

import pytest
from pyspark.sql import functions as F

from quillmeter.operators.blocks import CHUNK_WIDTHS, with_block

HOUR = 3_600_000


def walk(instants, tz, width):
    zone, out, end = ZoneInfo(tz), {}, None
    start = None
    for ms in sorted(set(instants)):
        if end is None or ms >= end:
            local = datetime.fromtimestamp(ms // 1000, timezone.utc).astimezone(zone)
            start = ms - ((local.minute * 60 + local.second) * 1000 + ms % 1000) % min(width, HOUR)
            end = start + width
        out[ms] = start
    return out


def instants(seed, around, n, gap):
    r = random.Random(seed)
    out = [around]
    for _ in range(n):
        out.append(out[-1] + int(r.expovariate(1 / gap)) * (60 if r.random() < 0.02 else 1))
    return out


SHIFT = int(datetime(2026, 4, 4, 15, tzinfo=timezone.utc).timestamp() * 1000)  # Lord Howe's clocks go back by half an hour


@pytest.mark.parametrize(
    "tz, width, around, gap",
    [
        ("UTC", 5 * HOUR, SHIFT, HOUR // 3), ("UTC", 1, SHIFT, 2), ("UTC", 1000, 0, 700), ("Asia/Kolkata", 90 * 60_000, -50 * HOUR, HOUR // 5), ("Australia/Lord_Howe", 2 * HOUR, SHIFT - 40 * HOUR, HOUR // 4),
        ("Australia/Lord_Howe", 5 * HOUR, SHIFT - 40 * HOUR, HOUR // 6), ("America/Los_Angeles", 7 * HOUR + 1, SHIFT - 900 * HOUR, HOUR), ("Europe/Berlin", 3 * HOUR, SHIFT - 250 * HOUR, 30 * HOUR),
    ],
)
def test_same_blocks_as_the_walk(spark, tz, width, around, gap):
    at = instants(width, around, 700, gap)
    rows = [(k, ms) for k, ms in enumerate([*at, at[3], at[3], None])]
    events = spark.createDataFrame(rows, "k int, ts_ms long").repartition(5).withColumns({c: F.lit("own") for c in ("cell", "of", "row", "blocks", "first", "chunk", "cells", "end")})
    found = with_block(events, tz, width)
    assert found.columns == [*events.columns, "block_start"]
    want = walk([ms for _, ms in rows if ms is not None], tz, width)
    got = found.collect()
    assert len(got) == len(rows) and all(r["block_start"] == want.get(r["ts_ms"]) and r["cell"] == "own" for r in got)
    assert max(at) - min(at) > 2 * CHUNK_WIDTHS * width or width > 3 * HOUR  # several chunks


def test_plan_and_nothing(spark):
    none = spark.createDataFrame([], "ts_ms long, block_start string")
    found = with_block(none, "UTC")
    assert found.count() == 0 and found.columns == ["ts_ms", "block_start"]
    plan = with_block(spark.range(9).selectExpr("id as ts_ms"), "UTC")._jdf.queryExecution().toString()
    assert "SinglePartition" not in plan and "Python" not in plan and "InPandas" not in plan
