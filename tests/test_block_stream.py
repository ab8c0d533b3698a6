"""A stream of billing blocks against the batch over the same events."""

import json
import random
from collections import Counter

from pyspark.sql import functions as F

from quillmeter.operators.blocks import with_block
from quillmeter.schema import USAGE_EVENT
from quillmeter.streaming.blocks import PROVIDER, block_stream
from quillmeter.streaming.ingest import event_stream

HOUR = 3_600_000
BEGIN = 1_785_500_000_000


def event(session, ms, n):
    return {"session_id": session, "message_id": f"{session}-{ms}-{n}", "ts_ms": ms, "model": "m", "tokens": {"input": n, "output": 2 * n, "cache_read": 0, "cache_write": 1}}


def test_stream_equals_batch(spark, tmp_path):
    r = random.Random(4)
    rows = []
    for s in ("a", "b", None):
        at = BEGIN
        for n in range(120):
            at += int(r.expovariate(1 / (HOUR / 3))) + (9 * HOUR if r.random() < 0.05 else 0)
            rows.append(event(s, at - at % 1000 * r.randrange(2), n))
    rows.sort(key=lambda e: e["ts_ms"] + r.randrange(-25, 25) * 60_000)  # late by less than an hour
    last = max(e["ts_ms"] for e in rows)
    files = [rows[k : k + 60] for k in range(0, len(rows), 60)] + [[event(s, last + 40 * HOUR, 1) for s in ("a", "b", None)], [event("a", last + 80 * HOUR, 1)], [event("a", last + 81 * HOUR, 1)]]
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", PROVIDER)
    folder = tmp_path / "in"
    folder.mkdir()
    query = block_stream(event_stream(spark, str(folder), 1), tz="UTC").writeStream.format("memory").queryName("closed_blocks").outputMode("append").option("checkpointLocation", str(tmp_path / "state")).start()
    try:
        for k, part in enumerate(files):
            (tmp_path / "x").write_text("\n".join(json.dumps(e) for e in part))
            (tmp_path / "x").rename(folder / f"{k}.json")
            query.processAllAvailable()
        got = Counter((x["key"], x["block_start"], x["events"], x["input"], x["output"], x["cache_write"]) for x in spark.table("closed_blocks").collect())
    finally:
        query.stop()
        spark.conf.unset("spark.sql.streaming.stateStore.providerClass")
    want = Counter()
    for s in ("a", "b", None):
        own = spark.createDataFrame([e | {"turn": None} for e in rows if e["session_id"] == s], USAGE_EVENT)
        sums = with_block(own, "UTC").groupBy("block_start").agg(F.count("*").alias("events"), *[F.sum(F.col("tokens")[c]).alias(c) for c in ("input", "output", "cache_write")])
        want.update((s or "(unknown)", x["block_start"], x["events"], x["input"], x["output"], x["cache_write"]) for x in sums.collect())
    assert len(want) > 30
    assert {k: v for k, v in got.items() if k[1] < last + 20 * HOUR} == dict(want)
