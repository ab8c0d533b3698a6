"""Streams over folders of events."""

import json

from quillmeter.streaming import ingest


def event(k, ms):
    return {"harness": "h", "timestamp": "x", "ts_ms": ms, "session_id": "s", "message_id": f"m{k}", "turn": True, "subagent": False, "model": "m", "tokens": {"input": 2, "output": 1, "cache_read": 0, "cache_write": 0, "reasoning": 0}}


def test_stream(spark, tmp_path):
    (tmp_path / "in").mkdir()
    day = 1_785_542_400_000
    (tmp_path / "in/a.json").write_text("\n".join(json.dumps(event(k % 3, day + k)) for k in range(6)))
    e = ingest.deduplicated(ingest.event_stream(spark, str(tmp_path / "in")))
    out = ingest.rollup_stream(e)
    q = out.writeStream.outputMode("complete").format("memory").queryName("rolled").trigger(availableNow=True).option("checkpointLocation", str(tmp_path / "ck")).start()
    q.awaitTermination(120)
    rows = spark.table("rolled").collect()
    assert [(r["key"], r["events"], r["input"]) for r in rows] == [("m", 3, 6)]
