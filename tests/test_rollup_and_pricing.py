"""Rollups, blocks against a plain loop, lookups, catalogs and their cache."""

import json
import random

import pytest
from pyspark.sql import functions as F

from quillmeter.functions.instants import iso
from quillmeter.operators.blocks import with_block
from quillmeter.operators.rollup import ordered, rollup
from quillmeter.plans import pricing
from quillmeter.schema import USAGE_EVENT
from quillmeter.sources import catalogs as C
from quillmeter.sources import kit
from quillmeter.plans import wire
from quillmeter.plans.engine import create_pricing
from quillmeter.sources.lifecycle import Loader, Source, default_cache_dir


def events(spark, rows):
    made = []
    for k, r in enumerate(rows):
        t = {"input": 0, "output": 0, "cache_read": 0, "cache_write": 0, "cache_write_1h": None, "reasoning": 0} | r.get("tokens", {})
        made.append(("h", r.get("t"), kit.parse_ms(r["t"]) if r.get("t") else None, r.get("session", "s"), f"m{k}", r.get("turn", False), False, r.get("model", "m"), t, r.get("calls"), r.get("cost"), r.get("workspace"), None))
    return spark.createDataFrame(made, USAGE_EVENT)


def test_rollup(spark):
    e = events(spark, [{"t": "2026-08-01T00:00:00Z", "turn": True, "tokens": {"input": 5, "cache_write": 3, "cache_write_1h": 9}, "cost": 0.0}, {"t": "2026-08-01T01:00:00Z", "calls": 3, "tokens": {"input": 2}, "cost": float("inf")}, {"workspace": "/w"}])
    r = {x["key"]: x for x in rollup(e, "model").collect()}["m"]
    assert (r["input"], r["cache_write_1h"], r["events"], r["turns"], r["calls"], r["cost_usd"]) == (7, 3, 3, 1, 5, 0.0)
    assert [x["key"] for x in ordered(rollup(e, "day", "UTC")).collect()] == ["2026-08-01", "invalid-date"]
    assert {x["key"] for x in rollup(e, "workspace").collect()} == {"(unknown)", "/w"}
    with pytest.raises(ValueError, match="unknown dimension"):
        rollup(e, "colour")


def test_saturation(spark):
    big = 2**63 - 1
    e = events(spark, [{"t": "2026-08-01T00:00:00Z", "tokens": {"input": big}}] * 3)
    assert int(rollup(e, saturate=True).first()["input"]) == 2**64 - 1
    assert rollup(e).first()["input"] == big  # as BIGINTs, where they end
    few = events(spark, [{"t": "2026-08-01T00:00:00Z", "tokens": {"input": n, "output": -n}} for n in (big // 2, big // 2, 1)])
    assert (rollup(few).first()["input"], rollup(few).first()["output"]) == (big // 2 * 2 + 1, -(big // 2 * 2 + 1))


def plain_blocks(times, width):
    out, end, start = {}, None, None
    for ms in sorted(set(times)):
        if end is None or ms >= end:
            start = ms - (ms % 3_600_000) % min(width, 3_600_000)
            end = start + width
        out[ms] = start
    return out


@pytest.mark.parametrize("width", [18_000_000, 2_400_000, 3_600_000, 5_000_000, 60_000])
def test_blocks_equal_a_loop(spark, width):
    rng = random.Random(width)
    times = [1_785_542_400_000 + rng.randrange(0, 40 * 3_600_000) for _ in range(400)]
    df = spark.createDataFrame([(t,) for t in times], "ts_ms bigint")
    got = {r["ts_ms"]: r["block_start"] for r in with_block(df, "UTC", width).collect()}
    assert got == plain_blocks(times, width)


def test_block_vectors(spark):
    def keys(tz, width, *clock):
        df = spark.createDataFrame([(kit.parse_ms(c),) for c in clock], "ts_ms bigint")
        rows = with_block(df, tz, width).groupBy(iso(F.col("block_start")).alias("k")).count().orderBy("k").collect()
        return [(r["k"][11:16], r["count"]) for r in rows]

    d = "2026-08-01T"
    assert keys("UTC", 18_000_000, f"{d}09:17Z", f"{d}11:00Z") == [("09:00", 2)]
    assert keys("UTC", 18_000_000, f"{d}14:00Z", f"{d}09:00Z") == [("09:00", 1), ("14:00", 1)]
    assert keys("UTC", 1_800_000, f"{d}22:10Z", f"{d}22:40Z") == [("22:00", 1), ("22:30", 1)]
    assert keys("UTC", 2_400_000, f"{d}22:50Z", f"{d}23:10Z", f"{d}23:25Z") == [("22:40", 2), ("23:00", 1)]
    assert keys("Asia/Kolkata", 18_000_000, f"{d}09:17Z") == [("08:30", 1)]
    assert keys("America/New_York", 3_600_000, "2026-11-01T05:30Z", "2026-11-01T06:30Z") == [("05:00", 1), ("06:00", 1)]


def test_no_instants(spark):
    e = events(spark, [{}, {}])
    assert [(r["key"], r["events"]) for r in rollup(e, "block").collect()] == [("invalid-date", 2)]


LITELLM = {"gpt-5": {"input_cost_per_token": 1.25e-6, "output_cost_per_token": 1e-5}, "zero": {"input_cost_per_token": 0, "output_cost_per_token": 0}, "claude-x-4-5": {"input_cost_per_token": 3e-6, "output_cost_per_token": 1.5e-5, "input_cost_per_token_above_200k_tokens": 6e-6}, "sample_spec": {}}
ROUTER = {"data": [{"id": "gpt-5", "pricing": {"prompt": "0.9", "completion": "0.9"}}, {"id": "zero", "pricing": {"prompt": "0.000001", "completion": "0.000001"}}]}


def test_lookup_order(spark):
    cat = C.relation(spark, [C.parse("litellm", LITELLM), C.parse("openrouter", ROUTER)])
    models = spark.createDataFrame([("gpt-5",), ("zero",), ("claude-x-4.5",), ("nothing",)], "model string")
    rows = {r["model"]: r for r in pricing.lookup(models, cat).collect()}
    assert rows["gpt-5"]["source"] == "litellm"
    assert rows["zero"]["source"] == "openrouter"
    assert rows["claude-x-4.5"]["matched_key"] == "claude-x-4-5" and rows["claude-x-4.5"]["tiered"]
    assert rows["nothing"]["priced"] is False and rows["nothing"]["attempted"] == ["nothing"]
    only = C.relation(spark, [C.parse("litellm", LITELLM)])
    assert pricing.lookup(models, only).where("model = 'zero'").first()["zero_cost_key"] == "zero"
    own = C.relation(spark, [C.overrides([{"model": "zero", "input": 0, "output": 0}]), C.parse("openrouter", ROUTER)])
    assert pricing.lookup(models, own).where("model = 'zero'").first()["source"] == "override"


def test_modes(spark):
    cat = C.relation(spark, [C.parse("litellm", LITELLM)])
    e = events(spark, [{"t": "2026-08-01T00:00:00Z", "model": "gpt-5", "tokens": {"input": 1_000_000}, "cost": 9.0}, {"t": "2026-08-01T00:00:00Z", "model": "gpt-5", "tokens": {"input": 1_000_000}}, {"t": "2026-08-01T00:00:00Z", "model": "nothing"}])
    usd = {m: pricing.price_events(e, cat, "model", mode=m).where("key = 'gpt-5'").first()["usd"] for m in pricing.MODES}
    assert usd == {"calculate": 2.5, "display": 9.0, "auto": 10.25}
    miss = {m: pricing.price_events(e, cat, "model", mode=m).where("key = 'nothing'").first() for m in pricing.MODES}
    assert (miss["calculate"]["usd"], miss["auto"]["usd"], miss["auto"]["kind"]) == (None, 0.0, "single-miss")
    day = pricing.price_events(e, cat, "day", "UTC").first()
    assert day["kind"] == "multi-miss" and day["attempted"] == ["nothing"]
    with pytest.raises(ValueError):
        pricing.price_events(e, cat, mode="guess")


def test_groups_list_tries_as_they_came(spark):
    cat = C.relation(spark, [C.parse("litellm", LITELLM)])
    e = events(spark, [{"t": "2026-08-01T00:00:00Z", "model": m} for m in ("zz/b", "claude-x-4-5", "aa", "gpt-5", "zz/b")]).withColumn("seq", F.substring("message_id", 2, 9).cast("int"))
    day = pricing.price_events(e, cat, "day", "UTC").first()
    assert day["attempted"] == ["zz/b", "b", "aa"] and day["hit"]["matched_key"] == "claude-x-4-5" and day["kind"] == "multi-miss"
    back = pricing.price_events(e.withColumn("seq", -F.col("seq")), cat, "day", "UTC").first()
    assert back["attempted"] == ["zz/b", "b", "aa"] and back["hit"]["matched_key"] == "gpt-5"


def test_keys_are_not_computed_for_every_event(spark):
    """No expression of the candidate keys stands below the distinct models."""
    cat = C.relation(spark, [C.parse("litellm", LITELLM)])
    e = events(spark, [{"t": "2026-08-01T00:00:00Z", "model": "gpt-5"}])
    plan = pricing.lookup(e, cat)._jdf.queryExecution().optimizedPlan().toString()
    below = [line for line in plan.splitlines() if "LogicalRDD" in line or "LocalRelation" in line or "Filter" in line]
    assert below and not any("transform" in line or "anthropic" in line for line in below)


def test_create_pricing(spark, tmp_path):
    asked = []

    def fetch(url):
        asked.append(url)
        if "litellm" in url:
            return LITELLM
        if "openrouter" in url:
            return ROUTER
        raise OSError

    now = [1_785_542_400_000]
    p = create_pricing(spark, overrides=[{"model": "own", "input": 1, "output": 2}], cache_dir=tmp_path, fetch=fetch, clock=lambda: now[0], mode="auto")
    assert [(r["source"], r["models"]) for r in p.catalogs().collect()] == [("override", 1), ("openrouter", 2), ("litellm", 3)] and len(asked) == 3
    assert sorted(f.name for f in tmp_path.iterdir()) == ["pricing-litellm.json", "pricing-openrouter.json"]
    assert p.price_tokens("own", {"input": 1_000_000, "output": 500_000})["usd"] == 2.0
    assert p.price_tokens("nothing", {"input": 5})["usd"] is None and p.price_tokens("nothing", {})["attempted"] == ["nothing"]
    assert p.lookup_models(spark.createDataFrame([("gpt-5",)], "model string")).first()["source"] == "openrouter"
    e = events(spark, [{"t": "2026-08-01T00:00:00Z", "model": "own", "tokens": {"input": 1_000_000}}, {"t": "2026-08-01T00:00:00Z", "model": "gpt-5", "cost": 4.0}])
    assert p.price_events(e, "day", "UTC").first()["usd"] == 5.0
    assert {r["key"]: r["usd"] for r in p.price_rollups(rollup(e)).collect()} == {"own": 1.0, "gpt-5": 4.0}
    assert len(asked) == 3  # kept while fresh
    now[0] += 3_600_000
    p.catalogs()
    assert len(asked) == 4  # the disk caches are just fresh; the one without is asked again
    with pytest.raises(ValueError):
        create_pricing(spark, mode="guess")


def test_refresh_holds_once(tmp_path):
    now, calls = [1_785_542_400_000], []

    def source(name, fail=()):
        def fetch():
            calls.append(name)
            if len(calls) in fail:
                raise KeyboardInterrupt  # not a failed fetch: the load itself ends
            return LITELLM

        return Source("litellm", fetch, name)

    loader = Loader([source("a"), source("b", fail=(2,))], tmp_path, clock=lambda: now[0], refresh=True)
    with pytest.raises(KeyboardInterrupt):
        loader.catalogs()
    assert len(loader.catalogs()) == 2 and calls == ["a", "b", "b"]  # the first was refreshed already
    now[0] += 3_600_000
    assert len(loader.catalogs()) == 2 and calls == ["a", "b", "b"]


def test_cache_folders():
    folder = lambda env, platform: str(default_cache_dir(env, "/h", platform))
    assert folder({}, "linux") == "/h/.cache/quillmeter" and folder({"XDG_CACHE_HOME": ""}, "darwin") == "/h/Library/Caches/quillmeter"
    assert folder({"XDG_CACHE_HOME": "/x"}, "darwin") == "/x/quillmeter" and folder({"LOCALAPPDATA": "/l"}, "win32") == "/l/quillmeter/cache" and folder({}, "win32") == "/h/AppData/Local/quillmeter/cache"


def test_documents(spark):
    cat = C.relation(spark, [C.parse("litellm", LITELLM, "2026-08-01T00:00:00.000Z"), C.overrides([{"model": "own", "input": 1, "output": 2}])])
    e = events(spark, [{"t": "2026-08-01T00:00:00Z", "model": "own", "tokens": {"input": 2_000_000, "cache_write": 3, "cache_write_1h": 1}, "session": "a"}, {"t": "2026-08-01T00:00:00Z", "model": "gpt-5", "cost": 4.0, "session": "a"}, {"t": "2026-08-01T00:00:00Z", "model": "zero", "session": "b"}])
    rows = {r["key"]: json.loads(r["rollup"]) for r in wire.rollup_json(rollup(e)).collect()}
    assert rows["own"] == {"key": "own", "tokens": {"input": 2_000_000, "output": 0, "cacheRead": 0, "cacheWrite": 3, "cacheWrite1h": 1, "reasoning": 0}, "events": 1, "turns": 0, "calls": 1}
    assert rows["gpt-5"]["costUsd"] == 4.0 and "cacheWrite1h" not in rows["gpt-5"]["tokens"]
    priced = {r["key"]: json.loads(r["rollup"])["pricing"] for r in wire.priced_rollup_json(pricing.price_rollups(rollup(e), cat)).collect()}
    assert priced["own"]["fetchedAt"] is None and priced["own"]["price"] == {"input": 1.0, "output": 2.0} and priced["own"]["usd"] == 2.000004
    assert priced["gpt-5"]["fetchedAt"].startswith("2026") and priced["zero"] == {"priced": False, "model": "zero", "key": "zero", "attempted": ["zero"], "reason": "zeroCost"}
    groups = {r["key"]: json.loads(r["group"])["pricing"] for r in wire.priced_group_json(pricing.price_events(e, cat, "session")).collect()}
    assert groups["a"] == {"priced": True, "usd": 2.000004, "models": ["gpt-5", "own"]} and groups["b"]["reason"] == "zeroCost"


def test_models_dev_and_tiers():
    dev = C.parse_models_dev({"openai": {"models": {"gpt-5": {"cost": {"input": 1.25, "output": 10}}}}, "other": {"models": {"gpt-5": {"cost": {"input": 2, "output": 2}}}}})
    assert list(dev) == ["openai/gpt-5", "gpt-5", "other/gpt-5"] and dev["gpt-5"]["input"] == 1.25
    t = C.parse_litellm(LITELLM)["claude-x-4-5"]
    assert t["tier_mode"] == "whole-request" and t["tiers"][0]["output"] == pytest.approx(15.0)
    assert C.parse_openrouter({"data": [{"id": "x", "pricing": {"prompt": "", "completion": "1"}}, 7, {"id": 3}]}) == {}


def test_cache_lifecycle(tmp_path):
    now, calls = [1_785_542_400_000], []

    def fetch():
        calls.append(1)
        return LITELLM

    def broken():
        raise OSError

    make = lambda f, **k: Loader([Source("litellm", f)], tmp_path, clock=lambda: now[0], **k)
    assert make(broken).catalogs() == []
    assert len(make(fetch).catalogs()) == 1 and len(calls) == 1
    now[0] += 3_600_000  # an age of exactly the ttl is fresh
    assert make(fetch).catalogs()[0].fetched_at == "2026-08-01T00:00:00.000Z" and len(calls) == 1
    now[0] += 1
    assert len(make(fetch).catalogs()) == 1 and len(calls) == 2
    now[0] += 10**9
    assert len(make(broken).catalogs()) == 1 and len(make(broken, offline=True).catalogs()) == 1
    assert len(make(lambda: {"x": {}}).catalogs()) == 1  # an unusable payload falls back too
