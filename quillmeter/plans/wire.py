"""Results as JSON: camelCase names, absent values left out, a row a document."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .read_usage import Usage

ABSENT = {"ignoreNullFields": "true"}


def _tokens(t) -> Column:
    """The counters of a struct or of columns, by their names on the wire."""
    names = {"input": "input", "output": "output", "cache_read": "cacheRead", "cache_write": "cacheWrite", "cache_write_1h": "cacheWrite1h", "reasoning": "reasoning"}
    return F.struct(*[t(c).alias(n) for c, n in names.items()]).alias("tokens")


def event_json(events: DataFrame) -> DataFrame:
    row = F.struct("harness", "timestamp", F.col("session_id").alias("sessionId"), F.col("message_id").alias("messageId"), "turn", "subagent", "model", _tokens(lambda c: F.col("tokens")[c]), "calls", F.col("cost_usd").alias("costUsd"), "workspace", "title")
    return events.select(F.to_json(row, ABSENT).alias("event"))


def envelope(usage: Usage) -> DataFrame:
    """(part, value): every event and diagnostic as a document of its own, and the
    skipped locations of each agent as a list under its name."""
    events = event_json(usage.events).select(F.lit("events").alias("part"), F.col("event").alias("value"))
    notes = usage.diagnostics.select(F.lit("diagnostics").alias("part"), F.to_json(F.struct("severity", "message", "harness"), ABSENT).alias("value"))
    one = usage.skipped.select(F.lit("skipped").alias("part"), F.to_json(F.create_map("harness", "location")).alias("value"))
    return events.unionByName(notes).unionByName(one)


def _rollup_fields() -> list[Column]:
    return [F.col("key"), _tokens(F.col), F.col("events"), F.col("turns"), F.col("calls"), F.col("cost_usd").alias("costUsd")]


def rollup_json(rollups: DataFrame) -> DataFrame:
    return rollups.select("key", F.to_json(F.struct(*_rollup_fields()), ABSENT).alias("rollup"))


def _price(p: Column) -> Column:
    def rates(r: Column, *first: Column) -> Column:
        return F.struct(*first, *[r[c].alias(n) for c, n in (("input", "input"), ("output", "output"), ("cache_read", "cacheRead"), ("cache_write", "cacheWrite"), ("cache_write_1h", "cacheWrite1h"))])

    tiers = F.transform(p["tiers"], lambda t: rates(t, t["threshold"].alias("threshold")))
    return F.when(p.isNotNull(), F.struct(*[rates(p)[n].alias(n) for n in ("input", "output", "cacheRead", "cacheWrite", "cacheWrite1h")], tiers.alias("tiers"), p["tier_mode"].alias("tierMode")))


def _with_pricing(rows: DataFrame, pricing: Column, fetched: Column, name: str) -> DataFrame:
    """The rollup's document with its pricing; a hit says when its catalog was fetched, null if never."""
    told = F.to_json(pricing, ABSENT)
    told = F.when(fetched, F.concat(told.substr(F.lit(1), F.length(told) - 1), F.lit(',"fetchedAt":null}'))).otherwise(told)
    base = F.to_json(F.struct(*_rollup_fields()), ABSENT)
    return rows.select("key", F.concat(base.substr(F.lit(1), F.length(base) - 1), F.lit(',"pricing":'), told, F.lit("}")).alias(name))


def _pricing(model: Column, hit: Column, miss: Column, usd: Column) -> Column:
    """What is known of a hit or a miss; ``hit`` and ``miss`` say whether details are."""
    only = lambda when, c: F.when(when, F.col(c))
    key = F.coalesce(only(hit, "matched_key"), only(miss, "zero_cost_key"))
    return F.struct(
        F.col("priced"), F.when(hit | miss, model).alias("model"), key.alias("key"), F.when(hit, _price(F.col("price"))).alias("price"), only(hit, "source").alias("source"), only(hit, "fetched_at").alias("fetchedAt"),
        only(miss, "attempted").alias("attempted"), F.when(miss & F.col("zero_cost_key").isNotNull(), F.lit("zeroCost")).alias("reason"), usd.alias("usd"), F.when(hit & F.col("tiered_aggregate"), F.lit(True)).alias("tieredAggregate"),
    )


def priced_rollup_json(priced: DataFrame) -> DataFrame:
    """Documents of price_rollups' rows."""
    hit = F.col("priced")
    return _with_pricing(priced, _pricing(F.col("key"), hit, ~hit, F.col("usd")), hit & F.col("fetched_at").isNull(), "rollup")


def priced_group_json(groups: DataFrame) -> DataFrame:
    """Documents of price_events' rows: a group of one model has its details, others the sum and the models or tried keys."""
    one, hit = F.size("models") == 1, F.col("priced")
    model = F.when(one, F.get("models", F.lit(0))).otherwise(F.col("key"))
    rows = groups.withColumns({c: F.col("hit")[c] for c in ("source", "matched_key", "fetched_at", "price")}).withColumn("zero_cost_key", F.when(one, F.col("zero_cost_key")))
    pricing = _pricing(model, hit & one, ~hit, F.col("usd"))
    with_models = F.struct(*[pricing[n].alias(n) for n in ("priced", "model", "key", "price", "source", "fetchedAt", "attempted", "reason", "usd")], F.when(hit & ~one, F.col("models")).alias("models"), pricing["tieredAggregate"].alias("tieredAggregate"))
    return _with_pricing(rows, with_models, hit & one & F.col("fetched_at").isNull(), "group")
