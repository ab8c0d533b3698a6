"""Token cost in USD under a price, as one Column expression."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def one_hour_writes(tokens: Column) -> Column:
    """The one-hour part of cache writes, clamped into [0, cache_write]; null where not reported."""
    w = tokens["cache_write_1h"]
    return F.when(w.isNotNull(), F.greatest(F.lit(0).cast("bigint"), F.least(w, F.greatest(tokens["cache_write"], F.lit(0)))))


def _level(price: Column, read: Column, write: Column) -> list[Column]:
    i = price["input"]
    return [i.alias("input"), price["output"].alias("output"), read.alias("read"), write.alias("write"), F.coalesce(read, i).alias("r"), F.coalesce(write, i).alias("w"), F.coalesce(price["cache_write_1h"], i * 2).alias("w1")]


def levels(price: Column) -> Column:
    """The base rates, then each tier's by threshold; cache rates pass down to tiers without their own."""
    zero = F.struct(F.lit(0.0).alias("threshold"), *_level(price, price["cache_read"], price["cache_write"]))
    tiers = F.array_sort(F.coalesce(price["tiers"], F.array().cast("array<struct<threshold:double,input:double,output:double,cache_read:double,cache_write:double,cache_write_1h:double>>")), lambda a, b: F.when(a["threshold"] < b["threshold"], -1).when(a["threshold"] > b["threshold"], 1).otherwise(0))

    def step(done: Column, t: Column) -> Column:
        last = F.element_at(done, -1)
        own = F.struct(t["threshold"].alias("threshold"), *_level(t, F.coalesce(t["cache_read"], last["read"]), F.coalesce(t["cache_write"], last["write"])))
        return F.concat(done, F.array(own))

    return F.aggregate(tiers, F.array(zero), step)


def cost_usd(tokens: Column, price: Column) -> Column:
    """Flat, whole-request or marginal cost; null without a price."""
    # the levels are bound to a lambda variable, so that the plan holds them once
    return F.when(price.isNotNull(), F.get(F.transform(F.array(levels(price)), lambda found: _billed(tokens, price, found)), F.lit(0)))


def _billed(tokens: Column, price: Column, all_levels: Column) -> Column:
    d = lambda name: F.coalesce(tokens[name], F.lit(0)).cast("double")
    out = d("output") + d("reasoning")
    w1 = F.coalesce(one_hour_writes(tokens), F.lit(0)).cast("double")
    w5 = d("cache_write") - w1
    context = d("input") + d("cache_read") + d("cache_write")

    def writes(r: Column) -> Column:
        return w5 * r["w"] + w1 * r["w1"]

    def bill(r: Column) -> Column:
        return (d("input") * r["input"] + out * r["output"] + d("cache_read") * r["r"] + writes(r)) / 1_000_000.0

    def blend(r: Column) -> Column:
        return F.when(context == 0.0, 0.0).otherwise((d("input") * r["input"] + d("cache_read") * r["r"] + writes(r)) / F.when(context == 0.0, 1.0).otherwise(context))

    base, steps = F.element_at(all_levels, 1), F.slice(all_levels, 2, 1 << 20)
    # the first tier that the context does not exceed stops the climb
    active = F.element_at(F.filter(all_levels, lambda r, k: (k == 0) | (context > r["threshold"])), -1)
    start = F.struct(F.lit(0.0).alias("usd"), F.lit(0.0).alias("at"), blend(base).alias("rate"))

    def climb(s: Column, r: Column) -> Column:
        over = F.struct((s["usd"] + (r["threshold"] - s["at"]) * s["rate"]).alias("usd"), r["threshold"].alias("at"), blend(r).alias("rate"))
        return F.when(context > r["threshold"], over).otherwise(s)

    marginal = F.aggregate(steps, start, climb, lambda s: s["usd"] + (context - s["at"]) * s["rate"])
    whole = price["tier_mode"] == "whole-request"
    return F.when(F.size(all_levels) == 1, bill(base)).when(whole, bill(active)).otherwise((marginal + out * base["output"]) / 1_000_000.0)


def is_zero_cost(price: Column) -> Column:
    """Every rate, flat and of each tier, is zero: a placeholder."""
    rates = ("input", "output", "cache_read", "cache_write", "cache_write_1h")

    def zero(p: Column) -> Column:
        r = F.lit(True)
        for name in rates:
            r = r & (F.coalesce(p[name], F.lit(0.0)) == 0.0)
        return r

    return zero(price) & F.coalesce(F.forall(price["tiers"], zero), F.lit(True))
