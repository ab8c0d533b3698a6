"""Pricing: model lookup across catalogs, priced rollups and priced event groups.

Only distinct models are looked up.  The catalog relation is small and bounded
by its payloads; what is found is counted before it is broadcast.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.cost import cost_usd, is_zero_cost
from ..functions.models import candidate_keys
from ..operators.blocks import DEFAULT_BLOCK_MS, with_block
from ..functions.instants import iso, zone
from ..operators.rollup import aggregates, key_column

MODES = ("calculate", "display", "auto")
#: Distinct models up to which their prices are broadcast
BROADCAST_MODELS = 50_000


def _priced_models(models: DataFrame, catalog: DataFrame) -> DataFrame:
    """The lookup of the distinct models, broadcast if their number allows."""
    found = lookup(models, catalog).persist()  # read by the count and by the joins
    return F.broadcast(found) if found.count() <= BROADCAST_MODELS else found


def lookup(models: DataFrame, catalog: DataFrame) -> DataFrame:
    """(model) to priced, source, key, price, tiered, attempted, zero_cost_key.

    In a catalog the first candidate key present decides; if its price is all
    zero, and the catalog is no override, the whole catalog misses.  Over the
    catalogs the first override hit or tiered hit wins, else the first flat hit.
    """
    distinct = models.select("model").distinct().withColumn("keys", candidate_keys(F.col("model")))
    # of an inner explode Spark would infer a filter on the keys and compute them for every row before the distinct
    tries = distinct.select("model", F.posexplode_outer("keys").alias("rank", "key")).where("key is not null")
    found = tries.join(catalog, "key")
    best = found.groupBy("model", "catalog_ord").agg(F.min_by(F.struct("key", "price", "source", "fetched_at", "is_override"), F.struct("rank", "key_ord")).alias("hit"))
    tiered = F.coalesce(F.size("hit.price.tiers") > 0, F.lit(False))
    best = best.withColumn("zero", is_zero_cost(F.col("hit.price")) & ~F.col("hit.is_override")).withColumn("tiered", tiered)
    rank = F.when(F.col("zero"), 2).when(F.col("hit.is_override") | F.col("tiered"), 0).otherwise(1)
    pick = best.groupBy("model").agg(F.min_by(F.struct("hit", "tiered", "zero"), F.struct(rank, "catalog_ord")).alias("p"))
    out = distinct.join(pick, "model", "left")
    hit = F.col("p").isNotNull() & ~F.coalesce("p.zero", F.lit(False))
    keep = lambda c: F.when(hit, F.col(c))
    return out.select(
        "model", F.coalesce(hit, F.lit(False)).alias("priced"), keep("p.hit.source").alias("source"), keep("p.hit.fetched_at").alias("fetched_at"), keep("p.hit.key").alias("matched_key"), keep("p.hit.price").alias("price"),
        F.coalesce(keep("p.tiered"), F.lit(False)).alias("tiered"), F.when(~F.coalesce(hit, F.lit(False)), F.col("keys")).alias("attempted"), F.when(F.col("p.zero"), F.col("p.hit.key")).alias("zero_cost_key"),
    )


def _tokens() -> Column:
    return F.struct(*[F.col(c) for c in ("input", "output", "cache_read", "cache_write", "cache_write_1h", "reasoning")])


def price_rollups(rollups: DataFrame, catalog: DataFrame, mode: str = "calculate") -> DataFrame:
    """Rollup rows, keyed by model, with usd and how they were priced."""
    if mode not in MODES:
        raise ValueError(f"unknown mode {mode!r}")
    found = lookup(rollups.select(F.col("key").alias("model")), catalog).withColumnRenamed("model", "key")
    rows = rollups.join(found, "key", "left")
    calculated = cost_usd(_tokens(), F.col("price"))
    recorded = F.col("cost_usd")
    usd = {
        "calculate": F.when(F.col("priced"), calculated),
        "display": F.coalesce(recorded, F.lit(0.0)),
        "auto": F.when(F.col("priced"), F.coalesce(recorded, calculated)).otherwise(recorded),
    }[mode]
    many = F.col("tiered") & ((F.col("events") > 1) | (F.col("calls") > 1))
    shown = {"calculate": F.lit(True), "display": F.lit(False), "auto": recorded.isNull()}[mode]
    return rows.withColumn("usd", usd).withColumn("tiered_aggregate", F.col("priced") & many & shown)


def price_events(events: DataFrame, catalog: DataFrame, by: str = "day", tz: str | None = None, mode: str = "calculate", block_ms: int = DEFAULT_BLOCK_MS) -> DataFrame:
    """Groups of events with the exact sum of their costs (as decimals, so it
    does not depend on order) and the group's pricing kind.

    Blocks are priced by their own keys.  ``seq``, where events have it, is their
    order: of a group's models the first priced one gives ``hit``, and what the
    others tried is listed as they came.  Else message_id stands for it.
    """
    if mode not in MODES:
        raise ValueError(f"unknown mode {mode!r}")
    if by == "block":
        keyed = with_block(events, zone(tz), block_ms).withColumn("key", F.coalesce(iso(F.col("block_start")), F.lit("invalid-date")))
    else:
        keyed = events.withColumn("key", key_column(by, tz))
    found = _priced_models(events.select("model"), catalog)
    seq = F.col("seq") if "seq" in events.columns else F.col("message_id")
    rows = keyed.withColumn("_seq", seq).join(found.select("model", "priced", "price"), "model", "left")
    recorded = F.when(F.abs("cost_usd") < float("inf"), F.col("cost_usd"))
    calculated = cost_usd(F.col("tokens"), F.col("price"))
    usd = {
        "calculate": F.coalesce(calculated, F.lit(0.0)),
        "display": F.coalesce(recorded, F.lit(0.0)),
        "auto": F.coalesce(recorded, calculated, F.lit(0.0)),
    }[mode]
    # by model first: the models of a group are few, and what is known of each joins those alone
    one = rows.withColumn("_usd", usd.cast("decimal(28,12)")).groupBy("key", "model").agg(*aggregates(), F.sum("_usd").alias("_usd"), F.min("_seq").alias("_seq"), F.bool_or(F.coalesce(F.col("calls") > 1, F.lit(False))).alias("multi_call"))
    one = one.join(found, "model", "left").withColumn("hit", F.when(F.col("priced"), F.struct("source", "matched_key", "fetched_at", "price", "tiered")))
    sums = [F.sum(c).alias(c) for c in ("input", "output", "cache_read", "cache_write", "reasoning", "cache_write_1h", "events", "turns", "calls", "cost_usd")]
    missed = F.array_sort(F.collect_list(F.when(~F.col("priced"), F.struct("_seq", "attempted"))))
    grouped = one.groupBy("key").agg(
        *sums, F.sum("_usd").cast("double").alias("usd"), F.bool_and("priced").alias("priced"), F.array_sort(F.collect_list("model")).alias("models"), F.min_by("hit", F.when(F.col("priced"), F.col("_seq"))).alias("hit"),
        F.array_distinct(F.flatten(missed["attempted"])).alias("attempted"), F.min_by("zero_cost_key", F.when(~F.col("priced"), F.col("_seq"))).alias("zero_cost_key"), F.bool_or("multi_call").alias("multi_call"),
    )
    single = F.size("models") == 1
    kind = F.when(F.col("priced") & single, "single-hit").when(F.col("priced"), "multi-hit").when(single, "single-miss").otherwise("multi-miss")
    shown = F.col("usd") if mode != "calculate" else F.when(F.col("priced"), F.col("usd"))
    exposed = F.col("priced") & single & F.col("multi_call") & F.coalesce(F.col("hit.tiered"), F.lit(False)) & F.lit(mode != "display")
    return grouped.withColumn("kind", kind).withColumn("usd", shown).withColumn("tiered_aggregate", exposed)
