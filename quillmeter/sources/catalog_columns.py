"""Price catalogs parsed in columns: payloads are rows of JSON text, prices come out as rows.

``relation`` takes any number of payloads of the three public formats and gives the
catalog relation, a row per (catalog, key), equal to what the dict parsers of
:mod:`catalogs` give.  Payloads are exploded where they lie; none goes through the
driver.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.cells import at, is_object, number_of, string_of
from ..schema import PRICE, TIER
from .catalogs import MILLION, TIER_THOUSANDS

PAYLOADS = "catalog_ord int, kind string, source string, fetched_at string, payload string"
_RATES = ("input", "output", "cache_read", "cache_write")
#: Names of the rates in LiteLLM's and OpenRouter's payloads
LITELLM = {"input": "input_cost_per_token", "output": "output_cost_per_token", "cache_read": "cache_read_input_token_cost", "cache_write": "cache_creation_input_token_cost"}
LITELLM_HOUR = "cache_creation_input_token_cost_above_1hr"
ROUTER = {"input": "prompt", "output": "completion", "cache_read": "input_cache_read", "cache_write": "input_cache_write"}
#: Fixed value: what a numeric string looks like
DECIMAL = r"^[+-]?(\d+\.?\d*|\.\d+)([eE][+-]?\d+)?$"


def _loose(value: Column) -> Column:
    """A finite JSON number or numeric string."""
    s = F.trim(string_of(value))
    n = F.coalesce(number_of(value), F.when(s.rlike(DECIMAL), s.try_cast("double")))
    return F.when(F.abs(n) < float("inf"), n)


def _scaled(value: Column) -> Column:
    return _loose(value) * MILLION


def _hour(value: Column) -> Column:
    rate = _scaled(value)
    return F.when((rate >= 0) & (rate < float("inf")), rate)


def _members(df: DataFrame, value: str, key: str, inner: str) -> DataFrame:
    """The members of an object, or elements of an array, beside the row; ``pos`` is their place."""
    spark = df.sparkSession
    exploded = spark.tvf.variant_explode(F.col(value).outer()).select(F.col("pos").alias(f"{inner}_pos"), F.col("key").alias(key), F.col("value").alias(inner))
    return df.lateralJoin(exploded)


def _price(rates: dict[str, Column], hour: Column, tiers: Column, mode: Column) -> Column:
    return F.struct(*[rates[r].alias(r) for r in _RATES], hour.alias("cache_write_1h"), tiers.alias("tiers"), mode.alias("tier_mode")).cast(PRICE)


def _no(kind: str) -> Column:
    return F.lit(None).cast(kind)


def _litellm_tiers(entry: Column, base: dict[str, Column]) -> Column:
    """Tiers that name a rate, by threshold; what one does not name it has from the tier before, the first from the base."""
    own = []
    for thousand in TIER_THOUSANDS:
        mark = f"_above_{thousand}k_tokens"
        rates = [_scaled(at(entry, f"$.{name}{mark}")).alias(r) for r, name in LITELLM.items()]
        own.append(F.struct(F.lit(thousand * 1000.0).alias("threshold"), *rates, _hour(at(entry, f"$.{LITELLM_HOUR}{mark}")).alias("cache_write_1h")))
    named = F.filter(F.array(*own), lambda t: F.coalesce(*[t[r] for r in _RATES], t["cache_write_1h"]).isNotNull())
    # a base has input and output alone for its tiers to inherit
    start = {"input": base["input"], "output": base["output"], "cache_read": _no("double"), "cache_write": _no("double")}

    def step(done: Column, t: Column) -> Column:
        below = F.get(done, F.size(done) - 1)
        rates = [F.coalesce(t[r], F.when(F.size(done) > 0, below[r]).otherwise(start[r])).alias(r) for r in _RATES]
        return F.concat(done, F.array(F.struct(t["threshold"].alias("threshold"), *rates, t["cache_write_1h"].alias("cache_write_1h"))).cast(f"array<{TIER}>"))

    tiers = F.aggregate(named, F.array().cast(f"array<{TIER}>"), step)
    return F.when(F.size(tiers) > 0, tiers)


def litellm(payloads: DataFrame) -> DataFrame:
    """USD per token by model; tiers by context; Claude bills the whole request at its tier."""
    e = F.col("entry")
    # a variant for each member: taken out of the document's, each would carry the names of all
    each = F.explode(F.from_json("payload", "map<string,variant>")).alias("key", "entry")
    members = payloads.where(is_object(F.col("parsed"))).select("catalog_ord", each).where((F.col("key") != "sample_spec") & is_object(e))
    base = {r: _scaled(at(e, f"$.{name}")) for r, name in LITELLM.items()}
    flat = members.withColumns({f"_{r}": c for r, c in base.items()}).where("_input is not null and _output is not null")
    held = {r: F.col(f"_{r}") for r in _RATES}
    flat = flat.withColumn("_tiers", _litellm_tiers(e, held))
    mode = F.when(F.col("_tiers").isNotNull() & F.contains(F.col("key"), F.lit("claude")), "whole-request")
    order = F.row_number().over(Window.partitionBy("catalog_ord").orderBy("key")) - 1
    return flat.select("catalog_ord", order.alias("key_ord"), "key", _price(held, _hour(at(e, f"$.{LITELLM_HOUR}")), F.col("_tiers"), mode).alias("price"))


def openrouter(payloads: DataFrame) -> DataFrame:
    """Decimal strings, USD per token; of a repeated id the last price, at the place of the first."""
    data = payloads.withColumn("data", at(F.col("parsed"), "$.data")).where(F.schema_of_variant("data").startswith("ARRAY"))
    rows = _members(data, "data", "_", "entry").withColumn("key", string_of(at(F.col("entry"), "$.id")))
    rates = {r: _scaled(at(F.col("entry"), f"$.pricing.{name}")) for r, name in ROUTER.items()}
    flat = rows.where(F.col("key").isNotNull()).select("catalog_ord", "entry_pos", "key", *[c.alias(r) for r, c in rates.items()]).where("input is not null and output is not null")
    price = _price({r: F.col(r) for r in _RATES}, _no("double"), _no(f"array<{TIER}>"), _no("string"))
    one = flat.groupBy("catalog_ord", "key").agg(F.min("entry_pos").alias("place"), F.max_by(price, "entry_pos").alias("price"))
    return one.select("catalog_ord", F.col("place").cast("int").alias("key_ord"), "key", "price")


def models_dev(payloads: DataFrame) -> DataFrame:
    """USD per million; provider/model always, the bare id where it is not taken."""
    about = _members(payloads, "parsed", "provider", "about").withColumn("models", at(F.col("about"), "$.models")).where(is_object(F.col("models")))
    each = _members(about, "models", "model", "entry").where(F.col("model").isNotNull())
    rates = {r: _loose(at(F.col("entry"), f"$.cost.{r}")) for r in _RATES}
    flat = each.select("catalog_ord", "provider", "model", *[c.alias(r) for r, c in rates.items()]).where("input is not null and output is not null")
    price = _price({r: F.col(r) for r in _RATES}, _no("double"), _no(f"array<{TIER}>"), _no("string"))
    n = F.row_number().over(Window.partitionBy("catalog_ord").orderBy("provider", "model"))
    both = F.explode(F.array(F.struct(F.concat("provider", F.lit("/"), "model").alias("key"), F.lit(0).alias("bare")), F.struct(F.col("model").alias("key"), F.lit(1).alias("bare"))))
    keys = flat.select("catalog_ord", n.alias("n"), price.alias("price"), both.alias("x")).select("catalog_ord", "x.key", (2 * F.col("n") + F.col("x.bare")).alias("place"), F.col("x.bare").alias("bare"), "price")
    one = keys.groupBy("catalog_ord", "key").agg(F.min("place").alias("place"), F.min_by("price", F.struct("bare", "place")).alias("price"))
    return one.select("catalog_ord", F.col("place").cast("int").alias("key_ord"), "key", "price")


PARSERS = {"openrouter": openrouter, "litellm": litellm, "models.dev": models_dev}


def relation(payloads: DataFrame) -> DataFrame:
    """The catalog relation of PAYLOADS rows; payloads that are no JSON, or of an unknown kind, have no prices.

    ``key_ord`` orders the keys of a catalog and need not be dense.
    """
    about = payloads.select("catalog_ord", "source", "fetched_at")
    parsed = payloads.select("catalog_ord", "kind", "payload", F.try_parse_json("payload").alias("parsed"))
    found = None
    for kind, parse in PARSERS.items():
        rows = parse(parsed.where(F.col("kind") == kind).drop("kind"))
        found = rows if found is None else found.unionByName(rows)
    return found.join(about, "catalog_ord").select("catalog_ord", "source", "fetched_at", F.lit(False).alias("is_override"), "key_ord", "key", "price")
