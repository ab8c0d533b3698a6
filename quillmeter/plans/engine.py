"""One object for pricing: catalogs that are loaded and kept, and what is priced with them."""

from __future__ import annotations

from collections.abc import Callable, Iterable
from pathlib import Path

from pyspark.sql import DataFrame, Row, SparkSession
from pyspark.sql import functions as F

from ..functions.cost import cost_usd
from ..operators.blocks import DEFAULT_BLOCK_MS
from ..schema import TOKENS
from ..sources import catalogs as C
from ..sources.lifecycle import TTL_MS, Loader, Source, default_cache_dir, fetch_json, public_sources
from . import pricing


class Pricing:
    """Lookups and prices; catalogs are loaded at first use and again after their time."""

    def __init__(self, spark: SparkSession, loader: Loader, mode: str = "calculate"):
        if mode not in pricing.MODES:
            raise ValueError(f"unknown mode {mode!r}")
        self.spark, self.loader, self.mode = spark, loader, mode
        self._made: tuple[list[C.Catalog], DataFrame] | None = None

    def relation(self) -> DataFrame:
        """The catalog rows; made anew only when the catalogs are."""
        held = self.loader.catalogs()
        if self._made is None or self._made[0] is not held:
            self._made = (held, C.relation(self.spark, held))
        return self._made[1]

    def catalogs(self) -> DataFrame:
        """Source, fetched_at and number of models of each catalog, those without any too."""
        rows = [(k, c.source, c.fetched_at, len(c.prices)) for k, c in enumerate(self.loader.catalogs())]
        return self.spark.createDataFrame(rows, "catalog_ord int, source string, fetched_at string, models int").orderBy("catalog_ord")

    def lookup_models(self, models: DataFrame) -> DataFrame:
        return pricing.lookup(models, self.relation())

    def price_tokens(self, model: str, tokens: dict[str, int]) -> Row:
        """The lookup of one model, and usd: what the tokens cost, null for a miss."""
        counts = {"input": 0, "output": 0, "cache_read": 0, "cache_write": 0, "cache_write_1h": None, "reasoning": 0} | tokens
        one = self.spark.createDataFrame([(model, counts)], f"model string, tokens {TOKENS}")
        return one.join(self.lookup_models(one), "model").withColumn("usd", cost_usd(F.col("tokens"), F.col("price"))).drop("tokens").first()

    def price_rollups(self, rollups: DataFrame) -> DataFrame:
        return pricing.price_rollups(rollups, self.relation(), self.mode)

    def price_events(self, events: DataFrame, by: str = "day", tz: str | None = None, block_ms: int = DEFAULT_BLOCK_MS) -> DataFrame:
        return pricing.price_events(events, self.relation(), by, tz, self.mode, block_ms)


def create_pricing(
    spark: SparkSession, sources: list[Source] | None = None, overrides: Iterable[dict] = (), mode: str = "calculate", cache_dir: str | Path | None = None,
    offline: bool = False, ttl_ms: int = TTL_MS, refresh: bool = False, fetch: Callable[[str], object] = fetch_json, **more,
) -> Pricing:
    """Pricing over user prices first, then the sources in order: by default the public catalogs."""
    chosen = public_sources(fetch) if sources is None else sources
    loader = Loader(chosen, Path(cache_dir) if cache_dir else default_cache_dir(), ttl_ms, offline, [C.overrides(overrides)], refresh=refresh, **more)
    return Pricing(spark, loader, mode)
