"""Price catalogs: payload parsers, overrides, and the catalog relation.

Payloads are a few MB of JSON that the driver has fetched anyway; they are read
here and become one small relation, a row per (catalog, key).
"""

from __future__ import annotations

import json
import math
from collections.abc import Iterable
from dataclasses import dataclass, field
from typing import Any

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..schema import CATALOG

MILLION = 1e6
#: Catalog rows up to which the relation is broadcast: a public catalog has some thousand
BROADCAST_KEYS = 200_000
#: Fixed value: context thresholds, in thousands of tokens, of tiered rates
TIER_THOUSANDS = (128, 200, 256, 272, 512)


def number(value: Any) -> float | None:
    """A finite JSON number or numeric string."""
    if isinstance(value, bool) or not isinstance(value, (int, float, str)):
        return None
    if isinstance(value, str) and (not value.strip() or "_" in value):
        return None
    try:
        found = float(value)
    except (ValueError, OverflowError):
        return None
    return found if math.isfinite(found) else None


def _scaled(value: Any) -> float | None:
    found = number(value)
    return None if found is None else found * MILLION


def _one_hour(value: Any) -> float | None:
    found = _scaled(value)
    return found if found is not None and found >= 0 and math.isfinite(found) else None


@dataclass
class Catalog:
    """Prices by key in insertion order; a repeated key keeps its place."""

    source: str
    prices: dict[str, dict] = field(default_factory=dict)
    fetched_at: str | None = None
    is_override: bool = False


def _price(rate_in: float, rate_out: float, **more: Any) -> dict:
    return {"input": rate_in, "output": rate_out, "cache_read": None, "cache_write": None, "cache_write_1h": None, "tiers": None, "tier_mode": None} | more


def _dicts(value: Any) -> dict:
    return value if isinstance(value, dict) else {}


def parse_openrouter(payload: Any) -> dict[str, dict]:
    """Decimal strings, USD per token."""
    data = _dicts(payload).get("data")
    out: dict[str, dict] = {}
    for entry in data if isinstance(data, list) else []:
        key, rates = _dicts(entry).get("id"), _dicts(entry).get("pricing")
        if not isinstance(key, str) or not isinstance(rates, dict):
            continue
        i, o = _scaled(rates.get("prompt")), _scaled(rates.get("completion"))
        if i is not None and o is not None:
            out[key] = _price(i, o, cache_read=_scaled(rates.get("input_cache_read")), cache_write=_scaled(rates.get("input_cache_write")))
    return out


#: LiteLLM's names of our rates
_LITELLM = {"input": "input_cost_per_token", "output": "output_cost_per_token", "cache_read": "cache_read_input_token_cost", "cache_write": "cache_creation_input_token_cost"}
_LITELLM_1H = "cache_creation_input_token_cost_above_1hr"


def _litellm_tiers(entry: dict) -> list[dict]:
    tiers: list[dict] = []
    for thousand in TIER_THOUSANDS:
        mark = f"_above_{thousand}k_tokens"
        own = {rate: _scaled(entry.get(name + mark)) for rate, name in _LITELLM.items()}
        own["cache_write_1h"] = _one_hour(entry.get(_LITELLM_1H + mark))
        if all(v is None for v in own.values()):
            continue
        below = tiers[-1] if tiers else {rate: _scaled(entry.get(_LITELLM[rate])) or 0.0 for rate in ("input", "output")}
        inherited = {rate: below.get(rate) for rate in _LITELLM}
        tiers.append({"threshold": thousand * 1000.0, **{r: inherited[r] if own[r] is None else own[r] for r in _LITELLM}, "cache_write_1h": own["cache_write_1h"]})
    return tiers


def parse_litellm(payload: Any) -> dict[str, dict]:
    """USD per token by model; tiers by context; Claude bills the whole request at its tier."""
    out: dict[str, dict] = {}
    for key, entry in sorted(_dicts(payload).items()):
        if key == "sample_spec" or not isinstance(entry, dict):
            continue
        rates = {rate: _scaled(entry.get(name)) for rate, name in _LITELLM.items()}
        if rates["input"] is None or rates["output"] is None:
            continue
        tiers = _litellm_tiers(entry) or None
        mode = "whole-request" if tiers and "claude" in key else None
        out[key] = _price(rates["input"], rates["output"], cache_read=rates["cache_read"], cache_write=rates["cache_write"], cache_write_1h=_one_hour(entry.get(_LITELLM_1H)), tiers=tiers, tier_mode=mode)
    return out


def parse_models_dev(payload: Any) -> dict[str, dict]:
    """USD per million; provider/model first, the bare id where it is not taken."""
    out: dict[str, dict] = {}
    for provider, about in sorted(_dicts(payload).items()):
        for model, entry in sorted(_dicts(_dicts(about).get("models")).items()):
            cost = _dicts(_dicts(entry).get("cost"))
            i, o = number(cost.get("input")), number(cost.get("output"))
            if i is None or o is None:
                continue
            price = _price(i, o, cache_read=number(cost.get("cache_read")), cache_write=number(cost.get("cache_write")))
            out[f"{provider}/{model}"] = price
            out.setdefault(model, price)
    return out


PARSERS = {"openrouter": parse_openrouter, "litellm": parse_litellm, "models.dev": parse_models_dev}


def parse(kind: str, payload: str | Any, fetched_at: str | None = None) -> Catalog:
    data = json.loads(payload) if isinstance(payload, (str, bytes)) else payload
    return Catalog(kind, PARSERS[kind](data), fetched_at)


def overrides(entries: Iterable[dict]) -> Catalog:
    """User prices in camelCase; the last of a repeated model wins; zero prices count."""

    def snake(e: dict) -> dict:
        return {"input": float(e["input"]), "output": float(e["output"]), "cache_read": number(e.get("cacheRead")), "cache_write": number(e.get("cacheWrite")), "cache_write_1h": number(e.get("cacheWrite1h"))}

    prices = {}
    for e in entries:
        tiers = [{"threshold": float(t["threshold"]), **snake(t)} for t in e.get("tiers") or []] or None
        prices[e["model"]] = snake(e) | {"tiers": tiers, "tier_mode": e.get("tierMode")}
    return Catalog("override", prices, is_override=True)


def relation(spark: SparkSession, catalogs: list[Catalog]) -> DataFrame:
    """One row per key, catalogs in order of priority."""
    order = ("input", "output", "cache_read", "cache_write", "cache_write_1h")
    rows = []
    for ord_, c in enumerate(catalogs):
        for key_ord, (key, p) in enumerate(c.prices.items()):
            tiers = [(t["threshold"], *(t.get(r) for r in order)) for t in p["tiers"]] if p.get("tiers") else None
            rows.append((ord_, c.source, c.fetched_at, c.is_override, key_ord, key, (*(p.get(r) for r in order), tiers, p.get("tier_mode"))))
    made = spark.createDataFrame(rows, CATALOG)
    return F.broadcast(made) if len(rows) <= BROADCAST_KEYS else made


def provenance(catalog: DataFrame) -> DataFrame:
    """source, fetched_at and number of models of each catalog, in order."""
    return catalog.groupBy("catalog_ord", "source", "fetched_at").agg(F.count("*").alias("models")).orderBy("catalog_ord")
