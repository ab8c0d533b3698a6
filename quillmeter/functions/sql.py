"""The library's functions for SQL: temporary functions with SQL bodies.

``register(spark)`` makes them; then ``SELECT cost_usd(tokens, price)``,
``date_parse_ms(text)`` or ``FROM ranked_keys(model)`` work in any query of the
session, inlined and optimised like built-in expressions.

Bodies without lambdas are the column builders' own expressions, as Spark writes
them; those with lambdas are written here, and tests hold them to the builders.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, SparkSession
from pyspark.sql import functions as F

from ..schema import PRICE, TIER, TOKENS
from .instants import day_key, iso, parse_ms, within_hour
from .models import FAMILY, ROUTES, estimate_tokens
from .paths import basename, normalize_workspace, parent, stem

#: Functions whose bodies are column builders': parameters, type, builder
FROM_COLUMNS: dict[str, tuple[str, str, Callable[..., Column]]] = {
    "date_parse_ms": ("text STRING", "BIGINT", parse_ms),
    "iso_instant": ("ms BIGINT", "STRING", iso),
    "day_key": ("ms BIGINT, tz STRING", "STRING", day_key),
    "within_hour": ("ms BIGINT, tz STRING", "BIGINT", within_hour),
    "normalize_workspace": ("path STRING", "STRING", normalize_workspace),
    "path_basename": ("path STRING", "STRING", basename),
    "path_parent": ("path STRING", "STRING", parent),
    "path_stem": ("path STRING", "STRING", stem),
    "estimate_tokens": ("text STRING", "BIGINT", estimate_tokens),
}


def _body(spark: SparkSession, parameters: str, builder: Callable[..., Column]) -> str:
    """SQL of a builder's expression over columns named and typed as the parameters."""
    named = [p.split() for p in parameters.split(", ")]
    empty = spark.createDataFrame([], ", ".join(f"{n} {t}" for n, t in named))
    made = empty.select(builder(*[F.col(n) for n, _ in named]).alias("made"))
    return made._jdf.queryExecution().analyzed().expressions().head().child().sql()


def _quoted(text: str) -> str:
    return "'" + text.replace("\\", "\\\\").replace("'", "\\'") + "'"


def _widened(variants: str, derived: str) -> str:
    """All variants, then what each derives, first occurrences in order; nulls are no variants."""
    return f"array_distinct(array_compact(concat({variants}, flatten(transform({variants}, x -> array({derived}))))))"


#: Steps by which a model's keys widen, each an SQL function of an array
KEY_STEPS = {
    "_keys_unrouted": ", ".join(f"CASE WHEN startswith(x, '{r}') THEN substr(x, {len(r) + 1}) END" for r in ROUTES),
    "_keys_family": f"CASE WHEN x RLIKE {_quoted(FAMILY)} THEN regexp_replace(x, {_quoted(FAMILY)}, '$1-$2.$3') END",
    "_keys_dotted": r"replace(x, '.', '-'), regexp_replace(x, '(\\d)-(\\d)', '$1.$2')",
    "_keys_undated": r"regexp_replace(regexp_replace(x, '-\\d{8}$', ''), '-\\d{4}-\\d{2}-\\d{2}$', '')",
    "_keys_owned": "CASE WHEN startswith(x, 'claude-') THEN concat('anthropic/', x) END",
}

_LEVEL = "STRUCT<threshold: DOUBLE, input: DOUBLE, output: DOUBLE, read: DOUBLE, write: DOUBLE, r: DOUBLE, w: DOUBLE, w1: DOUBLE>"


def _level(t: str, threshold: str, read: str, write: str) -> str:
    rates = f"'input', {t}.input, 'output', {t}.output, 'read', {read}, 'write', {write}, 'r', coalesce({read}, {t}.input), 'w', coalesce({write}, {t}.input), 'w1', coalesce({t}.cache_write_1h, {t}.input * 2)"
    return f"CAST(named_struct('threshold', {threshold}, {rates}) AS {_LEVEL})"


def _fresh(level: str) -> str:
    """What input, cache reads and cache writes cost at a level, in millionths."""
    return f"(n.i * {level}.input + n.c * {level}.r + n.w5 * {level}.w + n.w1 * {level}.w1)"


_NUMBERS = (
    "named_struct('i', CAST(coalesce(tokens.input, 0) AS DOUBLE), 'c', CAST(coalesce(tokens.cache_read, 0) AS DOUBLE), 'o', CAST(coalesce(tokens.output, 0) AS DOUBLE) + CAST(coalesce(tokens.reasoning, 0) AS DOUBLE), "
    "'w1', CAST(coalesce(one_hour_writes(tokens), 0) AS DOUBLE), 'w5', CAST(coalesce(tokens.cache_write, 0) AS DOUBLE) - CAST(coalesce(one_hour_writes(tokens), 0) AS DOUBLE), "
    "'x', CAST(coalesce(tokens.input, 0) AS DOUBLE) + CAST(coalesce(tokens.cache_read, 0) AS DOUBLE) + CAST(coalesce(tokens.cache_write, 0) AS DOUBLE))"
)
_N = "STRUCT<i: DOUBLE, c: DOUBLE, o: DOUBLE, w1: DOUBLE, w5: DOUBLE, x: DOUBLE>"
_BLEND = "CASE WHEN n.x = 0 THEN 0D ELSE {} / n.x END"
_CLIMBED = (
    f"aggregate(slice(levels, 2, 1000), named_struct('usd', 0D, 'at', 0D, 'rate', {_BLEND.format(_fresh('levels[0]'))}), "
    f"(s, l) -> CASE WHEN n.x > l.threshold THEN named_struct('usd', s.usd + (l.threshold - s.at) * s.rate, 'at', l.threshold, 'rate', {_BLEND.format(_fresh('l'))}) ELSE s END, "
    "s -> s.usd + (n.x - s.at) * s.rate)"
)

#: Functions with bodies written here, in the order in which they use each other
WRITTEN: dict[str, tuple[str, str, str]] = {
    **{name: ("v ARRAY<STRING>", "ARRAY<STRING>", _widened("v", derived)) for name, derived in KEY_STEPS.items()},
    "_keys_tails": ("model STRING", "ARRAY<STRING>", "transform(sequence(1, size(split(model, '/'))), i -> array_join(slice(split(model, '/'), i, size(split(model, '/'))), '/'))"),
    "_keys_own": ("model STRING", "ARRAY<STRING>", "array_distinct(array(model, element_at(split(model, '/'), -1)))"),
    "candidate_keys": ("model STRING", "ARRAY<STRING>", "filter(array_distinct(concat(_keys_tails(model), _keys_owned(_keys_undated(_keys_dotted(_keys_family(_keys_unrouted(_keys_own(model)))))))), k -> k <> '')"),
    "one_hour_writes": (f"tokens {TOKENS}", "BIGINT", "CASE WHEN tokens.cache_write_1h IS NOT NULL THEN greatest(0L, least(tokens.cache_write_1h, greatest(tokens.cache_write, 0L))) END"),
    "price_levels": (
        f"price {PRICE}", f"ARRAY<{_LEVEL}>",
        f"aggregate(array_sort(coalesce(price.tiers, CAST(array() AS ARRAY<{TIER}>)), (a, b) -> CASE WHEN a.threshold < b.threshold THEN -1 WHEN a.threshold > b.threshold THEN 1 ELSE 0 END), "
        f"array({_level('price', '0D', 'price.cache_read', 'price.cache_write')}), "
        f"(done, t) -> concat(done, array({_level('t', 't.threshold', 'coalesce(t.cache_read, element_at(done, -1).read)', 'coalesce(t.cache_write, element_at(done, -1).write)')})))",
    ),
    "_token_numbers": (f"tokens {TOKENS}", _N, _NUMBERS),
    "_billed": (
        f"n {_N}, levels ARRAY<{_LEVEL}>, mode STRING", "DOUBLE",
        f"CASE WHEN size(levels) = 1 THEN ({_fresh('levels[0]')} + n.o * levels[0].output) / 1000000D "
        f"WHEN mode = 'whole-request' THEN aggregate(filter(levels, (l, k) -> k = 0 OR n.x > l.threshold), 0D, (s, l) -> ({_fresh('l')} + n.o * l.output) / 1000000D) "
        f"ELSE ({_CLIMBED} + n.o * levels[0].output) / 1000000D END",
    ),
    "cost_usd": (f"tokens {TOKENS}, price {PRICE}", "DOUBLE", "CASE WHEN price IS NOT NULL THEN _billed(_token_numbers(tokens), price_levels(price), price.tier_mode) END"),
}

#: Table functions: parameters, columns, query
TABLES: dict[str, tuple[str, str, str]] = {
    # outer, as Spark infers from a plain one that there are keys, and asks that of every row of the caller's table before it is grouped
    "ranked_keys": ("model STRING", "key_rank INT, key STRING", "SELECT pos, col FROM (SELECT candidate_keys(model) AS held), LATERAL posexplode_outer(held) WHERE col IS NOT NULL"),
}


def register(spark: SparkSession) -> list[str]:
    """Make the functions of this module temporary functions of the session; their names."""
    for name, (parameters, kind, builder) in FROM_COLUMNS.items():
        spark.sql(f"CREATE OR REPLACE TEMPORARY FUNCTION {name}({parameters}) RETURNS {kind} RETURN {_body(spark, parameters, builder)}")
    for name, (parameters, kind, body) in WRITTEN.items():
        spark.sql(f"CREATE OR REPLACE TEMPORARY FUNCTION {name}({parameters}) RETURNS {kind} RETURN {body}")
    for name, (parameters, columns, query) in TABLES.items():
        spark.sql(f"CREATE OR REPLACE TEMPORARY FUNCTION {name}({parameters}) RETURNS TABLE({columns}) RETURN {query}")
    return [*FROM_COLUMNS, *WRITTEN, *TABLES]
