"""Queries over the driver's tables: every operator on a usage view of ``events``.

The view's SQL is the same text in Spark and DuckDB but for the instant, so the
two start from equal rows.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.cells import counter_at
from ..functions.instants import parse_ms
from ..functions.models import candidate_keys, estimate_tokens
from ..functions.paths import normalize_workspace
from ..operators import windows as W
from ..operators.rollup import rollup
from ..sources import catalogs as C
from . import pricing
from .homes import HOMES, read_home
from .read_usage import bounded

Query = Callable[[SparkSession, str], DataFrame]

MODELS = ("gpt-5", "openai/gpt-5", "claude-sonnet-4-5", "us.anthropic.claude-opus-4-6-20260115-v1:0", "free-model", "totally-unknown-model-9000")


def _usage_sql(ms: str, k: str, source: str) -> str:
    picks = " ".join(f"WHEN {i} THEN '{m}'" for i, m in enumerate(MODELS))
    return f"""
SELECT event_id AS seq, 'h_' || event_type AS harness, {ms} AS ts_ms, concat('u', user_id) AS session_id, concat('e', event_id) AS message_id,
  event_type = 'click' AS turn, k % 7 = 0 AS subagent, CASE k % 6 {picks} END AS model,
  CAST(floor(value * 1000) AS BIGINT) AS input, CAST(k * 10 AS BIGINT) AS output, CAST(k * 3 AS BIGINT) AS cache_read, CAST((k % 5) * 7 AS BIGINT) AS cache_write,
  CAST(CASE WHEN k % 5 = 1 THEN (k % 5) * 7 + 5 WHEN k % 5 = 2 THEN 3 END AS BIGINT) AS cache_write_1h, CAST(k % 3 AS BIGINT) AS reasoning,
  CAST(CASE WHEN k % 4 = 0 THEN 2 END AS BIGINT) AS calls, CASE WHEN k % 5 = 0 THEN value / 1000 END AS cost_usd,
  CASE WHEN k % 11 <> 0 THEN concat('/w/', k % 13) END AS workspace, k
FROM (SELECT *, {k} AS k FROM {source}) e"""


USAGE_DUCK = _usage_sql("epoch_us(ts) // 1000", "CAST(json_extract(props, '$.k') AS BIGINT)", "events")


def usage(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The usage view as events; session zone does not matter."""
    spark.read.parquet(f"{sf_dir}/events.parquet").createOrReplaceTempView("_events")
    ms = "timestampdiff(MILLISECOND, TIMESTAMP_NTZ'1970-01-01 00:00:00', CAST(ts AS TIMESTAMP_NTZ))"
    flat = spark.sql(_usage_sql(ms, "CAST(get_json_object(props, '$.k') AS BIGINT)", "_events"))
    counters = ("input", "output", "cache_read", "cache_write", "cache_write_1h", "reasoning")
    return flat.withColumn("tokens", F.struct(*counters)).drop(*counters)


def catalog(spark: SparkSession) -> DataFrame:
    """Two small catalogs: flat, tiered (both modes), a placeholder."""
    litellm = {
        "gpt-5": {"input_cost_per_token": 1.25e-6, "output_cost_per_token": 1e-5, "cache_read_input_token_cost": 1.25e-7, "input_cost_per_token_above_200k_tokens": 2.5e-6, "output_cost_per_token_above_200k_tokens": 1.5e-5},
        "claude-sonnet-4-5": {"input_cost_per_token": 3e-6, "output_cost_per_token": 1.5e-5, "cache_read_input_token_cost": 3e-7, "cache_creation_input_token_cost": 3.75e-6, "cache_creation_input_token_cost_above_1hr": 6e-6, "input_cost_per_token_above_200k_tokens": 6e-6, "output_cost_per_token_above_200k_tokens": 2.25e-5},
        "free-model": {"input_cost_per_token": 0, "output_cost_per_token": 0},
    }
    router = {"data": [{"id": "openai/gpt-5", "pricing": {"prompt": "0.000002", "completion": "0.00001"}}, {"id": "anthropic/claude-opus-4.6", "pricing": {"prompt": "0.000005", "completion": "0.000025", "input_cache_read": "0.0000005", "input_cache_write": "0.00000625"}}]}
    return C.relation(spark, [C.parse("litellm", litellm), C.parse("openrouter", router)])


#: The same prices by model as SQL values: what the lookup must find
_RATES = """
rates(model, source, matched_key, tiered, whole, i, o, r, w, w1, ti, t_o, tr, tw, tw1) AS (VALUES
  ('gpt-5', 'litellm', 'gpt-5', true, false, 1.25, 10.0, 0.125, 1.25, 2.5, 2.5, 15.0, 0.125, 2.5, 5.0),
  ('openai/gpt-5', 'litellm', 'gpt-5', true, false, 1.25, 10.0, 0.125, 1.25, 2.5, 2.5, 15.0, 0.125, 2.5, 5.0),
  ('claude-sonnet-4-5', 'litellm', 'claude-sonnet-4-5', true, true, 3.0, 15.0, 0.3, 3.75, 6.0, 6.0, 22.5, 0.3, 3.75, 12.0),
  ('us.anthropic.claude-opus-4-6-20260115-v1:0', 'openrouter', 'anthropic/claude-opus-4.6', false, false, 5.0, 25.0, 0.5, 6.25, 10.0, 0.0, 0.0, 0.0, 0.0, 0.0))"""


def _cost_sql(scale: str = "1") -> str:
    """Cost of the columns of a usage row joined with rates; the one tier starts past 200,000."""
    n = {c: f"({c} * {scale})::DOUBLE" for c in ("input", "output", "cache_read", "cache_write", "reasoning")}
    w1 = f"(least(coalesce(cache_write_1h, 0), cache_write) * {scale})::DOUBLE"
    ctx = f"({n['input']} + {n['cache_read']} + {n['cache_write']})"
    part = lambda i, r, w, x: f"({n['input']} * {i} + {n['cache_read']} * {r} + ({n['cache_write']} - {w1}) * {w} + {w1} * {x})"
    base, tier = part("i", "r", "w", "w1"), part("ti", "tr", "tw", "tw1")
    out = f"({n['output']} + {n['reasoning']})"
    return f"""(CASE WHEN NOT tiered OR {ctx} <= 200000 THEN {base} + {out} * o
      WHEN whole THEN {tier} + {out} * t_o
      ELSE 200000 * ({base} / {ctx}) + ({ctx} - 200000) * ({tier} / {ctx}) + {out} * o END) / 1000000.0"""


_AGG = """coalesce(sum(input), 0)::BIGINT AS input, coalesce(sum(output), 0)::BIGINT AS output, coalesce(sum(cache_read), 0)::BIGINT AS cache_read,
  coalesce(sum(cache_write), 0)::BIGINT AS cache_write, coalesce(sum(reasoning), 0)::BIGINT AS reasoning,
  sum(CASE WHEN cache_write_1h IS NOT NULL THEN least(cache_write_1h, cache_write) END)::BIGINT AS cache_write_1h,
  count(*) AS events, count(*) FILTER (turn) AS turns, sum(coalesce(calls, 1))::BIGINT AS calls, round(sum(cost_usd), 6) AS cost_usd"""


def _rolled(by: str, tz: str = "UTC", block_ms: int = 18_000_000, pick: Callable[[DataFrame], DataFrame] = lambda e: e) -> Query:
    return lambda spark, d: rollup(pick(usage(spark, d)), by, tz, block_ms).withColumn("cost_usd", F.round("cost_usd", 6))


def _rolled_sql(key: str, where: str = "true") -> str:
    return f"WITH u AS ({USAGE_DUCK}) SELECT {key} AS key, {_AGG} FROM u WHERE {where} GROUP BY 1"


def _day_sql(tz: str) -> str:
    return _rolled_sql(f"strftime(make_timestamp(ts_ms * 1000) AT TIME ZONE 'UTC' AT TIME ZONE '{tz}', '%Y-%m-%d')")


def _block_sql(width: int) -> str:
    unit = min(width, 3_600_000)
    cut = lambda x: f"({x} - ({x} % 3600000) % {unit})"
    return f"""
WITH RECURSIVE u AS MATERIALIZED ({USAGE_DUCK}), t AS MATERIALIZED (SELECT DISTINCT ts_ms FROM u),
b AS (SELECT min(ts_ms) AS opened, {cut("min(ts_ms)")} AS start FROM t
  UNION ALL SELECT n, {cut("n")} FROM (SELECT (SELECT min(ts_ms) FROM t WHERE ts_ms >= b.start + {width}) AS n FROM b) WHERE n IS NOT NULL),
k AS (SELECT u.*, b.start FROM u ASOF JOIN b ON u.ts_ms >= b.opened)
SELECT strftime(make_timestamp(start * 1000), '%Y-%m-%dT%H:%M:%S.') || lpad((start % 1000)::VARCHAR, 3, '0') || 'Z' AS key, {_AGG} FROM k GROUP BY 1"""


SINCE, UNTIL = 1_705_000_000_000, 1_706_000_000_000
_PLAIN = ["seq", "session_id", "message_id", "model", "k"]


def _dedup_first(spark: SparkSession, d: DataFrame) -> DataFrame:
    return W.first_wins(usage(spark, d), ["session_id", "k"], ["ts_ms", "seq"]).select(*_PLAIN)


def _dedup_last(spark: SparkSession, d: str) -> DataFrame:
    e = usage(spark, d).select("session_id", "k", "ts_ms", "seq", "model", "message_id")
    return W.last_wins(e, ["session_id", "k"], ["ts_ms", "seq"]).select(*_PLAIN, F.col("position.seq").alias("first_seq"))


def _best(spark: SparkSession, d: str) -> DataFrame:
    e = usage(spark, d)
    total = F.col("tokens.input") + F.col("tokens.output")
    return W.best_of(e, ["session_id"], total.desc(), F.col("turn").desc(), F.col("seq").desc()).select(*_PLAIN)


def _turn_flags(spark: SparkSession, d: str) -> DataFrame:
    c = spark.read.parquet(f"{d}/conversations.parquet")
    by, order = ["conv_id"], ["turn"]
    user, assistant = F.col("role") == "user", F.col("role") == "assistant"
    return c.select("conv_id", "turn", W.previous_is(user, user | assistant, by, order).alias("after_user"), W.pending(user, assistant, by, order).alias("pending_user"))


def _carry(spark: SparkSession, d: str) -> DataFrame:
    e = usage(spark, d).withColumn("changed", F.when(F.col("k") % 4 == 0, F.col("model")))
    return e.select("seq", "session_id", W.carried("changed", ["session_id"], ["ts_ms", "seq"]).alias("carried_model"))


def _delta(spark: SparkSession, d: str) -> DataFrame:
    e = usage(spark, d).select("seq", "session_id", "ts_ms", F.col("tokens.output").alias("a"), F.col("tokens.cache_read").alias("b"))
    found = W.deltas(["a", "b"], ["session_id"], ["ts_ms", "seq"])
    return e.select("seq", found["a"].alias("delta_a"), found["b"].alias("delta_b"))


def _covered(spark: SparkSession, d: str) -> DataFrame:
    e = usage(spark, d)
    return W.without_covered(e, e.where((F.col("harness") == "h_click") & (F.col("k") % 17 == 0)), "session_id").select(*_PLAIN)


def _lanes(spark: SparkSession, d: str) -> DataFrame:
    e = usage(spark, d).select(*_PLAIN, "harness")
    return W.in_lanes(e.where("harness = 'h_click'"), e.where("harness <> 'h_click'")).drop("harness")


def _est(spark: SparkSession, d: str) -> DataFrame:
    c = spark.read.parquet(f"{d}/conversations.parquet")
    return c.select("conv_id", "turn", estimate_tokens(F.col("text")).alias("est_tokens"))


def _home(agent: str) -> Query:
    return lambda spark, d: read_home(usage(spark, d), agent)


def _lookup(spark: SparkSession, d: str) -> DataFrame:
    return pricing.lookup(usage(spark, d), catalog(spark)).select("model", "priced", "source", "matched_key", "tiered", "zero_cost_key")


def _keys(spark: SparkSession, d: str) -> DataFrame:
    return usage(spark, d).select("model").distinct().select("model", F.posexplode(candidate_keys(F.col("model"))).alias("rank", "key"))


def _rollup_priced(mode: str) -> Query:
    def run(spark: SparkSession, d: str) -> DataFrame:
        p = pricing.price_rollups(rollup(usage(spark, d)), catalog(spark), mode)
        return p.select("key", "events", "priced", F.round("usd", 6).alias("usd"), "tiered_aggregate")

    return run


def _events_priced(by: str, mode: str, key_ms: int = 18_000_000, digits: int = 6) -> Query:
    def run(spark: SparkSession, d: str) -> DataFrame:
        p = pricing.price_events(usage(spark, d), catalog(spark), by, "UTC", mode, key_ms)
        return p.select("key", "events", "priced", F.round("usd", digits).alias("usd"), "kind", F.array_join("models", ",").alias("models"), F.array_join("attempted", ",").alias("attempted"), F.col("hit.matched_key").alias("first_key"), F.col("hit.source").alias("first_source"))

    return run


def _tier_cost(part: str) -> Query:
    """Every event with 4000 times the tokens, so that most of those with tiers pass one, by model and ``part``."""

    def run(spark: SparkSession, d: str) -> DataFrame:
        e = usage(spark, d).withColumn("session_id", F.concat_ws(":", part, "model"))
        big = F.struct(*[(F.col("tokens")[c] * 4000).alias(c) for c in ("input", "output", "cache_read", "cache_write", "cache_write_1h", "reasoning")])
        return pricing.price_events(e.withColumn("tokens", big), catalog(spark), "session").select("key", "events", F.round("usd", 4).alias("usd"))

    return run


def _tier_sql(part: str) -> str:
    return f"WITH u AS ({USAGE_DUCK}), {_RATES} SELECT {part} || ':' || model AS key, count(*) AS events, round(sum(CASE WHEN source IS NOT NULL THEN round({_cost_sql('4000')}, 12) END), 4) AS usd FROM u LEFT JOIN rates USING (model) GROUP BY 1"


#: Ways of writing an instant, as Spark formats it, and what each must be read as in DuckDB
_WRITTEN = {
    "yyyy-MM-dd'T'HH:mm:ss.SSS'Z'": "ms", "yyyy-MM-dd'T'HH:mm:ss.SSS'+05:30'": "ms - 19800000", "yyyy-MM-dd": "ms - ms % 86400000", "yyyy-MM-dd HH:mm": "ms - ms % 60000", "yyyy-MM-dd'T'HH:mm:ss.SSSSSS'Z'": "ms", "yyyy-MM-dd HH:mm:ss'-08:00'": "ms - ms % 1000 + 28800000",
    "yyyy-MM-dd'T'HH:mm:ss.SSS'Z '": "NULL", "yyyy/MM/dd": "NULL", "yyyy-MM-dd'T'HH:mm:ss.'Z'": "NULL", "yyyy-MM-dd'T'24:mm": "NULL", "yyyy-MM-'31'": "ms - ms % 86400000 + (31 - day(ts)) * 86400000",
}


def _grammar(spark: SparkSession, d: str) -> DataFrame:
    """Each event's instant written in one of several ways, and read again."""
    e = spark.read.parquet(f"{d}/events.parquet")
    local = F.col("ts").cast("timestamp_ntz")
    text = F.element_at(F.array(*[F.date_format(local, w) for w in _WRITTEN]), (F.col("event_id") % len(_WRITTEN) + 1).cast("int"))
    return e.select("event_id", parse_ms(text).alias("ms"))


_GRAMMAR_SQL = "SELECT event_id, CASE event_id % " + str(len(_WRITTEN)) + " " + " ".join(f"WHEN {k} THEN {ms}" for k, ms in enumerate(_WRITTEN.values())) + " END::BIGINT AS ms FROM (SELECT event_id, ts, epoch_us(ts) // 1000 AS ms FROM events)"

PATHS = (" /home/me/repo/ ", "/home//me///repo", r"C:\Users\Me\Repo", r"C:\\", r"\\\\Server\\Share\\Dir", "relative/Path/", "/", "   ")


def _workspaces(spark: SparkSession, d: str) -> DataFrame:
    e = usage(spark, d).select("seq", F.concat_ws("", F.lit("C:\\W\\\\"), F.col("workspace"), F.lit("//")).alias("raw"))
    return e.select("seq", normalize_workspace(F.col("raw")).alias("workspace"))


def _json_k(spark: SparkSession, d: str) -> DataFrame:
    e = spark.read.parquet(f"{d}/events.parquet")
    return e.select("event_id", counter_at(F.col("props"), "$.k").alias("k"))


def queries() -> dict[str, Query]:
    return {
        "rollup_model": _rolled("model"),
        "rollup_session": _rolled("session"),
        "rollup_harness": _rolled("harness"),
        "rollup_workspace": _rolled("workspace"),
        "rollup_day_utc": _rolled("day"),
        "rollup_day_la": _rolled("day", "America/Los_Angeles"),
        "rollup_day_kolkata": _rolled("day", "Asia/Kolkata"),
        "rollup_block_5h": _rolled("block"),
        "rollup_block_40m": _rolled("block", block_ms=2_400_000),
        "filter_since_until": _rolled("model", pick=lambda e: bounded(e, SINCE, UNTIL)),
        "exclude_subagents": _rolled("model", pick=lambda e: bounded(e, subagents="exclude")),
        "dedup_first_wins": _dedup_first,
        "dedup_last_wins": _dedup_last,
        "best_of_slot": _best,
        "turn_flags": _turn_flags,
        "carry_model": _carry,
        "delta_cumulative": _delta,
        "covered_anti_join": _covered,
        "union_lanes": _lanes,
        "est_tokens": _est,
        "candidate_keys": _keys,
        "price_lookup": _lookup,
        "price_rollups_calculate": _rollup_priced("calculate"),
        "price_rollups_display": _rollup_priced("display"),
        "price_rollups_auto": _rollup_priced("auto"),
        "price_events_by_day": _events_priced("day", "calculate"),
        "price_events_by_session": _events_priced("session", "auto", digits=4),
        "price_events_by_model": _events_priced("model", "display"),
        "price_events_by_block": _events_priced("block", "calculate"),
        "cost_tier_whole": _tier_cost("session_id"),
        "cost_tier_marginal": _tier_cost("harness"),
        "ts_grammar": _grammar,
        "json_k_extract": _json_k,
        "workspace_norm": _workspaces,
    } | {f"reader_{agent}": _home(agent) for agent in HOMES}


def _priced_rollup_sql(mode: str) -> str:
    calc = f"round({_cost_sql()}, 6)"
    usd = {"calculate": f"CASE WHEN source IS NOT NULL THEN {calc} END", "display": "round(coalesce(cost_usd, 0), 6)", "auto": f"coalesce(round(cost_usd, 6), CASE WHEN source IS NOT NULL THEN {calc} END)"}[mode]
    shown = {"calculate": "true", "display": "false", "auto": "cost_usd IS NULL"}[mode]
    return f"""WITH u AS ({USAGE_DUCK}), {_RATES}, g AS (SELECT model, {_AGG} FROM u GROUP BY 1)
SELECT model AS key, events, source IS NOT NULL AS priced, {usd} AS usd,
  source IS NOT NULL AND tiered AND (events > 1 OR calls > 1) AND {shown} AS tiered_aggregate FROM g LEFT JOIN rates USING (model)"""


def _priced_events_sql(key: str, mode: str, digits: int = 6) -> str:
    calc = f"CASE WHEN source IS NOT NULL THEN {_cost_sql()} ELSE 0 END"
    one = {"calculate": calc, "display": "coalesce(cost_usd, 0)", "auto": f"coalesce(cost_usd, {calc})"}[mode]
    shown = "usd" if mode != "calculate" else "CASE WHEN priced THEN usd END"
    return f"""WITH u AS ({USAGE_DUCK}), {_RATES},
g AS (SELECT {key} AS key, count(*) AS events, bool_and(source IS NOT NULL) AS priced, round(sum({one}), {digits}) AS usd, count(DISTINCT model) AS n, string_agg(DISTINCT model, ',' ORDER BY model) AS models,
  min_by(matched_key, seq) FILTER (source IS NOT NULL) AS first_key, min_by(source, seq) FILTER (source IS NOT NULL) AS first_source
  FROM u LEFT JOIN rates USING (model) GROUP BY 1),
tries AS (SELECT key, coalesce(string_agg(model, ',' ORDER BY first) FILTER (source IS NULL), '') AS attempted FROM (SELECT {key} AS key, model, source, min(seq) AS first FROM u LEFT JOIN rates USING (model) GROUP BY 1, 2, 3) GROUP BY 1)
SELECT key, events, attempted, first_key, first_source, priced, {shown} AS usd, CASE WHEN n = 1 THEN 'single' ELSE 'multi' END || CASE WHEN priced THEN '-hit' ELSE '-miss' END AS kind, models FROM g JOIN tries USING (key)"""


_KEYS = {
    "gpt-5": ["gpt-5"],
    "openai/gpt-5": ["openai/gpt-5", "gpt-5"],
    "claude-sonnet-4-5": ["claude-sonnet-4-5", "claude-sonnet-4.5", "anthropic/claude-sonnet-4-5", "anthropic/claude-sonnet-4.5"],
    "free-model": ["free-model"],
    "totally-unknown-model-9000": ["totally-unknown-model-9000"],
    "us.anthropic.claude-opus-4-6-20260115-v1:0": [
        "us.anthropic.claude-opus-4-6-20260115-v1:0", "anthropic.claude-opus-4-6-20260115-v1:0", "claude-opus-4.6", "us-anthropic-claude-opus-4-6-20260115-v1:0", "us.anthropic.claude-opus-4.6-20260115-v1:0",
        "anthropic-claude-opus-4-6-20260115-v1:0", "anthropic.claude-opus-4.6-20260115-v1:0", "claude-opus-4-6", "anthropic/claude-opus-4.6", "anthropic/claude-opus-4-6",
    ],
}


def _priced_blocks_sql(width: int) -> str:
    inner = _block_sql(width)
    keyed = inner[: inner.index("SELECT strftime")]
    key = "strftime(make_timestamp(start * 1000), '%Y-%m-%dT%H:%M:%S.') || lpad((start % 1000)::VARCHAR, 3, '0') || 'Z'"
    rest = _priced_events_sql(key, "calculate").replace(f"WITH u AS ({USAGE_DUCK}), {_RATES},", "").replace("FROM u LEFT JOIN", "FROM k LEFT JOIN")
    return f"{keyed.rstrip()}, {_RATES}, {rest}"


def oracle_sql() -> dict[str, str]:
    u = f"WITH u AS ({USAGE_DUCK}) "
    plain = ", ".join(_PLAIN)
    keys = ", ".join(f"('{m}', {i}, '{k}')" for m, ks in _KEYS.items() for i, k in enumerate(ks))
    by = "PARTITION BY session_id ORDER BY ts_ms, seq"
    return {
        "rollup_model": _rolled_sql("model"),
        "rollup_session": _rolled_sql("session_id"),
        "rollup_harness": _rolled_sql("harness"),
        "rollup_workspace": _rolled_sql("coalesce(workspace, '(unknown)')"),
        "rollup_day_utc": _day_sql("UTC"),
        "rollup_day_la": _day_sql("America/Los_Angeles"),
        "rollup_day_kolkata": _day_sql("Asia/Kolkata"),
        "rollup_block_5h": _block_sql(18_000_000),
        "rollup_block_40m": _block_sql(2_400_000),
        "filter_since_until": _rolled_sql("model", f"ts_ms >= {SINCE} AND ts_ms < {UNTIL}"),
        "exclude_subagents": _rolled_sql("model", "NOT subagent"),
        "dedup_first_wins": u + f"SELECT {plain} FROM (SELECT *, row_number() OVER (PARTITION BY session_id, k ORDER BY ts_ms, seq) AS n FROM u) WHERE n = 1",
        "dedup_last_wins": u + f"SELECT {plain}, first_seq FROM (SELECT *, row_number() OVER (PARTITION BY session_id, k ORDER BY ts_ms DESC, seq DESC) AS n, first_value(seq) OVER (PARTITION BY session_id, k ORDER BY ts_ms, seq) AS first_seq FROM u) WHERE n = 1",
        "best_of_slot": u + f"SELECT {plain} FROM (SELECT *, row_number() OVER (PARTITION BY session_id ORDER BY input + output DESC, turn DESC, seq DESC) AS n FROM u) WHERE n = 1",
        "turn_flags": "SELECT conv_id, turn, coalesce(last_value(CASE WHEN role IN ('user', 'assistant') THEN role = 'user' END IGNORE NULLS) OVER w, false) AS after_user, coalesce(max(CASE WHEN role = 'user' THEN turn END) OVER w > coalesce(max(CASE WHEN role = 'assistant' THEN turn END) OVER w, -1), false) AS pending_user FROM conversations WINDOW w AS (PARTITION BY conv_id ORDER BY turn ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)",
        "carry_model": u + f"SELECT seq, session_id, last_value(CASE WHEN k % 4 = 0 THEN model END IGNORE NULLS) OVER ({by} ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS carried_model FROM u",
        "delta_cumulative": u + f"SELECT seq, CASE WHEN pa IS NULL OR output < pa OR cache_read < pb THEN output ELSE output - pa END AS delta_a, CASE WHEN pa IS NULL OR output < pa OR cache_read < pb THEN cache_read ELSE cache_read - pb END AS delta_b FROM (SELECT *, lag(output) OVER ({by}) AS pa, lag(cache_read) OVER ({by}) AS pb FROM u)",
        "covered_anti_join": u + f"SELECT {plain} FROM u WHERE NOT EXISTS (SELECT 1 FROM u c WHERE c.session_id = u.session_id AND c.harness = 'h_click' AND c.k % 17 = 0)",
        "union_lanes": u + f"SELECT {plain}, 0 AS lane FROM u WHERE harness = 'h_click' UNION ALL SELECT {plain}, 1 FROM u WHERE harness <> 'h_click'",
        "est_tokens": "SELECT conv_id, turn, ((strlen(text) // 4 + 5) // 10 * 10)::BIGINT AS est_tokens FROM conversations",
        "candidate_keys": u + f"SELECT v.model, v.rank, v.key FROM (VALUES {keys}) v(model, rank, key) WHERE model IN (SELECT model FROM u)",
        "price_lookup": f"WITH u AS ({USAGE_DUCK}), {_RATES} SELECT model, source IS NOT NULL AS priced, source, matched_key, coalesce(tiered, false) AS tiered, CASE WHEN model = 'free-model' THEN model END AS zero_cost_key FROM (SELECT DISTINCT model FROM u) LEFT JOIN rates USING (model)",
        "price_rollups_calculate": _priced_rollup_sql("calculate"),
        "price_rollups_display": _priced_rollup_sql("display"),
        "price_rollups_auto": _priced_rollup_sql("auto"),
        "price_events_by_day": _priced_events_sql("strftime(make_timestamp(ts_ms * 1000), '%Y-%m-%d')", "calculate"),
        "price_events_by_session": _priced_events_sql("session_id", "auto", 4),
        "price_events_by_model": _priced_events_sql("model", "display"),
        "price_events_by_block": _priced_blocks_sql(18_000_000),
        "cost_tier_whole": _tier_sql("session_id"),
        "cost_tier_marginal": _tier_sql("harness"),
        "ts_grammar": _GRAMMAR_SQL,
        "json_k_extract": "SELECT event_id, CAST(json_extract(props, '$.k') AS BIGINT) AS k FROM events",
        "workspace_norm": u + "SELECT seq, lower(regexp_replace(rtrim(regexp_replace(replace(concat('C:\\W\\\\', workspace, '//'), '\\', '/'), '/+', '/', 'g'), '/'), '^$', '/')) AS workspace FROM u",
    } | {f"reader_{agent}": home.sql(USAGE_DUCK) for agent, home in HOMES.items()}


