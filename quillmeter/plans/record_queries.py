"""Queries over the driver's tables: records matched, merged and reconciled; logs and catalogs in columns."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.sql import register
from ..operators import records as R
from ..sources.catalog_columns import relation
from ..sources import sqlite_source
from ..sources.logs_in_columns import claude_events, pi_events
from .homes import home_dir
from .testdata import _RATES, SINCE, UNTIL, USAGE_DUCK, Query, _cost_sql, catalog, usage

#: Models of a catalog, which is parsed as one document
CATALOG_USERS = 2_000
_ORDER = ["ts_ms", "seq"]
_TOKENS = ("input", "output", "cache_read", "cache_write", "reasoning")


def _match_turns(spark: SparkSession, d: str) -> DataFrame:
    c = spark.read.parquet(f"{d}/conversations.parquet").select("conv_id", "turn", "role")
    found = R.first_free(c, F.col("role") == "assistant", F.col("role") == "user", ["conv_id"], ["turn"])
    return found.select("conv_id", "turn", F.col("match.turn").alias("match"))


def _match_events(spark: SparkSession, d: str) -> DataFrame:
    """Each error of a session takes the first free click before it."""
    e = usage(spark, d).select("session_id", "ts_ms", "seq", "harness")
    found = R.first_free(e, F.col("harness") == "h_error", F.col("harness") == "h_click", ["session_id"], _ORDER)
    return found.select("seq", "session_id", F.col("match.seq").alias("match"))


def _merged(spark: SparkSession, d: str) -> DataFrame:
    e = spark.read.parquet(f"{d}/events.parquet")
    props = F.from_json("props", "map<string,bigint>")
    named = F.map_from_arrays(F.array(F.lit("value"), F.concat(F.lit("k"), (F.element_at(props, "k") % 3).cast("string"))), F.array(F.floor("value").cast("bigint"), F.element_at(props, "k")))
    found = R.merged(e.select("user_id", "event_type", F.map_concat(props, named).alias("attributes")), ["user_id", "event_type"], "attributes")
    return found.select("user_id", "event_type", F.explode("attributes").alias("name", "largest"))


def _outranked(spark: SparkSession, d: str) -> DataFrame:
    """Of the events of a session that share k, those of the lowest lane."""
    e = usage(spark, d).withColumn("lane", F.when(F.col("harness") == "h_click", 0).when(F.col("harness") == "h_view", 1).when(F.col("harness") == "h_error", 2))
    return R.not_outranked(e.select("seq", "session_id", "k", "lane"), ["session_id", "k"], "lane")


def _reconciled(spark: SparkSession, d: str) -> DataFrame:
    """Views carry a total of the session's input, all other events an increment."""
    e = usage(spark, d).select("seq", "session_id", "ts_ms", "harness", "k", F.col("tokens.input").alias("input"))
    view = F.col("harness") == "h_view"
    found = R.reconciled(e, F.when(view, F.col("input") * (F.col("k") % 9)), F.when(~view, F.col("input")), ["session_id"], _ORDER)
    return found.where("remainder is not null").select("seq", "session_id", "remainder")


def _committed(spark: SparkSession, d: str) -> DataFrame:
    """The last click before each error of a session, and the session's last workspace."""
    e = usage(spark, d).select("seq", "session_id", "ts_ms", "harness", "workspace")
    marked = e.withColumn("committed", R.last_before(F.col("harness") == "h_error", F.col("harness") == "h_click", ["session_id"], _ORDER))
    return R.final(marked, ["workspace"], ["session_id"], _ORDER).select("seq", "committed", "workspace")


def session_log(spark: SparkSession, d: str, entry, user, last: str) -> DataFrame:
    """One log a session, as lines: a user's line where a turn begins, then the event's; a broken line last."""
    e = usage(spark, d)
    n = F.row_number().over(Window.partitionBy("session_id").orderBy("seq"))
    both = e.withColumn("n", n).select("session_id", "n", F.explode(F.array(F.struct(F.lit(0).alias("half"), user.alias("text")), F.struct(F.lit(1).alias("half"), entry.alias("text")))).alias("x"))
    lines = both.select(F.col("session_id"), (2 * F.col("n") - 2 + F.col("x.half")).cast("bigint").alias("src_ord"), F.col("x.text").alias("text"))
    ends = e.groupBy("session_id").agg((2 * F.count("*")).alias("src_ord")).withColumn("text", F.lit(last))
    every = lines.unionByName(ends).where("text is not null")
    return every.select(F.lit(0).alias("lane"), F.lit(0).alias("root_ord"), F.concat(F.lit("/logs/"), "session_id", F.lit(".jsonl")).alias("src_path"), "src_ord", "text")


def _claude_log(spark: SparkSession, d: str) -> DataFrame:
    t = F.col("tokens")
    used = F.struct(t["input"].alias("input_tokens"), t["output"].alias("output_tokens"), t["cache_read"].alias("cache_read_input_tokens"), t["cache_write"].alias("cache_creation_input_tokens"))
    message = F.struct(F.col("message_id").alias("id"), F.lit("assistant").alias("role"), "model", used.alias("usage"))
    entry = F.to_json(F.struct(F.lit("assistant").alias("type"), F.col("session_id").alias("sessionId"), F.col("ts_ms").alias("timestamp"), F.col("subagent").alias("isSidechain"), F.col("workspace").alias("cwd"), message.alias("message")))
    tool = '{"type":"user","message":{"role":"user","content":[{"type":"tool_result"}]}}'
    user = F.when(F.col("turn"), '{"type":"user","message":{"role":"user","content":"go on"}}').otherwise(tool)
    return session_log(spark, d, entry, user, "{broken")


def _pi_log(spark: SparkSession, d: str) -> DataFrame:
    t = F.col("tokens")
    used = F.struct(t["input"].alias("input"), (t["output"] + t["reasoning"]).alias("output"), t["cache_read"].alias("cacheRead"), t["cache_write"].alias("cacheWrite"), t["reasoning"].alias("reasoning"))
    entry = F.to_json(F.struct(F.lit("message").alias("type"), F.col("message_id").alias("id"), F.col("ts_ms").alias("timestamp"), F.struct(F.lit("assistant").alias("role"), "model", used.alias("usage")).alias("message")))
    return session_log(spark, d, entry, F.when(F.col("turn"), '{"type":"message","message":{"role":"user"}}'), '{"type":"message","message":{"role":"assistant","usage":{"input":"x"}}}')


def scanned(log, read) -> Query:
    def run(spark: SparkSession, d: str) -> DataFrame:
        found = read(log(spark, d)).where("kind = 'event'")
        ms = F.unix_millis(F.to_timestamp("timestamp", "yyyy-MM-dd'T'HH:mm:ss.SSSX"))
        return found.select("session_id", "message_id", ms.alias("ts_ms"), "model", *_TOKENS, "turn", "subagent", "workspace")

    return run


def noted(log, read) -> Query:
    return lambda spark, d: read(log(spark, d)).where("kind = 'skip'").select("src_path", "location", "message")


def _payloads(spark: SparkSession, d: str, kind: str) -> DataFrame:
    """Catalogs for each type of event, one for every so many users, with a model for each of them: what they saw sets the rates."""
    e = spark.read.parquet(f"{d}/events.parquet")
    one = e.groupBy("event_type", "user_id").agg(F.count("*").alias("n"), F.sum(F.floor("value").cast("bigint")).alias("v"))
    name = F.concat(F.when(F.col("user_id") % 2 == 0, "claude-").otherwise("m-"), F.col("user_id").cast("string"))
    if kind == "litellm":
        tier = F.when(F.col("n") % 3 == 0, F.col("v"))
        rates = F.struct(F.col("n").alias("input_cost_per_token"), F.col("v").cast("string").alias("output_cost_per_token"), tier.alias("output_cost_per_token_above_200k_tokens"), F.when(F.col("n") % 2 == 0, F.col("n") * 2).alias("input_cost_per_token_above_256k_tokens"))
        body = F.to_json(F.map_from_entries(F.collect_list(F.struct(name, rates))))
    else:
        rates = F.struct(F.col("n").cast("string").alias("prompt"), F.col("v").cast("string").alias("completion"))
        body = F.to_json(F.struct(F.array_sort(F.collect_list(F.struct(name.alias("id"), rates.alias("pricing")))).alias("data")))
    held = one.groupBy("event_type", F.floor(F.col("user_id") / CATALOG_USERS).alias("part")).agg(body.alias("payload"))
    return held.select((F.ascii("event_type") * 1_000_000 + F.col("part")).cast("int").alias("catalog_ord"), F.lit(kind).alias("kind"), F.col("event_type").alias("source"), F.lit(None).cast("string").alias("fetched_at"), "payload")


def _catalog(kind: str) -> Query:
    def run(spark: SparkSession, d: str) -> DataFrame:
        p = F.col("price")
        tiers = F.transform(p["tiers"], lambda t: F.concat_ws(":", *[(t[c] if c == "threshold" else t[c] / 1e6).cast("bigint").cast("string") for c in ("threshold", "input", "output")]))
        return relation(_payloads(spark, d, kind)).select("source", "key", F.round(p["input"] / 1e6).alias("input"), F.round(p["output"] / 1e6).alias("output"), F.array_join(tiers, ";").alias("tiers"), p["tier_mode"].alias("mode"))

    return run


def _sqlite(spark: SparkSession, d: str) -> DataFrame:
    """Events written to stores by session, read back in ranges of rows with the bounds in each store's statement."""
    sqlite_source.register(spark)
    e = usage(spark, d).select("seq", "session_id", "ts_ms", "model", F.col("tokens.input").alias("input"), F.col("tokens.output").alias("output"))
    path = home_dir(spark)
    e.repartition("session_id").write.format("sqlite").options(path=path, table="usage").mode("append").save()
    back = spark.read.format("sqlite").schema(e.schema).options(path=path, table="usage", rowsPerTask="20000").load()
    kept = back.where((F.col("ts_ms") >= SINCE) & (F.col("ts_ms") < UNTIL))
    return kept.groupBy("session_id", "model").agg(F.count("*").alias("events"), F.sum("input").alias("input"), F.sum("output").alias("output"), F.max("seq").alias("last_seq"))


def _in_sql(text: str) -> Query:
    """A query in SQL alone over views of events and prices, with the library's SQL functions."""

    def run(spark: SparkSession, d: str) -> DataFrame:
        register(spark)
        usage(spark, d).createOrReplaceTempView("usage_events")
        catalog(spark).createOrReplaceTempView("prices")
        return spark.sql(text)

    return run


_SQL_COST = """
WITH models AS (SELECT DISTINCT model FROM usage_events),
matched AS (SELECT m.model, r.key_rank, p.catalog_ord, p.source, p.price FROM models m, LATERAL ranked_keys(m.model) r JOIN prices p ON p.key = r.key WHERE p.price.input + p.price.output > 0),
priced AS (SELECT model, min_by(price, struct(catalog_ord, key_rank)) AS price, min_by(source, struct(catalog_ord, key_rank)) AS source FROM matched GROUP BY model)
SELECT u.model, p.source, count(*) AS events, round(sum(cost_usd(u.tokens, p.price)), 6) AS usd, sum(one_hour_writes(u.tokens)) AS hour_writes
FROM usage_events u LEFT JOIN priced p ON p.model = u.model GROUP BY u.model, p.source"""

_SQL_DAYS = """
SELECT day_key(ts_ms, 'America/Los_Angeles') AS day, path_basename(normalize_workspace(concat(workspace, '//'))) AS project, count(*) AS events,
  count_if(date_parse_ms(iso_instant(ts_ms)) = ts_ms) AS kept, max(within_hour(ts_ms, 'Asia/Kolkata')) AS latest
FROM usage_events GROUP BY 1, 2"""


def queries() -> dict[str, Query]:
    return {
        "greedy_match_turns": _match_turns,
        "greedy_match_events": _match_events,
        "merged_attributes": _merged,
        "not_outranked": _outranked,
        "reconciled_totals": _reconciled,
        "committed_and_final": _committed,
        "log_columns_claude": scanned(_claude_log, claude_events),
        "log_columns_pi": scanned(_pi_log, pi_events),
        "log_columns_notes": noted(_claude_log, claude_events),
        "log_columns_pi_notes": noted(_pi_log, pi_events),
        "catalog_columns_litellm": _catalog("litellm"),
        "catalog_columns_openrouter": _catalog("openrouter"),
        "sqlite_since_until": _sqlite,
        "sql_cost_by_model": _in_sql(_SQL_COST),
        "sql_days_by_project": _in_sql(_SQL_DAYS),
    }


def _match_sql(rows: str, key: str, at: str, item: str, candidate: str) -> str:
    """Rows met one by one, with the queue of free candidates."""
    return f"""WITH RECURSIVE {rows},
n AS MATERIALIZED (SELECT *, row_number() OVER (PARTITION BY {key} ORDER BY ord) AS i FROM r),
s AS (
  SELECT {key}, i, pos, kind, CASE WHEN kind = '{candidate}' THEN [pos] ELSE []::BIGINT[] END AS free, NULL::BIGINT AS match FROM n WHERE i = 1
  UNION ALL SELECT n.{key}, n.i, n.pos, n.kind,
    CASE WHEN n.kind = '{candidate}' THEN list_append(s.free, n.pos) WHEN n.kind = '{item}' THEN s.free[2:] ELSE s.free END,
    CASE WHEN n.kind = '{item}' THEN s.free[1] END
  FROM s JOIN n ON n.{key} = s.{key} AND n.i = s.i + 1)
SELECT {key}, pos AS {at}, match FROM s WHERE kind = '{item}'"""


def oracle_sql() -> dict[str, str]:
    u = f"WITH u AS MATERIALIZED ({USAGE_DUCK})"
    by = "PARTITION BY session_id ORDER BY ts_ms, seq"
    event = "session_id, message_id, ts_ms, model, input, output, cache_read, cache_write"
    rates = "SELECT event_type AS source, CASE WHEN user_id % 2 = 0 THEN 'claude-' ELSE 'm-' END || user_id AS key, count(*) AS n, sum(floor(value)::BIGINT)::BIGINT AS v FROM events GROUP BY event_type, user_id"
    return {
        "greedy_match_turns": _match_sql("r AS (SELECT conv_id, turn AS pos, turn AS ord, role AS kind FROM conversations)", "conv_id", "turn", "assistant", "user"),
        "greedy_match_events": _match_sql(f"u AS ({USAGE_DUCK}), r AS (SELECT session_id, seq AS pos, (ts_ms, seq) AS ord, harness AS kind FROM u)", "session_id", "seq", "h_error", "h_click"),
        "merged_attributes": """WITH e AS (SELECT user_id, event_type, CAST(json_extract(props, '$.k') AS BIGINT) AS k, floor(value)::BIGINT AS v FROM events),
a AS (SELECT user_id, event_type, unnest(['k', 'value', 'k' || (k % 3)]) AS name, unnest([k, v, k]) AS x FROM e)
SELECT user_id, event_type, name, max(x) AS largest FROM a GROUP BY ALL""",
        "not_outranked": f"{u}, l AS (SELECT seq, session_id, k, CASE harness WHEN 'h_click' THEN 0 WHEN 'h_view' THEN 1 WHEN 'h_error' THEN 2 END AS lane FROM u) SELECT * FROM l QUALIFY coalesce(lane, 9) = coalesce(min(lane) OVER (PARTITION BY session_id, k), 9)",
        "reconciled_totals": f"""WITH RECURSIVE u AS ({USAGE_DUCK}),
n AS MATERIALIZED (SELECT seq, session_id, row_number() OVER ({by}) AS i, CASE WHEN harness = 'h_view' THEN input * (k % 9) END AS total, CASE WHEN harness = 'h_view' THEN 0 ELSE input END AS inc FROM u),
s AS (
  SELECT session_id, i, seq, CASE WHEN total IS NOT NULL THEN greatest(0, total) END AS remainder, greatest(inc, coalesce(total, 0)) AS held FROM n WHERE i = 1
  UNION ALL SELECT n.session_id, n.i, n.seq, CASE WHEN total IS NOT NULL THEN greatest(0, total - s.held) END, greatest(s.held + inc, coalesce(total, 0)) FROM s JOIN n ON n.session_id = s.session_id AND n.i = s.i + 1)
SELECT seq, session_id, remainder::BIGINT AS remainder FROM s WHERE remainder IS NOT NULL""",
        "committed_and_final": f"""{u}, f AS (SELECT seq, lead(harness) OVER ({by}) = 'h_error' AND harness = 'h_click' AS committed FROM u WHERE harness IN ('h_click', 'h_error')),
w AS (SELECT session_id, arg_max(workspace, (ts_ms, seq)) FILTER (workspace IS NOT NULL) AS workspace FROM u GROUP BY 1)
SELECT u.seq, coalesce(committed, false) AS committed, w.workspace FROM u JOIN w USING (session_id) LEFT JOIN f USING (seq)""",
        "log_columns_claude": f"{u} SELECT {event}, 0::BIGINT AS reasoning, turn, subagent, workspace FROM u",
        "log_columns_pi": f"{u} SELECT {event}, reasoning, turn, false AS subagent, NULL::VARCHAR AS workspace FROM u",
        "log_columns_notes": f"{u} SELECT '/logs/' || session_id || '.jsonl' AS src_path, '/logs/' || session_id || '.jsonl:' || (2 * count(*) + 1) AS location, 'malformed JSON line' AS message FROM u GROUP BY session_id",
        "log_columns_pi_notes": f"{u} SELECT '/logs/' || session_id || '.jsonl' AS src_path, '/logs/' || session_id || '.jsonl:' || (2 * count(*) + 1) AS location, 'malformed usage record' AS message FROM u GROUP BY session_id",
        "catalog_columns_litellm": f"""WITH r AS ({rates}),
t AS (SELECT *, n % 3 = 0 AS low, n % 2 = 0 AS high FROM r)
SELECT source, key, n::DOUBLE AS input, v::DOUBLE AS output,
  CASE WHEN low OR high THEN concat_ws(';', CASE WHEN low THEN '200000:' || n || ':' || v END, CASE WHEN high THEN '256000:' || (2 * n) || ':' || v END) END AS tiers,
  CASE WHEN (low OR high) AND key LIKE 'claude%' THEN 'whole-request' END AS mode FROM t""",
        "sqlite_since_until": f"{u} SELECT session_id, model, count(*) AS events, sum(input)::BIGINT AS input, sum(output)::BIGINT AS output, max(seq) AS last_seq FROM u WHERE ts_ms >= {SINCE} AND ts_ms < {UNTIL} GROUP BY 1, 2",
        "sql_cost_by_model": f"""{u}, {_RATES} SELECT model, source, count(*) AS events, round(sum(CASE WHEN source IS NOT NULL THEN {_cost_sql()} END), 6) AS usd,
  sum(CASE WHEN cache_write_1h IS NOT NULL THEN least(cache_write_1h, cache_write) END)::BIGINT AS hour_writes FROM u LEFT JOIN rates USING (model) GROUP BY ALL""",
        "sql_days_by_project": f"""{u} SELECT strftime(make_timestamp(ts_ms * 1000) AT TIME ZONE 'UTC' AT TIME ZONE 'America/Los_Angeles', '%Y-%m-%d') AS day, regexp_extract(workspace, '[^/]+$') AS project,
  count(*) AS events, count(*) AS kept, max((ts_ms + 1800000) % 3600000) AS latest FROM u GROUP BY ALL""",
        "catalog_columns_openrouter": f"WITH r AS ({rates}) SELECT source, key, n::DOUBLE AS input, v::DOUBLE AS output, NULL::VARCHAR AS tiers, NULL::VARCHAR AS mode FROM r",
    }
