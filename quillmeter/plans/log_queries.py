"""Queries over the driver's tables: session logs of more agents, written as lines and read in columns."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..sources.logs_in_columns import codebuddy_events, commandcode_events, junie_events, openclaw_events, opencodereview_events, qwen_events
from .record_queries import noted, scanned, session_log
from .testdata import USAGE_DUCK, Query


def _t(name: str) -> Column:
    return F.col("tokens")[name]


def _obj(**cells: Column | str) -> Column:
    return F.struct(*[(F.lit(c) if isinstance(c, str) else c).alias(name) for name, c in cells.items()])


def _json(**cells: Column | str) -> Column:
    """A line of JSON; what is null is left out."""
    return F.to_json(_obj(**cells))


def _codebuddy_log(spark: SparkSession, d: str) -> DataFrame:
    """Usage stands with the message or, for even k, with the provider's data; inputs hold what was read from the cache."""
    used = _obj(input_tokens=_t("input") + _t("cache_read"), output_tokens=_t("output"), cache_read_input_tokens=_t("cache_read"), cache_creation_input_tokens=_t("cache_write"))
    even, bare = F.col("k") % 2 == 0, _obj(id=F.col("message_id"), role="assistant")
    whole = _obj(id=F.col("message_id"), role="assistant", model=F.col("model"), usage=used)
    rest = dict(type=F.when(F.col("k") % 3 == 0, "function_call").otherwise("assistant"), sessionId=F.col("session_id"), timestamp=F.col("ts_ms"), isSidechain=F.col("subagent"), cwd=F.col("workspace"))
    raw = _obj(prompt_tokens=_t("input"))
    entry = F.when(even, _json(**rest, message=bare, providerData=_obj(model=F.col("model"), usage=used, rawUsage=raw))).otherwise(_json(**rest, message=whole, providerData=_obj(rawUsage=raw)))
    tool = '{"type":"user","message":{"role":"user","content":[{"type":"tool_result"}]}}'
    return session_log(spark, d, entry, F.when(F.col("turn"), '{"type":"user","message":{"role":"user","content":"go on"}}').otherwise(tool), "{broken")


def _commandcode_log(spark: SparkSession, d: str) -> DataFrame:
    """Before an event stands a first record of it, with less output, or for other k the session's folder."""

    def record(output: Column) -> Column:
        used = _obj(inputTokens=_t("input") + _t("cache_read"), outputTokens=output, cacheReadTokens=_t("cache_read"), cacheWriteTokens=_t("cache_write"))
        return _json(id=F.col("message_id"), sessionId=F.col("session_id"), timestamp=F.col("ts_ms"), model=F.col("model"), usage=used)

    folder = _json(type="session", cwd=F.concat(F.lit("/p//"), F.col("k").cast("string"), F.lit("/")))
    return session_log(spark, d, record(_t("output")), F.when(F.col("k") % 3 == 0, record(F.lit(0))).otherwise(folder), '{"usage":{},"id":"x"}')


def _qwen_log(spark: SparkSession, d: str) -> DataFrame:
    used = _obj(promptTokenCount=_t("input"), candidatesTokenCount=_t("output"), cachedContentTokenCount=_t("cache_read"), thoughtsTokenCount=_t("reasoning"))
    entry = _json(type="assistant", uuid=F.col("message_id"), sessionId=F.col("session_id"), timestamp=F.col("ts_ms"), model=F.col("model"), cwd=F.col("workspace"), usageMetadata=used)
    return session_log(spark, d, entry, F.when(F.col("turn"), _json(type="user", sessionId=F.col("session_id"))), '{"type":"assistant","usageMetadata":{"promptTokenCount":-1}}')


def _openclaw_log(spark: SparkSession, d: str) -> DataFrame:
    """Models are named by clicks alone; for even k the output is what the total leaves."""
    total = _t("input") + _t("output") + _t("cache_read") + _t("cache_write")
    used = _obj(input=_t("input"), output=F.when(F.col("k") % 2 == 1, _t("output")).otherwise(F.lit(0)), cacheRead=_t("cache_read"), cacheWrite=_t("cache_write"), totalTokens=total)
    entry = _json(type="message", id=F.col("message_id"), message=_obj(role="assistant", timestamp=F.col("ts_ms"), usage=used))
    return session_log(spark, d, entry, F.when(F.col("turn"), _json(type="model_change", modelId=F.col("model"), provider="prov")), "{broken")


def _opencodereview_log(spark: SparkSession, d: str) -> DataFrame:
    """Each click starts a session of its own; responses of even k name no model."""
    start = _json(type="session_start", sessionId=F.concat("session_id", F.lit("-"), F.col("seq").cast("string")), model=F.col("model"), cwd=F.col("workspace"))
    used = _obj(prompt_tokens=_t("input"), completion_tokens=_t("output"), cache_read_tokens=_t("cache_read"), cache_write_tokens=_t("cache_write"))
    entry = _json(type="llm_response", uuid=F.col("message_id"), timestamp=F.col("ts_ms"), model=F.when(F.col("k") % 2 == 1, F.col("model")), usage=used)
    return session_log(spark, d, entry, F.when(F.col("turn"), start), '{"type":"session_end","usage":{"prompt_tokens":9}}')


def _junie_log(spark: SparkSession, d: str) -> DataFrame:
    """Every event is reported twice in its line."""
    used = _obj(model=F.col("model"), inputTokens=_t("input"), outputTokens=_t("output"), cacheInputTokens=_t("cache_read"), cacheCreateTokens=_t("cache_write"), reasoningTokens=_t("reasoning"))
    entry = _json(kind="AgentEvent", timestampMs=F.col("ts_ms"), event=_obj(agentEvent=_obj(modelUsage=F.array(used, used))))
    lines = session_log(spark, d, entry, F.when(F.col("turn"), '{"kind":"UserPromptEvent"}'), "{broken")
    return lines.withColumn("src_path", F.regexp_replace("src_path", r"\.jsonl$", "/events.jsonl"))


def queries() -> dict[str, Query]:
    return {
        "log_columns_codebuddy": scanned(_codebuddy_log, codebuddy_events),
        "log_columns_commandcode": scanned(_commandcode_log, commandcode_events),
        "log_columns_commandcode_notes": noted(_commandcode_log, commandcode_events),
        "log_columns_qwen": scanned(_qwen_log, qwen_events),
        "log_columns_openclaw": scanned(_openclaw_log, openclaw_events),
        "log_columns_openclaw_notes": noted(_openclaw_log, openclaw_events),
        "log_columns_opencodereview": scanned(_opencodereview_log, opencodereview_events),
        "log_columns_junie": scanned(_junie_log, junie_events),
    }


def oracle_sql() -> dict[str, str]:
    u = f"WITH u AS MATERIALIZED ({USAGE_DUCK})"
    by = "PARTITION BY session_id ORDER BY seq"
    event = "session_id, message_id, ts_ms, model, input, output, cache_read"
    # a turn stays open over events that are not counted
    opened = "g AS (SELECT *, count(*) FILTER (counted) OVER (PARTITION BY session_id ORDER BY seq ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS before FROM f), t AS (SELECT * REPLACE (bool_or(turn) OVER (PARTITION BY session_id, before) AS turn) FROM g)"
    named = f"c AS (SELECT *, last_value(CASE WHEN turn THEN model END IGNORE NULLS) OVER ({by}) AS named, row_number() OVER ({by}) AS n, count(*) OVER (PARTITION BY session_id) AS most FROM u)"
    return {
        "log_columns_codebuddy": f"{u} SELECT {event}, cache_write, 0::BIGINT AS reasoning, turn, subagent, workspace FROM u",
        "log_columns_commandcode": f"{u} SELECT {event}, cache_write, 0::BIGINT AS reasoning, true AS turn, false AS subagent, last_value(CASE WHEN k % 3 <> 0 THEN '/p/' || k END IGNORE NULLS) OVER ({by}) AS workspace FROM u",
        "log_columns_commandcode_notes": f"{u} SELECT '/logs/' || session_id || '.jsonl' AS src_path, '/logs/' || session_id || '.jsonl:' || (2 * count(*) + 1) AS location, 'malformed usage record' AS message FROM u GROUP BY session_id",
        "log_columns_qwen": f"{u}, f AS (SELECT *, input + output + cache_read + reasoning > 0 AS counted FROM u), {opened} SELECT {event}, 0::BIGINT AS cache_write, reasoning, turn, false AS subagent, workspace FROM t WHERE counted",
        "log_columns_openclaw": f"{u}, {named} SELECT session_id, message_id, ts_ms, CASE WHEN contains(named, '/') THEN named ELSE 'prov/' || named END AS model, input, output, cache_read, cache_write, 0::BIGINT AS reasoning, true AS turn, false AS subagent, NULL::VARCHAR AS workspace FROM c WHERE named IS NOT NULL AND input + output + cache_read + cache_write > 0",
        "log_columns_openclaw_notes": f"""{u}, {named}, l AS (SELECT session_id, 2 * n AS line, 'malformed usage record' AS message FROM c WHERE named IS NULL UNION ALL SELECT session_id, 2 * max(most) + 1, 'malformed JSON line' FROM c GROUP BY 1)
SELECT '/logs/' || session_id || '.jsonl' AS src_path, '/logs/' || session_id || '.jsonl:' || line AS location, message FROM l""",
        "log_columns_opencodereview": f"""{u}, h AS (SELECT *, max(CASE WHEN turn THEN seq END) OVER ({by}) AS head FROM u)
SELECT coalesce(s.session_id || '-' || s.seq, h.session_id) AS session_id, h.message_id, h.ts_ms, CASE WHEN h.k % 2 = 1 THEN h.model ELSE s.model END AS model, h.input, h.output, h.cache_read, h.cache_write, 0::BIGINT AS reasoning, true AS turn, false AS subagent, s.workspace
FROM h LEFT JOIN u s ON s.seq = h.head WHERE h.k % 2 = 1 OR s.model IS NOT NULL""",
        "log_columns_junie": f"""{u}, r AS (SELECT *, row_number() OVER ({by}) AS n, row_number() OVER (PARTITION BY session_id, ts_ms, model, input, output, cache_read, cache_write, reasoning ORDER BY seq) AS nth FROM u),
f AS (SELECT *, nth = 1 AND input + output + cache_read + cache_write + reasoning > 0 AS counted FROM r), {opened}
SELECT session_id, '/logs/' || session_id || '/events.jsonl:' || (2 * n - 1) || ':0' AS message_id, ts_ms, model, input, output, cache_read, cache_write, reasoning, turn, false AS subagent, NULL::VARCHAR AS workspace FROM t WHERE counted""",
    }
