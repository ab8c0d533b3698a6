"""JSON-lines session logs as columns: no Python touches a line.

A log is read as text and split to lines; each line becomes a VARIANT whose own
types gate every cell.  What a line means depends on lines before it (whose turn
it is, which session, how deep), which are windows over a log's lines.  Events and
skips come as the rows that the other readers' parsers give.
"""

from __future__ import annotations

from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.cells import BLANKS, at, counter_of, given, is_object, kind, number_of, optional_of, stamp, stamp_cells, string_of, text_of, true_of
from ..functions.instants import MAX_MS, iso
from ..functions.paths import basename, normalize_workspace, parent, stem
from ..operators.windows import carried, first_wins, last_wins, pending
from .kit import File

#: Files up to which their list is broadcast
LISTED = 200_000
#: Tasks that look at the files of a list
LISTING_TASKS = 64
_PLACE = ["lane", "root_ord", "src_path", "src_ord"]
_BY, _ORDER = ["lane", "root_ord", "src_path"], ["src_ord"]
_COUNTERS = ["input", "output", "cache_read", "cache_write", "reasoning"]


def plain_path(path: Column) -> Column:
    """A file's path as the driver lists it, from Spark's URL."""
    return F.regexp_replace(F.url_decode(F.replace(path, F.lit("+"), F.lit("%2B"))), "^file:(//(?=/))?", "")


@contextmanager
def few_listing_tasks(spark: SparkSession) -> Iterator[None]:
    """While files are named to Spark, it looks at them in some tasks, not in one for each path."""
    name = "spark.sql.sources.parallelPartitionDiscovery.parallelism"
    before = spark.conf.get(name)
    spark.conf.set(name, str(min(int(before), LISTING_TASKS)))
    try:
        yield
    finally:
        spark.conf.set(name, before)


def log_lines(spark: SparkSession, files: list[File]) -> DataFrame:
    """(lane, root_ord, src_path, src_ord, text): the lines of some logs that are not blank, numbered from zero.

    Bytes that are no UTF-8 become U+FFFD.  A log is one row of the scan, its lines are many.
    """
    listed = spark.createDataFrame([(f.path, f.root, f.lane) for f in files], "src_path string, root_ord int, lane int")
    with few_listing_tasks(spark):
        read = spark.read.text([f.path for f in files], wholetext=True)
    logs = read.select(plain_path(F.col("_metadata.file_path")).alias("src_path"), F.make_valid_utf8("value").alias("log"))
    return split_logs(logs.join(F.broadcast(listed) if len(files) <= LISTED else listed, "src_path"))


def split_logs(logs: DataFrame) -> DataFrame:
    """The lines of (lane, root_ord, src_path, log), as ``log_lines`` gives them."""
    lines = logs.select("lane", "root_ord", "src_path", F.posexplode(F.split("log", "\n")).alias("src_ord", "text"))
    return lines.select("lane", "root_ord", "src_path", F.col("src_ord").cast("bigint").alias("src_ord"), "text").where(F.col("text").rlike(r"\S"))


def opened(lines: DataFrame) -> DataFrame:
    """Lines with ``row``, their VARIANT, null where a line is no JSON."""
    parsed = F.try_parse_json(F.btrim("text", F.lit(BLANKS)))
    # generated, not projected: conditions on cells would otherwise parse the line once for each cell
    return lines.select(*_PLACE, F.explode(F.array(parsed)).alias("row"))


def celled(rows: DataFrame, **paths: str) -> DataFrame:
    """The cells at some paths of ``row`` as variants, each taken out once.

    A stack of one row: what reads the cells is then compiled apart from what takes them out, and stays small enough to be.
    """
    return rows.select(*_PLACE, F.stack(F.lit(1), *[at(F.col("row"), p) for p in paths.values()]).alias(*paths))


def _stamps(**cells: Column) -> list[Column]:
    """The parts of stamps, which become instants only after the windows, where each is one column."""
    return [c.alias(f"{name}_{part}") for name, cell in cells.items() for part, c in zip(("text", "number"), stamp_cells(cell))]


def _first_stamp(*stamps: tuple[Column, Column]) -> Column:
    """The instant of the first stamp that is one.  A lambda's body is no generated code, of which parsing several stamps gives too much to compile."""
    held = F.array(*[F.struct(text.alias("text"), number.alias("number")) for text, number in stamps])
    return F.get(F.filter(F.transform(held, lambda x: stamp(x["text"], x["number"])), lambda t: t.isNotNull()), 0)


def _stamped(df: DataFrame, *names: str) -> DataFrame:
    """``df`` and timestamp: the first of the stamps that is one.  Generated, so that no condition on it repeats the parsing."""
    return df.select("*", F.stack(F.lit(1), _first_stamp(*[(F.col(f"{n}_text"), F.col(f"{n}_number")) for n in names])).alias("timestamp"))


def _counted(df: DataFrame, usage: str, **paths: str) -> DataFrame:
    """``df`` and the cells at some paths of its variant ``usage``, each taken out once."""
    return df.select("*", F.stack(F.lit(1), *[at(F.col(usage), p) for p in paths.values()]).alias(*paths))


def _line() -> Column:
    """What a record without an id is called: its file and line."""
    return F.concat("src_path", F.lit(":"), F.col("src_ord").cast("string"))


def _total() -> Column:
    return sum((F.col(n) for n in _COUNTERS[1:]), F.col(_COUNTERS[0]))


def _uses(idle: bool) -> Column:
    """A record of some tokens; with ``idle`` also one of none."""
    return _total() >= 0 if idle else _total() > 0


def _token_key(*names: str) -> Column:
    return F.to_json(F.struct(*names, *_COUNTERS))


def _skips(rows: DataFrame, message: str) -> DataFrame:
    location = F.concat("src_path", F.lit(":"), (F.col("src_ord") + 1).cast("string"))
    return rows.select(F.lit("skip").alias("kind"), F.lit(message).alias("message"), location.alias("location"), *_PLACE)


def _found(lines: DataFrame, records: DataFrame, required: list[str]) -> DataFrame:
    """Events of complete records; skips of the others and of lines that are no JSON."""
    whole = F.lit(True)
    for name in required:
        whole = whole & F.col(name).isNotNull()
    none = lambda t: F.lit(None).cast(t)
    events = records.where(whole).select(F.lit("event").alias("kind"), none("string").alias("message"), none("string").alias("location"), *_PLACE, *[c for c in records.columns if c not in _PLACE])
    broken = lines.where(~given(F.col("row")))
    skips = _skips(records.where(~whole), "malformed usage record").unionByName(_skips(broken, "malformed JSON line"))
    return events.unionByName(skips, allowMissingColumns=True)


def _event(**own: Column | str) -> list[Column]:
    """The cells of an event, in the order of the parsers' rows."""
    null = {"calls": "bigint", "cost_usd": "double", "workspace": "string", "title": "string", "cache_write_1h": "bigint"}
    cells = {"session_id": None, "message_id": None, "timestamp": None, "model": None, **dict.fromkeys(_COUNTERS), "cache_write_1h": None, "turn": None, "subagent": None, "calls": None, "cost_usd": None, "workspace": None, "title": None, "key": None}
    made = {name: own.get(name, F.lit(None).cast(null[name]) if name in null else F.col(name)) for name in cells}
    return [(F.col(c) if isinstance(c, str) else c).alias(name) for name, c in made.items()] + [F.lit(0.0).alias("rank")]


def claude_events(lines: DataFrame, buddy: bool = False) -> DataFrame:
    """Rows of the claude reader.  A turn is an assistant's first message after a user's own words.

    With ``buddy`` rows of the codebuddy reader: usage and model may stand with the provider's data,
    other types of lines report them too, and a call without usage leaves the turn open.
    The provider's usage is passed over if it is null or {}.
    """
    rows, c = opened(lines), F.col
    cells = celled(
        rows, c_type="$.type", c_role="$.role", c_message="$.message", c_message_role="$.message.role", c_content="$.content", c_message_content="$.message.content", c_usage="$.message.usage", c_model="$.message.model", c_at="$.timestamp",
        c_id="$.message.id", c_request="$.requestId", c_uuid="$.uuid", c_own="$.id", c_session="$.sessionId", c_side="$.isSidechain", c_cost="$.costUSD", c_cwd="$.cwd", p_usage="$.providerData.usage", p_model="$.providerData.model",
        p_raw="$.providerData.rawUsage.prompt_tokens", r_usage="$.usage",
    )
    usage, model, raw, types = c("c_usage"), text_of(c("c_model")), F.lit(None).cast("double"), ["assistant"]
    if buddy:
        provided = given(c("p_usage")) & (kind(c("p_usage")) != "OBJECT<>")
        usage = F.when(given(usage), usage).when(provided, c("p_usage")).otherwise(c("r_usage"))
        model = F.when(given(c("c_usage")), model).otherwise(F.coalesce(model, text_of(c("p_model"))))
        raw, types = number_of(c("p_raw")), ["assistant", "function_call", "message"]
    type_ = string_of(c("c_type"))
    role = F.coalesce(*[F.nullif(string_of(c(n)), F.lit("")) for n in ("c_message_role", "c_role", "c_type")])
    content = F.when(given(c("c_message")), c("c_message_content")).otherwise(c("c_content"))
    parts = F.try_variant_get(content, "$", "array<variant>")
    own_words = F.exists(parts, lambda p: F.coalesce(string_of(at(p, "$.type")) != "tool_result", F.lit(True)))
    human = F.when(kind(content).startswith("ARRAY"), F.coalesce(own_words, F.lit(False))).otherwise(F.lit(True))
    user = F.coalesce((type_ == "user") | (role == "user"), F.lit(False))
    said = cells.select(
        *_PLACE, user.alias("user"), (user & human).alias("human"), F.coalesce(type_.isin(types), F.lit(False)).alias("assistant"), F.coalesce(type_ == "function_call", F.lit(False)).alias("call"), usage.alias("usage"), model.alias("model"), raw.alias("raw"),
        *_stamps(own=c("c_at")), F.coalesce(*[text_of(c(n)) for n in ("c_id", "c_request", "c_uuid", "c_own")]).alias("own_id"), text_of(c("c_session")).alias("own_session"), true_of(c("c_side")).alias("subagent"),
        number_of(c("c_cost")).alias("cost_usd"), string_of(c("c_cwd")).alias("cwd"),
    ).where("user or assistant")
    counted = _counted(said, "usage", c_input="$.input_tokens", c_output="$.output_tokens", c_read="$.cache_read_input_tokens", c_write="$.cache_creation_input_tokens", c_hour="$.cache_creation.ephemeral_1h_input_tokens")
    fresh, read = counter_of(c("c_input")), optional_of(c("c_read"))
    numbers = counted.withColumns({
        "used": given(c("usage")), "input": F.when(c("raw").isNull(), fresh).otherwise(F.when(fresh.isNotNull() & read.isNotNull(), F.greatest(fresh - read, F.lit(0)))), "output": counter_of(c("c_output")), "cache_read": read,
        "cache_write": optional_of(c("c_write")), "reasoning": F.lit(0).cast("bigint"), "cache_write_1h": counter_of(c("c_hour")),
    }).drop("usage", "c_input", "c_output", "c_read", "c_write", "c_hour", "raw")
    consumes = ~F.col("human") & ~(F.col("call") & ~F.col("used") & ~F.col("user"))
    flagged = numbers.withColumn("turn", pending(F.col("human"), consumes, _BY, _ORDER))
    billed = flagged.where("not user and assistant and used and coalesce(model, '') <> '<synthetic>'")
    ident = F.coalesce("own_id", _line())
    named = _stamped(billed, "own").withColumns({"workspace": normalize_workspace(F.col("cwd")), "message_id": ident, "session_id": F.coalesce("own_session", stem(F.col("src_path")))})
    records = named.select(*_PLACE, *_event(key="message_id", cost_usd="cost_usd", workspace="workspace", cache_write_1h="cache_write_1h"))
    return _found(rows, records, ["model", "timestamp", "input", "output", "cache_read", "cache_write"])


def codebuddy_events(lines: DataFrame) -> DataFrame:
    return claude_events(lines, buddy=True)


def pi_events(lines: DataFrame) -> DataFrame:
    """Rows of the readers of the pi family: the session's name and depth come from its header lines."""
    rows, c = opened(lines), F.col
    cells = celled(
        rows, c_type="$.type", c_id="$.id", c_depth="$.rlmDepth", c_message="$.message", c_role="$.message.role", c_model="$.message.model", c_usage="$.message.usage", c_at="$.timestamp", c_message_at="$.message.timestamp", c_input="$.message.usage.input",
        c_output="$.message.usage.output", c_read="$.message.usage.cacheRead", c_write="$.message.usage.cacheWrite", c_reasoning="$.message.usage.reasoning", c_hour="$.message.usage.cacheWrite1h",
    )
    type_, role, hour = string_of(c("c_type")), string_of(c("c_role")), c("c_hour")
    header = F.coalesce(type_ == "session", F.lit(False))
    talk = F.coalesce((type_ == "message") & is_object(c("c_message")), F.lit(False))
    said = cells.select(
        *_PLACE, F.when(header, text_of(c("c_id"))).alias("named"), F.when(header, F.coalesce(number_of(c("c_depth")), F.lit(0.0))).alias("deep"), header.alias("header"),
        (talk & F.coalesce(role == "user", F.lit(False))).alias("user"), (talk & F.coalesce(role == "assistant", F.lit(False))).alias("assistant"), given(c("c_usage")).alias("used"), text_of(c("c_id")).alias("message_id"),
        text_of(c("c_model")).alias("model"), *_stamps(own=c("c_at"), message=c("c_message_at")), counter_of(c("c_input")).alias("input"), counter_of(c("c_output")).alias("all_output"), counter_of(c("c_read")).alias("cache_read"),
        counter_of(c("c_write")).alias("cache_write"), optional_of(c("c_reasoning")).alias("reasoning"), F.when(given(hour), counter_of(hour)).alias("cache_write_1h"), (given(hour) & counter_of(hour).isNull()).alias("bad_hour"),
    ).where("header or user or assistant")
    flagged = said.withColumns({
        "turn": pending(F.col("user"), F.col("assistant"), _BY, _ORDER),
        "session_id": F.coalesce(carried("named", _BY, _ORDER), stem(F.col("src_path"))),
        "subagent": F.coalesce(carried("deep", _BY, _ORDER), F.lit(0.0)) > 0,
    })
    billed = _stamped(flagged.where("assistant and used"), "own", "message").withColumns({"output": F.greatest(F.col("all_output") - F.col("reasoning"), F.lit(0)), "sound": F.when(~F.col("bad_hour"), F.lit(True))})
    key = F.to_json(F.struct("session_id", "message_id", "model", *_COUNTERS, "cache_write_1h"))
    records = billed.select(*_PLACE, "sound", *_event(key=key, cache_write_1h="cache_write_1h"))
    return _found(rows, records, ["message_id", "model", "timestamp", "input", "output", "cache_read", "cache_write", "reasoning", "sound"]).drop("sound")


def opencodereview_events(lines: DataFrame) -> DataFrame:
    """Rows of the opencodereview reader: what a response lacks stands in the last session_start before it."""
    rows, c = opened(lines), F.col
    cells = celled(
        rows, c_type="$.type", c_at="$.timestamp", c_model="$.model", c_session="$.sessionId", c_session_id="$.session_id", c_cwd="$.cwd", c_uuid="$.uuid", c_usage="$.usage", c_input="$.usage.prompt_tokens", c_output="$.usage.completion_tokens",
        c_read="$.usage.cache_read_tokens", c_write="$.usage.cache_write_tokens",
    )
    type_ = string_of(c("c_type"))
    said = cells.select(
        *_PLACE, F.coalesce(type_ == "session_start", F.lit(False)).alias("start"), F.coalesce((type_ == "llm_response") & given(c("c_usage")), F.lit(False)).alias("billed"), *_stamps(own=c("c_at")), text_of(c("c_model")).alias("own_model"),
        F.coalesce(text_of(c("c_session")), text_of(c("c_session_id"))).alias("session"), string_of(c("c_cwd")).alias("cwd"), F.coalesce(text_of(c("c_uuid")), _line()).alias("message_id"), counter_of(c("c_input")).alias("input"),
        counter_of(c("c_output")).alias("output"), optional_of(c("c_read")).alias("cache_read"), optional_of(c("c_write")).alias("cache_write"), F.lit(0).cast("bigint").alias("reasoning"), F.lit(True).alias("turn"), F.lit(False).alias("subagent"),
    ).where("start or billed")
    head = F.when(F.col("start"), F.struct("own_text", "own_number", F.col("own_model").alias("model"), "session", "cwd"))
    led = said.withColumn("head", head).withColumn("head", carried("head", _BY, _ORDER)).where("billed")
    whole = led.withColumns({
        "head_text": c("head.own_text"), "head_number": c("head.own_number"), "model": F.coalesce("own_model", "head.model"), "session_id": F.coalesce("head.session", stem(F.col("src_path"))), "workspace": normalize_workspace(c("head.cwd")),
    })
    records = _stamped(whole, "own", "head").select(*_PLACE, *_event(key=F.lit(None).cast("string"), workspace="workspace"))
    return _found(rows, records, ["model", "timestamp", "input", "output", "cache_read", "cache_write"])


def commandcode_events(lines: DataFrame) -> DataFrame:
    """Rows of the commandcode reader: a message's last record counts, in the place of its first; workspaces come from session lines."""
    rows, c = opened(lines), F.col
    cells = celled(
        rows, c_type="$.type", c_cwd="$.cwd", c_usage="$.usage", c_at="$.timestamp", c_id="$.id", c_session="$.sessionId", c_model="$.model", c_input="$.usage.inputTokens", c_output="$.usage.outputTokens", c_read="$.usage.cacheReadTokens",
        c_write="$.usage.cacheWriteTokens",
    )
    session = F.coalesce(string_of(c("c_type")) == "session", F.lit(False))
    said = cells.select(
        *_PLACE, F.when(session, normalize_workspace(string_of(c("c_cwd")))).alias("where_now"), session.alias("session"), is_object(c("c_usage")).alias("used"), *_stamps(own=c("c_at")), F.coalesce(text_of(c("c_id")), _line()).alias("message_id"),
        F.coalesce(text_of(c("c_session")), stem(c("src_path"))).alias("session_id"), F.coalesce(text_of(c("c_model")), F.lit("commandcode-unknown")).alias("model"), counter_of(c("c_input")).alias("all_input"), counter_of(c("c_output")).alias("output"),
        optional_of(c("c_read")).alias("cache_read"), optional_of(c("c_write")).alias("cache_write"), F.lit(0).cast("bigint").alias("reasoning"), F.lit(True).alias("turn"), F.lit(False).alias("subagent"),
    ).where("session or used")
    placed = said.withColumn("workspace", carried("where_now", _BY, _ORDER)).where("used").withColumn("input", F.when(c("all_input").isNotNull() & c("cache_read").isNotNull(), F.greatest(c("all_input") - c("cache_read"), F.lit(0))))
    records = _stamped(placed, "own").select(*_PLACE, *_event(key=F.lit(None).cast("string"), workspace="workspace"))
    found = _found(rows, records, ["timestamp", "input", "output", "cache_read", "cache_write"])
    events = last_wins(found.where("kind = 'event'"), [*_BY, "message_id"], _ORDER).withColumn("src_ord", c("position.src_ord")).drop("position")
    return events.unionByName(found.where("kind <> 'event'"))


def qwen_events(lines: DataFrame, idle: bool = False) -> DataFrame:
    """Rows of the qwen reader.  A user's prompt may stand in another file of the session, in the same folder."""
    rows, c = opened(lines), F.col
    cells = celled(
        rows, c_type="$.type", c_session="$.sessionId", c_usage="$.usageMetadata", c_at="$.timestamp", c_model="$.model", c_uuid="$.uuid", c_cwd="$.cwd", c_input="$.usageMetadata.promptTokenCount", c_output="$.usageMetadata.candidatesTokenCount",
        c_read="$.usageMetadata.cachedContentTokenCount", c_thoughts="$.usageMetadata.thoughtsTokenCount",
    )
    type_, folder = string_of(c("c_type")), parent(c("src_path"))
    own = F.concat(basename(parent(folder)), F.lit("-"), stem(c("src_path")))
    said = cells.select(
        *_PLACE, F.coalesce(type_ == "user", F.lit(False)).alias("user"), (F.coalesce(type_ == "assistant", F.lit(False)) & is_object(c("c_usage"))).alias("billed"), F.coalesce(text_of(c("c_session")), own).alias("session_id"), folder.alias("folder"),
        *_stamps(own=c("c_at")), F.coalesce(text_of(c("c_model")), F.lit("unknown")).alias("model"), F.coalesce(text_of(c("c_uuid")), _line()).alias("message_id"), normalize_workspace(string_of(c("c_cwd"))).alias("workspace"),
        optional_of(c("c_input")).alias("input"), optional_of(c("c_output")).alias("output"), optional_of(c("c_read")).alias("cache_read"), F.lit(0).cast("bigint").alias("cache_write"), optional_of(c("c_thoughts")).alias("reasoning"),
        F.lit(False).alias("subagent"),
    ).where("user or billed")
    dated = _stamped(said, "own")
    counts = F.coalesce(c("timestamp").isNotNull() & _uses(idle), F.lit(False))
    flagged = dated.withColumn("turn", pending(c("user"), c("billed") & counts, ["lane", "root_ord", "folder", "session_id"], ["src_path", "src_ord"]))
    records = flagged.where("billed").where(F.coalesce(_uses(idle), F.lit(True))).select(*_PLACE, *_event(key=F.lit(None).cast("string"), workspace="workspace"))
    return _found(rows, records, ["timestamp", "input", "output", "cache_read", "reasoning"])


def openclaw_events(lines: DataFrame, idle: bool = False) -> DataFrame:
    """Rows of the openclaw reader: session, folder, model and provider hold until a later line names others; a folder that is no string names none."""
    rows, c = opened(lines), F.col
    cells = celled(
        rows, c_type="$.type", c_custom="$.customType", c_id="$.id", c_cwd="$.cwd", c_data="$.data", d_model="$.data.modelId", d_provider="$.data.provider", r_model="$.modelId", r_provider="$.provider", c_role="$.message.role", c_usage="$.message.usage",
        m_model="$.message.model", m_provider="$.message.provider", m_at="$.message.timestamp", c_at="$.timestamp", c_input="$.message.usage.input", c_output="$.message.usage.output", c_read="$.message.usage.cacheRead",
        c_write="$.message.usage.cacheWrite", c_all="$.message.usage.totalTokens",
    )
    type_, nested = string_of(c("c_type")), is_object(c("c_data"))
    session = F.coalesce(type_ == "session", F.lit(False))
    change = F.coalesce(type_.isin("model_change", "model-snapshot"), F.lit(False)) | F.coalesce(string_of(c("c_custom")) == "model-snapshot", F.lit(False))
    billed = F.coalesce((type_ == "message") & (string_of(c("c_role")) == "assistant"), F.lit(False)) & is_object(c("c_usage"))
    said = cells.select(
        *_PLACE, session.alias("session"), change.alias("change"), billed.alias("billed"), F.when(session, text_of(c("c_id"))).alias("named"), F.when(session, F.nullif(string_of(c("c_cwd")), F.lit(""))).alias("cwd"),
        F.when(change, text_of(F.when(nested, c("d_model")).otherwise(c("r_model")))).alias("set_model"), F.when(change, text_of(F.when(nested, c("d_provider")).otherwise(c("r_provider")))).alias("set_provider"),
        text_of(c("m_model")).alias("own_model"), text_of(c("m_provider")).alias("own_provider"), *_stamps(message=c("m_at"), own=c("c_at")), F.coalesce(text_of(c("c_id")), _line()).alias("message_id"),
        *[optional_of(c(f"c_{n}")).alias(n) for n in ("input", "read", "write", "all")], optional_of(c("c_output")).alias("own_output"), F.lit(0).cast("bigint").alias("reasoning"), F.lit(True).alias("turn"), F.lit(False).alias("subagent"),
    ).where("session or change or billed")
    state = {n: carried(n, _BY, _ORDER) for n in ("named", "cwd", "set_model", "set_provider")}
    led = said.withColumns(state).where("billed")
    model, by, rest = F.coalesce("own_model", "set_model"), F.coalesce("own_provider", "set_provider"), c("all") - c("input") - c("read") - c("write")
    whole = _stamped(led, "message", "own").withColumns({
        "model": F.when(F.contains(model, F.lit("/")) | by.isNull(), model).otherwise(F.concat(by, F.lit("/"), model)), "session_id": F.coalesce("named", F.regexp_replace(basename(c("src_path")), r"\.jsonl(\..*)?$", "")), "workspace": normalize_workspace(c("cwd")),
        "cache_read": c("read"), "cache_write": c("write"), "output": F.when((c("own_output") == 0) & (rest > 0), rest).when(rest.isNotNull(), c("own_output")),
    })
    records = whole.where(F.coalesce(_uses(idle), F.lit(True)) | c("model").isNull() | c("timestamp").isNull()).select(*_PLACE, *_event(key=_token_key("session_id", "timestamp", "model"), workspace="workspace"))
    return _found(rows, records, ["model", "timestamp", "input", "output", "cache_read", "cache_write"])


def _lenient(*cells: Column) -> Column:
    """A counter from the first cell that is a number; below zero, or without one, zero."""
    return F.coalesce(*[F.when(number_of(x).isNotNull(), F.coalesce(counter_of(x), F.lit(0).cast("bigint"))) for x in cells], F.lit(0).cast("bigint"))


def junie_events(lines: DataFrame, idle: bool = False) -> DataFrame:
    """Rows of the junie reader: a line reports several models; what a log says again counts once, and its first report takes the turn."""
    rows, c = opened(lines), F.col
    cells = celled(rows, c_kind="$.kind", c_used="$.event.agentEvent.modelUsage", c_ms="$.timestampMs", c_at="$.timestamp")
    prompt = F.coalesce(string_of(c("c_kind")) == "UserPromptEvent", F.lit(False))
    used = F.coalesce(F.try_variant_get(c("c_used"), "$", "array<variant>"), F.array().cast("array<variant>"))
    # a prompt comes before what its own line reports
    reports = F.transform(used, lambda u, j: F.struct(j.alias("j"), u.alias("report")))
    opener = F.when(prompt, F.array(F.struct(F.lit(-1).alias("j"), F.lit(None).cast("variant").alias("report")))).otherwise(F.array().cast("array<struct<j:int,report:variant>>"))
    each = cells.select(*_PLACE, *_stamps(ms=c("c_ms"), own=c("c_at")), F.inline(F.concat(opener, reports)))
    counted = _counted(
        each, "report", c_model="$.model", i1="$.inputTokens", i2="$.input_tokens", o1="$.outputTokens", o2="$.output_tokens", r1="$.cacheInputTokens", r2="$.cacheReadTokens", w1="$.cacheCreateTokens", w2="$.cacheWriteTokens", z1="$.reasoningTokens"
    )
    numbered = counted.select(
        *_PLACE, "j", "ms_number", "own_text", "own_number", text_of(c("c_model")).alias("model"), _lenient(c("i1"), c("i2")).alias("input"), _lenient(c("o1"), c("o2")).alias("output"), _lenient(c("r1"), c("r2")).alias("cache_read"),
        _lenient(c("w1"), c("w2")).alias("cache_write"), _lenient(c("z1")).alias("reasoning"),
    )
    ms = F.when((c("ms_number") > 0) & (c("ms_number") <= MAX_MS), c("ms_number").cast("bigint"))
    when = F.stack(F.lit(1), F.coalesce(iso(ms), _first_stamp((c("own_text"), c("own_number"))))).alias("timestamp")
    named = numbered.select("*", when).withColumns({
        "session_id": basename(parent(c("src_path"))), "message_id": F.concat(_line(), F.lit(":"), c("j").cast("string")), "subagent": F.lit(False), "cache_write_1h": F.lit(None).cast("bigint"), "key": _token_key("src_path", "timestamp", "model"),
    })
    sound = c("model").isNotNull() & c("timestamp").isNotNull()
    bad = named.where((c("j") >= 0) & ~sound)
    once = first_wins(named.where((c("j") >= 0) & sound & _uses(idle)), [*_BY, "key"], ["src_ord", "j"])
    flagged = once.unionByName(named.where("j < 0")).withColumn("turn", pending(c("j") < 0, c("j") >= 0, _BY, ["src_ord", "j"])).where("j >= 0")
    records = flagged.select(*_PLACE, *_event(key=_token_key("session_id", "timestamp", "model")))
    return _found(rows, records, []).unionByName(_skips(bad, "malformed usage record"), allowMissingColumns=True)
