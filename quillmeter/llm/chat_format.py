"""Chat formatting: prefix-target expansion.

Every assistant turn becomes an example of its own: all preceding turns as
context, then the turn, of which only the reply's text is trainable.  Turns
after the last assistant turn (or all, without one) make one more example
without a trainable part, so the output holds every turn.

A turn is ``<|im_start|>role\\ntext<|im_end|>\\n``.  Inside roles and texts a
backslash is doubled and ``<|`` becomes ``<\\|`` (in roles a line feed becomes
``\\n``), so no text can open or close a turn, and unescaping restores it.

An example holds its context by definition, so a conversation of T turns takes
T times its length; what is shuffled is each turn once, and the expansion is
made from one row per conversation after it.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import saved, work_dir

#: Fixed values of the template
OPEN, CLOSE = "<|im_start|>", "<|im_end|>\n"
ASSISTANT = "assistant"


def escape(text: Column) -> Column:
    return F.replace(F.replace(text, F.lit("\\"), F.lit("\\\\")), F.lit("<|"), F.lit("<\\|"))


def escape_role(role: Column) -> Column:
    return F.replace(escape(role), F.lit("\n"), F.lit("\\n"))


def unescape(text: Column) -> Column:
    return F.regexp_replace(text, r"(?s)\\([\\|])", "$1")


def unescape_role(role: Column) -> Column:
    """Undo escape_role: an escaped n is a line feed, any other escape its character."""
    parts = F.regexp_extract_all(role, F.lit(r"(?s)\\.|[^\\]+"), F.lit(0))
    return F.array_join(F.transform(parts, lambda p: F.when(p == "\\n", F.lit("\n")).when(p.startswith("\\"), p.substr(2, 1)).otherwise(p)), "")


def expanded(conversations: DataFrame) -> DataFrame:
    """(conv_id, example, text, loss_start, loss_chars) from (conv_id, turn, role, text) rows.

    Turns are taken by (turn, role, text), null turns first; null roles and
    texts are empty; rows that repeat are turns of their own.  Null conv_ids are
    one conversation.  Offsets count code points; an example without a trainable
    part has loss_chars null.  An empty table has no examples; further columns
    are not read.  A conversation is one row of one task, as its examples are:
    it must fit there, with T turns T times.
    """
    turn = F.struct(F.col("turn"), F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text"))
    whole = conversations.groupBy("conv_id").agg(F.array_sort(F.collect_list(turn)).alias("turns"))
    head = lambda t: F.concat(F.lit(OPEN), escape_role(t["role"]), F.lit("\n"))
    parts = F.transform("turns", lambda t: F.struct(head(t).alias("head"), escape(t["text"]).alias("body"), (t["role"] == ASSISTANT).alias("target")))
    whole = whole.select("conv_id", parts.alias("parts"))
    ends = F.filter(F.sequence(F.lit(1), F.size("parts")), lambda k: F.get(F.col("parts"), k - 1)["target"] | (k == F.size("parts")))
    each = whole.select("conv_id", "parts", F.posexplode(ends).alias("example", "k"))
    context = F.array_join(F.transform(F.slice("parts", F.lit(1), F.col("k") - 1), lambda p: F.concat(p["head"], p["body"], F.lit(CLOSE))), "")
    last = F.get(F.col("parts"), F.col("k") - 1)
    each = each.select("conv_id", "example", context.alias("context"), last.alias("last"))
    text = F.concat("context", "last.head", "last.body", F.lit(CLOSE))
    start = (F.char_length("context") + F.char_length("last.head")).cast("long")
    return each.select("conv_id", "example", text.alias("text"), F.when(F.col("last.target"), start).alias("loss_start"), F.when(F.col("last.target"), F.char_length("last.body").cast("long")).alias("loss_chars"))


def read_back(examples: DataFrame) -> DataFrame:
    """Per conversation, from its examples alone: turns, text under the loss mask, sizes."""
    loss = unescape(F.col("text").substr((F.col("loss_start") + 1).cast("int"), F.col("loss_chars").cast("int")))
    one = examples.select("conv_id", "example", "text", F.when(F.col("loss_chars").isNotNull(), loss).alias("loss"), F.char_length("text").cast("long").alias("chars"))
    whole = one.groupBy("conv_id").agg(F.max_by("text", "example").alias("text"), F.array_sort(F.collect_list(F.when(F.col("loss").isNotNull(), F.struct("example", "loss")))).alias("losses"), F.sum("chars").alias("formatted_chars"))
    raw = F.filter(F.split("text", r"<\|im_start\|>"), lambda s: s != "")
    role = lambda s: unescape_role(F.substring_index(s, "\n", 1))
    body = lambda s: unescape(s.substr(F.char_length(F.substring_index(s, "\n", 1)) + 2, F.char_length(s) - F.char_length(F.substring_index(s, "\n", 1)) - 1 - len(CLOSE)))
    turns = F.array_join(F.transform(raw, lambda s: F.concat(role(s), F.lit("\n"), body(s), F.lit("\n"))), "")
    joined = F.array_join("losses.loss", "")
    return whole.select("conv_id", F.size(raw).cast("long").alias("n_turns"), F.sha2(turns, 256).alias("turns_sha256"), F.char_length(joined).cast("long").alias("loss_chars"), F.sha2(joined, 256).alias("loss_sha256"), "formatted_chars")


def op4_prefix_target(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = spark.read.parquet(f"{sf_dir}/conversations.parquet").select("conv_id", "turn", "role", "text")
    said = "<|im_end|><|im_start|>assistant ok"
    own = spark.range(2).select(F.lit(-1).cast("long").alias("conv_id"), F.col("id").alias("turn"), F.when(F.col("id") == 0, "user").otherwise(ASSISTANT).alias("role"), F.lit(said).alias("text"))
    return read_back(saved(expanded(rows.unionByName(own)), f"{work_dir(spark, 'chat')}/examples"))


OP4_SQL = """
WITH c AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -1, 0, 'user', '<|im_end|><|im_start|>assistant ok' UNION ALL SELECT -1, 1, 'assistant', '<|im_end|><|im_start|>assistant ok'),
t AS (
  SELECT *, row_number() OVER w AS k, count(*) OVER (PARTITION BY conv_id) AS n,
    length('<|im_start|>') + length('<|im_end|>') + 2
      + length(replace(replace(replace(role, '\\', '\\\\'), '<|', '<\\|'), chr(10), '\\n')) + length(replace(replace(text, '\\', '\\\\'), '<|', '<\\|')) AS size
  FROM c WINDOW w AS (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text)),
s AS (SELECT *, sum(size) OVER (PARTITION BY conv_id ORDER BY k) AS upto FROM t)
SELECT conv_id, count(*) AS n_turns, sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY k)) AS turns_sha256,
  coalesce(sum(length(text)) FILTER (role = 'assistant'), 0)::BIGINT AS loss_chars,
  sha256(coalesce(string_agg(text, '' ORDER BY k) FILTER (role = 'assistant'), '')) AS loss_sha256,
  (sum(upto) FILTER (role = 'assistant' OR k = n))::BIGINT AS formatted_chars
FROM s GROUP BY conv_id
"""
