"""Benchmark decontamination: a prefix-filtered join of item windows with documents.

Every window of an item (10 consecutive words; a shorter item is one window) is
a set of shingles of up to three words.  A document that holds the window holds
all of its shingles, so for containment one is a sufficient prefix: the rarest
in the corpus.  The first pass counts the windows' shingles over all documents,
the second joins each window on its rarest shingle alone.  A hit at position p
of a shingle with offset o can only be an occurrence at p - o (positional bound)
that ends within the document (length bound); it is verified word for word.

Both passes are one scan each: split, explode, hash, look up, verify, all in
generated code.  The index holds the benchmark alone; it is broadcast if its
counted rows allow.  Else positions meet it by a shuffle of (key, document,
position), without texts, and each document with a candidate then sends its words
once to where its candidates are verified.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import held_rows, saved, sized, work_dir

WINDOW_WORDS, SHINGLE_WORDS = 10, 3
INDEX_ROWS = 200_000
HIT_ROWS = 50_000  # contaminated documents, with their items, up to which they are broadcast
#: Fixed value: what separates words, after A-Z are in lower case
SEPARATOR = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"


def item_words(text: Column) -> Column:
    """Words of a text; the split leaves at most an empty string at either end."""
    parts = F.split(_lower(text), SEPARATOR)
    return F.filter(parts, lambda w: w != "")


def _lower(text: Column) -> Column:
    # only A-Z may change: lower() is that, and much faster, where the text is all ASCII
    text = F.coalesce(text, F.lit(""))
    slow = F.translate(text, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    return F.when(F.octet_length(text) == F.char_length(text), F.lower(text)).otherwise(slow)


def _key(words: Column, at: Column, n: int) -> Column:
    """The hash of the n words from ``at`` (0-based) on."""
    return F.xxhash64(F.lit(n), *[F.get(words, at + j) for j in range(n)])


def windows(benchmark: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(window_id, words, length) of distinct windows, and (window_id, item_id)."""
    items = benchmark.select(F.col("item_id").cast("long"), item_words(F.col("text")).alias("ws")).where(F.size("ws") > 0)
    starts = F.sequence(F.lit(0), F.greatest(F.size("ws") - WINDOW_WORDS, F.lit(0)))
    each = items.select("item_id", "ws", F.explode(starts).alias("s")).select("item_id", F.slice("ws", F.col("s") + 1, WINDOW_WORDS).alias("words"))
    each = each.withColumn("window_id", F.sha2(F.concat_ws(" ", "words"), 256)).distinct()
    return each.select("window_id", "words", F.size("words").alias("length")).dropDuplicates(["window_id"]), each.select("window_id", "item_id")


def _window_shingles(each: DataFrame) -> DataFrame:
    n = F.least(F.col("length"), F.lit(SHINGLE_WORDS))
    at = each.select("window_id", "words", "length", n.alias("n"), F.explode(F.sequence(F.lit(0), F.col("length") - n)).alias("o"))
    key = F.when(F.col("n") == 1, _key(F.col("words"), F.col("o"), 1))
    for k in range(2, SHINGLE_WORDS + 1):
        key = key.when(F.col("n") == k, _key(F.col("words"), F.col("o"), k))
    return at.withColumn("key", key)


def _version(text: Column) -> Column:
    """With the doc_id, what a row is known by: ids may be null or repeated."""
    return F.xxhash64(F.coalesce(text, F.lit("")))


def _split(docs: DataFrame) -> DataFrame:
    """doc_id, version, parts of the text, lead (1 if the first part is empty), n_words."""
    split = docs.select(F.col("doc_id").cast("long").alias("doc_id"), _version(F.col("text")).alias("version"), F.split(_lower(F.col("text")), SEPARATOR).alias("parts"))
    # an empty string can only be the first or the last part
    split = split.withColumn("lead", (F.get("parts", F.lit(0)) == "").cast("int"))
    last = F.when((F.size("parts") > 1) & (F.element_at("parts", -1) == ""), 1).otherwise(0)
    return split.withColumn("n_words", F.greatest(F.size("parts") - F.col("lead") - last, F.lit(0)))


def _positions(split: DataFrame, sizes: list[int], first: int = 0) -> DataFrame:
    """A row per document, position and size with the shingle's hash; with ``first`` -1 one more, for the document."""
    at = split.withColumn("p", F.explode(F.sequence(F.lit(first), F.col("n_words") - 1) if first < 0 else F.when(F.col("n_words") > 0, F.sequence(F.lit(0), F.col("n_words") - 1))))
    keys = [_key(F.col("parts"), F.col("lead") + F.col("p"), n) for n in sizes]
    if len(keys) == 1:
        return at.withColumn("key", keys[0])
    return at.withColumn("key", F.explode(F.when(F.col("p") < 0, F.array(F.lit(0).cast("long"))).otherwise(F.array(*keys))))


def contamination(docs: DataFrame, benchmark: DataFrame, folder: str | None = None) -> DataFrame:
    """Per row of ``docs`` (doc_id, text): n_words, n_hit, n_items, item_ids, contaminated.

    Null and empty texts have no words; items without words have no window.  A
    null item_id marks words as hit but is not listed.  Rows that repeat a
    doc_id and a text get one result row each; items repeated in the benchmark
    count once by their item_id.
    """
    return _judged(docs, benchmark, folder).drop("version")


def _judged(docs: DataFrame, benchmark: DataFrame, folder: str | None) -> DataFrame:
    """contamination, and each row's version: the hash of its text."""
    spark: SparkSession = docs.sparkSession
    folder = folder or work_dir(spark, "decontaminate")
    each, owners = windows(benchmark)
    each, owners = saved(each, f"{folder}/windows"), saved(owners, f"{folder}/owners")
    shingles = saved(_window_shingles(each), f"{folder}/shingles")
    sizes = sorted(r["n"] for r in shingles.select("n").distinct().collect()) or [1]  # at most SHINGLE_WORDS values
    split = _split(docs)

    keys = saved(shingles.select("key").distinct(), f"{folder}/keys")
    counts = _positions(split, sizes).select("key").join(sized(keys, keys.count(), INDEX_ROWS), "key").groupBy("key").agg(F.count("*").alias("seen"))
    counts = saved(counts, f"{folder}/counts")
    rarest = Window.partitionBy("window_id").orderBy(F.coalesce("seen", F.lit(0)), "key", "o")
    index = shingles.join(counts, "key", "left").withColumn("rank", F.row_number().over(rarest)).where("rank = 1")
    index = saved(index.select(F.col("key").alias("k"), "window_id", "words", "length", "o"), f"{folder}/index")
    n_index = index.count()

    start = F.col("p") - F.col("o")
    fits = (F.col("key") == F.col("k")) & (F.col("p") >= 0) & (start >= 0) & (start + F.col("length") <= F.col("n_words"))
    holds = F.slice("parts", F.col("lead") + F.col("start") + 1, F.col("length")) == F.col("words")
    if n_index <= INDEX_ROWS:
        verified = fits & (F.slice("parts", F.col("lead") + start + 1, F.col("length")) == F.col("words"))
        found = _positions(split, sizes, -1).join(F.broadcast(index), verified, "left").where((F.col("p") == -1) | F.col("k").isNotNull())
        found = saved(found.select("doc_id", "version", "n_words", F.when(F.col("k").isNotNull(), start).alias("start"), "length", "window_id"), f"{folder}/found")
        base, hits = found.where("start is null"), found.where("start is not null")
    else:
        base = saved(split.select("doc_id", "version", "n_words"), f"{folder}/base")
        may = _positions(split, sizes).select("doc_id", "version", "n_words", "p", "key").join(index.drop("words"), fits)
        may = saved(may.select("doc_id", "version", start.alias("start"), "window_id").distinct(), f"{folder}/may")
        asked = may.select(F.col("doc_id").alias("d"), F.col("version").alias("v")).distinct()
        same = F.col("doc_id").eqNullSafe(F.col("d")) & (F.col("version") == F.col("v"))
        words = split.drop("n_words").join(asked, same, "left_semi").dropDuplicates(["doc_id", "version"])
        words = words.select(F.col("doc_id").alias("d"), F.col("version").alias("v"), "parts", "lead")
        hits = may.join(index.drop("k", "o"), "window_id").join(words, same).where(holds).select("doc_id", "version", "start", "length", "window_id")
    return _summed(base, hits, owners, folder)


def _summed(base: DataFrame, hits: DataFrame, owners: DataFrame, folder: str) -> DataFrame:
    ids = ["doc_id", "version"]
    hits = saved(hits.select(*ids, "start", "length", "window_id").distinct(), f"{folder}/hits")
    reach = F.max(F.col("start") + F.col("length")).over(Window.partitionBy(*ids).orderBy("start", "length").rowsBetween(Window.unboundedPreceding, -1))
    fresh = F.greatest(F.lit(0), F.col("start") + F.col("length") - F.greatest(F.col("start"), F.coalesce(reach, F.lit(0))))
    words = hits.select(*ids, fresh.alias("fresh")).groupBy(*ids).agg(F.sum("fresh").alias("n_hit"))
    named = hits.select(*ids, "window_id").distinct().join(owners, "window_id").where("item_id is not null").groupBy(*ids).agg(F.array_sort(F.collect_set(F.col("item_id").cast("string"))).alias("item_ids"))
    both = words.join(named, [words["doc_id"].eqNullSafe(named["doc_id"]), words["version"] == named["version"]], "left").select(words["doc_id"].alias("d"), words["version"].alias("v"), "n_hit", "item_ids")
    both = saved(both, f"{folder}/both")
    out = base.join(sized(both, both.count(), HIT_ROWS), F.col("doc_id").eqNullSafe(F.col("d")) & (F.col("version") == F.col("v")), "left")
    none = F.array().cast("array<string>")
    return out.select("doc_id", "version", F.col("n_words").cast("long"), F.coalesce("n_hit", F.lit(0)).cast("long").alias("n_hit"), F.size(F.coalesce("item_ids", none)).cast("long").alias("n_items"), F.coalesce("item_ids", none).alias("item_ids"), (F.coalesce("n_hit", F.lit(0)) > 0).alias("contaminated"))


def without_contaminated(docs: DataFrame, benchmark: DataFrame, folder: str | None = None) -> DataFrame:
    """``docs`` without the documents that hold a window, all columns as they are."""
    folder = folder or work_dir(docs.sparkSession, "decontaminate")
    hit = _judged(docs, benchmark, folder).where("contaminated").select("doc_id", "version").distinct()
    hit = saved(hit, f"{folder}/hit")
    rows = held_rows(docs, id=F.col("doc_id").cast("long"), version=_version(F.col("text")))
    return rows.join(sized(hit, hit.count()), rows["id"].eqNullSafe(hit["doc_id"]) & (rows["version"] == hit["version"]), "left_anti").select("row.*")


def op1_prefix_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = contamination(spark.read.parquet(f"{sf_dir}/documents.parquet"), spark.read.parquet(f"{sf_dir}/benchmark.parquet"))
    return out.select("doc_id", "n_words", "n_hit", "n_items", F.sha2(F.concat_ws(",", "item_ids"), 256).alias("items_sha256"), "contaminated")


OP1_SQL = """
WITH d AS MATERIALIZED (
  SELECT doc_id, list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+'), lambda x: x <> '') AS ws FROM documents),
i AS MATERIALIZED (
  SELECT item_id, list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+'), lambda x: x <> '') AS ws FROM benchmark),
win AS MATERIALIZED (
  SELECT DISTINCT item_id, least(len(ws), 10) AS k, array_to_string(ws[s:s + least(len(ws), 10) - 1], ' ') AS g
  FROM (SELECT item_id, ws, unnest(range(1, greatest(len(ws) - 10, 0) + 2)) AS s FROM i WHERE len(ws) > 0)),
ks AS (SELECT DISTINCT k FROM win),
pos AS MATERIALIZED (
  SELECT doc_id, k, s, array_to_string(ws[s:s + k - 1], ' ') AS g
  FROM (SELECT doc_id, ws, k, unnest(range(1, len(ws) - k + 2)) AS s FROM d, ks WHERE len(ws) >= k)),
hit AS MATERIALIZED (SELECT p.doc_id, p.s, p.k, w.item_id FROM pos p JOIN win w ON p.k = w.k AND p.g = w.g),
words AS (SELECT doc_id, count(DISTINCT q) AS n_hit FROM (SELECT doc_id, unnest(range(s, s + k)) AS q FROM hit) GROUP BY 1),
items AS (SELECT doc_id, count(*) AS n_items, string_agg(i, ',' ORDER BY i) AS ids FROM (SELECT DISTINCT doc_id, item_id::VARCHAR AS i FROM hit) GROUP BY 1)
SELECT d.doc_id, len(ws)::BIGINT AS n_words, coalesce(n_hit, 0)::BIGINT AS n_hit, coalesce(n_items, 0)::BIGINT AS n_items,
  sha256(coalesce(ids, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN words USING (doc_id) LEFT JOIN items USING (doc_id)
"""
