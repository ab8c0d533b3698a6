"""URL filters: rules found by a cascade of Bloom filters, without joins.

A url's candidate keys are (suffix of its host at a dot, prefix of its path of
a length that some rule has), longest first.  The rules' keys are listed.  Level
1 encodes the listed keys; over the complete universe of candidate keys in the
corpus, the keys that pass though they are not listed are its false positives;
level 2 encodes those, level 3 the listed keys that pass level 2, and so on
until a level has no false positives.  A key of the universe is listed if and
only if the first level that rejects it is even (counted from 1), so membership
is exact and a url's rule is its longest listed candidate.

Keys are dealt over shards of about SHARD_KEYS by a hash, each with filters of its
own size, so a list of any length has the same cascade.  The filters of one shard
are arrays of longs in the plan, tested in generated code: a scan of urls needs no
shuffle and no join.  Of more shards they are a table of a row per shard, which
candidate keys meet by their shard's number (broadcast while the filters take
FILTER_BYTES at most, else shuffled, with SALTS copies of each row); the list
itself is joined in neither case.  Building needs one distinct over the keys that
pass level 1.
"""

from __future__ import annotations

import math
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import saved, work_dir

#: Host, path prefix, verdict
RULES = (("com", "/", "allow"), ("example.com", "/en/", "block"), ("www.example.com", "/en/", "allow"), ("net", "/es/", "block"), ("net", "/fr/", "block"))
DEFAULT = "allow"  # what no rule lists
BITS_PER_KEY, HASHES = 8, 4
#: Listed keys of a shard, about; bytes of all filters up to which they are broadcast; copies of a filter where they are not
SHARD_KEYS, FILTER_BYTES, SALTS = 1 << 17, 64 << 20, 16


def host_and_path(url: Column) -> tuple[Column, Column]:
    at = F.instr(url, F.lit("://"))
    rest = F.when(at > 0, url.substr(at + 3, F.char_length(url))).otherwise("")
    rest = F.coalesce(rest, F.lit(""))
    host = F.translate(F.regexp_extract(rest, r"(?s)^[^/?#]*", 0), "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    path = F.regexp_extract(rest, r"(?s)^[^/?#]*([^?#]*)", 1)
    return host, path


def _suffixes(host: Column) -> Column:
    """The host, then what follows each dot."""
    labels = F.split(host, r"\.")
    return F.transform(F.sequence(F.lit(1), F.size(labels)), lambda i: F.array_join(F.slice(labels, i, F.size(labels)), "."))


def candidates(host: Column, path: Column, lengths: list[int]) -> Column:
    """(key, host part, path part), the longest first; the longer host first among equals."""
    cuts = F.array(*[F.lit(n) for n in lengths])
    paths = F.transform(F.filter(cuts, lambda n: n <= F.char_length(path)), lambda n: path.substr(F.lit(1), n))
    pairs = F.flatten(F.transform(_suffixes(host), lambda h: F.transform(paths, lambda p: F.struct((-F.char_length(h) - F.char_length(p)).alias("less"), (-F.char_length(h)).alias("lessh"), F.concat(h, p).alias("rule"), F.concat(h, F.lit("\n"), p).alias("key")))))
    return F.array_sort(pairs)


def shard_of(key: Column, shards: int) -> Column:
    return F.pmod(F.xxhash64(key, F.lit(-1)), F.lit(shards))


def _slots(key: Column, number: int, words: Column) -> list[Column]:
    """A key's bit positions in a filter of that many longs."""
    return [F.pmod(F.xxhash64(key, F.lit(1000 * number + k)), 64 * words) for k in range(HASHES)]


def _holds(key: Column, number: int, words: Column) -> Column:
    """Whether the filter passes the key; none passes where a shard has no filter."""
    test = words.isNotNull()
    for slot in _slots(key, number, F.size(words)):
        test = test & (F.call_function("shiftright", F.get(words, F.floor(slot / 64).cast("int")), (slot % 64).cast("int")).bitwiseAND(F.lit(1)) == 1)
    return F.coalesce(test, F.lit(False))


def _level(number: int, keys: DataFrame) -> DataFrame:
    """(shard, the filter's longs) of keys (shard, key)."""
    sizes = keys.groupBy("shard").agg(F.greatest(F.lit(1).cast("long"), F.ceil(F.count("*") * BITS_PER_KEY / 64)).alias("words"))
    slot = keys.join(sizes, "shard").select("shard", F.explode(F.array(*_slots(F.col("key"), number, F.col("words")))).alias("slot"))
    one = F.call_function("shiftleft", F.lit(1).cast("long"), (F.col("slot") % 64).cast("int"))
    bits = slot.select("shard", F.floor(F.col("slot") / 64).alias("at"), one.alias("bit")).groupBy("shard", "at").agg(F.bit_or("bit").alias("bits"))
    every = sizes.select("shard", F.explode(F.sequence(F.lit(0).cast("long"), F.col("words") - 1)).alias("at")).join(bits, ["shard", "at"], "left")
    return every.groupBy("shard").agg(F.array_sort(F.collect_list(F.struct("at", F.coalesce("bits", F.lit(0).cast("long")).alias("bits")))).alias("f")).select("shard", F.col("f.bits").alias(f"l{number}"))


class Cascade:
    """The filters by level: literals in the plan for one shard, else a table."""

    def __init__(self, shards: int, levels: int, table: DataFrame | None, listed: int):
        self.shards, self.levels, self.table, self.listed = shards, levels, table, listed
        self.literals: list[Column] = []
        if shards == 1 and table is not None:
            row = table.first()  # one shard's filters: SHARD_KEYS bytes and less a level
            for k in range(1, levels + 1):
                words = row[f"l{k}"] or []
                plain = F.array(*[F.lit(w) for w in words]) if 0 < len(words) <= 4096 else F.from_json(F.lit(str(words)), "array<bigint>")
                self.literals.append(plain)

    def listed_key(self, key: Column, words: list[Column] | None = None) -> Column:
        """Whether a key of the universe is listed, by the shard's filters."""
        words = self.literals if words is None else words
        found = F.lit(self.levels % 2 == 1)
        for number in range(self.levels, 0, -1):
            found = F.when(_holds(key, number, words[number - 1]), found).otherwise(F.lit(number % 2 == 0))
        return found

    def marked(self, keys: DataFrame, key: Column, name: str) -> DataFrame:
        """``keys`` with a column that says whether each is listed."""
        if self.shards == 1 or self.table is None:
            return keys.withColumn(name, self.listed_key(key))
        return met(keys, key, self.shards, self.table, lambda: {name: self.listed_key(key, [F.col(f"l{k}") for k in range(1, self.levels + 1)])}, self.listed)


def met(keys: DataFrame, key: Column, shards: int, table: DataFrame, found: Callable[[], dict[str, Column]], listed: int) -> DataFrame:
    """``keys`` joined with their shard's row of ``table``, which ``found`` turns into columns."""
    names = [c for c in table.columns if c != "shard"]
    small = 2 * listed * BITS_PER_KEY // 8 <= FILTER_BYTES
    rows, own = keys.withColumn("_shard", shard_of(key, shards)), table.withColumnRenamed("shard", "_shard")
    if small:
        joined = rows.join(F.broadcast(own), "_shard", "left")
    else:
        rows = rows.withColumn("_salt", F.pmod(F.monotonically_increasing_id(), F.lit(SALTS)))
        own = own.withColumn("_salt", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(SALTS - 1).cast("long"))))
        joined = rows.join(own, ["_shard", "_salt"], "left").drop("_salt")
    return joined.withColumns(found()).drop("_shard", *names)


def cascade(listed: DataFrame, universe: DataFrame, folder: str) -> Cascade:
    """The levels that tell ``listed`` keys from all others of ``universe``; each has a column key."""
    count = listed.count()
    shards = max(1, math.ceil(count / SHARD_KEYS))
    listed = listed.select("key", shard_of(F.col("key"), shards).alias("shard"))
    table, number, left = None, 0, count
    inside, outside = listed, None
    while left:
        number += 1
        level = saved(_level(number, inside.select("shard", "key")), f"{folder}/filter{number}")
        passes = lambda df, level=level, number=number: met(df, F.col("key"), shards, level, lambda: {"passes": _holds(F.col("key"), number, F.col(f"l{number}"))}, count).where("passes").select("key", "shard")
        if outside is None:
            own = passes(universe.select("key", shard_of(F.col("key"), shards).alias("shard"))).distinct()
            wrong = saved(own.join(listed.select("key"), "key", "left_anti"), f"{folder}/level{number}")
        else:
            wrong = saved(passes(outside), f"{folder}/level{number}")
        table = level if table is None else saved(table.join(level, "shard", "left"), f"{folder}/filters{number}")
        inside, outside = wrong, inside
        left = inside.count()
    return Cascade(shards, number, table, count)


def judge(pages: DataFrame, rules: DataFrame, default: str = DEFAULT, folder: str | None = None) -> DataFrame:
    """Per row of ``pages`` (page_id, url): host, path, rule, verdict.

    ``rules`` has (host, path, verdict).  Null urls and urls without :// have
    empty parts and no rule.  Of rules that repeat a host and path the smallest
    verdict holds; of rules that fit equally long the one of the longer host.
    Rows that repeat a page_id are each judged; further columns are not read.
    """
    spark: SparkSession = pages.sparkSession
    folder = folder or work_dir(spark, "urls")
    rules = saved(rules.groupBy("host", "path").agg(F.min("verdict").alias("verdict")).withColumn("key", F.concat("host", F.lit("\n"), "path")), f"{folder}/rules")
    lengths = sorted(r["n"] for r in rules.select(F.char_length("path").alias("n")).distinct().collect())
    host, path = host_and_path(F.col("url"))
    urls = pages.select("page_id", host.alias("host"), path.alias("path"))
    urls = urls.withColumn("found", candidates(F.col("host"), F.col("path"), lengths) if lengths else F.lit(None))
    if not lengths:
        return urls.select("page_id", "host", "path", F.lit(None).cast("string").alias("rule"), F.lit(default).alias("verdict"))
    levels = cascade(rules.select("key"), urls.select(F.explode("found.key").alias("key")), folder)
    verdicts = sorted(r["verdict"] for r in rules.select("verdict").distinct().collect())
    sides = {v: cascade(rules.where(F.col("verdict") == v).select("key"), rules.select("key"), f"{folder}/{v}") for v in verdicts[1:]}
    if levels.shards == 1:
        rows = urls.withColumn("best", F.get(F.filter("found", lambda c: levels.listed_key(c["key"])), F.lit(0)))
    else:
        spread = saved(urls.withColumn("id", F.monotonically_increasing_id()), f"{folder}/urls")
        hits = levels.marked(spread.select("id", F.explode("found").alias("c")), F.col("c.key"), "listed").where("listed")
        rows = spread.drop("found").join(hits.groupBy("id").agg(F.min("c").alias("best")), "id", "left")
    verdict = F.lit(verdicts[0])
    for k, (v, own) in enumerate(sides.items()):
        rows = own.marked(rows, F.col("best.key"), f"side{k}")
        verdict = F.when(F.col(f"side{k}"), F.lit(v)).otherwise(verdict)
    return rows.select("page_id", "host", "path", F.col("best.rule").alias("rule"), F.when(F.col("best").isNull(), F.lit(default)).otherwise(verdict).alias("verdict"))


def op3_bloom_cascade(spark: SparkSession, sf_dir: str) -> DataFrame:
    rules = spark.sql("SELECT * FROM VALUES " + ", ".join(f"('{h}', '{p}', '{v}')" for h, p, v in RULES) + " AS r(host, path, verdict)")
    return judge(spark.read.parquet(f"{sf_dir}/pages.parquet"), rules)


OP3_SQL = """
WITH p AS (
  SELECT page_id, CASE WHEN instr(coalesce(url, ''), '://') > 0 THEN substr(url, instr(url, '://') + 3) ELSE '' END AS rest FROM pages),
u AS (
  SELECT page_id, translate(regexp_extract(rest, '^[^/?#]*'), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
    regexp_extract(rest, '^[^/?#]*([^?#]*)', 1) AS path FROM p),
rules(h, f, v) AS (VALUES ('com', '/', 'allow'), ('example.com', '/en/', 'block'), ('www.example.com', '/en/', 'allow'), ('net', '/es/', 'block'), ('net', '/fr/', 'block')),
m AS (
  SELECT page_id, h || f AS rule, v, row_number() OVER (PARTITION BY page_id ORDER BY length(h || f) DESC, length(h) DESC) AS k
  FROM u JOIN rules ON (host = h OR host LIKE '%.' || h) AND starts_with(path, f))
SELECT u.page_id, host, path, rule, coalesce(v, 'allow') AS verdict FROM u LEFT JOIN m ON u.page_id = m.page_id AND k = 1
"""
