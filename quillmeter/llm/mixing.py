"""Mixing sources to target weights by fixed-length blocks and index permutations.

Sizes are words.  Targets: source weights share the total; a target stops at
three times its source's size and the excess is shared again by weight, which
has a closed form (water filling over sources sorted by cap / weight).

Packing: documents of a source lie end to end in an order of (bucket, doc_id,
text hash), bucket = a hash of doc_id and text, so a document's first word index
is a prefix sum over bucket totals plus one within its bucket, and no task holds a
source.  Block b of a source is the words [128 b, 128 b + 128).

Drawing: a source gives its target, rounded to words: all its blocks in each full
epoch, then blocks until the rest is met, the last one cut at the rest; that is
its quota of slots.  Each of an output shard's 1024 slots draws its source with a
probability of quota / all quotas, from a seeded hash, so the sources' counts in a
shard are a multinomial draw.  Counts are summed over shards in order; slots by
which a source has passed its quota, most of them in the last shards, go to the
sources that have not reached theirs, so the totals carry no sampling noise.
The j-th slot of a source takes, in epoch j div n, block perm(source, epoch)(j mod
n) of its n blocks: no block is taken twice before all are taken once, and never
more than three times.

Permutations are swap-or-not shuffles: a bijection of [0, n) for any n, made of
hashes, evaluated per index; nothing is sorted or collected.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import held_rows, saved, sized, work_dir

#: Weights by source order, repeating; most times that a source is used
WEIGHTS, MOST = (5, 2, 1), 3
#: Fixed value: the words of a text
WORD = r"[^\x20\x09-\x0D]+"
BLOCK_WORDS, SHARD_SLOTS, ROUNDS, SEED = 128, 1024, 24, 17
#: Documents of a bucket, about; buckets at least; parts of a running total that one task sums; cells of all quotas
BUCKET_ROWS, BUCKETS, SPAN, CELLS = 1 << 15, 1024, 1024, 4096
SOURCE_ROWS = 10_000  # sources up to which tables of them are broadcast


def permuted(x: Column, n: Column, *key: Column, back: bool = False) -> Column:
    """Where a pseudorandom permutation of [0, n), named by ``key``, puts x; with ``back``, what it puts at x."""

    def swap(v: Column, i: Column) -> Column:
        other = F.pmod(F.pmod(F.xxhash64(F.lit(SEED), i, *key), n) - v, n)
        return F.when(F.xxhash64(F.lit(SEED + 1), i, F.greatest(v, other), *key) % 2 == 0, other).otherwise(v)

    # a round is its own inverse
    rounds = F.sequence(F.lit(ROUNDS), F.lit(1)) if back else F.sequence(F.lit(1), F.lit(ROUNDS))
    return F.aggregate(rounds, x.cast("long"), swap)


def source_targets(sizes: DataFrame) -> DataFrame:
    """(source, source_size) to weights and targets; one row per source.

    The window runs over all sources in one task: a row each, of three numbers.
    """
    order = Window.orderBy(F.col("source").asc_nulls_last())
    rank = F.pmod(F.row_number().over(order) - 1, F.lit(len(WEIGHTS)))
    weight = F.element_at(F.array(*[F.lit(float(w)) for w in WEIGHTS]), (rank + 1).cast("int"))
    w = sizes.withColumn("weight", weight).withColumn("cap", (MOST * F.col("source_size")).cast("double"))
    up = Window.orderBy(F.col("cap") / F.col("weight"), F.col("source").asc_nulls_last())
    before, after = up.rowsBetween(Window.unboundedPreceding, -1), up.rowsBetween(0, Window.unboundedFollowing)
    total = F.sum("source_size").over(Window.partitionBy()).cast("double")
    level = (total - F.coalesce(F.sum("cap").over(before), F.lit(0.0))) / F.sum("weight").over(after)
    w = w.withColumn("level", level).withColumn("fits", F.col("level") <= F.col("cap") / F.col("weight"))
    water = F.min(F.when(F.col("fits"), F.struct(F.col("cap") / F.col("weight"), "level"))).over(Window.partitionBy())["level"]
    return w.withColumn("target", F.least("cap", F.coalesce(water * F.col("weight"), F.col("cap")))).select("source", "source_size", "weight", "target")


def running(df: DataFrame, by: list[str], at: str, value: str, name: str) -> DataFrame:
    """``df``, of one row for each (by, at), with the sum of ``value`` over smaller ``at`` as ``name``.

    Sums of SPAN neighbours, then sums before each of them: no task holds all.
    """
    ahead = lambda w: w.rowsBetween(Window.unboundedPreceding, -1)
    spans = df.withColumn("span", F.floor(F.col(at) / SPAN))
    upper = spans.groupBy(*by, "span").agg(F.sum(value).alias("held"))
    upper = upper.withColumn("base", F.coalesce(F.sum("held").over(ahead(Window.partitionBy(*by).orderBy("span"))), F.lit(0))).drop("held")
    inner = spans.withColumn("inner", F.coalesce(F.sum(value).over(ahead(Window.partitionBy(*by, "span").orderBy(at))), F.lit(0)))
    return inner.join(upper, [*by, "span"]).withColumn(name, F.col("base") + F.col("inner")).select(*df.columns, name)


def _version(text: Column) -> Column:
    return F.xxhash64(F.coalesce(text, F.lit("")))


def sized_rows(docs: DataFrame) -> DataFrame:
    """Per row: doc_id, version (a hash of the text), source and size in words."""
    size = F.regexp_count(F.coalesce("text", F.lit("")), F.lit(WORD)).cast("long")
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), _version(F.col("text")).alias("version"), F.col("source").cast("string").alias("source"), size.alias("size"))


def mix(docs: DataFrame, folder: str | None = None) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(placed documents, sources with targets, slots of the mix).

    documents: doc_id, version, source, sid, size, first; slots: shard, slot,
    source, sid, epoch, block, take: the words of the block that it takes at most.
    sid numbers the sources.  A null source is a source of its own; null texts
    have no words and are never taken; an empty table has no slots.
    """
    folder = folder or work_dir(docs.sparkSession, "mix")
    sizes = saved(sized_rows(docs), f"{folder}/sizes")
    sources = source_targets(sizes.groupBy("source").agg(F.sum("size").alias("source_size")))
    sources = saved(sources.withColumn("sid", F.row_number().over(Window.orderBy(F.col("source").asc_nulls_last())).cast("long")), f"{folder}/sources")
    n_sources = sources.count()

    n_buckets = max(BUCKETS, sizes.count() // BUCKET_ROWS)
    names = sized(sources.select(F.col("source").alias("s"), "sid"), n_sources, SOURCE_ROWS)
    bucket = F.pmod(F.xxhash64("doc_id", "version"), F.lit(n_buckets)).alias("bucket")
    rows = sizes.join(names, F.col("source").eqNullSafe(F.col("s"))).select("doc_id", "version", "source", "sid", "size", bucket)
    starts = running(saved(rows.groupBy("sid", "bucket").agg(F.sum("size").alias("held")), f"{folder}/buckets"), ["sid"], "bucket", "held", "base")
    inner = Window.partitionBy("sid", "bucket").orderBy("doc_id", "version").rowsBetween(Window.unboundedPreceding, -1)
    placed = rows.withColumn("within", F.coalesce(F.sum("size").over(inner), F.lit(0))).join(starts.drop("held"), ["sid", "bucket"])
    placed = placed.select("doc_id", "version", "source", "sid", "size", (F.col("base") + F.col("within")).alias("first"))
    return placed, sources, _slots(with_quotas(sources), n_sources, folder)


def _slots(quotas: DataFrame, n_sources: int, folder: str) -> DataFrame:
    """Every slot of the mix with its source, epoch and block."""
    spark = quotas.sparkSession
    # a row per source goes through a single task
    ahead = Window.orderBy("sid").rowsBetween(Window.unboundedPreceding, -1)
    quotas = saved(quotas.where("quota > 0").withColumn("begin", F.coalesce(F.sum("quota").over(ahead), F.lit(0))), f"{folder}/quotas")
    total = quotas.agg(F.coalesce(F.sum("quota"), F.lit(0))).first()[0]
    tasks = int(spark.conf.get("spark.sql.shuffle.partitions"))
    shards = spark.range(0, -(-total // SHARD_SLOTS), 1, tasks).select(F.col("id").alias("shard"))
    last = F.least(F.lit(SHARD_SLOTS), F.lit(total) - F.col("shard") * SHARD_SLOTS) - 1
    ticks = shards.select("shard", F.explode(F.sequence(F.lit(0).cast("long"), last)).alias("i"))
    ticks = ticks.withColumn("tick", F.pmod(F.xxhash64(F.lit(SEED + 2), "shard", "i"), F.lit(max(1, total))))
    # the source whose span [begin, begin + quota) holds the tick; cells find it by an equal key
    n_cells = max(CELLS, 4 * n_sources)
    width = -(-max(1, total) // n_cells)
    cell = lambda x: F.floor(x / width)
    cells = quotas.select("sid", "begin", "quota", F.explode(F.sequence(cell(F.col("begin")), cell(F.col("begin") + F.col("quota") - 1))).alias("cell"))
    inside = (F.col("tick") >= F.col("begin")) & (F.col("tick") < F.col("begin") + F.col("quota"))
    drawn = ticks.withColumn("cell", cell(F.col("tick"))).join(sized(cells, n_cells + n_sources, 4 * SOURCE_ROWS), "cell").where(inside)
    nth = F.row_number().over(Window.partitionBy("shard", "sid").orderBy("i")) - 1
    drawn = saved(drawn.select("shard", "i", "sid", nth.cast("long").alias("nth")), f"{folder}/drawn")

    counts = running(saved(drawn.groupBy("shard", "sid").agg(F.count("*").alias("n")), f"{folder}/counts"), ["sid"], "shard", "n", "before")
    small = lambda df: sized(df, n_sources, SOURCE_ROWS)
    ranked = drawn.join(counts, ["shard", "sid"]).join(small(quotas.select("sid", "quota")), "sid")
    ranked = saved(ranked.select("shard", "i", "sid", (F.col("before") + F.col("nth")).alias("j"), (F.col("before") + F.col("nth") >= F.col("quota")).alias("spare")), f"{folder}/ranked")

    spare = ranked.where("spare").select("shard", "i").withColumn("nth", F.row_number().over(Window.partitionBy("shard").orderBy("i")) - 1)
    spare_counts = running(spare.groupBy("shard").agg(F.count("*").alias("n")), [], "shard", "n", "before")
    spare = spare.join(spare_counts, "shard").select("shard", "i", (F.col("before") + F.col("nth")).alias("unit"))
    got = counts.groupBy("sid").agg(F.sum("n").alias("got"))
    lacks = quotas.join(got, "sid", "left").select("sid", F.coalesce("got", F.lit(0)).alias("got"), (F.col("quota") - F.coalesce("got", F.lit(0))).alias("lack")).where("lack > 0")
    lacks = lacks.withColumn("from", F.coalesce(F.sum("lack").over(ahead), F.lit(0)))
    units = lacks.select("sid", "got", "from", F.explode(F.sequence(F.lit(0).cast("long"), F.col("lack") - 1)).alias("u"))
    units = units.select("sid", (F.col("from") + F.col("u")).alias("unit"), (F.col("got") + F.col("u")).alias("j"))
    given = spare.join(units, "unit").select("shard", "i", "sid", "j")

    taken = ranked.where("not spare").select("shard", "i", "sid", "j").unionByName(given).join(small(quotas.drop("begin")), "sid")
    epoch = F.floor(F.col("j") / F.col("blocks"))
    block = permuted(F.pmod("j", "blocks"), F.col("blocks"), *_source_key(), F.col("epoch"))
    take = F.when(F.col("j") == F.col("quota") - 1, F.col("last")).otherwise(F.lit(BLOCK_WORDS)).cast("long")
    # an index is a few bytes but much work: a stated number of partitions is not coalesced
    taken = taken.repartition(tasks, "shard", "i").withColumn("epoch", epoch)
    return saved(taken.select("shard", (F.col("shard") * SHARD_SLOTS + F.col("i")).alias("slot"), "source", "sid", "epoch", block.alias("block"), take.alias("take")), f"{folder}/slots")


def _source_key() -> tuple[Column, Column]:
    return F.coalesce("source", F.lit("")), F.col("source").isNull()


def with_quotas(sources: DataFrame) -> DataFrame:
    """Per source: its blocks, quota (slots) and last, the words that its last slot takes."""
    size, blocks = F.col("source_size"), F.ceil(F.col("source_size") / BLOCK_WORDS).cast("long")
    want = F.least(F.round("target").cast("long"), MOST * size)
    q = sources.where(size > 0).select("sid", "source", "source_size", blocks.alias("blocks"), want.alias("want"))
    epochs = F.floor(F.col("want") / F.greatest(size, F.lit(1)))  # filters may be evaluated late
    q = q.withColumn("epochs", epochs).withColumn("rest", F.col("want") - F.col("epochs") * size)
    # the source's last block lacks some words; where the last, partial epoch takes it matters
    lacks = F.col("blocks") * BLOCK_WORDS - size
    q = q.withColumn("lacks", lacks).withColumn("short", permuted(F.col("blocks") - 1, F.greatest("blocks", F.lit(1)), *_source_key(), F.col("epochs"), back=True))

    def held(slots: Column) -> Column:
        return slots * BLOCK_WORDS - F.when(F.col("short") < slots, F.col("lacks")).otherwise(0)

    few = F.ceil(F.col("rest") / BLOCK_WORDS).cast("long")
    q = q.withColumn("few", few + F.when(held(few) < F.col("rest"), 1).otherwise(0))
    last = F.when(F.col("few") > 0, F.col("rest") - held(F.col("few") - 1)).otherwise(BLOCK_WORDS)
    return q.select("sid", "source", "blocks", (F.col("epochs") * F.col("blocks") + F.col("few")).alias("quota"), last.alias("last"))


def segments(placed: DataFrame) -> DataFrame:
    """The words that each document has in each block: at (in the document), off (in the block), words."""
    first, end = F.col("first"), F.col("first") + F.col("size")
    s = placed.where("size > 0").withColumn("block", F.explode(F.sequence(F.floor(first / BLOCK_WORDS), F.floor((end - 1) / BLOCK_WORDS))))
    lo = F.greatest(first, F.col("block") * BLOCK_WORDS)
    hi = F.least(end, (F.col("block") + 1) * BLOCK_WORDS)
    return s.select("doc_id", "version", "source", "sid", "size", "first", "block", (lo - first).alias("at"), (lo - F.col("block") * BLOCK_WORDS).alias("off"), (hi - lo).alias("words"))


def _taken() -> Column:
    """The words of a segment that a slot takes of its block."""
    return F.greatest(F.lit(0), F.least(F.col("words"), F.col("take") - F.col("off")))


def usage(placed: DataFrame, slots: DataFrame) -> DataFrame:
    """Per placed document: taken, the words of it that the mix holds."""
    times = slots.groupBy("sid", "block", "take").agg(F.count("*").alias("times"))
    joined = segments(placed).join(times, ["sid", "block"], "left")
    # a document's place tells rows that repeat an id and a text apart
    taken = joined.groupBy("sid", "first", "source", "doc_id", "size").agg(F.sum(F.when(F.col("times").isNull(), 0).otherwise(_taken() * F.col("times"))).alias("taken"))
    empty = placed.where("size = 0").select("sid", "first", "source", "doc_id", "size", F.lit(0).cast("long").alias("taken"))
    return taken.unionByName(empty)


def op5_block_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    placed, sources, slots = mix(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    used = usage(placed, slots)
    return used.join(sized(sources.select("sid", "source_size", "target"), sources.count(), SOURCE_ROWS), "sid").select("doc_id", "size", "source_size", "target", "taken")


#: A word with the white space before it, so that cut texts keep their lines.
PART = r"[\x20\x09-\x0D]*[^\x20\x09-\x0D]+"


def mixed_documents(docs: DataFrame, folder: str | None = None) -> DataFrame:
    """The mix as rows of ``docs``: for each epoch in which the mix takes words
    of a document, one row of it with the taken words in their order.

    Wholly taken texts stay as they are, others are cut at word bounds.  All
    columns stay; n_chars, where there is one, is the new text's length.  Rows
    that repeat an id, text and source take their places in any order.
    """
    folder = folder or work_dir(docs.sparkSession, "mix")
    placed, _, slots = mix(docs, folder)
    parts = segments(placed).join(slots.select("sid", "block", "epoch", "take"), ["sid", "block"]).withColumn("words", _taken()).where("words > 0")
    keys = ["doc_id", "version", "source"]
    taken = parts.groupBy(*keys, "size", "first", "epoch").agg(F.sum("words").alias("taken"), F.array_sort(F.collect_list(F.struct("at", "words"))).alias("cuts"))
    plan = taken.withColumn("twin", F.dense_rank().over(Window.partitionBy(*keys).orderBy("first"))).withColumn("whole", F.col("taken") == F.col("size"))
    plan = saved(plan.select(*keys, "twin", "whole", "cuts"), f"{folder}/plan")
    rows = held_rows(docs, id=F.col("doc_id").cast("long"), text_version=_version(F.col("text")), origin=F.col("source").cast("string"))
    if plan.where("twin > 1").isEmpty():
        rows = rows.withColumn("nth", F.lit(1))
    else:
        rows = rows.withColumn("nth", F.row_number().over(Window.partitionBy("id", "text_version", "origin").orderBy(F.lit(1))))
    match = F.col("id").eqNullSafe(F.col("doc_id")) & (F.col("text_version") == F.col("version")) & F.col("origin").eqNullSafe(F.col("source")) & (F.col("nth") == F.col("twin"))
    words = F.regexp_extract_all("row.text", F.lit(PART), F.lit(0))
    # a text's words are bound to a lambda variable: found once, not once a cut
    cut = F.transform(F.array(words), lambda ws: F.array_join(F.flatten(F.transform("cuts", lambda c: F.slice(ws, (c["at"] + 1).cast("int"), c["words"].cast("int")))), ""))
    text = F.when(F.col("whole"), F.col("row.text")).otherwise(F.regexp_replace(F.get(cut, F.lit(0)), r"^[\x20\x09-\x0D]+", ""))
    out = rows.join(plan, match).select("row", text.alias("new_text"))
    row = F.col("row").withField("text", F.col("new_text"))
    if "n_chars" in docs.columns:
        row = row.withField("n_chars", F.char_length("new_text").cast(docs.schema["n_chars"].dataType))
    return out.select(row.alias("row")).select("row.*")
