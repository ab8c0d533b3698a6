"""Near duplicates: circulant MinHash, banding, exact Jaccard verification.

Signature.  One permutation sigma (the 64-bit shingle hash, cut to 20 bits)
places a shingle in a universe of 2**20 slots; one table pi permutes the slots.
Coordinate k of a document is the minimum over its shingles of
``pi[(sigma + k) mod 2**20]``: pi shifted circularly by k, so two permutations
make all coordinates, and a shingle's coordinates lie side by side in memory.
The low byte of a coordinate is kept; equal bytes are equal minima, but for a
chance of 1/256 that only adds candidates.

Candidates.  60 bands of 5 coordinates: a pair at similarity 0.75 shares no
band with probability (1 - 0.75**5)**60 = 9e-8.  Documents with one set of
shingles are one class, and classes alone are compared.

Links without all pairs.  (1) In each bucket every class is verified against
the bucket's most popular class, the one that shares the most buckets, which is
near the middle of a group of edited copies.  (2) Components of these links are
formed.  (3) Only buckets that still hold two components are searched in full:
pairs of different components whose 1024-byte sketches agree within five
standard deviations of 0.75 are verified, each pair in its first common band.
Links inside a component cannot change it, so none between components is lost
but by the banding's and the sketch's stated chances.  Buckets of any size are
searched, in blocks.  Verification intersects full shingle sets; the set that many
others are verified against is copied once per HUB_MEMBERS of them, so that a
group of any number of edited copies is spread over tasks.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import held_rows, mapped, saved, sized, work_dir
from .components import components
from .textkernel import LOWER, ngrams, pieces, words_of

assert LOWER[65] == 97
SHINGLE_WORDS, SIMILARITY = 5, 75  # percent
ROWS, BANDS, SKETCH = 5, 60, 1024
UNIVERSE_BITS = 20
BLOCK = 2048  # classes of a bucket that are compared in one piece
HUB_MEMBERS = 64  # sets that meet one copy of a set
#: Sketch agreement that a pair at the threshold has but for five standard deviations.
AGREE = int(SKETCH * (SIMILARITY / 100 - 5 * (SIMILARITY / 100 * (1 - SIMILARITY / 100) / SKETCH) ** 0.5))

_tables: dict[int, np.ndarray] = {}


def _pi(width: int) -> np.ndarray:
    """Row s is pi at slots s, s + 1, ... s + width - 1 (circularly)."""
    if width not in _tables:
        pi = np.random.Generator(np.random.PCG64(977)).permutation(1 << UNIVERSE_BITS).astype(np.uint32)
        _tables[width] = np.lib.stride_tricks.sliding_window_view(np.concatenate([pi, pi[:width]]), width)
    return _tables[width]


def signature(shingles: np.ndarray, width: int) -> np.ndarray:
    """The low bytes of the first ``width`` coordinates of a set that is not empty."""
    table, slot = _pi(width), (shingles >> np.uint64(64 - UNIVERSE_BITS)).astype(np.int64)
    low = table[slot[:128]].min(axis=0)
    for at in range(128, len(slot), 128):
        np.minimum(low, table[slot[at : at + 128]].min(axis=0), out=low)
    return low.astype(np.uint8)


def band_keys(sketch: np.ndarray) -> np.ndarray:
    """One long per band: its number, then its five bytes."""
    b = sketch[: ROWS * BANDS].reshape(BANDS, ROWS).astype(np.int64)
    key = np.arange(BANDS, dtype=np.int64)
    for j in range(ROWS):
        key = (key << 8) | b[:, j]
    return key


def shingle_sets(texts: pa.Array) -> Iterator[np.ndarray]:
    """The sorted distinct shingle hashes of each text; empty without words."""
    w = words_of(texts, lower=True)
    grams, bounds = ngrams(w.hashes(), w.first, SHINGLE_WORDS, short=True)
    for a, b in zip(bounds[:-1], bounds[1:]):
        yield np.unique(grams[a:b])


def set_class(shingles: np.ndarray) -> int:
    """A 64-bit name of a set: equal sets have one name."""
    return int.from_bytes(hashlib.blake2b(shingles.tobytes(), digest_size=8).digest(), "little", signed=True)


SIGNED = "doc_id long, version long, n_shingles long, cls long, bands array<long>"
SETS = "doc_id long, cls long, n long, shingles array<long>, sketch binary"


def _lists(values: list[np.ndarray], kind: pa.DataType) -> pa.ListArray:
    ends = np.cumsum([0, *map(len, values)])
    flat = np.concatenate(values) if values else np.zeros(0, np.int64)
    return pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(flat, kind))


def _sign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    none = np.zeros(0, np.int64)
    for p in pieces(batches, "text"):
        n, cls, bands = [], [], []
        for s in shingle_sets(p.column("text")):
            n.append(len(s))
            cls.append(set_class(s) if len(s) else None)
            bands.append(band_keys(signature(s, ROWS * BANDS)) if len(s) else none)
        yield pa.RecordBatch.from_arrays([p.column("doc_id"), p.column("version"), pa.array(n, pa.int64()), pa.array(cls, pa.int64()), _lists(bands, pa.int64())], names=["doc_id", "version", "n_shingles", "cls", "bands"])


def _collect_sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for p in pieces(batches, "text"):
        sets = [s for s in shingle_sets(p.column("text"))]
        full = [len(s) > 0 for s in sets]
        ids = p.column("doc_id").filter(pa.array(full, pa.bool_()))
        sets = [s for s in sets if len(s)]
        yield pa.RecordBatch.from_arrays(
            [ids, pa.array([set_class(s) for s in sets], pa.int64()), pa.array([len(s) for s in sets], pa.int64()), _lists([s.view(np.int64) for s in sets], pa.int64()), pa.array([signature(s, SKETCH).tobytes() for s in sets], pa.binary())],
            names=["doc_id", "cls", "n", "shingles", "sketch"],
        )


def _cross(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Pairs of one bucket (rows come sorted by bucket) that differ in component and may be similar."""

    def search(key: tuple, rows: list[tuple]) -> list[tuple[int, int]]:
        bucket, i, j = key
        band = bucket >> (8 * ROWS)
        sides = [[r for r in rows if r[0] == k] for k in ((i,) if i == j else (i, j))]
        left, right = sides[0], sides[-1]
        b_cls, b_comp, b_n = (np.array([r[k] for r in right], np.int64) for k in (1, 2, 3))
        b = np.frombuffer(b"".join(r[4] for r in right), np.uint8).reshape(-1, SKETCH)
        out = []
        for at, (_, cls, comp, n, sketch) in enumerate(left):
            may = (b_comp != comp) & (100 * np.minimum(b_n, n) >= SIMILARITY * np.maximum(b_n, n))
            if i == j:
                may[: at + 1] = False
            may = np.flatnonzero(may)
            a = np.frombuffer(sketch, np.uint8)
            may = may[np.count_nonzero(b[may] == a, axis=1) >= AGREE]
            if len(may) and band:
                earlier = (b[may, : ROWS * band] == a[: ROWS * band]).reshape(len(may), band, ROWS).all(axis=2).any(axis=1)
                may = may[~earlier]
            out += [(min(cls, int(x)), max(cls, int(x))) for x in b_cls[may]]
        return out

    key, rows = None, []

    def table(pairs: list[tuple[int, int]]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array([x[k] for x in pairs], pa.int64()) for k in (0, 1)], names=["a", "hub"])

    for batch in batches:
        cols = [batch.column(c).to_pylist() for c in ("bucket", "i", "j", "block", "cls", "comp", "n", "sketch")]
        found: list[tuple[int, int]] = []
        for r in zip(*cols):
            if r[:3] != key:
                if key is not None:
                    found += search(key, rows)
                key, rows = r[:3], []
            rows.append(r[3:])
        if found:
            yield table(found)
    if key is not None and (found := search(key, rows)):
        yield table(found)


def _verified(pairs: DataFrame, sets: DataFrame, folder: str) -> DataFrame:
    """The pairs (a, hub) whose full sets reach the similarity, as (a, b)."""
    hubs = saved(pairs.groupBy("hub").agg(F.count("*").alias("members")), f"{folder}-hubs")
    copies = F.ceil(F.col("members") / HUB_MEMBERS)
    dealt = pairs.join(sized(hubs, hubs.count()), "hub").select("a", "hub", F.pmod(F.xxhash64("a"), copies).alias("copy"))
    left = dealt.join(sets.select(F.col("cls").alias("a"), F.col("n").alias("na"), F.col("shingles").alias("sa")), "a")
    right = hubs.join(sets.select(F.col("cls").alias("hub"), F.col("n").alias("nb"), F.col("shingles").alias("sb")), "hub")
    right = right.select("hub", F.explode(F.sequence(F.lit(0).cast("long"), copies - 1)).alias("copy"), "nb", "sb")
    both = F.size(F.array_intersect("sa", "sb"))
    return left.join(right, ["hub", "copy"]).where(100 * both >= SIMILARITY * (F.col("na") + F.col("nb") - both)).select("a", F.col("hub").alias("b"))


def near_duplicates(docs: DataFrame, folder: str | None = None) -> DataFrame:
    """Per row of ``docs`` (doc_id, text): n_shingles, component_id, kept.

    Words are runs outside [\\x20\\x09-\\x0D] with A-Z in lower case; the set is
    the distinct 5-word shingles, or the whole sequence of fewer words.  Null
    and empty texts have no set and stand alone.  Every row of ``docs`` gets
    one row; rows that repeat a doc_id follow their text.  component_id is the
    smallest doc_id of the component (null ids count last); a row without id
    is kept only where its whole component has none.
    """
    return _judged(docs, folder).drop("version")


def _version(text: Column) -> Column:
    """With the doc_id, what a row is known by: ids may be null or repeated."""
    return F.xxhash64(F.coalesce(text, F.lit("")))


def _judged(docs: DataFrame, folder: str | None) -> DataFrame:
    """near_duplicates, and each row's version."""
    spark: SparkSession = docs.sparkSession
    folder = folder or work_dir(spark, "dedup")
    slim = docs.select(F.col("doc_id").cast("long"), "text")
    signed = saved(mapped(slim.withColumn("version", _version(F.col("text"))), _sign, SIGNED), f"{folder}/signed")

    banded = signed.where("cls is not null").select("cls", "n_shingles", F.explode("bands").alias("bucket"))
    full = saved(banded.groupBy("bucket").agg(F.min("cls").alias("lo"), F.max("cls").alias("hi")).where("lo <> hi").select("bucket"), f"{folder}/buckets")
    members = saved(banded.join(sized(full, full.count()), "bucket").distinct(), f"{folder}/members")

    popular = members.join(members.groupBy("bucket").agg(F.count("*").alias("size")), "bucket").groupBy("cls").agg(F.sum("size").alias("fame"))
    popular = saved(popular, f"{folder}/popular")
    which = signed.join(sized(popular, popular.count()), "cls", "left_semi").groupBy("cls").agg(F.min("doc_id").alias("doc_id"))
    which = saved(which, f"{folder}/which")
    n_which = which.count()
    chosen = sized(which.select(F.col("doc_id").alias("chosen_id")).distinct(), n_which)
    sets = mapped(slim.join(chosen, F.col("doc_id").eqNullSafe(F.col("chosen_id")), "left_semi"), _collect_sets, SETS)
    sets = sets.join(sized(which.select("cls"), n_which), "cls", "left_semi").dropDuplicates(["cls"]).drop("doc_id")
    sets = saved(sets, f"{folder}/sets")

    lead = members.join(popular, "cls").groupBy("bucket").agg(F.max_by(F.struct("cls", "n_shingles"), F.struct("fame", -F.col("cls").cast("decimal(20,0)"))).alias("lead"))
    # sets whose sizes differ too much cannot be similar
    alike = 100 * F.least("n_shingles", "lead.n_shingles") >= SIMILARITY * F.greatest("n_shingles", "lead.n_shingles")
    star = members.join(lead, "bucket").where((F.col("cls") != F.col("lead.cls")) & alike).select(F.col("cls").alias("a"), F.col("lead.cls").alias("hub")).distinct()
    links = saved(_verified(saved(star, f"{folder}/star"), sets, f"{folder}/star"), f"{folder}/links")
    labels = components(links, f"{folder}/first")

    placed = members.join(labels.select(F.col("node").alias("cls"), "label"), "cls", "left").select("bucket", "cls", F.coalesce("label", "cls").alias("comp"))
    mixed = placed.groupBy("bucket").agg(F.min("comp").alias("lo"), F.max("comp").alias("hi"), F.count("*").alias("size")).where("lo <> hi").select("bucket", "size")
    blocks = F.ceil(F.col("size") / BLOCK)
    held = placed.join(mixed, "bucket").withColumn("blocks", blocks).withColumn("block", F.pmod(F.xxhash64("cls"), F.col("blocks")))
    other = F.explode(F.sequence(F.lit(0).cast("long"), F.col("blocks") - 1))
    held = held.select("bucket", "cls", "comp", "block", other.alias("o")).select("bucket", "cls", "comp", "block", F.least("block", "o").alias("i"), F.greatest("block", "o").alias("j"))
    dealt = held.join(sets.select("cls", "n", "sketch"), "cls").repartition("bucket", "i", "j").sortWithinPartitions("bucket", "i", "j")
    more = mapped(dealt.select("bucket", "i", "j", "block", "cls", "comp", "n", "sketch"), _cross, "a long, hub long").distinct()
    extra = saved(_verified(saved(more, f"{folder}/more"), sets, f"{folder}/more"), f"{folder}/extra")
    if not extra.isEmpty():
        labels = components(links.union(extra), f"{folder}/last")

    # ids meet by class first, and only classes of several rows or with links have another's id to learn
    classes = signed.where("cls is not null").groupBy("cls").agg(F.min("doc_id").alias("first_id"), F.count("*").alias("copies"))
    placed = classes.join(labels.select(F.col("node").alias("cls"), "label"), "cls", "left").where("copies > 1 or label is not null")
    placed = saved(placed.select("cls", "first_id", F.coalesce("label", "cls").alias("label")), f"{folder}/placed")
    best = saved(placed.groupBy("label").agg(F.min("first_id").alias("least")), f"{folder}/best")
    named = saved(placed.join(sized(best, best.count()), "label").select("cls", "least"), f"{folder}/named")
    found = signed.select("doc_id", "version", "n_shingles", "cls").join(sized(named.withColumn("known", F.lit(True)), named.count()), "cls", "left")
    component = F.when(F.col("known"), F.col("least")).otherwise(F.col("doc_id"))
    return found.select("doc_id", "version", "n_shingles", component.alias("component_id"), F.coalesce(F.col("doc_id") == component, component.isNull()).alias("kept"))


def one_of_each(docs: DataFrame, folder: str | None = None) -> DataFrame:
    """``docs`` with one document of each near-duplicate group, all columns as they are.

    Rows that repeat a doc_id and a text count as one document.
    """
    folder = folder or work_dir(docs.sparkSession, "dedup")
    result = saved(_judged(docs, folder), f"{folder}/result")
    by = ["id", "version"]
    gone = saved(result.where("not kept").select(F.col("doc_id").alias("id"), "version").distinct(), f"{folder}/gone")
    twice = saved(result.where("kept").groupBy(F.col("doc_id").alias("id"), "version").agg(F.count("*").alias("times")).where("times > 1").select(*by), f"{folder}/twice")

    def same(rows: DataFrame, keys: DataFrame):
        return rows["id"].eqNullSafe(keys["id"]) & (rows["version"] == keys["version"])

    rows = held_rows(docs, id=F.col("doc_id").cast("long"), version=_version(F.col("text")), blank=F.col("text").isNull())
    left = rows.join(sized(gone, gone.count()), same(rows, gone), "left_anti")
    n = twice.count()
    if not n:
        return left.select("row.*")
    again = left.join(sized(twice, n), same(left, twice), "left_semi").dropDuplicates([*by, "blank"])
    return left.join(sized(twice, n), same(left, twice), "left_anti").unionByName(again).select("row.*")


def op8_circulant_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(spark.read.parquet(f"{sf_dir}/documents.parquet"))


OP8_SQL = """
WITH RECURSIVE w AS (
  SELECT doc_id, list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\\x20\\x09-\\x0D]+'), lambda x: x <> '') AS ws
  FROM documents),
s AS MATERIALIZED (
  SELECT DISTINCT doc_id, unnest(CASE WHEN len(ws) = 0 THEN [] WHEN len(ws) < 5 THEN [array_to_string(ws, ' ')]
    ELSE list_transform(range(1, len(ws) - 3), lambda i: array_to_string(ws[i:i + 4], ' ')) END) AS g
  FROM w),
n AS MATERIALIZED (SELECT doc_id, count(*) AS n FROM s GROUP BY 1),
pairs AS MATERIALIZED (
  SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS n_both FROM s a JOIN s b ON a.g = b.g AND a.doc_id < b.doc_id GROUP BY 1, 2),
links AS MATERIALIZED (
  SELECT a, b FROM pairs JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE 100 * n_both >= 75 * (x.n + y.n - n_both)),
edges AS MATERIALIZED (SELECT a, b FROM links UNION SELECT b, a FROM links),
reach AS (SELECT doc_id AS a, doc_id AS b FROM w UNION SELECT r.a, e.b FROM reach r JOIN edges e ON r.b = e.a),
least AS (SELECT a AS doc_id, min(b) AS component_id FROM reach GROUP BY 1)
SELECT w.doc_id, coalesce(n.n, 0)::BIGINT AS n_shingles, least.component_id, w.doc_id = least.component_id AS kept
FROM w LEFT JOIN n USING (doc_id) JOIN least ON least.doc_id = w.doc_id
"""
