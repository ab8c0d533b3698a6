"""Shared plumbing: work folders, tables written between steps, sized broadcasts."""

from __future__ import annotations

import atexit
import shutil
import tempfile
import uuid
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Rows of a few fixed-width columns up to which a side of a join is broadcast.
BROADCAST_ROWS = 500_000
#: Bytes of a batch that a Python worker gets, and Spark's own limit, which it stands for
BATCH_BYTES, _LIMIT, _SPARKS_OWN = 4 << 20, "spark.sql.execution.arrow.maxBytesPerBatch", "67108864b"


def work_dir(spark: SparkSession, name: str) -> str:
    """A new folder below spark.checkpoint.dir.

    Where that is unset a local session gets one of its own; a cluster's
    executors could not see such a folder, so there it is an error.
    """
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        found = spark.sparkContext._jsc.sc().getCheckpointDir()
        if found.isDefined():
            base = found.get()
        elif not (master := spark.sparkContext.master).startswith("local") or master.startswith("local-cluster"):
            raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
        else:
            base = tempfile.mkdtemp(prefix="quillmeter-")
            atexit.register(shutil.rmtree, base, ignore_errors=True)
            spark.sparkContext.setCheckpointDir(base)
    return f"{base.rstrip('/')}/quillmeter/{name}-{uuid.uuid4().hex[:12]}"


def saved(df: DataFrame, path: str) -> DataFrame:
    """Write and reread: cuts lineage, and survives lost executors as the folder is shared."""
    df.write.mode("overwrite").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def sized(df: DataFrame, rows: int, limit: int = BROADCAST_ROWS) -> DataFrame:
    """``df`` with a broadcast hint if its counted rows are within ``limit``; else as it is."""
    return F.broadcast(df) if rows <= limit else df


def mapped(df: DataFrame, run: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]], schema) -> DataFrame:
    """mapInArrow in batches of about BATCH_BYTES, however long the rows are.

    The limit is a setting of the session; one that was changed before stays.
    """
    conf = df.sparkSession.conf
    if conf.get(_LIMIT) == _SPARKS_OWN:
        conf.set(_LIMIT, str(BATCH_BYTES))
    return df.mapInArrow(run, schema)


def held_rows(docs: DataFrame, **keys: Column) -> DataFrame:
    """``docs`` as one struct column ``row`` beside the keys: no name of theirs can clash with a key's."""
    return docs.select(F.struct("*").alias("row"), *[c.alias(name) for name, c in keys.items()])


def words_array(text: Column, pattern: str) -> Column:
    """The words of a text as maximal runs outside ``pattern`` (a separator class); null: none."""
    return F.filter(F.split(F.coalesce(text, F.lit("")), pattern), lambda w: w != "")


def lower_ascii(text: Column) -> Column:
    """A-Z in lower case, every other character as it is."""
    return F.translate(text, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def held_out(doc_id: Column) -> Column:
    """crc32 of the id as text is a multiple of five."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 5 == 0, F.lit(False))
