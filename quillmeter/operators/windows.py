"""Order-dependent steps of readers, as window expressions.

All take the partition and order columns of a window; nulls in them are values.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def _over(by: list[str], order: list[str], upto: int | None = None):
    w = Window.partitionBy(*by).orderBy(*order)
    return w if upto is None else w.rowsBetween(Window.unboundedPreceding, upto)


def first_wins(df: DataFrame, key: list[str], order: list[str]) -> DataFrame:
    """The first row of each key."""
    return df.withColumn("_n", F.row_number().over(_over(key, order))).where("_n = 1").drop("_n")


def last_wins(df: DataFrame, key: list[str], order: list[str]) -> DataFrame:
    """The last row of each key, with ``position``: the order value of its first."""
    names = [c for c in df.columns if c not in key]
    rows = df.groupBy(*key).agg(F.max_by(F.struct(*names), F.struct(*order)).alias("_r"), F.min(F.struct(*order)).alias("position"))
    return rows.select(*key, *[F.col("_r")[c].alias(c) for c in names], "position")


def best_of(df: DataFrame, key: list[str], *rank: Column) -> DataFrame:
    """The row of each key that comes first by ``rank``."""
    w = Window.partitionBy(*key).orderBy(*rank)
    return df.withColumn("_n", F.row_number().over(w)).where("_n = 1").drop("_n")


def carried(value: str, by: list[str], order: list[str]) -> Column:
    """The last value that is not null, up to and with this row."""
    return F.last(value, ignorenulls=True).over(_over(by, order, 0))


def previous_is(flag: Column, among: Column, by: list[str], order: list[str]) -> Column:
    """Whether the last row before this one that is ``among`` has ``flag``."""
    return F.coalesce(F.last(F.when(among, flag), ignorenulls=True).over(_over(by, order, -1)), F.lit(False))


def pending(raises: Column, consumes: Column, by: list[str], order: list[str]) -> Column:
    """Whether a row that raises stands before this one, and none since has consumed it."""
    event = F.when(raises, F.lit(True)).when(consumes, F.lit(False))
    return F.coalesce(F.last(event, ignorenulls=True).over(_over(by, order, -1)), F.lit(False))


def deltas(counters: list[str], by: list[str], order: list[str]) -> dict[str, Column]:
    """Increments of cumulative counters; where any of them falls, all start anew."""
    w = _over(by, order)
    before = {c: F.lag(c).over(w) for c in counters}
    reset = F.lit(False)
    for c in counters:
        reset = reset | (F.col(c) < before[c])
    return {c: F.when(before[c].isNull() | reset, F.col(c)).otherwise(F.col(c) - before[c]) for c in counters}


def without_covered(df: DataFrame, covering: DataFrame, key: str) -> DataFrame:
    """Rows of sessions that the covering source does not have."""
    return df.join(covering.select(key).distinct(), key, "left_anti")


def in_lanes(*lanes: DataFrame) -> DataFrame:
    """All rows of the lanes, in order of precedence, with the lane's number."""
    numbered = [df.withColumn("lane", F.lit(k)) for k, df in enumerate(lanes)]
    out = numbered[0]
    for df in numbered[1:]:
        out = out.unionByName(df)
    return out
