"""Records that belong together: matched one to one, merged, outranked, reconciled, committed.

Each is a closed form over windows or partial aggregates, so no group is ever
collected: a session of any length streams through a sorted partition.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def first_free(df: DataFrame, item: Column, candidate: Column, by: list[str], order: list[str]) -> DataFrame:
    """``df`` and ``match``: for each item, the ``order`` of the candidate that is its own.

    Rows are met in order; an item takes the earliest candidate before it that no
    item has taken, or none.  With U candidates before the j-th item, the items up
    to it have taken M = j + min(0, least of U - i over the items i up to j), as one
    that goes empty is never made up for; the item takes the M-th candidate if M
    grew with it.  Nulls in ``by`` are a group; rows that tie in order are met in
    any order, so ``order`` should be unique.
    """
    upto = Window.partitionBy(*by).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    is_item, is_candidate = F.coalesce(item, F.lit(False)), F.coalesce(candidate, F.lit(False)) & ~F.coalesce(item, F.lit(False))
    counted = df.select(F.struct("*").alias("_row"), *[F.col(c).alias(f"_by_{k}") for k, c in enumerate(by)], F.struct(*order).alias("_at"), F.count_if(is_candidate).over(upto).alias("_u"), F.count_if(is_item).over(upto).alias("_j"), is_item.alias("_item"), is_candidate.alias("_candidate"))
    keys = [f"_by_{k}" for k in range(len(by))]
    again = Window.partitionBy(*keys).orderBy("_at").rowsBetween(Window.unboundedPreceding, 0)
    slack = F.min(F.when(F.col("_item"), F.col("_u") - F.col("_j"))).over(again)
    taken = counted.withColumn("_m", F.col("_j") + F.least(F.lit(0), slack))
    before = F.coalesce(F.lag("_m").over(Window.partitionBy(*keys).orderBy("_at")), F.lit(0))
    ranked = taken.withColumn("_rank", F.when(F.col("_item") & (F.col("_m") > before), F.col("_m")))
    free = ranked.where("_candidate").select(*[F.col(k).alias(f"{k}_c") for k in keys], F.col("_u").alias("_rank_c"), F.col("_at").alias("match"))
    same = F.col("_rank") == F.col("_rank_c")
    for k in keys:
        same = same & F.col(k).eqNullSafe(F.col(f"{k}_c"))
    return ranked.join(free, same, "left").where("_item").select("_row.*", "match")


def merged(df: DataFrame, by: list[str], attributes: str) -> DataFrame:
    """One row per key: ``attributes``, a map, with the largest value of every name.

    Null values and null maps add nothing; a key with no attribute at all has an
    empty map.  Names are summed up before the shuffle, so a key with many rows
    sends one row per name and task.
    """
    kind = df.schema[attributes].dataType.simpleString()
    each = df.select(*by, F.explode_outer(attributes).alias("_name", "_value"))
    largest = each.groupBy(*by, "_name").agg(F.max("_value").alias("_value"))
    held = F.collect_list(F.when(F.col("_name").isNotNull() & F.col("_value").isNotNull(), F.struct("_name", "_value")))
    return largest.groupBy(*by).agg(F.map_from_entries(F.array_sort(held)).cast(kind).alias(attributes))


def not_outranked(df: DataFrame, by: list[str], rank: str) -> DataFrame:
    """The rows of each key that have its lowest rank; null ranks come last, rows without a key stay."""
    known = F.lit(True)
    for c in by:
        known = known & F.col(c).isNotNull()
    least = df.where(known).groupBy(*[F.col(c).alias(f"_{c}") for c in by]).agg(F.min(rank).alias("_least"))
    same = F.lit(True)
    for c in by:
        same = same & (F.col(c) == F.col(f"_{c}"))
    joined = df.join(least, same, "left")
    stays = F.col("_least").isNull() | F.coalesce(F.col(rank) == F.col("_least"), F.lit(False))
    return joined.where(stays).select(*[F.col(c) for c in df.columns])


def reconciled(df: DataFrame, total: Column, increment: Column, by: list[str], order: list[str]) -> DataFrame:
    """``df`` and ``remainder``: of a row with a cumulative total, what came before does not account for.

    What is accounted for grows by each increment and is never below a total that
    was seen: A = max(A + increment, total).  With S the running sum of increments,
    A - S is the running maximum of total - S, from zero on, so two windows of one
    order do.  Null is no total, or no increment; rows without a total give null.
    """
    w = Window.partitionBy(*by).orderBy(*order)
    sums = F.sum(F.coalesce(increment, F.lit(0))).over(w.rowsBetween(Window.unboundedPreceding, 0))
    led = df.withColumns({"_sums": sums, "_lead": total - sums})
    lead = F.greatest(F.lit(0), F.coalesce(F.max("_lead").over(w.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
    return led.withColumn("remainder", F.when(total.isNotNull(), F.greatest(F.lit(0), total - F.col("_sums") - lead))).drop("_sums", "_lead")


def last_before(marker: Column, among: Column, by: list[str], order: list[str]) -> Column:
    """Whether this row is the last one ``among`` before a marker: the next row that is either is a marker."""
    after = Window.partitionBy(*by).orderBy(*order).rowsBetween(1, Window.unboundedFollowing)
    mark, of = F.coalesce(marker, F.lit(False)), F.coalesce(among, F.lit(False))
    return of & F.coalesce(F.first(F.when(mark | of, mark), ignorenulls=True).over(after), F.lit(False))


def final(df: DataFrame, values: list[str], by: list[str], order: list[str]) -> DataFrame:
    """``df`` with each of ``values`` as it stands last in its group, nulls aside: one partial aggregate and a join."""
    at = F.struct(*order)
    last = df.groupBy(*[F.col(c).alias(f"_{c}") for c in by]).agg(*[F.max_by(v, F.when(F.col(v).isNotNull(), at)).alias(f"_final_{v}") for v in values])
    same = F.lit(True)
    for c in by:
        same = same & F.col(c).eqNullSafe(F.col(f"_{c}"))
    return df.join(last, same, "left").select(*[(F.col(f"_final_{c}").alias(c) if c in values else F.col(c)) for c in df.columns])
