"""Connected components by minimum labels and pointer jumping, all in DataFrames."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import saved


def components(edges: DataFrame, folder: str) -> DataFrame:
    """(a, b) links to (node, label): the smallest node that each node reaches.

    Every round replaces a node's label by the smallest label among its
    neighbours' and its own, then by that label's label, so a chain shrinks to
    about a half or better each round.  Rounds are written to ``folder``.
    Nodes without a link are not returned.
    """
    both = edges.select("a", "b").union(edges.select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct()
    both = saved(both, f"{folder}/edges")
    labels = saved(both.groupBy(F.col("a").alias("node")).agg(F.least(F.first("a"), F.min("b")).alias("label")), f"{folder}/labels0")
    step = 0
    while True:
        step += 1
        near = both.join(labels.select(F.col("node").alias("b"), "label"), "b").groupBy(F.col("a").alias("node")).agg(F.min("label").alias("near"))
        best = labels.join(near, "node").select("node", F.least("label", "near").alias("label"), F.col("label").alias("before"))
        jump = labels.select(F.col("node").alias("label"), F.col("label").alias("next"))
        new = saved(best.join(jump, "label", "left").select("node", F.least("label", "next").alias("label"), "before"), f"{folder}/labels{step}")
        labels = new.select("node", "label")
        if new.where("label <> before").isEmpty():
            return labels
