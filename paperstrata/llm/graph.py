"""Connected components by minimum labels and pointer jumping, over staged tables."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common as C


def components(edges: DataFrame) -> DataFrame:
    """node, root (smallest node reachable) for all nodes of the edges (a, b); staged.

    Each round gives a node the smallest label among its own, its neighbours' and its label's label. Minimum is a partial
    aggregate, so a node with very many neighbours costs a row per task. Rounds grow with the logarithm of path lengths.
    """
    both = C.stage(edges.select("a", "b").unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b"))).filter("a <> b").distinct())
    labels = C.Stage(both.groupBy("a").agg(F.min("b").alias("m")).select(F.col("a").alias("node"), F.least("a", "m").alias("next")))
    while True:
        now = labels.df.select("node", F.col("next").alias("root"))
        near = both.join(now, both["b"] == now["node"]).groupBy("a").agg(F.min("root").alias("near"))
        step = now.join(near.withColumnRenamed("a", "node"), "node", "left").select("node", "root", F.least("root", "near").alias("best"))
        step = C.Stage(step)
        up = step.df.select(F.col("node").alias("best"), F.col("best").alias("top"))
        nxt = C.Stage(step.df.join(up, "best", "left").select("node", "root", F.least("best", "top").alias("next")))
        changed = nxt.df.filter("root <> next").limit(1).count()
        labels.drop()
        step.drop()
        labels = nxt
        if not changed:
            return labels.df.select("node", F.col("next").alias("root"))
