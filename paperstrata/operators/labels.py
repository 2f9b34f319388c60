"""Interval labels of trees: each node's place in the depth-first order (``enter``) and that of the last node below it (``leave``).

A subtree is then a range of ``enter``, which the statistics of stored files prune, and ancestors are the intervals around a
place. The labels are list ranks of the tour that enters and leaves each node once: links are followed in doubling steps, so
the number of rounds grows with the logarithm of the number of nodes, whatever the depth. No node's children are gathered:
siblings find each other in ranges of a global order, and ranges pass on their first rows only.
"""

from __future__ import annotations

import functools

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from .tree import _T, nodes_of, staged

#: One place of the tour in so many, by hash, is where the first doubling steps end; only these go through all rounds.
SPARSE = 16


def _ranged(rows: DataFrame, *order: str) -> DataFrame:
    """``rows`` in as many ranges of an order as there are shuffle partitions, with the number of the range as _part."""
    tasks = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return staged(rows.repartitionByRange(tasks, *order).withColumn("_part", F.spark_partition_id()))


def _tour(nodes: DataFrame) -> DataFrame:
    """The places (id, out) of the tour, each with a link to the next (to_id, to_out; null at the end) and what it counts: ins, outs."""
    order = ["parent_id", "ordinal", "id"]
    rows = _ranged(nodes, *order)
    heads = rows.groupBy("_part").agg(F.min(F.struct(*order)).alias("head"))  # a row per range
    heads = heads.select(F.lag("_part").over(W.orderBy("_part")).alias("_part"), "head").filter("_part IS NOT NULL")
    after = F.coalesce(F.lead(F.struct(*order)).over(W.partitionBy("_part").orderBy(*order)), F.col("head"))
    placed = rows.join(F.broadcast(heads), "_part", "left").withColumn("next", after)
    placed = placed.select("id", "parent_id", F.when(F.col("next.parent_id").eqNullSafe(F.col("parent_id")), F.col("next.id")).alias("sibling"))
    eldest = rows.filter("parent_id IS NOT NULL").groupBy("parent_id").agg(F.min(F.struct("ordinal", "id"))["id"].alias("child"))
    whole = placed.join(eldest.withColumnRenamed("parent_id", "id"), "id", "left")
    into = F.struct(F.lit(False).alias("out"), F.coalesce("child", "id").alias("to_id"), F.col("child").isNull().alias("to_out"), F.lit(1).cast("long").alias("ins"), F.lit(0).cast("long").alias("outs"))
    away = F.struct(F.lit(True).alias("out"), F.coalesce("sibling", "parent_id").alias("to_id"), F.col("sibling").isNull().alias("to_out"), F.lit(0).cast("long").alias("ins"), F.lit(1).cast("long").alias("outs"))
    return whole.select("id", F.inline(F.array(into, away)))


def _followed(links: DataFrame, stops: Column) -> DataFrame:
    """Each link followed to a place where it stops; those that never get there, since they lead nowhere or round, are left out."""
    links = staged(links)
    done, active = [links.filter(stops)], links.filter(~stops)
    for _ in range(links.count().bit_length()):
        if active.isEmpty():
            break
        whole = functools.reduce(DataFrame.unionByName, [*done, active])
        far = whole.select(F.col("id").alias("to_id"), F.col("out").alias("to_out"), F.col("to_id").alias("_id"), F.col("to_out").alias("_out"), F.col("ins").alias("_ins"), F.col("outs").alias("_outs"))
        step = active.join(far, ["to_id", "to_out"]).select("id", "out", F.col("_id").alias("to_id"), F.col("_out").alias("to_out"), (F.col("ins") + F.col("_ins")).alias("ins"), (F.col("outs") + F.col("_outs")).alias("outs"))
        step = staged(step)
        done.append(step.filter(stops))
        active = step.filter(~stops)
    return functools.reduce(DataFrame.unionByName, done)


def label(nodes: DataFrame) -> DataFrame:
    """Nodes (id, parent_id, ordinal) that a root (null parent) reaches: id, enter, leave, depth.

    Siblings, and roots among each other, go by ordinal (null: 0), then id. Nodes below a missing parent or on a cycle stay out, as
    does a null id; a repeated id is an error. An empty table gives no row. Other columns play no part.
    """
    own = nodes.filter("id IS NOT NULL").select("id", "parent_id", F.coalesce("ordinal", F.lit(0)).cast("int").alias("ordinal"))
    if not own.groupBy("id").count().filter("count > 1").isEmpty():
        raise ValueError("ids are repeated")
    sparse = lambda *place: F.pmod(F.xxhash64(*place), F.lit(SPARSE)) == 0
    end = F.col("to_id").isNull()
    near = staged(_followed(_tour(own), end | sparse("to_id", "to_out")))
    ranks = _followed(near.filter(sparse("id", "out")), end).select(F.col("id").alias("to_id"), F.col("out").alias("to_out"), F.col("ins").alias("_ins"), F.col("outs").alias("_outs"))
    rest = near.filter(~end).join(ranks, ["to_id", "to_out"]).select("id", "out", (F.col("ins") + F.col("_ins")).alias("ins"), (F.col("outs") + F.col("_outs")).alias("outs"))
    left = staged(near.filter(end).select("id", "out", "ins", "outs").unionByName(rest))  # what is still to be entered and left
    n = F.lit(left.agg(F.max("ins")).first()[0] or 0)
    at = lambda out, c: F.max(F.when(F.col("out") == out, F.col(c)))
    return left.groupBy("id").agg((n - at(False, "ins") + 1).alias("enter"), (n - at(True, "ins")).alias("leave"), (at(False, "outs") - at(False, "ins")).cast("int").alias("depth"))


def store(labelled: DataFrame, path: str, files: int) -> DataFrame:
    """Labelled rows written in ranges of ``enter``, so that a search of a range opens the files and row groups it lies in."""
    labelled.repartitionByRange(files, "enter").sortWithinPartitions("enter").write.parquet(path)
    return labelled.sparkSession.read.schema(labelled.schema).parquet(path)


def subtree(labelled: DataFrame, root) -> DataFrame:
    """The node and all below it; an unknown one has none."""
    found = labelled.filter(F.col("id") == root).select("enter", "leave").first()
    return labelled.filter(F.col("enter").between(*found)) if found else labelled.limit(0)


def ancestors(labelled: DataFrame, node) -> DataFrame:
    """The node and all above it; an unknown one has none."""
    found = labelled.filter(F.col("id") == node).select("enter").first()
    return labelled.filter((F.col("enter") <= found[0]) & (F.col("leave") >= found[0])) if found else labelled.limit(0)


def with_ancestors(labelled: DataFrame, match: Column) -> DataFrame:
    """Rows that match (null: no) and all their ancestors: those with a match between enter and leave. One shuffle, in ranges of
    ``enter``; ranges pass on the first match behind them."""
    rows = _ranged(labelled.withColumn("_match", F.when(match, F.col("enter"))), "enter")
    heads = rows.groupBy("_part").agg(F.min("_match").alias("head"))  # a row per range
    heads = heads.select("_part", F.min("head").over(W.orderBy("_part").rowsBetween(1, W.unboundedFollowing)).alias("head"))
    following = F.min("_match").over(W.partitionBy("_part").orderBy("enter").rowsBetween(0, W.unboundedFollowing))
    found = rows.withColumn("_next", following).join(F.broadcast(heads), "_part", "left")
    return found.filter(F.coalesce("_next", "head") <= F.col("leave")).select(*labelled.columns)


def _labelled(s: SparkSession, d: str) -> DataFrame:
    nodes = nodes_of(s, d)
    return staged(nodes.join(label(nodes), "id"))


_N = f"""{_T}, below AS (SELECT id, count(*) AS n FROM (SELECT unnest(tp) AS id FROM t) GROUP BY id),
  l AS (SELECT t.*, row_number() OVER (ORDER BY op, t.id) AS enter, n FROM t JOIN below USING (id))"""

QUERIES = {
    "tree_labels": (lambda s, d: label(nodes_of(s, d)), f"{_N} SELECT id, enter, enter + n - 1 AS leave, len(tp) - 1 AS depth FROM l"),
    "tree_labelled_subtree": (
        lambda s, d: subtree(_labelled(s, d), "r3").select("id", "title", "enter"),
        f"{_N} SELECT id, title, enter FROM l WHERE list_contains(tp, 'r3')",
    ),
    "tree_labelled_filter": (
        lambda s, d: with_ancestors(_labelled(s, d), F.col("title").endswith("7")).select("id", "enter"),
        f"{_N}, w AS (SELECT DISTINCT unnest(tp) AS id FROM l WHERE ends_with(title, '7')) SELECT id, enter FROM l JOIN w USING (id)",
    ),
}
