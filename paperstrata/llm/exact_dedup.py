"""Exact dedup: 128-bit content hash groups, one row of each stays, bytes compared inside the groups.

Method. Every text is normalised (A-Z lower-cased, nothing else) and hashed with MD5; hashes, ids and SHA-256 are staged, and
everything but the comparison works on those rows. Hashes of two rows or more are groups, and only texts of those are read
again: they are aggregated by hash *and* normalised text, so Spark compares the bytes of all texts of a hash, and equal texts
collapse before the shuffle, which therefore carries each repeated text about once however large its group is. A hash with
more than one text is a collision; its rows are assigned by text. All other rows are assigned by hash alone.

Skew. A group with a large share of the rows is one row per task after the partial aggregation. For the assignment,
groups of at least 1/HOT_SHARE of all rows (at most HOT_SHARE of them, whatever the input) are broadcast, and all others
meet their rows in a shuffled join.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from . import common as C

HOT_SHARE = 1000
#: Hashes of 16 bytes.
BROADCAST_HASHES = 500_000


def content_hash(text: Column) -> Column:
    return F.unhex(F.md5(text))


def assign(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", keep: str = "smallest", hasher=content_hash) -> DataFrame:
    """One row per input row: the id, keep_id (id of the row of its group that stays), group_size, kept, text_sha256.

    keep: "smallest" or "largest" id of the group. Null text counts as empty; empty texts equal each other. A null id is
    smaller than any other id and stays only in a group without other ids. Of rows that repeat both id and text, exactly one
    can stay. Empty input gives an empty result; other columns of any name are ignored. hasher: replaceable to test
    collisions.
    """
    rows = docs.select(F.col(id_col).alias("id"), C.ascii_lower(C.text_of(text_col)).alias("norm"))
    hashed = rows.select("id", "norm", hasher(F.col("norm")).alias("h"))
    best = F.max("id") if keep == "largest" else F.min("id")
    own = C.stage(hashed.select("id", "h", F.sha2("norm", 256).alias("sha")))
    groups = C.stage(own.groupBy("h").agg(best.alias("keep_id"), F.count(F.lit(1)).alias("group_size")))
    repeated = groups.filter("group_size > 1")
    texts = hashed.join(C.maybe_broadcast(repeated.select("h"), BROADCAST_HASHES), "h", "left_semi")
    collided = texts.groupBy("h", "norm").agg(F.lit(1).alias("one")).groupBy("h").agg(F.count(F.lit(1)).alias("n")).filter("n > 1").select("h")
    collided = C.stage(collided)
    if not collided.limit(1).count():
        out = _by_hash(own, groups)
    else:
        apart = hashed.join(C.maybe_broadcast(collided, BROADCAST_HASHES), "h", "left_semi")
        exact = apart.groupBy("h", "norm").agg(best.alias("keep_id"), F.count(F.lit(1)).alias("group_size"))
        apart = apart.join(exact, ["h", "norm"]).select("id", "h", F.sha2("norm", 256).alias("sha"), "keep_id", "group_size")
        out = _by_hash(own.join(collided, "h", "left_anti"), groups.join(collided, "h", "left_anti")).unionByName(apart)
    nth = F.row_number().over(W.partitionBy("id", "sha").orderBy(F.lit(1)))
    return out.withColumn("nth", nth).select(
        F.col("id").alias(id_col), "keep_id", "group_size", (F.col("id").eqNullSafe(F.col("keep_id")) & (F.col("nth") == 1)).alias("kept"), F.col("sha").alias("text_sha256")
    )


def _by_hash(rows: DataFrame, groups: DataFrame) -> DataFrame:
    total = groups.agg(F.sum("group_size")).first()[0] or 0
    hot = groups.filter(F.col("group_size") >= max(2, total / HOT_SHARE)).select("h", F.col("keep_id").alias("hot_keep"), F.col("group_size").alias("hot_size"))
    rows = rows.join(F.broadcast(hot), "h", "left")  # at most HOT_SHARE rows: their sizes add up to the total at most
    cold = rows.filter(F.col("hot_size").isNull()).select("id", "h", "sha").join(groups.select("h", "keep_id", "group_size").hint("shuffle_merge"), "h")
    return rows.filter(F.col("hot_size").isNotNull()).select("id", "h", "sha", F.col("hot_keep").alias("keep_id"), F.col("hot_size").alias("group_size")).unionByName(cold.select("id", "h", "sha", "keep_id", "group_size"))


def exact_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", keep: str = "smallest") -> DataFrame:
    """``docs`` without the rows that ``assign`` drops; all columns stay as they are. Ids shall be unique: of rows that share
    an id, one of each text can stay."""
    text_hash = F.sha2(C.ascii_lower(C.text_of(text_col)), 256)
    (tag,) = C.fresh(docs, "content_tag")
    kept = assign(docs, id_col, text_col, keep).filter("kept").select(F.col(id_col).alias("kept_id"), F.col("text_sha256").alias("kept_sha"))
    own = docs.withColumn(tag, text_hash)
    joined = own.join(kept.hint("shuffle_merge"), own[id_col].eqNullSafe(F.col("kept_id")) & (own[tag] == F.col("kept_sha")), "left_semi")
    # rows that repeat id and text all match; the first of them stays
    nth = F.row_number().over(W.partitionBy(id_col, tag).orderBy(F.lit(1)))
    (n,) = C.fresh(joined, "nth_copy")
    return joined.withColumn(n, nth).filter(F.col(n) == 1).drop(n, tag)


def op9_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return assign(C.documents(spark, sf_dir), keep="largest").select("doc_id", "keep_id", "group_size", "kept", "text_sha256")


ORACLE = f"""
WITH t AS (SELECT doc_id, translate(coalesce(text, ''), '{C.UPPER}', '{C.UPPER.lower()}') AS norm FROM documents),
g AS (SELECT norm, max(doc_id) AS keep_id, count(*) AS group_size FROM t GROUP BY norm),
n AS (SELECT *, row_number() OVER (PARTITION BY doc_id, norm) AS nth FROM t)
SELECT n.doc_id, g.keep_id, g.group_size, coalesce(n.doc_id = g.keep_id, g.keep_id IS NULL) AND n.nth = 1 AS kept, sha256(n.norm) AS text_sha256
FROM n JOIN g ON n.norm = g.norm
"""
