"""Stored hash trees of manifests: a diff of two versions reads the folders and files whose digests differ, and no others.

Layout. An entry (group, slash-separated name, values) lies in its folder, in one of BUCKETS buckets by the hash of its name, so that
a folder of any number of files is dealt as well. A bucket's digest is the sum of its entries' SHA-256 values in eight lanes of 32
bits, with their number; a folder's is the sum over everything below it. Sums don't depend on order, combine before a shuffle
and need no list of a folder's children. They tell changes from chance, not from an attacker who seeks sums that are equal.
Entries and buckets are stored by shard of a hash, folders by depth and by shard of the folder above, so a set of
differing folders, whatever its size, is at most ``shards`` partitions to read.

Diff. Folders are compared level by level, below differing folders only; then the buckets of the differing folders that hold files;
then the entries of the differing buckets, by ``versions.diff``. There is one round a level of nesting.

Keys are unique and not null, as manifests have them; values may be null. Empty manifests give empty trees. Columns other than
group, name and values aren't stored.
"""

from __future__ import annotations

import functools
import json
import uuid
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from ..session import table
from . import versions
from .tree import checkpoint_folder, staged

BUCKETS, SHARDS = 256, 64
LANES = [f"lane_{i}" for i in range(8)]
DIGEST = ["entries", *LANES]


@dataclass(frozen=True)
class HashTree:
    """The tree stored at ``path``."""

    spark: SparkSession
    path: str

    @classmethod
    def build(cls, manifest: DataFrame, path: str, group: str = "namespace", name: str = "logical_path", values: tuple[str, ...] = ("sha256", "byte_size"), shards: int = SHARDS, buckets: int = BUCKETS) -> HashTree:
        """Writes the tree of ``manifest``. Its description comes last: without one there is no tree."""
        tree, spark = cls(manifest.sparkSession, path), manifest.sparkSession
        above = F.slice(F.split(name, "/"), 1, F.size(F.split(name, "/")) - 1)
        placed = manifest.select(group, name, *values, F.size(above).alias("_depth"), F.array_join(above, "/").alias("_folder"), F.pmod(F.xxhash64(name), F.lit(buckets)).cast("int").alias("_bucket"))
        placed = placed.withColumn("_shard", _shard(shards, group, "_depth", "_folder", "_bucket"))
        placed.repartition("_shard").sortWithinPartitions("_shard", group, "_folder", "_bucket").write.partitionBy("_shard").parquet(f"{path}/entries")
        kind = manifest.select(group, name, *values).schema.jsonValue()
        # read back, so that the two tables below agree with the entries whatever the manifest is read from
        stored = spark.read.schema(placed.schema).parquet(f"{path}/entries")
        code = F.sha2(F.to_json(F.struct(name, *values), {"ignoreNullFields": "false"}), 256)
        lanes = [F.sum(F.conv(F.substring("_code", 8 * i + 1, 8), 16, 10).cast("bigint")).alias(lane) for i, lane in enumerate(LANES)]
        per = stored.withColumn("_code", code).groupBy(group, "_depth", "_folder", "_bucket").agg(F.count(F.lit(1)).alias("entries"), *lanes)
        per = per.withColumn("_shard", _shard(shards, group, "_depth", "_folder"))
        per.repartition("_shard").sortWithinPartitions("_shard", group, "_folder").write.partitionBy("_shard").parquet(f"{path}/buckets")
        rows = spark.read.schema(per.schema).parquet(f"{path}/buckets").groupBy(group, "_depth", "_folder").agg(*(F.sum(c).alias(c) for c in DIGEST))
        # every folder from the top down to the bucket's own
        parts = F.when(F.col("_depth") > 0, F.split("_folder", "/")).otherwise(F.array().cast("array<string>"))
        each = rows.withColumn("_parts", parts).withColumn("_depth", F.explode(F.sequence(F.lit(0), F.col("_depth"))))
        up = lambda depth: F.array_join(F.slice("_parts", 1, depth), "/")
        each = each.withColumn("_folder", up(F.col("_depth"))).withColumn("_above", up(F.greatest(F.col("_depth") - 1, F.lit(0))))
        folders = each.groupBy(group, "_depth", "_folder", "_above").agg(*(F.sum(c).alias(c) for c in DIGEST))
        folders = folders.withColumn("_shard", _shard(shards, group, F.greatest(F.col("_depth") - 1, F.lit(0)), "_above"))
        folders.repartition("_depth", "_shard").write.partitionBy("_depth", "_shard").parquet(f"{path}/folders")
        depths = spark.read.schema(folders.schema).parquet(f"{path}/folders").agg(F.max("_depth")).first()[0]
        about = {"group": group, "name": name, "values": list(values), "shards": shards, "buckets": buckets, "depths": -1 if depths is None else depths, "kind": kind, "tables": {n: t.schema.jsonValue() for n, t in (("entries", placed), ("buckets", per), ("folders", folders))}}
        spark.range(1).select(F.lit(json.dumps(about)).alias("value")).coalesce(1).write.text(f"{path}/about")
        return tree

    @functools.cached_property
    def about(self) -> dict:
        return json.loads(self.spark.read.text(f"{self.path}/about").first()[0])

    def table(self, name: str, shards: list[int] | None = None) -> DataFrame:
        """A stored table: ``entries``, ``buckets`` or ``folders``, all of it or the partitions of ``shards``."""
        stored = self.spark.read.schema(StructType.fromJson(self.about["tables"][name])).parquet(f"{self.path}/{name}")
        return stored if shards is None else stored.filter(F.col("_shard").isin(shards))


@dataclass
class Difference:
    """``rows``: group, name and change (added, removed, changed). ``old`` and ``new``: the entries that were compared for it."""

    rows: DataFrame
    old: DataFrame
    new: DataFrame


def diff(old: HashTree, new: HashTree) -> Difference:
    """What ``versions.diff`` of the two manifests gives."""
    same = ("group", "name", "values", "shards", "buckets", "kind")
    if apart := [k for k in same if old.about[k] != new.about[k]]:
        raise ValueError(f"the trees differ in {', '.join(apart)}")
    group, shards = old.about["group"], old.about["shards"]
    found: DataFrame | None = None
    near: DataFrame | None = None
    for depth in range(max(old.about["depths"], new.about["depths"]) + 1):
        sides = [_below(t, depth, near, group) for t in (old, new)]
        near = staged(_differing(*sides, [group, "_depth", "_folder"]).withColumn("_shard", _shard(shards, group, "_depth", "_folder")))
        if near.isEmpty():
            break
        found = near if found is None else found.unionByName(near)
    if found is None:
        rows = [t.table("entries", []) for t in (old, new)]
    else:
        sides = [_within(t, "buckets", found, [group, "_depth", "_folder"]) for t in (old, new)]
        hit = _differing(*sides, [group, "_depth", "_folder", "_bucket"]).withColumn("_shard", _shard(shards, group, "_depth", "_folder", "_bucket"))
        hit = staged(hit)
        rows = [_within(t, "entries", hit, [group, "_depth", "_folder", "_bucket"]) for t in (old, new)]
    return Difference(versions.diff(*rows, [group, old.about["name"]], tuple(old.about["values"])), *rows)


def _shard(shards: int, *columns: str | Column) -> Column:
    return F.pmod(F.xxhash64(*columns), F.lit(shards)).cast("int")


def _shards_of(rows: DataFrame) -> list[int]:
    """At most as many numbers as the tree has shards."""
    return [r[0] for r in rows.select("_shard").distinct().collect()]


def _within(tree: HashTree, name: str, wanted: DataFrame, keys: list[str]) -> DataFrame:
    """Rows of a stored table that have a key of ``wanted``, from the partitions that can have them."""
    return tree.table(name, _shards_of(wanted)).join(wanted.select(*keys), keys, "left_semi")


def _below(tree: HashTree, depth: int, near: DataFrame | None, group: str) -> DataFrame:
    """Folders of a depth, below those in ``near`` (null: all of them)."""
    rows = tree.table("folders", None if near is None else _shards_of(near)).filter(F.col("_depth") == depth)
    if near is None:
        return rows
    return rows.join(near.select(group, F.col("_folder").alias("_above")), [group, "_above"], "left_semi")


def _differing(old: DataFrame, new: DataFrame, keys: list[str]) -> DataFrame:
    """Keys whose digests differ or that one side lacks."""
    a, b = (t.select(*keys, F.struct(*DIGEST).alias(side)) for t, side in ((old, "_old"), (new, "_new")))
    return a.join(b, keys, "full_outer").filter(~F.col("_old").eqNullSafe(F.col("_new"))).select(*keys)


def _files(spark, d, changed: int | None = None, dropped: int | None = None):
    """Documents as files in folders by language and number."""
    docs = table(spark, d, "documents")
    text = F.col("text") if changed is None else F.when(F.col("doc_id") % changed == 0, F.concat("text", F.lit("!"))).otherwise(F.col("text"))
    name = F.concat("lang", F.lit("/"), F.floor(F.col("doc_id") / 64), F.lit("/d"), "doc_id")
    files = docs.select(F.col("source").alias("namespace"), name.alias("logical_path"), F.sha2(text, 256).alias("sha256"), F.octet_length(text).cast("long").alias("byte_size"), "doc_id")
    return files if dropped is None else files.filter(F.col("doc_id") % dropped != 1)


def _files_sql(changed=None, dropped=None):
    text = "text" if changed is None else f"CASE WHEN doc_id % {changed} = 0 THEN text || '!' ELSE text END"
    where = "" if dropped is None else f" WHERE doc_id % {dropped} <> 1"
    return f"SELECT source AS namespace, lang || '/' || (doc_id // 64) || '/d' || doc_id AS logical_path, sha256({text}) AS sha256, CAST(strlen({text}) AS BIGINT) AS byte_size FROM documents{where}"


def manifest_tree_diff(spark, d):
    """Trees of two versions of the documents, and what differs."""
    old, new = (HashTree.build(files, f"{checkpoint_folder(spark)}/{uuid.uuid4().hex}") for files in (_files(spark, d, None, 211), _files(spark, d, 97, 307)))
    return diff(old, new).rows


QUERIES = {"manifest_tree_diff": (manifest_tree_diff, versions._diff_sql(_files_sql(None, 211), _files_sql(97, 307)))}
