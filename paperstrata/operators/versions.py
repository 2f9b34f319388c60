"""Versions of content-addressed manifests: diffs, missing blobs, conflicts, hashes, history, retention, publication, caches."""

from __future__ import annotations

import hashlib
import itertools
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W
from pyspark.sql.types import LongType, StringType, StructField, StructType

from ..session import table

KEY = ["namespace", "logical_path"]


class StaleBase(RuntimeError):
    """The version a change is based on is no longer the head."""


def diff(old: DataFrame, new: DataFrame, key: list[str] = KEY, values: tuple[str, ...] = ("sha256", "byte_size")) -> DataFrame:
    """key and change (added, removed, changed) of two manifests; equal entries are left out."""
    a, b = (m.select(*key, F.struct(*values).alias(x)) for m, x in ((old, "_old"), (new, "_new")))
    change = F.when(F.col("_old").isNull(), "added").when(F.col("_new").isNull(), "removed").when(F.col("_old") != F.col("_new"), "changed")
    return a.join(b, key, "full_outer").withColumn("change", change).filter(F.col("change").isNotNull()).select(*key, "change")


def conflicts(base: DataFrame, local: DataFrame, remote: DataFrame, key: list[str] = KEY) -> DataFrame:
    """Keys changed on both sides since the base. If both sides changed but no key is common, all changed keys; if only one
    side changed, none."""
    ours, theirs = (diff(base, side, key).select(*key) for side in (local, remote))
    common = ours.intersect(theirs)
    counts = lambda df, name: df.agg(F.count(F.lit(1)).alias(name))
    state = counts(ours, "_ours").crossJoin(counts(theirs, "_theirs")).crossJoin(counts(common, "_common"))  # one row
    every = ours.withColumn("_side", F.lit(1)).unionByName(theirs.withColumn("_side", F.lit(2))).groupBy(*key).agg(F.count_distinct("_side").alias("_sides"))
    both = every.crossJoin(F.broadcast(state)).filter("_ours > 0 AND _theirs > 0")
    return both.filter("_sides = 2 OR _common = 0").select(*key)


def missing_blobs(manifest: DataFrame, stored: DataFrame) -> DataFrame:
    """Blobs of the manifest that aren't stored in the declared size."""
    return manifest.select("sha256", "byte_size").distinct().join(stored.select("sha256", "byte_size"), ["sha256", "byte_size"], "left_anti")


def unique_blobs(manifest: DataFrame) -> DataFrame:
    """One entry per content: the one with the last path."""
    return manifest.groupBy("sha256").agg(F.max("logical_path").alias("logical_path"), F.max_by("byte_size", "logical_path").alias("byte_size"))


def hash_conflicts(manifest: DataFrame) -> DataFrame:
    """Contents declared with several sizes, and paths declared twice."""
    sizes = manifest.groupBy("sha256").agg(F.count_distinct("byte_size").alias("n")).filter("n > 1").select(F.lit("size").alias("fault"), F.col("sha256").alias("what"))
    paths = manifest.groupBy(*KEY).count().filter("count > 1").select(F.lit("path").alias("fault"), F.col("logical_path").alias("what"))
    return sizes.unionByName(paths)


def manifest_hash(manifest: DataFrame, by: list[str], columns: list[str]) -> DataFrame:
    """One SHA-256 per group over its entries as JSON, in order of their text, a line each. A group is one package."""
    entries = manifest.select(*by, F.to_json(F.struct(*columns)).alias("_entry"))
    return streamed_hash(entries, by, "_entry", ["_entry"]).select(*by, F.col("sha256").alias("package_hash"), F.col("entries").alias("files"))


def streamed_hash(rows: DataFrame, by: list[str], entry: str, order: list[str], head: str = "", between: str = "\n", tail: str = "") -> DataFrame:
    """by, sha256 and entries (their number) per group: the digest of head, the entries (strings, not null) in ``order`` with
    ``between`` between them, and tail, in UTF-8. A group is sorted, which spills, and fed to its digest batch by batch, so
    memory doesn't grow with it. Null is a group key like others; no rows give no groups."""
    keyed = rows.select(*by, F.to_json(F.struct(*by)).alias("_group"), F.col(entry).alias("_fed"), *(F.col(c).alias(f"_order_{i}") for i, c in enumerate(order)))
    ordered = keyed.repartition("_group").sortWithinPartitions("_group", *(f"_order_{i}" for i in range(len(order)))).select(*by, "_group", "_fed")
    kind = StructType([*rows.select(*by).schema.fields, StructField("sha256", StringType()), StructField("entries", LongType())])

    def digests(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        group = digest = first = None
        n = 0

        def done() -> pa.RecordBatch:
            digest.update(tail.encode())
            return pa.RecordBatch.from_arrays([*first.columns, pa.array([digest.hexdigest()]), pa.array([n], pa.int64())], names=[*by, "sha256", "entries"])

        for batch in batches:
            groups, fed, at = batch.column("_group").to_pylist(), batch.column("_fed").to_pylist(), 0
            for name, run in itertools.groupby(groups):
                size = sum(1 for _ in run)
                if name != group:
                    if digest:
                        yield done()
                    group, digest, n, first = name, hashlib.sha256(head.encode()), 0, batch.select(by).slice(at, 1)
                elif n:
                    digest.update(between.encode())
                digest.update(between.join(fed[at : at + size]).encode())
                n, at = n + size, at + size
        if digest:
            yield done()

    return ordered.mapInArrow(digests, kind)


def history(versions: DataFrame, group: str, limit: int, offset: int = 0) -> DataFrame:
    """Newest first (created_at, id), per group: ``limit`` versions from ``offset`` on, and whether there are more."""
    w = W.partitionBy(group).orderBy(F.desc("created_at"), F.desc("id"))
    numbered = versions.withColumn("pos", F.row_number().over(w)).filter(F.col("pos") <= offset + limit + 1)
    more = F.max("pos").over(W.partitionBy(group)) > offset + limit
    return numbered.withColumn("more", more).filter((F.col("pos") > offset) & (F.col("pos") <= offset + limit))


def retained(versions: DataFrame, group: str, newest: int, since, active: DataFrame | None = None) -> DataFrame:
    """Versions to keep: the newest of a group, those created since a time, and active ones (column id)."""
    nth = F.row_number().over(W.partitionBy(group).orderBy(F.desc("created_at"), F.desc("id")))
    kept = versions.withColumn("_nth", nth)
    rule = (F.col("_nth") <= newest) | (F.col("created_at") >= since)
    if active is not None:
        kept = kept.join(active.select("id").distinct().withColumn("_active", F.lit(True)), "id", "left")
        rule = rule | F.coalesce("_active", F.lit(False))
    return kept.filter(rule).drop("_nth", "_active")


def garbage(objects: DataFrame, retained_files: DataFrame, before) -> DataFrame:
    """Stored objects (sha256, modified) that no retained version names and that are older than the grace period."""
    return objects.join(retained_files.select("sha256").distinct(), "sha256", "left_anti").filter(F.col("modified") < before)


@dataclass(frozen=True)
class Head:
    version_id: str | None
    manifest_sha256: str | None = None
    name: str | None = None


def start_push(head: Head, base_id: str | None, manifest: DataFrame, manifest_sha256: str, name: str, stored: DataFrame) -> DataFrame | None:
    """The blobs to upload; None where head already is that manifest. A base other than the head is an error."""
    if head.version_id != base_id:
        raise StaleBase(head.version_id or "none")
    if (head.manifest_sha256, head.name) == (manifest_sha256, name):
        return None
    return missing_blobs(manifest, stored)


def publish(versions: DataFrame, version: dict) -> DataFrame:
    """``versions`` with one more, whose parent must be the newest of its collection. The same id again changes nothing."""
    own = versions.filter(F.col("collection_id") == version["collection_id"])
    if own.filter(F.col("id") == version["id"]).limit(1).count():
        return versions
    head = own.orderBy(F.desc("created_at"), F.desc("id")).limit(1).collect()
    if (head[0]["id"] if head else None) != version["parent_id"]:
        raise StaleBase(head[0]["id"] if head else "none")
    return versions.unionByName(versions.sparkSession.createDataFrame([version], versions.schema))


def rollback(versions: DataFrame, files: DataFrame, source_id: str, version: dict) -> tuple[DataFrame, DataFrame]:
    """Publishes the files of an older version as a new one."""
    again = files.filter(F.col("version_id") == source_id).withColumn("version_id", F.lit(version["id"]))
    return publish(versions, version | {"source_version_id": source_id, "operation": "rollback"}), files.unionByName(again)


def cached(wanted: DataFrame, cache: DataFrame, key: list[str], value: str) -> DataFrame:
    """``wanted`` with the cached value (null: to be made) and reused."""
    own = cache.select(*key, value).dropDuplicates(key)
    return wanted.join(own, key, "left").withColumn("reused", F.col(value).isNotNull())


def carry_over(drafts: DataFrame, previous: DataFrame) -> DataFrame:
    """Identities of drafts (logical_key, source_sha256) from the previous build (with id): by key, else by content where
    exactly one draft and one previous node of that content are left; null otherwise."""
    by_key = drafts.join(previous.select("logical_key", F.col("id").alias("by_key")), "logical_key", "left")
    one = lambda df: df.withColumn("_n", F.count(F.lit(1)).over(W.partitionBy("source_sha256"))).filter("_n = 1").drop("_n")
    left_new = one(by_key.filter(F.col("by_key").isNull()).select("logical_key", "source_sha256"))
    left_old = one(previous.join(drafts.select("logical_key"), "logical_key", "left_anti").select("source_sha256", F.col("id").alias("by_content")))
    by_content = left_new.join(left_old, "source_sha256").select("logical_key", "by_content")
    return by_key.join(by_content, "logical_key", "left").withColumn("id", F.coalesce("by_key", "by_content")).drop("by_key", "by_content")


def latest(rows: DataFrame, key: list[str], order: str) -> DataFrame:
    """An upsert's outcome: the row of each key that comes last in the order."""
    return rows.withColumn("_nth", F.row_number().over(W.partitionBy(*key).orderBy(F.desc(order)))).filter("_nth = 1").drop("_nth")


def _manifest(spark, d, changed: int | None = None, dropped: int | None = None):
    """Documents as files; every changed-th has other content, every dropped-th is gone."""
    docs = table(spark, d, "documents")
    text = F.col("text") if changed is None else F.when(F.col("doc_id") % changed == 0, F.concat("text", F.lit("!"))).otherwise(F.col("text"))
    out = docs.select(F.col("source").alias("namespace"), F.concat(F.lit("d"), F.col("doc_id")).alias("logical_path"), F.sha2(text, 256).alias("sha256"), F.octet_length(text).cast("long").alias("byte_size"), "doc_id")
    return (out if dropped is None else out.filter(F.col("doc_id") % dropped != 1)).drop("doc_id")


def _versions(spark, d):
    return table(spark, d, "orders").select(F.col("o_orderkey").alias("id"), F.col("o_custkey").alias("collection_id"), F.col("o_orderdate").alias("created_at"))


def _sql(changed=None, dropped=None):
    text = "text" if changed is None else f"CASE WHEN doc_id % {changed} = 0 THEN text || '!' ELSE text END"
    return f"SELECT source AS namespace, 'd' || doc_id AS logical_path, sha256({text}) AS sha256, CAST(strlen({text}) AS BIGINT) AS byte_size FROM documents" + ("" if dropped is None else f" WHERE doc_id % {dropped} <> 1")


def _diff_sql(a: str, b: str) -> str:
    return f"""SELECT * FROM (SELECT coalesce(a.namespace, b.namespace) AS namespace, coalesce(a.logical_path, b.logical_path) AS logical_path,
      CASE WHEN a.sha256 IS NULL THEN 'added' WHEN b.sha256 IS NULL THEN 'removed' WHEN a.sha256 <> b.sha256 OR a.byte_size <> b.byte_size THEN 'changed' END AS change
      FROM ({a}) a FULL OUTER JOIN ({b}) b ON a.namespace = b.namespace AND a.logical_path = b.logical_path) WHERE change IS NOT NULL"""


_SINCE = "1998-06-01"
_DRAFTS = "SELECT 'k' || (doc_id % 700) || '/' || doc_id AS logical_key, sha256(text) AS source_sha256, doc_id FROM documents"

QUERIES = {
    "manifest_diff": (lambda s, d: diff(_manifest(s, d, None, 9), _manifest(s, d, 10, 7)), _diff_sql(_sql(None, 9), _sql(10, 7))),
    "three_way_conflicts": (
        lambda s, d: conflicts(_manifest(s, d), _manifest(s, d, 10), _manifest(s, d, 15, 8)),
        f"SELECT a.namespace, a.logical_path FROM ({_diff_sql(_sql(), _sql(10))}) a JOIN ({_diff_sql(_sql(), _sql(15, 8))}) b ON a.namespace = b.namespace AND a.logical_path = b.logical_path",
    ),
    "three_way_apart": (
        lambda s, d: conflicts(_manifest(s, d), _manifest(s, d, 10).filter("logical_path NOT LIKE '%5'"), _manifest(s, d).filter("logical_path NOT LIKE '%3'")).distinct(),
        f"""WITH l AS ({_diff_sql(_sql(), f"SELECT * FROM ({_sql(10)}) WHERE logical_path NOT LIKE '%5'")}), r AS ({_diff_sql(_sql(), f"SELECT * FROM ({_sql()}) WHERE logical_path NOT LIKE '%3'")}),
        c AS (SELECT namespace, logical_path FROM l INTERSECT SELECT namespace, logical_path FROM r)
        SELECT namespace, logical_path FROM (SELECT namespace, logical_path FROM l UNION SELECT namespace, logical_path FROM r) WHERE (SELECT count(*) FROM c) = 0 AND (SELECT count(*) FROM l) > 0 AND (SELECT count(*) FROM r) > 0""",
    ),
    "missing_blobs": (
        lambda s, d: missing_blobs(_manifest(s, d, 10), _manifest(s, d, None, 5)),
        f"SELECT DISTINCT sha256, byte_size FROM ({_sql(10)}) m WHERE NOT EXISTS (SELECT 1 FROM ({_sql(None, 5)}) s WHERE s.sha256 = m.sha256 AND s.byte_size = m.byte_size)",
    ),
    "unique_blobs": (lambda s, d: unique_blobs(_manifest(s, d)), f"SELECT sha256, max(logical_path) AS logical_path, arg_max(byte_size, logical_path) AS byte_size FROM ({_sql()}) GROUP BY sha256"),
    "hash_conflicts": (
        lambda s, d: hash_conflicts(_manifest(s, d).withColumn("byte_size", F.col("byte_size") + F.when(F.col("logical_path").endswith("7"), 1).otherwise(0))),
        f"SELECT 'size' AS fault, sha256 AS what FROM (SELECT sha256, byte_size + CASE WHEN logical_path LIKE '%7' THEN 1 ELSE 0 END AS byte_size FROM ({_sql()})) GROUP BY sha256 HAVING count(DISTINCT byte_size) > 1",
    ),
    "package_hash": (
        lambda s, d: manifest_hash(_manifest(s, d), ["namespace"], ["logical_path", "sha256"]),
        f"SELECT namespace, sha256(string_agg(j, chr(10) ORDER BY j)) AS package_hash, count(*) AS files FROM (SELECT namespace, '{{\"logical_path\":\"' || logical_path || '\",\"sha256\":\"' || sha256 || '\"}}' AS j FROM ({_sql()})) GROUP BY namespace",
    ),
    "version_history_page": (
        lambda s, d: history(_versions(s, d), "collection_id", 3, 2).select("collection_id", "id", "pos", "more"),
        "SELECT * FROM (SELECT o_custkey AS collection_id, o_orderkey AS id, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate DESC, o_orderkey DESC) AS pos, count(*) OVER (PARTITION BY o_custkey) > 5 AS more FROM orders) WHERE pos > 2 AND pos <= 5",
    ),
    "version_prune": (
        lambda s, d: retained(_versions(s, d), "collection_id", 3, F.lit(_SINCE).cast("timestamp"), table(s, d, "orders").filter("o_orderstatus = 'P'").select(F.col("o_orderkey").alias("id"))).select("id", "collection_id"),
        f"SELECT id, collection_id FROM (SELECT o_orderkey AS id, o_custkey AS collection_id, o_orderdate, o_orderstatus, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate DESC, o_orderkey DESC) AS nth FROM orders) WHERE nth <= 3 OR o_orderdate >= TIMESTAMP '{_SINCE}' OR o_orderstatus = 'P'",
    ),
    "object_garbage": (
        lambda s, d: garbage(_manifest(s, d).select("sha256", F.col("logical_path").alias("modified")), _manifest(s, d, None, 3), "d5").select("sha256", "modified"),
        f"SELECT sha256, logical_path AS modified FROM ({_sql()}) WHERE logical_path < 'd5' AND sha256 NOT IN (SELECT sha256 FROM ({_sql(None, 3)}))",
    ),
    "embedding_cache_lookup": (
        lambda s, d: cached(_manifest(s, d).select("sha256", "logical_path"), _manifest(s, d, None, 4).select("sha256", "byte_size"), ["sha256"], "byte_size").select("logical_path", "byte_size", "reused"),
        f"SELECT logical_path, c.byte_size, c.byte_size IS NOT NULL AS reused FROM ({_sql()}) m LEFT JOIN (SELECT DISTINCT sha256, byte_size FROM ({_sql(None, 4)})) c ON m.sha256 = c.sha256",
    ),
    "identity_carry_over": (
        lambda s, d: carry_over(
            table(s, d, "documents").filter("doc_id % 3 <> 0").select(F.concat(F.lit("k"), F.when(F.col("doc_id") % 2 == 0, F.col("doc_id")).otherwise(F.col("doc_id") + 1000000)).alias("logical_key"), F.sha2("text", 256).alias("source_sha256")),
            table(s, d, "documents").filter("doc_id % 5 <> 0").select(F.concat(F.lit("k"), F.col("doc_id")).alias("logical_key"), F.sha2("text", 256).alias("source_sha256"), F.col("doc_id").alias("id")),
        ).select("logical_key", "id"),
        """WITH n AS (SELECT 'k' || CASE WHEN doc_id % 2 = 0 THEN doc_id ELSE doc_id + 1000000 END AS k, sha256(text) AS s FROM documents WHERE doc_id % 3 <> 0),
        p AS (SELECT 'k' || doc_id AS k, sha256(text) AS s, doc_id AS id FROM documents WHERE doc_id % 5 <> 0),
        b AS (SELECT n.k, n.s, p.id FROM n LEFT JOIN p ON n.k = p.k),
        ln AS (SELECT s, any_value(k) AS k FROM b WHERE id IS NULL GROUP BY s HAVING count(*) = 1),
        lo AS (SELECT s, any_value(id) AS id FROM p WHERE k NOT IN (SELECT k FROM n) GROUP BY s HAVING count(*) = 1)
        SELECT b.k AS logical_key, coalesce(b.id, lo.id) AS id FROM b LEFT JOIN ln ON ln.k = b.k LEFT JOIN lo ON lo.s = ln.s""",
    ),
    "upsert_latest": (
        lambda s, d: latest(_versions(s, d), ["collection_id"], "id").select("collection_id", "id"),
        "SELECT o_custkey AS collection_id, max(o_orderkey) AS id FROM orders GROUP BY o_custkey",
    ),
}
