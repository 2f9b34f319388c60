"""What comes in and how it is taken up: files and their parsers, archives, manifests, uploads, publication, requests."""

from __future__ import annotations

import contextlib
import json
import math
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from ..session import table
from ..sources import archives, files, sinks
from ..sources.table_log import Conflict, TableLog, changes, put_if_absent
from ..streaming.ingest import ingest
from . import checks, versions
from .tree import checkpoint_folder, page_list

#: suffix: (parser, setting that turns it off).
PARSERS = {"pdf": ("pdf", None), "md": ("markdown", "text"), "markdown": ("markdown", "text"), "txt": ("markdown", "text"), "csv": ("csv", "tables")}


def route(path: Column, settings: Column) -> Column:
    """The parser of a file by its suffix, under settings (struct of text, images, tables: auto or off). What is turned off, or
    has no parser, is kept as a file; a PDF only if all three are off."""
    suffix, off = F.lower(F.regexp_extract(path, r"\.([^./]+)$", 1)), lambda s: F.coalesce(settings[s] == "off", F.lit(False))
    out = F.lit("file")
    for name, (parser, setting) in PARSERS.items():
        closed = off(setting) if setting else off("text") & off("images") & off("tables")
        out = F.when((suffix == name) & ~closed, F.lit(parser)).otherwise(out)
    return out


def generic_nodes(inputs: DataFrame) -> DataFrame:
    """Files (path, sha256) without a parser as nodes: title, kind file, extension (bin if none) and a warning."""
    name = F.element_at(F.split("path", "/"), -1)
    extension = F.regexp_extract(name, r".\.([^.]+)$", 1)
    return inputs.select(F.col("path").alias("key"), name.alias("title"), F.lit("file").alias("kind"), "sha256", F.when(extension == "", "bin").otherwise(extension).alias("extension"), F.array(F.lit("no specialised parser; kept as a file")).alias("warnings"))


def listed(found: DataFrame, items: DataFrame, reserved: tuple[str, ...] = checks.RESERVED) -> DataFrame:
    """Files (path, is_link) that are taken up, in byte order of their paths as ``place``: no links, nothing in reserved folders
    or below ignored items (path, ignore), hidden ones only where an item names them or a hidden folder above."""
    ignored = items.filter("ignore").select("path")
    named = items.filter("NOT ignore").select("path")
    above = F.transform(F.sequence(F.lit(1), F.size(F.split("path", "/"))), lambda n: F.array_join(F.slice(F.split("path", "/"), 1, n), "/"))
    prefixes = found.select("path", F.explode(above).alias("_above"))
    dropped = prefixes.join(ignored.select(F.col("path").alias("_above")).distinct(), "_above", "left_semi").select("path").distinct()
    shown = prefixes.join(named.select(F.col("path").alias("_above")).distinct(), "_above", "left_semi").filter((F.col("_above") == F.col("path")) | F.col("_above").rlike(r"(^|/)\.")).select("path").distinct().withColumn("_shown", F.lit(True))
    parts = F.split("path", "/")
    hidden = F.exists(parts, lambda p: p.startswith("."))
    kept = found.filter(~F.arrays_overlap(parts, F.array(*map(F.lit, reserved))) & ~F.coalesce("is_link", F.lit(False))).join(dropped, "path", "left_anti").join(shown, "path", "left")
    kept = kept.filter(~hidden | F.coalesce("_shown", F.lit(False))).drop("_shown")
    # files of one folder are numbered together; the folders' order comes from their names
    return kept.withColumn("place", F.row_number().over(W.partitionBy(F.regexp_replace("path", "[^/]*$", "")).orderBy(F.encode("path", "UTF-8"))))


def corpus_pairs(found: DataFrame) -> DataFrame:
    """Folders (folder) of files (path) with exactly one PDF and an output.md, from a folder whose name ends in -run if there is
    one: folder, pdf, output. Others are left out."""
    folder = F.regexp_extract("path", "^([^/]*)/", 1)
    run = F.regexp_extract("path", "([^/]*)/[^/]*$", 1)
    rows = found.withColumn("folder", folder).filter("folder <> ''")
    is_pdf, is_output = F.lower("path").endswith(".pdf"), F.col("path").endswith("/output.md")
    one = rows.groupBy("folder").agg(F.count(F.when(is_pdf, 1)).alias("n"), F.min(F.when(is_pdf, F.col("path"))).alias("pdf"), F.min(F.when(is_output, F.struct((~run.endswith("-run")).alias("other"), "path"))).alias("o"))
    return one.filter("n = 1 AND o IS NOT NULL").select("folder", "pdf", F.col("o.path").alias("output"))


def archive_faults(entries: DataFrame) -> DataFrame:
    """Archive entries (archive, name, is_link) that may not be unpacked: repeated, absolute, upward, or links."""
    rows = entries.withColumn("_n", F.count(F.lit(1)).over(W.partitionBy("archive", "name"))).withColumn("at", F.concat_ws(":", "archive", "name"))
    return checks.faults(rows, "at", {"repeated": F.col("_n") > 1, "absolute": F.col("name").startswith("/"), "upward": F.col("name").rlike(r"(^|/)\.\.(/|$)|\\"), "link": F.col("is_link")})


def read_items(spark: SparkSession, text: str, spec: str) -> DataFrame:
    """Items (path, ignore, fields, part_of, derived_from, first, last, quality) of an input manifest: front matter with ``spec``
    and a mapping of items. A manifest is one small file, read by the driver."""
    parts = text.split("---", 2)
    if "\r" in text or len(parts) != 3 or parts[0]:
        raise ValueError("a manifest starts with front matter and has \\n line ends")
    value = files.front_matter(parts[1])
    if value.get("spec") != spec or set(value) - {"spec", "collection", "items"}:
        raise ValueError("the manifest has another form")
    rows = []
    for path, item in (value.get("items") or {}).items():
        first, last = item.get("pages") or (None, None)
        rows.append((path, bool(item.get("ignore", False)), len(set(item) - {"ignore"}), item.get("part_of"), item.get("derived_from"), first, last, "quality" in item))
    return spark.createDataFrame(rows, "path string, ignore boolean, fields int, part_of string, derived_from string, first long, last long, quality boolean")


def read_transport(spark: SparkSession, path: str) -> DataFrame:
    """Files (namespace, logical_path, sha256, byte_size, media_type) of a transport manifest in JSON."""
    kind = "spec string, package_root string, files array<struct<namespace:string,logical_path:string,sha256:string,byte_size:bigint,media_type:string>>"
    return spark.read.schema(kind).option("multiLine", True).json(path).select(F.explode("files").alias("f")).select("f.*")


def canonical(manifest: DataFrame, by: str, spec: str, columns: list[str]) -> DataFrame:
    """Per package, its manifest as canonical JSON (sorted keys, no spaces, files in order) and the SHA-256 of that."""
    entry = F.struct(*sorted(columns))
    one = manifest.groupBy(by).agg(F.array_sort(F.collect_list(entry)).alias("files"))
    return one.select(by, F.to_json(F.struct("files", F.lit(spec).alias("spec"))).alias("json")).withColumn("sha256", F.sha2("json", 256))


def canonical_hash(manifest: DataFrame, by: str, spec: str, columns: list[str]) -> DataFrame:
    """The SHA-256 of ``canonical`` without the text itself, for packages of any size."""
    entries = manifest.select(by, *(c for c in columns if c != by), F.to_json(F.struct(*sorted(columns))).alias("_entry"))
    tail = json.dumps({"spec": spec}, separators=(",", ":"), ensure_ascii=False)[1:]
    return versions.streamed_hash(entries, [by], "_entry", sorted(columns), '{"files":[', ",", f"],{tail}").select(by, "sha256")


def numbered(rows: DataFrame, file: str, order: str) -> DataFrame:
    """``rows`` with row_number from 1 within their file, in the order of a column."""
    return rows.withColumn("row_number", F.row_number().over(W.partitionBy(file).orderBy(order)))


def read_numbered_csv(spark: SparkSession, path: str) -> DataFrame:
    """A strict CSV table with row_number from 1 per file, however many tasks read the file."""
    return files.read_csv(spark, path, row_number="row_number")


def sessions(uploads: DataFrame, now: Column, hours: int = 24) -> DataFrame:
    """Upload sessions (id, collection, created_at, state) with ``live``: open and younger than ``hours``."""
    return uploads.withColumn("live", (F.col("state") == "open") & (F.col("created_at") > now - F.expr(f"INTERVAL {hours} HOURS")))


def searchable(collections: DataFrame, uploads: DataFrame) -> DataFrame:
    """Collections without a live import: semantic search waits for the others (uploads as ``sessions`` gives them)."""
    return collections.join(uploads.filter("live").select("collection").distinct(), "collection", "left_anti")


def repairs(attempts: DataFrame, most: int = 3) -> DataFrame:
    """Attempts (item, nth, ok) to the state of each item: done (the last attempt succeeded), failed (``most`` failed), else retry
    with the number of the next attempt."""
    per = attempts.groupBy("item").agg(F.max("nth").alias("nth"), F.max_by("ok", "nth").alias("ok"), F.count(F.when(~F.col("ok"), 1)).alias("bad"))
    state = F.when(F.col("ok"), "done").when(F.col("bad") >= most, "failed").otherwise("retry")
    return per.select("item", state.alias("state"), F.when(state == "retry", F.col("nth") + 1).alias("next"))


def collection_of(paths: DataFrame, roots: DataFrame) -> DataFrame:
    """Paths with the nearest folder above (or the path itself) that is a collection's root (path, id); null if none is."""
    parts = F.split("path", "/")
    above = F.transform(F.sequence(F.lit(1), F.size(parts)), lambda n: F.struct(n.alias("n"), F.array_join(F.slice(parts, 1, n), "/").alias("at")))
    each = paths.select("path", F.explode(above).alias("a")).select("path", "a.n", F.col("a.at").alias("_root"))
    hit = each.join(roots.select(F.col("path").alias("_root"), "id"), "_root").groupBy("path").agg(F.max_by("id", "n").alias("collection"))
    return paths.join(hit, "path", "left")


def nested_roots(roots: DataFrame) -> DataFrame:
    """Collections (path, id) below another collection's root, which isn't allowed."""
    return collection_of(roots.select(F.regexp_replace("path", "/?[^/]*$", "").alias("path"), F.col("path").alias("root")), roots).filter("collection IS NOT NULL").select(F.col("root").alias("path"), "collection")


def request_faults(requests: DataFrame) -> DataFrame:
    """Search requests (id, query, mode, limit, candidate_limit, threshold) out of the ranges that ``search.Options`` allows."""
    within = lambda c, a, b: F.col(c).between(a, b)
    return checks.faults(
        requests,
        "id",
        {
            "query": (F.trim("query") == "") | (F.char_length("query") > 1000),
            "mode": ~F.col("mode").isin("lexical", "semantic", "hybrid"),
            "limit": ~within("limit", 1, 50),
            "candidate_limit": ~within("candidate_limit", 10, 500) | (F.col("candidate_limit") < F.col("limit")),
            "threshold": ~within("threshold", -1, 1),
        },
    )


def publish_folder(spark: SparkSession, df: DataFrame, target: str) -> None:
    """Replaces a folder's table as a whole: written beside it first, then swapped by renames. If the swap fails, the old one is
    put back. Readers see the old or the new table, or for the moment between two renames none."""
    at = spark._jvm.org.apache.hadoop.fs.Path
    staging, backup = at(f"{target}.staging-{uuid.uuid4().hex}"), at(f"{target}.backup-{uuid.uuid4().hex}")
    fs = staging.getFileSystem(spark._jsc.hadoopConfiguration())
    df.write.parquet(staging.toString())
    had = fs.exists(at(target))
    if had and not fs.rename(at(target), backup):
        raise RuntimeError(f"{target} can't be moved away")
    if not fs.rename(staging, at(target)):
        if had:
            fs.rename(backup, at(target))
        raise RuntimeError(f"{target} can't be put in place")
    if had:
        fs.delete(backup, True)


def claim_head(spark: SparkSession, folder: str, collection: str, parent: str | None, version: str) -> bool:
    """The conditional write of a publication: whether ``version`` is now the one that follows ``parent``. The claim is a file
    named by collection and parent, complete before it is visible and created only if it isn't there, so of several writers one
    wins; the winner may claim again. A writer that dies before its claim is visible has claimed nothing."""
    path = f"{folder}/{collection}/after-{parent or 'none'}.json"
    if put_if_absent(spark, path, json.dumps({"version": version})):
        return True
    said = spark.read.text(path).first()
    return said is not None and json.loads(said[0])["version"] == version


def commit(spark: SparkSession, heads: str, history: DataFrame, version: dict, manifest: DataFrame, stored: DataFrame) -> DataFrame:
    """Publishes an upload: all blobs must be stored in their declared size and the parent must still be the head; then the
    claim decides between writers. Returns the history with the version; the same version again changes nothing."""
    if not versions.missing_blobs(manifest, stored).isEmpty():
        raise ValueError("blobs are missing")
    out = versions.publish(history, version)
    if not claim_head(spark, heads, version["collection_id"], version["parent_id"], version["id"]):
        raise versions.StaleBase(version["parent_id"] or "none")
    return out


def _scratch(spark: SparkSession) -> str:
    return f"{checkpoint_folder(spark)}/{uuid.uuid4().hex}"


def _csv_again(s, d):
    at = _scratch(s)
    sinks.write_csv(table(s, d, "part").select(F.col("p_partkey").cast("string").alias("key"), F.concat("p_name", F.lit(', "'), "p_brand", F.lit('"\n'), "p_name").alias("text")), at)
    return files.read_csv(s, at)


#: Rows of a CSV file that one task sorts and writes.
FILE_ROWS = 100_000


def _csv_numbers(s, d):
    """Rows in files of about FILE_ROWS, numbered as they were written; every comment is quoted and holds line breaks."""
    at = _scratch(s)
    text = F.concat(F.lit("a\n\n"), "o_orderpriority", F.lit(' "x",\n'))
    rows = table(s, d, "orders").select(F.col("o_orderkey").cast("string").alias("key"), text.alias("text"))
    n = max(2, math.ceil(rows.count() / FILE_ROWS))
    sinks.write_csv(rows.repartition(n, "key").sortWithinPartitions(F.col("key").cast("long")), at)
    rows = files.read_csv(s, at, row_number="n", file_name="file").repartition(n, "file")
    place = F.row_number().over(W.partitionBy("file").orderBy(F.col("key").cast("long")))
    return rows.withColumn("place", place).select(F.col("key").cast("long").alias("key"), "text", (F.col("n") == F.col("place")).alias("in_order"))


def _archives_again(s, d):
    """Documents into archives of 64 files, and out again."""
    docs = table(s, d, "documents").select(archives.archive_name(F.col("doc_id"), 64).alias("archive"), F.concat_ws("/", "lang", F.col("doc_id").cast("string")).alias("path"), F.col("text").cast("binary").alias("content"))
    return archives.unpacked(archives.packed(docs)).select("archive", "path", F.sha2("content", 256).alias("sha256"), F.length("content").alias("byte_size"))


def _jsonl_again(s, d):
    at = _scratch(s)
    table(s, d, "part").select("p_partkey", "p_name").write.json(at)
    return files.read_jsonl(s, at, "p_partkey long, p_name string", True)


def _texts_again(s, d):
    at = _scratch(s)
    table(s, d, "region").select("r_name").repartition(5, "r_name").write.text(at, lineSep="\r\n")
    return files.read_text(s, at).select("text").filter("text <> ''").select(F.explode(F.split("text", "\n")).alias("name")).filter("name <> ''")


def _objects(s, d):
    return table(s, d, "documents").select("doc_id", F.sha2("text", 256).alias("sha256"), F.octet_length("text").cast("long").alias("byte_size"), F.col("text").cast("binary").alias("content"))


def _put_again(s, d):
    at = _scratch(s)
    sinks.put_objects(s, at, _objects(s, d).filter("doc_id % 3 = 0").drop("doc_id"))
    return sinks.put_objects(s, at, _objects(s, d).drop("doc_id")).select("sha256", "byte_size")


def _replaced_again(s, d):
    at, orders = _scratch(s), table(s, d, "orders").select("o_orderkey", "o_orderstatus", F.lit(1).alias("turn"))
    sinks.replace_partitions(orders, at, "o_orderstatus")
    sinks.replace_partitions(orders.filter("o_orderstatus = 'F'").withColumn("turn", F.lit(2)), at, "o_orderstatus")
    return s.read.parquet(at)


def _published_again(s, d):
    at = _scratch(s)
    for turn in (1, 2):
        publish_folder(s, table(s, d, "part").select("p_partkey", F.lit(turn).alias("turn")), at)
    return s.read.parquet(at)


def _transport_again(s, d):
    at, files_ = _scratch(s), table(s, d, "supplier").select(F.lit("raw").alias("namespace"), F.col("s_name").alias("logical_path"), F.sha2("s_name", 256).alias("sha256"), F.col("s_suppkey").alias("byte_size"), F.lit("text/plain").alias("media_type"))
    files_.agg(F.collect_list(F.struct(*files_.columns)).alias("files")).select(F.lit("v1").alias("spec"), F.lit("p").alias("package_root"), "files").write.json(at)
    return read_transport(s, at)


def _ingested_again(s, d):
    source, target, done = _scratch(s), _scratch(s), _scratch(s)
    orders = table(s, d, "orders").select("o_orderkey", "o_orderstatus")
    for part in (orders.filter("o_orderkey % 2 = 0"), orders.filter("o_orderkey % 2 = 1 AND o_orderstatus = 'F'")):  # the second batch replaces one partition
        part.write.mode("append").parquet(source)
        ingest(s, source, "o_orderkey long, o_orderstatus string", target, "o_orderstatus", done).awaitTermination()
    return s.read.parquet(target).select("o_orderkey", "o_orderstatus")


def _claims_again(s, d):
    heads, history = _scratch(s), s.createDataFrame([], "id string, collection_id string, parent_id string, created_at int")
    blobs, out = _push(s, d).cache(), []
    for n, (version, parent) in enumerate((("v1", None), ("v2", None), ("v2", "v1"), ("v2", "v1"))):
        try:
            after = commit(s, heads, history, {"id": version, "collection_id": "c", "parent_id": parent, "created_at": n}, blobs, blobs)
            history, said = after, "published"
        except versions.StaleBase as e:
            said = f"stale: {e}"
        out.append((n, version, said, history.count()))
    out += [(len(out), "v3", str(claim_head(s, heads, "c", "v1", "v3")).lower(), history.count())]
    turns = s.createDataFrame(out, "turn int, version string, said string, versions long")
    sizes = blobs.agg(F.count(F.lit(1)).alias("blobs"), F.sum("byte_size").alias("bytes"))
    return turns.join(F.broadcast(sizes))  # one row


def _log_again(s, d):
    """Documents by language: two appends, an overwrite from a stale version, a replacement that is sent twice."""
    log, docs = TableLog(s, _scratch(s), ("lang",)), table(s, d, "documents").select("doc_id", "lang", F.lit(1).alias("turn"))
    log.commit(docs.filter("lang <> 'fr'"))
    log.commit(docs.filter("lang = 'fr'"))
    with contextlib.suppress(Conflict):
        log.commit(docs.withColumn("turn", F.lit(9)), "overwrite", expected=0)
    for _ in range(2):
        log.commit(docs.filter("lang = 'de'").withColumn("turn", F.lit(2)), "replace", txn="de again")
    first = log.read(0).select("doc_id", F.col("turn").alias("was"))
    return log.read().join(first, "doc_id", "left").select("doc_id", "turn", "was", F.lit(log.version()).alias("version"))


def _log_changes(s, d):
    """What a replacement changed, by key: orders of status F with another priority, and without those of 1-URGENT."""
    log = TableLog(s, _scratch(s), ("o_orderstatus",))
    orders = table(s, d, "orders").select("o_orderkey", "o_orderpriority", "o_orderstatus")
    log.commit(orders)
    log.commit(orders.filter("o_orderstatus = 'F' AND o_orderpriority <> '1-URGENT'").withColumn("o_orderpriority", F.regexp_replace("o_orderpriority", "^5", "6")), "replace")
    return changes(log, 0, ["o_orderkey"])


def _inputs(s, d):
    k = F.col("o_orderkey")
    top = F.when(k % 13 == 0, ".git").when(k % 11 == 0, ".hid").when(k % 7 == 0, "skip").otherwise("in")
    name = F.concat(F.when(k % 17 == 0, ".").otherwise(""), F.lit("f"), k.cast("string"))
    return table(s, d, "orders").select(F.concat_ws("/", top, (k % 10).cast("string"), name).alias("path"), (k % 19 == 0).alias("is_link"))


_IN = "SELECT o_orderkey AS k, concat_ws('/', CASE WHEN o_orderkey % 13 = 0 THEN '.git' WHEN o_orderkey % 11 = 0 THEN '.hid' WHEN o_orderkey % 7 = 0 THEN 'skip' ELSE 'in' END, CAST(o_orderkey % 10 AS VARCHAR), CASE WHEN o_orderkey % 17 = 0 THEN '.' ELSE '' END || 'f' || o_orderkey) AS path FROM orders"
_SUFFIX = "CASE p_partkey % 6 WHEN 0 THEN '.pdf' WHEN 1 THEN '.MD' WHEN 2 THEN '.csv' WHEN 3 THEN '.txt' WHEN 4 THEN '.png' ELSE '' END"


def _parts(s, d):
    k = F.col("p_partkey")
    suffix = F.element_at(F.array(*map(F.lit, (".pdf", ".MD", ".csv", ".txt", ".png", ""))), (k % 6 + 1).cast("int"))
    off = lambda n: F.when(k % n == 0, "off").otherwise("auto")
    return table(s, d, "part").select("p_partkey", F.concat(F.lit("a/"), k.cast("string"), suffix).alias("path"), F.struct(off(5).alias("text"), off(2).alias("images"), off(4).alias("tables")).alias("settings"), F.sha2("p_name", 256).alias("sha256"))


def _manifest(s, d):
    return table(s, d, "documents").select("source", F.concat(F.lit("d/"), F.col("doc_id").cast("string")).alias("path"), F.sha2("text", 256).alias("sha256"))


def _history(s, d):
    return table(s, d, "orders").filter("o_custkey % 100 = 1").select(F.col("o_orderkey").cast("string").alias("id"), F.col("o_custkey").cast("string").alias("collection_id"), F.lit(None).cast("string").alias("parent_id"), "o_orderdate", F.lit(None).cast("string").alias("operation"), F.lit(None).cast("string").alias("source_version_id")).withColumnRenamed("o_orderdate", "created_at")


def _rolled_back(s, d):
    kept = table(s, d, "lineitem").select(F.col("l_orderkey").cast("string").alias("version_id"), F.col("l_partkey").alias("path"))
    return versions.rollback(_history(s, d).limit(0), kept, "1", {"id": "new", "collection_id": "c", "parent_id": None, "created_at": None})[1]


def _push(s, d):
    own = _objects(s, d).select("sha256", "byte_size")
    return versions.start_push(versions.Head("v1", "old", "n"), "v1", own, "new", "n", _objects(s, d).filter("doc_id % 4 <> 0").select("sha256", "byte_size"))


QUERIES = {
    "parser_routes": (
        lambda s, d: _parts(s, d).select("p_partkey", route(F.col("path"), F.col("settings")).alias("parser")),
        "SELECT p_partkey, CASE WHEN p_partkey % 6 = 0 AND NOT (p_partkey % 5 = 0 AND p_partkey % 4 = 0) THEN 'pdf' WHEN p_partkey % 6 IN (1, 3) AND p_partkey % 5 > 0 THEN 'markdown' WHEN p_partkey % 6 = 2 AND p_partkey % 4 > 0 THEN 'csv' ELSE 'file' END AS parser FROM part",
    ),
    "generic_nodes": (
        lambda s, d: generic_nodes(_parts(s, d).filter(route(F.col("path"), F.col("settings")) == "file")).select("key", "title", "kind", "extension", F.size("warnings").alias("warnings")),
        f"SELECT 'a/' || p_partkey || e AS key, p_partkey || e AS title, 'file' AS kind, CASE WHEN e = '' THEN 'bin' ELSE e[2:] END AS extension, 1 AS warnings FROM (SELECT p_partkey, {_SUFFIX} AS e FROM part) WHERE p_partkey % 6 > 3 OR p_partkey % 60 = 0 OR p_partkey % 6 IN (1, 3) AND p_partkey % 5 = 0 OR p_partkey % 6 = 2 AND p_partkey % 4 = 0",
    ),
    "listed_inputs": (
        lambda s, d: listed(_inputs(s, d), s.createDataFrame([("skip", True), (".hid/3", False), ("in/4/.f34", False)], "path string, ignore boolean")).select("path", "place"),
        f"""SELECT path, row_number() OVER (PARTITION BY regexp_replace(path, '[^/]*$', '') ORDER BY path) AS place FROM ({_IN}) WHERE k % 19 <> 0 AND NOT starts_with(path, '.git') AND NOT starts_with(path, 'skip/')
        AND (NOT regexp_matches(path, '(^|/)\\.') OR starts_with(path, '.hid/3/') OR path = 'in/4/.f34')""",
    ),
    "corpus_pairs": (
        lambda s, d: (lambda o: corpus_pairs(o.select(F.concat(F.lit("c"), F.col("o_custkey").cast("string"), F.when(F.col("o_orderkey") % 4 == 0, F.concat(F.lit("/"), F.col("o_orderkey").cast("string"), F.lit(".PDF"))).when(F.col("o_orderkey") % 4 == 1, F.concat(F.lit("/"), F.col("o_orderkey").cast("string"), F.lit("-run/output.md"))).otherwise(F.concat(F.lit("/"), F.col("o_orderkey").cast("string"), F.lit("/output.md")))).alias("path"))))(table(s, d, "orders")),
        """SELECT 'c' || o_custkey AS folder, min('c' || o_custkey || '/' || o_orderkey || '.PDF') FILTER (o_orderkey % 4 = 0) AS pdf, coalesce(min('c' || o_custkey || '/' || o_orderkey || '-run/output.md') FILTER (o_orderkey % 4 = 1), min('c' || o_custkey || '/' || o_orderkey || '/output.md') FILTER (o_orderkey % 4 > 1)) AS output
        FROM orders GROUP BY o_custkey HAVING count(*) FILTER (o_orderkey % 4 = 0) = 1 AND count(*) FILTER (o_orderkey % 4 > 0) > 0""",
    ),
    "archive_faults": (
        lambda s, d: archive_faults(table(s, d, "lineitem").select((F.col("l_orderkey") % 500).alias("archive"), F.concat(F.when(F.col("l_partkey") % 40 == 0, "/").when(F.col("l_partkey") % 40 == 1, "../").otherwise("a/"), F.col("l_partkey").cast("string")).alias("name"), (F.col("l_partkey") % 50 == 7).alias("is_link"))),
        """WITH e AS (SELECT (l_orderkey % 500) || ':' || CASE l_partkey % 40 WHEN 0 THEN '/' WHEN 1 THEN '../' ELSE 'a/' END || l_partkey AS at1, l_partkey AS k, count(*) OVER (PARTITION BY l_orderkey % 500, l_partkey) AS n FROM lineitem)
        SELECT 'repeated' AS fault, at1 AS what FROM e WHERE n > 1 UNION ALL SELECT 'absolute', at1 FROM e WHERE k % 40 = 0 UNION ALL SELECT 'upward', at1 FROM e WHERE k % 40 = 1 UNION ALL SELECT 'link', at1 FROM e WHERE k % 50 = 7""",
    ),
    "canonical_manifests": (
        lambda s, d: canonical_hash(_manifest(s, d), "source", "v1", ["path", "sha256"]),
        """SELECT source, sha256('{"files":[' || string_agg('{"path":"d/' || doc_id || '","sha256":"' || sha256(text) || '"}', ',' ORDER BY 'd/' || doc_id) || '],"spec":"v1"}') AS sha256 FROM documents GROUP BY source""",
    ),
    "numbered_rows": (
        lambda s, d: numbered(table(s, d, "orders").select("o_custkey", "o_orderkey"), "o_custkey", "o_orderkey"),
        "SELECT o_custkey, o_orderkey, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) AS row_number FROM orders",
    ),
    "object_paths": (
        lambda s, d: _objects(s, d).select("doc_id", files.object_path(F.col("sha256")).alias("path")),
        "SELECT doc_id, 'objects/sha256/' || h[1:2] || '/' || h[3:4] || '/' || h AS path FROM (SELECT doc_id, sha256(text) AS h FROM documents)",
    ),
    "safe_paths": (
        lambda s, d: table(s, d, "part").select("p_partkey", F.concat(F.element_at(F.array(*map(F.lit, ("", "/", "../", "a//", "./", "a/../", ".a/", "a.."))), (F.col("p_partkey") % 8 + 1).cast("int")), F.col("p_partkey").cast("string")).alias("path")).filter(files.safe_path(F.col("path"))).select("p_partkey"),
        "SELECT p_partkey FROM part WHERE p_partkey % 8 IN (0, 6, 7)",
    ),
    "card_parts": (
        lambda s, d: table(s, d, "part").select("p_partkey", F.concat(F.lit("---\ntitle: A --- "), "p_brand", F.lit("\n---\n"), "p_name", F.lit("\n---\n")).alias("t")).select("p_partkey", *[c.alias(n) for c, n in zip(files.card_parts(F.col("t")), ("front", "body"), strict=True)]),
        "SELECT p_partkey, 'title: A --- ' || p_brand AS front, p_name || chr(10) || '---' || chr(10) AS body FROM part",
    ),
    "page_expression": (
        lambda s, d: table(s, d, "lineitem").filter(F.col("l_linenumber").isin(*page_list("7,1-3,2", 9))).select("l_orderkey", "l_linenumber"),
        "SELECT l_orderkey, l_linenumber FROM lineitem WHERE l_linenumber IN (1, 2, 3, 7)",
    ),
    "live_sessions": (
        lambda s, d: sessions(table(s, d, "orders").select(F.col("o_orderkey").alias("id"), F.col("o_custkey").alias("collection"), F.col("o_orderdate").cast("timestamp").alias("created_at"), F.when(F.col("o_orderstatus") == "O", "open").otherwise("closed").alias("state")), F.lit("1997-01-02").cast("timestamp"), 24 * 300).select("id", "live"),
        "SELECT o_orderkey AS id, o_orderstatus = 'O' AND o_orderdate > TIMESTAMP '1997-01-02' - INTERVAL 300 DAYS AS live FROM orders",
    ),
    "searchable_collections": (
        lambda s, d: searchable(table(s, d, "customer").select(F.col("c_custkey").alias("collection")), table(s, d, "orders").select(F.col("o_custkey").alias("collection"), (F.col("o_orderstatus") == "P").alias("live"))),
        "SELECT c_custkey AS collection FROM customer WHERE c_custkey NOT IN (SELECT o_custkey FROM orders WHERE o_orderstatus = 'P')",
    ),
    "repair_states": (
        lambda s, d: repairs(table(s, d, "orders").select(F.col("o_custkey").alias("item"), F.row_number().over(W.partitionBy("o_custkey").orderBy("o_orderkey")).alias("nth"), (F.col("o_orderstatus") == "F").alias("ok"))),
        """SELECT item, CASE WHEN ok THEN 'done' WHEN bad >= 3 THEN 'failed' ELSE 'retry' END AS state, CASE WHEN NOT ok AND bad < 3 THEN n + 1 END AS next FROM (
          SELECT o_custkey AS item, count(*) AS n, arg_max(o_orderstatus = 'F', o_orderkey) AS ok, count(*) FILTER (o_orderstatus <> 'F') AS bad FROM orders GROUP BY o_custkey)""",
    ),
    "collections_of_paths": (
        lambda s, d: collection_of(table(s, d, "part").select(F.concat_ws("/", F.lit("w"), (F.col("p_partkey") % 30).cast("string"), F.col("p_partkey").cast("string")).alias("path")), table(s, d, "nation").select(F.concat_ws("/", F.lit("w"), F.col("n_nationkey").cast("string"), F.when(F.col("n_nationkey") % 2 == 0, (F.col("n_nationkey") + 60).cast("string"))).alias("path"), F.col("n_name").alias("id"))),
        "SELECT 'w/' || (p_partkey % 30) || '/' || p_partkey AS path, n_name AS collection FROM part LEFT JOIN nation ON n_nationkey = p_partkey % 30 AND (n_nationkey % 2 = 1 OR p_partkey = n_nationkey + 60)",
    ),
    "nested_collections": (
        lambda s, d: nested_roots(table(s, d, "part").select(F.when(F.col("p_partkey") % 3 == 0, F.concat_ws("/", F.lit("w"), F.col("p_partkey").cast("string"))).otherwise(F.concat_ws("/", F.lit("w"), (F.col("p_partkey") - 1).cast("string"), F.lit("x"), F.col("p_partkey").cast("string"))).alias("path"), F.col("p_partkey").alias("id"))),
        "SELECT 'w/' || (p_partkey - 1) || '/x/' || p_partkey AS path, p_partkey - 1 AS collection FROM part WHERE p_partkey % 3 = 1 AND p_partkey - 1 IN (SELECT p_partkey FROM part)",
    ),
    "request_faults": (
        lambda s, d: request_faults(table(s, d, "part").select(F.col("p_partkey").alias("id"), F.when(F.col("p_partkey") % 9 == 0, " ").otherwise(F.col("p_name")).alias("query"), F.when(F.col("p_partkey") % 8 == 0, "odd").otherwise("hybrid").alias("mode"), (F.col("p_partkey") % 60).alias("limit"), (F.col("p_partkey") % 70).alias("candidate_limit"), ((F.col("p_partkey") % 30) / 20.0).alias("threshold"))),
        """SELECT 'query' AS fault, CAST(p_partkey AS VARCHAR) AS what FROM part WHERE p_partkey % 9 = 0 UNION ALL SELECT 'mode', CAST(p_partkey AS VARCHAR) FROM part WHERE p_partkey % 8 = 0 UNION ALL SELECT 'limit', CAST(p_partkey AS VARCHAR) FROM part WHERE p_partkey % 60 NOT BETWEEN 1 AND 50
        UNION ALL SELECT 'candidate_limit', CAST(p_partkey AS VARCHAR) FROM part WHERE p_partkey % 70 < 10 OR p_partkey % 70 < p_partkey % 60 UNION ALL SELECT 'threshold', CAST(p_partkey AS VARCHAR) FROM part WHERE p_partkey % 30 > 20""",
    ),
    "push_start": (_push, "SELECT DISTINCT sha256(text) AS sha256, strlen(text) AS byte_size FROM documents WHERE sha256(text) NOT IN (SELECT sha256(text) FROM documents WHERE doc_id % 4 <> 0)"),
    "version_rollback": (_rolled_back, "SELECT CAST(l_orderkey AS VARCHAR) AS version_id, l_partkey AS path FROM lineitem UNION ALL SELECT 'new', l_partkey FROM lineitem WHERE l_orderkey = 1"),
    "csv_round_trip": (_csv_again, """SELECT CAST(p_partkey AS VARCHAR) AS key, p_name || ', "' || p_brand || '"' || chr(10) || p_name AS text FROM part"""),
    "archive_round_trip": (_archives_again, "SELECT 'part-' || doc_id // 64 || '.zip' AS archive, lang || '/' || doc_id AS path, sha256(text) AS sha256, strlen(text) AS byte_size FROM documents"),
    "csv_numbers": (_csv_numbers, """SELECT o_orderkey AS key, 'a' || chr(10) || chr(10) || o_orderpriority || ' "x",' || chr(10) AS text, true AS in_order FROM orders"""),
    "jsonl_round_trip": (_jsonl_again, "SELECT p_partkey, p_name FROM part"),
    "text_round_trip": (_texts_again, "SELECT r_name AS name FROM region"),
    "objects_put": (_put_again, "SELECT DISTINCT sha256(text) AS sha256, strlen(text) AS byte_size FROM documents WHERE sha256(text) NOT IN (SELECT sha256(text) FROM documents WHERE doc_id % 3 = 0)"),
    "partitions_replaced": (_replaced_again, "SELECT o_orderkey, o_orderstatus, CASE WHEN o_orderstatus = 'F' THEN 2 ELSE 1 END AS turn FROM orders"),
    "folder_published": (_published_again, "SELECT p_partkey, 2 AS turn FROM part"),
    "rows_upserted": (
        lambda s, d: sinks.upsert(table(s, d, "part").select("p_partkey", "p_name"), table(s, d, "part").filter("p_partkey % 3 = 0").select((F.col("p_partkey") * 2).alias("p_partkey"), F.concat("p_name", F.lit("!")).alias("p_name")), ["p_partkey"]),
        "SELECT coalesce(n.k, p.p_partkey) AS p_partkey, coalesce(n.name, p.p_name) AS p_name FROM part p FULL JOIN (SELECT p_partkey * 2 AS k, p_name || '!' AS name FROM part WHERE p_partkey % 3 = 0) n ON n.k = p.p_partkey",
    ),
    "transport_round_trip": (_transport_again, "SELECT 'raw' AS namespace, s_name AS logical_path, sha256(s_name) AS sha256, s_suppkey AS byte_size, 'text/plain' AS media_type FROM supplier"),
    "streaming_ingest": (_ingested_again, "SELECT o_orderkey, o_orderstatus FROM orders WHERE CASE WHEN o_orderstatus = 'F' THEN o_orderkey % 2 = 1 ELSE o_orderkey % 2 = 0 END"),
    "log_published": (
        _log_again,
        "SELECT doc_id, CASE WHEN lang = 'de' THEN 2 ELSE 1 END AS turn, CASE WHEN lang <> 'fr' THEN 1 END AS was, 2 AS version FROM documents",
    ),
    "log_changes": (
        _log_changes,
        "SELECT o_orderkey, CASE WHEN o_orderpriority = '1-URGENT' THEN 'removed' ELSE 'changed' END AS change FROM orders WHERE o_orderstatus = 'F' AND (o_orderpriority = '1-URGENT' OR o_orderpriority LIKE '5%')",
    ),
    "conditional_publication": (
        _claims_again,
        "SELECT t.*, b.* FROM (VALUES (0, 'v1', 'published', 1), (1, 'v2', 'stale: v1', 1), (2, 'v2', 'published', 2), (3, 'v2', 'published', 2), (4, 'v3', 'false', 2)) AS t(turn, version, said, versions), (SELECT count(*) AS blobs, sum(byte_size)::BIGINT AS bytes FROM (SELECT DISTINCT sha256(text) AS sha256, strlen(text) AS byte_size FROM documents WHERE sha256(text) NOT IN (SELECT sha256(text) FROM documents WHERE doc_id % 4 <> 0))) b",
    ),
}
