"""Contracts of cards, resources, manifests, tables, samples and batches: faults as rows (fault, what), none if all is well.

Every check is a filter, an aggregate per key, or an anti-join, so it scales like the tables it reads; nothing is collected.
"""

from __future__ import annotations

import functools

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from ..session import table

KINDS = ("group", "text", "table", "image", "file")
UUID = "^[0-9a-fA-F]{8}(-?[0-9a-fA-F]{4}){3}-?[0-9a-fA-F]{12}$"
SHA256 = "^[0-9a-f]{64}$"
#: Names that a path of an input may not hold as a part.
RESERVED = (".git", "__pycache__")


def faults(rows: DataFrame, what: str, rules: dict[str, Column]) -> DataFrame:
    """(fault, what) for each row and each rule that holds there; a rule that is null doesn't."""
    said = F.array(*[F.when(F.coalesce(rule, F.lit(False)), F.lit(name)) for name, rule in rules.items()])
    return rows.select(F.explode(F.array_compact(said)).alias("fault"), F.col(what).cast("string").alias("what"))


def union(*parts: DataFrame) -> DataFrame:
    return functools.reduce(DataFrame.unionByName, parts)


def _blank(c: str) -> Column:
    return F.trim(F.coalesce(F.col(c), F.lit(""))) == ""


def metadata_faults(cards: DataFrame, spec: str, allowed: tuple[str, ...] = ()) -> DataFrame:
    """Cards (path, spec, id, kind, title, description, has_content, warnings array; fields: names present, optional) against
    the rules of their metadata."""
    rules = {
        "spec": ~F.col("spec").eqNullSafe(F.lit(spec)),
        "id": ~F.coalesce(F.col("id"), F.lit("")).rlike(UUID),
        "kind": ~F.coalesce(F.col("kind"), F.lit("")).isin(*KINDS),
        "title or description": _blank("title") | _blank("description"),
        "group with content": (F.col("kind") == "group") & F.col("has_content"),
        "no content": F.col("kind").isin(*KINDS) & (F.col("kind") != "group") & ~F.col("has_content"),
        "warnings": F.exists(F.coalesce("warnings", F.array().cast("array<string>")), lambda w: w.isNull() | (w == "")),
    }
    if allowed:
        rules["unknown field"] = F.size(F.array_except("fields", F.array(*map(F.lit, allowed)))) > 0
    return faults(cards, "path", rules)


def resource_faults(references: DataFrame, files: DataFrame) -> DataFrame:
    """References (path, role, uri, sha256, media_type) against stored files (uri, sha256): form of address and hash, media types
    of all but sources, and whether the file is there with that hash."""
    there = files.select("uri", F.col("sha256").alias("stored")).groupBy("uri").agg(F.min("stored").alias("stored"))
    known = references.join(there, "uri", "left")
    form = F.when(F.col("role") == "source", F.col("uri").startswith("raw://")).otherwise(F.col("uri").rlike("^(raw://|\\./)"))
    rules = {
        "hash": ~F.coalesce(F.col("sha256"), F.lit("")).rlike(SHA256),
        "address": ~F.coalesce(form, F.lit(False)),
        "media type": (F.col("role") != "source") & _blank("media_type"),
        "missing or mismatched": F.col("stored").isNull() | (F.col("stored") != F.col("sha256")),
    }
    return faults(known.withColumn("at", F.concat_ws(":", "path", "role")), "at", rules)


def machine_changes(cards: DataFrame, expected: DataFrame, fields: list[str]) -> DataFrame:
    """Cards (id, fields) whose generated fields differ from those that were published (id, machine_sha256), or are new."""
    own = cards.select("id", machine_hash(fields).alias("_now"))
    return own.join(expected.select("id", "machine_sha256"), "id", "left").filter(~F.col("_now").eqNullSafe(F.col("machine_sha256"))).select("id")


def machine_hash(fields: list[str]) -> Column:
    """SHA-256 of the fields as JSON with sorted keys; null fields are left out."""
    return F.sha2(F.to_json(F.struct(*sorted(fields))), 256)


def manifest_faults(items: DataFrame, paths: DataFrame) -> DataFrame:
    """Input items (path, ignore, fields: number of other settings, part_of, derived_from, first, last, quality) against what
    exists (path, is_dir) and each other. Relation cycles are ``tree.cycles``."""
    known = items.join(paths.select("path", "is_dir"), "path", "left")
    target = F.coalesce("part_of", "derived_from")
    unsafe = F.col("path").rlike(r"^/|\\|(^|/)(\.{0,2})(/|$)") | functools.reduce(Column.__or__, [F.array_contains(F.split("path", "/"), r) for r in RESERVED])
    own = faults(
        known,
        "path",
        {
            "unsafe path": unsafe,
            "no such path": F.col("is_dir").isNull(),
            "directory settings": F.col("is_dir") & (target.isNotNull() | F.col("first").isNotNull() | F.col("quality")),
            "ignored with settings": F.col("ignore") & (F.col("fields") > 0),
            "two relations": F.col("part_of").isNotNull() & F.col("derived_from").isNotNull(),
            "pages without relation": F.col("first").isNotNull() & target.isNull(),
            "pages": (F.col("first") < 1) | (F.col("first") > F.col("last")) | (F.col("first").isNull() != F.col("last").isNull()),
            "quality of no table": F.col("quality") & ~F.lower("path").endswith(".csv"),
            "refers to itself": target == F.col("path"),
        },
    )
    ignored = items.filter("ignore").select(F.col("path").alias("_t")).distinct()
    lost = items.select(target.alias("_t")).join(ignored, "_t", "left_semi").distinct().select(F.lit("target is ignored").alias("fault"), F.col("_t").alias("what"))
    return own.unionByName(lost)


def table_faults(rows: DataFrame) -> DataFrame:
    """Parsed tables as rows (table, row, cells array) against: the same width throughout, none empty, no blank row."""
    width = F.size("cells")
    per_table = rows.groupBy("table").agg(F.min(width).alias("low"), F.max(width).alias("high"))
    return union(
        faults(rows.withColumn("_at", F.concat_ws(":", "table", "row")), "_at", {"empty row": F.forall("cells", lambda c: F.trim(F.coalesce(c, F.lit(""))) == "")}),
        faults(per_table, "table", {"not rectangular": (F.col("low") != F.col("high")) | (F.col("low") == 0)}),
    )


def shape_faults(rows: DataFrame, declared: DataFrame) -> DataFrame:
    """Tables as rows (table, row from 0: the header, cells) against their declaration (table, row_count, columns, primary_key)."""
    shape = rows.groupBy("table").agg(F.count(F.when(F.col("row") > 0, 1)).alias("n"), F.min(F.size("cells")).alias("low"), F.max(F.size("cells")).alias("high"), F.max(F.when(F.col("row") == 0, F.col("cells"))).alias("head"))
    both = declared.join(shape, "table", "left")
    return faults(
        both,
        "table",
        {
            "header": F.col("head").isNull() | (F.size("head") == 0) | (F.size(F.array_distinct("head")) < F.size("head")),
            "shape": (F.col("low") != F.col("high")) | (F.coalesce("n", F.lit(0)) != F.col("row_count")),
            "columns": F.col("columns") != F.col("head"),
            "primary key": F.size(F.array_except("primary_key", "head")) > 0,
        },
    )


def sample_indexes(total: Column, edge: int = 3) -> Column:
    """Row numbers that a sample of ``total`` rows holds: all up to twice ``edge``, else the first and last ``edge``."""
    few = F.sequence(F.lit(1).cast("long"), total)
    ends = F.concat(F.sequence(F.lit(1).cast("long"), F.lit(edge).cast("long")), F.sequence(total - edge + 1, total))
    return F.when(total < 1, F.array().cast("array<bigint>")).when(total <= 2 * edge, few).otherwise(ends)


def sample_faults(samples: DataFrame, rows: DataFrame) -> DataFrame:
    """Samples (sample, mode, total, header, skip_reason) with rows (sample, row, cells) against the sample contract."""
    own = rows.groupBy("sample").agg(F.array_sort(F.collect_list("row")).alias("have"), F.array_sort(F.collect_list(F.struct("row", "cells"))).alias("cells"))  # six rows a sample, where it is right
    both = samples.join(own, "sample", "left").withColumn("have", F.coalesce("have", F.array().cast("array<bigint>")))
    content, width = F.col("mode") == "content", F.size("header")
    return faults(
        both,
        "sample",
        {
            "mode": ~F.coalesce(F.col("mode"), F.lit("")).isin("content", "skip"),
            "total": content & (F.coalesce("total", F.lit(0)) < 1),
            "indexes": content & (F.col("total") >= 1) & (F.col("have") != sample_indexes(F.greatest("total", F.lit(1).cast("long")))),
            "width": content & F.exists("cells", lambda c: F.size(c["cells"]) != width),
            "empty row": content & F.exists("cells", lambda c: F.forall(c["cells"], lambda x: F.trim(x) == "")),
            "skip": (F.col("mode") == "skip") & ((F.col("total") != 0) | (F.size("header") != 0) | (F.size("have") != 0) | _blank("skip_reason")),
        },
    )


def batch_faults(vectors: DataFrame) -> DataFrame:
    """A batch of vectors (batch, key, vector): hexadecimal keys of 64, no empty vector, one dimension a batch."""
    sizes = vectors.groupBy("batch").agg(F.count_distinct(F.size("vector")).alias("n"))
    return union(
        faults(vectors, "key", {"key": ~F.coalesce(F.col("key"), F.lit("")).rlike(SHA256), "empty vector": F.coalesce(F.size("vector"), F.lit(0)) < 1}),
        faults(sizes, "batch", {"several dimensions": F.col("n") > 1}),
    )


def assemble(chunks: DataFrame) -> DataFrame:
    """Uploaded chunks (sha256, index, count, byte_size, content) to blobs: sha256, status (partial, conflict, size or hash
    mismatch, complete), received, total and content where it is complete. A blob's chunks meet in one row, so a blob has to
    fit in a task, as it has to in a cell of the result; of a chunk sent twice the last by content counts."""
    one = chunks.groupBy("sha256", "index").agg(F.max(F.struct("content", "count", "byte_size")).alias("c"), F.max("count").alias("high"), F.min("count").alias("low"))
    joined = one.groupBy("sha256").agg(
        F.count(F.lit(1)).alias("received"), F.max("high").alias("total"), F.min("low").alias("low"), F.min("index").alias("first"), F.max("index").alias("last"),
        F.max("c.byte_size").alias("byte_size"), F.array_sort(F.collect_list(F.struct("index", "c.content"))).alias("parts"),
    )
    blob = F.reduce("parts", F.lit(b""), lambda a, p: F.concat(a, p["content"]))
    status = (
        F.when((F.col("total") != F.col("low")) | (F.col("first") < 0) | (F.col("last") >= F.col("total")), "conflict")
        .when(F.col("received") < F.col("total"), "partial")
        .when(F.octet_length("blob") != F.col("byte_size"), "size mismatch")
        .when(F.sha2("blob", 256) != F.col("sha256"), "hash mismatch")
        .otherwise("complete")
    )
    return joined.withColumn("blob", blob).withColumn("status", status).select("sha256", "status", "received", "total", F.when(F.col("status") == "complete", F.col("blob")).alias("content"))


def kept_bodies(drafts: DataFrame, published: DataFrame) -> DataFrame:
    """Drafts (id, body, source_sha256) beside what is published (id, body, generated_body_sha256, source_sha256): a published
    body that was edited stays (curated), and needs review where the source has changed since."""
    old = published.select("id", F.col("body").alias("_body"), F.col("generated_body_sha256").alias("_made"), F.col("source_sha256").alias("_source"))
    both = drafts.join(old, "id", "left").withColumn("curated", F.coalesce(F.sha2("_body", 256) != F.col("_made"), F.lit(False)))
    return both.select("id", F.when(F.col("curated"), F.col("_body")).otherwise(F.col("body")).alias("body"), "curated", (F.col("curated") & ~F.col("source_sha256").eqNullSafe(F.col("_source"))).alias("review"))


def staleness(current: DataFrame, built: DataFrame) -> DataFrame:
    """One row: status (stale or valid) and how many inputs (path, sha256) are new, changed and removed since the build."""
    now, then = current.select("path", F.col("sha256").alias("_now")), built.select("path", F.col("sha256").alias("_then"))
    counts = now.join(then, "path", "full_outer").agg(F.count(F.when(F.col("_then").isNull(), 1)).alias("new"), F.count(F.when(F.col("_now") != F.col("_then"), 1)).alias("changed"), F.count(F.when(F.col("_now").isNull(), 1)).alias("removed"))
    return counts.select(F.when(F.col("new") + F.col("changed") + F.col("removed") > 0, "stale").otherwise("valid").alias("status"), "new", "changed", "removed")


def chain_faults(found: DataFrame, pages: DataFrame, tolerance: float = 1.0) -> DataFrame:
    """Found tables (doc, pos, id, page, x0, y0, x1, y1, merge: yes, possible or no) against: ids used once, pages that exist
    (doc, page, width, height), boxes within their page up to ``tolerance``, and merges with a table at most a page before."""
    w = W.partitionBy("doc").orderBy("pos")
    at = found.join(pages, ["doc", "page"], "left").withColumn("_before", F.lag("page").over(w)).withColumn("_n", F.count(F.lit(1)).over(W.partitionBy("doc", "id")))
    inside = (F.col("x0") > -tolerance) & (F.col("x0") < F.col("x1")) & (F.col("x1") < F.col("width") + tolerance) & (F.col("y0") > -tolerance) & (F.col("y0") < F.col("y1")) & (F.col("y1") < F.col("height") + tolerance)
    merges = F.col("merge") != "no"
    return faults(
        at,
        "id",
        {
            "repeated id": F.col("_n") > 1,
            "no such page": F.col("width").isNull(),
            "box outside page": F.col("width").isNotNull() & ~inside,
            "merge value": ~F.coalesce(F.col("merge"), F.lit("")).isin("yes", "possible", "no"),
            "merge of the first": merges & F.col("_before").isNull(),
            "merge over pages": merges & (F.col("page") > F.col("_before") + 1),
        },
    )


def clipped(boxes: DataFrame) -> DataFrame:
    """Boxes (x0, y0, x1, y1, width, height) clipped to their page, to three decimals."""
    low, high = (lambda c: F.round(F.greatest(F.lit(0.0), c), 3)), (lambda c, most: F.round(F.least(F.col(most), F.col(c)), 3))
    return boxes.withColumns({"x0": low(F.col("x0")), "y0": low(F.col("y0")), "x1": high("x1", "width"), "y1": high("y1", "height")})


def merge_faults(members: DataFrame, found: DataFrame) -> DataFrame:
    """Merge groups (group, id) against found tables (id): each id known, used once, and none left out."""
    counts = members.groupBy("id").agg(F.count(F.lit(1)).alias("n"))
    both = counts.join(found.select("id").distinct().withColumn("_known", F.lit(True)), "id", "full_outer")
    return faults(both, "id", {"unknown id": F.col("_known").isNull(), "repeated id": F.col("n") > 1, "omitted id": F.col("n").isNull()})


def set_faults(expected: DataFrame, given: DataFrame, key: list[str]) -> DataFrame:
    """What is missing from, and what is extra in, one set of keys compared with another; none if they are equal."""
    both = expected.select(*key).distinct().withColumn("_e", F.lit(1)).join(given.select(*key).distinct().withColumn("_g", F.lit(1)), key, "full_outer")
    return faults(both.withColumn("_at", F.concat_ws("/", *key)), "_at", {"missing": F.col("_g").isNull(), "extra": F.col("_e").isNull()})


def _cards(s, d):
    p = table(s, d, "part")
    k = F.col("p_partkey")
    uuid = F.when(k % 9 == 0, F.lit("none")).otherwise(F.lower(F.concat(F.lit("00000000-0000-4000-8000-"), F.lpad(k.cast("string"), 12, "0"))))
    kind = F.element_at(F.array(*map(F.lit, (*KINDS, "odd"))), (k % 6 + 1).cast("int"))
    return p.select(k.cast("string").alias("path"), F.when(k % 11 == 0, "v0").otherwise("v1").alias("spec"), uuid.alias("id"), kind.alias("kind"), F.when(k % 13 == 0, " ").otherwise(F.col("p_name")).alias("title"), F.col("p_brand").alias("description"), (k % 4 != 0).alias("has_content"), F.when(k % 17 == 0, F.array(F.lit(""))).otherwise(F.array(F.lit("w"))).alias("warnings"))


def _said(select: str, rules: dict[str, str], source: str, what: str) -> str:
    return " UNION ALL ".join(f"SELECT '{name}' AS fault, CAST({what} AS VARCHAR) AS what FROM ({source}) WHERE {rule}" for name, rule in rules.items()) + select


_K = "p_partkey"
_KIND = f"['group', 'text', 'table', 'image', 'file', 'odd'][CAST({_K} % 6 + 1 AS INTEGER)]"


def _references(s, d):
    docs = table(s, d, "documents")
    k = F.col("doc_id")
    uri = F.concat(F.when(k % 7 == 0, "http://").when(k % 2 == 0, "raw://").otherwise("./"), k.cast("string"))
    return docs.select(k.cast("string").alias("path"), F.when(k % 3 == 0, "source").otherwise("content").alias("role"), uri.alias("uri"), F.when(k % 19 == 0, "x").otherwise(F.sha2("text", 256)).alias("sha256"), F.when(k % 5 != 0, "text/plain").alias("media_type"))


def _stored(s, d):
    return _references(s, d).join(table(s, d, "documents").select(F.col("doc_id").cast("string").alias("path"), "text"), "path").filter(F.col("path").cast("long") % 8 != 0).select("uri", F.sha2(F.when(F.col("path").cast("long") % 10 == 9, "other").otherwise(F.col("text")), 256).alias("sha256"))


_REF = """SELECT doc_id, doc_id || ':' || CASE WHEN doc_id % 3 = 0 THEN 'source' ELSE 'content' END AS place, doc_id % 3 = 0 AS src, doc_id % 7 = 0 AS http, doc_id % 7 <> 0 AND doc_id % 2 = 0 AS raw,
  CASE WHEN doc_id % 19 = 0 THEN 'x' ELSE sha256(text) END AS h, CASE WHEN doc_id % 8 <> 0 THEN sha256(CASE WHEN doc_id % 10 = 9 THEN 'other' ELSE text END) END AS stored FROM documents"""


def _tables(s, d):
    o = table(s, d, "orders")
    k = F.col("o_orderkey")
    cells = F.when(k % 101 == 0, F.array(F.lit(" "), F.lit(""))).when(k % 97 == 0, F.array(F.col("o_orderstatus"))).otherwise(F.array("o_orderstatus", "o_orderpriority"))
    return o.select(F.col("o_custkey").alias("table"), k.alias("row"), cells.alias("cells"))


def _samples(s, d):
    c = table(s, d, "customer")
    k = F.col("c_custkey")
    return c.select(k.alias("sample"), F.when(k % 10 == 0, "skip").when(k % 23 == 0, "odd").otherwise("content").alias("mode"), F.when(k % 10 == 0, 0).otherwise(k % 9).cast("long").alias("total"), F.when(k % 10 == 0, F.array().cast("array<string>")).otherwise(F.array(F.lit("a"), F.lit("b"))).alias("header"), F.when(k % 20 == 0, "blank page").alias("skip_reason"))


def _sample_rows(s, d):
    rows = _samples(s, d).filter("mode <> 'skip'").select("sample", F.explode(sample_indexes(F.col("total"))).alias("row"))
    rows = rows.filter((F.col("sample") % 29 != 0) | (F.col("row") != 1))
    return rows.withColumn("cells", F.when((F.col("sample") % 31 == 0) & (F.col("row") == 2), F.array(F.lit("x"))).when((F.col("sample") % 37 == 0) & (F.col("row") == 1), F.array(F.lit(" "), F.lit(""))).otherwise(F.array(F.lit("x"), F.lit("y"))))


_SAMPLE = "SELECT c_custkey AS k, c_custkey % 10 = 0 AS skip, CASE WHEN c_custkey % 10 = 0 THEN 0 ELSE c_custkey % 9 END AS total FROM customer"


def _chunks(s, d):
    docs = table(s, d, "documents").groupBy(F.sha2("text", 256).alias("sha256")).agg(F.min("doc_id").alias("k"), F.first("text").alias("text"))
    data, half = F.col("text").cast("binary"), F.expr("octet_length(text) DIV 2")
    parts = F.array(F.struct(F.lit(0).alias("index"), F.substring(data, F.lit(1), half).alias("content")), F.struct(F.lit(1).alias("index"), F.substring(data, half + 1, F.octet_length("text")).alias("content")))
    each = docs.select("sha256", "k", F.octet_length("text").alias("n"), F.explode(parts).alias("p"))
    each = each.filter((F.col("k") % 7 != 0) | (F.col("p.index") == 0))
    content = F.when((F.col("k") % 11 == 0) & (F.col("p.index") == 1), F.concat(F.lit(b"\x01"), F.substring(F.col("p.content"), F.lit(2), F.col("n")))).otherwise(F.col("p.content"))
    return each.select("sha256", "p.index", F.when((F.col("k") % 13 == 0) & (F.col("p.index") == 1), 3).otherwise(2).alias("count"), (F.col("n") + (F.col("k") % 17 == 0).cast("int")).alias("byte_size"), content.alias("content"))


def _found(s, d):
    o = table(s, d, "orders")
    k = F.col("o_orderkey")
    box = {"x0": (k % 50 - 2).cast("double"), "y0": F.lit(10.0), "x1": (k % 600).cast("double"), "y1": (k % 860).cast("double")}
    return o.select(F.col("o_custkey").alias("doc"), k.alias("pos"), F.expr("o_orderkey DIV 2").alias("id"), (F.expr("o_orderkey DIV 3000") + 1).alias("page"), *[v.alias(c) for c, v in box.items()], F.when(k % 3 == 0, "yes").when(k % 53 == 0, "maybe").otherwise("no").alias("merge"))


def _page_sizes(s, d):
    return table(s, d, "orders").select(F.col("o_custkey").alias("doc"), (F.expr("o_orderkey DIV 3000") + 1).alias("page")).distinct().filter("doc % 41 <> 0").select("doc", "page", F.lit(595.0).alias("width"), F.lit(842.0).alias("height"))


_FOUND = """SELECT o_orderkey // 2 AS id, o_custkey AS doc, o_orderkey AS k, o_orderkey // 3000 + 1 AS page, o_orderkey % 50 - 2 AS x0, o_orderkey % 600 AS x1, o_orderkey % 860 AS y1,
  CASE WHEN o_orderkey % 3 = 0 THEN 'yes' WHEN o_orderkey % 53 = 0 THEN 'maybe' ELSE 'no' END AS merge, lag(o_orderkey // 3000 + 1) OVER (PARTITION BY o_custkey ORDER BY o_orderkey) AS before, count(*) OVER (PARTITION BY o_custkey, o_orderkey // 2) AS n FROM orders"""


def _items(s, d):
    p = table(s, d, "part")
    k = F.col("p_partkey")
    path = F.when(k % 19 == 0, F.concat(F.lit("../"), k.cast("string"))).otherwise(F.concat(F.lit("in/"), k.cast("string"), F.when(k % 2 == 0, ".csv").otherwise(".pdf")))
    other = lambda n: F.concat(F.lit("in/"), (k + n).cast("string"), F.when((k + n) % 2 == 0, ".csv").otherwise(".pdf"))
    part_of = F.when(k % 23 == 0, path).when(k % 5 == 0, other(1))
    return p.select(path.alias("path"), (k % 7 == 0).alias("ignore"), F.when(k % 14 == 0, 1).otherwise(0).alias("fields"), part_of.alias("part_of"), F.when(k % 15 == 0, other(2)).alias("derived_from"), F.when(k % 4 == 0, k % 9).alias("first"), F.when(k % 4 == 0, F.lit(5).cast("long")).alias("last"), (k % 3 == 0).alias("quality"), k.alias("k"))


_PATH = "CASE WHEN k % 19 = 0 THEN '../' || k ELSE 'in/' || k || CASE WHEN k % 2 = 0 THEN '.csv' ELSE '.pdf' END END"
_ITEM = f"""SELECT *, CASE WHEN k % 23 = 0 THEN path WHEN k % 5 = 0 THEN 'in/' || (k + 1) || CASE WHEN k % 2 = 1 THEN '.csv' ELSE '.pdf' END END AS part_of,
  CASE WHEN k % 15 = 0 THEN 'in/' || (k + 2) || CASE WHEN k % 2 = 0 THEN '.csv' ELSE '.pdf' END END AS derived_from, CASE WHEN k % 4 = 0 THEN k % 9 END AS a FROM (SELECT p_partkey AS k, {_PATH.replace('k ', 'p_partkey ')} AS path FROM part)"""
_BODY = "SELECT doc_id AS id, CASE WHEN doc_id % 6 = 0 THEN text || ' edited' ELSE text END AS old, text AS made, doc_id % 4 AS src FROM documents WHERE doc_id % 3 <> 1"

QUERIES = {
    "metadata_faults": (
        lambda s, d: metadata_faults(_cards(s, d), "v1"),
        _said("", {"spec": f"{_K} % 11 = 0", "id": f"{_K} % 9 = 0", "kind": f"{_K} % 6 = 5", "title or description": f"{_K} % 13 = 0", "group with content": f"{_K} % 6 = 0 AND {_K} % 4 <> 0", "no content": f"{_K} % 6 BETWEEN 1 AND 4 AND {_K} % 4 = 0", "warnings": f"{_K} % 17 = 0"}, "SELECT * FROM part", _K),
    ),
    "resource_faults": (
        lambda s, d: resource_faults(_references(s, d), _stored(s, d)),
        _said("", {"hash": "doc_id % 19 = 0", "address": "http OR src AND NOT raw", "media type": "NOT src AND doc_id % 5 = 0", "missing or mismatched": "stored IS NULL OR stored <> h"}, _REF, "place"),
    ),
    "machine_changes": (
        lambda s, d: machine_changes(
            table(s, d, "part").select(F.col("p_partkey").alias("id"), F.col("p_name").alias("title"), F.when(F.col("p_partkey") % 7 == 0, "changed").otherwise(F.col("p_brand")).alias("description")),
            table(s, d, "part").filter("p_partkey % 10 <> 3").select(F.col("p_partkey").alias("id"), F.col("p_name").alias("title"), F.col("p_brand").alias("description")).select("id", machine_hash(["title", "description"]).alias("machine_sha256")),
            ["title", "description"],
        ),
        "SELECT p_partkey AS id FROM part WHERE p_partkey % 10 = 3 OR p_partkey % 7 = 0",
    ),
    "manifest_faults": (
        lambda s, d: manifest_faults(_items(s, d), _items(s, d).filter("k % 6 <> 0").select("path", (F.col("k") % 8 == 1).alias("is_dir"))),
        _said(
            f" UNION ALL SELECT DISTINCT 'target is ignored', t FROM (SELECT coalesce(part_of, derived_from) AS t FROM ({_ITEM})) WHERE t IN (SELECT path FROM ({_ITEM}) WHERE k % 7 = 0)",
            {
                "unsafe path": "k % 19 = 0", "no such path": "k % 6 = 0", "directory settings": "k % 6 <> 0 AND k % 8 = 1 AND (part_of IS NOT NULL OR derived_from IS NOT NULL OR a IS NOT NULL OR k % 3 = 0)", "ignored with settings": "k % 14 = 0",
                "two relations": "part_of IS NOT NULL AND derived_from IS NOT NULL", "pages without relation": "a IS NOT NULL AND part_of IS NULL AND derived_from IS NULL", "pages": "a < 1 OR a > 5", "quality of no table": "k % 3 = 0 AND path NOT LIKE '%.csv'", "refers to itself": "coalesce(part_of, derived_from) = path",
            },
            _ITEM, "path",
        ),
    ),
    "table_faults": (
        lambda s, d: table_faults(_tables(s, d)),
        """WITH r AS (SELECT o_custkey AS t, o_orderkey AS k, CASE WHEN o_orderkey % 101 = 0 THEN 2 WHEN o_orderkey % 97 = 0 THEN 1 ELSE 2 END AS w FROM orders)
        SELECT 'empty row' AS fault, t || ':' || k AS what FROM r WHERE k % 101 = 0 UNION ALL SELECT 'not rectangular', CAST(t AS VARCHAR) FROM r GROUP BY t HAVING min(w) <> max(w)""",
    ),
    "shape_faults": (
        lambda s, d: shape_faults(
            table(s, d, "orders").select(F.col("o_custkey").alias("table"), (F.row_number().over(W.partitionBy("o_custkey").orderBy("o_orderkey")) - 1).alias("row"), F.array("o_orderstatus", F.when(F.col("o_custkey") % 12 == 0, F.col("o_orderstatus")).otherwise(F.lit("z"))).alias("cells")),
            table(s, d, "customer").select(F.col("c_custkey").alias("table"), (F.col("c_custkey") % 12).alias("row_count"), F.array(F.lit("O"), F.lit("z")).alias("columns"), F.array(F.when(F.col("c_custkey") % 5 == 0, "y").otherwise("z")).alias("primary_key")),
        ),
        """WITH r AS (SELECT o_custkey AS t, o_orderstatus AS a, CASE WHEN o_custkey % 12 = 0 THEN o_orderstatus ELSE 'z' END AS b, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) AS n FROM orders),
        c AS (SELECT c_custkey AS t, c_custkey % 12 AS want, (SELECT count(*) - 1 FROM r WHERE r.t = c_custkey) AS n, h.a, h.b FROM customer LEFT JOIN (SELECT * FROM r WHERE n = 1) h ON h.t = c_custkey)
        SELECT 'header' AS fault, CAST(t AS VARCHAR) AS what FROM c WHERE a IS NULL OR a = b UNION ALL SELECT 'shape', CAST(t AS VARCHAR) FROM c WHERE greatest(n, 0) <> want
        UNION ALL SELECT 'columns', CAST(t AS VARCHAR) FROM c WHERE a <> 'O' OR b <> 'z' UNION ALL SELECT 'primary key', CAST(t AS VARCHAR) FROM c WHERE a IS NOT NULL AND CASE WHEN t % 5 = 0 THEN 'y' ELSE 'z' END NOT IN (a, b)""",
    ),
    "sample_faults": (
        lambda s, d: sample_faults(_samples(s, d), _sample_rows(s, d)),
        _said("", {"mode": "NOT skip AND k % 23 = 0", "total": "NOT skip AND k % 23 <> 0 AND total < 1", "indexes": "NOT skip AND k % 23 <> 0 AND total >= 1 AND k % 29 = 0", "width": "NOT skip AND k % 23 <> 0 AND k % 31 = 0 AND total >= 2", "empty row": "NOT skip AND k % 23 <> 0 AND k % 37 = 0 AND total >= 1 AND k % 29 <> 0", "skip": "skip AND k % 20 <> 0"}, _SAMPLE, "k"),
    ),
    "batch_faults": (
        lambda s, d: batch_faults(table(s, d, "customer").select(F.col("c_nationkey").alias("batch"), F.when(F.col("c_custkey") % 50 == 0, F.col("c_name")).otherwise(F.sha2("c_name", 256)).alias("key"), F.when(F.col("c_custkey") % 60 == 0, F.array().cast("array<double>")).otherwise(F.array("c_acctbal")).alias("vector"))),
        """SELECT 'key' AS fault, c_name AS what FROM customer WHERE c_custkey % 50 = 0 UNION ALL SELECT 'empty vector', CASE WHEN c_custkey % 50 = 0 THEN c_name ELSE sha256(c_name) END FROM customer WHERE c_custkey % 60 = 0
        UNION ALL SELECT 'several dimensions', CAST(c_nationkey AS VARCHAR) FROM customer GROUP BY c_nationkey HAVING count(DISTINCT CASE WHEN c_custkey % 60 = 0 THEN 0 ELSE 1 END) > 1""",
    ),
    "blob_assembly": (
        lambda s, d: assemble(_chunks(s, d)).select("sha256", "status", "received", F.octet_length("content").alias("n")),
        """SELECT sha256, status, received, CASE WHEN status = 'complete' THEN n END AS n FROM (SELECT sha256, n, CASE WHEN k % 7 = 0 THEN 1 ELSE 2 END AS received,
          CASE WHEN k % 13 = 0 AND k % 7 <> 0 THEN 'conflict' WHEN k % 7 = 0 THEN 'partial' WHEN k % 17 = 0 THEN 'size mismatch' WHEN k % 11 = 0 THEN 'hash mismatch' ELSE 'complete' END AS status
          FROM (SELECT sha256(text) AS sha256, min(doc_id) AS k, any_value(strlen(text)) AS n FROM documents GROUP BY text))""",
    ),
    "kept_bodies": (
        lambda s, d: kept_bodies(
            table(s, d, "documents").select(F.col("doc_id").alias("id"), F.concat("text", F.lit(" new")).alias("body"), F.lit(0).cast("long").alias("source_sha256")),
            table(s, d, "documents").filter("doc_id % 3 <> 1").select(F.col("doc_id").alias("id"), F.when(F.col("doc_id") % 6 == 0, F.concat("text", F.lit(" edited"))).otherwise(F.col("text")).alias("body"), F.sha2("text", 256).alias("generated_body_sha256"), (F.col("doc_id") % 4).alias("source_sha256")),
        ).select("id", F.md5("body").alias("body"), "curated", "review"),
        f"SELECT d.doc_id AS id, md5(CASE WHEN b.old <> b.made THEN b.old ELSE d.text || ' new' END) AS body, coalesce(b.old <> b.made, false) AS curated, coalesce(b.old <> b.made AND b.src <> 0, false) AS review FROM documents d LEFT JOIN ({_BODY}) b ON b.id = d.doc_id",
    ),
    "input_staleness": (
        lambda s, d: staleness(table(s, d, "documents").filter("doc_id % 9 <> 0").select(F.col("doc_id").alias("path"), F.sha2("text", 256).alias("sha256")), table(s, d, "documents").filter("doc_id % 7 <> 0").select(F.col("doc_id").alias("path"), F.sha2(F.when(F.col("doc_id") % 5 == 0, "old").otherwise(F.col("text")), 256).alias("sha256"))),
        "SELECT 'stale' AS status, count(*) FILTER (doc_id % 9 <> 0 AND doc_id % 7 = 0) AS new, count(*) FILTER (doc_id % 9 <> 0 AND doc_id % 7 <> 0 AND doc_id % 5 = 0 AND text <> 'old') AS changed, count(*) FILTER (doc_id % 9 = 0 AND doc_id % 7 <> 0) AS removed FROM documents",
    ),
    "find_chain_faults": (
        lambda s, d: chain_faults(_found(s, d), _page_sizes(s, d)),
        _said("", {"repeated id": "n > 1", "no such page": "doc % 41 = 0", "box outside page": "doc % 41 <> 0 AND NOT (x0 > -1 AND x0 < x1 AND x1 < 596 AND 10 < y1 AND y1 < 843)", "merge value": "merge = 'maybe'", "merge of the first": "merge <> 'no' AND before IS NULL", "merge over pages": "merge <> 'no' AND page > before + 1"}, _FOUND, "id"),
    ),
    "clipped_boxes": (
        lambda s, d: clipped(_found(s, d).withColumns({"width": F.lit(595.0), "height": F.lit(842.0)})).select("pos", "x0", "y0", "x1", "y1"),
        "SELECT o_orderkey AS pos, greatest(0, o_orderkey % 50 - 2) AS x0, 10 AS y0, least(595, o_orderkey % 600) AS x1, least(842, o_orderkey % 860) AS y1 FROM orders",
    ),
    "merge_faults": (
        lambda s, d: merge_faults(table(s, d, "lineitem").filter("l_linenumber <= 2").select(F.col("l_partkey").alias("group"), F.col("l_orderkey").alias("id")), table(s, d, "orders").filter("o_orderkey % 20 <> 0").select(F.col("o_orderkey").alias("id"))),
        """WITH m AS (SELECT l_orderkey AS id, count(*) AS n FROM lineitem WHERE l_linenumber <= 2 GROUP BY l_orderkey), f AS (SELECT DISTINCT o_orderkey AS id FROM orders WHERE o_orderkey % 20 <> 0)
        SELECT 'unknown id' AS fault, CAST(id AS VARCHAR) AS what FROM m WHERE id NOT IN (SELECT id FROM f) UNION ALL SELECT 'repeated id', CAST(id AS VARCHAR) FROM m WHERE n > 1 UNION ALL SELECT 'omitted id', CAST(id AS VARCHAR) FROM f WHERE id NOT IN (SELECT id FROM m)""",
    ),
    "file_set_faults": (
        lambda s, d: set_faults(table(s, d, "orders").filter("o_orderkey % 50 <> 1").select("o_custkey", "o_orderkey"), table(s, d, "orders").filter("o_orderkey % 70 <> 2").select("o_custkey", "o_orderkey"), ["o_custkey", "o_orderkey"]),
        "SELECT CASE WHEN o_orderkey % 70 = 2 THEN 'missing' ELSE 'extra' END AS fault, o_custkey || '/' || o_orderkey AS what FROM (SELECT DISTINCT o_custkey, o_orderkey FROM orders) WHERE (o_orderkey % 70 = 2) <> (o_orderkey % 50 = 1)",
    ),
}
