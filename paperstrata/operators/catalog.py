"""The catalogue of collections: records joined for reading, outlines of sections and directories, counts and reports.

Joins are equi-joins on declared keys; counts are partial aggregates with their fixed categories joined in from a literal.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from ..session import dealt, table


def with_active_version(collections: DataFrame, versions: DataFrame) -> DataFrame:
    """Collections (id, active_id, ...) with ``version``, a struct of all columns of their active version; null if none."""
    own = versions.select(F.col("id").alias("_vid"), F.struct(*[versions[c] for c in versions.columns]).alias("version"))
    return collections.join(own, collections["active_id"] == F.col("_vid"), "left").drop("_vid")


def links(edges: DataFrame, resources: DataFrame, nodes: DataFrame) -> DataFrame:
    """Edges (node_id, resource_id, role, ordinal) whose node and resource are known, with title and kind of the node and path,
    hash and size of the resource."""
    r = resources.select(F.col("id").alias("resource_id"), "logical_path", "sha256", "byte_size")
    n = nodes.select(F.col("id").alias("node_id"), "title", "kind")
    return edges.join(r, "resource_id").join(n, "node_id")


def denormalised(units: DataFrame, nodes: DataFrame, columns: tuple[str, ...] = ("path", "kind", "title", "description")) -> DataFrame:
    """Units (node_id, ...) with columns of their node; units of unknown nodes are left out."""
    return units.join(nodes.select(F.col("id").alias("node_id"), *columns), "node_id")


def parents(nodes: DataFrame) -> DataFrame:
    """Nodes (id, path) with parent_id: the node whose path is theirs without its last part. ``orphan``: such a path is named but
    no node has it."""
    up = F.when(F.col("path").contains("/"), F.regexp_replace("path", "/[^/]*$", ""))
    by_path = nodes.select(F.col("path").alias("_up"), F.col("id").alias("parent_id"))
    return nodes.withColumn("_up", up).join(by_path, "_up", "left").withColumn("orphan", F.col("_up").isNotNull() & F.col("parent_id").isNull()).drop("_up")


def grouping_items(items: DataFrame) -> DataFrame:
    """Items (path, part_of) that others are part of."""
    return items.join(items.select(F.col("part_of").alias("path")).distinct(), "path", "left_semi")


def name_conflicts(wanted: DataFrame, existing: DataFrame) -> DataFrame:
    """Wanted names (id, name) that another id has. A name of many owners is one row: some owner differs from an id if the least
    or the greatest does."""
    taken = existing.groupBy("name").agg(F.min("id").alias("_least"), F.max("id").alias("_greatest"))
    return wanted.join(taken, "name").filter((F.col("_least") != F.col("id")) | (F.col("_greatest") != F.col("id"))).select("id", "name").distinct()


def resolved(wanted: DataFrame, *places: tuple[str, DataFrame]) -> DataFrame:
    """Wanted objects (sha256) with ``found_in``: the first of the places (name, DataFrame of sha256, checked) that holds them
    with a verified hash; null if none does."""
    out, names = wanted, []
    for name, held in places:
        own = held.filter("checked = sha256").select("sha256").distinct().withColumn(f"_{name}", F.lit(name))
        out, names = out.join(own, "sha256", "left"), [*names, f"_{name}"]
    return out.withColumn("found_in", F.coalesce(*names)).drop(*names)


def depths(nodes: DataFrame) -> DataFrame:
    """The card of a node as it is listed: id, path, parent_id, order, depth, kind, title, description; the root has depth 0."""
    return nodes.select("id", "path", "parent_id", "ordinal", (F.size("tree_path") - 1).alias("depth"), "kind", "title", "description")


def evidence(hits: DataFrame, offset: int = 0) -> DataFrame:
    """Hits (score, unit_id, node_id, unit_type, unit_locator, node_locator) of one page with rank from offset + 1 by score and
    id, what to open (card or content) and the locator, the node's where the unit has none. A page is bounded by its limit."""
    rank = F.row_number().over(W.orderBy(F.desc("score"), "unit_id")) + offset
    return hits.select(rank.alias("rank"), "score", "unit_id", "node_id", F.when(F.col("unit_type") == "card", "card").otherwise("content").alias("target"), F.coalesce("unit_locator", "node_locator").alias("locator"))


def response(reranked: Column, hits: Column, candidate_limit: int) -> Column:
    """How many of the hits were reranked: none where reranking is off."""
    return F.when(reranked, F.least(hits, F.lit(candidate_limit).cast("long"))).otherwise(F.lit(0).cast("long"))


def directories(paths: DataFrame) -> DataFrame:
    """Every directory above a file (path), with its title: the name with - and _ as spaces."""
    parts = F.split("path", "/")
    above = F.transform(F.sequence(F.lit(1), F.size(parts) - 1), lambda n: F.array_join(F.slice(parts, 1, n), "/"))
    each = paths.select(F.explode(F.when(F.size(parts) > 1, above).otherwise(F.array().cast("array<string>"))).alias("path")).distinct()
    return each.withColumn("title", F.trim(F.translate(F.element_at(F.split("path", "/"), -1), "-_", "  ")))


def section_keys(sections: DataFrame, slug: Column) -> DataFrame:
    """Sections (doc, pos) with ``key``: the slug, from its second use in the document on with :2, :3, ..."""
    rows = sections.withColumn("_slug", slug)
    nth = F.row_number().over(W.partitionBy("doc", "_slug").orderBy("pos"))
    return rows.withColumn("_nth", nth).withColumn("key", F.when(F.col("_nth") > 1, F.concat("_slug", F.lit(":"), F.col("_nth").cast("string"))).otherwise(F.col("_slug"))).drop("_slug", "_nth")


def numbered_titles(tables: DataFrame) -> DataFrame:
    """Tables (doc, pos, title): titles that a document has twice or more get their table's number as a suffix."""
    number, same = F.row_number().over(W.partitionBy("doc").orderBy("pos")), F.count(F.lit(1)).over(W.partitionBy("doc", "title"))
    rows = tables.withColumn("_number", number).withColumn("_same", same)
    return rows.withColumn("title", F.when(F.col("_same") > 1, F.concat("title", F.lit(" — Table "), F.col("_number").cast("string"))).otherwise(F.col("title"))).drop("_number", "_same")


def unique_names(names: Column) -> Column:
    """Column names without blanks and repeats: ``Column i`` and ``name (2)``."""
    filled = F.transform(names, lambda c, i: F.when(F.trim(F.coalesce(c, F.lit(""))) == "", F.concat(F.lit("Column "), (i + 1).cast("string"))).otherwise(F.trim(c)))

    def numbered(all_: Column) -> Column:
        nth = lambda c, i: F.size(F.filter(F.slice(all_, F.lit(1), i + 1), lambda x: x == c))
        return F.transform(all_, lambda c, i: F.when(nth(c, i) > 1, F.concat(c, F.lit(" ("), nth(c, i).cast("string"), F.lit(")"))).otherwise(c))

    return F.element_at(F.transform(F.array(filled), numbered), 1)


def first_title(text: Column, keyword: str, stem: Column, lines: int = 100, most: int = 120) -> Column:
    """The first of the first ``lines`` lines that holds the keyword and has at most ``most`` characters, without heading
    marks; else the file's stem with - and _ as spaces."""
    each = F.transform(F.slice(F.split(text, "\n"), 1, lines), lambda x: F.trim(F.ltrim(F.trim(x), F.lit("#"))))
    fits = F.filter(each, lambda x: F.lower(x).contains(keyword.lower()) & (F.char_length(x) <= most))
    return F.coalesce(F.get(fits, F.lit(0)), F.trim(F.translate(stem, "-_", "  ")))


def status_counts(rows: DataFrame, status: str, known: tuple[str, ...] = ()) -> DataFrame:
    """(status, n): known statuses with none have 0; others are counted too."""
    counts = rows.groupBy(F.col(status).alias("status")).agg(F.count(F.lit(1)).alias("n"))
    if not known:
        return counts
    fixed = rows.sparkSession.createDataFrame([(k,) for k in known], "status string")
    return fixed.join(counts, "status", "full_outer").withColumn("n", F.coalesce("n", F.lit(0).cast("long")))


def usage_sums(steps: DataFrame, usage: str) -> DataFrame:
    """(key, total) over maps of usage numbers given as text; values that are no whole numbers don't count."""
    each = steps.select(F.explode(usage).alias("key", "value"))
    whole = F.when(F.col("value").rlike("^-?[0-9]+$"), F.col("value").cast("long"))
    return each.groupBy("key").agg(F.sum(whole).alias("total")).filter("total IS NOT NULL")


def suffix_counts(paths: DataFrame) -> DataFrame:
    """(suffix, n) of paths, lower-cased; file where there is none."""
    name = F.element_at(F.split("path", "/"), -1)
    suffix = F.lower(F.regexp_extract(name, r".\.([^.]+)$", 1))
    return paths.groupBy(F.when(suffix == "", "file").otherwise(suffix).alias("suffix")).agg(F.count(F.lit(1)).alias("n"))


def commit_stats(nodes: DataFrame, resources: DataFrame, units: DataFrame) -> DataFrame:
    """One row: numbers of nodes, raw sources, resources, units, and of units embedded anew and reused (units: reused)."""
    n = lambda df, **c: df.agg(*[F.count(F.when(v, 1)).alias(k) for k, v in c.items()])
    all_ = F.lit(True)
    return n(nodes, nodes=all_).crossJoin(n(resources, raw_sources=F.col("namespace") == "raw", resources=all_)).crossJoin(n(units, units=all_, embedded=~F.col("reused"), reused=F.col("reused")))


def node_hashes(nodes: DataFrame, link_rows: DataFrame, metadata: list[str]) -> DataFrame:
    """(id, node_hash): SHA-256 over the metadata as JSON with sorted keys, the body and the hashes of the node's resources in
    order of their links (node_id, role, ordinal, sha256). A node's links are a bounded list."""
    own = link_rows.groupBy("node_id").agg(F.array_sort(F.collect_list(F.struct("role", "ordinal", "sha256"))).alias("_l"))
    hashes = F.array_join(F.transform(F.coalesce("_l", F.array().cast("array<struct<role:string,ordinal:int,sha256:string>>")), lambda x: x["sha256"]), "\n")
    return nodes.join(own, F.col("id") == F.col("node_id"), "left").select("id", F.sha2(F.concat(F.to_json(F.struct(*sorted(metadata))), F.lit("\n"), "body", F.lit("\n"), hashes), 256).alias("node_hash"))


def csv_shape(rows: DataFrame) -> DataFrame:
    """Tables as rows (table, row from 0: the header, cells) to one row each: rows, data_rows, columns, empty_rows (numbers of
    blank data rows), head and tail (number and first cell of the first three and last six data rows)."""
    data, blank = F.col("row") > 0, F.forall("cells", lambda c: F.trim(F.coalesce(c, F.lit(""))) == "")
    short = F.coalesce(F.get("cells", F.lit(0)), F.lit(""))
    cell = F.struct("row", F.when(F.char_length(short) <= 96, short).otherwise(F.concat(F.substring(short, 1, 95), F.lit("…"))).alias("first"))
    last = F.max("row").over(W.partitionBy("table"))
    edge = rows.withColumn("_last", last)
    return edge.groupBy("table").agg(
        F.count(F.lit(1)).alias("rows"), F.count(F.when(data, 1)).alias("data_rows"), F.max(F.when(F.col("row") == 0, F.size("cells"))).alias("columns"), F.array_sort(F.collect_list(F.when(data & blank, F.col("row")))).alias("empty_rows"),
        F.array_sort(F.collect_list(F.when(data & (F.col("row") <= 3), cell))).alias("head"), F.array_sort(F.collect_list(F.when(data & (F.col("row") > F.col("_last") - 6), cell))).alias("tail"),
    )


def merged_members(members: DataFrame, found: DataFrame) -> DataFrame:
    """Merge groups (group, pos, id, reason) with what was found (id, title, page): group, ids in order, title_hint (of the first
    member) and pages."""
    rows = members.join(found, "id")
    return rows.groupBy("group").agg(F.array_sort(F.collect_list(F.struct("pos", "id", "title", "page"))).alias("m")).select("group", F.transform("m", lambda x: x["id"]).alias("ids"), F.get("m", F.lit(0))["title"].alias("title_hint"), F.array_sort(F.array_distinct(F.transform("m", lambda x: x["page"]))).alias("pages"))


def document_sequence(blocks: DataFrame, parsed: DataFrame) -> DataFrame:
    """Blocks (doc, block, page, pos, kind, ignored) in reading order with the tables parsed from them (table, block): a table
    comes once, at its first block; other blocks of it and ignored ones go; blocks without a table stay themselves."""
    live = blocks.filter("NOT ignored").join(parsed.select("block", "table"), "block", "left")
    nth = F.row_number().over(W.partitionBy("doc", "table").orderBy("page", "pos", "block"))
    once = live.withColumn("_nth", nth).filter("table IS NULL OR _nth = 1")
    place = F.row_number().over(W.partitionBy("doc").orderBy("page", "pos", "block", "table"))
    return once.select("doc", place.alias("place"), "block", "table", F.when(F.col("table").isNotNull(), "table").otherwise(F.col("kind")).alias("kind"))


def child_order(nodes: DataFrame) -> DataFrame:
    """Drafts (key, parent, hint, item_path, kind, title) with ``ordinal`` 1 to n among their siblings."""
    return nodes.withColumn("ordinal", F.row_number().over(W.partitionBy("parent").orderBy("hint", "item_path", "kind", "title", "key")))


def _orders(s, d):
    return table(s, d, "orders")


_LINES = "SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, l_returnflag, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey) AS n FROM lineitem"


def _lines(s, d):
    w = W.partitionBy("l_orderkey").orderBy("l_linenumber", "l_partkey", "l_suppkey")
    rows = table(s, d, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_returnflag")
    return dealt(rows, "l_orderkey").withColumn("n", F.row_number().over(w))


def _grid(s, d):
    w = W.partitionBy("o_custkey").orderBy("o_orderkey")
    cells = F.when(F.col("o_orderkey") % 9 == 0, F.array(F.lit(" "), F.lit(""))).otherwise(F.array("o_orderpriority", "o_orderstatus"))
    return _orders(s, d).select(F.col("o_custkey").alias("table"), (F.row_number().over(w) - 1).alias("row"), cells.alias("cells"))


def _joined(c: str) -> Column:
    return F.array_join(F.transform(c, lambda x: x.cast("string")), ",")


_PATHS = "SELECT 'data/' || lower(o_orderstatus) || '-set/' || CAST(year(o_orderdate) AS VARCHAR) || '/' || o_orderkey || CASE o_orderkey % 4 WHEN 0 THEN '.CSV' WHEN 1 THEN '.md' WHEN 2 THEN '' ELSE '.tar.gz' END AS path FROM orders"


def _paths(s, d):
    k = F.col("o_orderkey")
    end = F.when(k % 4 == 0, ".CSV").when(k % 4 == 1, ".md").when(k % 4 == 2, "").otherwise(".tar.gz")
    return _orders(s, d).select(F.concat(F.lit("data/"), F.lower("o_orderstatus"), F.lit("-set/"), F.year("o_orderdate").cast("string"), F.lit("/"), k.cast("string"), end).alias("path"))


QUERIES = {
    "collection_versions": (
        lambda s, d: with_active_version(table(s, d, "customer").select(F.col("c_custkey").alias("id"), (F.col("c_custkey") * 3).alias("active_id")), _orders(s, d).select(F.col("o_orderkey").alias("id"), "o_orderstatus")).select("id", F.col("version.o_orderstatus").alias("status")),
        "SELECT c_custkey AS id, o_orderstatus AS status FROM customer LEFT JOIN orders ON o_orderkey = c_custkey * 3",
    ),
    "resource_links": (
        lambda s, d: links(
            table(s, d, "lineitem").select(F.col("l_orderkey").alias("node_id"), F.col("l_partkey").alias("resource_id"), F.col("l_returnflag").alias("role"), F.col("l_linenumber").alias("ordinal")),
            table(s, d, "part").filter("p_partkey % 6 <> 0").select(F.col("p_partkey").alias("id"), F.col("p_name").alias("logical_path"), F.sha2("p_name", 256).alias("sha256"), F.col("p_size").alias("byte_size")),
            _orders(s, d).filter("o_orderkey % 5 <> 0").select(F.col("o_orderkey").alias("id"), F.col("o_orderpriority").alias("title"), F.col("o_orderstatus").alias("kind")),
        ),
        "SELECT l_orderkey AS node_id, l_partkey AS resource_id, l_returnflag AS role, l_linenumber AS ordinal, p_name AS logical_path, sha256(p_name) AS sha256, p_size AS byte_size, o_orderpriority AS title, o_orderstatus AS kind FROM lineitem JOIN part ON p_partkey = l_partkey AND p_partkey % 6 <> 0 JOIN orders ON o_orderkey = l_orderkey AND o_orderkey % 5 <> 0",
    ),
    "units_with_nodes": (
        lambda s, d: denormalised(table(s, d, "lineitem").select(F.col("l_orderkey").alias("node_id"), F.col("l_linenumber").alias("ordinal"), "l_partkey"), _orders(s, d).select(F.col("o_orderkey").alias("id"), F.col("o_orderpriority").alias("path"), F.col("o_orderstatus").alias("kind")), ("path", "kind")),
        "SELECT l_orderkey AS node_id, l_linenumber AS ordinal, l_partkey, o_orderpriority AS path, o_orderstatus AS kind FROM lineitem JOIN orders ON o_orderkey = l_orderkey",
    ),
    "parent_resolution": (
        lambda s, d: parents(table(s, d, "part").select(F.col("p_partkey").alias("id"), F.when(F.col("p_partkey") % 7 == 0, F.concat(F.lit("n"), F.col("p_partkey").cast("string"))).otherwise(F.concat(F.lit("n"), (F.col("p_partkey") - F.col("p_partkey") % 7).cast("string"), F.lit("/"), F.col("p_partkey").cast("string"))).alias("path")).filter("id % 35 <> 0")).select("id", "parent_id", "orphan"),
        "SELECT p_partkey AS id, CASE WHEN p_partkey % 7 <> 0 AND (p_partkey - p_partkey % 7) % 35 <> 0 THEN p_partkey - p_partkey % 7 END AS parent_id, p_partkey % 7 <> 0 AND (p_partkey - p_partkey % 7) % 35 = 0 AS orphan FROM part WHERE p_partkey % 35 <> 0",
    ),
    "grouping_items": (
        lambda s, d: grouping_items(_orders(s, d).select(F.col("o_orderkey").alias("path"), F.when(F.col("o_custkey") % 3 == 0, F.col("o_custkey")).alias("part_of"))).select("path"),
        "SELECT o_orderkey AS path FROM orders WHERE o_orderkey IN (SELECT o_custkey FROM orders WHERE o_custkey % 3 = 0)",
    ),
    "name_conflicts": (
        lambda s, d: name_conflicts(table(s, d, "part").select(F.col("p_partkey").alias("id"), F.col("p_name").alias("name")), table(s, d, "part").filter("p_partkey % 2 = 0").select((F.col("p_partkey") - F.col("p_partkey") % 4).alias("id"), F.col("p_name").alias("name"))),
        "SELECT DISTINCT a.p_partkey AS id, a.p_name AS name FROM part a JOIN part b ON a.p_name = b.p_name AND b.p_partkey % 2 = 0 AND b.p_partkey - b.p_partkey % 4 <> a.p_partkey",
    ),
    "resource_resolution": (
        lambda s, d: (lambda h: resolved(h.select("sha256", "doc_id"), ("local", h.filter("doc_id % 3 = 0").select("sha256", F.when(F.col("doc_id") % 2 == 0, F.col("sha256")).alias("checked"))), ("cache", h.filter("doc_id % 5 < 3").select("sha256", F.col("sha256").alias("checked")))).select("doc_id", "found_in"))(table(s, d, "documents").select("doc_id", F.sha2(F.col("doc_id").cast("string"), 256).alias("sha256"))),
        "SELECT doc_id, CASE WHEN doc_id % 6 = 0 THEN 'local' WHEN doc_id % 5 < 3 THEN 'cache' END AS found_in FROM documents",
    ),
    "card_depths": (
        lambda s, d: depths(_orders(s, d).select(F.col("o_orderkey").alias("id"), F.col("o_orderpriority").alias("path"), F.col("o_custkey").alias("parent_id"), F.lit(1).alias("ordinal"), F.array_repeat(F.col("o_orderkey"), (F.col("o_orderkey") % 5 + 1).cast("int")).alias("tree_path"), F.col("o_orderstatus").alias("kind"), F.col("o_orderpriority").alias("title"), F.col("o_orderpriority").alias("description"))).select("id", "depth", "kind"),
        "SELECT o_orderkey AS id, o_orderkey % 5 AS depth, o_orderstatus AS kind FROM orders",
    ),
    "evidence_page": (
        lambda s, d: evidence(_orders(s, d).orderBy(F.desc("o_totalprice"), "o_orderkey").limit(20).select(F.col("o_totalprice").alias("score"), F.col("o_orderkey").alias("unit_id"), F.col("o_custkey").alias("node_id"), F.when(F.col("o_orderstatus") == "F", "card").otherwise("content_text").alias("unit_type"), F.when(F.col("o_orderkey") % 2 == 0, "unit").alias("unit_locator"), F.lit("node").alias("node_locator")), 40),
        "SELECT 40 + row_number() OVER (ORDER BY o_totalprice DESC, o_orderkey) AS rank, o_totalprice AS score, o_orderkey AS unit_id, o_custkey AS node_id, CASE WHEN o_orderstatus = 'F' THEN 'card' ELSE 'content' END AS target, CASE WHEN o_orderkey % 2 = 0 THEN 'unit' ELSE 'node' END AS locator FROM orders ORDER BY o_totalprice DESC, o_orderkey LIMIT 20",
    ),
    "response_counts": (
        lambda s, d: _orders(s, d).groupBy("o_custkey").agg(F.count(F.lit(1)).alias("hits")).select("o_custkey", response(F.col("o_custkey") % 3 != 0, F.col("hits"), 20).alias("reranked")),
        "SELECT o_custkey, CASE WHEN o_custkey % 3 <> 0 THEN least(count(*), 20) ELSE 0 END AS reranked FROM orders GROUP BY o_custkey",
    ),
    "directory_nodes": (
        lambda s, d: directories(_paths(s, d)),
        f"SELECT DISTINCT p AS path, trim(translate(list_extract(string_split(p, '/'), -1), '-_', '  ')) AS title FROM (SELECT unnest(list_transform(range(1, len(q)), lambda n: array_to_string(q[1:n], '/'))) AS p FROM (SELECT string_split(path, '/') AS q FROM ({_PATHS})))",
    ),
    "suffix_counts": (
        lambda s, d: suffix_counts(_paths(s, d)),
        "SELECT CASE o_orderkey % 4 WHEN 0 THEN 'csv' WHEN 1 THEN 'md' WHEN 2 THEN 'file' ELSE 'gz' END AS suffix, count(*) AS n FROM orders GROUP BY 1",
    ),
    "section_keys": (
        lambda s, d: section_keys(_lines(s, d).select(F.col("l_orderkey").alias("doc"), F.col("n").alias("pos"), "l_returnflag"), F.lower("l_returnflag")).select("doc", "pos", "key"),
        f"SELECT doc, pos, CASE WHEN k > 1 THEN slug || ':' || k ELSE slug END AS key FROM (SELECT l_orderkey AS doc, n AS pos, lower(l_returnflag) AS slug, row_number() OVER (PARTITION BY l_orderkey, l_returnflag ORDER BY n) AS k FROM ({_LINES}))",
    ),
    "numbered_titles": (
        lambda s, d: numbered_titles(_lines(s, d).select(F.col("l_orderkey").alias("doc"), F.col("n").alias("pos"), F.col("l_returnflag").alias("title"))),
        f"SELECT l_orderkey AS doc, n AS pos, CASE WHEN count(*) OVER (PARTITION BY l_orderkey, l_returnflag) > 1 THEN l_returnflag || ' — Table ' || n ELSE l_returnflag END AS title FROM ({_LINES})",
    ),
    "header_names": (
        lambda s, d: table(s, d, "orders").select("o_orderkey", F.array_join(unique_names(F.array("o_orderstatus", F.when(F.col("o_orderkey") % 3 == 0, " ").otherwise(F.col("o_orderstatus")), F.lit("F"))), ",").alias("names")),
        """SELECT o_orderkey, concat_ws(',', o_orderstatus, CASE WHEN o_orderkey % 3 = 0 THEN 'Column 2' ELSE o_orderstatus || ' (2)' END, CASE WHEN o_orderstatus <> 'F' THEN 'F' WHEN o_orderkey % 3 = 0 THEN 'F (2)' ELSE 'F (3)' END) AS names FROM orders""",
    ),
    "first_titles": (
        lambda s, d: table(s, d, "documents").select("doc_id", first_title(F.col("text"), "the", F.concat(F.col("source"), F.lit("_doc-"), F.col("doc_id").cast("string"))).alias("title")),
        "SELECT doc_id, coalesce(list_filter(list_transform(string_split(text, chr(10))[1:100], lambda x: trim(ltrim(trim(x), '#'))), lambda x: contains(lower(x), 'the') AND length(x) <= 120)[1], trim(translate(source || '_doc-' || doc_id, '-_', '  '))) AS title FROM documents",
    ),
    "status_counts": (
        lambda s, d: status_counts(_orders(s, d), "o_orderstatus", ("O", "failed", "verified")),
        "SELECT status, max(n) AS n FROM (SELECT o_orderstatus AS status, count(*) AS n FROM orders GROUP BY 1 UNION ALL SELECT unnest(['O', 'failed', 'verified']), 0) GROUP BY status",
    ),
    "usage_sums": (
        lambda s, d: usage_sums(table(s, d, "lineitem").select(F.create_map(F.lit("input"), F.col("l_partkey").cast("string"), F.col("l_returnflag"), F.col("l_linenumber").cast("string"), F.lit("cost"), F.col("l_tax").cast("string")).alias("u")), "u"),
        "SELECT 'input' AS key, CAST(sum(l_partkey) AS BIGINT) AS total FROM lineitem UNION ALL SELECT l_returnflag, CAST(sum(l_linenumber) AS BIGINT) FROM lineitem GROUP BY l_returnflag",
    ),
    "commit_stats": (
        lambda s, d: commit_stats(_orders(s, d), table(s, d, "part").select(F.when(F.col("p_partkey") % 3 == 0, "raw").otherwise("package").alias("namespace")), table(s, d, "lineitem").select((F.col("l_linenumber") > 2).alias("reused"))),
        "SELECT (SELECT count(*) FROM orders) AS nodes, (SELECT count(*) FROM part WHERE p_partkey % 3 = 0) AS raw_sources, (SELECT count(*) FROM part) AS resources, count(*) AS units, count(*) FILTER (l_linenumber <= 2) AS embedded, count(*) FILTER (l_linenumber > 2) AS reused FROM lineitem",
    ),
    "node_hashes": (
        lambda s, d: node_hashes(
            _orders(s, d).select(F.col("o_orderkey").alias("id"), F.col("o_orderstatus").alias("kind"), F.col("o_orderpriority").alias("title"), F.col("o_orderpriority").alias("body")),
            _lines(s, d).select(F.col("l_orderkey").alias("node_id"), F.lit("content").alias("role"), F.col("n").alias("ordinal"), F.sha2(F.col("l_partkey").cast("string"), 256).alias("sha256")),
            ["title", "kind"],
        ),
        f"""SELECT o_orderkey AS id, sha256('{{"kind":"' || o_orderstatus || '","title":"' || o_orderpriority || '"}}' || chr(10) || o_orderpriority || chr(10) || coalesce(h, '')) AS node_hash FROM orders
        LEFT JOIN (SELECT l_orderkey, string_agg(sha256(CAST(l_partkey AS VARCHAR)), chr(10) ORDER BY n) AS h FROM ({_LINES}) GROUP BY l_orderkey) ON l_orderkey = o_orderkey""",
    ),
    "csv_shapes": (
        lambda s, d: csv_shape(_grid(s, d)).select("table", "rows", "data_rows", "columns", _joined("empty_rows").alias("empty_rows"), F.array_join(F.transform("head", lambda x: x["first"]), ",").alias("head"), F.array_join(F.transform("tail", lambda x: x["row"].cast("string")), ",").alias("tail")),
        """WITH g AS (SELECT o_custkey AS t, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) - 1 AS r, o_orderkey % 9 = 0 AS blank, CASE WHEN o_orderkey % 9 = 0 THEN ' ' ELSE o_orderpriority END AS c, count(*) OVER (PARTITION BY o_custkey) AS n FROM orders)
        SELECT t AS "table", count(*) AS rows, count(*) FILTER (r > 0) AS data_rows, 2 AS columns, coalesce(string_agg(CAST(r AS VARCHAR), ',' ORDER BY r) FILTER (r > 0 AND blank), '') AS empty_rows,
          coalesce(string_agg(c, ',' ORDER BY r) FILTER (r BETWEEN 1 AND 3), '') AS head, coalesce(string_agg(CAST(r AS VARCHAR), ',' ORDER BY r) FILTER (r > 0 AND r > n - 7), '') AS tail FROM g GROUP BY t""",
    ),
    "merged_members": (
        lambda s, d: merged_members(_lines(s, d).select(F.col("l_partkey").alias("group"), F.struct("l_orderkey", "n").alias("pos"), F.concat_ws("-", F.col("l_orderkey").cast("string"), F.col("n").cast("string")).alias("id")), _lines(s, d).select(F.concat_ws("-", F.col("l_orderkey").cast("string"), F.col("n").cast("string")).alias("id"), F.col("l_returnflag").alias("title"), F.col("l_linenumber").alias("page"))).select("group", F.array_join("ids", ",").alias("ids"), "title_hint", _joined("pages").alias("pages")),
        f"""SELECT l_partkey AS "group", string_agg(l_orderkey || '-' || n, ',' ORDER BY l_orderkey, n) AS ids, arg_min(l_returnflag, l_orderkey * 100 + n) AS title_hint, array_to_string(list_sort(list_distinct(list(l_linenumber))), ',') AS pages FROM ({_LINES}) GROUP BY l_partkey""",
    ),
    "document_sequence": (
        lambda s, d: document_sequence(
            _lines(s, d).select((F.col("l_orderkey") % 2000).alias("doc"), F.concat_ws("-", F.col("l_orderkey").cast("string"), F.col("n").cast("string")).alias("block"), F.col("l_orderkey").alias("page"), F.col("n").alias("pos"), F.lower("l_returnflag").alias("kind"), (F.col("l_partkey") % 10 == 0).alias("ignored")),
            _lines(s, d).filter("l_returnflag = 'A'").select(F.concat_ws("-", F.col("l_orderkey").cast("string"), F.col("n").cast("string")).alias("block"), (F.col("l_suppkey") % 50).alias("table")),
        ).select("doc", "place", "block", "table", "kind"),
        f"""WITH b AS (SELECT l_orderkey % 2000 AS doc, l_orderkey || '-' || n AS block, l_orderkey AS page, n AS pos, CASE WHEN l_returnflag = 'A' THEN l_suppkey % 50 END AS t, lower(l_returnflag) AS kind FROM ({_LINES}) WHERE l_partkey % 10 <> 0),
        o AS (SELECT *, row_number() OVER (PARTITION BY doc, t ORDER BY page, pos, block) AS nth FROM b)
        SELECT doc, row_number() OVER (PARTITION BY doc ORDER BY page, pos, block) AS place, block, t AS "table", CASE WHEN t IS NOT NULL THEN 'table' ELSE kind END AS kind FROM o WHERE t IS NULL OR nth = 1""",
    ),
    "child_order": (
        lambda s, d: child_order(_lines(s, d).select(F.concat_ws("-", F.col("l_orderkey").cast("string"), F.col("n").cast("string")).alias("key"), F.col("l_orderkey").alias("parent"), F.col("l_linenumber").alias("hint"), F.col("l_returnflag").alias("item_path"), F.lit("text").alias("kind"), F.col("l_partkey").alias("title"))).select("key", "ordinal"),
        f"SELECT l_orderkey || '-' || n AS key, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_returnflag, l_partkey, l_orderkey || '-' || n) AS ordinal FROM ({_LINES})",
    ),
}
