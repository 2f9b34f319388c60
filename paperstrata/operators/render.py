"""Writing things down: tables as Markdown or HTML, packages of cards, reports, archives, and replacements inside documents.

Everything per row is a column expression; a document or a table is one row, and nothing larger is gathered.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from ..functions import text as T
from ..session import table

WIDEST = 10


def _each(rows: Column, cell) -> Column:
    return F.transform(rows, lambda r: F.transform(r, lambda c: cell(F.coalesce(c, F.lit("")))))


def padded(rows: Column) -> Column:
    """Rows of cells as wide as the widest, filled with empty cells."""
    width = F.array_max(F.transform(rows, lambda r: F.size(r)))
    return F.transform(rows, lambda r: F.concat(r, F.array_repeat(F.lit(""), width - F.size(r))))


def pipe_table(rows: Column) -> Column:
    """A pipe table with escaped backslashes, pipes and line breaks; the first row is the header."""
    cell = lambda c: F.regexp_replace(T.pipe_cell(c), "\\r\\n|\\n|\\r", "<br>")
    line = lambda r: F.concat(F.lit("| "), F.array_join(r, " | "), F.lit(" |"))
    lines = F.transform(_each(rows, cell), line)
    rule = line(F.array_repeat(F.lit("---"), F.size(F.get(rows, F.lit(0)))))
    return F.array_join(F.concat(F.slice(lines, 1, 1), F.array(rule), F.slice(lines, 2, F.greatest(F.size(lines), F.lit(1)))), "\n")


def html_table(rows: Column) -> Column:
    """An HTML table with a head of the first row; line breaks of the body as <br>."""
    row = lambda r, tag: F.concat(F.lit("<tr>"), F.array_join(F.transform(r, lambda c: F.concat(F.lit(f"<{tag}>"), c, F.lit(f"</{tag}>"))), ""), F.lit("</tr>"))
    cells = _each(rows, T.escape_html)
    body = F.transform(F.slice(cells, 2, F.greatest(F.size(cells), F.lit(1))), lambda r: row(F.transform(r, lambda c: F.replace(c, F.lit("\n"), F.lit("<br>"))), "td"))
    return F.concat(F.lit("<table><thead>"), row(F.get(cells, F.lit(0)), "th"), F.lit("</thead><tbody>"), F.array_join(body, ""), F.lit("</tbody></table>"))


def table_text(rows: Column) -> Column:
    """A pipe table if there are at most WIDEST columns and no cell has a line break or pipe, else HTML; empty without rows."""
    wide = padded(rows)
    plain = (F.size(F.get(wide, F.lit(0))) <= WIDEST) & F.forall(wide, lambda r: F.forall(r, lambda c: ~F.coalesce(c, F.lit("")).rlike("[\\n|]")))
    return F.when(F.size(rows) < 1, F.lit("")).when(plain, pipe_table(wide)).otherwise(html_table(wide))


def package_paths(nodes: DataFrame) -> DataFrame:
    """Nodes (id, parent_id, ordinal, kind, tree_path, slug) of a tree with ``card``, the path of their card in a package: groups
    are folders with an index, others files with their order in five digits, without it directly under the root."""
    folders = nodes.select(F.col("id").alias("_id"), F.when((F.col("kind") == "group") & F.col("parent_id").isNotNull(), F.col("slug")).alias("_slug"))
    above = nodes.select("id", F.posexplode("tree_path").alias("_pos", "_id")).join(folders, "_id").filter("_slug IS NOT NULL")
    folder = above.groupBy("id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("_pos", "_slug"))), lambda x: x["_slug"]), "/").alias("_folder"))
    file = F.when(F.col("kind") == "group", "index.node.md").when(F.size("tree_path") == 2, F.concat("slug", F.lit(".node.md"))).otherwise(F.concat(F.lpad(F.col("ordinal").cast("string"), 5, "0"), F.lit("--"), "slug", F.lit(".node.md")))
    return nodes.join(folder, "id", "left").withColumn("card", F.concat_ws("/", F.col("_folder"), file)).drop("_folder")


def card_text(metadata: list[str], body: str = "body") -> Column:
    """A card: metadata as JSON, which is YAML, between rules, then the body."""
    return F.concat(F.lit("---\n"), F.to_json(F.struct(*metadata)), F.lit("\n---\n\n"), F.col(body))


def archive_entries(files: DataFrame) -> DataFrame:
    """Files (path, content) of an archive in order of path, with their place and where their bytes begin."""
    w = W.partitionBy("archive").orderBy("path")
    size = F.octet_length("content").cast("long")
    return files.withColumn("place", F.row_number().over(w)).withColumn("begin", F.sum(size).over(w) - size)


def report(tables: DataFrame, known: tuple[str, ...]) -> DataFrame:
    """Runs of tables (run, id, status, accepted, title, millis, tokens) to a report each: accepted, tables, counts (JSON of known
    statuses, zero-filled), millis, tokens, failed (ids in order) and a Markdown text. A run is one report, so its tables are
    one list."""
    counts = [F.count(F.when(F.col("status") == k, 1)).alias(f"_{k}") for k in known]
    one = F.struct("id", F.concat(F.lit("- `"), F.col("id"), F.lit("`: "), F.col("status"), F.lit(" ("), F.coalesce("title", F.lit("")), F.lit(")")).alias("line"))
    failed = F.array_sort(F.collect_list(F.when(~F.col("accepted"), F.col("id"))))
    per_run = tables.groupBy("run").agg(F.min("accepted").alias("accepted"), F.count(F.lit(1)).alias("tables"), *counts, F.sum("millis").alias("millis"), F.sum("tokens").alias("tokens"), failed.alias("failed"), F.array_sort(F.collect_list(one)).alias("_lines"))
    head = [F.lit("# Report"), F.lit(""), F.concat(F.lit("- Accepted: "), F.col("accepted").cast("string")), F.concat(F.lit("- Tables: "), F.col("tables").cast("string"))]
    lines = F.concat(F.array(*head, *[F.concat(F.lit(f"- {k}: "), F.col(f"_{k}").cast("string")) for k in known], F.lit(""), F.lit("## Tables"), F.lit("")), F.transform("_lines", lambda x: x["line"]))
    return per_run.select("run", "accepted", "tables", F.to_json(F.struct(*[F.col(f"_{k}").alias(k) for k in known])).alias("counts"), "millis", "tokens", "failed", F.concat(F.array_join(lines, "\n"), F.lit("\n")).alias("text"))


def replaced(documents: DataFrame, spans: DataFrame) -> DataFrame:
    """Documents (id, text) with spans (id, replacement, start, end, markdown) replaced, code points from 0, end exclusive: the
    first span of a replacement gets its Markdown, the others nothing. Column ``fault`` says why a document was left as it is:
    invalid span, overlapping spans. A document's spans are one list."""
    nth = F.row_number().over(W.partitionBy("id", "replacement").orderBy("start", "end"))
    one = F.struct("start", "end", F.when(F.col("_nth") == 1, F.col("markdown")).otherwise(F.lit("")).alias("put"))
    lists = spans.withColumn("_nth", nth).groupBy("id").agg(F.array_sort(F.collect_list(one)).alias("_spans"))
    both = documents.join(lists, "id", "left").withColumn("_n", F.char_length("text"))
    bad = F.exists("_spans", lambda s: (s["start"] < 0) | (s["start"] >= s["end"]) | (s["end"] > F.col("_n")))
    over = F.exists(F.zip_with(F.slice("_spans", 1, F.size("_spans") - 1), F.slice("_spans", 2, F.size("_spans") - 1), lambda a, b: b["start"] < a["end"]), lambda x: x)
    fault = F.when(F.col("_spans").isNull(), F.lit(None).cast("string")).when(bad, "invalid span").when(over, "overlapping spans")
    piece = lambda a, b: F.substring("text", a + 1, b - a)
    parts = F.zip_with(F.col("_spans"), F.concat(F.array(F.lit(0).cast("long")), F.transform("_spans", lambda s: s["end"].cast("long"))), lambda s, before: F.when(s.isNotNull(), F.concat(piece(before.cast("int"), s["start"].cast("int")), s["put"])).otherwise(piece(before.cast("int"), F.col("_n"))))
    whole = both.withColumn("fault", fault)
    return whole.withColumn("text", F.when(F.col("_spans").isNull() | F.col("fault").isNotNull(), F.col("text")).otherwise(F.array_join(parts, ""))).drop("_spans", "_n")


def anchors(text: Column, before: Column, after: Column, size: int = 8) -> Column:
    """start and end (code points) of what lies between the last ``size`` words of ``before`` and the first of ``after`` in
    ``text``, case aside. An anchor that isn't there, or is there twice, is the text's begin or end. Null if nothing is left."""
    found = lambda t: F.regexp_extract_all(F.lower(t), F.lit("[\\p{L}\\p{N}_]+"), F.lit(0))
    last, first = found(before), found(after)
    last = F.slice(last, F.greatest(F.size(last) - size + 1, F.lit(1)), size)

    def place(needle: Column, behind: bool) -> Column:
        """The place behind (or before) the only match of the words, with anything but word characters between them."""
        pattern = F.concat(F.lit("(?<![\\p{L}\\p{N}_])(?:"), F.array_join(F.transform(needle, lambda w: w), "[^\\p{L}\\p{N}_]+"), F.lit(")(?![\\p{L}\\p{N}_])"))
        # overlapping matches count too, so they are looked for from every word's begin
        hits = F.size(F.regexp_extract_all(F.lower(text), F.concat(F.lit("(?="), pattern, F.lit(")")), F.lit(0)))
        match = F.regexp_extract_all(F.lower(text), pattern, F.lit(0))
        at = F.position(F.get(match, F.lit(0)), F.regexp_replace(F.lower(text), F.concat(F.lit("(?s)^.*?(?="), pattern, F.lit(")")), F.lit("")))
        begin = F.char_length(text) - F.char_length(F.regexp_replace(F.lower(text), F.concat(F.lit("(?s)^.*?(?="), pattern, F.lit(")")), F.lit(""))) + at - 1
        return F.when((F.size(needle) > 0) & (hits == 1), begin + F.char_length(F.get(match, F.lit(0))) if behind else begin)

    ends = F.struct(F.coalesce(place(last, True), F.lit(0)).alias("start"), F.coalesce(place(F.slice(first, 1, size), False), F.char_length(text)).alias("end"))
    return F.element_at(F.transform(F.array(ends), lambda e: F.when(e["start"] < e["end"], e)), 1)


def line_offsets(lines: DataFrame) -> DataFrame:
    """Lines (doc, pos, line), line ends included, with start and end in their document (code points)."""
    n, w = F.char_length("line").cast("long"), W.partitionBy("doc").orderBy("pos")
    return lines.withColumn("end", F.sum(n).over(w)).withColumn("start", F.col("end") - n)


def joined_words(words: Column) -> Column:
    """Words (x0, y0, x1, y1, text) in order as text. A hyphen at a line's end before a small letter goes, a hyphen of a compound
    stays without a space, other words are a space apart."""
    start = F.struct(F.lit("").alias("out"), F.lit(None).cast("struct<x0:double,y0:double,x1:double,y1:double,text:string>").alias("last"))

    def add(acc: Column, w: Column) -> Column:
        part, out, last = F.trim(w["text"]), acc["out"], acc["last"]
        new_line = F.abs(w["y0"] - last["y0"]) > 0.25
        stem = F.regexp_replace(last["text"], "-$", "")
        compound = stem.isin("MS", "NS", "ONS") | (F.char_length(stem) <= 2) | (~new_line & (w["x0"] - last["x1"] <= 0.15))
        wrapped = out.rlike("\\p{Ll}-$") & part.rlike("^\\p{Ll}") & new_line
        cut = F.concat(F.substring(out, F.lit(1), F.char_length(out) - 1), part)
        hyphen = out.endswith("-") & (F.char_length(out) > 1)
        text = F.when(out == "", part).when(hyphen & wrapped, cut).when(hyphen & compound, F.concat(out, part)).otherwise(F.concat(out, F.lit(" "), part))
        return F.when(part == "", acc).otherwise(F.struct(text.alias("out"), w.alias("last")))

    return F.aggregate(words, start, add)["out"]


def table_nodes(tables: DataFrame) -> DataFrame:
    """Tables as rows (table, row from 0: the header, cells) to a node each: row_count, columns, description and a preview of
    the first five rows. Only the header and the preview are gathered."""
    edge = F.when(F.col("row") <= 5, F.struct("row", "cells"))
    one = tables.groupBy("table").agg(F.count(F.when(F.col("row") > 0, 1)).alias("row_count"), F.array_sort(F.collect_list(edge)).alias("_e"))
    names = F.transform(F.get("_e", F.lit(0))["cells"], lambda c: F.trim(c))
    listed = F.concat(F.array_join(F.slice(names, 1, 6), ", "), F.when(F.size(names) <= 6, ".").otherwise(", and additional fields."))
    told = F.concat(F.lit("Table with "), F.col("row_count").cast("string"), F.lit(" rows and "), F.size(names).cast("string"), F.lit(" columns: "), listed)
    return one.select("table", "row_count", names.alias("columns"), told.alias("description"), F.transform(F.slice("_e", 2, 5), lambda x: x["cells"]).alias("preview"))


def paragraph_groups(texts: Column, target: int = 12_000) -> Column:
    """Paragraphs in groups: a new one begins where the next paragraph would bring a group over ``target`` characters."""
    start = F.struct(F.array().cast("array<array<string>>").alias("done"), F.array().cast("array<string>").alias("now"), F.lit(0).alias("size"))

    def add(acc: Column, t: Column) -> Column:
        full, n = (F.size(acc["now"]) > 0) & (acc["size"] + F.char_length(t) > target), F.char_length(t)
        return F.struct(F.when(full, F.array_append(acc["done"], acc["now"])).otherwise(acc["done"]).alias("done"), F.when(full, F.array(t)).otherwise(F.array_append(acc["now"], t)).alias("now"), F.when(full, n).otherwise(acc["size"] + n).alias("size"))

    return F.aggregate(texts, start, add, lambda a: F.when(F.size(a["now"]) > 0, F.array_append(a["done"], a["now"])).otherwise(a["done"]))


def readable(title: Column, texts: Column, skipped: tuple[str, ...] = ("contents", "inhalt", "inhaltsverzeichnis")) -> Column:
    """Whether a section is worth a unit: it has text with a letter or digit and isn't a list of contents."""
    return (F.size(texts) > 0) & ~F.lower(F.trim(title)).isin(*skipped) & F.exists(texts, lambda t: t.rlike("[\\p{L}\\p{N}]"))


def _turns(s, d):
    c = table(s, d, "conversations").select("conv_id", F.struct("turn", "role", "text").alias("x"))
    return c.groupBy("conv_id").agg(F.array_sort(F.collect_list("x")).alias("xs"))


_TURNS = "SELECT conv_id, list(role ORDER BY turn, role, text) AS roles, list(text ORDER BY turn, role, text) AS texts FROM conversations GROUP BY conv_id"
_E = "replace(replace(replace(replace(replace({0}, '&', '&amp;'), '<', '&lt;'), '>', '&gt;'), '\"', '&quot;'), '''', '&#x27;')"


def _grid(s, d):
    return _turns(s, d).select("conv_id", F.concat(F.array(F.array(F.lit("role"), F.lit("text"))), F.transform("xs", lambda x: F.array(x["role"], F.when(F.col("conv_id") % 3 == 0, F.concat(x["text"], F.lit("\n|"))).otherwise(F.replace(x["text"], F.lit("\n"), F.lit(" "))))) ).alias("rows"))


def _nodes(s, d):
    p = table(s, d, "part")
    k = F.col("p_partkey")
    group = (k - k % 20).cast("string")
    root = s.createDataFrame([("r", None, None, "group", ["r"], "root")], "id string, parent_id string, ordinal int, kind string, tree_path array<string>, slug string")
    groups = p.select(group.alias("id")).distinct().select("id", F.lit("r").alias("parent_id"), F.lit(1).alias("ordinal"), F.lit("group").alias("kind"), F.array(F.lit("r"), F.col("id")).alias("tree_path"), F.concat(F.lit("g"), "id").alias("slug"))
    leaves = p.select(F.concat(F.lit("n"), k.cast("string")).alias("id"), group.alias("parent_id"), (k % 20 + 1).cast("int").alias("ordinal"), F.lit("text").alias("kind"), F.array(F.lit("r"), group, F.concat(F.lit("n"), k.cast("string"))).alias("tree_path"), F.concat(F.lit("s"), k.cast("string")).alias("slug"))
    return root.unionByName(groups).unionByName(leaves)


def _spans(s, d):
    docs = table(s, d, "documents").filter("doc_id % 4 <> 0")
    one = lambda name, a, b: docs.select(F.col("doc_id").alias("id"), F.lit(name).alias("replacement"), F.lit(a).alias("start"), (F.lit(b) + F.when(F.col("doc_id") % 9 == 0, 20).otherwise(0)).alias("end"), F.lit(f"<{name}>").alias("markdown"))
    return one("p", 5, 9).unionByName(one("p", 30, 40)).unionByName(one("q", 12, 13))


QUERIES = {
    "table_text": (
        lambda s, d: _grid(s, d).select("conv_id", table_text(F.col("rows")).alias("text")),
        f"""SELECT conv_id, CASE WHEN conv_id % 3 = 0 THEN '<table><thead><tr><th>role</th><th>text</th></tr></thead><tbody>' || array_to_string(list_transform(range(1, len(roles) + 1), lambda i: '<tr><td>' || {_E.format("roles[i]")} || '</td><td>' || replace({_E.format("texts[i] || chr(10) || '|'")}, chr(10), '<br>') || '</td></tr>'), '') || '</tbody></table>'
        ELSE '| role | text |' || chr(10) || '| --- | --- |' || array_to_string(list_transform(range(1, len(roles) + 1), lambda i: chr(10) || '| ' || replace(roles[i], '\\', '\\\\') || ' | ' || replace(replace(texts[i], chr(10), ' '), '\\', '\\\\') || ' |'), '') END AS text FROM ({_TURNS}) WHERE conv_id % 3 = 0 OR NOT contains(array_to_string(texts, ''), '|')
        UNION ALL SELECT conv_id, '<table><thead><tr><th>role</th><th>text</th></tr></thead><tbody>' || array_to_string(list_transform(range(1, len(roles) + 1), lambda i: '<tr><td>' || {_E.format("roles[i]")} || '</td><td>' || {_E.format("replace(texts[i], chr(10), ' ')")} || '</td></tr>'), '') || '</tbody></table>' FROM ({_TURNS}) WHERE conv_id % 3 <> 0 AND contains(array_to_string(texts, ''), '|')""",
    ),
    "package_paths": (
        lambda s, d: package_paths(_nodes(s, d)).select("id", "card"),
        "SELECT 'r' AS id, 'index.node.md' AS card UNION ALL SELECT DISTINCT CAST(p_partkey - p_partkey % 20 AS VARCHAR), 'g' || (p_partkey - p_partkey % 20) || '/index.node.md' FROM part UNION ALL SELECT 'n' || p_partkey, 'g' || (p_partkey - p_partkey % 20) || '/' || lpad(CAST(p_partkey % 20 + 1 AS VARCHAR), 5, '0') || '--s' || p_partkey || '.node.md' FROM part",
    ),
    "card_texts": (
        lambda s, d: table(s, d, "part").select(F.col("p_partkey").alias("id"), F.col("p_brand").alias("title"), F.col("p_name").alias("body")).select("id", card_text(["id", "title"]).alias("card")),
        """SELECT p_partkey AS id, '---' || chr(10) || '{"id":' || p_partkey || ',"title":"' || p_brand || '"}' || chr(10) || '---' || chr(10) || chr(10) || p_name AS card FROM part""",
    ),
    "archive_entries": (
        lambda s, d: archive_entries(table(s, d, "documents").select(F.col("source").alias("archive"), F.concat(F.lit("d/"), F.col("doc_id").cast("string")).alias("path"), F.col("text").alias("content"))).select("archive", "path", "place", "begin"),
        "SELECT source AS archive, 'd/' || doc_id AS path, row_number() OVER w AS place, CAST(sum(strlen(text)) OVER w - strlen(text) AS BIGINT) AS begin FROM documents WINDOW w AS (PARTITION BY source ORDER BY 'd/' || doc_id)",
    ),
    "run_reports": (
        lambda s, d: report(table(s, d, "orders").select(F.col("o_custkey").alias("run"), F.col("o_orderkey").cast("string").alias("id"), F.when(F.col("o_orderstatus") == "F", "failed").otherwise("verified").alias("status"), (F.col("o_orderstatus") != "F").alias("accepted"), F.col("o_orderpriority").alias("title"), F.col("o_orderkey").alias("millis"), F.col("o_custkey").alias("tokens")), ("verified", "skipped", "failed")).select("run", "accepted", "tables", "counts", "millis", "tokens", F.array_join("failed", ",").alias("failed"), "text"),
        """SELECT o_custkey AS run, bool_and(o_orderstatus <> 'F') AS accepted, count(*) AS tables, '{"verified":' || count(*) FILTER (o_orderstatus <> 'F') || ',"skipped":0,"failed":' || count(*) FILTER (o_orderstatus = 'F') || '}' AS counts, CAST(sum(o_orderkey) AS BIGINT) AS millis, CAST(sum(o_custkey) AS BIGINT) AS tokens,
        coalesce(string_agg(CAST(o_orderkey AS VARCHAR), ',' ORDER BY CAST(o_orderkey AS VARCHAR)) FILTER (o_orderstatus = 'F'), '') AS failed,
        '# Report' || chr(10) || chr(10) || '- Accepted: ' || bool_and(o_orderstatus <> 'F') || chr(10) || '- Tables: ' || count(*) || chr(10) || '- verified: ' || count(*) FILTER (o_orderstatus <> 'F') || chr(10) || '- skipped: 0' || chr(10) || '- failed: ' || count(*) FILTER (o_orderstatus = 'F') || chr(10) || chr(10) || '## Tables' || chr(10) || chr(10)
          || string_agg('- `' || o_orderkey || '`: ' || CASE WHEN o_orderstatus = 'F' THEN 'failed' ELSE 'verified' END || ' (' || o_orderpriority || ')', chr(10) ORDER BY CAST(o_orderkey AS VARCHAR)) || chr(10) AS text FROM orders GROUP BY o_custkey""",
    ),
    "span_replacement": (
        lambda s, d: replaced(table(s, d, "documents").select(F.col("doc_id").alias("id"), "text"), _spans(s, d)).select("id", F.md5("text").alias("text"), "fault"),
        """SELECT doc_id AS id, md5(CASE WHEN doc_id % 4 <> 0 AND f IS NULL THEN text[1:5] || '<p>' || text[10:12] || '<q>' || text[14:30] || text[41:] ELSE text END) AS text, f AS fault
        FROM (SELECT *, CASE WHEN doc_id % 4 = 0 THEN NULL WHEN length(text) < 40 + CASE WHEN doc_id % 9 = 0 THEN 20 ELSE 0 END THEN 'invalid span' WHEN doc_id % 9 = 0 THEN 'overlapping spans' END AS f FROM documents)""",
    ),
    "line_offsets": (
        lambda s, d: line_offsets(table(s, d, "documents").select(F.col("doc_id").alias("doc"), F.posexplode(F.split("text", "(?<=\n)", -1)).alias("pos", "line")).filter("line <> ''")).select("doc", "pos", "start", "end"),
        """SELECT doc, pos, CAST(e - n AS BIGINT) AS start, CAST(e AS BIGINT) AS "end" FROM (SELECT *, sum(n) OVER (PARTITION BY doc ORDER BY pos) AS e FROM (
          SELECT doc_id AS doc, i - 1 AS pos, length(ls[i]) + CASE WHEN i < len(ls) THEN 1 ELSE 0 END AS n FROM (SELECT doc_id, string_split(text, chr(10)) AS ls FROM documents), unnest(range(1, len(ls) + 1)) AS u(i)) WHERE n > 0)""",
    ),
    "table_nodes": (
        lambda s, d: table_nodes(table(s, d, "orders").select(F.col("o_custkey").alias("table"), (F.row_number().over(W.partitionBy("o_custkey").orderBy("o_orderkey")) - 1).alias("row"), F.array("o_orderpriority", "o_orderstatus").alias("cells"))).select("table", "row_count", F.array_join("columns", ",").alias("columns"), "description", F.array_join(F.transform("preview", lambda r: F.get(r, F.lit(0))), ",").alias("preview")),
        """SELECT t AS "table", count(*) - 1 AS row_count, any_value(p || ',' || s) FILTER (r = 0) AS columns, 'Table with ' || (count(*) - 1) || ' rows and 2 columns: ' || any_value(p || ', ' || s) FILTER (r = 0) || '.' AS description, coalesce(string_agg(p, ',' ORDER BY r) FILTER (r BETWEEN 1 AND 5), '') AS preview
        FROM (SELECT o_custkey AS t, o_orderpriority AS p, o_orderstatus AS s, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) - 1 AS r FROM orders) GROUP BY t""",
    ),
    "readable_sections": (
        lambda s, d: table(s, d, "documents").select("doc_id", readable(F.when(F.col("doc_id") % 5 == 0, " Contents ").otherwise(F.col("lang")), F.split("text", "\n")).alias("readable")),
        "SELECT doc_id, doc_id % 5 <> 0 AND regexp_matches(text, '[\\p{L}\\p{N}]') AS readable FROM documents",
    ),
    "joined_words": (
        lambda s, d: table(s, d, "part").select("p_partkey", joined_words(F.array(*[F.struct(F.lit(float(x)).alias("x0"), F.lit(float(y)).alias("y0"), F.lit(x + 1.0).alias("x1"), F.lit(y + 1.0).alias("y1"), t.alias("text")) for x, y, t in ((0, 0, F.col("p_brand")), (5, 0, F.lit("Netz-")), (0, 5, F.col("p_name")), (9, 5, F.lit("MS-")), (20, 5, F.lit("Kabel")), (30, 5, F.lit(" ")), (40, 5, F.lit("Foo-")), (50, 5, F.lit("bar")))])).alias("text")),
        "SELECT p_partkey, p_brand || ' Netz' || p_name || ' MS-Kabel Foo- bar' AS text FROM part",
    ),
    "anchor_spans": (
        lambda s, d: table(s, d, "part").withColumn("text", F.concat(F.lit("Intro words. "), F.upper("p_name"), F.lit(" stop: | cell | "), F.when(F.col("p_partkey") % 3 == 0, "twice twice ").otherwise("then "), F.lit("the end"))).select("p_partkey", anchors(F.col("text"), F.concat(F.lit("intro words "), "p_name", F.lit(" stop")), F.when(F.col("p_partkey") % 3 == 0, "twice").otherwise("then the")).alias("a")).select("p_partkey", "a.start", "a.end"),
        """SELECT p_partkey, 13 + length(p_name) + 5 AS start, CASE WHEN p_partkey % 3 = 0 THEN 13 + length(p_name) + 5 + 11 + 12 + 7 ELSE 13 + length(p_name) + 5 + 11 END AS "end" FROM part""",
    ),
    "paragraph_groups": (
        lambda s, d: table(s, d, "part").select("p_partkey", F.explode(paragraph_groups(F.array_repeat(F.repeat(F.lit("x"), (F.col("p_partkey") % 7 + 1).cast("int")), 20), 30)).alias("g")).select("p_partkey", F.size("g").alias("n")),
        "SELECT p_partkey, least(m, 20 - (i - 1) * m) AS n FROM (SELECT p_partkey, 30 // (p_partkey % 7 + 1) AS m FROM part), unnest(range(1, 21)) AS u(i) WHERE (i - 1) * m < 20",
    ),
}
