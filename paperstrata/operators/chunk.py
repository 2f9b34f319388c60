"""Documents to search units: overlapping chunks, section splits, Markdown sections and tables, table rows.

Packing depends on what was packed before, so it runs per document in Python over Arrow batches; everything around it is a
column expression.
"""

from __future__ import annotations

import re
from collections.abc import Callable

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, StringType, StructField, StructType

from ..functions import text as T
from ..session import dealt, table

CHUNK = pa.list_(pa.struct([("text", pa.string()), ("start_line", pa.int32()), ("end_line", pa.int32())]))
CHUNK_SQL = "array<struct<text: string, start_line: int, end_line: int>>"
#: Texts that a worker holds as Python objects at once, and rows of a table that one task turns to and fro in Python.
PART_ROWS, PYTHON_ROWS = 64, 20_000
SECTION = ArrayType(StructType([StructField("path", ArrayType(StringType())), StructField("text", StringType())]))
RULE = re.compile(r":?-+:?")
HEADING = re.compile(r"(#{1,6})\s+(.+?)\s*$")


def in_parts(work: Callable[[str], list], kind: pa.DataType, sql: str) -> Callable[[Column | str], Column]:
    """A function of a text column, null as empty. Beside its Arrow columns a worker holds the objects of PART_ROWS texts, not of
    a whole batch."""

    @F.arrow_udf(sql)
    def over(text: pa.Array) -> pa.Array:
        parts = [pa.array([work(t or "") for t in text.slice(i, PART_ROWS).to_pylist()], kind) for i in range(0, len(text), PART_ROWS)]
        return pa.concat_arrays(parts) if parts else pa.array([], kind)

    return over


def block_spans(lines: list[str]) -> list[tuple[int, int]]:
    """Half-open line ranges between blank lines. A blank line ends a block only if the block has lines; else it opens one."""
    spans, begin = [], 0
    for i, line in enumerate(lines):
        if not line.strip() and i > begin:
            spans.append((begin, i))
            begin = i + 1
    if begin < len(lines):
        spans.append((begin, len(lines)))
    return spans


def chunk_lines(body: str, target: int = 600, overlap: int = 80) -> list[tuple[str, int, int]]:
    """Chunks of whole blocks with about ``target`` words and 1-based line ranges; the next one repeats the trailing blocks that
    hold ``overlap`` words, at least one block. An empty body is one empty chunk."""
    lines = body.splitlines()
    if not lines:
        return [("", 1, 1)]
    spans = block_spans(lines)
    sizes = [sum(len(line.split()) for line in lines[a:b]) for a, b in spans]
    out, first, held = [], 0, 0

    def emit(last: int) -> None:
        out.append(("\n\n".join("\n".join(lines[a:b]) for a, b in spans[first:last]), spans[first][0] + 1, spans[last - 1][1]))

    for i, size in enumerate(sizes):
        if i > first and held + size > target:
            emit(i)
            start, held = first, 0
            first = i
            while first > start and (first == i or held < overlap):
                first -= 1
                held += sizes[first]
        held += size
    if spans:
        emit(len(spans))
    return out


def markdown_chunks(body: Column | str, target: int = 600, overlap: int = 80) -> Column:
    return in_parts(lambda b: [{"text": t, "start_line": s, "end_line": e} for t, s, e in chunk_lines(b, target, overlap)], CHUNK, CHUNK_SQL)(body)


def by_words(text: str, most: int) -> list[str]:
    """``text`` in runs of ``most`` words."""
    words = text.split()
    return [" ".join(words[i : i + most]) for i in range(0, len(words), most)]


def pieces_of(text: str, most: int, count: Callable[[str], int], cut: Callable[[str, int], list[str]] = by_words) -> list[str]:
    """``text`` in pieces of at most ``most`` tokens: sentences, or the clauses of a single one, as many together as fit. One that
    is too long by itself is cut every 120 words, and by tokens (``cut``) where that doesn't help; its pieces stand before
    the sentences that were being put together when it came, and those go on after it."""
    if count(text) <= most:
        return [text]
    parts: list[str] = []
    for pattern in (r"(?<=[.!?])\s+", r"(?<=[,;:])\s+"):
        if len(parts) < 2:
            parts = [p.strip() for p in re.split(pattern, text) if p.strip()]
    out: list[str] = []
    together = ""
    for part in parts:
        if count(part) > most:
            runs = by_words(part, 120) if len(part.split()) > 1 else [part]
            out += [piece for run in runs for piece in ([run] if count(run) <= most else cut(run, most))]
        elif together and count(f"{together} {part}") > most:
            out.append(together)
            together = part
        else:
            together = f"{together} {part}".strip()
    return [*out, together] if together else out


def split_section(text: str, most: int = 700, count: Callable[[str], int] = lambda t: len(t.split()), cut: Callable[[str, int], list[str]] = by_words) -> list[str]:
    """Chunks without overlap of at most ``most`` tokens, of blocks where they fit; ``count`` and ``cut`` are the tokenizer's."""
    out: list[list[str]] = [[]]
    held = 0
    for block in (b.strip() for b in re.split(r"\n\s*\n", text) if b.strip()):
        for piece in pieces_of(block, most, count, cut):
            n = count(piece)
            if out[-1] and held + n > most:
                out.append([])
                held = 0
            out[-1].append(piece)
            held += n
    return ["\n\n".join(parts) for parts in out if parts] or [text]


def word_count(text: str) -> int:
    return len(text.split())


def section_chunks(text: Column | str, most: int = 700, count: Callable[[str], int] = word_count, cut: Callable[[str, int], list[str]] = by_words) -> Column:
    """``count`` gives the tokens of a text and ``cut`` cuts it by tokens, by whatever tokenizer the units are made for."""
    return in_parts(lambda t: split_section(t, most, count, cut), pa.list_(pa.string()), "array<string>")(text)


def sections_of(text: str) -> list[tuple[list[str], str]]:
    """Heading path and text of each section, heading line included; text before the first heading has an empty path."""
    out: list[tuple[list[str], list[str]]] = [([], [])]
    for line in text.splitlines(keepends=True):
        if found := HEADING.match(line.rstrip("\n")):
            out.append(([*out[-1][0][: len(found[1]) - 1], found[2].strip()], []))
        out[-1][1].append(line)
    return [(path, "".join(own)) for path, own in out if own]


@F.pandas_udf(SECTION)
def markdown_sections(text: pd.Series) -> pd.Series:
    return text.map(lambda t: [{"path": p, "text": s} for p, s in sections_of(t or "")])


def has_body(section: Column) -> Column:
    """More than a heading."""
    return F.trim(F.regexp_replace(section, "^#{1,6}\\s+[^\\n]*\\n?", "")) != ""


def tables_of(text: str) -> list[list[list[str]]]:
    """Pipe tables: a header row, a rule row as wide, then rows as wide."""
    cells = lambda line: [c.strip().replace("\\|", "|") for c in re.split(r"(?<!\\)\|", re.sub(r"(?<!\\)\|$", "", line.strip()).removeprefix("|"))]
    lines, out, i = text.splitlines(), [], 0
    while i + 1 < len(lines):
        # few lines are rules, and a rule has a dash
        rule = cells(lines[i + 1]) if "|" in lines[i] and "-" in lines[i + 1] else []
        head = cells(lines[i]) if rule and all(RULE.fullmatch(c) for c in rule) else []
        if head and len(head) == len(rule):
            grid, i = [head], i + 2
            while i < len(lines) and "|" in lines[i] and len(row := cells(lines[i])) == len(head):
                grid.append(row)
                i += 1
            out.append(grid)
        else:
            i += 1
    return out


def markdown_tables(text: Column | str) -> Column:
    return in_parts(tables_of, pa.list_(pa.list_(pa.list_(pa.string()))), "array<array<array<string>>>")(text)


def header_names(names: list[str]) -> list[str]:
    """Column names without blanks and repeats: ``Column i`` and ``name (2)``."""
    seen: dict[str, int] = {}
    out = []
    for i, name in enumerate(names, 1):
        name = name.strip() or f"Column {i}"
        seen[name] = seen.get(name, 0) + 1
        out.append(name if seen[name] == 1 else f"{name} ({seen[name]})")
    return out


def units(nodes: DataFrame, rows: DataFrame, row_columns: list[str]) -> DataFrame:
    """Search units: a card and content chunks per node (id, title, body), and a unit per table row (id, row_number, columns)."""
    card = nodes.select(F.concat("id", F.lit(":card:1")).alias("unit_id"), F.col("id").alias("node_id"), F.lit("card").alias("unit_type"), F.lit(1).alias("ordinal"), F.col("title").alias("text"))
    chunks = nodes.select("id", F.posexplode(markdown_chunks("body")).alias("pos", "c"))
    content = chunks.select(F.concat("id", F.lit(":content_text:"), F.col("pos") + 1).alias("unit_id"), F.col("id").alias("node_id"), F.lit("content_text").alias("unit_type"), (F.col("pos") + 1).alias("ordinal"), F.col("c.text").alias("text"), F.col("c.start_line").alias("start_line"), F.col("c.end_line").alias("end_line"))
    table_rows = rows.select(F.concat("id", F.lit(":table_row:"), F.col("row_number")).alias("unit_id"), F.col("id").alias("node_id"), F.lit("table_row").alias("unit_type"), F.col("row_number").cast("int").alias("ordinal"), T.row_text(row_columns).alias("text"))
    return card.unionByName(content, allowMissingColumns=True).unionByName(table_rows, allowMissingColumns=True)


def _parts(s, d):
    """Parts, dealt to many tasks: their table is one small file, which one task reads, but Python turns over every row."""
    return dealt(table(s, d, "part").select("p_partkey", "p_name", "p_brand"), rows=PYTHON_ROWS)


def _markdown(s, d):
    """Conversations as Markdown, a heading per turn."""
    turn = F.concat(F.lit("# "), "role", F.lit("\n\n"), "text", F.lit("\n"))
    c = table(s, d, "conversations").select("conv_id", F.struct("turn", turn.alias("t")).alias("x"))
    return c.groupBy("conv_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list("x")), lambda x: x["t"]), "\n").alias("text"))


QUERIES = {
    "chunk_blocks": (
        lambda s, d: table(s, d, "documents").select("doc_id", F.posexplode(T.blocks(F.replace("text", F.lit("\n"), F.lit("\n\n")))).alias("pos", "block")).select("doc_id", (F.col("pos") + 1).alias("pos"), F.length("block").alias("n")),
        "SELECT doc_id, unnest(range(1, len(bs) + 1)) AS pos, unnest(list_transform(bs, lambda b: length(b))) AS n FROM (SELECT doc_id, list_filter(regexp_split_to_array(replace(text, chr(10), chr(10) || chr(10)), '\\n\\s*\\n'), lambda b: trim(b) <> '') AS bs FROM documents)",
    ),
    "chunk_markdown": (lambda s, d: table(s, d, "documents").select("doc_id", F.explode(markdown_chunks(F.replace("text", F.lit("\n"), F.lit("\n\n")))).alias("c")).select("doc_id", "c.*"), None),
    "chunk_section": (lambda s, d: table(s, d, "documents").select("doc_id", F.posexplode(section_chunks("text")).alias("pos", "chunk")), None),
    "chunk_overlap": (
        lambda s, d: _parts(s, d).select("p_partkey", F.explode(markdown_chunks(F.array_join(F.array_repeat("p_name", 10), "\n\n"), 6, 2)).alias("c")).select("p_partkey", "c.*"),
        "SELECT p_partkey, p_name || repeat(chr(10) || chr(10) || p_name, CAST(least(a + 2, 10) - a AS INTEGER)) AS text, 2 * a - 1 AS start_line, 2 * least(a + 2, 10) - 1 AS end_line FROM part, unnest([1, 3, 5, 7, 9]) AS u(a)",
    ),
    "chunk_bounded": (
        lambda s, d: _parts(s, d).select("p_partkey", F.posexplode(section_chunks(F.concat(F.array_join(F.array_repeat("p_name", 10), "\n\n"), F.lit("\n\na b c d. e f g. h")), 6)).alias("pos", "text")),
        """SELECT p_partkey, i - 1 AS pos, CASE WHEN i < 4 THEN p_name || repeat(chr(10) || chr(10) || p_name, 2) WHEN i = 4 THEN p_name || chr(10) || chr(10) || 'a b c d.' ELSE 'e f g. h' END AS text FROM part, unnest([1, 2, 3, 4, 5]) AS u(i)""",
    ),
    "markdown_sections": (
        lambda s, d: _markdown(s, d).select("conv_id", F.posexplode(markdown_sections("text")).alias("pos", "s")).select("conv_id", "pos", F.array_join("s.path", "/").alias("path"), F.md5("s.text").alias("text"), has_body(F.col("s.text")).alias("body")),
        """SELECT conv_id, row_number() OVER w - 1 AS pos, role AS path, md5('# ' || role || chr(10) || chr(10) || text || chr(10) || CASE WHEN lead(turn) OVER w IS NULL THEN '' ELSE chr(10) END) AS text, trim(text) <> '' AS body FROM conversations WINDOW w AS (PARTITION BY conv_id ORDER BY turn, '# ' || role || chr(10) || chr(10) || text || chr(10))""",
    ),
    "markdown_tables": (
        lambda s, d: _parts(s, d).select("p_partkey", F.explode(markdown_tables(F.concat(F.lit("before\n\n| name | a\\|b |\n|---|:-:|\n| "), "p_name", F.lit(" | "), "p_brand", F.lit(" |\n| odd |\n| x | y |\n|--|--|\n\nafter")))).alias("t")).select("p_partkey", F.array_join(F.transform("t", lambda r: F.array_join(r, ";")), "/").alias("cells")),
        "SELECT p_partkey, 'name;a|b/' || p_name || ';' || p_brand AS cells FROM part UNION ALL SELECT p_partkey, 'x;y' FROM part",
    ),
    "search_units": (
        lambda s, d: units(_parts(s, d).select(F.col("p_partkey").cast("string").alias("id"), F.col("p_brand").alias("title"), F.col("p_name").alias("body")), table(s, d, "supplier").select(F.concat(F.lit("s"), F.col("s_nationkey").cast("string")).alias("id"), F.col("s_suppkey").alias("row_number"), "s_name"), ["s_name"]).select("unit_id", "node_id", "unit_type", "ordinal", "text", "start_line"),
        """SELECT p_partkey || ':card:1' AS unit_id, CAST(p_partkey AS VARCHAR) AS node_id, 'card' AS unit_type, 1 AS ordinal, p_brand AS text, NULL AS start_line FROM part
        UNION ALL SELECT p_partkey || ':content_text:1', CAST(p_partkey AS VARCHAR), 'content_text', 1, p_name, 1 FROM part UNION ALL SELECT 's' || s_nationkey || ':table_row:' || s_suppkey, 's' || s_nationkey, 'table_row', s_suppkey, 's_name: ' || s_name, NULL FROM supplier""",
    ),
    "row_units": (
        lambda s, d: table(s, d, "part").select("p_partkey", T.row_text(["p_name", "p_brand", "p_size"]).alias("text")),
        "SELECT p_partkey, 'p_name: ' || p_name || ' | p_brand: ' || p_brand || ' | p_size: ' || p_size AS text FROM part",
    ),
    "text_functions": (
        lambda s, d: table(s, d, "documents").select("doc_id", T.excerpt(F.col("text")).alias("excerpt"), F.md5(T.escape_html(F.col("text"))).alias("html"), F.md5(T.pipe_cell(F.col("text"))).alias("cell")),
        r"""SELECT doc_id, rtrim(substring(trim(regexp_replace(text, '\s+', ' ', 'g')), 1, 180)) AS excerpt,
        md5(replace(replace(replace(replace(replace(text, '&', '&amp;'), '<', '&lt;'), '>', '&gt;'), '"', '&quot;'), '''', '&#x27;')) AS html, md5(replace(replace(text, '\', '\\'), '|', '\|')) AS cell FROM documents""",
    ),
}
QUERIES["token_counts"] = (
    lambda s, d: table(s, d, "documents").select("doc_id", T.token_count(F.col("text")).cast("long").alias("n")),
    r"SELECT doc_id, CAST(len(regexp_extract_all(text, '\S+')) AS BIGINT) AS n FROM documents",
)
QUERIES |= {
    "text_slugs": (
        lambda s, d: table(s, d, "documents").select("doc_id", T.slug(T.excerpt(F.col("text"))).alias("slug")),
        r"""SELECT doc_id, coalesce(nullif(rtrim(substring(trim(regexp_replace(lower(regexp_replace(strip_accents(replace(rtrim(substring(trim(regexp_replace(text, '\s+', ' ', 'g')), 1, 180)), 'ß', 'ss')), '[^\x00-\x7F]', '', 'g')), '[^a-z0-9]+', '-', 'g'), '-'), 1, 60), '-'), ''), 'node') AS slug FROM documents""",
    ),
    "text_plain": (
        lambda s, d: table(s, d, "documents").select("doc_id", F.md5(T.plain(F.concat(F.lit("<b>*X*</b> &amp; &lt;"), "text"))).alias("plain")),
        r"""SELECT doc_id, md5(lower(trim(regexp_replace(replace(replace(replace(replace(replace(replace(regexp_replace('<b>*X*</b> &amp; &lt;' || text, '<[^>]*>|[*_`]', ' ', 'g'), '&lt;', '<'), '&gt;', '>'), '&quot;', '"'), '&#x27;', chr(39)), '&nbsp;', ' '), '&amp;', '&'), '\s+', ' ', 'g')))) AS plain FROM documents""",
    ),
    "sentence_counts": (
        lambda s, d: table(s, d, "documents").select("doc_id", F.size(T.sentences(F.col("text"))).alias("sentences"), F.size(T.clauses(F.col("text"))).alias("clauses")),
        r"""SELECT doc_id, CASE WHEN text = '' THEN 0 ELSE len(regexp_extract_all(text, '[.!?]\s+')) + 1 - CASE WHEN regexp_matches(text, '[.!?]\s+$') THEN 1 ELSE 0 END END AS sentences,
        CASE WHEN text = '' THEN 0 ELSE len(regexp_extract_all(text, '[,;:]\s+')) + 1 - CASE WHEN regexp_matches(text, '[,;:]\s+$') THEN 1 ELSE 0 END END AS clauses FROM documents""",
    ),
    "pipe_cells": (
        lambda s, d: table(s, d, "part").select("p_partkey", F.array_join(T.split_pipe_row(F.concat(F.lit("|  "), "p_name", F.lit(" | a\\|b |"), "p_brand", F.lit(" |"))), "~").alias("cells")),
        "SELECT p_partkey, p_name || '~a|b~' || p_brand AS cells FROM part",
    ),
    "headings": (
        lambda s, d: table(s, d, "part").select("p_partkey", F.concat(F.repeat(F.lit("#"), (F.col("p_partkey") % 9).cast("int")), F.when(F.col("p_partkey") % 4 > 0, " ").otherwise(""), "p_name", F.lit("  ")).alias("line")).select("p_partkey", T.heading(F.col("line"))[0].alias("level"), T.heading(F.col("line"))[1].alias("title")),
        "SELECT p_partkey, CASE WHEN ok THEN p_partkey % 9 ELSE 0 END AS level, CASE WHEN ok THEN p_name ELSE '' END AS title FROM (SELECT *, p_partkey % 4 > 0 AND p_partkey % 9 BETWEEN 1 AND 6 AS ok FROM part)",
    ),
    "compatible_keys": (
        lambda s, d: table(s, d, "part").select("p_partkey", T.compatible(F.concat("p_name", F.lit(" co-\nop ﬁ"), "p_brand")).alias("key")),
        "SELECT p_partkey, replace(p_name, ' ', '') || 'coopfi' || p_brand AS key FROM part",
    ),
    "human_titles": (
        lambda s, d: table(s, d, "part").select("p_partkey", T.humanise(F.concat(F.lpad(F.col("p_partkey").cast("string"), 5, "0"), F.lit("--"), F.replace("p_name", F.lit(" "), F.lit("_")))).alias("title")),
        "SELECT p_partkey, array_to_string(list_transform(string_split(p_name, ' '), lambda w: upper(w[1:1]) || lower(w[2:])), ' ') AS title FROM part",
    ),
    "byte_sizes": (
        lambda s, d: table(s, d, "orders").select("o_orderkey", T.byte_size(F.col("o_orderkey") * F.col("o_orderkey") * (F.col("o_custkey") % 50)).alias("size")),
        """SELECT o_orderkey, CASE WHEN n < 1024 THEN n || ' B' WHEN n < 1048576 THEN format('{:.1f} KB', floor(n / 1024 * 10 + 0.5) / 10) WHEN n < 1073741824 THEN format('{:.1f} MB', floor(n / 1048576 * 10 + 0.5) / 10) ELSE format('{:.1f} GB', floor(n / 1073741824 * 10 + 0.5) / 10) END AS size
        FROM (SELECT o_orderkey, o_orderkey * o_orderkey * (o_custkey % 50) AS n FROM orders)""",
    ),
}
