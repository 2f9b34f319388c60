"""Column expressions over text. All but the Unicode forms stay in the JVM."""

from __future__ import annotations

import re
import unicodedata

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, StringType

WORD = "[\\p{L}\\p{N}]+"


def tokens(text: Column) -> Column:
    """Lower-cased runs of letters and digits."""
    return F.regexp_extract_all(F.lower(text), F.lit(WORD), F.lit(0))


def words(text: str) -> list[str]:
    """The driver-side twin of ``tokens``, for queries."""
    return re.findall(r"[^\W_]+", text.lower())


def token_count(text: Column) -> Column:
    """Number of runs of non-space characters."""
    return F.size(F.regexp_extract_all(text, F.lit("\\S+"), F.lit(0)))


def collapse_spaces(text: Column) -> Column:
    return F.trim(F.regexp_replace(text, "\\s+", " "))


def plain(text: Column) -> Column:
    """Without markup, case and repeated spaces: for comparing cells."""
    return F.lower(collapse_spaces(unescape_html(F.regexp_replace(text, "<[^>]*>|[*_`]", " "))))


def blocks(text: Column) -> Column:
    """Parts between blank lines, without empty ones."""
    return F.filter(F.split(text, "\\n\\s*\\n", -1), lambda b: F.trim(b) != "")


def sentences(text: Column) -> Column:
    return F.filter(F.split(text, "(?<=[.!?])\\s+", -1), lambda s: s != "")


def clauses(text: Column) -> Column:
    return F.filter(F.split(text, "(?<=[,;:])\\s+", -1), lambda s: s != "")


def heading(line: Column) -> tuple[Column, Column]:
    """Level (0: none) and title of a Markdown heading line."""
    pattern = "^(#{1,6})\\s+(.+?)\\s*$"
    return F.length(F.regexp_extract(line, pattern, 1)), F.regexp_extract(line, pattern, 2)


def excerpt(text: Column, limit: int = 180) -> Column:
    return F.rtrim(F.substring(collapse_spaces(text), 1, limit))


def preview(text: Column, limit: int = 120) -> Column:
    """At most ``limit`` characters, the last one an ellipsis where text was cut."""
    flat = collapse_spaces(text)
    return F.when(F.length(flat) > limit, F.concat(F.substring(flat, 1, limit - 1), F.lit("…"))).otherwise(flat)


def row_text(names: list[str]) -> Column:
    """``name: value`` of all columns, joined by `` | ``."""
    return F.concat_ws(" | ", *[F.concat(F.lit(f"{n}: "), F.coalesce(F.col(n).cast("string"), F.lit(""))) for n in names])


def row_fields(text: Column) -> Column:
    """The inverse: an array of name and value."""
    parts = F.split(text, " \\| ", -1)
    return F.transform(parts, lambda p: F.struct(F.split(p, ": ", 2)[0].alias("name"), F.try_element_at(F.split(p, ": ", 2), F.lit(2)).alias("value")))


def split_pipe_row(line: Column) -> Column:
    """Cells of a pipe table row. A backslash keeps the pipe after it."""
    inner = F.regexp_replace(F.regexp_replace(F.trim(line), "^\\|", ""), "(?<!\\\\)\\|$", "")
    return F.transform(F.split(inner, "(?<!\\\\)\\|", -1), lambda c: F.trim(F.replace(c, F.lit("\\|"), F.lit("|"))))


def escape_html(text: Column) -> Column:
    for raw, name in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;"), ("'", "&#x27;")):
        text = F.replace(text, F.lit(raw), F.lit(name))
    return text


def unescape_html(text: Column) -> Column:
    for name, raw in (("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&#x27;", "'"), ("&nbsp;", " "), ("&amp;", "&")):
        text = F.replace(text, F.lit(name), F.lit(raw))
    return text


def pipe_cell(text: Column) -> Column:
    return F.replace(F.replace(text, F.lit("\\"), F.lit("\\\\")), F.lit("|"), F.lit("\\|"))


def humanise(stem: Column) -> Column:
    """A title from a file stem: without its order prefix, separators as spaces, words capitalised."""
    return F.initcap(F.trim(F.regexp_replace(F.regexp_replace(stem, "^\\d{5}--", ""), "[_-]+", " ")))


def byte_size(n: Column) -> Column:
    """A size for people: B, KB, MB, GB with one decimal."""
    scaled = lambda unit, size: F.format_string(f"%.1f {unit}", n.cast("double") / size)
    return F.when(n < 1024, F.concat(n.cast("string"), F.lit(" B"))).when(n < 1024**2, scaled("KB", 1024)).when(n < 1024**3, scaled("MB", 1024**2)).otherwise(scaled("GB", 1024**3))


@F.pandas_udf(StringType())
def _ascii_slug(text: pd.Series) -> pd.Series:
    """Needs Unicode decomposition, hence pandas."""

    def one(value: str | None) -> str | None:
        flat = unicodedata.normalize("NFKD", (value or "").replace("ß", "ss")).encode("ascii", "ignore").decode().lower()
        return re.sub(r"[^a-z0-9]+", "-", flat).strip("-")[:60].rstrip("-") or None

    return text.map(one)


def slug(text: Column | str, fallback: str = "node") -> Column:
    """ASCII slug of at most 60 characters; the fallback where nothing is left."""
    return F.coalesce(_ascii_slug(text), F.lit(fallback))


@F.pandas_udf(StringType())
def compatible(text: pd.Series) -> pd.Series:
    """NFKC without hyphens, soft hyphens and spaces: equal for cells that differ in hyphenation only."""
    return text.map(lambda v: None if v is None else re.sub(r"[\s­‐-―-]+", "", unicodedata.normalize("NFKC", v)))


@F.pandas_udf(StringType())
def uuid5(namespace: pd.Series, name: pd.Series) -> pd.Series:
    import uuid

    return pd.Series([str(uuid.uuid5(uuid.UUID(n), v)) for n, v in zip(namespace, name, strict=True)])


def lcs_ratio(a: str, b: str) -> float:
    """Longest common subsequence over the longer length, by bit-parallel rows; 1 for two empty strings."""
    if not a or not b:
        return float(not a and not b)
    where: dict[str, int] = {}
    for i, ch in enumerate(a):
        where[ch] = where.get(ch, 0) | 1 << i
    row, full = (1 << len(a)) - 1, (1 << len(a)) - 1
    for ch in b:
        kept = row & where.get(ch, 0)
        row = (row + kept | row - kept) & full
    return (len(a) - row.bit_count()) / max(len(a), len(b))


@F.pandas_udf(DoubleType())
def lcs_similarity(a: pd.Series, b: pd.Series) -> pd.Series:
    return pd.Series([lcs_ratio(x or "", y or "") for x, y in zip(a, b, strict=True)], dtype="float64")
