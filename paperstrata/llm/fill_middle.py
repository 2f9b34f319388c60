"""Fill-in-middle: texts cut at seeded line borders and reordered, with line borders from a distinct-text index.

Method. Texts are hashed (128 bits) and hashes that occur twice or more are counted. Only their texts are moved: grouped by hash
*and* text, so that contents are compared, and each distinct one gets its line borders computed once, as an Elias-Fano list
(low bits packed, high bits as gaps in unary: about 2 + log2(chars / lines) bits a line). The index, which holds no texts, is
joined back to documents by hash. A hash with two different texts stays out of the index; its documents, and those whose text
occurs once, get their list from their own text where they stand. Each document then selects its two seeded borders from the list.

Skew. Copies collapse in the partial aggregation of the grouping, so a group of any size brings one row per task. For the join
back, hashes with at least 1/4096 of the rows are broadcast (so at most 4096) and the others are shuffled, unless all fit a
broadcast of at most BROADCAST rows.

Defined results. Null text counts as empty; empty texts, and texts that hold a mark, stay plain. A null id counts as the empty
string where the seed is hashed. Rows that repeat are cut each, in the same way if they share the id. Empty tables give empty
results, columns of any name beside id and text are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from . import common as C

PREFIX, SUFFIX, MIDDLE = "<P>", "<S>", "<M>"
BROADCAST = 200_000
_FIELDS = ("n", "width", "low", "high")
INDEX_SCHEMA = "n long, width int, low binary, high binary"


def line_ends(text: str) -> np.ndarray:
    """Where each line ends, in code points, its line break included."""
    chars = np.frombuffer(text.encode("utf-32-le"), np.uint32)
    ends = np.flatnonzero(chars == 10) + 1
    return ends if not len(chars) or (len(ends) and ends[-1] == len(chars)) else np.append(ends, len(chars))


def elias_fano(values: np.ndarray) -> tuple[int, int, bytes, bytes]:
    """An ascending list as n, width of the low bits, low bits and high bits."""
    n = len(values)
    if not n:
        return 0, 0, b"", b""
    width = max(0, (int(values[-1]) // n).bit_length() - 1)
    low = ((values[:, None] >> np.arange(width)) & 1).astype(np.uint8)
    high = np.zeros((int(values[-1]) >> width) + n, np.uint8)
    high[(values >> width) + np.arange(n)] = 1
    return n, width, np.packbits(low).tobytes(), np.packbits(high).tobytes()


_ONES = np.array([bin(i).count("1") for i in range(256)], np.int64)


def select(i: int, width: int, low: bytes, high: bytes) -> int:
    """Value ``i`` of a list: the place of the i-th one among the high bits tells the high part."""
    data = np.frombuffer(high, np.uint8)
    ones = np.cumsum(_ONES[data])
    at = int(np.searchsorted(ones, i + 1))
    inside = np.flatnonzero(np.unpackbits(data[at : at + 1]))[i - (int(ones[at - 1]) if at else 0)]
    first = i * width
    bits = np.unpackbits(np.frombuffer(low, np.uint8, offset=first // 8, count=(first % 8 + width + 7) // 8))[first % 8 : first % 8 + width] if width else ()
    return ((8 * at + int(inside) - i) << width) + sum(int(b) << k for k, b in enumerate(bits))


def _index_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        rows = [elias_fano(line_ends(text)) for text in batch.column("text").to_pylist()]
        made = [pa.array([r[k] for r in rows], kind) for k, kind in enumerate((pa.int64(), pa.int32(), pa.binary(), pa.binary()))]
        yield pa.RecordBatch.from_arrays([batch.column("h"), batch.column("copies"), *made], ["h", "copies", *_FIELDS])


def text_index(keyed: DataFrame) -> DataFrame:
    """h, copies and the line borders of each text that occurs twice or more. ``keyed``: h, text."""
    counts = C.stage(keyed.groupBy("h").agg(F.count(F.lit(1)).alias("copies")).filter("copies > 1"))
    texts = _matching(keyed, counts).groupBy("h", "text").agg(F.first("copies").alias("copies"), F.count(F.lit(1)).alias("here"))
    return C.stage(texts.filter("copies = here").select("h", "copies", "text").mapInArrow(_index_batches, f"h binary, copies long, {INDEX_SCHEMA}"))


def _matching(rows: DataFrame, table: DataFrame) -> DataFrame:
    """The rows whose hash is in ``table``, with its columns."""
    return rows.join(F.broadcast(table), "h") if C.small(table, BROADCAST) else C.join_by_weight(rows, table, ["h"], "copies")


def cut(text: str, ends: tuple[int, int, bytes, bytes], id: object, seed: int, percent: int, spm_percent: int) -> tuple[str, str, int | None, int | None]:
    """Form, output, and the lengths of prefix and middle."""
    digest = hashlib.sha256(f"{seed}:{'' if id is None else id}".encode()).hexdigest()
    h1, h2, h3, h4 = (int(digest[8 * k : 8 * k + 8], 16) for k in range(4))
    if not text or any(mark in text for mark in (PREFIX, SUFFIX, MIDDLE)) or h3 % 100 >= percent:
        return "plain", text, None, None
    n, *rest = ends
    first, last = sorted((h1 % (n + 1), h2 % (n + 1)))
    a, b = (select(k - 1, *rest) if k else 0 for k in (first, last))
    prefix, middle, suffix = text[:a], text[a:b], text[b:]
    if h4 % 100 < spm_percent:
        return "spm", f"{SUFFIX}{suffix}{PREFIX}{prefix}{MIDDLE}{middle}", a, b - a
    return "psm", f"{PREFIX}{prefix}{SUFFIX}{suffix}{MIDDLE}{middle}", a, b - a


def _cutter(seed: int, percent: int, spm_percent: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    def batches(source: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in source:
            out = []
            for id, text, *ends in zip(*(batch.column(c).to_pylist() for c in ("id", "text", *_FIELDS)), strict=True):
                ends = elias_fano(line_ends(text)) if ends[0] is None else tuple(ends)
                out.append((ends[0], *cut(text, ends, id, seed, percent, spm_percent)))
            kinds = (pa.int64(), pa.string(), pa.string(), pa.int64(), pa.int64())
            yield pa.RecordBatch.from_arrays([batch.column("id"), *(pa.array([r[k] for r in out], kind) for k, kind in enumerate(kinds))], ["id", "n", "form", "output", "prefix_chars", "middle_chars"])

    return batches


def content_hash(text: Column) -> Column:
    return F.unhex(F.md5(text))


def fill_in_middle(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", seed: int = 7, percent: int = 100, spm_percent: int = 50, hasher: Callable[[Column], Column] = content_hash
) -> DataFrame:
    """One row per input row: the id, n (lines), form (plain, psm, spm), output, prefix_chars, middle_chars.

    percent: share of documents that are reordered; spm_percent: how many of those with the suffix first. hasher: replaceable to
    test collisions.
    """
    rows = docs.select(F.col(id_col).alias("id"), C.text_of(text_col).alias("text"))
    keyed = rows.withColumn("h", hasher(F.col("text")))
    index = text_index(keyed.select("h", "text"))
    fields = ["id", "text", *_FIELDS]
    known = _matching(keyed, index).select(*fields)
    alone = keyed.join(C.maybe_broadcast(index.select("h"), BROADCAST), "h", "left_anti").select("id", "text", *(F.lit(None).cast(t.split()[1]).alias(t.split()[0]) for t in INDEX_SCHEMA.split(", ")))
    kind = dict(rows.dtypes)["id"]
    made = known.unionByName(alone).mapInArrow(_cutter(seed, percent, spm_percent), f"id {kind}, n long, form string, output string, prefix_chars long, middle_chars long")
    return made.withColumnRenamed("id", id_col)


def restored(output: Column, form: Column) -> Column:
    """The text that an output was made of."""
    parts = F.split(output, f"{PREFIX}|{SUFFIX}|{MIDDLE}", -1)
    part = lambda k: F.get(parts, F.lit(k))
    return F.when(form == "psm", F.concat(part(1), part(3), part(2))).when(form == "spm", F.concat(part(2), part(3), part(1))).otherwise(output)


def op13_fill_in_middle(spark: SparkSession, sf_dir: str) -> DataFrame:
    made = fill_in_middle(C.documents(spark, sf_dir))
    return made.select(
        "doc_id", "n", "form", "prefix_chars", "middle_chars", F.sha2("output", 256).alias("output_sha256"), F.sha2(restored(F.col("output"), F.col("form")), 256).alias("restored_sha256")
    )


ORACLE = f"""
WITH d AS (SELECT doc_id, coalesce(text, '') AS t, sha256('7:' || coalesce(doc_id::VARCHAR, '')) AS x FROM documents),
h AS (SELECT *, length(t) - length(replace(t, chr(10), '')) + CASE WHEN t = '' OR right(t, 1) = chr(10) THEN 0 ELSE 1 END AS n,
  ('0x' || substr(x, 1, 8))::BIGINT AS h1, ('0x' || substr(x, 9, 8))::BIGINT AS h2, ('0x' || substr(x, 25, 8))::BIGINT AS h4 FROM d),
k AS (SELECT *, t = '' OR contains(t, '{PREFIX}') OR contains(t, '{SUFFIX}') OR contains(t, '{MIDDLE}') AS plain,
  least(h1 % (n + 1), h2 % (n + 1)) AS a, greatest(h1 % (n + 1), h2 % (n + 1)) AS b, string_split(t, chr(10)) AS lines FROM h),
c AS (SELECT *, array_to_string(lines[:a], chr(10)) || CASE WHEN a > 0 AND a < len(lines) THEN chr(10) ELSE '' END AS p,
  array_to_string(lines[:b], chr(10)) || CASE WHEN b > 0 AND b < len(lines) THEN chr(10) ELSE '' END AS q FROM k),
s AS (SELECT *, substr(q, length(p) + 1) AS m, substr(t, length(q) + 1) AS z,
  CASE WHEN plain THEN 'plain' WHEN h4 % 100 < 50 THEN 'spm' ELSE 'psm' END AS form FROM c)
SELECT doc_id, n, form, CASE WHEN NOT plain THEN length(p) END AS prefix_chars, CASE WHEN NOT plain THEN length(m) END AS middle_chars,
  sha256(CASE form WHEN 'plain' THEN t WHEN 'spm' THEN '{SUFFIX}' || z || '{PREFIX}' || p || '{MIDDLE}' || m
    ELSE '{PREFIX}' || p || '{SUFFIX}' || z || '{MIDDLE}' || m END) AS output_sha256,
  sha256(CASE form WHEN 'plain' THEN t ELSE p || m || z END) AS restored_sha256
FROM s
"""
