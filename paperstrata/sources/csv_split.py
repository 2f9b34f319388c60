"""Strict CSV read by many tasks per file, although quoted fields may hold line breaks.

Spark's text source splits files into blocks at line breaks, without knowing which ones are quoted. Whether a block begins inside a
quoted field depends on the parity of the quotes before it. So a first pass counts, per block, its quotes and the records
that end in it for either beginning; running sums over the blocks of a file turn these into each block's true beginning
and its first record's number. The second pass knows both, joins physical lines to records and parses them. Records that cross
blocks come as pieces and are put together by their number.

Quotes are doubled inside quoted fields, so a record has an even number of them.
"""

from __future__ import annotations

import csv
from collections.abc import Iterator

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import Window as W

#: Physical lines in which a header has to end.
HEADER_LINES = 1000


def parse(record: str) -> list[str]:
    """The fields of one record without its line break; [] for an empty line."""
    csv.field_size_limit(2**31 - 1)
    rows = list(csv.reader([record], strict=True))
    if len(rows) > 1:
        raise ValueError("a quote is out of place")
    return rows[0] if rows else []


def _lines(spark: SparkSession, path: str) -> DataFrame:
    """file, block, value: physical lines, in order within a block."""
    return spark.read.option("lineSep", "\n").text(path).select(F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("block"), "value")


def _count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """file, block, quotes, and the records that end in the block if it begins outside (ends0) or inside (ends1) a field."""
    seen: dict[tuple[str, int], list[int]] = {}
    for batch in batches:
        quotes = pc.count_substring(batch.column("value"), '"').to_pylist()
        for file, block, n in zip(batch.column("file").to_pylist(), batch.column("block").to_pylist(), quotes, strict=True):
            own = seen.setdefault((file, block), [0, 0, 0])
            own[0] += n
            own[1 + own[0] % 2] += 1
    rows = [(f, b, *own) for (f, b), own in seen.items()]
    kinds = (pa.string(), pa.int64(), pa.int64(), pa.int64(), pa.int64())
    yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], kind) for i, kind in enumerate(kinds)], ["file", "block", "quotes", "ends0", "ends1"])


_RECORDS = "file string, record long, block long, fields array<string>, piece string, width int"


def _records(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Whole records with their fields, and as ``piece`` what a block has of a record that crosses its borders."""
    at, inside, record, first, held = None, False, 0, False, []

    def close(out: list, ended: bool) -> None:
        text = "\n".join(held)
        if first or not ended:  # begun in an earlier block, or going on in a later one
            out.append((at[0], record, at[1], None, text))
        else:
            out.append((at[0], record, at[1], parse(text.removesuffix("\r")), None))

    for batch in batches:
        out: list = []
        columns = (batch.column(c).to_pylist() for c in ("file", "block", "value", "begins_inside", "first_record"))
        for file, block, value, begins, number in zip(*columns, strict=True):
            if (file, block) != at:
                if held:
                    close(out, False)
                at, inside, record, first, held = (file, block), begins, number, begins, []
            held.append(value)
            inside ^= value.count('"') % 2 == 1
            if not inside:
                close(out, True)
                record, first, held = record + 1, False, []
        yield _batch(out)
    if held:
        out = []
        close(out, False)
        yield _batch(out)


def _batch(rows: list) -> pa.RecordBatch:
    kinds = (pa.string(), pa.int64(), pa.int64(), pa.list_(pa.string()), pa.string())
    arrays = [pa.array([r[i] for r in rows], kind) for i, kind in enumerate(kinds)]
    return pa.RecordBatch.from_arrays([*arrays, pa.array([None if r[3] is None else len(r[3]) for r in rows], pa.int32())], ["file", "record", "block", "fields", "piece", "width"])


def _join(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        yield _batch([(f, r, 0, parse(t.removesuffix("\r")), None) for f, r, t in zip(*(batch.column(c).to_pylist() for c in ("file", "record", "text")), strict=True)])


def header(spark: SparkSession, path: str) -> list[str]:
    """The names in the first record of the first file."""
    text, quotes = [], 0
    for row in spark.read.option("lineSep", "\n").text(path).limit(HEADER_LINES).toLocalIterator():
        text.append(row.value)
        quotes += row.value.count('"')
        if quotes % 2 == 0:
            break
    names = parse("\n".join(text).removeprefix("﻿").removesuffix("\r")) if text and quotes % 2 == 0 else []
    if not names or not all(n.strip() for n in names) or len(set(names)) < len(names):
        raise ValueError("the header must be non-empty and unique")
    return names


def read_csv(spark: SparkSession, path: str, row_number: str | None = None, file_name: str | None = None) -> DataFrame:
    """The rows of the files at ``path`` as strings. Every file begins with the same header, whose names are neither blank nor
    repeated; a row of another width, an open quote at the end, or another file's header fails the read. Empty lines
    are passed over. row_number: name of a column with each row's number in its file, from 1, empty lines counted. file_name: name
    of a column with its file."""
    names = header(spark, path)
    lines = _lines(spark, path)
    blocks = lines.mapInArrow(_count, "file string, block long, quotes long, ends0 long, ends1 long")
    # a block is a row here: some 8000 of them for a terabyte
    before = W.partitionBy("file").orderBy("block").rowsBetween(W.unboundedPreceding, -1)
    blocks = blocks.withColumn("begins_inside", F.coalesce(F.sum("quotes").over(before), F.lit(0)) % 2 == 1)
    blocks = blocks.withColumn("first_record", F.coalesce(F.sum(F.when(F.col("begins_inside"), F.col("ends1")).otherwise(F.col("ends0"))).over(before), F.lit(0)))
    known = lines.join(F.broadcast(blocks.select("file", "block", "begins_inside", "first_record")), ["file", "block"])  # keeps the lines' order
    found = known.mapInArrow(_records, _RECORDS)
    pieces = found.filter("piece IS NOT NULL").groupBy("file", "record").agg(F.array_sort(F.collect_list(F.struct("block", "piece"))).alias("pieces"))
    joined = pieces.select("file", "record", F.array_join(F.col("pieces.piece"), "\n").alias("text")).mapInArrow(_join, _RECORDS)
    rows = found.filter("piece IS NULL").unionByName(joined)
    marked = F.when(F.col("record") == 0, F.regexp_replace(F.to_json("fields"), "^\\[\"﻿", "[\"")).otherwise("")
    head = F.to_json(F.array(*map(F.lit, names)))
    same = F.when((F.col("record") == 0) & (marked != head), F.raise_error(F.concat(F.lit("another header in "), F.col("file"))))
    wide = F.when((F.col("width") > 0) & (F.col("width") != len(names)), F.raise_error(F.concat(F.lit("a row of another width in "), F.col("file"))))
    # the checks are part of the filter, so no plan can leave them out
    rows = rows.filter(same.isNull() & wide.isNull() & (F.col("record") > 0) & (F.col("width") > 0))
    out = [F.get("fields", F.lit(i)).alias(n) for i, n in enumerate(names)]
    return rows.select(*([F.col("file").alias(file_name)] if file_name else []), *([F.col("record").alias(row_number)] if row_number else []), *out)
