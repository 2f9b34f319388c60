"""Harmonic packing of token ids into sequences of a fixed capacity.

Method. Lengths fall into reciprocal classes: class k holds lengths in (capacity/(k+1), capacity/k], and a bin of class k
takes exactly k pieces. Documents may be cut, so each is cut to lengths that fill their class without waste: with a capacity
that is a power of two these are capacity/k for k = 1, 2, 4, ..., and a document's length has one such decomposition into
whole sequences and, for the rest, at most log2(capacity) pieces, longest first. Bins of k pieces are then full to the last
token. Each worker fills its own bins and needs no word from any other. What is left at its end, fewer than k pieces a class,
goes longest first into further bins; pieces that are powers of two fill those completely too, and the last, partial one is
closed at the powers of two of its length, which need no padding either.

Scale. One narrow pass: no shuffle, and a worker holds less than one sequence per class. Sequence ids are the partition's
number and a counter, so a task that is run again gives the same ids.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import common as C
from . import tokens as T

CAPACITY = 2048
ROWS = 20_000
#: Words whose ids a worker keeps, about 170 bytes each, and as many from before.
MAX_WORDS = 700_000


def cuts(length: int, capacity: int) -> Iterator[tuple[int, int]]:
    """(start, length) of a document's pieces: whole sequences, then falling powers of two."""
    start = 0
    while length - start >= capacity:
        yield start, capacity
        start += capacity
    rest = length - start
    while rest:
        size = 1 << (rest.bit_length() - 1)
        yield start, size
        start, rest = start + size, rest - size


class Bins:
    """One worker's open bins. ``put`` and ``close`` yield (piece, sequence, offset) as bins are completed."""

    def __init__(self, capacity: int, first: int):
        self.capacity, self.sequence = capacity, first
        self.open: dict[int, list] = {}

    def put(self, size: int, piece) -> list:
        held = self.open.setdefault(size, [])
        held.append(piece)
        if len(held) * size < self.capacity:
            return []
        self.open[size] = []
        return self._done([(size, p) for p in held])

    def _done(self, pieces: list) -> list:
        out, at = [], 0
        for size, piece in pieces:
            out.append((piece, self.sequence, at))
            at += size
        self.sequence += 1
        return out

    def close(self) -> list:
        left = [(size, p) for size in sorted(self.open, reverse=True) for p in self.open[size]]
        out, total = [], sum(size for size, _ in left)
        while left:
            room = min(self.capacity, 1 << (total.bit_length() - 1))
            n = at = 0
            while at < room:
                at, n = at + left[n][0], n + 1
            out += self._done(left[:n])
            left, total = left[n:], total - room
        self.open = {}
        return out


def pack(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", capacity: int = CAPACITY, end_id: int = 1, path: str | None = None) -> DataFrame:
    """One row per piece: the id, start, length, doc_tokens, sequence_id, offset and ids (little-endian 32-bit, binary).

    Documents are the library's ids without added special tokens, then end_id; null text counts as empty, so every row has at
    least one id. Rows that repeat an id are documents of their own, whose pieces overlap in start. Empty input gives an empty
    result; other columns are ignored. The capacity must be a power of two.
    """
    if capacity < 1 or capacity & (capacity - 1):
        raise ValueError("the capacity must be a power of two")
    path, last = path or T.tokenizer_path(), int(end_id).to_bytes(4, "little")
    kind = docs.schema[id_col].dataType.simpleString()

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words = T.words_for(path, MAX_WORDS)
        bins = Bins(capacity, TaskContext.get().partitionId() << 32)
        id_type, rows = None, []

        def batch(rows: list) -> pa.RecordBatch:
            cols = list(zip(*[(i, s, n, t, q, o, ids) for (i, s, n, t, ids), q, o in rows], strict=True)) or [[]] * 7
            kinds = [id_type, *[pa.int64()] * 5, pa.binary()]
            return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, kinds, strict=True)], ["id", "start", "length", "doc_tokens", "sequence_id", "offset", "ids"])

        for b in batches:
            id_type = b.column(0).type
            for i, text in zip(b.column(0).to_pylist(), b.column(1), strict=True):
                ids = words.ids(text.as_py()) + last
                n = len(ids) // 4
                for start, size in cuts(n, capacity):
                    rows += bins.put(size, (i, start, size, n, ids[4 * start : 4 * (start + size)]))
                    if len(rows) >= ROWS:
                        yield batch(rows)
                        rows = []
        rows += bins.close()
        if rows:
            yield batch(rows)

    packed = docs.select(F.col(id_col).alias("id"), C.text_of(text_col).alias("text")).mapInArrow(work, f"id {kind}, start bigint, length bigint, doc_tokens bigint, sequence_id bigint, offset bigint, ids binary")
    return packed.withColumnRenamed("id", id_col)


def digest(packed: DataFrame) -> DataFrame:
    return packed.withColumn("ids_crc32", F.crc32("ids")).drop("ids")


def op7_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return digest(pack(C.documents(spark, sf_dir))).select("doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset")


def unpack(packed: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """The ids of each document again, from its pieces in order; ids of documents must be unique."""
    pieces = F.array_sort(F.collect_list(F.struct("start", "ids")))
    return packed.groupBy(id_col).agg(F.reduce(pieces, F.lit(b""), lambda a, x: F.concat(a, x["ids"])).alias("ids"))


def as_ids(data: bytes) -> list[int]:
    return np.frombuffer(data, np.uint32).tolist()
