"""Suffix-array dedup: removes bytes covered by a string of WIDTH bytes that also starts elsewhere in the corpus.

Bringing equal strings together. Each window of WIDTH bytes has an anchor, the leftmost smallest hash among its 32-byte grams.
Neighbouring windows mostly share theirs, so a text falls into runs of windows (segments, about 185 starts each) with one
anchor; equal windows have equal anchors. Text with a period, in which the anchor moves on at every byte but keeps its hash,
is one run of up to suffixes.RUN starts. Only anchors that occur twice, or move inside a run, can have repeated windows. Equal
segments (by a 64-bit hash beside the anchor's) collapse to one with a count. Segments of shared anchors are dealt to shards
by anchor.

Suffix array. Each shard concatenates its distinct segments and sorts their suffixes in two stages: suffixes smaller than
their successors directly, the others induced from them by a scan over the buckets. Adjacent common prefixes of WIDTH bytes or
more mark repeated windows; so does a count of two. Marked windows go back to the texts as intervals, and a text loses the
bytes that they cover. All strings are judged on the input.

Scale. Texts are read in place: only hashes and positions (about 40 bytes per 185 of text) are shuffled, pre-aggregated so that
copies of a text are one row per task; bytes are fetched for distinct segments of shared anchors alone, and not at all where
an anchor has one distinct segment. A shard holds about SHARD_BYTES; an anchor with more than HOT_BYTES of distinct segments
(a passage in very many different contexts) isn't put into a shard: its windows are compared by 128-bit hash in an ordinary
aggregation instead. Intervals return to texts through a join by content hash whose hot keys are broadcast.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from . import common as C
from . import suffixes

WIDTH = 400
SHARD_BYTES = 1 << 20
HOT_BYTES = 6 << 20
PIECE = 1 << 20
BROADCAST_ROWS = 1_000_000


def text_key(text: Column) -> list[Column]:
    """Two 64-bit hashes that stand for a text's bytes."""
    return [F.xxhash64(F.lit(1), text).alias("k1"), F.xxhash64(F.lit(2), text).alias("k2")]


def _segments(width: int):
    """(k1, k2, text bytes) to (k1, k2, anchor, seg, start, size, moves): the runs of windows; texts below ``width`` have none."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            k1, k2 = (b.column(i).to_numpy() for i in (0, 1))
            owner, anchors, segs, starts, sizes, moving = [], [], [], [], [], []
            for i, value in enumerate(b.column(2)):
                text = value.as_buffer()
                if text is None or len(text) < width:
                    continue
                data = np.frombuffer(text, np.uint8)
                for at in range(0, len(data) - width + 1, PIECE):  # long texts piece by piece; each window lies in one
                    part = data[at : at + PIECE + width - 1]
                    first, last, anchor, moves = suffixes.anchored(part, width)
                    view = memoryview(part)
                    owner.append(np.full(len(first), i))
                    anchors.append(anchor)
                    starts.append(first + at)
                    sizes.append(last - first + width)
                    moving.append(moves)
                    segs += [int.from_bytes(hashlib.blake2b(view[s:e], digest_size=8).digest(), "little") for s, e in zip(first.tolist(), (last + width).tolist(), strict=True)]
            if segs:
                who = np.concatenate(owner)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(k1[who]), pa.array(k2[who]), pa.array(np.concatenate(anchors).view(np.int64)), pa.array(np.array(segs, np.uint64).view(np.int64)), pa.array(np.concatenate(starts)), pa.array(np.concatenate(sizes).astype(np.int32)), pa.array(np.concatenate(moving))],
                    ["k1", "k2", "anchor", "seg", "start", "size", "moves"],
                )

    return work


def _cut_out(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(text bytes, list of (anchor, seg, start, size, copies)) to a row with the bytes of each."""
    for b in batches:
        rows = []
        for text, wanted in zip(b.column(0), b.column(1), strict=True):
            data = text.as_buffer().to_pybytes()
            for w in wanted.as_py():
                rows.append((w["anchor"], w["seg"], w["copies"], data[w["start"] : w["start"] + w["size"]]))
                if len(rows) >= 5000:
                    yield _rows(rows)
                    rows = []
        if rows:
            yield _rows(rows)


def _rows(rows: list) -> pa.RecordBatch:
    kinds = (pa.int64(), pa.int64(), pa.int64(), pa.binary())
    return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)], ["anchor", "seg", "copies", "bytes"])


def _ranges(hits: np.ndarray, width: int) -> list[dict]:
    """Byte ranges that the marked window starts cover."""
    edges = np.flatnonzero(np.diff(np.concatenate([[0], hits.astype(np.int8), [0]])))
    return [{"start": s, "end": e - 1 + width} for s, e in zip(edges[::2].tolist(), edges[1::2].tolist(), strict=True)]


RANGES = pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32())]))


def _sort_shard(width: int):
    def work(table: pa.Table) -> pa.Table:
        texts = table["bytes"].to_pylist()
        found = []
        for text, hits, copies in zip(texts, suffixes.repeated_windows(texts, width), table["copies"].to_pylist(), strict=True):
            found.append([{"start": 0, "end": len(text)}] if copies > 1 else _ranges(hits, width))
        return pa.table([table["anchor"], table["seg"], pa.array(found, RANGES)], ["anchor", "seg", "ranges"])

    return work


def _window_hashes(width: int):
    """(anchor, seg, copies, bytes) to a row per window: its 128-bit hash and offset. For hot anchors only."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for anchor, seg, copies, data in zip(*(b.column(i).to_pylist() for i in range(4)), strict=True):
                digests = [hashlib.blake2b(data[i : i + width], digest_size=16).digest() for i in range(len(data) - width + 1)]
                n = len(digests)
                yield pa.RecordBatch.from_arrays([pa.array([anchor] * n, pa.int64()), pa.array([seg] * n, pa.int64()), pa.array([copies] * n, pa.int64()), pa.array(digests, pa.binary()), pa.array(range(n), pa.int32())], ["anchor", "seg", "copies", "hash", "at"])

    return work


def _by_hash(hot: DataFrame, width: int) -> DataFrame:
    windows = hot.mapInArrow(_window_hashes(width), "anchor bigint, seg bigint, copies bigint, hash binary, at int")
    twice = C.stage(windows.groupBy("hash").agg(F.sum("copies").alias("n"), F.count(F.lit(1)).alias("rows")).filter("n > 1"))
    marked = C.join_by_weight(windows, twice.select("hash", "rows"), ["hash"], "rows").select("anchor", "seg", F.struct(F.col("at").alias("start"), (F.col("at") + width).cast("int").alias("end")).alias("r"))
    return marked.groupBy("anchor", "seg").agg(F.collect_list("r").alias("ranges"))


def repeats(docs: DataFrame, text_col: str = "text", width: int = WIDTH, shard_bytes: int = SHARD_BYTES, hot_bytes: int = HOT_BYTES) -> DataFrame:
    """k1, k2 (a text's key), spans (byte ranges covered by repeated windows, any order, may overlap), copies (rows with that
    text): one row per distinct text that has any; staged."""
    texts = docs.select(C.text_of(text_col).alias("text")).filter(F.octet_length("text") >= width).select(*text_key(F.col("text")), F.col("text").cast("binary").alias("bytes"))
    kind = "k1 bigint, k2 bigint, anchor bigint, seg bigint, start bigint, size int, moves boolean"
    runs = texts.mapInArrow(_segments(width), kind).groupBy("anchor", "seg", "k1", "k2", "start", "size", "moves").agg(F.count(F.lit(1)).alias("copies"))
    runs = C.stage(runs)
    shared = runs.groupBy("anchor").agg(F.sum("copies").alias("n"), F.count(F.lit(1)).alias("rows"), F.min("seg").alias("low"), F.max("seg").alias("high"), F.max("moves").alias("moves")).filter("n > 1 OR moves")
    shared = C.stage(shared.select("anchor", "rows", ((F.col("low") == F.col("high")) & (F.col("n") > 1)).alias("uniform")))
    runs = C.stage(C.join_by_weight(runs, shared, ["anchor"], "rows").drop("rows"))

    whole = F.array(F.struct(F.col("start").alias("start"), (F.col("start") + F.col("size")).alias("end")))
    spans = runs.filter("uniform").select("k1", "k2", "copies", whole.alias("spans"))
    mixed = runs.filter("NOT uniform")
    segs = mixed.groupBy("anchor", "seg").agg(F.sum("copies").alias("copies"), F.count(F.lit(1)).alias("rows"), F.min(F.struct("k1", "k2", "start", "size")).alias("at"))
    segs = C.stage(segs.select("anchor", "seg", "copies", "rows", "at.*"))
    if segs.limit(1).count():
        by_text = segs.groupBy("k1", "k2").agg(F.collect_list(F.struct("anchor", "seg", "start", "size", "copies")).alias("wanted"))  # one text's own segments
        if segs.count() <= BROADCAST_ROWS:
            by_text = F.broadcast(by_text)
        # copies of a text would all fetch its segments: the first to come is enough
        cut = texts.join(by_text, ["k1", "k2"]).select("bytes", "wanted").mapInArrow(_cut_out, "anchor bigint, seg bigint, copies bigint, bytes binary")
        cut = C.stage(cut.groupBy("anchor", "seg").agg(F.max("copies").alias("copies"), F.max("bytes").alias("bytes")))
        sizes = C.stage(segs.groupBy("anchor").agg(F.sum("size").alias("total"), F.count(F.lit(1)).alias("rows")))
        shards = int((sizes.agg(F.sum("total")).first()[0] or 0) // shard_bytes) + 1
        hot = C.stage(sizes.filter(F.col("total") > hot_bytes).select("anchor", "rows"))
        has_hot = hot.limit(1).count() > 0
        cold = cut.join(C.maybe_broadcast(hot.select("anchor"), BROADCAST_ROWS), "anchor", "left_anti") if has_hot else cut
        sorted_ = cold.withColumn("shard", F.pmod(F.xxhash64("anchor"), F.lit(shards))).groupBy("shard").applyInArrow(_sort_shard(width), "anchor bigint, seg bigint, ranges array<struct<start:int,end:int>>")
        if has_hot:
            sorted_ = sorted_.unionByName(_by_hash(C.join_by_weight(cut, hot, ["anchor"], "rows").drop("rows"), width))
        found = C.stage(sorted_.filter(F.size("ranges") > 0))
        found = C.stage(found.join(segs.select("anchor", "seg", "rows"), ["anchor", "seg"]))
        moved = C.join_by_weight(mixed, found, ["anchor", "seg"], "rows")
        placed = F.transform("ranges", lambda r: F.struct((F.col("start") + r["start"]).alias("start"), (F.col("start") + r["end"]).alias("end")))
        spans = spans.unionByName(moved.select("k1", "k2", "copies", placed.alias("spans")))
    return C.stage(spans.groupBy("k1", "k2").agg(F.flatten(F.collect_list("spans")).alias("spans"), F.max("copies").alias("copies")))


def substring_dedup(docs: DataFrame, text_col: str = "text", width: int = WIDTH, **settings) -> DataFrame:
    """``docs`` with n_bytes (before), n_removed, n_spans (maximal removed runs) and kept (the remaining bytes, binary) added or
    replaced.

    Texts are UTF-8 bytes; null counts as empty; strings never reach over the ends of a text. A text of fewer than ``width``
    bytes loses nothing; of texts that repeat, all lose everything, as each occurs elsewhere. What remains may not be valid
    UTF-8 where a run ends inside a character. Empty input gives an empty result.
    """
    k1, k2, key1, key2, spans, copies, out = C.fresh(docs, "k1", "k2", "key1", "key2", "spans", "copies", "cut")
    found = repeats(docs, text_col, width, **settings).toDF(key1, key2, spans, copies)
    a, b = text_key(C.text_of(text_col))
    own = docs.withColumns({k1: a, k2: b})

    @F.arrow_udf("struct<n_removed:bigint,n_spans:bigint,kept:binary>")
    def cut(texts: pa.Array, ranges: pa.Array) -> pa.Array:
        removed, runs, kept = [], [], []
        for text, own_ranges in zip(texts, ranges, strict=True):
            data, values = text.as_buffer().to_pybytes(), own_ranges.values
            if values is None or not len(values):
                removed.append(0)
                runs.append(0)
                kept.append(data)
                continue
            edge = np.zeros(len(data) + 1, np.int64)
            np.add.at(edge, values.field(0).to_numpy(), 1)
            np.add.at(edge, values.field(1).to_numpy(), -1)
            gone = np.cumsum(edge)[:-1] > 0
            removed.append(int(gone.sum()))
            runs.append(int((np.diff(gone.astype(np.int8)) == 1).sum()) + int(gone[:1].sum()))
            kept.append(np.frombuffer(data, np.uint8)[~gone].tobytes())
        return pa.StructArray.from_arrays([pa.array(removed, pa.int64()), pa.array(runs, pa.int64()), pa.array(kept, pa.binary())], ["n_removed", "n_spans", "kept"])

    total = found.agg(F.sum(copies)).first()[0] or 0
    least = max(2, total / C.HOT_SHARE)
    hot, cold = found.filter(F.col(copies) >= least), found.filter(F.col(copies) < least)
    text = C.text_of(text_col).cast("binary")
    n = F.octet_length(text).cast("long")
    names = [*[c for c in docs.columns if c not in ("n_bytes", "n_removed", "n_spans", "kept")], "n_bytes", "n_removed", "n_spans", "kept"]
    match = lambda t: (own[k1] == t[key1]) & (own[k2] == t[key2])
    whole = None
    if hot.limit(1).count():
        # a text that occurs twice loses all of its bytes, so hot rows need no list; at most HOT_SHARE keys
        keys = F.broadcast(hot.select(key1, key2))
        whole = own.join(keys, match(keys), "left_semi").withColumns({"n_bytes": n, "n_removed": n, "n_spans": F.lit(1).cast("long"), "kept": F.lit(b"")})
        own = own.join(keys, match(keys), "left_anti")
    rest = own.join(cold.hint("shuffle_merge"), match(cold), "left").withColumn(out, cut(text, F.col(spans)))
    rest = rest.withColumns({"n_bytes": n, **{c: F.col(f"{out}.{c}") for c in ("n_removed", "n_spans", "kept")}}).select(*names)
    return rest.unionByName(whole.select(*names)) if whole is not None else rest


def op4_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = C.documents(spark, sf_dir).select("doc_id", "text")
    kept = F.make_valid_utf8(F.col("kept").cast("string")).alias("kept_text")  # a character cut by the end of a run shows as U+FFFD
    return substring_dedup(docs).select("doc_id", "n_bytes", "n_removed", "n_spans", F.sha2("kept", 256).alias("kept_sha256"), F.octet_length("kept").cast("long").alias("n_kept"), kept)
