"""Line dedup: a sharded minimal perfect hash over distinct line hashes indexes fingerprint and count arrays; documents probe
the arrays instead of joining lines.

Method. A line's key is the line stripped of \\x20 and \\x09-\\x0D at both ends, A-Z lower-cased; two seeded 64-bit hashes
stand for it. Document counts per distinct key come from one aggregation (each document names a key once; partial counts
first, so a line that is everywhere is one row per task). Keys are dealt to shards by the first hash's high bits; one task a
shard builds the minimal perfect hash with its fingerprint and count arrays, about 5.5 bytes a distinct line, counts
saturating. The hashes of the documents' lines go to the shard of their keys and probe its arrays there; the positions of
frequent lines come back to the documents.

Scale. There is one path at every size. No array leaves its shard and nothing that grows with the input is collected. A shard
has about SHARD_ROWS keys and lines to probe. A key in HOT_ROWS documents or more, and in more than 1/HOT_KEYS of all (document,
key) pairs, would bring all its lines to one shard: such keys, at most HOT_KEYS of them, have a perfect hash of their own (at
most some 10 MB), which is sent to the executors and probed first; only lines that it doesn't know travel. Texts are shuffled
once, to meet their positions.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from . import common as C
from . import mphf

SHARD_ROWS = 500_000
HOT_ROWS = 10_000
HOT_KEYS = 1 << 20

BUILT = "shard int, sizes binary, bits binary, prints binary, counts binary"


def lines_of(text: Column) -> Column:
    return F.split(text, "\n", -1)


def _keys(text: Column, min_chars: int) -> Column:
    """Per line the two hashes of its key, or null for a key shorter than min_chars."""
    key = lambda x: C.strip_spaces(x)
    hashes = lambda k: F.when(F.char_length(k) >= min_chars, F.struct(F.xxhash64(F.lit(1), k).alias("a"), F.xxhash64(F.lit(2), k).alias("b")))
    return F.transform(F.transform(lines_of(C.ascii_lower(text)), key), hashes)


def line_counts(docs: DataFrame, text_col: str = "text", min_chars: int = 1) -> DataFrame:
    """a, b, n: the hashes of each distinct line key and the number of rows that have it."""
    own = F.array_distinct(F.filter(_keys(C.text_of(text_col), min_chars), lambda h: h.isNotNull()))
    return docs.select(F.explode(own).alias("h")).groupBy(F.col("h.a").alias("a"), F.col("h.b").alias("b")).agg(F.count(F.lit(1)).alias("n"))


def _count_dtype(min_docs: int):
    return next(d for d in (np.uint8, np.uint16, np.uint32, np.uint64) if min_docs <= np.iinfo(d).max)


def build_index(counts: DataFrame, shard: Column, min_docs: int) -> DataFrame:
    """One row per shard (columns of BUILT) of the counted keys."""
    dtype = _count_dtype(min_docs)

    def build(table: pa.Table) -> pa.Table:
        a, b = (table[c].to_numpy().view(np.uint64) for c in ("a", "b"))
        n = np.minimum(table["n"].to_numpy(), np.iinfo(dtype).max).astype(dtype)
        arrays = mphf.build(a, b, n)
        return pa.table([pa.array([table["shard"][0].as_py()], pa.int32()), *(pa.array([x], pa.binary()) for x in arrays)], ["shard", "sizes", "bits", "prints", "counts"])

    return counts.select("a", "b", "n", shard.alias("shard")).groupBy("shard").applyInArrow(build, BUILT)


def _hits(index: mphf.Index, a: pa.Array, b: pa.Array, min_docs: int) -> np.ndarray:
    return index.probe(*(x.to_numpy(zero_copy_only=False).view(np.uint64) for x in (a, b))) >= min_docs


def _known_hot(lines: DataFrame, hot: DataFrame, min_docs: int) -> Column:
    """Whether the hot keys' arrays, sent to the executors, know a line."""
    (arrays,) = build_index(hot, F.lit(0), min_docs).collect()  # at most HOT_KEYS keys
    sent = lines.sparkSession.sparkContext.broadcast([(0, *map(bytes, arrays[1:]))])
    held = []

    @F.arrow_udf("boolean")
    def known(a: pa.Array, b: pa.Array) -> pa.Array:
        if not held:
            held.append(mphf.Index(0, sent.value, _count_dtype(min_docs)))
        return pa.array(_hits(held[0], a, b, min_docs))

    return known("a", "b")


def _probed(lines: DataFrame, counts: DataFrame, bits: int, min_docs: int) -> DataFrame:
    """r1, r2, pos of the lines whose keys are in min_docs documents or more: each shard probes its own arrays."""
    shard = F.shiftrightunsigned("a", 64 - bits).cast("int") if bits else F.lit(0)

    def probe(own: pa.Table, arrays: pa.Table) -> pa.Table:
        hit = np.zeros(own.num_rows, bool)
        if own.num_rows and arrays.num_rows:
            one = mphf.Index(0, [(0, *(arrays[c][0].as_py() for c in ("sizes", "bits", "prints", "counts")))], _count_dtype(min_docs))
            hit = _hits(one, own["a"].combine_chunks(), own["b"].combine_chunks(), min_docs)
        return own.select(["r1", "r2", "pos"]).filter(pa.array(hit))

    index = build_index(counts, shard, min_docs).groupBy("shard")
    return lines.withColumn("shard", shard).groupBy("shard").cogroup(index).applyInArrow(probe, "r1 bigint, r2 bigint, pos int")


def frequent_lines(docs: DataFrame, id_col: str, text_col: str, min_docs: int, min_chars: int) -> DataFrame:
    """r1, r2 (hashes of id and text) and the positions of the lines to drop, of rows that have any."""
    counts = C.stage(line_counts(docs, text_col, min_chars))
    total, keys = counts.agg(F.coalesce(F.sum("n"), F.lit(0)), F.count(F.lit(1))).first()
    own = docs.select(*row_key(id_col, text_col), _keys(C.text_of(text_col), min_chars).alias("keys"))  # first: texts aren't exploded
    lines = own.select("r1", "r2", F.posexplode("keys").alias("pos", "h")).filter("h IS NOT NULL").select("r1", "r2", "pos", "h.a", "h.b")
    least = max(HOT_ROWS, min_docs, total // HOT_KEYS + 1)
    hot = counts.filter(F.col("n") >= least)
    found = None
    if hot.limit(1).count():
        lines = C.stage(lines.withColumn("known", _known_hot(lines, hot, min_docs)))
        found = lines.filter("known").select("r1", "r2", "pos")
        lines = lines.filter("NOT known").drop("known")
    bits = max(0, math.ceil(math.log2(max(1, keys / SHARD_ROWS, total / SHARD_ROWS))))
    cold = _probed(lines, counts.filter(F.col("n") < least), bits, min_docs)
    found = cold if found is None else found.unionByName(cold)
    return found.groupBy("r1", "r2").agg(F.collect_set("pos").alias("gone"))


def row_key(id_col: str, text_col: str) -> list[Column]:
    """Two 64-bit hashes that stand for a row's id and text; rows that repeat both lose the same lines."""
    return [F.xxhash64(F.lit(i), F.col(id_col), C.text_of(text_col)).alias(f"r{i}") for i in (1, 2)]


def line_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", min_docs: int = 10, min_chars: int = 1) -> DataFrame:
    """``docs`` with the columns kept_text, n_lines and n_dropped added (or replaced).

    Lines are split at \\n; a null or empty text is one empty line. Keys of at least min_chars code points found in at least
    min_docs rows lose all their lines in every row, so repeats inside a row count once and lines that strip to nothing stay.
    Rows that repeat an id count as documents of their own. Empty input gives an empty result.
    """
    r1, r2, f1, f2, gone = C.fresh(docs, "r1", "r2", "f1", "f2", "gone_lines")
    found = frequent_lines(docs, id_col, text_col, min_docs, min_chars).toDF(f1, f2, gone)
    a, b = row_key(id_col, text_col)
    joined = docs.withColumns({r1: a, r2: b}).join(found.hint("shuffle_merge"), (F.col(r1) == F.col(f1)) & (F.col(r2) == F.col(f2)), "left")
    text = C.text_of(text_col)

    def kept(lines: Column) -> Column:
        return F.array_join(F.transform(F.array_except(F.sequence(F.lit(0), F.size(lines) - 1), F.col(gone)), lambda i: F.get(lines, i)), "\n")

    n_lines = F.char_length(text) - F.char_length(F.replace(text, F.lit("\n"), F.lit(""))) + 1
    out = {"n_lines": n_lines.cast("long"), "n_dropped": F.when(F.col(gone).isNull(), F.lit(0)).otherwise(F.size(gone)).cast("long"), "kept_text": F.when(F.col(gone).isNull(), text).otherwise(C.bind(lines_of(text), kept))}
    return joined.withColumns(out).drop(r1, r2, f1, f2, gone)


def op1_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = C.documents(spark, sf_dir).select("doc_id", "text")
    return line_dedup(docs).select("doc_id", "n_lines", "n_dropped", F.sha2("kept_text", 256).alias("kept_sha256"))


ORACLE = rf"""
WITH d AS (SELECT row_number() OVER () AS rid, doc_id, string_split(coalesce(text, ''), chr(10)) AS lines FROM documents),
e AS (SELECT rid, doc_id, unnest(lines) AS line, unnest(range(len(lines))) AS i FROM d),
k AS (SELECT *, regexp_replace(regexp_replace(translate(line, '{C.UPPER}', '{C.UPPER.lower()}'), '^[\x20\x09-\x0D]+', ''), '[\x20\x09-\x0D]+$', '') AS key FROM e),
f AS (SELECT key FROM k WHERE length(key) >= 1 GROUP BY key HAVING count(DISTINCT rid) >= 10),
m AS (SELECT k.*, f.key IS NOT NULL AS gone FROM k LEFT JOIN f ON k.key = f.key)
SELECT any_value(doc_id) AS doc_id, count(*) AS n_lines, CAST(count(*) FILTER (gone) AS BIGINT) AS n_dropped,
  sha256(coalesce(string_agg(line, chr(10) ORDER BY i) FILTER (NOT gone), '')) AS kept_sha256
FROM m GROUP BY rid
"""
