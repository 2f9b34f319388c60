"""Mixing sources to target weights: token sums per source, repetition rates, whole copies plus one hash-seeded Bernoulli copy.

Method. Sizes are summed per source (partial sums first, so a hot source is one row per task). Targets follow the weights
under the cap, by water filling: with sources ordered by cap / weight, the level is the first one at which the sources not
yet at their cap take exactly what is left, which is where resharing the excess again and again ends. A source's rate is
target / size; a document is emitted floor(rate) times and once more by a hash-seeded draw whose probability is the fraction.
Independent draws would leave the taken words of small sources far from their targets (0.53 to 1.32 of them with 50 documents
a source), so the draws of a source are tied: those whose hash lies in one interval of the source are drawn (see ``draws``),
which leaves each document's probability as it is. Hashes depend on seed, id and source alone: reruns, retries and other
partitionings agree.

Scale. Texts are read once to count words; only (id, size, source, hash) is staged. The tables of targets and intervals have a
row per source. They are broadcast if counted to have at most BROADCAST_SOURCES rows and joined by shuffle beyond. The
cumulative sums over sources run in one task over the table of sums; those over documents in the cells of about CELL_ROWS
documents that hold an end of an interval, two a source.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from . import common as C

BROADCAST_SOURCES = 50_000
CELL_ROWS = 50_000
HASH_BITS = 52
WEIGHTS = (5.0, 2.0, 1.0)
MAX_RATE = 3.0


def targets(sizes: DataFrame, weights: tuple[float, ...] = WEIGHTS, max_rate: float = MAX_RATE) -> DataFrame:
    """(source, size) rows, any number per source, to one row per source: source, source_size, target, rate.

    Weights are dealt to the sources in order of code point, null last, repeating. Targets share the total size by weight,
    none above max_rate times its source's size. A source of size 0 has target and rate 0. Null sizes count 0.
    """
    sums = sizes.groupBy("source").agg(F.coalesce(F.sum("size"), F.lit(0)).alias("source_size"))
    nth = F.row_number().over(W.orderBy(F.col("source").asc_nulls_last())) - 1
    weight = F.element_at(F.array(*map(F.lit, weights)), (F.col("nth") % len(weights) + 1).cast("int"))
    capped = sums.withColumn("nth", nth).withColumn("weight", weight).withColumn("cap", F.col("source_size") * F.lit(float(max_rate)))
    by_ratio = W.orderBy(F.col("cap") / F.col("weight"), "nth")
    left = F.sum("source_size").over(W.partitionBy()) - F.coalesce(F.sum("cap").over(by_ratio.rowsBetween(W.unboundedPreceding, -1)), F.lit(0.0))
    level = left / F.sum("weight").over(by_ratio.rowsBetween(W.currentRow, W.unboundedFollowing))
    fits = F.when(F.col("level") <= F.col("cap") / F.col("weight"), F.col("level"))
    # levels fall from the first that fits on, so that one is the largest that fits
    filled = capped.withColumn("level", level).withColumn("level", F.max(fits).over(W.partitionBy()))
    target = F.least(F.col("cap"), F.coalesce(F.col("level") * F.col("weight"), F.col("cap")))
    filled = filled.withColumn("target", target)
    rate = F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(F.lit(0.0))
    return filled.select("source", "source_size", "target", rate.alias("rate"))


def unit(value: Column, seed: str) -> Column:
    """A number of 52 bits from MD5 of seed and value."""
    digest = F.md5(F.concat(F.lit(f"{seed}:"), F.coalesce(value.cast("string"), F.lit("null"))))
    return F.conv(F.substring(digest, 1, 13), 16, 10).cast("long")


def sized(docs: DataFrame, id_col: str, text_col: str, source_col: str, seed: str) -> DataFrame:
    """id, source, size (words) and h (the id's hash) of each row."""
    size = F.size(C.words_of(C.text_of(text_col))).cast("long")
    return docs.select(F.col(id_col).alias("id"), F.col(source_col).alias("source"), size.alias("size"), unit(F.col(id_col), seed).alias("h"))


def draws(sizes: DataFrame, table: DataFrame, seed: str) -> DataFrame:
    """``table`` (staged; a row per source) with lo, hi and wraps: hashes in [lo, hi), or outside [hi, lo) if it wraps, get
    the further copy. ``sizes`` is staged (source, size, h).

    In order of hash, the documents of a source fill [0, source_size) by their sizes; a document's point is the middle of its
    part. The drawn interval has the length fraction * source_size and starts at a hash-seeded place of the circle, so each
    document is drawn with probability fraction, and what is drawn differs from that length by at most half a document at
    either end. The ends are looked up in sums per cell of hashes, and then among the documents of their two cells alone.
    """
    bits = max(0, math.ceil(math.log2(max(1, sizes.count() / CELL_ROWS))))
    cell = F.shiftrightunsigned("h", HASH_BITS - bits).cast("long")
    length = F.col("source_size").cast("double")
    begin = unit(F.col("source"), f"{seed}:source") / F.lit(float(1 << HASH_BITS))
    end = begin + F.col("rate") - F.floor("rate")
    ends = table.select("source", (begin * length).alias("lo"), (F.when(end < 1, end).otherwise(end - 1) * length).alias("hi"))
    ends = ends.select(F.col("source").alias("of"), F.explode(F.array(F.struct(F.lit("lo").alias("edge"), F.col("lo").alias("at")), F.struct(F.lit("hi").alias("edge"), F.col("hi").alias("at")))).alias("e")).select("of", "e.*")
    ends = C.stage(ends)
    cells = sizes.groupBy("source", cell.alias("cell")).agg(F.sum("size").alias("words"))
    before = F.sum("words").over(W.partitionBy("source").orderBy("cell")) - F.col("words")
    places = C.stage(C.beside(cells.withColumn("before", before), ends, "source", "of", BROADCAST_SOURCES).filter((F.col("before") <= F.col("at")) & (F.col("at") < F.col("before") + F.col("words"))).select("of", F.col("cell").alias("in_cell"), "edge", "at", "before"))
    inside = C.beside(sizes.withColumn("cell", cell), places, "source", "of", BROADCAST_SOURCES, F.col("cell") == F.col("in_cell"))
    own = W.partitionBy("of", "edge").orderBy("h")
    summed = inside.groupBy("of", "edge", "at", "before", "cell", "h").agg(F.sum("size").alias("words"))
    middle = F.col("before") + F.sum("words").over(own) - F.col("words") / 2
    # no document behind the place in its cell: the next cell begins behind it
    found = summed.withColumn("middle", middle).groupBy("of", "edge").agg(F.coalesce(F.min(F.when(F.col("middle") >= F.col("at"), F.col("h"))), F.shiftleft(F.max("cell") + 1, HASH_BITS - bits)).alias("cut"))
    cuts = found.groupBy("of").agg(*[F.max(F.when(F.col("edge") == e, F.col("cut"))).alias(e) for e in ("lo", "hi")])
    joined = table.join(cuts, table["source"].eqNullSafe(F.col("of")), "left")
    return joined.select(table["source"], "source_size", "target", "rate", (end >= 1).alias("wraps"), *[F.coalesce(e, F.lit(1 << HASH_BITS)).alias(e) for e in ("lo", "hi")])


def copies(rate: Column, h: Column, lo: Column, hi: Column, wraps: Column) -> Column:
    drawn = F.when(wraps, (h >= lo) | (h < hi)).otherwise((h >= lo) & (h < hi)) & (rate > F.floor(rate))
    return (F.floor(rate) + drawn.cast("long")).cast("long")


def _planned(sizes: DataFrame, weights: tuple[float, ...], max_rate: float, seed: str) -> DataFrame:
    return C.stage(draws(sizes, C.stage(targets(sizes, weights, max_rate)), seed))


def plan(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", weights: tuple[float, ...] = WEIGHTS, max_rate: float = MAX_RATE, seed: str = "mix") -> DataFrame:
    """One row per input row: id, source, size (words), source_size, target, rate, copies, taken (size times copies).

    A source's taken words differ from its target by at most its largest document. Null text has size 0; null is a source of
    its own, the last. Rows that repeat an id share its decision and count as one document in that bound. Empty input gives an
    empty result; other columns are ignored.
    """
    sizes = C.stage(sized(docs, id_col, text_col, source_col, seed))
    out = C.beside(sizes, _planned(sizes, weights, max_rate, seed).withColumnRenamed("source", "of"), "source", "of", BROADCAST_SOURCES)
    out = out.withColumn("copies", copies(F.col("rate"), F.col("h"), F.col("lo"), F.col("hi"), F.col("wraps")))
    return out.select(F.col("id").alias(id_col), "source", "size", "source_size", "target", "rate", "copies", (F.col("copies") * F.col("size")).alias("taken"))


def mix(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", weights: tuple[float, ...] = WEIGHTS, max_rate: float = MAX_RATE, seed: str = "mix") -> DataFrame:
    """``docs`` with each row emitted as often as ``plan`` says, columns as they are. Texts are not shuffled: rates and drawn
    intervals are joined to the rows where they lie, if broadcast."""
    table = _planned(C.stage(sized(docs, id_col, text_col, source_col, seed)), weights, max_rate, seed)
    key, mine, n = C.fresh(docs, "mix_source", "mix_plan", "mix_copy")
    joined = C.beside(docs, table.select(F.col("source").alias(key), F.struct("rate", "lo", "hi", "wraps").alias(mine)), source_col, key, BROADCAST_SOURCES)
    times = copies(F.col(f"{mine}.rate"), unit(F.col(id_col), seed), *[F.col(f"{mine}.{c}") for c in ("lo", "hi", "wraps")]).cast("int")
    return joined.withColumn(n, F.explode(F.array_repeat(F.lit(0), times))).select(*docs.columns)


def op10_mix_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    return plan(C.documents(spark, sf_dir)).select("doc_id", "size", "source_size", "target", "taken", "source", "rate", "copies")


ORACLE = r"""
WITH s AS (
  SELECT doc_id, source, CAST(len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) AS BIGINT) AS size FROM documents
), q AS (
  SELECT source, CAST(sum(size) AS BIGINT) AS source_size, row_number() OVER (ORDER BY source ASC NULLS LAST) - 1 AS nth FROM s GROUP BY source
), w AS (
  SELECT *, CASE nth % 3 WHEN 0 THEN 5.0::DOUBLE WHEN 1 THEN 2.0::DOUBLE ELSE 1.0::DOUBLE END AS weight, source_size * 3.0::DOUBLE AS cap FROM q
), l AS (
  SELECT *, (sum(source_size) OVER () - coalesce(sum(cap) OVER (ORDER BY cap / weight, nth ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))
    / sum(weight) OVER (ORDER BY cap / weight, nth ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS level FROM w
), f AS (
  SELECT source, source_size, weight, cap, max(CASE WHEN level <= cap / weight THEN level END) OVER () AS level FROM l
), t AS (
  SELECT source, source_size, least(cap, coalesce(level * weight, cap)) AS target FROM f
), r AS (
  SELECT *, CASE WHEN source_size > 0 THEN target / source_size ELSE 0 END AS rate FROM t
), p AS (
  SELECT *, CAST('0x' || substr(md5('mix:source:' || coalesce(source, 'null')), 1, 13) AS BIGINT) / 4503599627370496.0::DOUBLE AS b FROM r
), i AS (
  SELECT *, b * source_size::DOUBLE AS lo, (CASE WHEN b + rate - floor(rate) < 1 THEN b + rate - floor(rate) ELSE b + rate - floor(rate) - 1 END) * source_size::DOUBLE AS hi FROM p
), h AS (
  SELECT *, CAST('0x' || substr(md5('mix:' || coalesce(CAST(doc_id AS VARCHAR), 'null')), 1, 13) AS BIGINT) AS h FROM s
), m AS (
  SELECT source, h, sum(words) OVER (PARTITION BY source ORDER BY h) - words / 2.0::DOUBLE AS middle FROM (SELECT source, h, CAST(sum(size) AS BIGINT) AS words FROM h GROUP BY source, h)
), c AS (
  SELECT h.doc_id, h.size, i.source_size, i.target, h.source, i.rate,
    CAST(floor(i.rate) AS BIGINT) + CASE WHEN i.rate > floor(i.rate) AND CASE WHEN b + rate - floor(rate) < 1 THEN middle >= lo AND middle < hi ELSE middle >= lo OR middle < hi END THEN 1 ELSE 0 END AS copies
  FROM h JOIN i ON h.source IS NOT DISTINCT FROM i.source JOIN m ON h.source IS NOT DISTINCT FROM m.source AND h.h = m.h
)
SELECT doc_id, size, source_size, target, CAST(copies * size AS BIGINT) AS taken, source, rate, CAST(copies AS BIGINT) AS copies FROM c
"""
