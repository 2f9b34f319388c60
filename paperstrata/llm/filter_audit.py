"""Interaction of document filters: what each removes in every order, and what only it would remove.

Method. A document's failures are a mask of five bits; four come from its own text, the fifth marks copies. Copies are found by
partition refinement: documents are split by their length in code points, then by hashes of successive blocks of text, each
eight times as long as the one before; a class of one document drops out at every split. What is left after the last block is
compared by full text: texts of a surviving class are grouped by class and text, and all but the smallest id of a text are
marked. Then masks are counted per part, and every order's steps are sums over at most 32 counts; no document is looked at again.

Scale. One scan makes rows of id, part, mask, length and block hashes (8 bytes a block, and six blocks reach 9 million code points).
Equal rows of hashes are added up before they are refined, so a group of copies is one row. Full texts are read again for surviving
classes only, and equal ones collapse before their shuffle. Rows meet classes in joins by weight: classes with 1/4096 of the rows
or more are broadcast, the others shuffled. The counts have at most 128 rows a part.

Defined results. Null text is empty: it fails A, and E if a smaller id is empty too. Null source is the part "". Equal ids don't
mark each other; a null id neither marks nor is marked. A document is good (toxic) if a label of its id says quality = 1
(toxic = 1). Empty tables give empty results; columns of any name beside those named are ignored.
"""

from __future__ import annotations

import itertools
import json

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from . import common as C

FILTERS = "ABCDE"
ORDERS = ["".join(p) for p in itertools.permutations(FILTERS)]
FIRST_BLOCK, GROWTH = 256, 8
BROADCAST = 200_000


def own_masks(text: Column) -> Column:
    """Bits 1, 2, 4, 8 for the filters A to D that ``text`` fails by itself."""
    chars, capitals = F.char_length(text), F.char_length(text) - F.char_length(F.translate(text, C.UPPER, ""))

    def of_words(words: Column) -> Column:
        n, distinct = F.size(words), F.size(F.array_distinct(words))
        return F.when(n < 200, 1).otherwise(0) + F.when(100 * distinct < 50 * n, 2).otherwise(0)

    return C.bind(C.words_of(text), of_words) + F.when(100 * capitals.cast("long") > 2 * chars.cast("long"), 4).otherwise(0) + F.when(F.translate(text, "#$%&*|", "") != text, 8).otherwise(0)


def blocks(longest: int) -> list[tuple[int, int]]:
    """Start and size of the blocks that cover texts of so many code points."""
    out, at, size = [], 0, FIRST_BLOCK
    while not out or at < longest:
        out.append((at, size))
        at, size = at + size, size * GROWTH
    return out


def block_hashes(text: Column, longest: int) -> Column:
    """Hashes of the blocks; a text that ends before a block has the empty string there."""
    return F.array(*(F.xxhash64(F.substring(text, at + 1, size)) for at, size in blocks(longest)))


def refined(rows: DataFrame, rounds: int) -> DataFrame:
    """The signatures (length, hashes) of ``rows`` that two rows or more have, by splitting and dropping classes of one."""
    left = C.stage(rows.groupBy("length", "hashes").agg(F.count(F.lit(1)).alias("n")))
    for k in range(rounds + 1):
        split = left.withColumn("prefix", F.slice("hashes", 1, k))
        classes = split.groupBy("length", "prefix").agg(F.sum("n").alias("size"))
        if k == rounds:
            break
        large = C.stage(classes.filter("size > 1"))
        met = split.join(F.broadcast(large), ["length", "prefix"]) if C.small(large, BROADCAST) else C.join_by_weight(split, large, ["length", "prefix"], "size")
        left = C.stage(met.select("length", "hashes", "n"))
    return left.filter("n > 1")


def copies(rows: DataFrame, texts: DataFrame, rounds: int) -> DataFrame:
    """The rows (id, part, mask, good, toxic, length, hashes) whose text a smaller id has. ``texts``: id, text, length, hashes."""
    alike = C.stage(refined(rows, rounds))
    meet = lambda left, right: left.join(F.broadcast(right), ["length", "hashes"]) if C.small(right, BROADCAST) else C.join_by_weight(left, right, ["length", "hashes"], "n")
    first = meet(texts, alike).groupBy("length", "hashes", "text").agg(F.min("id").alias("first"), F.count(F.lit(1)).alias("here"), F.first("n").alias("n"))
    first = C.stage(first.select("length", "hashes", "first", "here", "n", F.when(F.col("here") < F.col("n"), F.col("text")).alias("text")))
    whole = first.filter("here = n").select("length", "hashes", "first", "n")
    marked = meet(rows, whole).filter(F.col("id") > F.col("first")).select(*rows.columns)
    split = first.filter("here < n").select("length", "hashes", "first", "text")  # signatures that different texts share
    if not split.limit(1).count():
        return marked
    apart = texts.join(split.hint("shuffle_merge"), ["length", "hashes", "text"]).filter(F.col("id") > F.col("first"))
    return marked.unionByName(apart.select(*rows.columns))


def audit(
    docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", part_col: str = "source", hasher=block_hashes
) -> DataFrame:
    """part, filter_order, step, kept, removed, redundant, unique_fails, good_lost, toxic_lost, shapley; a row per part, order of
    the five filters, and step. labels: the id, quality, toxic. hasher: replaceable to test collisions."""
    source = docs.select(F.col(id_col).alias("id"), C.text_of(text_col).alias("text"), F.coalesce(F.col(part_col), F.lit("")).alias("part"))
    longest = source.agg(F.max(F.char_length("text"))).first()[0] or 0
    told = labels.filter("quality = 1 OR toxic = 1").groupBy(F.col(id_col).alias("label_id")).agg(F.max(F.when(F.col("quality") == 1, 1).otherwise(0)).alias("good"), F.max(F.when(F.col("toxic") == 1, 1).otherwise(0)).alias("toxic"))
    own = source.select("id", "part", own_masks(F.col("text")).alias("mask"), F.char_length("text").alias("length"), hasher(F.col("text"), longest).alias("hashes"), "text")
    labelled = own.join(C.maybe_broadcast(told, BROADCAST), F.col("id") == F.col("label_id"), "left").select("id", "part", "mask", F.coalesce("good", F.lit(0)).alias("good"), F.coalesce("toxic", F.lit(0)).alias("toxic"), "length", "hashes", "text")
    rows = C.stage(labelled.drop("text"))
    marked = C.stage(copies(rows, labelled, len(blocks(longest))).select("part", "mask", "good", "toxic"))
    counted = rows.groupBy("part", "mask", "good", "toxic").agg(F.count(F.lit(1)).alias("n"))
    moved = marked.groupBy("part", "mask", "good", "toxic").agg(F.count(F.lit(1)).alias("n"))
    every = counted.unionByName(moved.withColumn("n", -F.col("n"))).unionByName(moved.withColumn("mask", F.col("mask") + 16))
    return _steps(every.groupBy("part", "mask").agg(F.sum("n").alias("n"), F.sum(F.col("n") * F.col("good")).alias("good"), F.sum(F.col("n") * F.col("toxic")).alias("toxic")))


def _steps(masks: DataFrame) -> DataFrame:
    """All orders' steps from the counts of masks."""
    steps = [{"filter_order": o, "step": k + 1, "bit": 1 << FILTERS.index(o[k]), "before": sum(1 << FILTERS.index(f) for f in o[:k])} for o in ORDERS for k in range(len(o))]
    literal = F.from_json(F.lit(json.dumps(steps)), "array<struct<filter_order:string,step:int,bit:int,before:int>>")
    parts = masks.groupBy("part").agg(F.collect_list(F.struct("mask", "n", "good", "toxic")).alias("masks"))  # at most 32
    rows = parts.select("part", "masks", F.explode(literal).alias("at"))
    bit, before = F.col("at.bit"), F.col("at.before")
    has = lambda m, bits: m["mask"].bitwiseAND(bits) != 0
    total = lambda value, test: F.aggregate("masks", F.lit(0).cast("long"), lambda n, m: n + F.when(test(m), value(m)).otherwise(0))
    now = lambda m: has(m, bit) & ~has(m, before)
    count = lambda m: m["n"]
    share = lambda m: m["n"] * F.floor(F.lit(len(ORDERS)) / F.bit_count(m["mask"])).cast("long")
    return rows.select(
        "part", "at.filter_order", "at.step",
        total(count, lambda m: ~has(m, before.bitwiseOR(bit))).alias("kept"),
        total(count, now).alias("removed"),
        total(count, lambda m: has(m, bit) & has(m, before)).alias("redundant"),
        total(count, lambda m: m["mask"] == bit).alias("unique_fails"),
        total(lambda m: m["good"], now).alias("good_lost"),
        total(lambda m: m["toxic"], now).alias("toxic_lost"),
        # of the filters that a document fails, each is first in an equal share of the orders
        total(share, lambda m: has(m, bit)).alias("shapley"),
    )


def op11_filter_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    return audit(C.documents(spark, sf_dir), C.labels(spark, sf_dir))


ORACLE = f"""
WITH d AS (SELECT doc_id, coalesce(source, '') AS part, coalesce(text, '') AS t, list_filter(regexp_split_to_array(coalesce(text, ''), '[\\x20\\x09-\\x0D]+'), lambda x: x <> '') AS w FROM documents),
l AS (SELECT doc_id, max(CASE WHEN quality = 1 THEN 1 ELSE 0 END) AS good, max(CASE WHEN toxic = 1 THEN 1 ELSE 0 END) AS toxic FROM labels GROUP BY doc_id),
f AS (SELECT part, coalesce(l.good, 0) AS good, coalesce(l.toxic, 0) AS toxic,
  (CASE WHEN len(w) < 200 THEN 1 ELSE 0 END) + (CASE WHEN 100 * len(list_distinct(w)) < 50 * len(w) THEN 2 ELSE 0 END)
  + (CASE WHEN 100 * (length(t) - length(regexp_replace(t, '[A-Z]', '', 'g'))) > 2 * length(t) THEN 4 ELSE 0 END)
  + (CASE WHEN regexp_matches(t, '[#$%&*|]') THEN 8 ELSE 0 END)
  + (CASE WHEN d.doc_id > min(d.doc_id) OVER (PARTITION BY t) THEN 16 ELSE 0 END) AS mask
  FROM d LEFT JOIN l ON d.doc_id = l.doc_id),
m AS (SELECT part, mask, count(*) AS n, sum(good) AS good, sum(toxic) AS toxic FROM f GROUP BY part, mask),
o AS (SELECT unnest({ORDERS!r}) AS filter_order),
s AS (SELECT filter_order, step, 1 << (instr('{FILTERS}', filter_order[step]) - 1) AS bit FROM o, (SELECT unnest(range(1, 6))::INTEGER AS step)),
b AS (SELECT x.filter_order, x.step, x.bit, coalesce(sum(y.bit), 0)::INTEGER AS before FROM s x LEFT JOIN s y ON x.filter_order = y.filter_order AND y.step < x.step GROUP BY ALL),
q AS (SELECT part, filter_order, step, bit, before,
  coalesce(sum(n) FILTER (WHERE mask & (before | bit) = 0), 0)::BIGINT AS kept,
  coalesce(sum(n) FILTER (WHERE mask & bit <> 0 AND mask & before = 0), 0)::BIGINT AS removed,
  coalesce(sum(n) FILTER (WHERE mask & bit <> 0 AND mask & before <> 0), 0)::BIGINT AS redundant,
  coalesce(sum(n) FILTER (WHERE mask = bit), 0)::BIGINT AS unique_fails,
  coalesce(sum(good) FILTER (WHERE mask & bit <> 0 AND mask & before = 0), 0)::BIGINT AS good_lost,
  coalesce(sum(toxic) FILTER (WHERE mask & bit <> 0 AND mask & before = 0), 0)::BIGINT AS toxic_lost
  FROM m, b GROUP BY ALL)
SELECT part, filter_order, step, kept, removed, redundant, unique_fails, good_lost, toxic_lost,
  (sum(removed) OVER (PARTITION BY part, bit))::BIGINT AS shapley
FROM q
"""
