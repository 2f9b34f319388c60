"""Spatial joins on pages of any density: cells that hold many boxes are split in four, again and again.

A sample by hash tells which cells to split, so a dense page or a dense corner of one becomes many small join keys, and a sparse
page stays one. Both sides go down the same tree; boxes that reach over several leaves are in each of them, and a pair is
reported in the leaf of its common part's upper left corner.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .layout import _LINES, _lines, centre_in, intersects
from .tree import staged

SIDE = 1024.0  #: width and height of the undivided cells
DEEPEST = 12  #: levels below these, so the smallest cells are a quarter of a point
LIMIT = 1000  #: upper left corners in a cell that isn't split, by estimate
ONE_IN = 16  #: boxes of which one is in the sample
BROADCAST_CELLS = 200_000  #: split cells that are sent to all tasks; more are joined by shuffles

_BOX = ("x", "y", "w", "h")


def _sound(boxes: DataFrame) -> DataFrame:
    """Boxes with a page, a place and a size; null or negative sizes meet nothing."""
    return boxes.select("id", "page", *[F.col(c).cast("double").alias(c) for c in _BOX]).filter("page IS NOT NULL AND x IS NOT NULL AND y IS NOT NULL AND w >= 0 AND h >= 0")


def split_cells(boxes: DataFrame, limit: int = LIMIT, one_in: int = ONE_IN) -> DataFrame:
    """Cells (page, level, cx, cy) to split. The sample decides on balance only, not on results."""
    sample = _sound(boxes).filter(F.pmod(F.xxhash64("id", "page", *_BOX), F.lit(one_in)) == 0)
    at = lambda c, level: F.floor(F.col(c) / (SIDE / 2**level)).alias(f"c{c}")
    cells = [F.struct(F.lit(level).alias("level"), at("x", level), at("y", level)) for level in range(DEEPEST)]
    counts = sample.select("page", F.inline(F.array(*cells))).groupBy("page", "level", "cx", "cy").count()
    return counts.filter(F.col("count") * one_in > limit).drop("count")


def leaves(boxes: DataFrame, name: str, splits: DataFrame, levels: int) -> DataFrame:
    """Boxes as {name}_* with the leaves (level, cx, cy) they reach into; ``splits`` are split down to ``levels``."""
    size = F.lit(SIDE) / F.pow(F.lit(2.0), F.col("level"))
    first = lambda c: F.floor(F.col(f"{name}_{c}") / size)
    last = lambda c, s: F.floor((F.col(f"{name}_{c}") + F.col(f"{name}_{s}")) / size)
    rows = _sound(boxes).select(*[F.col(c).alias(f"{name}_{c}") for c in ("id", "page", *_BOX)], F.lit(0).alias("level"))
    rows = rows.withColumn("cx", F.explode(F.sequence(first("x"), last("x", "w")))).withColumn("cy", F.explode(F.sequence(first("y"), last("y", "h"))))
    for level in range(levels):
        here = splits.filter(F.col("level") == level).select(F.col("page").alias(f"{name}_page"), "level", "cx", "cy", F.lit(1).alias("_down"))
        rows = rows.join(here, [f"{name}_page", "level", "cx", "cy"], "left")
        down = F.col("_down").isNotNull()
        rows = rows.withColumn("level", F.col("level") + F.when(down, 1).otherwise(0))
        half = lambda c, s: F.explode(F.when(down, F.sequence(F.greatest(F.col(f"c{c}") * 2, first(c)), F.least(F.col(f"c{c}") * 2 + 1, last(c, s)))).otherwise(F.array(f"c{c}")))  # noqa: E731, B023
        rows = rows.withColumn("cx", half("x", "w")).withColumn("cy", half("y", "h")).drop("_down")
    return rows


def partitioned(a: DataFrame, b: DataFrame, limit: int = LIMIT, one_in: int = ONE_IN) -> tuple[DataFrame, DataFrame]:
    """Both tables of boxes with the leaves of one tree over their pages."""
    both = _sound(a).unionByName(_sound(b).withColumn("id", F.col("id").cast(a.schema["id"].dataType)))
    splits = staged(split_cells(both, limit, one_in))
    n, deepest = splits.agg(F.count(F.lit(1)), F.max("level")).first()
    splits = F.broadcast(splits) if n <= BROADCAST_CELLS else splits
    levels = 0 if deepest is None else deepest + 1
    return leaves(a, "a", splits, levels), leaves(b, "b", splits, levels)


def overlap_join(a: DataFrame, b: DataFrame, limit: int = LIMIT, one_in: int = ONE_IN) -> DataFrame:
    """Pairs of boxes (id, page, x, y, w, h) that intersect on their page: a_* and b_*, as ``layout.overlap_join`` gives them.

    Repeated rows give repeated pairs; empty tables none. Boxes at one and the same corner stay in one leaf, and all of their
    pairs are results.
    """
    ga, gb = partitioned(a, b, limit, one_in)
    key = (F.col("a_page") == F.col("b_page"), *[ga[c] == gb[c] for c in ("level", "cx", "cy")])
    size = F.lit(SIDE) / F.pow(F.lit(2.0), ga["level"])
    corner = (ga["cx"] == F.floor(F.greatest("a_x", "b_x") / size)) & (ga["cy"] == F.floor(F.greatest("a_y", "b_y") / size))
    return ga.join(gb, list(key)).filter(intersects() & corner).select(*[f"{t}_{c}" for t in "ab" for c in ("id", "page", *_BOX)])


def _sheet(s, d, kind):
    """All order lines as small boxes on one sheet, those of a flag densely: more orders are more boxes, and a longer sheet."""
    dense = F.when(F.col("l_returnflag") == "R", 64.0).otherwise(16.0)
    y = (F.col("l_partkey") * 53 + F.col("l_suppkey") * 7919) % 100_000 / dense + F.expr("l_orderkey DIV 10000") * 6250
    rows = _lines(s, d).filter(F.col("l_returnflag").isin("R", kind))
    boxes = rows.select("id", F.lit("sheet").alias("page"), (F.col("l_extendedprice").cast("double") / 8).alias("x"), y.alias("y"), F.col("l_quantity").cast("double").alias("w"), (F.col("l_linenumber") * 2.0).alias("h"), F.col("l_linestatus").alias("status"))
    return boxes


_SHEET = f"""SELECT id, l_returnflag AS flag, l_linestatus AS status, CAST(l_extendedprice AS DOUBLE) / 8 AS x, (l_partkey * 53 + l_suppkey * 7919) % 100000 / CASE l_returnflag WHEN 'R' THEN 64.0::DOUBLE ELSE 16.0::DOUBLE END + l_orderkey // 10000 * 6250 AS y,
  CAST(l_quantity AS DOUBLE) AS w, l_linenumber * 2.0::DOUBLE AS h FROM ({_LINES}) WHERE l_returnflag IN ('R', 'A')"""
_NEAR = "JOIN b ON a.x < b.x + b.w AND b.x < a.x + a.w AND a.y < b.y + b.h AND b.y < a.y + a.h"
_AB = f"WITH s AS ({_SHEET}), a AS (SELECT * FROM s WHERE status = 'F'), b AS (SELECT * FROM s WHERE id % 2 = 0)"

QUERIES = {
    "bbox_overlap_dense": (
        lambda s, d: (lambda k: overlap_join(k.filter("status = 'F'"), k.filter("id % 2 = 0")).select("a_id", "b_id"))(_sheet(s, d, "A")),
        f"{_AB} SELECT a.id AS a_id, b.id AS b_id FROM a {_NEAR}",
    ),
    "bbox_centre_in_dense": (
        lambda s, d: (lambda k: overlap_join(k.filter("status = 'F'"), k.filter("id % 2 = 0")).filter(centre_in()).filter("a_id <> b_id").groupBy("a_id").agg(F.count(F.lit(1)).alias("n")))(_sheet(s, d, "A")),
        f"{_AB} SELECT a.id AS a_id, count(*) AS n FROM a {_NEAR} AND a.x + a.w / 2 BETWEEN b.x AND b.x + b.w AND a.y + a.h / 2 BETWEEN b.y AND b.y + b.h AND a.id <> b.id GROUP BY a.id",
    ),
}
