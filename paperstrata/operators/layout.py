"""Geometry of page layouts and the checks of extracted tables.

Boxes are x, y, w, h with a page. Spatial joins are equi-joins on page and grid cell, so they hash instead of comparing all
boxes of a page; a pair that shares several cells is reported in one of them.
"""

from __future__ import annotations

import functools

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from ..functions import text as T
from ..session import dealt, table
from .tree import staged

CELL = 100.0


def intersects(a: str = "a", b: str = "b") -> Column:
    c = lambda t, x: F.col(f"{t}_{x}")
    return (c(a, "x") < c(b, "x") + c(b, "w")) & (c(b, "x") < c(a, "x") + c(a, "w")) & (c(a, "y") < c(b, "y") + c(b, "h")) & (c(b, "y") < c(a, "y") + c(a, "h"))


def centre_in(a: str = "a", b: str = "b") -> Column:
    """The centre of a lies in b, edges included."""
    c = lambda t, x: F.col(f"{t}_{x}")
    cx, cy = c(a, "x") + c(a, "w") / 2, c(a, "y") + c(a, "h") / 2
    return cx.between(c(b, "x"), c(b, "x") + c(b, "w")) & cy.between(c(b, "y"), c(b, "y") + c(b, "h"))


def expand(boxes: DataFrame, by: float, width: float, height: float) -> DataFrame:
    """Boxes larger by a margin on all sides, clipped to the page."""
    x0, y0 = F.greatest(F.col("x") - by, F.lit(0.0)), F.greatest(F.col("y") - by, F.lit(0.0))
    x1, y1 = F.least(F.col("x") + F.col("w") + by, F.lit(width)), F.least(F.col("y") + F.col("h") + by, F.lit(height))
    return boxes.withColumns({"x": x0, "y": y0, "w": x1 - x0, "h": y1 - y0})


def _named(boxes: DataFrame, name: str) -> DataFrame:
    return boxes.select(*[F.col(c).alias(f"{name}_{c}") for c in ("id", "page", "x", "y", "w", "h")])


def _gridded(boxes: DataFrame, name: str, cell: float) -> DataFrame:
    cells = lambda low, size: F.sequence(F.floor(F.col(f"{name}_{low}") / cell), F.floor((F.col(f"{name}_{low}") + F.col(f"{name}_{size}")) / cell))
    return _named(boxes, name).withColumn(f"{name}_cx", F.explode(cells("x", "w"))).withColumn(f"{name}_cy", F.explode(cells("y", "h")))


def overlap_join(a: DataFrame, b: DataFrame, cell: float = CELL) -> DataFrame:
    """Pairs of boxes that intersect on their page: all columns as a_* and b_*."""
    ga, gb = _gridded(a, "a", cell), _gridded(b, "b", cell)
    joined = ga.join(gb, (ga["a_page"] == gb["b_page"]) & (ga["a_cx"] == gb["b_cx"]) & (ga["a_cy"] == gb["b_cy"])).filter(intersects())
    first = (F.col("a_cx") == F.floor(F.greatest("a_x", "b_x") / cell)) & (F.col("a_cy") == F.floor(F.greatest("a_y", "b_y") / cell))
    return joined.filter(first).drop("a_cx", "a_cy", "b_cx", "b_cy")


def union_box(boxes: DataFrame, *by: str) -> DataFrame:
    return boxes.groupBy(*by).agg(F.min("x").alias("x"), F.min("y").alias("y"), (F.max(F.col("x") + F.col("w")) - F.min("x")).alias("w"), (F.max(F.col("y") + F.col("h")) - F.min("y")).alias("h"))


def nearest(a: DataFrame, b: DataFrame, cell: float = CELL, few: int = 500) -> DataFrame:
    """For each box of a, the box of b on its page with the least L1 distance of corners and sizes (ties: smallest id).

    Where no page has more than ``few`` boxes of b, each box is compared with those of its page. Else boxes meet in grid cells of their corners, first with the eight cells around, and those that found nothing as near as the
    cells reach in rings of twice the width, again and again, until the rings reach over the widest page.
    """
    away = sum((F.abs(F.col(f"a_{c}") - F.col(f"b_{c}")) for c in ("x", "y", "w", "h")), F.lit(0.0))
    closest = lambda met: met.groupBy("a_id").agg(F.min(F.struct(F.round(away, 6).alias("d"), F.col("b_id").alias("id"))).alias("m")).select("a_id", F.col("m.id").alias("b_id"), F.col("m.d").alias("distance"))
    if (b.groupBy("page").count().agg(F.max("count")).first()[0] or 0) <= few:
        # a page's boxes of b are one row, so its pairs are never rows to be sorted
        there = _named(b, "b").groupBy("b_page").agg(F.collect_list(F.struct("b_id", *[f"b_{c}" for c in ("x", "y", "w", "h")])).alias("bs"))
        far = lambda t: F.struct(F.round(sum((F.abs(F.col(f"a_{c}") - t[f"b_{c}"]) for c in ("x", "y", "w", "h")), F.lit(0.0)), 6).alias("d"), t["b_id"].alias("id"))
        met = _named(a, "a").join(there, F.col("a_page") == F.col("b_page")).select("a_id", F.array_min(F.transform("bs", far)).alias("m"))
        return met.select("a_id", F.col("m.id").alias("b_id"), F.col("m.d").alias("distance"))
    at = lambda n, c: F.floor(F.col(f"{n}_{c}") / cell)
    there = _named(b, "b").withColumns({"b_cx": at("b", "x"), "b_cy": at("b", "y")})
    pending = _named(a, "a").withColumns({"a_cx": at("a", "x"), "a_cy": at("a", "y")})
    ends = [f(at(n, c)) for n, c, f in (("b", "x", F.min), ("b", "x", F.max), ("b", "y", F.min), ("b", "y", F.max))]
    mine = [f(at(n, c)) for n, c, f in (("a", "x", F.min), ("a", "x", F.max), ("a", "y", F.min), ("a", "y", F.max))]
    bounds, own = there.agg(*ends).first(), pending.agg(*mine).first()
    found, reach, most = [], 1, -1
    if bounds[0] is not None and own[0] is not None:
        most = max(bounds[1] - own[0], own[1] - bounds[0], bounds[3] - own[2], own[3] - bounds[2], 1)
    while most > 0:
        ring = lambda c: F.explode(F.sequence(F.col(c) - reach, F.col(c) + reach))  # noqa: E731, B023
        spread = pending.select("a_id", "a_page", "a_x", "a_y", "a_w", "a_h", "a_cy", ring("a_cx").alias("cx")).withColumn("cy", ring("a_cy"))
        met = spread.join(there, (F.col("a_page") == F.col("b_page")) & (F.col("cx") == F.col("b_cx")) & (F.col("cy") == F.col("b_cy")))
        near = staged(closest(met).filter(F.lit(reach >= most) | (F.col("distance") <= reach * cell)))
        found.append(near)
        if reach >= most:
            break
        pending = staged(pending.join(near, "a_id", "left_anti"))
        if pending.isEmpty():
            break
        reach *= 2
    if not found:
        return _named(a, "a").select("a_id").limit(0).withColumns({"b_id": F.lit(None).cast(b.schema["id"].dataType), "distance": F.lit(None).cast("double")})
    return functools.reduce(DataFrame.unionByName, found)


def coverage(targets: DataFrame, images: DataFrame) -> DataFrame:
    """Share of each target that images cover, at most 1."""
    hit = overlap_join(targets, images)
    side = lambda lo, size: F.least(F.col(f"a_{lo}") + F.col(f"a_{size}"), F.col(f"b_{lo}") + F.col(f"b_{size}")) - F.greatest(f"a_{lo}", f"b_{lo}")
    area = F.sum(side("x", "w") * side("y", "h") / (F.col("a_w") * F.col("a_h")))
    return hit.groupBy("a_id").agg(F.least(F.lit(1.0), F.round(area, 6)).alias("coverage"))


def chrome(blocks: DataFrame, height: float, band: float = 0.13, grid: float = 6.0) -> DataFrame:
    """Blocks with ``repeated``: whether a block of that type and place (to the grid) is in the top or bottom band of two pages."""
    at_edge = F.coalesce((F.col("y") + F.col("h") <= band * height) | (F.col("y") >= (1 - band) * height), F.lit(False))
    place = F.struct("kind", *[F.round(F.col(c) / grid).alias(c) for c in ("x", "y", "w", "h")])
    own = blocks.withColumns({"_edge": at_edge, "_place": place})
    found = staged(own.filter("_edge").groupBy("_place").count().filter("count > 1").select("_place", F.lit(True).alias("_twice")))
    found = F.broadcast(found) if found.count() <= 200_000 else found
    return own.join(found, "_place", "left").withColumn("repeated", F.col("_edge") & F.coalesce("_twice", F.lit(False))).select(*blocks.columns, "repeated")


def clusters(items: DataFrame, gap: float = 50.0) -> DataFrame:
    """Number of the vertical cluster on the page: a new one where y jumps by more than the gap."""
    w = W.partitionBy("page").orderBy("y", "id")
    jump = F.coalesce((F.col("y") - F.lag("y").over(w) > gap).cast("int"), F.lit(0))
    return items.withColumn("_jump", jump).withColumn("cluster", F.sum("_jump").over(w)).drop("_jump")


def islands(rows: DataFrame, by: str, order: str, joins: Column) -> DataFrame:
    """Number of the group of consecutive rows: a new one wherever ``joins`` doesn't hold."""
    w = W.partitionBy(by).orderBy(order)
    return rows.withColumn("_new", (~F.coalesce(joins, F.lit(False))).cast("int")).withColumn("island", F.sum("_new").over(w)).drop("_new")


def lines(words: DataFrame) -> DataFrame:
    """Words packed into lines by rounded top and bottom: page, top, line text in order of x."""
    packed = words.groupBy("page", F.round("y").alias("top"), F.round(F.col("y") + F.col("h")).alias("bottom")).agg(F.array_sort(F.collect_list(F.struct("x", "id", "text"))).alias("ws"))
    return packed.select("page", "top", "bottom", F.array_join(F.transform("ws", lambda s: s["text"]), " ").alias("line"))


def boundary_sample(rows: DataFrame, by: str, order: str, edge: int = 3) -> DataFrame:
    """All rows of a group of up to twice ``edge``, else its first and last ``edge``."""
    up, down = W.partitionBy(by).orderBy(F.asc(order)), W.partitionBy(by).orderBy(F.desc(order))
    return rows.withColumn("_u", F.row_number().over(up)).withColumn("_d", F.row_number().over(down)).filter((F.col("_u") <= edge) | (F.col("_d") <= edge)).drop("_u", "_d")


def compare_rows(sample: DataFrame, parsed: DataFrame, key: str, cells: str, threshold: float = 0.8) -> DataFrame:
    """Cells of the sample that the parsed rows miss or hold less than ``threshold`` alike (longest common subsequence)."""
    both = sample.select(key, F.col(cells).alias("want")).join(parsed.select(key, F.col(cells).alias("have")), key, "left")
    each = both.select(key, F.posexplode(F.arrays_zip("want", F.coalesce("have", F.array().cast("array<string>")).alias("have")))).select(key, F.col("pos").alias("column"), T.collapse_spaces(F.coalesce("col.want", F.lit(""))).alias("want"), T.collapse_spaces(F.coalesce("col.have", F.lit(""))).alias("have"))
    return each.withColumn("similarity", F.round(T.lcs_similarity("want", "have"), 6)).filter(F.col("similarity") < threshold)


def compare_exact(sample: DataFrame, parsed: DataFrame, key: str, cells: str) -> DataFrame:
    """Rows whose cells differ, and in which columns."""
    both = sample.select(key, F.col(cells).alias("want")).join(parsed.select(key, F.col(cells).alias("have")), key, "full_outer")
    changed = F.filter(F.transform(F.arrays_zip(F.coalesce("want", F.array().cast("array<string>")).alias("w"), F.coalesce("have", F.array().cast("array<string>")).alias("h")), lambda z, i: F.when(~z["w"].eqNullSafe(z["h"]), i)), lambda i: i.isNotNull())
    return both.withColumn("changed", changed).filter(F.size("changed") > 0)


def leakage(rows: DataFrame, by: str, order: str, cell: str) -> DataFrame:
    """Rows whose cell ends with the cell of the next row: text that ran over."""
    nxt = F.lead(cell).over(W.partitionBy(by).orderBy(order))
    return rows.withColumn("_next", nxt).filter((F.length("_next") > 0) & F.col(cell).endswith(F.col("_next"))).drop("_next")


def last_before(rows: DataFrame, by: str, order: str, value: str, within: int) -> Column:
    """The last non-null value of the ``within`` rows before: a bounded look-back."""
    return F.last(value, ignorenulls=True).over(W.partitionBy(by).orderBy(order).rowsBetween(-within, -1))


_HIT = "a.page = b.page AND a.x < b.x + b.w AND b.x < a.x + a.w AND a.y < b.y + b.h AND b.y < a.y + a.h"


def _lines(s, d):
    """All order lines, with an id and a page of 20 order keys; order and line number alone repeat in the test tables. Rows are dealt by page."""
    same = W.partitionBy("page", "l_orderkey", "l_linenumber").orderBy("l_partkey", "l_suppkey", "l_quantity", "l_returnflag", "l_linestatus")
    return dealt(table(s, d, "lineitem").withColumn("page", F.expr("l_orderkey DIV 20")), "page").withColumn("id", (F.col("l_orderkey") * 10 + F.col("l_linenumber")) * 100 + F.row_number().over(same))


def _boxes(s, d, kind=None):
    """Deterministic boxes from order lines, 20 order keys to a page: more orders are more pages, not larger ones."""
    out = _lines(s, d).select("id", "page", (F.col("l_partkey") * 37 % 500).cast("double").alias("x"), (F.col("l_suppkey") * 53 % 760).cast("double").alias("y"), (F.col("l_quantity") * 3).alias("w"), (F.col("l_linenumber") * 5.0).cast("double").alias("h"), F.col("l_returnflag").alias("kind"), F.col("l_linestatus").alias("text"))
    return out if kind is None else out.filter(F.col("kind") == kind)


_LINES = "SELECT *, (l_orderkey * 10 + l_linenumber) * 100 + row_number() OVER (PARTITION BY l_orderkey, l_linenumber ORDER BY l_partkey, l_suppkey, l_quantity, l_returnflag, l_linestatus) AS id FROM lineitem"
_BOX = f"SELECT id, l_orderkey // 20 AS page, CAST(l_partkey * 37 % 500 AS DOUBLE) AS x, CAST(l_suppkey * 53 % 760 AS DOUBLE) AS y, l_quantity * 3 AS w, l_linenumber * 5.0::DOUBLE AS h, l_returnflag AS kind, l_linestatus AS text FROM ({_LINES})"


def _cells(s, d, edited):
    flag = F.when((F.col("l_orderkey") % 11 == 0) & F.lit(edited), F.lit("changed")).otherwise(F.col("l_returnflag"))
    return _lines(s, d).select(F.col("id").alias("row"), F.array(F.col("l_quantity").cast("int").cast("string"), flag, F.col("l_linestatus")).alias("cells"))


def _of_boxes(boxes, cells, box):
    """The queries over boxes and cells, and their SQL over the same boxes."""
    return {
        "bbox_overlap": (lambda s, d: overlap_join(boxes(s, d, "A"), boxes(s, d, "R")).select("a_id", "b_id"), f"SELECT a.id AS a_id, b.id AS b_id FROM ({box}) a JOIN ({box}) b ON {_HIT} AND a.kind = 'A' AND b.kind = 'R'"),
        "bbox_centre_in": (
            lambda s, d: overlap_join(boxes(s, d, "A"), boxes(s, d, "N")).filter(centre_in()).select("a_id").distinct(),
            f"SELECT DISTINCT a.id AS a_id FROM ({box}) a JOIN ({box}) b ON {_HIT} AND a.kind = 'A' AND b.kind = 'N' AND a.x + a.w / 2 BETWEEN b.x AND b.x + b.w AND a.y + a.h / 2 BETWEEN b.y AND b.y + b.h",
        ),
        "union_bbox": (lambda s, d: union_box(boxes(s, d), "page", "kind"), f"SELECT page, kind, min(x) AS x, min(y) AS y, max(x + w) - min(x) AS w, max(y + h) - min(y) AS h FROM ({box}) GROUP BY page, kind"),
        "bbox_expand": (lambda s, d: expand(boxes(s, d), 14.0, 595.0, 842.0).select("id", "x", "y", "w", "h"), f"SELECT id, greatest(x - 14, 0) AS x, greatest(y - 14, 0) AS y, least(x + w + 14, 595) - greatest(x - 14, 0) AS w, least(y + h + 14, 842) - greatest(y - 14, 0) AS h FROM ({box})"),
        "nearest_box": (
            lambda s, d: nearest(boxes(s, d, "A"), boxes(s, d, "R")),
            f"SELECT a_id, b_id, distance FROM (SELECT a.id AS a_id, b.id AS b_id, round(abs(a.x - b.x) + abs(a.y - b.y) + abs(a.w - b.w) + abs(a.h - b.h), 6) AS distance, row_number() OVER (PARTITION BY a.id ORDER BY round(abs(a.x - b.x) + abs(a.y - b.y) + abs(a.w - b.w) + abs(a.h - b.h), 6), b.id) AS n FROM ({box}) a JOIN ({box}) b ON a.page = b.page AND a.kind = 'A' AND b.kind = 'R') WHERE n = 1",
        ),
        "image_coverage": (
            lambda s, d: coverage(boxes(s, d, "A"), boxes(s, d, "R")),
            f"SELECT a.id AS a_id, least(1.0, round(sum((least(a.x + a.w, b.x + b.w) - greatest(a.x, b.x)) * (least(a.y + a.h, b.y + b.h) - greatest(a.y, b.y)) / (a.w * a.h)), 6)) AS coverage FROM ({box}) a JOIN ({box}) b ON {_HIT} AND a.kind = 'A' AND b.kind = 'R' GROUP BY a.id",
        ),
        "page_chrome": (
            lambda s, d: chrome(boxes(s, d), 842.0).filter("repeated").select("id"),
            f"SELECT id FROM (SELECT *, count(*) OVER (PARTITION BY kind, round(x / 6), round(y / 6), round(w / 6), round(h / 6)) AS n FROM ({box}) WHERE y + h <= 0.13 * 842 OR y >= 0.87 * 842) WHERE n >= 2",
        ),
        "y_clusters": (
            lambda s, d: clusters(boxes(s, d, "R"), 20.0).select("id", "cluster"),
            f"SELECT id, CAST(sum(j) OVER (PARTITION BY page ORDER BY y, id ROWS UNBOUNDED PRECEDING) AS BIGINT) AS cluster FROM (SELECT *, CASE WHEN y - lag(y) OVER (PARTITION BY page ORDER BY y, id) > 20 THEN 1 ELSE 0 END AS j FROM ({box}) WHERE kind = 'R')",
        ),
        "line_pack": (
            lambda s, d: lines(boxes(s, d)),
            f"SELECT page, round(y) AS top, round(y + h) AS bottom, string_agg(text, ' ' ORDER BY x, id) AS line FROM ({box}) GROUP BY page, round(y), round(y + h)",
        ),
        "row_compare_exact": (lambda s, d: compare_exact(cells(s, d, False), cells(s, d, True), "row", "cells").select("row", F.array_join(F.transform("changed", lambda x: x.cast("string")), ",").alias("changed")), None),
        "row_compare_lcs": (lambda s, d: compare_rows(cells(s, d, False), cells(s, d, True), "row", "cells"), None),
    }


QUERIES = _of_boxes(_boxes, _cells, _BOX) | {
    "boundary_sample": (
        lambda s, d: boundary_sample(table(s, d, "orders"), "o_custkey", "o_orderkey").select("o_orderkey"),
        "SELECT o_orderkey FROM (SELECT o_orderkey, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) AS u, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey DESC) AS d FROM orders) WHERE u <= 3 OR d <= 3",
    ),
    "row_leakage": (
        lambda s, d: leakage(table(s, d, "orders").withColumn("c", F.concat(F.col("o_orderpriority"), F.col("o_orderstatus"))).withColumn("c", F.when(F.col("o_orderkey") % 2 == 0, F.col("o_orderstatus")).otherwise(F.col("c"))), "o_custkey", "o_orderkey", "c").select("o_orderkey"),
        "SELECT o_orderkey FROM (SELECT *, lead(c) OVER (PARTITION BY o_custkey ORDER BY o_orderkey) AS n FROM (SELECT *, CASE WHEN o_orderkey % 2 = 0 THEN o_orderstatus ELSE o_orderpriority || o_orderstatus END AS c FROM orders)) WHERE length(n) > 0 AND ends_with(c, n)",
    ),
    "merge_groups": (
        lambda s, d: islands(table(s, d, "orders"), "o_custkey", "o_orderkey", F.col("o_orderstatus") == "F").select("o_orderkey", "island"),
        "SELECT o_orderkey, CAST(sum(CASE WHEN o_orderstatus = 'F' THEN 0 ELSE 1 END) OVER (PARTITION BY o_custkey ORDER BY o_orderkey ROWS UNBOUNDED PRECEDING) AS BIGINT) AS island FROM orders",
    ),
    "title_look_back": (
        lambda s, d: (lambda o: o.select("o_orderkey", last_before(o, "o_custkey", "o_orderkey", "urgent", 4).alias("title")))(table(s, d, "orders").withColumn("urgent", F.when(F.col("o_orderpriority").startswith("1"), F.col("o_orderdate").cast("string")))),
        "SELECT o_orderkey, CAST(last_value(u IGNORE NULLS) OVER (PARTITION BY o_custkey ORDER BY o_orderkey ROWS BETWEEN 4 PRECEDING AND 1 PRECEDING) AS VARCHAR) AS title FROM (SELECT *, CASE WHEN starts_with(o_orderpriority, '1') THEN o_orderdate END AS u FROM orders)",
    ),
}
QUERIES["row_compare_exact"] = (QUERIES["row_compare_exact"][0], f"SELECT id AS row, '1' AS changed FROM ({_LINES}) WHERE l_orderkey % 11 = 0")
QUERIES["row_compare_lcs"] = (QUERIES["row_compare_lcs"][0], f"SELECT id AS row, 1 AS column, l_returnflag AS want, 'changed' AS have, 0.0 AS similarity FROM ({_LINES}) WHERE l_orderkey % 11 = 0")


def line_intersects(line: str = "a", box: str = "b") -> Column:
    """A line (x1, y1, x2, y2) touches a box (x, y, w, h), edges included: by its own bounds."""
    c = lambda t, x: F.col(f"{t}_{x}")
    low, high = (lambda d: F.least(c(line, f"{d}1"), c(line, f"{d}2"))), (lambda d: F.greatest(c(line, f"{d}1"), c(line, f"{d}2")))
    side = lambda d, size: (low(d) <= c(box, d) + c(box, size)) & (high(d) >= c(box, d))
    return side("x", "w") & side("y", "h")


def lines_in(lines_: DataFrame, boxes: DataFrame, cell: float = CELL) -> DataFrame:
    """Pairs (line, box) of lines (id, page, x1, y1, x2, y2) and boxes that touch: the boxes of the lines' bounds meet the others
    in grid cells, and each pair is told once."""
    span = lambda a, b: F.sequence(F.floor(a / cell), F.floor(b / cell))
    la = lines_.select(*[F.col(c).alias(f"a_{c}") for c in ("id", "page", "x1", "y1", "x2", "y2")])
    la = la.withColumn("cx", F.explode(span(F.least("a_x1", "a_x2"), F.greatest("a_x1", "a_x2")))).withColumn("cy", F.explode(span(F.least("a_y1", "a_y2"), F.greatest("a_y1", "a_y2"))))
    lb = _named(boxes, "b").withColumn("cx", F.explode(span(F.col("b_x"), F.col("b_x") + F.col("b_w")))).withColumn("cy", F.explode(span(F.col("b_y"), F.col("b_y") + F.col("b_h"))))
    first = (F.col("cx") == F.floor(F.greatest(F.least("a_x1", "a_x2"), "b_x") / cell)) & (F.col("cy") == F.floor(F.greatest(F.least("a_y1", "a_y2"), "b_y") / cell))
    joined = la.join(lb.withColumnsRenamed({"cx": "dx", "cy": "dy"}), (F.col("a_page") == F.col("b_page")) & (F.col("cx") == F.col("dx")) & (F.col("cy") == F.col("dy")))
    return joined.filter(line_intersects() & first).select(F.col("a_id").alias("line"), F.col("b_id").alias("box"))


def positional(struct: Column, fields: list[str]) -> Column:
    """A record as an array of its fields' values in a fixed order, as text; null where it has none."""
    return F.array(*[struct[f].cast("string") for f in fields])


def scoped(items: DataFrame, scopes: DataFrame, fields: list[str], version: str) -> DataFrame:
    """Per scope (id, page, x, y, w, h), the items of its page that meet it as positional records in order of id, and a revision:
    the SHA-256 of version, scope and records. A scope is a region of one page, so its records are one list."""
    hit = overlap_join(items, scopes).select(F.col("a_id").alias("id"), F.col("b_id").alias("scope"))
    records = items.select("id", positional(F.struct(*fields), fields).alias("record"))
    own = hit.join(records, "id").groupBy("scope").agg(F.array_sort(F.collect_list(F.struct("id", "record"))).alias("r"))
    both = scopes.select(F.col("id").alias("scope"), "page", "x", "y", "w", "h").join(own, "scope", "left")
    listed = F.coalesce(F.transform("r", lambda x: x["record"]), F.array().cast("array<array<string>>"))
    place = F.concat_ws(",", *[F.col(c).cast("string") for c in ("page", "x", "y", "w", "h")])
    told = F.concat_ws("\n", F.lit(version), place, F.array_join(F.transform(listed, lambda x: F.array_join(x, ",", "")), "\n"))
    return both.select("scope", listed.alias("records"), F.sha2(told, 256).alias("revision"))


def evidence_segments(segments: DataFrame, full: Column) -> DataFrame:
    """Segments (table, pos) that are shown: all of a table where ``full`` holds, else its first and last."""
    up, down = W.partitionBy("table").orderBy("pos"), W.partitionBy("table").orderBy(F.desc("pos"))
    return segments.withColumn("_u", F.row_number().over(up)).withColumn("_d", F.row_number().over(down)).filter(full | (F.col("_u") == 1) | (F.col("_d") == 1)).drop("_u", "_d")


def large_enough(width: float, height: float, share: float = 0.05) -> Column:
    """Images of at least a share of the page's area."""
    return F.abs(F.col("w") * F.col("h")) / (width * height) >= share


def table_signals(runs: Column, ruled: Column, vector_lines: Column, most_runs: int = 3, most_lines: int = 80) -> Column:
    """Reasons to look for tables on a page: direct ones (many runs of aligned text, many lines) and weak ones (any at all)."""
    runs, ruled, vector_lines = (F.coalesce(c, F.lit(0)) for c in (runs, ruled, vector_lines))
    return F.array_compact(
        F.array(
            F.when(runs >= most_runs, F.lit("direct: text runs")),
            F.when(vector_lines >= most_lines, F.lit("direct: vector lines")),
            F.when(ruled > 0, F.lit("weak: ruled table")),
            F.when((runs > 0) & (runs < most_runs), F.lit("weak: text run")),
        )
    )


def needs_agent(kind: Column, ignored: Column) -> Column:
    """Blocks whose content rules can't read off: tables, figures, and grids found as a last resort."""
    return kind.isin("table", "figure", "grid_fallback") & ~F.coalesce(ignored, F.lit(False))


def words_in_images(words: DataFrame, images: DataFrame, targets: DataFrame) -> DataFrame:
    """Words (id) whose centre is both in an image and in a target of their page."""
    inside = lambda boxes: overlap_join(words, boxes).filter(centre_in()).select(F.col("a_id").alias("id")).distinct()
    return inside(images).join(inside(targets), "id", "left_semi")


def located(items: DataFrame, values: DataFrame, width: float, height: float, gap: float = 50.0, margin: float = 14.0) -> DataFrame:
    """Where the cell values (page, value) of a page's table stand among its text items (id, page, x, y, w, h, text): the box of
    the largest cluster of matching items, wider by the margin, on the page. Pages with fewer than three matches, or whose
    cluster has fewer different values than two or a quarter of all, have none. Ties: the uppermost cluster. A page's values are one
    row, so every step is by page, and items and values that are dealt by page stay where they are."""
    cell = lambda c: T.collapse_spaces(F.lower(F.regexp_replace(c, "[*_`]+", "")))
    wanted = values.select("page", cell(F.col("value")).alias("value")).filter("value <> ''").groupBy("page").agg(F.collect_set("value").alias("values"))
    matched = items.withColumn("value", cell(F.col("text"))).join(wanted, "page").filter(F.array_contains("values", F.col("value"))).withColumn("total", F.size("values")).drop("values")
    matched = matched.withColumn("_all", F.count(F.lit(1)).over(W.partitionBy("page"))).filter("_all >= 3")
    per = clusters(matched, gap).groupBy("page", "cluster").agg(F.first("total").alias("total"), F.count(F.lit(1)).alias("n"), F.count_distinct("value").alias("own"), F.min("x").alias("x0"), F.min("y").alias("y0"), F.max(F.col("x") + F.col("w")).alias("x1"), F.max(F.col("y") + F.col("h")).alias("y1"))
    best = per.groupBy("page").agg(F.max_by(F.struct("own", "total", "x0", "y0", "x1", "y1"), F.struct("n", -F.col("cluster"))).alias("b")).select("page", "b.*")
    enough = best.filter(F.col("own") >= F.greatest(F.lit(2.0), F.bround(F.col("total") * 0.25)))
    return enough.select("page", F.greatest(F.lit(0.0), F.col("x0") - margin).alias("x0"), F.greatest(F.lit(0.0), F.col("y0") - margin).alias("y0"), F.least(F.lit(width), F.col("x1") + margin).alias("x1"), F.least(F.lit(height), F.col("y1") + margin).alias("y1"))


def _strokes(s, d):
    return _boxes(s, d, "A").select("id", "page", F.col("x").alias("x1"), (F.col("y") + F.col("h")).alias("y1"), (F.col("x") + F.col("w")).alias("x2"), F.col("y").alias("y2"))


_PAIRS = f"SELECT a.id AS a, b.id AS b, a.x AS ax, a.y AS ay, a.w AS aw, a.h AS ah, b.kind AS kind, a.x + a.w / 2 BETWEEN b.x AND b.x + b.w AND a.y + a.h / 2 BETWEEN b.y AND b.y + b.h AS centre FROM ({_BOX}) a JOIN ({_BOX}) b ON {_HIT} AND a.kind = 'A'"

QUERIES |= {
    "line_intersects": (
        lambda s, d: lines_in(_strokes(s, d), _boxes(s, d, "R")),
        f"SELECT a.id AS line, b.id AS box FROM ({_BOX}) a JOIN ({_BOX}) b ON a.page = b.page AND a.kind = 'A' AND b.kind = 'R' AND a.x <= b.x + b.w AND a.x + a.w >= b.x AND a.y <= b.y + b.h AND a.y + a.h >= b.y",
    ),
    "scoped_geometry": (
        lambda s, d: scoped(_boxes(s, d, "A"), _boxes(s, d, "R"), ["id", "kind"], "v1").select("scope", F.size("records").alias("n"), "revision"),
        f"SELECT id AS scope, count(a) AS n, sha256('v1' || chr(10) || any_value(p) || chr(10) || coalesce(string_agg(a || ',A', chr(10) ORDER BY a), '')) AS revision FROM (SELECT id, page || ',' || x || ',' || y || ',' || w || ',' || h AS p FROM ({_BOX}) WHERE kind = 'R') LEFT JOIN (SELECT a, b FROM ({_PAIRS}) WHERE kind = 'R') ON b = id GROUP BY id",
    ),
    "positional_records": (
        lambda s, d: table(s, d, "part").select("p_partkey", F.array_join(positional(F.struct("p_brand", "p_size"), ["p_size", "p_brand"]), "|").alias("record")),
        "SELECT p_partkey, p_size || '|' || p_brand AS record FROM part",
    ),
    "evidence_segments": (
        lambda s, d: evidence_segments(table(s, d, "orders").select(F.col("o_custkey").alias("table"), F.col("o_orderkey").alias("pos")), F.col("table") % 5 == 0),
        'SELECT t AS "table", pos FROM (SELECT o_custkey AS t, o_orderkey AS pos, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) AS u, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey DESC) AS d FROM orders) WHERE t % 5 = 0 OR u = 1 OR d = 1',
    ),
    "image_area": (lambda s, d: _boxes(s, d).filter(large_enough(200.0, 100.0)).select("id"), f"SELECT id FROM ({_BOX}) WHERE w * h / 20000 >= 0.05"),
    "table_signals": (
        lambda s, d: table(s, d, "part").select("p_partkey", F.array_join(table_signals(F.col("p_partkey") % 5, F.col("p_partkey") % 3, F.col("p_size") * 2), ",").alias("reasons")),
        "SELECT p_partkey, concat_ws(',', CASE WHEN p_partkey % 5 >= 3 THEN 'direct: text runs' END, CASE WHEN p_size * 2 >= 80 THEN 'direct: vector lines' END, CASE WHEN p_partkey % 3 > 0 THEN 'weak: ruled table' END, CASE WHEN p_partkey % 5 IN (1, 2) THEN 'weak: text run' END) AS reasons FROM part",
    ),
    "needs_agent": (
        lambda s, d: table(s, d, "part").filter(needs_agent(F.element_at(F.array(*map(F.lit, ("text", "table", "figure", "grid_fallback"))), (F.col("p_partkey") % 4 + 1).cast("int")), F.col("p_size") > 25)).select("p_partkey"),
        "SELECT p_partkey FROM part WHERE p_partkey % 4 > 0 AND p_size <= 25",
    ),
    "words_in_images": (
        lambda s, d: words_in_images(_boxes(s, d, "A"), _boxes(s, d, "R"), _boxes(s, d, "N")),
        f"SELECT a AS id FROM ({_PAIRS}) WHERE centre GROUP BY a HAVING bool_or(kind = 'R') AND bool_or(kind = 'N')",
    ),
    "located_tables": (
        lambda s, d: located(_boxes(s, d), _boxes(s, d, "R").filter("id % 3 = 0").select("page", F.concat(F.lit("**"), F.upper("text"), F.lit("** ")).alias("value")).unionByName(_boxes(s, d, "R").filter("id % 7 = 0").select("page", F.lit("f").alias("value"))), 595.0, 842.0, 20.0),
        f"""WITH v AS (SELECT DISTINCT page, lower(text) AS value FROM ({_BOX}) WHERE kind = 'R' AND id % 3 = 0 UNION SELECT DISTINCT page, 'f' FROM ({_BOX}) WHERE kind = 'R' AND id % 7 = 0),
        m AS (SELECT b.*, v.value, count(*) OVER (PARTITION BY b.page) AS n FROM ({_BOX}) b JOIN v ON v.page = b.page AND v.value = lower(b.text)),
        j AS (SELECT *, CASE WHEN y - lag(y) OVER (PARTITION BY page ORDER BY y, id) > 20 THEN 1 ELSE 0 END AS j FROM m WHERE n >= 3),
        k AS (SELECT *, sum(j) OVER (PARTITION BY page ORDER BY y, id ROWS UNBOUNDED PRECEDING) AS c FROM j),
        p AS (SELECT page, c, count(*) AS n, count(DISTINCT value) AS own, min(x) AS x0, min(y) AS y0, max(x + w) AS x1, max(y + h) AS y1 FROM k GROUP BY page, c),
        b AS (SELECT *, row_number() OVER (PARTITION BY page ORDER BY n DESC, c) AS nth FROM p)
        SELECT page, greatest(0, x0 - 14) AS x0, greatest(0, y0 - 14) AS y0, least(595, x1 + 14) AS x1, least(842, y1 + 14) AS y1 FROM b WHERE nth = 1 AND own >= greatest(2, round_even((SELECT count(*) FROM v WHERE v.page = b.page) * 0.25, 0))""",
    ),
}
