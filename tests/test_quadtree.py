"""Spatial joins over split cells against all pairs, and the size of leaves on one page of 100,000 boxes."""

import random

from pyspark.sql import functions as F

from paperstrata.operators import layout, quadtree

SCHEMA = "id long, page string, x double, y double, w double, h double, level int, a_id string"


def boxes(seed, n):
    rnd, out = random.Random(seed), []
    for i in range(n):
        near = rnd.random() < 0.6
        x, y = (rnd.gauss(100, 3), rnd.gauss(-40, 3)) if near else (rnd.uniform(-3000, 3000), rnd.uniform(-2000, 4000))
        w, h = rnd.choice([(0.0, 0.0), (rnd.random(), rnd.random()), (rnd.uniform(0, 900), 0.5), (8.0, rnd.uniform(0, 2500))])
        out.append((i, rnd.choice("pppq"), x, y, w, h, 7, "z"))
    out += [(n + i, "p", 512.0, 1024.0, 256.0, 128.0, None, None) for i in range(6)]  # on borders of cells, and repeated
    out += [(n + 9, None, 1.0, 1.0, 9.0, 9.0, 1, ""), (n + 10, "p", None, 1.0, 9.0, 9.0, 1, ""), (n + 11, "p", 1.0, 1.0, -2.0, 9.0, 1, "")]
    return out


def test_pairs_are_all_pairs(spark):
    one, two = boxes(1, 500), boxes(2, 400)
    sound = lambda rows: [r for r in rows if None not in r[1:6] and r[4] >= 0]
    want = sorted((a[0], b[0]) for a in sound(one) for b in sound(two) if a[1] == b[1] and a[2] < b[2] + b[4] and b[2] < a[2] + a[4] and a[3] < b[3] + b[5] and b[3] < a[3] + a[5])
    a, b = (spark.createDataFrame(rows, SCHEMA) for rows in (one, two))
    for limit, one_in in ((8, 1), (60, 2), (10**9, 16)):
        got = quadtree.overlap_join(a, b, limit, one_in).select("a_id", "b_id").collect()
        assert sorted(map(tuple, got)) == want
    assert quadtree.overlap_join(a, b.limit(0)).collect() == [] and quadtree.overlap_join(a.limit(0), b).columns[0] == "a_id"


def test_leaves_of_a_dense_page(spark):
    """100,000 small boxes on one page, half of them in a corner of a ten-thousandth of its area."""
    part = F.when(F.col("id") % 2 == 0, 10.0).otherwise(1000.0)
    page = spark.range(100_000).select("id", F.lit(1).alias("page"), (F.rand(3) * part).alias("x"), (F.rand(4) * part).alias("y"), F.lit(0.02).alias("w"), F.lit(0.02).alias("h"))
    rows, _ = quadtree.partitioned(page, page.limit(0))
    sizes = rows.groupBy("a_page", "level", "cx", "cy").count().agg(F.max("count"), F.sum("count"), F.count(F.lit(1))).first()
    assert sizes[0] <= 2 * quadtree.LIMIT and sizes[1] < 120_000 and sizes[2] > 100
    assert layout._gridded(page, "a", layout.CELL).groupBy("a_cx", "a_cy").count().agg(F.max("count")).first()[0] > 40_000
