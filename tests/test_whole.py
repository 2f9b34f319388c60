"""Queries over whole tables: their results reach rows that an id subset would lose."""

import os
import random
from pathlib import Path

import pytest

from paperstrata import registry
from paperstrata.operators import tree

SF = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.01")

pytestmark = pytest.mark.skipif(not Path(SF).is_dir(), reason="no test tables")
BOXES = "bbox_overlap bbox_centre_in union_bbox bbox_expand nearest_box image_coverage page_chrome y_clusters line_pack row_compare_exact row_compare_lcs".split()


@pytest.mark.parametrize("name", BOXES)
def test_boxes(spark, name):
    """Results go on to the last of the order keys, of which sf0.01 has far more than 2000."""
    df = registry.queries()[name](spark, SF)
    last = df.selectExpr(f"max({df.columns[0]})").first()[0]
    keys = last * 20 if df.columns[0] == "page" else last // 1000
    top = spark.read.parquet(f"{SF}/orders.parquet").selectExpr("max(o_orderkey)").first()[0]
    assert top > 2000 and keys > 0.95 * top


STATEMENTS = "tq_join_left tq_join_right tq_join_lateral tq_union_all tq_subquery_exists tq_unpivot tq_string_functions tq_date_functions tq_math_functions tq_struct_map_functions tq_json_functions".split()


@pytest.mark.parametrize("name", STATEMENTS)
def test_statements(spark, name):
    """No order is lost: as many rows as all orders give."""
    orders = spark.read.parquet(f"{SF}/orders.parquet")
    n, customers = orders.count(), orders.select("o_custkey").distinct().count()
    statuses = orders.groupBy("o_custkey").agg({"o_orderstatus": "approx_count_distinct"}).filter("`approx_count_distinct(o_orderstatus)` > 1").select("o_custkey")
    want = {"tq_union_all": 2 * n, "tq_unpivot": 2 * n, "tq_join_lateral": customers, "tq_subquery_exists": orders.join(statuses, "o_custkey", "left_semi").count()}
    df = registry.queries()[name](spark, SF)
    assert df.count() == want.get(name, n)


def paths(df):
    got = [r["path"] for r in df.collect()]
    assert len(got) == len(set(got))
    return set(got)


def test_deep_closure(spark):
    """A chain of 70 steps and a cycle, from one end, and both directions from its middle."""
    chain = spark.createDataFrame([(i, i + 1) for i in range(70)] + [(70, 68), (200, 201)], "path long, target long")
    seeds = lambda *ids: spark.createDataFrame([(i,) for i in ids], "path long")
    assert paths(tree.closure(chain, seeds(0, 999), both=False)) == {*range(71), 999}
    assert paths(tree.closure(chain, seeds(35))) == set(range(71))
    assert paths(tree.closure(chain, seeds(201))) == {200, 201}


def reaching(edges):
    out = {}
    for a, b in edges:
        out.setdefault(a, set()).add(b)
    for start in {x for e in edges for x in e}:
        seen, todo = set(), [start]
        while todo:
            for x in out.get(todo.pop(), ()):
                if x not in seen:
                    seen.add(x)
                    todo.append(x)
        if start in seen:
            yield start


def test_cycles(spark):
    """A cycle of 70 steps with tails; graphs of several targets a path against brute force."""
    long = [(i, (i + 1) % 70) for i in range(70)] + [(100, 101), (101, 5), (300, 300)]
    assert paths(tree.cycles(spark.createDataFrame(long, "path long, target long"))) == {*range(70), 300}
    rng = random.Random(3)
    for n in (25, 40):
        edges = [(rng.randrange(30), rng.randrange(30)) for _ in range(n)]
        assert paths(tree.cycles(spark.createDataFrame(edges, "path long, target long"))) == set(reaching(edges))


def test_whole_texts(spark):
    """Characters behind the 50th are escaped too."""
    import hashlib
    import html

    got = {r["doc_id"]: r for r in registry.queries()["text_functions"](spark, SF).collect()}
    docs = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").collect()
    assert len(got) == len(docs) and any(html.escape(r["text"][50:]) != r["text"][50:] for r in docs)
    for r in docs:
        assert got[r["doc_id"]]["html"] == hashlib.md5(html.escape(r["text"]).encode()).hexdigest()
