"""Literal expectations of single operators."""

import zipfile

import pytest
from pyspark.sql import functions as F

from paperstrata.functions import text as T
from paperstrata.operators import chunk, evaluate, layout, profile, search, tree, versions
from paperstrata.plans import table_query
from paperstrata.sources import files, sinks
from paperstrata.streaming.ingest import ingest


def test_profile(spark):
    df = spark.createDataFrame([("a", "1"), ("b", ""), ("c", "3")], "name string, value string")
    got = {r["name"]: r for r in profile.profile(df).collect()}
    assert (got["name"]["type"], got["name"]["non_empty"], got["name"]["distinct"]) == ("string", 3, 3)
    v = got["value"]
    assert (v["type"], v["missing"], v["missing_rate"], v["distinct"], v["min"], v["max"]) == ("integer", 1, 0.333333, 2, 1.0, 3.0)
    odd = spark.createDataFrame([("007", "1,5")], "a string, b string")
    assert {r["name"]: r["type"] for r in profile.infer_types(odd).collect()} == {"a": "decimal", "b": "decimal"}


def test_sections_tables_chunks(spark):
    got = chunk.sections_of("# Report\n## Scope\nx\n## Data\ny\n")
    assert [p for p, _ in got] == [["Report"], ["Report", "Scope"], ["Report", "Data"]]
    assert chunk.tables_of("t\n| a | b |\n|---|:-:|\n| A\\|B | 2 |\n| odd |\n") == [[["a", "b"], ["A|B", "2"]]]
    assert chunk.header_names(["a", "", "a"]) == ["a", "Column 2", "a (2)"]
    parts = chunk.chunk_lines("one two three\n\nfour five\n\nfeeds 160 MW", 5, 1)
    assert parts[0] == ("one two three\n\nfour five", 1, 3) and parts[1] == ("four five\n\nfeeds 160 MW", 3, 5)
    assert chunk.chunk_lines("") == [("", 1, 1)]
    pieces = chunk.split_section("a b. " * 500, 100)
    assert all(len(p.split()) <= 100 for p in pieces) and " ".join(pieces).split() == ("a b. " * 500).split()
    nodes = spark.createDataFrame([("n", "t", "x\n\ny")], "id string, title string, body string")
    rows = spark.createDataFrame([("n", 1, "v")], "id string, row_number int, c string")
    assert [r["unit_id"] for r in chunk.units(nodes, rows, ["c"]).orderBy("unit_id").collect()] == ["n:card:1", "n:content_text:1", "n:table_row:1"]


def test_text(spark):
    df = spark.createDataFrame([("Größe: A & B!", "co-\nop", "160 MW", "160 MV")], "a string, b string, c string, d string")
    r = df.select(T.slug("a"), T.compatible("b"), T.lcs_similarity("c", "d"), T.split_pipe_row(F.lit("| x\\|y | z |")), T.uuid5(F.lit("6ba7b810-9dad-11d1-80b4-00c04fd430c8"), F.lit("x"))).first()
    assert r[0] == "grosse-a-b" and r[1] == "coop" and r[2] == pytest.approx(5 / 6) and r[3] == ["x|y", "z"] and len(r[4]) == 36
    assert T.lcs_ratio("", "") == 1 and T.lcs_ratio("a", "") == 0 and T.lcs_ratio("abcde", "ace") == 0.6


def test_search_options_and_bonus(spark):
    o = search.Options("q", cursor=None)
    cursor = search.encode_cursor("p1", o, 2)
    assert search.decode_cursor("p1", search.Options("q", cursor=cursor, limit=20)) == 2
    for bad in (("p2", search.Options("q", cursor=cursor)), ("p1", search.Options("other", cursor=cursor))):
        with pytest.raises(ValueError):
            search.decode_cursor(*bad)
    with pytest.raises(ValueError):
        search.Options(" ")
    hits = spark.createDataFrame([("a", 1, 1, None, 3.0), ("b", 2, 2, None, 1.0), ("c", 3, None, None, None)], "id string, original int, lexical_rank int, semantic_rank int, rerank_score double")
    got = {r["id"]: r for r in search.rerank_fuse(hits, "id", o).collect()}
    assert got["a"]["rerank_bonus"] == 0.0045 and got["b"]["rerank_bonus"] == 0 and got["c"]["score"] == pytest.approx(1 / 63) and got["c"]["rerank_rank"] is None


def test_metrics(spark):
    run = spark.createDataFrame([("q", f"d{i}", i) for i in range(1, 5)], "query string, id string, rank int")
    rel = spark.createDataFrame([("q", "d2"), ("q", "d4")], "query string, id string")
    r = evaluate.metrics(run, rel).first()
    from math import log2

    assert (r["recall"], r["mrr"]) == (1.0, 0.5) and r["ndcg"] == pytest.approx((1 / log2(3) + 1 / log2(5)) / (1 + 1 / log2(3)), abs=1e-6)


def test_guard(spark):
    load = lambda s: s.createDataFrame([(1, "x")], "a int, b string")
    assert table_query.first_rows(table_query.table_query(spark, load, "SELECT count(*) AS total FROM data;")) == {"columns": ["total"], "rows": [{"total": 1}], "truncated": False}
    for bad in ("DROP TABLE data", "SELECT ';' FROM data", "SELECT * FROM other", "WITH a AS (SELECT 1) INSERT INTO data SELECT * FROM a", "SELECT * FROM parquet.`/tmp/x`", "SELECT reflect('java.lang.System', 'exit') FROM data", "SELECT (SELECT max(a) FROM other) FROM data"):
        with pytest.raises(Exception):
            table_query.table_query(spark, load, bad).collect()


def test_versions(spark):
    schema = "id string, collection_id string, parent_id string, created_at int"
    v = spark.createDataFrame([("v1", "c", None, 1)], schema)
    two = versions.publish(v, {"id": "v2", "collection_id": "c", "parent_id": "v1", "created_at": 2})
    assert two.count() == 2 and versions.publish(two, {"id": "v2", "collection_id": "c", "parent_id": "v1", "created_at": 2}).count() == 2
    with pytest.raises(versions.StaleBase):
        versions.publish(two, {"id": "v3", "collection_id": "c", "parent_id": "v1", "created_at": 3})


def test_tree(spark):
    assert tree.page_list("7,1-3,2", 9) == [1, 2, 3, 7]
    with pytest.raises(ValueError):
        tree.page_list("8-12", 9)


def test_layout_helpers(spark):
    boxes = spark.createDataFrame([(1, 1, 0.0, 0.0, 250.0, 250.0)], "id int, page int, x double, y double, w double, h double")
    assert layout.overlap_join(boxes, boxes.withColumn("id", F.lit(2))).count() == 1


def test_files_and_streaming(spark, tmp_path):
    (tmp_path / "in").mkdir()
    (tmp_path / "in" / "a.csv").write_text("x,y\n1,2\n")
    (tmp_path / "in" / ".hidden").write_text("no")
    assert files.read_csv(spark, str(tmp_path / "in" / "a.csv")).collect() == [("1", "2")]
    assert [r["path"] for r in files.discover(spark, str(tmp_path / "in")).collect()] == ["a.csv"]
    (tmp_path / "bad.csv").write_text("x,x\n1,2\n")
    with pytest.raises(ValueError):
        files.read_csv(spark, str(tmp_path / "bad.csv"))
    (tmp_path / "wide.csv").write_text("x,y\n1,2,3\n")
    with pytest.raises(Exception):
        files.read_csv(spark, str(tmp_path / "wide.csv")).collect()
    with zipfile.ZipFile(tmp_path / "z.zip", "w") as z:
        z.writestr("../up", "x")
    with pytest.raises(ValueError), zipfile.ZipFile(tmp_path / "z.zip") as z:
        files.safe_entries(z)
    parts = spark.createDataFrame([("---\ntitle: A --- B\n---\nBody",)], "t string").select(*files.card_parts(F.col("t"))).first()
    assert parts[0] == "title: A --- B" and parts[1] == "Body"
    store = str(tmp_path / "store")
    objects = spark.createDataFrame([("ab", 1, bytearray(b"x")), ("cd", 1, bytearray(b"y"))], "sha256 string, byte_size int, content binary")
    assert sinks.put_objects(spark, store, objects).count() == 2 and sinks.put_objects(spark, store, objects).count() == 0
    source, target = str(tmp_path / "src"), str(tmp_path / "dst")
    spark.createDataFrame([(1, "a"), (2, "b")], "v int, c string").write.parquet(source)
    for _ in range(2):
        ingest(spark, source, "v int, c string", target, "c", str(tmp_path / "cp")).awaitTermination()
    assert spark.read.parquet(target).count() == 2


def test_without_corpus_operators():
    """Without the corpus subpackage and its pipeline the rest imports."""
    import subprocess
    import sys
    from pathlib import Path

    code = "import sys; sys.modules['paperstrata.llm'] = None; sys.modules['corpus_pipeline'] = None\nimport __spark_entry__ as e; assert 'hybrid_search' in e.queries() and not any(q.startswith('op') or q == 'pipeline' for q in e.queries()) and e.oracle_sql()"
    subprocess.run([sys.executable, "-c", code], cwd=Path(__file__).parents[1], check=True)


def test_nearest_over_far_and_empty_cells(spark):
    """Against all pairs: boxes near, far over many cells, on pages without a partner, ties; an empty side."""
    import random

    rng, kind = random.Random(4), "id long, page long, x double, y double, w double, h double"
    box = lambda i, far: (i, i % 4, rng.choice([0.0, 5.0, 3000.0 * far]) + rng.randint(0, 90), float(rng.randint(0, 4000 if far else 50)), 10.0, 5.0)
    a, b = [box(i, i % 2) for i in range(60)], [box(100 + i, i % 3 == 0) for i in range(30)]
    b = [x for x in b if x[1] != 3]
    want = {}
    for i, page, *own in a:
        near = [(round(sum(abs(p - q) for p, q in zip(own, other, strict=True)), 6), j) for j, pb, *other in b if pb == page]
        if near:
            want[i] = min(near)
    one, two = spark.createDataFrame(a, kind), spark.createDataFrame(b, kind)
    for few in (500, 0):
        assert {r["a_id"]: (r["distance"], r["b_id"]) for r in layout.nearest(one, two, few=few).collect()} == want
    assert layout.nearest(one, two.limit(0)).collect() == [] and layout.nearest(one.limit(0), two, few=0).columns == ["a_id", "b_id", "distance"]
