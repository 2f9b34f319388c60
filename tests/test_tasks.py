"""What a task holds doesn't grow with its table: rows are dealt to as many tasks as their number asks for."""

import functools
import math
import tracemalloc
from pathlib import Path

import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from paperstrata.operators import catalog, chunk, intake, layout, vectors
from paperstrata.session import dealt

SF = "/root/testdata/sf0.001"

tables = pytest.mark.skipif(not Path(SF).is_dir(), reason="no test tables")


def test_dealt(spark):
    assert [dealt(spark.range(n), *keys, rows=100).rdd.getNumPartitions() for n, keys in ((0, ()), (5, ("id",)), (1001, ("id",)), (1001, ()))] == [1, 1, 11, 11]


@tables
@pytest.mark.parametrize("module, name", [(catalog, "numbered_titles"), (catalog, "child_order"), (layout, "nearest_box"), (layout, "located_tables")])
def test_order_lines(spark, monkeypatch, module, name):
    """Windows, groups and joins by order or page stay in the tasks to which the rows were dealt."""
    monkeypatch.setattr(module, "dealt", functools.partial(dealt, rows=200))
    n = spark.read.parquet(f"{SF}/lineitem.parquet").count()
    assert module.QUERIES[name][0](spark, SF).rdd.getNumPartitions() == math.ceil(n / 200)


@tables
def test_files_of_bounded_rows(spark, monkeypatch):
    """A table is written to as many CSV files as its rows ask for, and each file's rows meet in a task of their own."""
    monkeypatch.setattr(intake, "FILE_ROWS", 100)
    n = spark.read.parquet(f"{SF}/orders.parquet").count()
    told = intake.QUERIES["csv_numbers"][0](spark, SF)
    assert told.rdd.getNumPartitions() == math.ceil(n / 100)
    assert [tuple(r) for r in told.groupBy("in_order").count().collect()] == [(True, n)]


@tables
@pytest.mark.parametrize("name", ["markdown_tables", "chunk_overlap", "chunk_bounded"])
def test_small_file_is_the_work_of_many_tasks(spark, monkeypatch, name):
    monkeypatch.setattr(chunk, "PYTHON_ROWS", 10)
    n = spark.read.parquet(f"{SF}/part.parquet").count()
    assert chunk.QUERIES[name][0](spark, SF).rdd.getNumPartitions() == math.ceil(n / 10)


def test_texts_are_objects_a_few_at_a_time(spark):
    """A batch of many texts is never held as Python objects at once: neither as it comes nor as it goes."""
    text = "word " * 2000
    batch = pa.array([text] * 2000)
    for function, kind in ((chunk.split_section, pa.list_(pa.string())), (lambda t: [{"text": x, "start_line": a, "end_line": b} for x, a, b in chunk.chunk_lines(t)], chunk.CHUNK)):
        sql = "array<string>" if kind != chunk.CHUNK else chunk.CHUNK_SQL
        udf = chunk.in_parts(function, kind, sql)
        tracemalloc.start()
        try:
            out = udf.func(batch)
            peak = tracemalloc.get_traced_memory()[1]
        finally:
            tracemalloc.stop()
        assert out.to_pylist() == [function(text)] * 2000
        assert peak < 4 * 64 * len(text)


def test_candidates_of_many_queries_are_dealt(spark, tmp_path, monkeypatch):
    """More queries are more tasks, and the hits are those of an exact search where all cells are looked into."""
    monkeypatch.setattr(vectors, "VECTOR_ROWS", 10)
    rows = spark.createDataFrame([(i, [float(i % 7), float(i % 11), float(i % 13) + 1]) for i in range(200)], "id long, embedding array<float>")
    asked = rows.filter("id % 50 = 0").select(F.col("id").alias("qid"), "embedding")
    index = vectors.VectorIndex.build(rows, "id", "embedding", f"file://{tmp_path}/v", k=5)
    hits = index.search(asked, 5, probes=len(index.model.cells))
    assert hits.rdd.getNumPartitions() == 4 * vectors.RESCORE * 5 // 10
    told = lambda found: sorted((r.qid, r["rank"], r.score) for r in found.collect())
    assert told(hits) == told(vectors.exact(rows, asked, 5))
