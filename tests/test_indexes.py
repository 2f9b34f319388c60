"""Stored indexes against scans."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from paperstrata.operators import inverted, search, vectors
from paperstrata.operators.inverted import InvertedIndex


@pytest.fixture(scope="module")
def units(spark):
    rng = random.Random(5)
    common, rare = [f"w{i}" for i in range(40)], [f"r{i}" for i in range(400)]

    def text():
        return " ".join(rng.choice(rare) if rng.random() < 0.1 else rng.choice(common[: rng.randint(1, 40)]) for _ in range(int(rng.paretovariate(1) * 3) % 400))

    rows = [(i, rng.choice(rare) + " head", text()) for i in range(3000)] + [(3000, None, None), (3001, "", "w0"), (3002, "w0 w0", "W0, w0!")]
    return spark.createDataFrame(rows, "id long, title string, text string").repartition(3).cache()


def scan(units, query, k, fields):
    return [tuple(r) for r in search.top(search.bm25(units, query, fields).select("id", "score"), "id", k).collect()]


def hits(index, query, k, boosts=None):
    return [tuple(r) for r in index.search(query, k, boosts).hits.select("id", "score").collect()]


def test_block_bounds_give_the_scans_hits(spark, units, tmp_path):
    index = InvertedIndex.build(units, "id", ["title", "text"], f"file://{tmp_path}/i", segment_docs=700, range_docs=16)
    for query in ("w0", "r3", "w1 r7 r9", "W0 w0 w39", "nothing", "!", "w2 w3 w4 w5"):
        for k in (1, 10, 100):
            assert hits(index, query, k, {"title": 4.0}) == scan(units, query, k, {"title": 4.0, "text": 1.0}), (query, k)


def test_few_blocks_are_read(spark, tmp_path):
    """Documents of many lengths with one frequent word: the best ones stand in few blocks."""
    times = F.when(F.col("id") % 2991 == 0, 3).when(F.col("id") % 3 == 0, 1).otherwise(0).cast("int")
    docs = spark.range(80_000).select("id", F.concat_ws(" ", F.array_repeat(F.lit("the"), times), F.repeat(F.lit("x "), (F.abs(F.xxhash64("id") % 60) + 60).cast("int"))).alias("text"))
    index = InvertedIndex.build(docs, "id", ["text"], f"file://{tmp_path}/i", segment_docs=8192, range_docs=64)
    found = index.search("the", 10)
    assert found.blocks > 1200 and found.blocks_read < found.blocks * 0.05, (found.blocks, found.blocks_read)
    assert [tuple(r) for r in found.hits.collect()] == scan(docs, "the", 10, {"text": 1.0})


def test_updates(spark, units, tmp_path):
    index = InvertedIndex.build(units, "id", ["text"], f"file://{tmp_path}/i", segment_docs=300, range_docs=32)
    gone, new = units.filter("id % 500 = 1"), spark.createDataFrame([(9000, "t", "w0 w1 r1"), (9001, "t", "r1 r1 r1")], units.schema)
    now = units.join(gone.select("id"), "id", "left_anti").withColumn("text", F.when(F.col("id") == 77, "r1 alone").otherwise(F.col("text"))).unionByName(new)
    assert 0 < index.update(now, gone.select("id").union(new.select("id")).union(spark.createDataFrame([(77,)], "id long"))) <= index.segments
    for query in ("r1", "w0 r1 alone"):
        assert hits(index, query, 20) == scan(now, query, 20, {"text": 1.0})
    index.update(units.limit(0), now.select("id"))
    assert hits(index, "r1", 5) == []


def test_parts_of_a_segment_and_a_died_update(spark, units, tmp_path, monkeypatch):
    """Segments larger than a task are dealt to parts, ids are of any type, and what a died update left is written over."""
    monkeypatch.setattr(inverted, "TASK_CHARS", 20_000)
    named = units.select(F.concat(F.lit("n"), F.col("id")).alias("id"), "title", "text")
    index = InvertedIndex.build(named, "id", ["title", "text"], f"file://{tmp_path}/i", segment_docs=2000, range_docs=16)
    blocks = spark.read.schema(index.schema).parquet(f"{index.path}/blocks")
    assert index.segments == 2 and blocks.rdd.getNumPartitions() > 1
    assert blocks.filter("term = ''").agg(F.sum(F.size("docs"))).first()[0] == 2 * named.count()
    blocks.drop("generation").write.parquet(f"{index.path}/blocks/generation=1")  # without its rows of segments
    now = named.withColumn("text", F.when(F.col("id") == "n7", "r1 alone").otherwise(F.col("text")))
    index.update(now, named.filter("id = 'n7'"))
    for query in ("r1 alone", "w0 r3"):
        assert hits(index, query, 20, {"title": 2.0}) == scan(now, query, 20, {"title": 2.0, "text": 1.0})


def test_empty_index(spark, units, tmp_path):
    index = InvertedIndex.build(units.limit(0), "id", ["text"], f"file://{tmp_path}/i")
    assert hits(index, "w0", 5) == []


@pytest.fixture(scope="module")
def clustered(spark):
    rng = np.random.default_rng(2)
    centres = rng.normal(size=(30, 24))
    points = [*(centres[rng.integers(30)] + rng.normal(size=24) * 0.3 for _ in range(3000)), *[centres[0]] * 1500]  # a third are copies
    rows = [(i, [float(x) for x in p]) for i, p in enumerate(points)] + [(9990, None), (9991, [0.0] * 24), (9992, [1.0]), (9993, [])]
    return spark.createDataFrame(rows, "id long, embedding array<float>").repartition(4).cache()


def test_vector_recall_and_scores(spark, clustered, tmp_path, monkeypatch):
    monkeypatch.setattr(vectors, "CHUNK_ROWS", 400)  # the cell of copies is cut into chunks
    index = vectors.VectorIndex.build(clustered, "id", "embedding", f"file://{tmp_path}/v", recall=0.98, k=20)
    assert index.model.probes < len(index.model.cells) / 4
    queries = clustered.filter("id % 50 = 0 AND id < 3000").withColumnRenamed("id", "qid")
    best = vectors.exact(clustered, queries, 20).collect()
    got = index.search(queries, 20).collect()
    near = {(r.qid, r.id): r.score for r in got}
    # equal scores are equally right
    least = {}
    for r in best:
        least[r.qid] = min(least.get(r.qid, 2.0), r.score)
    right = sum(r.score >= least[r.qid] for r in got)
    assert len(best) == len(got) == 60 * 20 and right / len(best) >= 0.9
    assert all(near[r.qid, r.id] == pytest.approx(r.score, abs=2e-5) for r in best if (r.qid, r.id) in near)
    everything = index.search(queries.limit(3), 20, probes=len(index.model.cells))
    assert everything.count() == 60 and index.search(queries, 20, threshold=0.999).filter("score < 0.999").count() == 0


def test_every_vector_is_stored(clustered, spark, tmp_path):
    index = vectors.VectorIndex.build(clustered, "id", "embedding", f"file://{tmp_path}/v", k=10)
    assert index.rows.count() == clustered.count() and sorted(r.id for r in index.rows.filter("cell = -1").collect()) == [9990, 9991, 9992, 9993]
    odd = clustered.filter("id >= 9990").withColumnRenamed("id", "qid")
    assert index.search(odd, 5).count() == 0
    with pytest.raises(ValueError):
        vectors.VectorIndex.build(clustered.filter("id = 9990"), "id", "embedding", f"file://{tmp_path}/w")


def test_registered_vector_query_recall(spark):
    got = {(r.qid, r.id) for r in vectors.search_vectors_indexed(spark, "/root/testdata/sf0.001").collect()}
    want = {(r.qid, r.id) for r in vectors.search_vectors_exact(spark, "/root/testdata/sf0.001").collect()}
    assert len(got & want) / len(want) >= 0.9
