"""Near-dedup sends the driver tables of bounded size only, and its filter of ids loses none."""

import math

from pyspark.sql import functions as F

from paperstrata.llm import near_dedup


def test_broadcasts_do_not_grow_with_ids(spark, monkeypatch):
    docs = spark.range(20_000).select(F.col("id").alias("doc_id"), F.expr("concat('a b c d e f ', id)").alias("text"))
    rows = near_dedup.sketches(docs, "doc_id", "text", 5, near_dedup.K)
    sent, real = [], F.broadcast
    monkeypatch.setattr(F, "broadcast", lambda df: sent.append(df.count()) or real(df))
    sets = near_dedup.full_sets(docs, "doc_id", "text", 5, rows.filter("id % 2 = 0").select("rid", "id", "ka", "kb"))
    assert sets.count() == 10_000
    assert sent and max(sent) <= 512


def test_filter_keeps_all_ids(spark):
    rows = spark.sql("SELECT * FROM VALUES ('a', 1), (NULL, 2), ('b', 3), ('b', 4), ('c', 5) AS t(id, n)")
    few = near_dedup.likely_among(rows, rows.filter("n < 4"))
    assert few.columns == ["id", "n"] and [r.n for r in few.orderBy("n").collect()] == [1, 2, 3, 4]
    many = spark.range(-100_000, 100_000)
    kept = near_dedup.likely_among(many, many.filter("id % 2 = 0"))
    expected = 100_000 * (1 - math.exp(-100_000 / 2 ** (near_dedup.ROW_BITS + 15)))  # others that share a bit with one
    assert kept.filter("id % 2 = 0").count() == 100_000
    assert kept.filter("id % 2 <> 0").count() < 2 * expected + 20
    assert near_dedup.likely_among(rows, rows.limit(0)).count() == 0


def test_unlike_members_are_not_broadcast(spark, monkeypatch):
    spread = spark.createDataFrame([(1, 7, 1, 1), (1, 7, 2, 2), (1, 8, 1, 1), (1, 8, 3, 3)], "level int, value long, rid long, root long")
    sets = spark.createDataFrame([(1, list(range(20))), (2, list(range(19))), (3, list(range(90, 110)))], "rid long, set array<long>")
    monkeypatch.setattr(near_dedup.C, "stage", lambda df: df)
    pairs = near_dedup._unlike(spread, sets, 80)
    assert "Broadcast" not in pairs._jdf.queryExecution().executedPlan().toString()
    assert [(r.a, r.b) for r in pairs.collect()] == [(1, 2)]
