"""Work that grows with the input and no faster: counts of rows and staged tables on inputs of two sizes or with hot keys."""

import tracemalloc

import numpy as np
import pyarrow as pa
from pyspark.sql import functions as F

from paperstrata.operators import catalog, pages, tree, vectors
from paperstrata.operators.inverted import InvertedIndex, counts_of


def test_conflicts_of_one_name(spark, monkeypatch):
    """A name of many owners gives a row per wanted name, not one per pair, ahead of the last step."""
    wanted = spark.range(400).select("id", F.lit("same").alias("name")).unionByName(spark.createDataFrame([(1, "own"), (2, None), (None, "same"), (900, "two")], "id long, name string"))
    existing = spark.range(300).select("id", F.lit("same").alias("name")).unionByName(spark.createDataFrame([(1, "own"), (None, "own"), (5, None), (900, "two"), (901, "two")], "id long, name string"))
    ahead, plain = [], type(wanted).distinct
    monkeypatch.setattr(type(wanted), "distinct", lambda self: ahead.append(self.count()) or plain(self))
    got = sorted(tuple(r) for r in catalog.name_conflicts(wanted, existing).collect())
    assert got == sorted([*((i, "same") for i in range(400)), (900, "two")])
    assert ahead == [401]


def test_index_is_written_by_many_tasks(spark, tmp_path, monkeypatch):
    """Neither the rows of segments nor words are pulled into one task, and no order is sampled by counting all words twice."""
    docs = spark.range(300).select("id", F.concat_ws(" ", F.lit("a a"), F.concat(F.lit("w"), F.col("id") % 7), F.lit("")).alias("text"))
    called = []
    index = InvertedIndex.build(docs, "id", ["text"], f"file://{tmp_path}/i", segment_docs=20, range_docs=8)
    for name in ("coalesce", "repartitionByRange"):
        monkeypatch.setattr(type(docs), name, lambda self, *a, name=name, f=getattr(type(docs), name): called.append(name) or f(self, *a))
    assert index.update(docs, docs.filter("id < 200")) > 1
    assert called == []
    assert [r.id for r in index.search("w3", 5).hits.collect()] == [3, 10, 17, 24, 31]


def test_index_shuffles_words_and_no_postings(spark, tmp_path):
    """What a build and an update of all segments shuffle is under a byte for each of the texts; posting blocks are not dealt again."""
    store, jvm = spark.sparkContext._jsc.sc().statusStore(), spark.sparkContext._jvm

    def shuffled():
        spark.sparkContext._jsc.sc().listenerBus().waitUntilEmpty(30_000)
        stages = store.stageList(None, False, False, spark.sparkContext._gateway.new_array(jvm.double, 0), jvm.java.util.ArrayList())
        return {(stages.apply(i).stageId(), stages.apply(i).attemptId()): stages.apply(i).shuffleWriteBytes() for i in range(stages.size())}

    word = lambda i: F.conv((F.abs(F.xxhash64("id", i)) % F.lit(7919) * F.lit(104729)).cast("string"), 10, 36)
    docs = spark.range(3000).select("id", F.concat_ws(" ", F.transform(F.sequence(F.lit(1), F.lit(300)), word)).alias("text")).cache()
    texts, before = docs.agg(F.sum(F.length("text"))).first()[0], shuffled()
    index = InvertedIndex.build(docs, "id", ["text"], f"file://{tmp_path}/i", segment_docs=64)
    assert index.update(docs, docs.filter("id % 2 = 0")) == index.segments
    after = shuffled()
    assert 0 < sum(n for key, n in after.items() if key not in before) < 2 * texts, texts


def test_counts_of_words(spark):
    rows = spark.createDataFrame([(0, ["b", "a", "b", "é", "b"]), (1, []), (2, ["x"])], "id int, words array<string>")
    got = [(r.id, sorted(map(tuple, r.c or []))) for r in rows.select("id", counts_of(F.col("words")).alias("c")).orderBy("id").collect()]
    assert got == [(0, [("a", 1, 5), ("b", 3, 5), ("é", 1, 5)]), (1, []), (2, [("x", 1, 1)])]


def test_items_go_through_rounds_once_a_shared_item(spark, monkeypatch):
    """Pages of one item, and further pages that two items share, add nothing to the rounds."""
    rounds, plain = [], pages.components
    monkeypatch.setattr(pages, "components", lambda links: rounds.append(links.count()) or plain(links))
    rows = [(1, p) for p in range(60)] + [(2, p) for p in range(10, 50)] + [(3, 1000 + p) for p in range(80)] + [(4, None), (5, 1000), (5, None), (7, 2000), (7, 2000)]
    claims = spark.createDataFrame(rows, "item long, page long")
    assert sorted(tuple(r) for r in pages.groups(claims).collect()) == [(1, 1), (2, 1), (3, 3), (4, 4), (5, 3), (7, 7)]
    assert rounds == [2]


def test_rings_do_not_prolong_trimming(spark, monkeypatch):
    """Chains that end are found in rounds by their own length, whatever rings there are."""
    count, plain = [], tree.staged
    monkeypatch.setattr(tree, "staged", lambda df: count.append(1) or plain(df))
    ring = [(i, (i + 1) % 3000) for i in range(3000)]
    left = tree._without_chains(spark.createDataFrame([*ring, (5000, 5001), (5001, 5002), (6000, 7), (6000, 8)], "path long, target long"))
    assert sorted(map(tuple, left.collect())) == sorted([*ring, (6000, 7), (6000, 8)])
    assert len(count) < 9


def test_exact_search_holds_few_scores():
    """Queries are scored in parts, so a batch of vectors takes no matrix of all of them."""
    rng = np.random.default_rng(1)
    held, asked = rng.normal(size=(10_000, 8)), rng.normal(size=(1500, 8))
    batch = pa.RecordBatch.from_arrays([pa.array(range(10_000)), pa.array([list(v) for v in held])], ["id", "embedding"])
    compare = vectors._compare(list(range(1500)), [list(v) for v in asked], 10, None)
    tracemalloc.start()
    got, best = 0, {}
    for out in compare(iter([batch])):
        got += out.num_rows
        for q, i in zip(out.column("qid").to_pylist(), out.column("id").to_pylist(), strict=True):
            best.setdefault(q, set()).add(i)
    most = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert most < 80e6 and got >= 15_000 and len(best) == 1500
    scores = (asked[777] / np.linalg.norm(asked[777])) @ (held / np.linalg.norm(held, axis=1, keepdims=True)).T
    assert set(np.argsort(-scores)[:10]) <= best[777]
