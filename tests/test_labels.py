"""Interval labels against a walk of the tree: chains, wide nodes, ties, orphans, cycles, empty tables; pruning of stored labels."""

import random

import pytest
from pyspark.sql import functions as F

from paperstrata.operators import labels

SCHEMA = "id string, parent_id string, ordinal int, depth string, _part string"


def walked(rows):
    below = {}
    for i, parent, ordinal, *_ in rows:
        below.setdefault(parent, []).append((ordinal or 0, i))
    out, place = {}, 0
    todo = [("in", i, 0) for _, i in sorted(below.get(None, []), reverse=True)]
    while todo:
        step, i, depth = todo.pop()
        if step == "out":
            out[i] = (out[i][0], place, depth)
            continue
        place += 1
        out[i] = (place, None, depth)
        todo.append(("out", i, depth))
        todo += [("in", c, depth + 1) for _, c in sorted(below.get(i, []), reverse=True)]
    return out


def made(seed=5):
    rnd = random.Random(seed)
    rows = [("root", None, None, "x", "y"), ("other", None, 2, None, None)]
    chain = "root"
    for i in range(400):
        rows.append((f"c{i}", chain, 1, None, None))
        chain = f"c{i}"
    rows += [(f"w{i}", "c7", rnd.choice([None, 0, 1, i]), None, None) for i in range(700)]
    rows += [(f"s{i}", rnd.choice(["other", "w3", f"s{i - 1}" if i else "other", "c200"]), i, None, None) for i in range(300)]
    reached = list(rows)
    rows += [("o1", "gone", 1, None, None), ("o2", "o1", 1, None, None), ("k1", "k2", 1, None, None), ("k2", "k1", 1, None, None), ("k3", "k1", 2, None, None), ("self", "self", 1, None, None), (None, "root", 9, None, None)]
    rnd.shuffle(rows)
    return rows, reached


def test_labels_are_those_of_a_walk(spark):
    rows, reached = made()
    got = {r["id"]: (r["enter"], r["leave"], r["depth"]) for r in labels.label(spark.createDataFrame(rows, SCHEMA)).collect()}
    assert got == walked(reached)


def test_searches(spark, tmp_path):
    rows, reached = made(6)
    nodes = spark.createDataFrame(rows, SCHEMA).drop("depth")
    table = labels.store(nodes.join(labels.label(nodes), "id"), f"{tmp_path}/labels", 40)
    parents = {i: p for i, p, *_ in reached}

    def up(i):
        while i is not None:
            yield i
            i = parents[i]

    ids = lambda df: {r["id"] for r in df.collect()}
    assert ids(labels.subtree(table, "c200")) == {i for i in parents if "c200" in up(i)}
    assert ids(labels.ancestors(table, "s250")) == set(up("s250"))
    assert ids(labels.subtree(table, "o1")) == ids(labels.ancestors(table, "none")) == set()
    hits = [i for i in parents if i.endswith("99")]
    assert ids(labels.with_ancestors(table, F.col("id").endswith("99"))) == {a for i in hits for a in up(i)}
    assert ids(labels.with_ancestors(table, F.lit(None).cast("boolean"))) == set()
    # statistics of the files leave out all row groups but those of the subtree
    found = labels.subtree(table, "c395")
    found.collect()
    scans = found._jdf.queryExecution().executedPlan().collectLeaves()
    read = scans.apply(0).metrics().get("numOutputRows").get().value()
    assert 0 < read < table.count() / 10


def test_a_long_chain_takes_few_rounds(spark, monkeypatch):
    tables, plain = [], labels.staged
    monkeypatch.setattr(labels, "staged", lambda df: tables.append(1) or plain(df))
    chain = spark.range(10_000).select("id", F.when(F.col("id") > 0, F.col("id") - 1).alias("parent_id"), F.lit(1).alias("ordinal"))
    got = labels.label(chain)
    assert got.filter("enter <> id + 1 OR leave <> 10000 OR depth <> id").isEmpty()
    assert got.count() == 10_000
    assert len(tables) < 30


def test_empty_and_repeated(spark):
    assert labels.label(spark.createDataFrame([], SCHEMA)).collect() == []
    with pytest.raises(ValueError):
        labels.label(spark.createDataFrame([("a", None, 1, "", ""), ("a", None, 2, "", "")], SCHEMA))
