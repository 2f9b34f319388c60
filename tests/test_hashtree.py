"""Hash trees against a full comparison, and how little of the entries a small change reads."""

import random

import pytest
from pyspark.sql import functions as F

from paperstrata.operators import versions
from paperstrata.operators.hashtree import HashTree, diff

KIND = "namespace string, logical_path string, sha256 string, byte_size long"


def frame(spark, entries):
    return spark.createDataFrame([(*key, *value) for key, value in entries.items()], KIND)


def changes(df):
    return sorted(map(tuple, df.select("namespace", "logical_path", "change").collect()))


def check(spark, tmp_path, old, new, **sizes):
    a, b = frame(spark, old), frame(spark, new)
    trees = [HashTree.build(m, f"{tmp_path}/{side}", **sizes) for m, side in ((a, "old"), (b, "new"))]
    out = diff(*trees)
    want = sorted([(*k, "added") for k in new.keys() - old.keys()] + [(*k, "removed") for k in old.keys() - new.keys()] + [(*k, "changed") for k in old.keys() & new.keys() if old[k] != new[k]])
    assert changes(out.rows) == want == changes(versions.diff(a, b))
    return out


def test_random_trees(spark, tmp_path):
    rng = random.Random(3)
    name = lambda: "/".join(rng.choice(["a", "b", "", "ü c", "a.b"]) for _ in range(rng.randint(0, 4)))
    every = {(rng.choice("xy"), f"{name()}/f{i}".lstrip("/") if i % 3 else f"f{i}"): (f"h{i}", i) for i in range(300)}
    old = {k: v for k, v in every.items() if rng.random() < 0.95}
    new = {k: (v if rng.random() < 0.9 else (v[0], v[1] + 1)) for k, v in every.items() if rng.random() < 0.95}
    # nulls among values, a file that becomes a folder, a whole namespace that goes
    old |= {("x", "n"): (None, 1), ("x", "m"): ("h", None), ("x", "q"): ("h", 1), ("z", "deep/er/f"): ("h", 2)}
    new |= {("x", "n"): ("h", None), ("x", "m"): ("h", None), ("x", "q/q"): ("h", 1)}
    check(spark, tmp_path, old, new, shards=4, buckets=8)


@pytest.mark.parametrize("old, new", [({}, {}), ({}, {("x", "a/b"): ("h", 1)}), ({("x", "b"): ("h", 1)}, {}), ({("x", "a/b"): ("h", 1)}, {("x", "a/b"): ("h", 1)})])
def test_edges(spark, tmp_path, old, new):
    check(spark, tmp_path, old, new, shards=2, buckets=2)


def test_values_that_trade_places(spark, tmp_path):
    """Sums over an unordered set must still see two files of a bucket swap their contents."""
    old = {("x", f"d/f{i}"): (f"h{i}", i) for i in range(20)}
    new = old | {("x", "d/f3"): old["x", "d/f4"], ("x", "d/f4"): old["x", "d/f3"]}
    check(spark, tmp_path, old, new, buckets=1)


def test_reads_what_changed(spark, tmp_path):
    """One flat folder of 40,000 files and 100 small folders; three changes."""
    old = {("x", f"flat/f{i}"): ("h", i) for i in range(40_000)} | {("x", f"s{i}/t/f{j}"): ("h", j) for i in range(100) for j in range(20)}
    new = old | {("x", "flat/f77"): ("other", 77), ("x", "s5/t/new"): ("h", 0)}
    del new["x", "s9/t/f3"]
    out = check(spark, tmp_path, old, new)
    assert out.old.count() < 250 and out.new.count() < 250
    files = spark.read.parquet(f"{tmp_path}/old/entries")
    read = files.filter(F.col("_shard").isin([r[0] for r in out.old.select("_shard").distinct().collect()])).count()
    assert read < len(old) / 10


def test_trees_of_other_shapes(spark, tmp_path):
    trees = [HashTree.build(frame(spark, {("x", "a"): ("h", 1)}), f"{tmp_path}/{n}", shards=n) for n in (2, 3)]
    with pytest.raises(ValueError, match="shards"):
        diff(*trees)


def test_a_tree_without_description_is_none(spark, tmp_path):
    (tmp_path / "entries").mkdir()
    with pytest.raises(Exception, match="PATH_NOT_FOUND|does not exist"):
        HashTree(spark, str(tmp_path)).about
