"""Section splits, exact percentiles of skewed groups, repeated page chrome."""

import math
import random
import re
from collections import Counter

import pytest
from pyspark.sql import functions as F

from paperstrata.operators import chunk, evaluate, layout, tree

count = lambda t: len(t.split())


def test_an_over_long_sentence_is_cut_every_120_words():
    text = ", ".join(f"w{i}" for i in range(800)) + ". Short one."
    assert [count(p) for p in chunk.pieces_of(text, 700, count)] == [120] * 6 + [80, 2]
    assert [count(p) for p in chunk.pieces_of("first. " + text, 700, count)] == [120] * 6 + [80, 3]  # what was being put together comes after it


def test_a_single_sentence_is_cut_at_clauses():
    text = ", ".join(" ".join(f"w{i}" for i in range(90)) for _ in range(10))
    assert [count(p) for p in chunk.pieces_of(text, 700, count)] == [630, 270]
    assert chunk.pieces_of("a b. c d. e", 4, count) == ["a b. c d.", "e"]


def test_one_long_word_is_cut_by_tokens():
    letters, cut = len, lambda t, n: [t[i : i + n] for i in range(0, len(t), n)]
    assert chunk.pieces_of("x" * 25, 10, letters, cut) == ["x" * 10, "x" * 10, "x" * 5]
    assert chunk.pieces_of("ab. " + "y" * 13 + ". cd.", 10, letters, cut) == ["y" * 10, "y" * 3 + ".", "ab. cd."]


@pytest.mark.parametrize("seed", range(5))
def test_splits_keep_all_words_within_the_limit(seed):
    rng = random.Random(seed)
    blocks = [" ".join("w" * rng.randint(1, 5) + rng.choice(["", "", "", ",", ".", "!"]) for _ in range(rng.randint(1, 400))) for _ in range(12)]
    text = "\n\n".join(blocks)
    for most in (5, 40, 130, 700):
        out = chunk.split_section(text, most)
        assert all(count(p) <= most for p in out) and Counter(" ".join(out).split()) == Counter(text.split())
        assert all(count(a) + count(re.split(r"\n\n", b)[0]) > most for a, b in zip(out, out[1:], strict=False))  # the next piece didn't fit


def test_chunk_section_over_documents(spark):
    rows = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select("doc_id", "text")
    got = {}
    for r in rows.select("doc_id", F.posexplode(chunk.section_chunks("text", 100)).alias("pos", "chunk")).collect():
        got.setdefault(r.doc_id, []).append((r.pos, r.chunk))
    for r in rows.collect():
        own = [c for _, c in sorted(got[r.doc_id])]
        assert Counter(" ".join(own).split()) == Counter((r.text or "").split()) and all(count(c) <= 100 for c in own)


@pytest.mark.parametrize(("bins", "ordered"), [(1024, 10_000), (4, 1), (64, 20)])
def test_percentiles(spark, monkeypatch, bins, ordered):
    monkeypatch.setattr(evaluate, "BINS", bins)
    monkeypatch.setattr(evaluate, "SORTED", ordered)
    rng = random.Random(bins)
    groups = {
        "hot": [rng.gauss(0, 1) for _ in range(3000)], "same": [5.0] * 50, "one": [2.5], "powers": [2.0**i for i in range(-40, 60)],
        "ties": [float(rng.randint(0, 3)) for _ in range(400)], None: [1.0, 2.0, 3.0, 4.0], "none": [None, None], "odd": [math.nan, 1.0, None, 9.0, -1e300, 1e300],
    }
    df = spark.createDataFrame([(k, v) for k, vs in groups.items() for v in vs], "kind string, value double").repartition(4)
    got = {r.kind: r for r in evaluate.percentiles(df, "value", "kind", (0.0, 0.5, 0.95, 1.0)).collect()}
    assert set(got) == set(groups)
    for kind, values in groups.items():
        own = sorted(v for v in values if v is not None and v == v)
        for share in (0.0, 0.5, 0.95, 1.0):
            want = own[max(math.ceil(len(own) * share), 1) - 1] if own else None
            assert got[kind][f"p{int(share * 100)}"] == want, (kind, share)


def test_percentiles_of_integers_and_nothing(spark):
    df = spark.range(101).select(F.lit("a").alias("k"), F.col("id").cast("int").alias("v"))
    assert [tuple(r) for r in evaluate.percentiles(df, "v", "k").collect()] == [("a", 50.0, 50, 95)]
    assert evaluate.percentiles(df.limit(0), "v", "k").collect() == []


def test_chrome_with_nulls(spark):
    rows = [(1, "h", 1.0, 1.0, 5.0, 5.0), (2, "h", 1.2, 1.1, 5.0, 5.0), (3, "h", 1.0, 400.0, 5.0, 5.0), (4, "h", None, 1.0, 5.0, 5.0), (5, "h", None, 1.0, 5.0, 5.0), (6, "f", 1.0, None, 5.0, 5.0), (7, "x", 9.0, 990.0, 5.0, 5.0)]
    df = spark.createDataFrame(rows, "id int, kind string, x double, y double, w double, h double")
    assert {r.id: r.repeated for r in layout.chrome(df, 1000.0).collect()} == {1: True, 2: True, 3: False, 4: True, 5: True, 6: False, 7: False}


def test_many_roots(spark):
    nodes = spark.createDataFrame([(i, None, None, "group") for i in range(3)], "id long, parent_id long, ordinal int, kind string")
    assert sorted((r.fault, r.id) for r in tree.validate(nodes).collect()) == [("several roots", i) for i in range(3)]
    assert tree.validate(nodes.limit(1)).collect() == []
