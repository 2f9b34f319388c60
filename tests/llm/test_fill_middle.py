"""Cuts against plain Python, the index of line borders, and the way back."""

import hashlib
import random
import re

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

from paperstrata.llm import fill_middle as M


def brute(id, text, seed=7, percent=100, spm=50):
    text = text or ""
    units = re.findall(r"[^\n]*\n|[^\n]+", text)
    digest = hashlib.sha256(f"{seed}:{'' if id is None else id}".encode()).hexdigest()
    h = [int(digest[8 * k : 8 * k + 8], 16) for k in range(4)]
    a, b = sorted((h[0] % (len(units) + 1), h[1] % (len(units) + 1)))
    prefix, middle, suffix = "".join(units[:a]), "".join(units[a:b]), "".join(units[b:])
    if not text or any(m in text for m in ("<P>", "<S>", "<M>")) or h[2] % 100 >= percent:
        return (len(units), "plain", text, None, None)
    if h[3] % 100 < spm:
        return (len(units), "spm", f"<S>{suffix}<P>{prefix}<M>{middle}", len(prefix), len(middle))
    return (len(units), "psm", f"<P>{prefix}<S>{suffix}<M>{middle}", len(prefix), len(middle))


@pytest.fixture(scope="module")
def rows(corpus):
    rng = random.Random(3)
    out = [(r[0], r[1]) for r in corpus]
    texts = ["\n", "\n\n\n", "a\n", "\na", "日本\n語\n\U0001f44d\nx", "has <M> inside\nx", "a\r\nb\x85c d\n", "".join(rng.choice("ab\n") for _ in range(30_000)), "x" * 200_000 + "\n" + "y" * 200_000, "line\n" * 40_000]
    out += [(1000 + 20 * k + j, t) for k, t in enumerate(texts) for j in range(8)]
    return out + [(1000, "a\n"), (1000, "a\n"), (None, "n\nm\n"), (None, None)]


def made(spark, rows, **more):
    docs = spark.createDataFrame(rows, "doc_id long, text string").withColumns({c: F.lit(1) for c in ("id", "h", "n", "low", "copies", "form")})
    out = M.fill_in_middle(docs, **more)
    assert out.columns == ["doc_id", "n", "form", "output", "prefix_chars", "middle_chars"]
    return out


def want(rows, **more):
    return sorted(((i, *brute(i, t, **more)) for i, t in rows), key=str)


def test_cuts(spark, rows):
    assert sorted((tuple(r) for r in made(spark, rows).collect()), key=str) == want(rows)
    got = sorted((tuple(r) for r in made(spark, rows, seed=11, percent=60, spm_percent=20).collect()), key=str)
    assert got == want(rows, seed=11, percent=60, spm=20) and {r[2] for r in got} == {"plain", "psm", "spm"}


@pytest.mark.parametrize("hasher", [lambda t: F.lit(b"\x00"), lambda t: F.unhex(F.substring(F.md5(t), 1, 2))])
def test_hashes_that_collide(spark, rows, hasher):
    assert sorted((tuple(r) for r in made(spark, rows, hasher=hasher).collect()), key=str) == want(rows)


def test_shuffled_joins(spark, rows, monkeypatch):
    monkeypatch.setattr(M, "BROADCAST", 0)
    assert sorted((tuple(r) for r in made(spark, rows).collect()), key=str) == want(rows)


def test_way_back(spark, rows):
    out = made(spark, rows).withColumn("back", M.restored(F.col("output"), F.col("form"))).collect()
    assert sorted((str(r.doc_id), r.back) for r in out) == sorted((str(i), t or "") for i, t in rows)


def test_the_index_holds_repeated_texts_once(spark, rows):
    docs = spark.createDataFrame(rows, "doc_id long, text string").select(F.coalesce("text", F.lit("")).alias("text")).withColumn("h", M.content_hash(F.col("text")))
    texts = [t or "" for _, t in rows]
    repeated = {t for t in texts if texts.count(t) > 1}
    got = M.text_index(docs).collect()
    assert len(got) == len(repeated) and sorted(r.n for r in got) == sorted(len(re.findall(r"[^\n]*\n|[^\n]+", t)) for t in repeated)
    longest = max(got, key=lambda r: r.n)
    assert (len(longest.low) + len(longest.high)) * 8 < 6 * longest.n  # bits a line


def test_elias_fano():
    rng = np.random.default_rng(1)
    for values in ([], [0], [1], [5], [0, 0, 0], list(range(1000)), [10**9], sorted(rng.integers(0, 10**7, 500).tolist()), sorted(rng.integers(0, 300, 900).tolist())):
        n, *rest = M.elias_fano(np.array(values, np.int64))
        assert n == len(values) and [M.select(i, *rest) for i in range(n)] == values


def test_empty(spark):
    assert made(spark, []).collect() == []


def test_sql(spark):
    con = duckdb.connect()
    con.execute("CREATE VIEW documents AS SELECT * FROM '/root/testdata/sf0.001/documents.parquet'")
    df = M.op13_fill_in_middle(spark, "/root/testdata/sf0.001")
    cursor = con.execute(M.ORACLE)
    assert [c[0] for c in cursor.description] == df.columns
    assert sorted((tuple(r) for r in df.collect()), key=str) == sorted(cursor.fetchall(), key=str)
