"""The audit of filters by running every order over the documents, one after the other."""

import itertools
import re
from collections import defaultdict

import duckdb
import pytest
from pyspark.sql import functions as F

from paperstrata.llm import filter_audit as A

WORDS = re.compile("[^\x20\x09-\x0d]+")
COLUMNS = ["part", "filter_order", "step", "kept", "removed", "redundant", "unique_fails", "good_lost", "toxic_lost", "shapley"]


def brute(rows, labels):
    """rows: (id, text, source)."""
    texts = [(i, t or "", s or "") for i, t, s in rows]
    fails = []
    for i, t, _ in texts:
        words = WORDS.findall(t)
        own = {"A": len(words) < 200, "B": 100 * len(set(words)) < 50 * len(words), "C": 100 * sum("A" <= c <= "Z" for c in t) > 2 * len(t), "D": any(c in "#$%&*|" for c in t)}
        own["E"] = any(j is not None and i is not None and j < i and u == t for j, u, _ in texts)
        fails.append({f for f, bad in own.items() if bad})
    says = lambda i, k: any(r[0] == i and r[k] == 1 for r in labels if i is not None)
    out = []
    for part in {s for _, _, s in texts}:
        here = [n for n, r in enumerate(texts) if r[2] == part]
        removed_by = defaultdict(int)
        steps = []
        for order in map("".join, itertools.permutations("ABCDE")):
            left = list(here)
            for step, f in enumerate(order, 1):
                lost = [n for n in left if f in fails[n]]
                left = [n for n in left if f not in fails[n]]
                removed_by[f] += len(lost)
                before = set(order[: step - 1])
                steps.append((f, [part, order, step, len(left), len(lost), sum(f in fails[n] and bool(before & fails[n]) for n in here), sum(fails[n] == {f} for n in here), sum(says(texts[n][0], 1) for n in lost), sum(says(texts[n][0], 2) for n in lost)]))
        out += [tuple([*values, removed_by[f]]) for f, values in steps]
    return sorted(out)


def table(df):
    assert df.columns == COLUMNS
    return sorted(tuple(r) for r in df.collect())


@pytest.fixture
def case(spark, corpus):
    clean = " ".join(f"w{i}" for i in range(300))
    rows = [(r[0], r[1], r[3]) for r in corpus]
    n = len(rows)
    rows += [(n + k, clean if k % 3 else clean + " #", ["a", "b", None, ""][k % 4]) for k in range(12)]
    rows += [(n + 50, clean, "a"), (n + 50, clean, "a"), (None, clean, "a"), (None, None, None), (5, clean, "z"), (n + 60, "A" * 3000, "z"), (n + 61, "A" * 2999 + "B", "z"), (n + 62, "A" * 3000, "z")]
    labels = [(r[0], k % 2, k % 3 == 0 and 1 or 0) for k, r in enumerate(rows) if r[0] is not None] + [(n, 1, 1), (n, 0, None), (None, 1, 1)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string").withColumns({c: F.lit(1) for c in ("id", "part", "mask", "length", "hashes", "first", "here", "n")})
    return rows, labels, docs, spark.createDataFrame(labels, "doc_id long, quality int, toxic int").withColumn("good", F.lit("x"))


def test_against_brute_force(case):
    rows, labels, docs, told = case
    assert table(A.audit(docs, told)) == brute(rows, labels)


def test_signatures_that_collide(case):
    """Block hashes that say little: the compared texts decide."""
    rows, labels, docs, told = case
    assert table(A.audit(docs, told, hasher=lambda text, longest: F.array(*(F.lit(0).cast("long") for _ in A.blocks(longest))))) == brute(rows, labels)


def test_shuffled_joins(case, monkeypatch):
    rows, labels, docs, told = case
    monkeypatch.setattr(A, "BROADCAST", 0)
    assert table(A.audit(docs, told)) == brute(rows, labels)


def test_blocks_cover_texts():
    for longest in (0, 1, 256, 257, 10**7):
        made = A.blocks(longest)
        assert made[0][0] == 0 and all(a + n == b for (a, n), (b, _) in itertools.pairwise(made)) and sum(made[-1]) >= longest
    assert len(A.blocks(9_000_000)) == 6


def test_copies_that_differ_late(spark):
    """Long texts that agree up to their last letter, and one group of many copies."""
    long = "x" * 400_000
    rows = [(i, long + "ab"[i % 2], "s") for i in range(5)] + [(i, "same text", "s") for i in range(100, 400)]
    docs, labels = spark.createDataFrame(rows, "doc_id long, text string, source string"), spark.createDataFrame([], "doc_id long, quality int, toxic int")
    got = {(r.filter_order, r.step): r for r in A.audit(docs, labels).collect()}
    assert got["EABCD", 1].removed == 3 + 299 and got["EABCD", 1].kept == 3 and got["EABCD", 1].unique_fails == 0


def test_empty(spark, empty):
    assert table(A.audit(empty, spark.createDataFrame([], "doc_id long, quality int, toxic int"))) == []


def test_sql(spark):
    con = duckdb.connect()
    for name in ("documents", "labels"):
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM '/root/testdata/sf0.001/{name}.parquet'")
    cursor = con.execute(A.ORACLE)
    assert [c[0] for c in cursor.description] == COLUMNS
    assert table(A.op11_filter_audit(spark, "/root/testdata/sf0.001")) == sorted(cursor.fetchall())
