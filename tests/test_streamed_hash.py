"""Package hashes fed row by row against hashes of the whole text."""

import hashlib
import json

import pytest

from paperstrata.operators import intake, versions


@pytest.fixture
def small_batches(spark):
    before = spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "7")
    yield
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", before)


def manifest(spark):
    """A large package, small ones, one without a name, nulls among values, a repeated entry, letters of several scripts."""
    rows = [("big", f"p/{i}ü", f"h{i}") for i in range(500)] + [(f"s{i}", "a", "h") for i in range(30)]
    rows += [(None, "x", "h"), (None, None, "h"), ("s1", "b", None), ("s1", "b", None), ("名", "ж", '"\\')]
    return rows, spark.createDataFrame(rows, "package string, path string, sha256 string").repartition(5)


def test_lines(spark, small_batches):
    rows, df = manifest(spark)
    per: dict = {}
    for package, path, sha in rows:
        fields = {k: v for k, v in (("path", path), ("sha256", sha)) if v is not None}
        per.setdefault(package, []).append(json.dumps(fields, separators=(",", ":"), ensure_ascii=False))
    want = {p: (hashlib.sha256("\n".join(sorted(e, key=str.encode)).encode()).hexdigest(), len(e)) for p, e in per.items()}
    got = versions.manifest_hash(df, ["package"], ["path", "sha256"]).collect()
    assert {r.package: (r.package_hash, r.files) for r in got} == want and len(got) == len(want)


def test_canonical(spark, small_batches):
    _, df = manifest(spark)
    want = {r.package: r.sha256 for r in intake.canonical(df, "package", "v1", ["sha256", "path"]).collect()}
    got = intake.canonical_hash(df, "package", "v1", ["sha256", "path"]).collect()
    assert {r.package: r.sha256 for r in got} == want and len(got) == len(want)


def test_no_rows(spark):
    assert versions.manifest_hash(manifest(spark)[1].limit(0), ["package"], ["path"]).count() == 0
