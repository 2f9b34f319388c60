"""Strict CSV read by many tasks per file against Python's reader of the whole file."""

import csv
import random

import pytest
from pyspark.sql import functions as F

from paperstrata.sources.files import read_csv


def write(path, rows, end="\n"):
    with open(path, "w", newline="") as f:
        csv.writer(f, lineterminator=end).writerows(rows)


@pytest.fixture
def tiny_blocks(spark):
    """Splits of 700 bytes, so that most records touch a border."""
    names = {"spark.sql.files.maxPartitionBytes": "700", "spark.sql.files.openCostInBytes": "1", "spark.sql.files.minPartitionNum": "1"}
    for k, v in names.items():
        spark.conf.set(k, v)
    yield
    for k in names:
        spark.conf.unset(k)


@pytest.mark.parametrize("end", ["\n", "\r\n"])
def test_random_tables(spark, tmp_path, tiny_blocks, end):
    rng = random.Random(3)
    cell = lambda: "".join(rng.choice(['a', 'é', '"', ",", "\n", "\r\n", "\x0b", " ", " ", "日"]) for _ in range(rng.randint(0, 12)))
    rows = [["first\nname", 'the "other"'], *([cell(), cell()] for _ in range(900))]
    rows[400][1] = "x\n" * 3000  # over several blocks
    write(tmp_path / "a.csv", rows, end)
    got = read_csv(spark, str(tmp_path / "a.csv"), row_number="n")
    assert got.columns == ["n", *rows[0]]
    assert got.rdd.getNumPartitions() > 10
    assert [list(r)[1:] for r in got.orderBy("n").collect()] == rows[1:]
    assert [r.n for r in got.orderBy("n").collect()] == list(range(1, len(rows)))


def test_one_file_is_read_by_many_tasks(spark, tmp_path, tiny_blocks):
    write(tmp_path / "a.csv", [["k", "v"], *([str(i), "two\nlines"] for i in range(3000))])
    tasks = read_csv(spark, str(tmp_path / "a.csv")).groupBy(F.spark_partition_id().alias("p")).count().collect()
    assert len(tasks) > 20 and max(r["count"] for r in tasks) < 200 and sum(r["count"] for r in tasks) == 3000


@pytest.mark.parametrize(
    ("text", "why"),
    [
        ("", "header"), ("a,a\n1,2\n", "header"), ("a, \n", "header"), ("a,b\n1\n", "width"), ("a,b\n1,2,3\n", "width"),
        ('a,b\n1,"open\n2,3\n', "unexpected end"), ('a,b\n1,"x"y\n', "expected after"), ('"a,b\n', "header"),
    ],
)
def test_faults_fail_the_read(spark, tmp_path, text, why):
    (tmp_path / "a.csv").write_text(text)
    with pytest.raises(Exception, match=why):
        read_csv(spark, str(tmp_path / "a.csv")).collect()
        read_csv(spark, str(tmp_path / "a.csv")).count()


def test_marks_empty_lines_and_headers(spark, tmp_path):
    (tmp_path / "a.csv").write_text("﻿a,b\n\n1,\n")
    (tmp_path / "b.csv").write_text("a,b\n")
    assert [tuple(r) for r in read_csv(spark, str(tmp_path)).collect()] == [("1", "")]
    (tmp_path / "c.csv").write_text("a,c\n1,2\n")
    with pytest.raises(Exception, match="header"):
        read_csv(spark, str(tmp_path)).collect()
