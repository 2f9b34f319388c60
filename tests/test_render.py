"""Literal expectations of rendering, replacement and word joining."""

import random

from pyspark.sql import functions as F

from paperstrata.operators import render


def one(spark, expression, value, kind):
    return spark.createDataFrame([(value,)], f"v {kind}").select(expression(F.col("v"))).first()[0]


def test_tables(spark):
    rows = [["a", "b\\"], ["x", None], ["y"]]
    assert one(spark, render.table_text, rows, "array<array<string>>") == "| a | b\\\\ |\n| --- | --- |\n| x |  |\n| y |  |"
    assert one(spark, render.table_text, [["a|b"], ["<i>\nz"]], "array<array<string>>") == "<table><thead><tr><th>a|b</th></tr></thead><tbody><tr><td>&lt;i&gt;<br>z</td></tr></tbody></table>"
    assert one(spark, render.table_text, [["h"] * 11], "array<array<string>>").startswith("<table>")
    assert one(spark, render.table_text, [], "array<array<string>>") == ""
    assert one(spark, render.pipe_table, [["h"], ["a|b\r\nc"]], "array<array<string>>") == "| h |\n| --- |\n| a\\|b<br>c |"


def test_words(spark):
    kind = "array<struct<x0:double,y0:double,x1:double,y1:double,text:string>>"
    join = lambda *ws: one(spark, render.joined_words, [(float(x), float(y), float(x + 1), float(y + 1), t) for x, y, t in ws], kind)
    assert join((0, 0, "Netz-"), (0, 5, "ausbau"), (3, 5, "plan")) == "Netzausbau plan"
    assert join((0, 0, "Netz-"), (5, 0, "und")) == "Netz- und"
    assert join((0, 0, "MS-"), (9, 0, "Kabel")) == "MS-Kabel" and join((0, 0, "Foo-"), (1, 0, "Bar")) == "Foo-Bar"
    assert join((0, 0, " "), (0, 0, "a")) == "a" and join() == ""


def test_replacement(spark):
    docs = spark.createDataFrame([(1, "0123456789"), (2, "abc"), (3, "xyz"), (4, "pqrst")], "id long, text string")
    spans = spark.createDataFrame([(1, "p", 7, 9, "P"), (1, "p", 2, 4, "P"), (1, "q", 4, 5, "Q"), (2, "p", 0, 9, "P"), (3, "p", 0, 2, "P"), (3, "q", 1, 3, "Q")], "id long, replacement string, start int, end int, markdown string")
    got = {r["id"]: (r["text"], r["fault"]) for r in render.replaced(docs, spans).collect()}
    assert got == {1: ("01PQ569", None), 2: ("abc", "invalid span"), 3: ("xyz", "overlapping spans"), 4: ("pqrst", None)}


def test_anchors(spark):
    text = "One two three. The TABLE is here | a | b | and then four five six seven."
    df = spark.createDataFrame([(text, "x three the table is here", "and then four"), (text, "", "nowhere"), ("a b a b", "a b", "z"), (text, "six seven", "one two"), ("aa a", "a a", "")], "t string, b string, a string")
    got = [r[0] for r in df.select(render.anchors(F.col("t"), F.col("b"), F.col("a"))).collect()]
    assert got[0] is not None and text[got[0]["start"] : got[0]["end"]].strip() == text[: text.index("and then")].strip()  # x isn't there, so the begin
    assert (got[1]["start"], got[1]["end"]) == (0, len(text)) and (got[2]["start"], got[2]["end"]) == (0, 7)
    assert got[3] is None and (got[4]["start"], got[4]["end"]) == (0, 4)
    near = spark.createDataFrame([(text, "three the table is here", "and then four")], "t string, b string, a string").select(render.anchors(F.col("t"), F.col("b"), F.col("a"))).first()[0]
    assert text[near["start"] : near["end"]] == " | a | b | "


def test_groups(spark):
    rng = random.Random(1)
    texts = ["x" * rng.randint(1, 9) for _ in range(200)]
    want, size = [[]], 0
    for t in texts:
        if want[-1] and size + len(t) > 30:
            want.append([])
            size = 0
        want[-1].append(t)
        size += len(t)
    assert one(spark, lambda v: render.paragraph_groups(v, 30), texts, "array<string>") == want
    assert one(spark, render.paragraph_groups, [], "array<string>") == []
