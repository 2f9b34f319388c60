"""Manifests, publication and cursors on literal values."""

import json

import pytest
from pyspark.sql import functions as F

from paperstrata.functions import text as T
from paperstrata.operators import catalog, checks, intake, pages, search, tree, versions


def test_manifest(spark):
    yaml = pytest.importorskip("yaml")
    assert yaml
    text = "---\nspec: v1\nitems:\n  a.pdf: {title: A}\n  b.csv: {part_of: a.pdf, pages: [2, 4], quality: {expected_rows: 3}}\n  c: {ignore: true}\n---\nbody"
    items = intake.read_items(spark, text, "v1")
    got = {r["path"]: (r["ignore"], r["fields"], r["part_of"], r["first"], r["last"], r["quality"]) for r in items.collect()}
    assert got == {"a.pdf": (False, 1, None, None, None, False), "b.csv": (False, 3, "a.pdf", 2, 4, True), "c": (True, 0, None, None, None, False)}
    there = spark.createDataFrame([("a.pdf", False), ("b.csv", False), ("c", True)], "path string, is_dir boolean")
    assert checks.manifest_faults(items, there).collect() == []
    for bad in ("no front matter", "---\nspec: v2\n---\n", "---\nspec: v1\nother: 1\n---\n", "---\r\nspec: v1\n---\n"):
        with pytest.raises(ValueError):
            intake.read_items(spark, bad, "v1")


def test_transport(spark, tmp_path):
    entry = {"namespace": "raw", "logical_path": "a", "sha256": "ab", "byte_size": 3, "media_type": "x"}
    (tmp_path / "m.json").write_text(json.dumps({"spec": "v1", "package_root": "p", "files": [entry]}, indent=1))
    assert [r.asDict() for r in intake.read_transport(spark, str(tmp_path / "m.json")).collect()] == [entry]


def test_numbered_csv(spark, tmp_path):
    (tmp_path / "a.csv").write_text("x,y\n" + "".join(f"{i},b\n" for i in range(50)))
    got = intake.read_numbered_csv(spark, str(tmp_path / "a.csv")).collect()
    assert [(r["x"], r["row_number"]) for r in sorted(got, key=lambda r: r["row_number"])] == [(str(i), i + 1) for i in range(50)]


def test_claims_and_commit(spark, tmp_path):
    heads = f"file://{tmp_path}/heads"
    assert intake.claim_head(spark, heads, "c", None, "v1") and intake.claim_head(spark, heads, "c", None, "v1")
    assert not intake.claim_head(spark, heads, "c", None, "v2") and intake.claim_head(spark, heads, "c", "v1", "v2")
    history = spark.createDataFrame([], "id string, collection_id string, parent_id string, created_at int")
    blobs = spark.createDataFrame([("aa", 1)], "sha256 string, byte_size int")
    none = blobs.limit(0)
    version = {"id": "w1", "collection_id": "d", "parent_id": None, "created_at": 1}
    with pytest.raises(ValueError):
        intake.commit(spark, heads, history, version, blobs, none)
    assert intake.commit(spark, heads, history, version, blobs, blobs).count() == 1
    with pytest.raises(versions.StaleBase):  # another writer saw the same empty history
        intake.commit(spark, heads, history, version | {"id": "w2"}, blobs, blobs)


def test_publish_folder(spark, tmp_path):
    target = f"{tmp_path}/t"
    for n in (3, 2):
        intake.publish_folder(spark, spark.range(n), target)
        assert spark.read.parquet(target).count() == n
    assert [p.name for p in tmp_path.iterdir()] == ["t"]


def test_cursor(spark):
    o = search.Options("q")
    got = spark.range(3).select(search.cursor(F.lit("p"), F.lit(o.fingerprint()), F.col("id"))).collect()
    assert [r[0] for r in got] == [search.encode_cursor("p", o, i) for i in range(3)]
    assert search.decode_cursor("p", search.Options("q", cursor=got[2][0])) == 2


def test_groups_of_long_chains(spark):
    chain = [(i, p) for i in range(200) for p in (i, i + 1)] + [(900, None), (901, 5000), (902, 5000)]
    got = {r["item"]: r["group"] for r in pages.groups(spark.createDataFrame(chain, "item long, page long")).collect()}
    assert got == {**dict.fromkeys(range(200), 0), 900: 900, 901: 901, 902: 901}


def test_deep_trees(spark):
    """Deeper than any limit of recursive SQL; cycles and orphans stay out."""
    rows = [("0", None, None, "group", "t")] + [(str(i), str(i - 1), 1, "group", "t") for i in range(1, 80)] + [("x", "y", 1, "text", "t"), ("y", "x", 1, "text", "t"), ("z", "gone", 1, "text", "t")]
    paths = tree.build_paths(spark.createDataFrame(rows, "id string, parent_id string, ordinal int, kind string, title string"))
    got = paths.select("id", F.size("tree_path")).collect()
    assert sorted(map(tuple, got)) == sorted((str(i), i + 1) for i in range(80))


def test_names_and_slugs(spark):
    df = spark.createDataFrame([(["a", " ", "a", "b", "a"], "„…“")], "n array<string>, t string")
    r = df.select(catalog.unique_names(F.col("n")), T.slug("t"), T.slug("t", "section")).first()
    assert r[0] == ["a", "Column 2", "a (2)", "b", "a (3)"] and tuple(r[1:]) == ("node", "section")
