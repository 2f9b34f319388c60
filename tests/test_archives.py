"""Archives to tables and back."""

import zipfile

import pytest

from paperstrata.sources import archives


def write(path, entries):
    with zipfile.ZipFile(path, "w") as z:
        for name, data in entries:
            z.writestr(name, data)


def test_entries_of_many_archives(spark, tmp_path):
    (tmp_path / "sub").mkdir()
    write(tmp_path / "a.zip", [("x/1.txt", b"one"), ("x/", b""), ("y", b"\x00\xff")])
    write(tmp_path / "sub/b.zip", [("x/1.txt", b"")])
    write(tmp_path / "empty.zip", [])
    (tmp_path / "c.txt").write_text("no archive")
    got = sorted((r.archive.rsplit("/", 1)[1], r.path, bytes(r.content)) for r in archives.read_archives(spark, str(tmp_path)).collect())
    assert got == [("a.zip", "x/1.txt", b"one"), ("a.zip", "y", b"\x00\xff"), ("b.zip", "x/1.txt", b"")]


@pytest.mark.parametrize("name", ["../up", "/abs", "a/../../b", "a\\b"])
def test_unsafe_entries_are_refused(spark, tmp_path, name):
    write(tmp_path / "a.zip", [("fine", b"1"), (name, b"2")])
    with pytest.raises(Exception, match="unsafe"):
        archives.read_archives(spark, str(tmp_path)).collect()


def test_links_repeats_and_damage_are_refused(spark, tmp_path):
    link = zipfile.ZipInfo("link")
    link.external_attr = 0xA1ED0000
    write(tmp_path / "a.zip", [(link, b"/etc/passwd")])
    with pytest.raises(Exception, match="unsafe"):
        archives.read_archives(spark, str(tmp_path)).collect()
    write(tmp_path / "a.zip", [("x", b"data data")])
    whole = (tmp_path / "a.zip").read_bytes()
    (tmp_path / "a.zip").write_bytes(whole.replace(b"data data", b"data dada"))
    with pytest.raises(Exception, match="CRC"):
        archives.read_archives(spark, str(tmp_path)).collect()
    twice = spark.createDataFrame([("a", "x", b"1"), ("a", "x", b"2")], "archive string, path string, content binary")
    with pytest.raises(Exception, match="repeated"):
        archives.packed(twice).collect()


def test_packing_is_repeatable(spark):
    rows = [("a", f"d/{i}", bytes([i]) * i) for i in range(50)] + [("b", "x", b"")]
    df = spark.createDataFrame(rows, "archive string, path string, content binary")
    one, two = ({r.archive: (r.entries, bytes(r.content)) for r in archives.packed(d).collect()} for d in (df, df.repartition(5)))
    assert one == two and one["a"][0] == 50
    assert sorted((r.archive, r.path, bytes(r.content)) for r in archives.unpacked(archives.packed(df)).collect()) == sorted(rows)
