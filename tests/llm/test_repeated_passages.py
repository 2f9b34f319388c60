"""Substring dedup at its full width: planted passages around the limit, text with a period, cut characters."""

import hashlib
import random
from collections import Counter

from paperstrata.llm import substring_dedup


def brute(texts, width=400):
    n = Counter(t[i : i + width] for t in texts for i in range(len(t) - width + 1))
    out = []
    for t in texts:
        gone = bytearray(len(t))
        for i in range(len(t) - width + 1):
            if n[t[i : i + width]] > 1:
                gone[i : i + width] = b"\1" * width
        out.append(bytes(c for c, g in zip(t, gone, strict=True) if not g))
    return out


def query(spark, tmp_path, texts):
    spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    return {r["doc_id"]: r for r in substring_dedup.op4_substring_dedup(spark, str(tmp_path)).collect()}


def test_plants(spark, tmp_path):
    rng = random.Random(5)
    words = lambda n: " ".join("".join(rng.choice("abcdefghij") for _ in range(rng.randint(2, 9))) for _ in range(n))
    plants = {size: words(200)[:size] for size in (380, 390, 400, 700)}
    texts = [f"{words(90)} {plant} {words(90)}" for plant in plants.values() for _ in range(3)] + [words(300) for _ in range(5)] + [plants[700]]
    got = query(spark, tmp_path, texts)
    for i, (t, kept) in enumerate(zip(texts, brute([t.encode() for t in texts]), strict=True)):
        r = got[i]
        assert (r["n_bytes"], r["n_removed"], r["n_kept"], r["kept_text"]) == (len(t), len(t) - len(kept), len(kept), kept.decode())
        assert r["kept_sha256"] == hashlib.sha256(kept).hexdigest()
    for size, plant in plants.items():
        found = [got[i]["kept_text"] for i, t in enumerate(texts) if plant in t and len(t) > 700]
        assert all((plant in k) == (size < 400) for k in found)


def test_periods(spark, tmp_path):
    """Runs of one byte and of short periods, over several runs' length, inside one text and in two."""
    rng = random.Random(6)
    own = lambda: "".join(rng.choice("klmnopqrst") for _ in range(500))
    texts = [own() + "a" * 9000 + own(), own() + "xyz" * 2500, own() + "-=" * 150 + own(), "b" * 401, "c" * 400, "d" * 399, "0123456789" * 41, own() + "a" * 700]
    got = query(spark, tmp_path, texts)
    for i, kept in enumerate(brute([t.encode() for t in texts])):
        assert got[i]["kept_text"] == kept.decode(), i


def test_cut_characters(spark, tmp_path):
    shared = "ä" * 3 + "".join(random.Random(8).choice("uvwxyzäö") for _ in range(400))
    texts = ["q" + "ö" + shared, "r" + "Ķ" + shared]  # ö and Ķ end in the same byte
    assert "ö".encode()[-1:] == "Ķ".encode()[-1:]
    got = query(spark, tmp_path, texts)
    for i, kept in enumerate(brute([t.encode() for t in texts])):
        assert got[i]["kept_sha256"] == hashlib.sha256(kept).hexdigest() and got[i]["n_kept"] == len(kept)
        assert got[i]["kept_text"].startswith("qr"[i])
