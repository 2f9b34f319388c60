"""Byte-level BPE against the library, on words, documents and other vocabularies."""

import base64
import hashlib
import random
import re
import struct

import pytest
import tiktoken
from pyspark.sql import functions as F

from paperstrata.llm import byte_bpe as B


@pytest.fixture(scope="module")
def vocabulary():
    return B.public_vocabulary()


@pytest.fixture(scope="module")
def library(vocabulary):
    return tiktoken.Encoding("own", pat_str=vocabulary.pattern, mergeable_ranks=vocabulary.ranks, special_tokens={})


@pytest.fixture(scope="module")
def texts():
    rng = random.Random(1)
    pick = lambda letters, n: "".join(rng.choice(letters) for _ in range(n))
    out = [None, "", "a", "hello world", "İstanbul ß  \n\n x", "\x00\x01 a\x01b \x7f", "日本語のテキスト", "'s 're don't 'LL", "   ", "a　b c\u0085d᠎e", "<|endoftext|>", "﻿​ x", "é ﬁ \U0001f44d\U0001f3fd‍", "٢٣ ½Ⅷ a1b2", "\r\n\t \r"]
    out += ["x" * 1000, "ab" * 700, "abc" * 900, "日本" * 400, "!" * 3000, " " * 3000 + "x", "\n" * 999, "👍🏽" * 300]
    out += [pick("abcdefgh", 5000), pick("etaoin", 257), pick("etaoin", 256), pick("01", 2000), "".join(chr(rng.randint(0x4E00, 0x9FFF)) for _ in range(3000))]
    out += [" ".join(pick("etaoinshrdluéßñж", rng.randint(1, 14)) for _ in range(400)) for _ in range(8)]
    return out + ["hello world", "hello world"]


def encoded(spark, texts, vocabulary):
    df = spark.createDataFrame([(i, t, 5) for i, t in enumerate(texts)], "doc_id long, text string, word int").withColumn("slot", F.lit("x"))
    out = B.encode(df, vocabulary).withColumn("back", B.decoded(vocabulary, F.col("ids")))
    assert out.columns == ["doc_id", "text", "word", "slot", "ids", "back"]
    return {r.doc_id: r for r in out.collect()}


def test_ids_and_bytes(spark, texts, vocabulary, library):
    got = encoded(spark, texts, vocabulary)
    assert len(got) == len(texts)
    for i, text in enumerate(texts):
        assert got[i].ids == library.encode_ordinary(text or ""), (i, (text or "")[:40])
        assert bytes(got[i].back) == (text or "").encode()


def test_words_that_lose_their_slot(spark, texts, vocabulary, library, monkeypatch):
    """With four slots nearly every word is folded where it stands."""
    monkeypatch.setattr(B, "SLOTS", 4)
    some = texts[:15] + texts[-3:]
    got = encoded(spark, some, vocabulary)
    assert [got[i].ids for i in range(len(some))] == [library.encode_ordinary(t or "") for t in some]
    assert B.known_words(spark.createDataFrame([(t,) for t in some], "text string"), vocabulary).count() <= 4


def test_windows_that_do_not_meet(spark, vocabulary, library, monkeypatch):
    """Windows barely longer than pieces: wrong ends show and windows grow."""
    monkeypatch.setattr(B, "WINDOW", 8)
    rng = random.Random(4)
    words = ["".join(rng.choice(a) for _ in range(n)) for a in ("etaoinsh", "ab", "thegin", "日本語東京大学") for n in (9, 30, 200)] + ["a" * 100, "internationalization" * 9]
    got = encoded(spark, words, vocabulary)
    assert [got[i].ids for i in range(len(words))] == [library.encode_ordinary(w) for w in words]


def test_ranks_that_fall(spark, tmp_path):
    """A vocabulary whose longer pieces rank below the pieces they are made of, and that can't make some of its pieces."""
    pieces = [bytes([i]) for i in range(256)]
    ranked = [b"bcd", b"ab", b"cd", b"abcd", b"bc", b"aab", b"aa", b"aaa", b"da", b"abc", b"xyzw"]
    path = tmp_path / "odd.tiktoken"
    path.write_bytes(b"\n".join(base64.b64encode(p) + f" {i}".encode() for i, p in enumerate(ranked + pieces)))
    own = B.Vocabulary(str(path), B.public_vocabulary().pattern)
    library = tiktoken.Encoding("odd", pat_str=own.pattern, mergeable_ranks=own.ranks, special_tokens={})
    rng = random.Random(9)
    words = ["".join(rng.choice("abcdxyzw") for _ in range(n)) for n in (1, 2, 3, 4, 5, 6, 7, 8, 9, 10, 20, 40, 300, 900)] + ["abcd", "xyzw", "aaaa", "aabcd"] + ["".join(rng.choice("abcd") for _ in range(7)) for _ in range(60)]
    got = encoded(spark, words, own)
    assert [got[i].ids for i in range(len(words))] == [library.encode_ordinary(w) for w in words]


def test_digests(spark, vocabulary, library):
    rows = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select("doc_id", "text").collect()
    got = {r.doc_id: r for r in B.op12_byte_bpe(spark, "/root/testdata/sf0.001").collect()}
    assert len(got) == len(rows)
    for r in rows:
        ids = library.encode_ordinary(r.text or "")
        assert got[r.doc_id].n_tokens == len(ids)
        assert got[r.doc_id].ids_sha256 == hashlib.sha256(struct.pack(f"<{len(ids)}I", *ids)).hexdigest()
        assert got[r.doc_id].decoded_sha256 == hashlib.sha256((r.text or "").encode()).hexdigest()


def test_java_classes(spark, vocabulary, library):
    """Code points of all planes are cut as the library cuts them, those that Java's Unicode lacks included."""
    newer = [int(x, 16) for k in "LN" for x in re.findall(r"\\x\{(\w+)\}", B.unknown_to_java(k))]
    points = sorted({*range(0, 0x110000, 97), *newer, *(c + 1 for c in newer), *range(0x2000, 0x2070)} - set(range(0xD800, 0xE000)))
    texts = ["".join(f"a{chr(c)}1 {chr(c)}" for c in points[k : k + 300]) for k in range(0, len(points), 300)]
    got = encoded(spark, texts, vocabulary)
    assert [i for i, t in enumerate(texts) if got[i].ids != library.encode_ordinary(t)] == []


def test_empty(spark, vocabulary):
    assert B.encode(spark.createDataFrame([], "doc_id long, text string"), vocabulary).collect() == []
