"""The corpus operators against brute force on rows with nulls, empty and long texts, copies and clashing column names."""

import hashlib
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest

from paperstrata.llm import exact_dedup, graph, line_dedup, mixing, mphf, near_dedup, packing, quality, secrets, substring_dedup, suffixes, tokens

WS = " \t\n\x0b\x0c\r"
UP = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def words(t):
    return re.findall(r"[^\x20\x09-\x0D]+", t or "")


def rows(df):
    return [r.asDict() for r in df.collect()]


@pytest.mark.parametrize("hot, shard", [(10_000, 500_000), (11, 500_000), (10_000, 8), (12, 4)])
def test_lines(docs, corpus, monkeypatch, hot, shard):
    """One result with and without hot keys, in one shard and in many."""
    monkeypatch.setattr(line_dedup, "HOT_ROWS", hot)
    monkeypatch.setattr(line_dedup, "SHARD_ROWS", shard)
    got = {r["doc_id"]: r for r in rows(line_dedup.line_dedup(docs))}
    key = lambda line: line.strip(WS).translate(UP)
    n = Counter(k for r in corpus for k in {key(x) for x in (r[1] or "").split("\n")} if k)
    for r in corpus:
        lines = (r[1] or "").split("\n")
        kept = [x for x in lines if not key(x) or n[key(x)] < 10]
        assert (got[r[0]]["n_lines"], got[r[0]]["n_dropped"], got[r[0]]["kept_text"]) == (len(lines), len(lines) - len(kept), "\n".join(kept))
        assert got[r[0]]["text"] == r[1] and got[r[0]]["h"] == "h"


def test_lines_of_repeated_rows(spark):
    """Rows that repeat an id, or id and text, or have none; all lines of a text gone; a text of very many lines."""
    long = "\n".join(f"line {i % 7}\n{i}" for i in range(20_000))
    rows_ = [(1, "a\nA \nb"), (1, "a\nA \nb"), (1, "a"), (None, "b"), (None, None), (2, "c\n\n"), (3, long), (4, long.upper())]
    got = rows(line_dedup.line_dedup(spark.createDataFrame(rows_, "doc_id long, text string"), min_docs=3))
    seen = Counter((r["doc_id"], r["text"], r["n_lines"], r["n_dropped"], r["kept_text"]) for r in got)
    n = Counter(k for _, t in rows_ for k in {x.strip(WS).translate(UP) for x in (t or "").split("\n")} if k)
    want = Counter()
    for i, t in rows_:
        kept = [x for x in (t or "").split("\n") if n[x.strip(WS).translate(UP)] < 3]
        want[i, t, len((t or "").split("\n")), len((t or "").split("\n")) - len(kept), "\n".join(kept)] += 1
    assert seen == want


def test_perfect_hash():
    rng = np.random.default_rng(1)
    a, b = (rng.integers(1 << 63, size=5000, dtype=np.uint64) for _ in range(2))
    n = (np.arange(5000) % 200).astype(np.uint8)
    shards = []
    for s in range(4):
        own = mphf.shard_of(a, 2) == s
        shards.append((s, *mphf.build(a[own], b[own], n[own])))
    index = mphf.Index(2, shards, np.uint8)
    assert len(index.counts) == 5000 and (index.probe(a, b) == n).all() and not index.probe(b, a).any()


def brute_exact(corpus, largest):
    groups = defaultdict(list)
    for r in corpus:
        groups[(r[1] or "").translate(UP)].append(r[0])
    best = max if largest else min
    return {i: (best(ids), len(ids), i == best(ids), hashlib.sha256(t.encode()).hexdigest()) for t, ids in groups.items() for i in ids}


@pytest.mark.parametrize("weak", [False, True])
def test_exact(docs, corpus, weak):
    from pyspark.sql import functions as F

    hasher = (lambda t: F.unhex(F.substring(F.md5(t), 1, 1 + 1))) if weak else exact_dedup.content_hash
    for keep in ("smallest", "largest"):
        got = exact_dedup.assign(docs, keep=keep, hasher=hasher)
        assert {r["doc_id"]: (r["keep_id"], r["group_size"], r["kept"], r["text_sha256"]) for r in rows(got)} == brute_exact(corpus, keep == "largest")


def test_exact_repeated_rows(spark, docs, corpus):
    twice = docs.unionByName(docs)
    kept = exact_dedup.exact_dedup(twice)
    assert kept.columns == docs.columns
    assert Counter(r["doc_id"] for r in rows(kept)) == Counter(i for i, x in brute_exact(corpus, False).items() if x[2])


def brute_near(corpus, percent):
    sets = {}
    for r in corpus:
        w = [x.translate(UP) for x in words(r[1])]
        sets[r[0]] = {tuple(w[i : i + 5]) for i in range(len(w) - 4)} if len(w) >= 5 else ({tuple(w)} if w else set())
    root = {i: i for i in sets}

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    ids = sorted(sets)
    for i in ids:
        for j in ids:
            if i < j and sets[i] and sets[j] and 100 * len(sets[i] & sets[j]) >= percent * len(sets[i] | sets[j]):
                a, b = sorted((find(i), find(j)))
                root[b] = a
    return {i: (len(sets[i]), find(i), find(i) == i) for i in ids}


@pytest.mark.parametrize("settings", [{}, {"k": 16, "shared": 6, "list_size": 2, "rounds": 1}])
def test_near(docs, corpus, settings):
    got = near_dedup.components(docs, percent=85, **settings)
    assert {r["doc_id"]: (r["n_shingles"], r["component_id"], r["kept"]) for r in rows(got)} == brute_near(corpus, 85)


def test_shared_values():
    from math import comb

    for k, percent in ((48, 85), (48, 80), (64, 70)):
        n, p = near_dedup.shared_values(k, percent), percent / 100
        chance = lambda m: sum(comb(k, i) * p**i * (1 - p) ** (k - i) for i in range(m))  # noqa: E731, B023
        assert chance(n) <= near_dedup.MISS < chance(n + 1)


def test_near_keeps_one(docs, corpus):
    kept = near_dedup.near_dedup(docs, percent=80)
    assert kept.columns == docs.columns
    assert sorted(r["doc_id"] for r in rows(kept)) == sorted(i for i, x in brute_near(corpus, 80).items() if x[2])


def test_components(spark):
    edges = spark.createDataFrame([(i + 1, i) for i in range(1, 40)] + [(100, 101), (7, 7)], "a long, b long")
    assert {r["node"]: r["root"] for r in rows(graph.components(edges))} == {**dict.fromkeys(range(1, 41), 1), 100: 100, 101: 100}


def brute_repeats(corpus, width):
    data = {r[0]: (r[1] or "").encode() for r in corpus}
    n = Counter(t[i : i + width] for t in data.values() for i in range(len(t) - width + 1))
    out = {}
    for i, t in data.items():
        gone = bytearray(len(t))
        for s in range(len(t) - width + 1):
            if n[t[s : s + width]] > 1:
                gone[s : s + width] = b"\1" * width
        kept = bytes(c for c, g in zip(t, gone, strict=True) if not g)
        out[i] = (len(t), sum(gone), len(re.findall(b"\1+", bytes(gone))), kept)
    return out


@pytest.mark.parametrize("hot", [64 << 20, 300])
def test_substrings(docs, corpus, hot):
    got = substring_dedup.substring_dedup(docs, width=120, shard_bytes=3000, hot_bytes=hot)
    assert {r["doc_id"]: (r["n_bytes"], r["n_removed"], r["n_spans"], bytes(r["kept"])) for r in rows(got)} == brute_repeats(corpus, 120)


def test_suffix_array():
    rng = np.random.default_rng(3)
    for trial in range(150):
        t = rng.integers(0, 1 + trial % 4, size=rng.integers(1, 70)).astype(np.uint8)
        if trial % 3 == 0:
            t = np.tile(t, 3)
        b, n = t.tobytes(), len(t)
        order = sorted(range(n), key=lambda i: b[i:])
        assert suffixes.suffix_array(t, n + 2).tolist() == order
        common = lambda x, y: next((c for c in range(n) if x + c >= n or y + c >= n or b[x + c] != b[y + c]), n)
        assert suffixes.common_prefixes(t, np.array(order), n + 1).tolist() == [0, *[common(x, y) for x, y in zip(order, order[1:], strict=False)]]


def test_tokens_and_packing(docs, corpus):
    import tokenizers

    library = tokenizers.Tokenizer.from_file(tokens.tokenizer_path())
    ids = {r[0]: library.encode(r[1] or "", add_special_tokens=False).ids for r in corpus}
    for r in rows(tokens.count_tokens(docs, limit=50)):
        assert (r["n_tokens"], r["n_bytes"], r["over_limit"]) == (len(ids[r["doc_id"]]), len((r["text"] or "").encode()), len(ids[r["doc_id"]]) > 50)
    pieces = rows(packing.pack(docs, capacity=256))
    for i, own in ids.items():
        mine = sorted((p for p in pieces if p["doc_id"] == i), key=lambda p: p["start"])
        assert sum((packing.as_ids(bytes(p["ids"])) for p in mine), []) == [*own, 1] and {p["doc_tokens"] for p in mine} == {len(own) + 1}
    sequences = defaultdict(list)
    for p in pieces:
        sequences[p["sequence_id"]].append((p["offset"], p["length"]))
    for own in sequences.values():
        at = 0
        for offset, length in sorted(own):
            assert offset == at
            at += length
        assert at <= 256 and at & (at - 1) == 0
    crc = packing.digest(packing.pack(docs.filter("doc_id = 3"))).first()
    assert crc["ids_crc32"] == zlib.crc32(np.array(([*ids[3], 1])[crc["start"] : crc["start"] + crc["length"]], "<u4").tobytes())


def test_transducer_edges():
    texts = ["", "  ", "<|endoftext|>x The<|startoftext|>", "H̱ Å Ångström it's I'LL don't 'S..,! 123abc", "x" * 700 + " y" * 300, "a" * 255 + " " + "b" * 256 + " " + "c" * 257, "\x1c\x85 　", "<|EndOfText|> <| a", "é.", "İstanbul ΣΑΣ ﬁ"]
    for states in (tokens.MAX_STATES, 500):
        counter = tokens.Counter(tokens.tokenizer_path(), states)
        for _ in range(3):
            assert counter([t.encode() for t in texts]) == [len(counter.words.library.encode(t, add_special_tokens=False).ids) for t in texts]


def test_secrets(docs, corpus, spark):
    from pyspark.sql import functions as F

    got = {r["doc_id"]: r for r in rows(secrets.scan(docs))}
    for r in corpus:
        t, base = r[1] or "", []
        for rank, (kind, pattern, group, least) in enumerate([("assign", r"""(?i:password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 1, 12), ("access", "AKIA[A-Z0-9]+", 0, 18), ("hex", "[0-9a-f]+", 0, 16)]):
            base += [(m.start(), rank, m.end(), kind) for m in re.finditer(pattern, t) if len(m[group]) >= least]
        assert [(s["kind"], s["start"], s["end"]) for s in got[r[0]]["base"]] == [(k, a, b) for a, _, b, k in sorted(base)]
        assert all(s in got[r[0]]["spans"] for s in got[r[0]]["base"])
    runs = spark.createDataFrame([("The9fXq2LmZ81KpWvB7sNcR4tYhG3dJx",), ("thisisaverylongordinarywordjoinedtogether",), ("0123456789" * 4,), ("a" * 30,)], "r string")
    p = [r[0] for r in runs.select(secrets.p_written(F.col("r"))["p"]).collect()]
    assert p[0] < 0.001 and min(p[1:]) > 0.5
    many = spark.createDataFrame([(i, f"key {hashlib.sha256(str(i).encode()).hexdigest().upper()} and words{'long' * 6}") for i in range(60)], "doc_id long, text string")
    found = rows(secrets.scan(many))
    assert sum(any(s["kind"] == "random" for s in r["spans"]) for r in found) > 40 and all(s["end"] <= 68 for r in found for s in r["spans"])


def test_quality_counts(docs, corpus, spark):
    labels = spark.createDataFrame([(0, 1, 0), (4, None, 0), (4, 1, 0), (999, 1, 0)], "doc_id long, quality int, toxic int")
    got = {r["doc_id"]: r for r in rows(quality.judge(docs, labels))}
    for r in corpus:
        w = words(r[1])
        grams = Counter(zip(w, w[1:], w[2:], strict=False))
        covered = {i + o for i in range(len(w) - 2) if grams[tuple(w[i : i + 3])] > 1 for o in range(3)}
        lines = [x for x in (r[1] or "").split("\n") if x.strip(WS)]
        want = (len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", r[1] or "")), len(lines) - len(set(lines)), len(covered))
        g = got[r[0]]
        assert (g["n_words"], g["word_chars"], g["n_symbols"], g["n_dup_lines"], g["n_repeat_words"]) == want
        assert g["base_failed"] == (len(w) < 50 or 100 * len(covered) > 50 * len(w)) and g["kept"] == (not g["base_failed"])


def test_binomial_and_cutoffs(spark):
    from pyspark.sql import functions as F

    df = spark.createDataFrame([(0, 100), (3, 500), (20, 2000)], "x long, n long")
    got = [r[0] for r in df.select(quality.log_binomial_tail(F.col("x"), F.col("n"), 0.01)).collect()]
    from math import comb, log

    assert got == pytest.approx([log(sum(comb(n, i) * 0.01**i * 0.99 ** (n - i) for i in range(x + 1))) for x, n in ((0, 100), (3, 500), (20, 2000))])
    counts = dict.fromkeys(quality.COUNTS, 0) | {"n_words": 100, "word_chars": 500, "n_lines": 10}
    held = [(i, "en" if i < 3000 else "rare", *[80 if c == "n_symbols" and i % 500 == 0 else counts[c] for c in quality.COUNTS]) for i in range(3020)]
    measured = spark.createDataFrame(held, "id long, stratum string, " + ", ".join(f"{c} long" for c in quality.COUNTS))
    good = spark.createDataFrame([(i, 1) for i in range(3020)], "id long, good int")
    cuts = {r["stratum"]: r for r in quality.cutoffs(measured, good).collect()}
    assert "rare" not in cuts  # twenty labels certify nothing
    assert cuts["en"]["level"] == 7 and (cuts["en"]["cut_symbols"], cuts["en"]["cut_marks"]) == (0.05, 0.15)  # 6 of 3000 rejected


def test_levels_by_brute_force(spark):
    """The level of each stratum by exact binomial sums over counts of all levels, with strata that certify some, none, all."""
    from math import comb
    import random

    rng, held, strata = random.Random(4), [], {"a": (600, 0.2), "b": (300, 0.05), "c": (90, 0.0), "d": (150, 0.0), None: (1000, 0.6)}
    for name, (n, spread) in strata.items():
        for _ in range(n):
            counts = {"n_words": 100, "word_chars": 500, "n_lines": 20, "n_symbols": int(rng.random() ** 12 * 110 * spread), "n_dup_lines": int(rng.random() ** 20 * 19 * spread)}
            held.append((len(held), name, *[counts.get(c, 0) for c in quality.COUNTS]))
    measured = spark.createDataFrame(held, "id long, stratum string, " + ", ".join(f"{c} long" for c in quality.COUNTS))
    good = spark.createDataFrame([(r[0], 1) for r in held], "id long, good int")
    got = {r["stratum"]: r["level"] for r in quality.cutoffs(measured, good).collect()}
    able = {s for s, (n, _) in strata.items() if 0.97**n <= 0.05}
    want = {}
    for s in able:
        own = [dict(zip(quality.COUNTS, r[2:], strict=True)) for r in held if r[1] == s]
        for k in range(quality.LEVELS):
            x = sum(any(o[b] and o[t] / o[b] > cs[k] for t, b, cs in quality.RULES.values()) for o in own)
            tail = sum(comb(len(own), i) * 0.03**i * 0.97 ** (len(own) - i) for i in range(x + 1))
            if x >= 0.03 * len(own) or tail > 0.05 / len(able):
                break
            want[s] = k + 1
    assert got == want and "c" not in got and len(set(got.values())) > 1


def test_mixing(docs, corpus, spark):
    got = {r["doc_id"]: r for r in rows(mixing.plan(docs))}
    sizes = Counter()
    for r in corpus:
        sizes[r[3]] += len(words(r[1]))
    order = sorted((s for s in sizes if s is not None)) + [None]
    weight = {s: (5, 2, 1)[i % 3] for i, s in enumerate(order)}
    total, target = sum(sizes.values()), dict.fromkeys(order, 0.0)
    full = set()
    while True:
        left = total - sum(3 * sizes[s] for s in full)
        live = [s for s in order if s not in full]
        target = {s: 3 * sizes[s] if s in full else left * weight[s] / sum(weight[x] for x in live) for s in order}
        over = {s for s in live if target[s] > 3 * sizes[s]}
        if not over:
            break
        full |= over
    for r in corpus:
        g = got[r[0]]
        assert g["size"] == len(words(r[1])) and g["source_size"] == sizes[r[3]] and g["target"] == pytest.approx(target[r[3]]) and g["taken"] <= 3 * g["size"] and g["copies"] in (int(g["rate"]), int(g["rate"]) + 1)
    taken, largest = Counter(), Counter()
    for r in corpus:
        taken[r[3]] += got[r[0]]["taken"]
        largest[r[3]] = max(largest[r[3]], got[r[0]]["size"])
    assert all(abs(taken[s] - target[s]) <= largest[s] + 1e-6 for s in order)
    many = Counter(r["doc_id"] for r in rows(mixing.mix(docs)))
    assert {i: g["copies"] for i, g in got.items() if g["copies"]} == dict(many)


@pytest.mark.parametrize("cell_rows", [50_000, 4])
def test_mixing_draws(spark, monkeypatch, cell_rows):
    """Taken words near their targets with few rows a cell too; each document is drawn about as often as the fraction says."""
    monkeypatch.setattr(mixing, "CELL_ROWS", cell_rows)
    rows_ = [(i, "w " * (1 + i * i % 37), f"s{i % 5}") for i in range(300)] + [(7, "w w", "s1"), (None, "w", "s2"), (400, None, "s3")]
    docs = spark.createDataFrame(rows_, "doc_id long, text string, source string")
    drawn = Counter()
    for seed in map(str, range(12 if cell_rows > 4 else 2)):
        got = rows(mixing.plan(docs, seed=seed))
        assert len(got) == len(rows_)
        for s in {r["source"] for r in got}:
            own = [r for r in got if r["source"] == s]
            assert abs(sum(r["taken"] for r in own) - own[0]["target"]) <= max(r["size"] for r in own) + 1e-6
            drawn[s] += sum(r["copies"] for r in own) / len(own)
    if cell_rows > 4:
        rate = {r["source"]: r["rate"] for r in got}
        assert all(abs(drawn[s] / 12 - rate[s]) < 0.1 for s in rate)


def test_empty(empty, spark):
    labels = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    for df in (
        line_dedup.line_dedup(empty), exact_dedup.assign(empty), exact_dedup.exact_dedup(empty), near_dedup.components(empty), near_dedup.near_dedup(empty), substring_dedup.substring_dedup(empty),
        tokens.count_tokens(empty), packing.pack(empty), secrets.scan(empty), quality.judge(empty, labels), quality.keep_good(empty, labels), mixing.plan(empty), mixing.mix(empty),
    ):
        assert df.collect() == []
