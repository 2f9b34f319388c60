"""The randomness battery: p values and cutoffs by brute force, and the share of planted random strings found by length."""

import itertools
import math
import random
import re
from collections import Counter, defaultdict

import pytest
from pyspark.sql import functions as F

from paperstrata.llm import secrets

ALPHABETS = {"hex": "0123456789ABCDEF", "base32": "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567", "alnum": secrets.UPPER + secrets.LOWER + secrets.DIGITS, "base64": secrets.UPPER + secrets.LOWER + secrets.DIGITS + "+/"}


def brute(run):
    b = re.sub("=+$", "", run)
    enc = next(k for k, (pattern, *_) in secrets.ENCODINGS.items() if re.fullmatch(pattern, b))
    b = (b.lower() if enc == "hex" else b).replace("-", "+").replace("_", "/")
    _, alphabet, letters, most = secrets.ENCODINGS[enc]
    v, n, k = [alphabet.index(c) + 1 for c in b], len(b), len(alphabet)
    equal, pairs = sum(c * (c - 1) / 2 for c in Counter(b).values()), n * (n - 1) / 2
    above, runs = sum(x > k / 2 for x in v), 1 + sum((x > k / 2) != (y > k / 2) for x, y in itertools.pairwise(v))
    mu = 2 * above * (n - above) / n + 1
    z_runs = (runs - mu) / math.sqrt((mu - 1) * (mu - 2) / (n - 1)) if (mu - 1) * (mu - 2) > 0 else 99
    mean = sum(v) / n
    spread = sum((x - mean) ** 2 for x in v)
    z_serial = sum((x - mean) * (y - mean) for x, y in itertools.pairwise(v)) / spread * math.sqrt(n) if spread else 99
    if (equal - pairs / k) / math.sqrt(pairs / k * (1 - 1 / k)) >= 4 or abs(z_runs) >= 3.3 or abs(z_serial) >= 3.3 or b.isdigit():
        return enc, n, 1.0

    def evidence(x, m, p, more):
        if not m or not (x / m > p if more else x / m < p):
            return 0.0
        r = x / m
        return m * ((r * math.log(r / p) if r else 0) + ((1 - r) * math.log((1 - r) / (1 - p)) if r < 1 else 0))

    t = max(0.0, sum(math.log(1000 / letters / secrets.LETTERS[ord(c) - 97]) for c in b.lower() if c.isalpha()))
    kinds = ["l" if c.islower() else "u" if c.isupper() else "d" for c in b if c.isalnum()]
    t += evidence(sum(x != y for x, y in itertools.pairwise(kinds)), len(kinds) - 1, most, True)
    near = [(x in "aeiou", y in "aeiou") for x, y in itertools.pairwise(b.lower()) if x.isalpha() and y.isalpha()]
    t += evidence(sum(x != y for x, y in near), len(near), 0.5, False)
    return enc, n, math.exp(-t) * (1 + t + t * t / 2)


def planted(rng, lengths, each):
    word = lambda: "".join(rng.choice("eeeaaiionnrrsstthldcumpfgbw") for _ in range(rng.randint(2, 11)))
    glued = lambda: rng.choice(["_", "-", "/", ""]).join(word() for _ in range(rng.randint(3, 6)))
    rows, wanted = [], {}
    for kind, length, _ in itertools.product(ALPHABETS, lengths, range(each)):
        key = "".join(rng.choice(ALPHABETS[kind]) for _ in range(length))
        before = f"{word()} {word()} "
        wanted[len(rows)] = (kind, length, len(before), len(before) + length)
        rows.append(f"{before}{key} {word()}.")
    rows += [" ".join(rng.choice([word, word, glued])() for _ in range(30)) for _ in range(1500)]
    return rows, wanted


def test_p_values(spark):
    rng = random.Random(2)
    runs = ["".join(rng.choice(a) for _ in range(n)) for a in ALPHABETS.values() for n in (20, 23, 32, 64, 200)]
    runs += ["thequickbrownfoxjumpsoverthelazydog", "getElementByIdAndReturnItsValue", "MAX_CONNECTION_TIMEOUT_SECONDS", "static/assets/images/profile", "v20231231T235959Z-000123", "0" * 24, "ab" * 15, secrets.LOWER, "ACGTTGCATGCATCGATCGATGCA", "aGVsbG8gd29ybGQhISBoZWxsbyB3b3JsZA=="]
    got = [tuple(r) for r in spark.createDataFrame([(r,) for r in runs], "r string").select(secrets.p_written(F.col("r")).alias("p")).select("p.encoding", "p.n", "p.p").collect()]
    for run, g in zip(runs, got, strict=True):
        want = brute(run)
        assert g[:2] == want[:2] and g[2] == pytest.approx(want[2], rel=1e-9), run
    assert all(brute(r)[2] > 0.01 for r in runs[20:-1])


def test_found_by_length(spark):
    """Cutoffs by brute force; nine in ten found from 32 characters on and six in ten of 20 and 24, none of 1500 ordinary texts."""
    rng = random.Random(9)
    rows, wanted = planted(rng, (20, 24, 32, 40, 64), 40)
    q = 0.01
    got = {r["doc_id"]: [(s["start"], s["end"]) for s in r["spans"] if s["kind"] == "random"] for r in secrets.scan(spark.createDataFrame(list(enumerate(rows)), "doc_id long, text string"), q=q).collect()}
    found = defaultdict(list)
    for i, (kind, length, start, end) in wanted.items():
        found[kind, length].append((start, end) in got[i])
    share = {k: sum(v) / len(v) for k, v in found.items()}
    print({k: round(v, 2) for k, v in share.items()})
    assert not any(got[i] for i in range(len(wanted), len(rows)))
    assert all(v >= (0.9 if length >= 32 else 0.6) for (_, length), v in share.items()), share

    classes = defaultdict(list)  # whole runs and their parts, each span once
    for i, text in enumerate(rows):
        for m in re.finditer(secrets.RUN, text):
            spans = {m.span()}
            if re.search("[/_+-]", m[0]):
                spans |= {(m.start() + p.start(), m.start() + p.end()) for part in secrets.PARTS for p in re.finditer(part, m[0])}
            for a, b in spans:
                enc, n, p = brute(text[a:b])
                classes[enc, math.floor(math.log2(n) * 4)].append((math.floor(min(400, -math.log10(max(p, 1e-300)) * 20)), i, a, b))
    passed = defaultdict(set)
    for own in classes.values():
        bins = Counter(b for b, *_ in own)
        ok = [b for b in bins if 10 ** (-b / 20) <= q * sum(n for x, n in bins.items() if x >= b) / len(own)]
        for b, i, a, e in own:
            if ok and b >= min(ok):
                passed[i].add((a, e))
    for i in range(len(rows)):
        outer = {s for s in passed[i] if not any(o != s and o[0] <= s[0] and s[1] <= o[1] for o in passed[i])}
        base = [m.span() for p in (r"AKIA[A-Z0-9]{14,}", r"[0-9a-f]{16,}") for m in re.finditer(p, rows[i])]
        assert set(got[i]) == {s for s in outer if not any(b[0] < s[1] and s[0] < b[1] for b in base)}
