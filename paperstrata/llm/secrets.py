"""Secret scans: base patterns plus a randomness test battery, in DataFrame functions only.

Base spans are the matches of three patterns, leftmost and without overlap per kind. The method adds spans of kind "random":
runs of at least MIN_RUN characters of an encoding's alphabet that look drawn at random rather than written.

A run is tested whole, and so are its parts of MIN_RUN characters or more between / _ - + (all of them, and one of the pairs
+ / and - _ only), since a key may be glued to words in a URL or path. All are hypotheses of the same control. Of added spans,
those inside another one go.

Battery. The encoding (hex, base32, alphanumeric, base64) is inferred from the characters. Three tests ask how a written run
would come to look like this one, each in nats of evidence against "written":
* alphabet: the likelihood ratio of letters drawn uniformly from the encoding's against letters of written text (LETTERS);
  as a likelihood ratio exceeds e**t under the other hypothesis with probability e**-t at most, exp(-t) is a p value;
* runs: changes between lower case, upper case and digits, of which written runs have few (see ENCODINGS);
* serial dependence: vowels and consonants alternate in written letters in WRITTEN_TURNS of neighbour pairs or more.
The last two are Chernoff bounds of binomial tails, so they hold at every length. Fisher's method combines the three (which
takes them to be independent given that the run is written). Besides, chi-squared uniformity over the alphabet, the runs test
above and below its middle, and the serial correlation of neighbours must not speak against a random run; else p is 1. False
discoveries are controlled by Benjamini-Hochberg over the whole corpus within classes of encoding and length, so short runs,
which have little power, don't borrow from long ones.

Scale. One pass reads the texts and stages spans and p bins; a histogram of bins per class (bounded: BINS bins, a few hundred
classes) yields the thresholds, which are broadcast as one row. Nothing is exploded but the candidates of the histogram.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from . import common as C

#: kind: (pattern, group, least characters of the group). Greedy runs of one class need no separate length filter.
BASE = {
    "assign": ("(?i:password|passwd|secret|token|api_?key)[\"']?\\x20*[:=]\\x20*[\"']?([A-Za-z0-9+/_.=-]+)", 1, 12),
    "access": ("AKIA[A-Z0-9]{14,}", 0, 18),
    "hex": ("[0-9a-f]{16,}", 0, 16),
}
KINDS = (*BASE, "random")

MIN_RUN = 20
RUN = f"[A-Za-z0-9+/_-]{{{MIN_RUN},}}={{0,2}}"
#: Parts of a run: between all four separators, between those that base64 has not, and between those that its URL form has not.
PARTS = (f"[A-Za-z0-9]{{{MIN_RUN},}}={{0,2}}", f"[A-Za-z0-9+/]{{{MIN_RUN},}}={{0,2}}", f"[A-Za-z0-9_-]{{{MIN_RUN},}}={{0,2}}")
DIGITS, UPPER, LOWER = "0123456789", C.UPPER, C.UPPER.lower()
#: encoding: (pattern, alphabet, how many letters, in one case, it has, most changes of kind a pair of neighbours in written
#: runs: names in mixed case change at every word, those in one case between words and numbers only).
ENCODINGS = {
    "hex": ("[0-9a-f]+|[0-9A-F]+", "0123456789abcdef", 6, 0.15),
    "base32": ("[A-Z2-7]+", UPPER + "234567", 26, 0.15),
    "alnum": ("[A-Za-z0-9]+", UPPER + LOWER + DIGITS, 26, 0.3),
    "base64": ("[A-Za-z0-9+/_-]+", UPPER + LOWER + DIGITS + "+/", 26, 0.3),
}
#: Rough shares (per thousand) of a to z in written English, German, French and Spanish taken together.
LETTERS = (80, 13, 32, 42, 145, 12, 18, 32, 72, 5, 8, 45, 28, 78, 55, 22, 5, 66, 72, 68, 47, 13, 10, 3, 8, 7)
WRITTEN_TURNS = 0.5
BINS, PER_DECADE = 400, 20
BLOCK = 512


def prefix_sums(lengths: Column) -> Column:
    """Sums of all elements before each one. Arrays are built in blocks, so the cost stays near linear."""

    def block(ls: Column, start: Column, first: Column) -> Column:
        empty = F.struct(first.cast("int").alias("t"), F.array().cast("array<int>").alias("a"))
        return F.aggregate(F.slice(ls, start + 1, BLOCK), empty, lambda s, x: F.struct((s["t"] + x).cast("int").alias("t"), F.array_append(s["a"], s["t"]).alias("a")))["a"]

    def blocks(ls: Column) -> Column:
        n = F.floor((F.size(ls) - 1) / BLOCK).cast("int")
        sums = F.transform(F.sequence(F.lit(0), n), lambda b: F.aggregate(F.slice(ls, b * BLOCK + 1, BLOCK), F.lit(0), lambda s, x: (s + x).cast("int")))
        starts = F.aggregate(sums, F.struct(F.lit(0).alias("t"), F.array().cast("array<int>").alias("a")), lambda s, x: F.struct((s["t"] + x).cast("int").alias("t"), F.array_append(s["a"], s["t"]).alias("a")))["a"]
        return F.flatten(C.bind(starts, lambda st: F.transform(F.sequence(F.lit(0), n), lambda b: block(ls, b * BLOCK, F.get(st, b)))))

    return C.bind(lengths, lambda ls: F.when(F.size(ls) == 0, F.array().cast("array<int>")).otherwise(blocks(ls)))


def matches(text: Column, pattern: str, group: int = 0) -> Column:
    """start, end (code points, exclusive) and the text of ``group`` of all matches, leftmost first, without overlap."""
    kind = "array<struct<start:int,end:int,part:string>>"

    def placed(x: Column) -> Column:
        size = lambda i: F.char_length(F.get(x["gaps"], i))
        lengths = F.transform(x["all"], lambda m, i: size(i) + F.char_length(m))
        return C.bind(prefix_sums(lengths), lambda p: F.transform(x["all"], lambda m, i: F.struct((F.get(p, i) + size(i)).alias("start"), (F.get(p, i) + size(i) + F.char_length(m)).alias("end"), F.get(x["parts"], i).alias("part"))))

    whole = F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    found = F.struct(F.split(text, pattern, -1).alias("gaps"), whole.alias("all"), (F.regexp_extract_all(text, F.lit(pattern), F.lit(group)) if group else whole).alias("parts"))
    return F.when(text.rlike(pattern), C.bind(found, placed)).otherwise(F.array()).cast(kind)


def _by_encoding(enc: Column, value) -> Column:
    out = F.lit(None)
    for name, spec in ENCODINGS.items():
        out = F.when(enc == name, F.lit(value(spec))).otherwise(out)
    return out


def _evidence(x: Column, n: Column, p: Column, more: bool) -> Column:
    """-ln of the Chernoff bound of a binomial tail: x or more (or x or fewer) of n at probability p."""
    r, part = x / n, lambda q, p: F.when(q > 0, q * F.log(q / p)).otherwise(F.lit(0.0))
    return F.when((n > 0) & ((r > p) if more else (r < p)), n * (part(r, p) + part(1 - r, 1 - p))).otherwise(F.lit(0.0))


def _squeezed(s: Column) -> Column:
    return F.regexp_replace(s, "(.)\\1+", "$1")


def p_written(run: Column) -> Column:
    """encoding, n, p of a run: the p value of its being written text; 1 where a test speaks against randomness. Digits alone
    are numbers and have p 1."""
    body = F.regexp_replace(run, "=+$", "")
    enc = F.lit(None).cast("string")
    for name, (pattern, *_) in reversed(ENCODINGS.items()):
        enc = F.when(body.rlike(f"^(?:{pattern})$"), F.lit(name)).otherwise(enc)
    norm = lambda b, e: F.translate(F.when(e == "hex", F.lower(b)).otherwise(b), "-_", "+/")

    def written(b: Column, e: Column) -> Column:
        """Nats of evidence of the three tests against a written run."""
        low = F.lower(b)
        scores = F.array(F.lit(0.0), *[F.lit(math.log(1000 / 26 / x)) for x in LETTERS])
        per_letter = _by_encoding(e, lambda s: math.log(26 / s[2]))
        letters = F.translate(low, DIGITS + "+/", "")
        alphabet = F.aggregate(F.split(letters, ""), F.lit(0.0), lambda a, c: a + F.when(c == "", F.lit(0.0)).otherwise(F.get(scores, F.position(c, F.lit(LOWER))) + per_letter))
        kinds = F.translate(b, LOWER + UPPER + DIGITS + "+/", "l" * 26 + "u" * 26 + "d" * 10)
        changes = _evidence(F.char_length(_squeezed(kinds)) - 1.0, F.char_length(kinds) - 1.0, _by_encoding(e, lambda s: s[3]), True)
        sounds = F.translate(low, LOWER + DIGITS + "+/", "".join("v" if c in "aeiou" else "c" for c in LOWER) + " " * 12)
        groups = F.size(F.filter(F.split(sounds, " +"), lambda g: g != ""))
        count = lambda s: (F.char_length(F.replace(s, F.lit(" "), F.lit(""))) - groups).cast("double")
        turns = _evidence(count(_squeezed(sounds)), count(sounds), F.lit(WRITTEN_TURNS), False)
        return F.greatest(alphabet, F.lit(0.0)) + changes + turns

    def tested(x: Column) -> Column:
        n, v, b, e = F.size(x["v"]).cast("double"), x["v"], x["b"], x["e"]
        k = _by_encoding(e, lambda s: float(len(s[1])))
        count = lambda c: (F.char_length(b) - F.char_length(F.replace(b, c, F.lit("")))).cast("double")
        equal = F.aggregate(F.array_distinct(F.split(b, "")), F.lit(0.0), lambda a, c: a + count(c) * (count(c) - 1) / 2)
        pairs = n * (n - 1) / 2
        z_uniform = (equal - pairs / k) / F.sqrt(pairs / k * (1 - 1 / k))  # chi-squared is linear in the equal pairs
        above = F.aggregate(v, F.lit(0.0), lambda a, y: a + (y > k / 2).cast("double"))
        runs = F.aggregate(F.zip_with(F.slice(v, 1, F.size(v) - 1), F.slice(v, 2, F.size(v) - 1), lambda p, q: ((p > k / 2) != (q > k / 2)).cast("double")), F.lit(1.0), lambda a, y: a + y)
        mu = 2 * above * (n - above) / n + 1
        z_runs = F.when((mu - 1) * (mu - 2) > 0, (runs - mu) / F.sqrt((mu - 1) * (mu - 2) / (n - 1))).otherwise(F.lit(99.0))
        mean = F.aggregate(v, F.lit(0.0), lambda a, y: a + y) / n
        spread = F.aggregate(v, F.lit(0.0), lambda a, y: a + (y - mean) * (y - mean))
        products = F.aggregate(F.zip_with(F.slice(v, 1, F.size(v) - 1), F.slice(v, 2, F.size(v) - 1), lambda p, q: (p - mean) * (q - mean)), F.lit(0.0), lambda a, y: a + y)
        z_serial = F.when(spread > 0, products / spread * F.sqrt(n)).otherwise(F.lit(99.0))
        random = (z_uniform < 4) & (F.abs(z_runs) < 3.3) & (F.abs(z_serial) < 3.3) & ~b.rlike("^[0-9]+$")
        fisher = C.bind(written(b, e), lambda t: F.exp(-t) * (1 + t + t * t / 2))  # chi-squared of 6 degrees
        return F.struct(e.alias("encoding"), n.cast("int").alias("n"), F.when(random, fisher).otherwise(F.lit(1.0)).alias("p"))

    def values(x: Column) -> Column:
        alphabet = _by_encoding(x["e"], lambda s: s[1])
        return F.struct(x["b"].alias("b"), x["e"].alias("e"), F.transform(F.split(x["b"], ""), lambda c: F.position(c, alphabet).cast("double")).alias("v"))

    start = F.struct(norm(body, enc).alias("b"), enc.alias("e"))
    return C.bind(C.bind(start, values), tested)


def _class(encoding: Column, n: Column) -> Column:
    """Encoding and length on a logarithmic scale, four classes to a doubling."""
    return F.concat(encoding, F.lit(":"), F.floor(F.log2(n.cast("double")) * 4).cast("string"))


def scan(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", q: float = 0.01) -> DataFrame:
    """One row per input row: the id, spans (array of kind, start, end in code points, by start and then kind as in KINDS), and
    base (those of the three base kinds).

    q bounds the expected share of false ones among the added spans of each class. Added spans don't overlap base spans. Null
    and empty texts have none. Rows that repeat an id are scanned each. Empty input gives an empty result; other columns are
    ignored.
    """
    text = C.text_of(text_col)

    def base_spans(rank: int, kind: str) -> Column:
        pattern, group, least = BASE[kind]
        long_enough = F.filter(matches(text, pattern, group), lambda m: F.char_length(m["part"]) >= least)
        return F.transform(long_enough, lambda m: F.struct(m["start"].alias("start"), F.lit(rank).alias("rank"), m["end"].alias("end"), F.lit(kind).alias("kind")))

    found = [base_spans(rank, kind) for rank, kind in enumerate(BASE)]

    def candidate(m: Column) -> Column:
        return C.bind(p_written(m["part"]), lambda t: F.struct(m["start"].alias("start"), m["end"].alias("end"), _class(t["encoding"], t["n"]).alias("class"), F.least(F.floor(-F.log10(F.greatest(t["p"], F.lit(1e-300))) * PER_DECADE), F.lit(BINS)).cast("int").alias("bin")))

    def hypotheses(m: Column) -> Column:
        """The run and its parts, each span once."""
        placed = lambda p: F.struct((m["start"] + p["start"]).alias("start"), (m["start"] + p["end"]).alias("end"), p["part"].alias("part"))
        parts = F.flatten(F.array(*[F.transform(matches(m["part"], pattern), placed) for pattern in PARTS]))
        return F.when(m["part"].rlike("[/_+-]"), F.array_distinct(F.concat(F.array(m), parts))).otherwise(F.array(m))

    tested = F.transform(F.flatten(F.transform(matches(text, RUN), hypotheses)), candidate)
    own = docs.select(F.col(id_col).alias("id"), F.array_sort(F.concat(*found)).alias("base"), tested.alias("tested"))
    own = C.stage(own)
    bins = own.select(F.explode("tested").alias("t")).groupBy("t.class", "t.bin").agg(F.count(F.lit(1)).alias("n"))
    # of each class: the lowest bin whose p values are at most q times the share of tests that far out
    total, out_there = F.sum("n").over(W.partitionBy("class")), F.sum("n").over(W.partitionBy("class").orderBy(F.col("bin").desc()))
    passed = bins.withColumn("m", total).withColumn("r", out_there).filter(F.pow(F.lit(10.0), -F.col("bin") / PER_DECADE) <= q * F.col("r") / F.col("m"))
    least = passed.groupBy("class").agg(F.min("bin").alias("least"))
    as_map = least.agg(F.map_from_entries(F.collect_list(F.struct("class", "least"))).alias("limits"))  # one row; some hundred classes
    both = own.crossJoin(F.broadcast(as_map))
    free = lambda t: ~F.exists("base", lambda b: (b["start"] < t["end"]) & (t["start"] < b["end"]))
    random = F.filter("tested", lambda t: F.coalesce(t["bin"] >= F.try_element_at(F.col("limits"), t["class"]), F.lit(False)) & free(t))
    inside = lambda t, all_: F.exists(all_, lambda o: (o["start"] <= t["start"]) & (t["end"] <= o["end"]) & (o["end"] - o["start"] > t["end"] - t["start"]))
    outer = C.bind(random, lambda all_: F.filter(all_, lambda t: ~inside(t, all_)))
    added = F.transform(outer, lambda t: F.struct(t["start"].alias("start"), F.lit(len(BASE)).alias("rank"), t["end"].alias("end"), F.lit("random").alias("kind")))
    plain = lambda spans: F.transform(spans, lambda s: F.struct(s["kind"].alias("kind"), s["start"].alias("start"), s["end"].alias("end")))
    return both.select(F.col("id").alias(id_col), plain(F.array_sort(F.concat("base", added))).alias("spans"), plain(F.col("base")).alias("base"))


def joined(spans: str) -> Column:
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")


def op3_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = scan(C.documents(spark, sf_dir).select("doc_id", "text"))

    def number(kind: str) -> Column:
        return F.size(F.filter("base", lambda s: s["kind"] == kind)).cast("long").alias(f"n_{kind}")

    return found.select("doc_id", *map(number, BASE), F.sha2(joined("base"), 256).alias("base_sha256"), joined("spans").alias("spans"))
