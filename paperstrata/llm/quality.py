"""Quality rules with risk-controlled thresholds, in DataFrame functions only.

Base rules need no labels: fewer than 50 words, or more than half of the words in repeated three-word windows.

Method. Further rules compare a ratio with a cutoff that labelled holdouts choose per stratum (by default the language). The
cutoffs of all rules are tightened together, level by level from mild to strict, so there is one sequence of tests a stratum
and each test has the whole allowance: a level is certified if, of the n good holdout rows of the stratum, all rules together
reject so few (x) that a false-rejection rate of max_false_rejection would give x or fewer with probability at most delta':
the exact binomial (Clopper-Pearson) upper bound lies below max_false_rejection. The last level before the first that is not
certified holds. Testing the levels in fixed order needs no correction; across strata delta is divided by the number of those
that have enough good rows to certify anything at all (Bonferroni; that number doesn't depend on what the rules reject), so
with probability 1 - delta no stratum loses more than max_false_rejection of its good documents to the rules. A stratum with
too few labels (98 good ones at the default settings, more with several strata) certifies nothing and is held to the base
rules only.

Scale. One pass over the texts writes a row of counts per document; labels are joined to those rows, never to texts. The
table of cutoffs has a row per stratum. It is broadcast if it was counted to be small, else joined by shuffle.
"""

from __future__ import annotations

import functools
import math

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from . import common as C

SYMBOLS = "[#*$%&|<>]"
MIN_WORDS = 50
BROADCAST_STRATA = 50_000

COUNTS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_lines", "n_upper", "n_marks")

#: rule: (numerator, denominator, its cutoff at each level, from mild to strict); a row is rejected if the ratio is above it.
RULES = {
    "symbols": ("n_symbols", "n_words", (1.0, 0.7, 0.5, 0.3, 0.2, 0.1, 0.05)),
    "duplicate_lines": ("n_dup_lines", "n_lines", (0.9, 0.7, 0.6, 0.5, 0.4, 0.3, 0.2)),
    "repeated_words": ("n_repeat_words", "n_words", (0.5, 0.45, 0.4, 0.35, 0.3, 0.25, 0.2)),
    "upper_case": ("n_upper", "word_chars", (0.9, 0.7, 0.6, 0.5, 0.4, 0.3, 0.2)),
    "marks": ("n_marks", "word_chars", (0.6, 0.5, 0.4, 0.3, 0.25, 0.2, 0.15)),
}
LEVELS = 7
MAX_FALSE_REJECTION, DELTA = 0.03, 0.05


def repeat_words(words: Column, size: Column) -> Column:
    """How many words lie in a three-word window that occurs at least twice among the ``size`` words, its first occurrence
    included. Windows are sorted by hash with their positions; equal neighbours are the repeated ones."""
    window = lambda i: F.struct(F.xxhash64(F.get(words, i), F.get(words, i + 1), F.get(words, i + 2)).alias("h"), i.alias("p"))
    windows = F.transform(F.sequence(F.lit(0), size - 3), window)

    def repeated(s: Column) -> Column:
        return F.transform(F.filter(s, lambda x, i: (F.get(s, i - 1)["h"] == x["h"]) | (F.get(s, i + 1)["h"] == x["h"])), lambda x: x["p"])

    def covered(p: Column) -> Column:
        return F.aggregate(F.transform(p, lambda v, i: F.least(F.lit(3), F.coalesce(F.get(p, i + 1) - v, F.lit(3)))), F.lit(0), lambda a, x: a + x)

    def count(w: Column) -> Column:
        return F.when(F.size(F.array_distinct(F.transform(w, lambda x: x["h"]))) == F.size(w), F.lit(0)).otherwise(C.bind(F.array_sort(C.bind(F.array_sort(w), repeated)), covered))

    return F.when(size < 3, F.lit(0)).otherwise(C.bind(windows, count))


def measure(text: Column) -> Column:
    """A struct of COUNTS (long) for a text; a null text has none of anything."""
    text = C.text_of(text)

    def lines(ls: Column) -> Column:
        return F.struct(F.size(ls).alias("n_lines"), (F.size(ls) - F.size(F.array_distinct(ls))).alias("n_dup_lines"))

    line_counts = C.bind(F.filter(F.split(text, "\n", -1), lambda x: C.strip_spaces(x) != ""), lines)
    word_counts = C.bind(C.words_of(text), lambda w: F.struct(F.size(w).alias("n_words"), F.char_length(F.array_join(w, "")).alias("word_chars"), repeat_words(w, F.size(w)).alias("n_repeat_words")))
    length = F.char_length(text)
    without = lambda pattern: (length - F.char_length(F.regexp_replace(text, pattern, "")))
    both = F.struct(word_counts.alias("w"), line_counts.alias("l"))
    own = {"n_symbols": without(SYMBOLS), "n_upper": without("\\p{Lu}"), "n_marks": without("[^\\p{L}\\p{N}\\x20\\x09-\\x0D]")}
    return C.bind(both, lambda b: F.struct(*[(own[c] if c in own else b["l"][c] if "line" in c else b["w"][c]).cast("long").alias(c) for c in COUNTS]))


def base_failed(c=F.col) -> Column:
    return (c("n_words") < MIN_WORDS) | (100 * c("n_repeat_words") > 50 * c("n_words"))


def ratio(rule: str, c=F.col) -> Column:
    top, bottom, _ = RULES[rule]
    return F.when(c(bottom) > 0, c(top) / c(bottom)).otherwise(F.lit(0.0))


def log_binomial_tail(x: Column, n: Column, p: float) -> Column:
    """ln P(X <= x) for X binomial with n trials of probability p, summed term by term in logarithms."""
    first = F.struct((n * F.log1p(F.lit(-p))).alias("term"), (n * F.log1p(F.lit(-p))).alias("total"))
    odds = F.log(F.lit(p)) - F.log1p(F.lit(-p))

    def add(acc: Column, i: Column) -> Column:
        term = acc["term"] + F.log(n - i + 1) - F.log(i) + odds
        top = F.greatest(term, acc["total"])
        return F.struct(term.alias("term"), (top + F.log(F.exp(term - top) + F.exp(acc["total"] - top))).alias("total"))

    steps = F.when(x >= 1, F.sequence(F.lit(1).cast("long"), x)).otherwise(F.array().cast("array<bigint>"))
    return F.aggregate(steps, first, add)["total"]


def cutoffs(measured: DataFrame, labelled: DataFrame, max_false_rejection: float = MAX_FALSE_REJECTION, delta: float = DELTA) -> DataFrame:
    """stratum, level (1 to LEVELS) and, per rule, its cutoff at the last certified level, from measured rows (id, stratum,
    COUNTS) and labels (id, good); strata that certify none are left out.

    Rows that fail the base rules don't count: the other rules never see them. A document with several labels is good only
    if all say so; null labels are no labels.
    """
    good = labelled.filter(F.col("good").isNotNull()).groupBy("id").agg(F.min("good").alias("good")).filter(F.col("good") == 1).select("id")
    held = measured.filter(~base_failed()).join(good, "id", "left_semi")
    rejected = lambda k: functools.reduce(Column.__or__, [ratio(r) > cs[k] for r, (_, _, cs) in RULES.items()])
    sums = held.groupBy("stratum").agg(F.count(F.lit(1)).alias("n"), *[F.sum(rejected(k).cast("long")).alias(f"x_{k}") for k in range(LEVELS)])
    sums = sums.filter(F.col("n") * math.log1p(-max_false_rejection) <= math.log(delta))
    strata = sums.agg(F.count(F.lit(1)).alias("strata"))
    out = sums.crossJoin(F.broadcast(strata))  # one row of one number
    test = F.log(F.lit(delta) / F.col("strata"))
    level = F.lit(0)
    for k in reversed(range(LEVELS)):
        certified = (F.col(f"x_{k}") < F.col("n") * max_false_rejection) & (log_binomial_tail(F.col(f"x_{k}"), F.col("n"), max_false_rejection) <= test)
        level = F.when(certified, F.when(level > 0, level).otherwise(F.lit(k + 1))).otherwise(F.lit(0))
    out = out.withColumn("level", level).filter("level > 0")
    return out.select("stratum", "level", *[F.element_at(F.array(*map(F.lit, cs)), F.col("level")).alias(f"cut_{r}") for r, (_, _, cs) in RULES.items()])


def judge(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", stratum_col: str = "lang", quality_col: str = "quality", max_false_rejection: float = MAX_FALSE_REJECTION, delta: float = DELTA) -> DataFrame:
    """One row per input row: the id, COUNTS, base_failed, reasons (rules of the method that reject it), kept.

    Null text has no words and so fails; null is a stratum of its own; rows that repeat an id are judged each by its text.
    Labels of ids without a document, and documents without labels, are fine; without labels only the base rules hold. Other
    columns are ignored. Empty input gives an empty result.
    """
    m = docs.select(F.col(id_col).alias("id"), F.col(stratum_col).cast("string").alias("stratum"), measure(F.col(text_col)).alias("m"))
    measured = C.stage(m.select("id", "stratum", *[f"m.{c}" for c in COUNTS]))
    cuts = cutoffs(measured, labels.select(F.col(id_col).alias("id"), F.col(quality_col).alias("good")), max_false_rejection, delta)
    cuts = C.maybe_broadcast(C.stage(cuts).withColumnRenamed("stratum", "cut_stratum"), BROADCAST_STRATA)
    joined = measured.join(cuts, measured["stratum"].eqNullSafe(F.col("cut_stratum")), "left")
    reasons = F.array_compact(F.array(*[F.when(ratio(r) > F.col(f"cut_{r}"), F.lit(r)) for r in RULES]))
    out = joined.withColumn("base_failed", base_failed()).withColumn("reasons", F.when(F.col("base_failed"), F.array().cast("array<string>")).otherwise(reasons))
    return out.select(F.col("id").alias(id_col), *COUNTS, "base_failed", "reasons", (~F.col("base_failed") & (F.size("reasons") == 0)).alias("kept"))


def keep_good(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", stratum_col: str = "lang", **settings) -> DataFrame:
    """``docs`` without the rows that ``judge`` rejects; columns as they are. Texts are measured once, staged with their counts,
    and not shuffled: cutoffs come to the rows."""
    m, cut_stratum = C.fresh(docs, "m", "cut_stratum")
    own = C.stage(docs.withColumn(m, measure(F.col(text_col))))
    part = own.select(F.col(id_col).alias("id"), F.col(stratum_col).cast("string").alias("stratum"), *[F.col(f"{m}.{c}").alias(c) for c in COUNTS])
    cuts = C.stage(cutoffs(part, labels.select(F.col(id_col).alias("id"), F.col("quality").alias("good")), **settings))
    names = C.fresh(docs, *[f"cut_{r}" for r in RULES])
    cuts = C.maybe_broadcast(cuts.drop("level").toDF(cut_stratum, *names), BROADCAST_STRATA)
    joined = own.join(cuts, own[stratum_col].cast("string").eqNullSafe(F.col(cut_stratum)), "left")
    at = lambda c: F.col(f"{m}.{c}")
    bad = base_failed(at)
    for rule, cut in zip(RULES, names, strict=True):
        bad = bad | F.coalesce(ratio(rule, at) > F.col(cut), F.lit(False))
    return joined.filter(~bad).select(*[joined[c] for c in docs.columns])


def op8_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return judge(C.documents(spark, sf_dir), C.labels(spark, sf_dir)).select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "n_lines", "n_upper", "n_marks", F.array_join("reasons", ",").alias("reasons"))


def _oracle() -> str:
    alpha, delta = MAX_FALSE_REJECTION, DELTA
    ratio_sql = {r: f"CASE WHEN {b} > 0 THEN {t} / {b}::DOUBLE ELSE 0 END" for r, (t, b, _) in RULES.items()}
    rejected = lambda k: " OR ".join(f"{ratio_sql[r]} > {cs[k]}" for r, (_, _, cs) in RULES.items())
    cells = "\n  UNION ALL ".join(f"SELECT stratum, {k + 1} AS k, count(*) AS n, count(*) FILTER ({rejected(k)}) AS x FROM held GROUP BY stratum" for k in range(LEVELS))
    reasons = ", ".join(f"CASE WHEN {ratio_sql[r]} > list_extract([{', '.join(f'{c}::DOUBLE' for c in cs)}], level) THEN '{r}' END" for r, (_, _, cs) in RULES.items())
    return rf"""
WITH d AS (SELECT row_number() OVER () AS rid, doc_id, lang AS stratum, coalesce(text, '') AS text FROM documents),
w AS (SELECT *, regexp_extract_all(text, '[^\x20\x09-\x0D]+') AS ws FROM d),
g AS (SELECT rid, unnest(range(1, len(ws) - 1)) AS i, unnest(list_transform(range(1, len(ws) - 1), lambda j: ws[j] || ' ' || ws[j + 1] || ' ' || ws[j + 2])) AS gram FROM w WHERE len(ws) >= 3),
h AS (SELECT rid, i, count(*) OVER (PARTITION BY rid, gram) AS c FROM g),
r AS (SELECT rid, count(DISTINCT i + o) AS n FROM (SELECT rid, i, unnest([0, 1, 2]) AS o FROM h WHERE c >= 2) GROUP BY rid),
l AS (SELECT rid, count(*) AS n_lines, count(*) - count(DISTINCT line) AS n_dup FROM (SELECT rid, unnest(string_split(text, chr(10))) AS line FROM d) WHERE regexp_matches(line, '[^\x20\x09-\x0D]') GROUP BY rid),
m AS (SELECT w.rid, doc_id, stratum, CAST(len(ws) AS BIGINT) AS n_words, CAST(length(array_to_string(ws, '')) AS BIGINT) AS word_chars,
    CAST(length(text) - length(regexp_replace(text, '{SYMBOLS}', '', 'g')) AS BIGINT) AS n_symbols, CAST(coalesce(l.n_dup, 0) AS BIGINT) AS n_dup_lines,
    CAST(coalesce(r.n, 0) AS BIGINT) AS n_repeat_words, CAST(coalesce(l.n_lines, 0) AS BIGINT) AS n_lines,
    CAST(length(text) - length(regexp_replace(text, '\p{{Lu}}', '', 'g')) AS BIGINT) AS n_upper,
    CAST(length(text) - length(regexp_replace(text, '[^\p{{L}}\p{{N}}\x20\x09-\x0D]', '', 'g')) AS BIGINT) AS n_marks
  FROM w LEFT JOIN r ON w.rid = r.rid LEFT JOIN l ON w.rid = l.rid),
b AS (SELECT *, n_words < {MIN_WORDS} OR 100 * n_repeat_words > 50 * n_words AS base_failed FROM m),
held AS (SELECT * FROM b WHERE NOT base_failed AND doc_id IN (SELECT doc_id FROM labels WHERE quality IS NOT NULL GROUP BY doc_id HAVING min(quality) = 1)),
cells AS ({cells}),
able AS (SELECT *, (SELECT count(*) FROM cells WHERE k = 1 AND n * ln(1 - {alpha!r}) <= ln({delta!r})) AS strata FROM cells WHERE n * ln(1 - {alpha!r}) <= ln({delta!r})),
tails AS (SELECT *, list_sum(list_transform(range(0, x + 1), lambda i: exp(lgamma(n + 1) - lgamma(i + 1) - lgamma(n - i + 1) + i * ln({alpha!r}) + (n - i) * ln(1 - {alpha!r})))) AS tail FROM able),
ok AS (SELECT *, bool_and(x < n * {alpha!r} AND tail <= {delta!r} / strata) OVER (PARTITION BY stratum ORDER BY k) AS good FROM tails),
chosen AS (SELECT stratum, max(k) AS level FROM ok WHERE good GROUP BY stratum),
a AS (SELECT b.*, c.level FROM b LEFT JOIN chosen c ON c.stratum IS NOT DISTINCT FROM b.stratum),
z AS (SELECT a.*, CASE WHEN base_failed THEN '' ELSE concat_ws(',', {reasons}) END AS reasons FROM a)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, NOT base_failed AND reasons = '' AS kept, n_lines, n_upper, n_marks, reasons FROM z
"""


ORACLE = _oracle()
