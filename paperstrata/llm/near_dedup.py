"""MinHash near-dedup with bottom-k sketches from one hash function.

Method. A document's set is its distinct five-word shingles, hashed once with a 64-bit function. Its sketch is the K smallest
hashes. Documents with equal sets collapse to one. Inverted lists of retained values generate candidates: two sets with
Jaccard similarity s share about s*K retained values, and fewer than ``shared_values`` of them with a probability below MISS;
sets of up to s*K elements lie in their sketches whole. So it is enough to list each document under its K - shared + 1 rarest
retained values (prefix filter; order: document frequency, then value). Pairs from a list are filtered by the Jaccard estimate of the
union's sketch, six standard deviations wide, and then verified on the full sets.

Skew. Lists aren't expanded to their pairs. In each round every list names one centre, the member with the fewest values of
its own (in a group of near copies, the one closest to their common origin); the others that are not yet in the centre's
component are its candidates; then the centre leaves the list, and lists whose members are all in one component go. That is linear in the lists, and large groups of near copies are joined after a round or two. Documents whose
sketches consist largely of frequent values (more than LIST documents: shared passages, or large groups) are listed anew
under their full sets, where the prefix filter is exact and needs only the rarest 15 %. After ROUNDS rounds,
once the pairs of unlike members that are left are no more than there were list entries (or after MOST_ROUNDS), they are
compared inside one join that gives out likely pairs only, so no link is lost. Hot values in joins are broadcast (bounded number).
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from . import common as C
from . import graph

K = 48
#: The chance to miss a link at exactly the threshold.
MISS = 1e-8
LIST = 48
ROUNDS = 4
MOST_ROUNDS = 6
WIDE = 512
#: A filter of ids has at most 2^(ROW_BITS + 15) bits: 512 rows of 4 KB, however many ids there are.
ROW_BITS = 9


def shared_values(k: int, percent: int) -> int:
    """The most values that two sketches of k at the threshold share but for a probability of MISS (each value of the union's
    sketch is shared with the probability of the similarity)."""
    p, below = percent / 100, 0.0
    for n in range(k + 1):
        below += math.comb(k, n) * p**n * (1 - p) ** (k - n)
        if below > MISS:
            return max(1, n)
    return k


def shingle_set(text: Column, width: int = 5) -> Column:
    """Sorted distinct hashes of the shingles of ``width`` words; all words as one where there are fewer; none without words."""

    def over(words: Column) -> Column:
        one = F.transform(F.array(F.lit(0)), lambda _: F.xxhash64(words))
        many = F.transform(F.sequence(F.lit(0), F.size(words) - width), lambda i: F.xxhash64(*[F.get(words, i + k) for k in range(width)]))
        return F.when(F.size(words) == 0, F.array().cast("array<bigint>")).when(F.size(words) < width, one).otherwise(many)

    hashed = F.transform(C.words_of(C.ascii_lower(C.text_of(text))), lambda w: F.xxhash64(w))
    return F.sort_array(F.array_distinct(C.bind(hashed, over)))


def sketches(docs: DataFrame, id_col: str, text_col: str, width: int, k: int) -> DataFrame:
    """rid (unique), id, n, two hashes of the set, sketch; one row per input row, staged."""
    both = C.bind(shingle_set(F.col(text_col), width), lambda s: F.struct(F.size(s).alias("n"), F.xxhash64(F.lit(1), s).alias("ka"), F.xxhash64(F.lit(2), s).alias("kb"), F.slice(s, 1, k).alias("sketch")))
    return C.stage(docs.select(F.monotonically_increasing_id().alias("rid"), F.col(id_col).alias("id"), both.alias("s")).select("rid", "id", "s.*"))


def likely_among(rows: DataFrame, ids: DataFrame, id_col: str = "id") -> DataFrame:
    """``rows`` whose id is in ``ids``, and a few others: ids are hashed to the bits of a table that is broadcast, which is of one size
    for any number of them."""
    place = F.xxhash64(id_col)
    row, bit = place.bitwiseAND((1 << ROW_BITS) - 1), F.shiftrightunsigned(place, 64 - 15)
    bits = C.stage(ids.select(row.alias("_row"), bit.alias("_bit")).repartition("_row").groupBy("_row").agg(F.bitmap_construct_agg("_bit").alias("_bits")))
    byte = F.conv(F.hex(F.substring("_bits", (bit / 8).cast("int") + 1, F.lit(1))), 16, 10).cast("int")
    held = F.expr("shiftright(_byte, _nth)").bitwiseAND(1) == 1
    joined = rows.withColumn("_row", row).join(F.broadcast(bits), "_row").withColumns({"_byte": byte, "_nth": (bit % 8).cast("int")})
    return joined.filter(held).select(*rows.columns)


def full_sets(docs: DataFrame, id_col: str, text_col: str, width: int, reps: DataFrame) -> DataFrame:
    """rid, set of the representatives ``reps`` (rid, id, ka, kb), from their texts; staged. Only their rows are hashed again."""
    rows = likely_among(docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")), reps)
    sets = rows.select("id", shingle_set(F.col("text"), width).alias("set")).withColumns({"ka": F.xxhash64(F.lit(1), "set"), "kb": F.xxhash64(F.lit(2), "set")})
    keyed = reps.select("rid", F.col("id").alias("rep_id"), "ka", "kb")
    joined = sets.join(keyed, (sets["ka"] == keyed["ka"]) & (sets["kb"] == keyed["kb"]) & F.col("id").eqNullSafe(F.col("rep_id")))
    return C.stage(joined.select("rid", "set").dropDuplicates(["rid"]))


def prefixes(values: DataFrame, level: int, allowed: Column, at_most: int | None) -> tuple[DataFrame, DataFrame | None]:
    """Inverted-list entries (level, value, rid, lone) from (rid, size, value): each set's ``allowed`` rarest values that
    another set has too; lone: how many of its values no other set has. With at_most, entries of longer lists are left out and the sets they belong to are returned as well."""
    frequency = C.stage(values.groupBy("value").agg(F.count(F.lit(1)).alias("df")).filter("df > 1"))
    shared = C.join_by_weight(values, frequency, ["value"], "df")
    nth, lone = F.row_number().over(W.partitionBy("rid").orderBy("df", "value")), F.col("size") - F.count(F.lit(1)).over(W.partitionBy("rid"))
    listed = shared.withColumn("lone", lone).withColumn("rank", nth + F.col("lone")).filter(F.col("rank") <= allowed)
    entries = C.stage(listed.select(F.lit(level).alias("level"), "value", "rid", "lone", "df"))
    if at_most is None:
        return entries.drop("df"), None
    return entries.filter(F.col("df") <= at_most).drop("df"), C.stage(entries.filter(F.col("df") > at_most).select("rid").distinct())


def _estimate(pairs: DataFrame, reps: DataFrame, percent: int, k: int) -> DataFrame:
    """Pairs whose union sketch doesn't rule out the similarity."""
    sa, sb = (reps.select(F.col("rid").alias(x), F.col("sketch").alias(f"s{x}"), F.col("n").alias(f"n{x}")) for x in "ab")
    joined = pairs.join(sa, "a").join(sb, "b")
    return joined.filter(_likely("sa", "sb", "na", "nb", percent, k)).select("a", "b")


def _likely(sa: str, sb: str, na: str, nb: str, percent: int, k: int) -> Column:
    """Whether sizes and the sketch of the union allow the similarity."""
    union, p = F.slice(F.sort_array(F.array_union(sa, sb)), 1, k), percent / 100
    # a union of fewer than k values is known whole
    least = lambda u: p * F.size(u) - F.when(F.size(u) < k, F.lit(1e-9)).otherwise(6 * math.sqrt(p * (1 - p)) * F.sqrt(F.size(u)) + 1)
    close = C.bind(union, lambda u: F.size(F.array_intersect(u, F.array_intersect(sa, sb))) >= least(u))
    return F.when(F.least(na, nb) * 100 >= F.greatest(na, nb) * percent, close).otherwise(F.lit(False))


def _verify(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    sa, sb = (sets.select(F.col("rid").alias(x), F.col("set").alias(f"s{x}")) for x in "ab")
    joined = pairs.join(sa, "a").join(sb, "b")
    both = C.bind(F.size(F.array_intersect("sa", "sb")), lambda i: 100 * i >= percent * (F.size("sa") + F.size("sb") - i))
    return joined.filter(both).select("a", "b")


def _unlike(spread: DataFrame, sets: DataFrame, percent: int, k: int = WIDE) -> DataFrame:
    """Pairs (a, b) of members of different components in one list that are likely links. Members carry wider sketches and
    their lists, so the join itself compares them, each pair in its first common list, and gives out likely pairs only."""
    place = F.xxhash64("level", "value")
    lists = spread.groupBy("rid").agg(F.collect_set(place).alias("lists"))
    own = C.stage(spread.select("level", "value", "rid", "root", place.alias("place")).join(lists.hint("shuffle_merge"), "rid").join(sets.select("rid", F.size("set").alias("n"), F.slice("set", 1, k).alias("sketch")).hint("shuffle_merge"), "rid"))
    a, b = (own.select("level", "value", *[F.col(c).alias(f"{c}_{x}") for c in ("rid", "root", "place", "lists", "n", "sketch")]) for x in "ab")
    first = F.when((F.col("rid_a") < F.col("rid_b")) & (F.col("root_a") != F.col("root_b")), F.array_min(F.array_intersect("lists_a", "lists_b")) == F.col("place_a")).otherwise(F.lit(False))
    compared = F.when(first, _likely("sketch_a", "sketch_b", "n_a", "n_b", percent, k)).otherwise(F.lit(False))
    pairs = a.join(b.hint("shuffle_merge"), (a["level"] == b["level"]) & (a["value"] == b["value"]) & compared)
    return pairs.select(F.col("rid_a").alias("a"), F.col("rid_b").alias("b"))


class _Search:
    """The components so far, and how candidate pairs become links."""

    def __init__(self, docs, id_col, text_col, width, reps, percent, k):
        self.docs, self.cols, self.reps, self.percent, self.k = docs, (id_col, text_col, width), reps, percent, k
        self.labels = None  # node, root: only nodes with a link

    def with_root(self, rows: DataFrame, node: str, root: str) -> DataFrame:
        if self.labels is None:
            return rows.withColumn(root, F.col(node))
        found = self.labels.select(F.col("node").alias(node), F.col("root").alias("_r"))
        return rows.join(found, node, "left").withColumn(root, F.coalesce("_r", node)).drop("_r")

    def link(self, pairs: DataFrame) -> bool:
        """Adds the links among ``pairs`` (a, b of different components); whether there were any."""
        likely = C.stage(_estimate(pairs, self.reps, self.percent, self.k))
        if not likely.limit(1).count():
            return False
        ends = C.stage(likely.select(F.col("a").alias("rid")).unionByName(likely.select(F.col("b").alias("rid"))).distinct())
        sets = full_sets(self.docs, *self.cols, self.reps.select("rid", "id", "ka", "kb").join(ends, "rid", "left_semi"))
        links = C.stage(_verify(likely, sets, self.percent))
        if not links.limit(1).count():
            return False
        # the graph of components: only their roots are relabelled
        joined = self.with_root(self.with_root(links, "a", "ra"), "b", "rb").select(F.col("ra").alias("a"), F.col("rb").alias("b"))
        merged = graph.components(joined)
        if self.labels is None:
            self.labels = merged
        else:
            up = merged.select(F.col("node").alias("root"), F.col("root").alias("top"))
            old = self.labels.join(up, "root", "left").select("node", F.coalesce("top", "root").alias("root"))
            new = merged.join(self.labels.select("node"), "node", "left_anti")
            self.labels = C.stage(old.unionByName(new))
        return True


def components(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = 5, percent: int = 80, k: int = K, shared: int | None = None, list_size: int = LIST, rounds: int = ROUNDS) -> DataFrame:
    """One row per input row: the id, n_shingles (size of its set), component_id (smallest id reachable by links, itself
    included), kept (id = component_id).

    Two rows are linked if 100 * |intersection| >= percent * |union| of their shingle sets, words lower-cased in A-Z only. A
    text of fewer words is one shingle; rows without words (null, empty) are linked with nothing. Rows that repeat an id are
    rows of their own, linked if their texts are; all rows with the component's id are kept. Null ids are larger than others.
    Empty input gives an empty result. Other columns are ignored.
    """
    shared = shared or shared_values(k, percent)
    rows = sketches(docs, id_col, text_col, width, k)
    reps = C.stage(rows.filter("n > 0").groupBy("ka", "kb").agg(F.min("rid").alias("rid"), F.min_by("id", "rid").alias("id"), F.min("id").alias("min_id"), F.count(F.lit(1)).alias("copies"), F.first("n").alias("n"), F.first("sketch").alias("sketch")))
    search = _Search(docs, id_col, text_col, width, reps, percent, k)

    size = F.size("sketch")
    # sets of up to percent * k elements: all that are similar enough lie in their sketches whole
    need = F.when(F.col("size") <= k * percent // 100, F.ceil(F.col("size") * percent / 100)).otherwise(F.least(F.lit(shared), F.ceil(F.col("size") * percent / 100)))
    values = reps.select("rid", size.alias("size"), F.explode("sketch").alias("value"))
    entries, heavy = prefixes(values, 1, F.col("size") - need + 1, list_size)
    if heavy.limit(1).count():
        sets = full_sets(docs, id_col, text_col, width, reps.select("rid", "id", "ka", "kb").join(heavy, "rid", "left_semi"))
        need = F.ceil(F.col("size") * percent / 100)
        again, _ = prefixes(sets.select("rid", F.size("set").alias("size"), F.explode("set").alias("value")), 2, F.col("size") - need + 1, None)
        entries = entries.unionByName(again)

    n_entries = None
    for turn in range(MOST_ROUNDS + 1):
        rooted = C.stage(search.with_root(entries, "rid", "root"))
        n_entries = n_entries or rooted.count()
        lists = rooted.groupBy("level", "value").agg(F.count(F.lit(1)).alias("members"), F.min("root").alias("low"), F.max("root").alias("high"), F.min(F.struct("lone", "rid", "root")).alias("centre")).filter("low <> high")
        lists = C.stage(lists.select("level", "value", "members", F.col("centre.rid").alias("a"), F.col("centre.root").alias("a_root")))
        pairs = lists.agg(F.sum(F.col("members") * (F.col("members") - 1) / 2)).first()[0]
        if not pairs:
            break
        spread = C.stage(C.join_by_weight(rooted, lists, ["level", "value"], "members").drop("members"))
        if turn == MOST_ROUNDS or turn >= rounds and pairs <= n_entries:
            members = C.stage(spread.select("rid").distinct())
            sets = full_sets(docs, id_col, text_col, width, reps.select("rid", "id", "ka", "kb").join(members, "rid", "left_semi"))
            search.link(_unlike(spread, sets, percent))
            break
        spread = spread.filter(F.col("rid") != F.col("a"))
        search.link(spread.filter(F.col("root") != F.col("a_root")).select("a", F.col("rid").alias("b")).distinct())
        entries = spread.select("level", "value", "rid", "lone")

    final = reps.select("rid", "ka", "kb", "copies", "min_id")
    if search.labels is None:
        final = final.withColumnRenamed("min_id", "component_id")
    else:
        linked = C.stage(final.join(search.labels, final["rid"] == F.col("node")).select("ka", "kb", "copies", "min_id", "root"))
        roots = C.stage(linked.groupBy("root").agg(F.min("min_id").alias("component_id"), F.count(F.lit(1)).alias("members")))
        alone = final.join(search.labels, final["rid"] == F.col("node"), "left_anti")
        final = C.join_by_weight(linked, roots, ["root"], "members").select("ka", "kb", "copies", "component_id").unionByName(alone.select("ka", "kb", "copies", F.col("min_id").alias("component_id")))
    final = C.stage(final.select("ka", "kb", "copies", "component_id"))
    filled = C.join_by_weight(rows.filter("n > 0").select("id", "n", "ka", "kb"), final, ["ka", "kb"], "copies").select("id", "n", "component_id")
    every = filled.unionByName(rows.filter("n = 0").select("id", "n", F.col("id").alias("component_id")))
    return every.select(F.col("id").alias(id_col), F.col("n").cast("long").alias("n_shingles"), "component_id", F.col("id").eqNullSafe(F.col("component_id")).alias("kept"))


def near_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = 5, percent: int = 80, **settings) -> DataFrame:
    """``docs`` with one row of each component, the one with the smallest id; columns as they are. Ids should be unique: all
    rows with a kept id stay."""
    kept = components(docs, id_col, text_col, width, percent, **settings).filter("kept").select(F.col(id_col).alias("kept_id"))
    return docs.join(kept.hint("shuffle_merge"), docs[id_col].eqNullSafe(F.col("kept_id")), "left_semi")


def op5_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return components(C.documents(spark, sf_dir).select("doc_id", "text"), percent=85).select("doc_id", "n_shingles", "component_id", "kept")


ORACLE = rf"""
WITH RECURSIVE d AS (SELECT row_number() OVER () AS rid, doc_id, regexp_extract_all(translate(coalesce(text, ''), '{C.UPPER}', '{C.UPPER.lower()}'), '[^\x20\x09-\x0D]+') AS ws FROM documents),
s AS (SELECT rid, doc_id, list_sort(list_distinct(CASE WHEN len(ws) = 0 THEN [] WHEN len(ws) < 5 THEN [array_to_string(ws, ' ')]
    ELSE list_transform(range(1, len(ws) - 3), lambda i: ws[i] || ' ' || ws[i + 1] || ' ' || ws[i + 2] || ' ' || ws[i + 3] || ' ' || ws[i + 4]) END)) AS sh FROM d),
n AS (SELECT rid, doc_id, len(sh) AS n FROM s),
v AS (SELECT rid, unnest(sh) AS v FROM s),
o AS (SELECT x.rid AS a, y.rid AS b, count(*) AS i FROM v x JOIN v y ON x.v = y.v AND x.rid < y.rid GROUP BY x.rid, y.rid),
l AS (SELECT a, b FROM o JOIN n p ON p.rid = a JOIN n q ON q.rid = b WHERE 100 * i >= 85 * (p.n + q.n - i)),
e AS (SELECT a, b FROM l UNION SELECT b, a FROM l),
r(rid, node) AS (SELECT rid, rid FROM n UNION SELECT r.rid, e.b FROM r JOIN e ON r.node = e.a),
c AS (SELECT r.rid, min(n.doc_id) AS component_id FROM r JOIN n ON r.node = n.rid GROUP BY r.rid)
SELECT doc_id, n AS n_shingles, component_id, doc_id = component_id AS kept FROM n JOIN c ON n.rid = c.rid
"""
