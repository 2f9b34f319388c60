"""Items that claim pages: groups that share pages, pages blocked by contagion, and what a group's pages touch.

Rows are (item, page), a row per claimed page. Fixpoints go round by round over staged tables, each round a partial aggregate per
page and per item, so a page with very many items is one row per task.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from ..session import table
from .layout import islands
from .tree import components, staged


def page_range(first: Column, last: Column) -> Column:
    """All pages from first to last; none if either is null or they are out of order."""
    return F.when(first <= last, F.sequence(first, last)).otherwise(F.array().cast("array<bigint>"))


def groups(claims: DataFrame) -> DataFrame:
    """(item, group) for all items of (item, page): items are in one group if they share pages, directly or through others.
    The group is its smallest item. Null pages join nothing; repeated rows change nothing. Each item of a page is linked with
    the page's smallest, and only these links, an item at most once to another, go through the rounds."""
    rows = staged(claims.select("item", "page").distinct())
    low = rows.filter("page IS NOT NULL").groupBy("page").agg(F.min("item").alias("target"), F.max("item").alias("high")).filter("target <> high")
    links = rows.join(low, "page").filter("item <> target").select(F.col("item").alias("path"), "target").distinct()
    linked = components(links).select(F.col("path").alias("item"), F.col("component").alias("group"))
    return rows.select("item").distinct().join(linked, "item", "left").select("item", F.coalesce("group", "item").alias("group"))


def blocked_pages(claims: DataFrame, valid: Column) -> DataFrame:
    """Pages (page) that no item may use: those of items that aren't ``valid`` (an expression over the rows, null is not valid),
    and, again and again, all pages of valid items that have a blocked one."""
    rows = staged(claims.select("item", "page", F.coalesce(valid, F.lit(False)).alias("ok")).filter("page IS NOT NULL").distinct())
    bad, good = rows.filter("NOT ok").select("page").distinct(), rows.filter("ok").select("item", "page")
    # contagion passes through valid items, so it takes the pages of their groups whole
    grouped = staged(good.join(groups(good), "item").select("page", "group").distinct())
    hit = grouped.join(bad, "page", "left_semi").select("group").distinct()
    return bad.unionByName(grouped.join(hit, "group", "left_semi").select("page")).distinct()


def partitioned(claims: DataFrame, valid: Column) -> DataFrame:
    """(item, state): invalid, blocked (valid with a blocked page) or eligible."""
    rows = claims.withColumn("_ok", F.coalesce(valid, F.lit(False)))
    blocked = rows.join(blocked_pages(claims, valid), "page", "left_semi").select("item").distinct().withColumn("_hit", F.lit(True))
    per_item = rows.groupBy("item").agg(F.min("_ok").alias("_ok"))
    state = F.when(~F.col("_ok"), "invalid").when(F.col("_hit"), "blocked").otherwise("eligible")
    return per_item.join(blocked, "item", "left").select("item", state.alias("state"))


def affected(group_claims: DataFrame, candidates: DataFrame) -> DataFrame:
    """Per group, what it replaces: candidates (candidate, pages, spans) that share any page with the group (group, page), the
    union of their spans in order, and the group's pages. Groups without candidates are left out."""
    pages = group_claims.select("group", "page").filter("page IS NOT NULL").distinct()
    hit = pages.join(candidates.select("candidate", "spans", F.explode("pages").alias("page")), "page").select("group", "candidate", "spans").distinct()
    joined = hit.groupBy("group").agg(F.array_sort(F.collect_set("candidate")).alias("candidates"), F.array_sort(F.array_distinct(F.flatten(F.collect_list("spans")))).alias("spans"))
    return joined.join(pages.groupBy("group").agg(F.array_sort(F.collect_list("page")).alias("pages")), "group")


def excluded(rows: DataFrame, ranges: DataFrame, key: str = "target") -> DataFrame:
    """``rows`` (key, page, ...) without those on pages that ranges (key, first, last) of their target cover."""
    taken = ranges.select(key, F.explode(page_range(F.col("first"), F.col("last"))).alias("page")).distinct()
    return rows.join(taken, [key, "page"], "left_anti")


def within_ranges(tables: DataFrame, images: DataFrame, key: str = "target") -> DataFrame:
    """(table, image): images (key, image, page) on the pages first to last of a table (key, table, first, last) of the same
    target. Pages are exploded on the table's side, so the join is an equi-join."""
    spread = tables.select(key, "table", F.explode(page_range(F.col("first"), F.col("last"))).alias("page"))
    return spread.join(images.select(key, "image", "page"), [key, "page"]).select("table", "image").distinct()


def candidate_runs(items: DataFrame) -> DataFrame:
    """Items (item, doc, page, pos, merges) with ``run``: a run goes on while an item may merge with the one before it and is
    at most one page further."""
    w = W.partitionBy("doc").orderBy("pos")
    joins = F.col("merges") & (F.col("page") <= F.lag("page").over(w) + 1)
    return islands(items.withColumn("_joins", joins), "doc", "pos", F.col("_joins")).withColumnRenamed("island", "run").drop("_joins")


def _claims(s, d):
    """Orders as items on one to six pages, so neighbours may share some."""
    o = table(s, d, "orders")
    first = F.col("o_orderkey") * 3
    return o.select(F.col("o_orderkey").alias("item"), (F.col("o_orderstatus") != "P").alias("good"), F.explode(page_range(first, first + F.col("o_custkey") % 6)).alias("page"))


_SPANS = "SELECT o_orderkey AS item, o_orderstatus <> 'P' AS good, o_orderkey * 3 AS a, o_orderkey * 3 + o_custkey % 6 AS b FROM orders"
_ISLANDS = f"SELECT *, sum(CASE WHEN a <= before THEN 0 ELSE 1 END) OVER (ORDER BY a, item) AS isle FROM (SELECT *, max(b) OVER (ORDER BY a, item ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS before FROM ({_SPANS}))"
_BLOCKED = f"SELECT *, NOT bool_and(good) OVER (PARTITION BY isle) AS hit FROM ({_ISLANDS})"


def _candidates(s, d):
    li = table(s, d, "lineitem").groupBy("l_orderkey").agg(F.min("l_linenumber").alias("n"))
    return li.select((-F.col("l_orderkey")).alias("candidate"), F.array(F.col("l_orderkey") * 3 + 1, F.col("l_orderkey") * 3 + 2).alias("pages"), F.array(F.struct((F.col("l_orderkey") * 100).alias("start"), (F.col("l_orderkey") * 100 + 50).alias("end"))).alias("spans"))


def _text(c):
    return F.array_join(F.transform(c, lambda x: x.cast("string")), ",")


QUERIES = {
    "shared_page_groups": (lambda s, d: groups(_claims(s, d)), f'SELECT item, min(item) OVER (PARTITION BY isle) AS "group" FROM ({_ISLANDS})'),
    "blocked_pages": (lambda s, d: blocked_pages(_claims(s, d), F.col("good")), f"SELECT DISTINCT unnest(range(a, b + 1)) AS page FROM ({_BLOCKED}) WHERE hit"),
    "replacement_states": (lambda s, d: partitioned(_claims(s, d), F.col("good")), f"SELECT item, CASE WHEN NOT good THEN 'invalid' WHEN hit THEN 'blocked' ELSE 'eligible' END AS state FROM ({_BLOCKED})"),
    "affected_candidates": (
        lambda s, d: affected(_claims(s, d).select(F.col("item").alias("group"), "page"), _candidates(s, d)).select("group", _text("candidates").alias("candidates"), _text("pages").alias("pages"), _text(F.transform("spans", lambda x: x["start"])).alias("starts")),
        f"""SELECT item AS "group", string_agg(c, ',' ORDER BY c) AS candidates, any_value(pages) AS pages, string_agg(s, ',' ORDER BY s) AS starts FROM (
          SELECT item, -k AS c, k * 100 AS s, array_to_string(range(a, b + 1), ',') AS pages FROM ({_SPANS}) JOIN (SELECT DISTINCT l_orderkey AS k FROM lineitem) ON k * 3 + 1 <= b AND k * 3 + 2 >= a) GROUP BY item""",
    ),
    "page_exclusion": (
        lambda s, d: excluded(
            table(s, d, "lineitem").select((F.col("l_orderkey") % 1000).alias("target"), (F.col("l_partkey") % 50).alias("page"), "l_orderkey", "l_linenumber"),
            table(s, d, "supplier").select(F.col("s_suppkey").alias("target"), (F.col("s_suppkey") % 40).alias("first"), (F.col("s_suppkey") % 40 + F.col("s_nationkey") % 9).alias("last")),
        ).select("l_orderkey", "l_linenumber", "page"),
        "SELECT l_orderkey, l_linenumber, l_partkey % 50 AS page FROM lineitem WHERE NOT EXISTS (SELECT 1 FROM supplier WHERE s_suppkey = l_orderkey % 1000 AND l_partkey % 50 BETWEEN s_suppkey % 40 AND s_suppkey % 40 + s_nationkey % 9)",
    ),
    "images_of_tables": (
        lambda s, d: within_ranges(
            table(s, d, "orders").select(F.col("o_custkey").alias("target"), F.col("o_orderkey").alias("table"), (F.col("o_orderkey") % 20).alias("first"), (F.col("o_orderkey") % 20 + F.col("o_custkey") % 4).alias("last")),
            table(s, d, "customer").select(F.col("c_custkey").alias("target"), F.col("c_custkey").alias("image"), (F.col("c_nationkey") % 24).cast("long").alias("page")),
        ),
        'SELECT o_orderkey AS "table", c_custkey AS image FROM orders JOIN customer ON o_custkey = c_custkey AND c_nationkey % 24 BETWEEN o_orderkey % 20 AND o_orderkey % 20 + o_custkey % 4',
    ),
    "candidate_runs": (
        lambda s, d: candidate_runs(table(s, d, "orders").select(F.col("o_orderkey").alias("item"), F.col("o_custkey").alias("doc"), F.expr("o_orderkey DIV 4000").alias("page"), F.col("o_orderkey").alias("pos"), (F.col("o_orderstatus") == "F").alias("merges"))).select("item", "run"),
        """SELECT item, CAST(sum(CASE WHEN merges AND page <= before + 1 THEN 0 ELSE 1 END) OVER (PARTITION BY doc ORDER BY item ROWS UNBOUNDED PRECEDING) AS BIGINT) AS run FROM (
          SELECT o_orderkey AS item, o_custkey AS doc, o_orderstatus = 'F' AS merges, o_orderkey // 4000 AS page, lag(o_orderkey // 4000) OVER (PARTITION BY o_custkey ORDER BY o_orderkey) AS before FROM orders)""",
    ),
}
