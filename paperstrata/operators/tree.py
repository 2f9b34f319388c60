"""Trees of nodes (id, parent_id, ordinal, kind, title): paths, children, subtrees, closures, validation.

Paths are built level by level with one join each, so the work grows with depth, not with pairs; once there, every subtree,
prefix or depth-first query is a filter or sort on ``tree_path`` and ``order_path``.
"""

from __future__ import annotations

import atexit
import functools
import shutil
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from ..session import table

#: Rounds of a fixpoint before it is worth making shortcuts along chains.
PLAIN_ROUNDS = 6


def build_paths(nodes: DataFrame) -> DataFrame:
    """``nodes`` reachable from a root (null parent) with tree_path, order_path and path. Cycles and orphans stay out. Each round
    joins the last level's nodes with their children; trees may have any number of nodes and levels."""
    own = nodes.select("id", "parent_id", "ordinal", "kind", "title")
    here = F.coalesce("ordinal", F.lit(0)).cast("int")
    roots = own.filter("parent_id IS NULL").select("*", F.array("id").alias("tree_path"), F.array(here).alias("order_path"), F.col("title").alias("path"))
    level, out = staged(roots), []
    below = staged(own.filter("parent_id IS NOT NULL"))
    while not level.isEmpty():
        out.append(level)
        up = level.select(F.col("id").alias("up"), F.col("tree_path").alias("t"), F.col("order_path").alias("o"), F.col("path").alias("p"))
        down = below.join(up, F.col("parent_id") == F.col("up"))
        paths = (F.array_append("t", F.col("id")).alias("tree_path"), F.array_append("o", here).alias("order_path"), F.concat("p", F.lit("/"), "title").alias("path"))
        level = staged(down.select("id", "parent_id", "ordinal", "kind", "title", *paths))
    return functools.reduce(DataFrame.unionByName, out or [level])


def children(paths: DataFrame, parent: str) -> DataFrame:
    return paths.filter(F.col("parent_id") == parent).orderBy(F.asc_nulls_first("ordinal"), "id")


def subtree(paths: DataFrame, root: str) -> DataFrame:
    """The node and all below it, depth first."""
    return paths.filter(F.array_contains("tree_path", root)).orderBy("order_path", "id")


def under(paths: DataFrame, prefix: str) -> DataFrame:
    return paths.filter(F.col("path").startswith(prefix))


def depth(paths: DataFrame) -> DataFrame:
    return paths.withColumn("depth", F.size("tree_path") - 1)


def with_ancestors(paths: DataFrame, match) -> DataFrame:
    """Nodes that match and all their ancestors."""
    wanted = paths.filter(match).select(F.explode("tree_path").alias("id")).distinct()
    return paths.join(wanted, "id", "left_semi")


def validate(nodes: DataFrame) -> DataFrame:
    """Faults as rows (fault, id): several roots, a root that isn't a group or has an order, repeated ids, missing parents,
    orders below 1, orders of siblings that aren't 1 to n."""
    roots = nodes.filter(F.col("parent_id").isNull())
    fault = lambda df, name, col="id": df.select(F.lit(name).alias("fault"), F.col(col).alias("id"))
    many = roots.join(F.broadcast(roots.agg(F.count(F.lit(1)).alias("n")).filter("n > 1")))  # one row or none
    orphans = nodes.filter(F.col("parent_id").isNotNull()).alias("n").join(nodes.select(F.col("id").alias("pid")).distinct(), F.col("parent_id") == F.col("pid"), "left_anti")
    siblings = nodes.filter(F.col("parent_id").isNotNull()).groupBy("parent_id").agg(F.count(F.lit(1)).alias("n"), F.min("ordinal").alias("low"), F.max("ordinal").alias("high"), F.count_distinct("ordinal").alias("own"))
    parts = [
        fault(many, "several roots"),
        fault(roots.filter("kind <> 'group'"), "root is no group"),
        fault(roots.filter("ordinal IS NOT NULL"), "root has an order"),
        fault(nodes.groupBy("id").count().filter("count > 1"), "repeated id"),
        fault(orphans, "missing parent"),
        fault(nodes.filter("parent_id IS NOT NULL AND (ordinal IS NULL OR ordinal < 1)"), "bad order"),
        fault(siblings.filter("low <> 1 OR high <> n OR own <> n"), "orders not consecutive", "parent_id"),
    ]
    out = parts[0]
    for part in parts[1:]:
        out = out.unionByName(part)
    return out


def checkpoint_folder(spark: SparkSession) -> str:
    """The folder for staged tables (spark.checkpoint.dir). Where none is set, a temporary one takes its place on one machine, and
    on a cluster it is an error."""
    context = spark.sparkContext
    if not context.getCheckpointDir():
        if not context.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        folder = tempfile.mkdtemp(prefix="paths-")
        atexit.register(shutil.rmtree, folder, ignore_errors=True)
        context.setCheckpointDir(f"file://{folder}")
    return context.getCheckpointDir()


def staged(df: DataFrame) -> DataFrame:
    """``df`` written to the checkpoint folder and read from there, which cuts its lineage and works it out once."""
    path = f"{checkpoint_folder(df.sparkSession)}/staged-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def components(edges: DataFrame) -> DataFrame:
    """(path, component) for all ends of edges (path, target), whichever way they point; the component is its smallest path.
    Each round takes the least label of all neighbours and then the label's label, so a chain halves."""
    both = edges.unionByName(edges.select(F.col("target").alias("path"), F.col("path").alias("target"))).distinct()
    both = staged(both)
    labels, moved = staged(both.groupBy("path").agg(F.least("path", F.min("target")).alias("label"))), True
    while moved:
        near = both.join(labels.select(F.col("path").alias("target"), "label"), "target").groupBy("path").agg(F.min("label").alias("near"))
        step = staged(labels.join(near, "path").select("path", "label", F.least("label", "near").alias("best")))
        # the old label's own path takes the better label as well, and every path then its label's label, twice
        hooked = step.groupBy(F.col("label").alias("path")).agg(F.min("best").alias("hook"))
        step = staged(step.join(hooked, "path", "left").select("path", "label", F.least("best", "hook").alias("best")))
        for _ in range(2):
            up = step.select(F.col("path").alias("best"), F.col("best").alias("top"))
            step = step.join(up, "best").select("path", "label", F.least("best", "top").alias("best"))
        after = staged(step)
        moved, labels = not after.filter("best <> label").isEmpty(), after.select("path", F.col("best").alias("label"))
    return labels.withColumnRenamed("label", "component")


def _shortcuts(edges: DataFrame) -> DataFrame:
    """``edges`` and, from paths with one target each, edges to what lies 2, 4, 8 ... steps further along such paths, so that a
    chain is passed in a number of rounds that grows with the logarithm of its length."""
    counts = edges.groupBy("path").agg(F.min("target").alias("target"), F.count(F.lit(1)).alias("n"))
    jump = staged(counts.filter("n = 1").select("path", "target"))
    out, most = [edges, jump.limit(0)], jump.count()
    for _ in range(most.bit_length()):
        jump = staged(jump.join(jump.select(F.col("path").alias("target"), F.col("target").alias("far")), "target").select("path", F.col("far").alias("target")).filter("path <> target"))
        if jump.isEmpty():
            break
        out.append(jump)
    whole = out[0]
    for more in out[1:]:
        whole = whole.unionByName(more)
    return staged(whole.distinct())


def closure(relations: DataFrame, seeds: DataFrame, both: bool = True) -> DataFrame:
    """Paths (path) that relations (path, target) select with the seeds, seeds included: where either end is selected, the
    other is (``both``), or the target where the path is. Both ways this is all of the components that hold a seed. One way,
    rounds join what is new only; after PLAIN_ROUNDS of them the chains of the graph get shortcuts."""
    edges = relations.filter("path IS NOT NULL AND target IS NOT NULL").select("path", "target")
    reached = new = staged(seeds.select("path").distinct())
    if both:
        whole = components(edges)
        held = whole.join(reached, "path", "left_semi").select("component").distinct()
        return reached.unionByName(whole.join(held, "component", "left_semi").select("path")).distinct()
    edges = staged(edges.distinct())
    rounds = 0
    while not new.isEmpty():
        found = edges.join(new, "path", "left_semi").select(F.col("target").alias("path")).distinct()
        new = staged(found.join(reached, "path", "left_anti"))
        reached, rounds = reached.unionByName(new), rounds + 1
        if rounds == PLAIN_ROUNDS:  # old paths begin again, since shortcuts leave from them too
            edges = _shortcuts(edges)
            reached = new = staged(reached)
        elif rounds % PLAIN_ROUNDS == 0:  # else the union of all rounds grows
            reached = staged(reached)
    return reached


def _trimmed(edges: DataFrame) -> DataFrame:
    """Relations left when those from paths that are no target, or to targets that are no path, go until none goes any more. After
    PLAIN_ROUNDS, chains that end (or begin) go whole: with shortcuts, a path's way to the end of its chain is short."""
    n, left, rounds = edges.count(), edges, 0
    while n:
        left = staged(left.join(left.select(F.col("target").alias("path")).distinct(), "path", "left_semi").join(left.select(F.col("path").alias("target")).distinct(), "target", "left_semi").select("path", "target"))
        before, n, rounds = n, left.count(), rounds + 1
        if n == before:
            break
        if n and rounds % PLAIN_ROUNDS == 0:
            left = _without_chains(_without_chains(left).select(F.col("target").alias("path"), F.col("path").alias("target"))).select(F.col("target").alias("path"), F.col("path").alias("target"))
            n = left.count()
    return left


def _without_chains(edges: DataFrame) -> DataFrame:
    """``edges`` without the paths of one target each that lead to a path of none."""
    ends = edges.select(F.col("target").alias("path")).distinct().join(edges.select("path").distinct(), "path", "left_anti")
    counts = edges.groupBy("path").agg(F.min("target").alias("target"), F.count(F.lit(1)).alias("n"))
    last = ends.select(F.col("path").alias("target"))
    jump = counts.filter("n = 1").select("path", "target")
    done, left = staged(jump.join(last, "target", "left_semi").select("path")), staged(jump.join(last, "target", "left_anti").select("path", "target"))
    gone, found = done, done.count()
    # paths of all distances up to the longest are there, so a round that finds none is the last; rings don't keep it going
    while found:
        done = staged(left.join(gone.select(F.col("path").alias("target")), "target", "left_semi").select("path"))
        further = left.select(F.col("path").alias("target"), F.col("target").alias("far"))
        left = staged(left.join(done, "path", "left_anti").join(further, "target").select("path", F.col("far").alias("target")))
        gone, found = gone.unionByName(done), done.count()
    gone = gone.unionByName(ends)
    return staged(edges.join(gone, "path", "left_anti").join(gone.select(F.col("path").alias("target")), "target", "left_anti").select("path", "target"))


def cycles(relations: DataFrame) -> DataFrame:
    """Paths that reach themselves, at any distance.

    After trimming, relations of one target a path are cycles and nothing else. Otherwise each path gets the largest path that
    reaches it (a fixpoint); those that reach that one within their own colour are its component, and are taken out.
    """
    all_edges = staged(relations.filter("path IS NOT NULL AND target IS NOT NULL").select("path", "target").distinct())
    found = [all_edges.filter("path = target").select("path")]
    edges = all_edges.filter("path <> target")
    while True:
        edges = _trimmed(edges)
        n = edges.count()
        paths = edges.select("path").distinct()
        if n == paths.count():
            found.append(paths)
            break
        colours, changed = staged(paths.select("path", F.col("path").alias("colour"))), True
        while changed:
            given = edges.join(colours, "path").groupBy(F.col("target").alias("path")).agg(F.max("colour").alias("given"))
            after = staged(colours.join(given, "path").select("path", F.greatest("colour", "given").alias("colour"), (F.col("given") > F.col("colour")).alias("moved")))
            changed, colours = not after.filter("moved").isEmpty(), after.drop("moved")
        own = edges.join(colours, "path").join(colours.select(F.col("path").alias("target"), F.col("colour").alias("other")), "target").filter("colour = other")
        settled = closure(own.select(F.col("target").alias("path"), F.col("path").alias("target")), colours.filter("path = colour").select("path"), both=False)
        settled = staged(settled.join(colours, "path"))
        several = settled.groupBy("colour").count().filter("count > 1").select("colour")
        found.append(settled.join(several, "colour", "left_semi").select("path"))
        edges = staged(edges.join(settled.select("path"), "path", "left_anti").join(settled.select(F.col("path").alias("target")), "target", "left_anti").select("path", "target"))
    out = found[0]
    for part in found[1:]:
        out = out.unionByName(part)
    return out.distinct()


def child_orders(nodes: DataFrame, *keys: str) -> DataFrame:
    """Orders 1 to n of siblings, by the keys."""
    return nodes.withColumn("ordinal", F.row_number().over(W.partitionBy("parent_id").orderBy(*keys)))


def page_list(expression: str, last: int) -> list[int]:
    """Pages of an expression such as ``1-3,7``: sorted, distinct, within 1 and last; anything else is an error."""
    pages: set[int] = set()
    for part in expression.split(","):
        low, _, high = part.strip().partition("-")
        if not low.isdigit() or (high and not high.isdigit()):
            raise ValueError(f"not a page range: {part!r}")
        span = range(int(low), int(high or low) + 1)
        if not span or span[0] < 1 or span[-1] > last:
            raise ValueError(f"pages out of range: {part!r}")
        pages |= set(span)
    return sorted(pages)


# The test tables as a tree: world, regions, nations, customers.


def nodes_of(spark, d) -> DataFrame:
    region, nation, customer = (table(spark, d, t) for t in ("region", "nation", "customer"))
    root = spark.sql("SELECT 'w' AS id, cast(NULL AS string) AS parent_id, cast(NULL AS int) AS ordinal, 'group' AS kind, 'world' AS title")
    r = region.select(F.concat(F.lit("r"), "r_regionkey").alias("id"), F.lit("w").alias("parent_id"), (F.col("r_regionkey") + 1).cast("int").alias("ordinal"), F.lit("group").alias("kind"), F.col("r_name").alias("title"))
    n = nation.select(F.concat(F.lit("n"), "n_nationkey").alias("id"), F.concat(F.lit("r"), "n_regionkey").alias("parent_id"), F.row_number().over(W.partitionBy("n_regionkey").orderBy("n_nationkey")).alias("ordinal"), F.lit("group").alias("kind"), F.col("n_name").alias("title"))
    c = customer.select(F.concat(F.lit("c"), "c_custkey").alias("id"), F.concat(F.lit("n"), "c_nationkey").alias("parent_id"), F.row_number().over(W.partitionBy("c_nationkey").orderBy("c_custkey")).alias("ordinal"), F.lit("text").alias("kind"), F.col("c_name").alias("title"))
    return root.unionByName(r).unionByName(n).unionByName(c)


def _paths(spark, d):
    return build_paths(nodes_of(spark, d))


def _flat(df):
    return df.select("id", "parent_id", "ordinal", "kind", "path", F.array_join("tree_path", ">").alias("tree_path"), F.array_join(F.transform("order_path", lambda x: x.cast("string")), ".").alias("order_path"))


def _faulty(spark, d):
    bad = spark.sql("SELECT * FROM VALUES ('x1', 'gone', 1, 'text', 'x1'), ('x2', CAST(NULL AS string), 3, 'text', 'x2'), ('c1', 'n0', 0, 'text', 'twice') AS t(id, parent_id, ordinal, kind, title)")
    return validate(nodes_of(spark, d).unionByName(bad))


def _relations(spark, d):
    """Relations from all orders: cycles of four, where all four orders exist, and trees that lead into them."""
    return table(spark, d, "orders").select(F.col("o_orderkey").alias("path"), F.expr("CASE o_orderkey % 5 WHEN 0 THEN o_orderkey DIV 2 WHEN 4 THEN o_orderkey - 3 ELSE o_orderkey + 1 END").alias("target"))


_NODES = """SELECT 'w' AS id, CAST(NULL AS VARCHAR) AS parent_id, CAST(NULL AS INTEGER) AS ordinal, 'group' AS kind, 'world' AS title
  UNION ALL SELECT 'r' || r_regionkey, 'w', r_regionkey + 1, 'group', r_name FROM region
  UNION ALL SELECT 'n' || n_nationkey, 'r' || n_regionkey, row_number() OVER (PARTITION BY n_regionkey ORDER BY n_nationkey), 'group', n_name FROM nation
  UNION ALL SELECT 'c' || c_custkey, 'n' || c_nationkey, row_number() OVER (PARTITION BY c_nationkey ORDER BY c_custkey), 'text', c_name FROM customer"""
_T = f"""WITH RECURSIVE nodes AS ({_NODES}), t AS (
  SELECT *, [id] AS tp, [coalesce(ordinal, 0)] AS op, title AS path FROM nodes WHERE parent_id IS NULL
  UNION ALL SELECT n.*, list_append(t.tp, n.id), list_append(t.op, coalesce(n.ordinal, 0)), t.path || '/' || n.title FROM t JOIN nodes n ON n.parent_id = t.id)"""
_FLAT = "id, parent_id, CAST(ordinal AS INTEGER) AS ordinal, kind, path, array_to_string(tp, '>') AS tree_path, array_to_string(op, '.') AS order_path"
_BAD = f"SELECT * FROM ({_NODES}) UNION ALL SELECT 'x1', 'gone', 1, 'text', 'x1' UNION ALL SELECT 'x2', NULL, 3, 'text', 'x2' UNION ALL SELECT 'c1', 'n0', 0, 'text', 'twice'"
_REL = "SELECT o_orderkey AS path, CASE o_orderkey % 5 WHEN 0 THEN o_orderkey // 2 WHEN 4 THEN o_orderkey - 3 ELSE o_orderkey + 1 END AS target FROM orders"

QUERIES = {
    "tree_paths": (lambda s, d: _flat(_paths(s, d)), f"{_T} SELECT {_FLAT} FROM t"),
    "tree_children": (lambda s, d: _flat(children(_paths(s, d), "r2")), f"{_T} SELECT {_FLAT} FROM t WHERE parent_id = 'r2'"),
    "tree_subtree": (lambda s, d: _flat(subtree(_paths(s, d), "r1")), f"{_T} SELECT {_FLAT} FROM t WHERE list_contains(tp, 'r1')"),
    "tree_prefix": (lambda s, d: _flat(under(_paths(s, d), "world/A")), f"{_T} SELECT {_FLAT} FROM t WHERE starts_with(path, 'world/A')"),
    "tree_depth": (lambda s, d: depth(_paths(s, d)).groupBy("depth").agg(F.count(F.lit(1)).alias("n")), f"{_T} SELECT CAST(len(tp) - 1 AS INTEGER) AS depth, count(*) AS n FROM t GROUP BY 1"),
    "tree_depth_first": (
        lambda s, d: _paths(s, d).filter("kind = 'group'").withColumn("pos", F.row_number().over(W.orderBy("order_path", "id"))).select("id", "pos"),
        f"{_T} SELECT id, row_number() OVER (ORDER BY op, id) AS pos FROM t WHERE kind = 'group'",
    ),
    "tree_filter_ancestors": (
        lambda s, d: with_ancestors(_paths(s, d), F.lower("title").contains("0017")).select("id", "path"),
        f"{_T}, w AS (SELECT DISTINCT unnest(tp) AS id FROM t WHERE contains(lower(title), '0017')) SELECT t.id, t.path FROM t JOIN w ON t.id = w.id",
    ),
    "tree_validate": (
        _faulty,
        f"""WITH n AS ({_BAD}), s AS (SELECT parent_id, count(*) AS c, min(ordinal) AS lo, max(ordinal) AS hi, count(DISTINCT ordinal) AS own FROM n WHERE parent_id IS NOT NULL GROUP BY parent_id)
        SELECT 'several roots' AS fault, id FROM n WHERE parent_id IS NULL AND (SELECT count(*) FROM n WHERE parent_id IS NULL) > 1
        UNION ALL SELECT 'root is no group', id FROM n WHERE parent_id IS NULL AND kind <> 'group'
        UNION ALL SELECT 'root has an order', id FROM n WHERE parent_id IS NULL AND ordinal IS NOT NULL
        UNION ALL SELECT 'repeated id', id FROM n GROUP BY id HAVING count(*) > 1
        UNION ALL SELECT 'missing parent', id FROM n WHERE parent_id IS NOT NULL AND parent_id NOT IN (SELECT id FROM n)
        UNION ALL SELECT 'bad order', id FROM n WHERE parent_id IS NOT NULL AND (ordinal IS NULL OR ordinal < 1)
        UNION ALL SELECT 'orders not consecutive', parent_id FROM s WHERE lo <> 1 OR hi <> c OR own <> c""",
    ),
    "path_closure": (
        lambda s, d: closure(_relations(s, d), _relations(s, d).filter("path % 1000 = 1").select("path")),
        f"WITH RECURSIVE rel AS (SELECT * FROM ({_REL}) UNION ALL SELECT target, path FROM ({_REL})), r AS (SELECT path FROM ({_REL}) WHERE path % 1000 = 1 UNION SELECT target FROM r JOIN rel ON rel.path = r.path) SELECT path FROM r",
    ),
    "relation_cycle": (
        lambda s, d: cycles(_relations(s, d)),
        f"WITH RECURSIVE rel AS ({_REL}), r AS (SELECT path AS start, target FROM rel UNION SELECT r.start, rel.target FROM r JOIN rel ON rel.path = r.target) SELECT DISTINCT start AS path FROM r WHERE target = start",
    ),
}
