"""Guarded read-only SQL over one table, seen as the view ``data`` with all columns as strings."""

from __future__ import annotations

import re
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import table

LIMIT = 1000
DENIED = ("java_method", "reflect", "try_reflect", "input_file_name", "input_file_block_start", "input_file_block_length", "read_files", "current_user", "session_user", "user", "version")


class NotAllowed(ValueError):
    pass


def guard(spark: SparkSession, sql: str) -> str:
    """The statement without its trailing semicolon, if it is one SELECT or CTE over ``data`` alone; else an error.

    As the text: it begins with SELECT or WITH and has no other semicolon, not even in a literal. As a parsed tree: no
    command or insert, no relation but ``data`` and its own common tables, no denied function.
    """
    text = sql.strip()
    if not re.match(r"(?i)(select|with)\b", text) or len(text) > 10_000 or ";" in text.rstrip(";"):
        raise NotAllowed("only one read-only SELECT or CTE statement is allowed")
    text = text.rstrip(";")
    tree = spark._jsparkSession.sessionState().sqlParser().parsePlan(text).treeString()
    if found := re.search(r"InsertInto|Create\w*|Drop\w*|Command|UnresolvedTableValuedFunction \[(?!range|explode|posexplode|inline|stack|json_tuple)", tree):
        raise NotAllowed(f"not read-only: {found[0]}")
    own = {name.strip().lower() for names in re.findall(r"CTE \[([^\]]*)\]", tree) for name in names.split(",")}
    relations = {name.strip().strip("`").lower() for name in re.findall(r"UnresolvedRelation \[([^\]]*)\]", tree)}
    if other := relations - own - {"data"}:
        raise NotAllowed(f"unknown relation: {', '.join(sorted(other))}")
    if found := re.search(rf"(?i)'({'|'.join(DENIED)})\(", tree):
        raise NotAllowed(f"function not allowed: {found[1]}")
    return text


def as_strings(df: DataFrame) -> DataFrame:
    return df.select(*[F.col(c).cast("string").alias(c) for c in df.columns])


def table_query(spark: SparkSession, load: Callable[[SparkSession], DataFrame], sql: str, params: list | None = None) -> DataFrame:
    """The statement's lazy result, in a session of its own in which paths aren't relations."""
    own = spark.newSession()
    own.conf.set("spark.sql.runSQLOnFiles", "false")
    own.conf.set("spark.sql.session.timeZone", "UTC")
    as_strings(load(own)).createOrReplaceTempView("data")
    text = guard(own, sql)
    return own.sql(text, args=params) if params else own.sql(text)


def first_rows(df: DataFrame, limit: int = LIMIT) -> dict:
    """columns, rows (at most ``limit``), truncated: for a caller that shows results."""
    rows = df.limit(limit + 1).collect()
    return {"columns": df.columns, "rows": [r.asDict() for r in rows[:limit]], "truncated": len(rows) > limit}


DATA_SQL = "SELECT CAST(o_orderkey AS VARCHAR) AS o_orderkey, CAST(o_custkey AS VARCHAR) AS o_custkey, o_orderstatus, CAST(o_totalprice AS VARCHAR) AS o_totalprice, CAST(o_orderdate AS VARCHAR) AS o_orderdate, o_orderpriority FROM orders"

N = "CAST(o_orderkey AS BIGINT)"
CUST = "CAST(o_custkey AS BIGINT)"
PRICE = "CAST(o_totalprice AS DOUBLE)"
DAY = "CAST(o_orderdate AS DATE)"

#: name: statement, or a pair of Spark's and the oracle's where the dialects differ.
STATEMENTS: dict[str, str | tuple[str, str]] = {
    "tq_project_filter": f"SELECT o_orderkey, CASE WHEN {PRICE} > 200000 THEN 'high' ELSE 'low' END AS band FROM data WHERE o_orderstatus = 'F' AND {PRICE} BETWEEN 100000 AND 300000",
    "tq_try_cast": "SELECT o_orderpriority, count(TRY_CAST(o_orderpriority AS INTEGER)) AS numbers, count(TRY_CAST(substring(o_orderpriority, 1, 1) AS INTEGER)) AS digits FROM data GROUP BY o_orderpriority",
    "tq_join_inner": f"WITH big AS (SELECT o_custkey, o_orderkey FROM data WHERE {PRICE} > 350000) SELECT a.o_custkey, count(*) AS n FROM data a JOIN big b ON a.o_custkey = b.o_custkey GROUP BY a.o_custkey",
    "tq_join_left": f"WITH big AS (SELECT o_custkey, count(*) AS n FROM data WHERE {PRICE} > 350000 GROUP BY o_custkey) SELECT a.o_orderkey, b.n FROM data a LEFT JOIN big b ON a.o_custkey = b.o_custkey",
    "tq_join_right": f"WITH c AS (SELECT DISTINCT o_custkey FROM data), f AS (SELECT o_custkey, o_orderkey FROM data) SELECT c.o_custkey, f.o_orderkey FROM f RIGHT JOIN c ON f.o_custkey = c.o_custkey",
    "tq_join_full": f"WITH a AS (SELECT o_custkey, count(*) AS na FROM data WHERE o_orderstatus = 'F' GROUP BY o_custkey), b AS (SELECT o_custkey, count(*) AS nb FROM data WHERE o_orderstatus = 'O' GROUP BY o_custkey) SELECT coalesce(a.o_custkey, b.o_custkey) AS o_custkey, na, nb FROM a FULL OUTER JOIN b ON a.o_custkey = b.o_custkey",
    "tq_join_cross": "WITH s AS (SELECT DISTINCT o_orderstatus FROM data), p AS (SELECT DISTINCT o_orderpriority FROM data) SELECT o_orderstatus, o_orderpriority FROM s CROSS JOIN p",
    "tq_join_semi": (
        f"SELECT o_orderkey FROM data a LEFT SEMI JOIN (SELECT o_custkey FROM data WHERE {PRICE} > 380000) b ON a.o_custkey = b.o_custkey",
        f"SELECT o_orderkey FROM data a SEMI JOIN (SELECT o_custkey FROM data WHERE {PRICE} > 380000) b ON a.o_custkey = b.o_custkey",
    ),
    "tq_join_anti": (
        "SELECT o_orderkey FROM data a LEFT ANTI JOIN (SELECT o_custkey FROM data WHERE o_orderstatus = 'P') b ON a.o_custkey = b.o_custkey",
        "SELECT o_orderkey FROM data a ANTI JOIN (SELECT o_custkey FROM data WHERE o_orderstatus = 'P') b ON a.o_custkey = b.o_custkey",
    ),
    "tq_join_theta": f"WITH m AS (SELECT o_orderpriority, avg({PRICE}) AS mean FROM data GROUP BY o_orderpriority) SELECT m.o_orderpriority, count(*) AS above FROM m JOIN data d ON {PRICE.replace('o_', 'd.o_')} > m.mean + 100000 GROUP BY m.o_orderpriority",
    "tq_join_lateral": f"WITH c AS (SELECT DISTINCT o_custkey FROM data) SELECT c.o_custkey, t.best FROM c, LATERAL (SELECT max({PRICE}) AS best FROM data d WHERE d.o_custkey = c.o_custkey) t",
    "tq_join_asof": (
        f"WITH a AS (SELECT o_orderkey, o_custkey, {DAY} AS d FROM data WHERE o_orderstatus = 'F'), b AS (SELECT o_custkey, {DAY} AS d, max({N}) AS k FROM data WHERE o_orderstatus = 'O' GROUP BY o_custkey, {DAY}) SELECT a.o_orderkey, max_by(b.k, b.d) AS last_open FROM a JOIN b ON a.o_custkey = b.o_custkey AND b.d <= a.d GROUP BY a.o_orderkey",
        f"WITH a AS (SELECT o_orderkey, o_custkey, {DAY} AS d FROM data WHERE o_orderstatus = 'F'), b AS (SELECT o_custkey, {DAY} AS d, max({N}) AS k FROM data WHERE o_orderstatus = 'O' GROUP BY o_custkey, {DAY}) SELECT a.o_orderkey, b.k AS last_open FROM a ASOF JOIN b ON a.o_custkey = b.o_custkey AND a.d >= b.d",
    ),
    "tq_group_having": f"SELECT o_custkey, count(*) AS n, round(sum({PRICE}), 2) AS total FROM data GROUP BY o_custkey HAVING count(*) > 12",
    "tq_aggregate_filter": "SELECT o_orderpriority, count(*) FILTER (WHERE o_orderstatus = 'F') AS f, count(DISTINCT o_custkey) AS customers FROM data GROUP BY o_orderpriority",
    "tq_grouping_sets": f"SELECT o_orderstatus, o_orderpriority, count(*) AS n FROM data GROUP BY GROUPING SETS ((o_orderstatus), (o_orderpriority), ())",
    "tq_cube": "SELECT o_orderstatus, o_orderpriority, count(*) AS n FROM data GROUP BY CUBE (o_orderstatus, o_orderpriority)",
    "tq_rollup": f"SELECT year({DAY}) AS y, o_orderstatus, count(*) AS n FROM data GROUP BY ROLLUP (year({DAY}), o_orderstatus)",
    "tq_window_rank": f"SELECT o_orderkey, rank() OVER w AS r, dense_rank() OVER w AS dr, row_number() OVER (PARTITION BY o_orderpriority ORDER BY {PRICE} DESC, {N}) AS rn, ntile(4) OVER (PARTITION BY o_orderpriority ORDER BY {N}) AS nt FROM data WINDOW w AS (PARTITION BY o_orderpriority ORDER BY {DAY})",
    "tq_window_frame": f"SELECT o_orderkey, CAST(sum({CUST}) OVER (PARTITION BY o_orderstatus ORDER BY {N} ROWS BETWEEN 3 PRECEDING AND CURRENT ROW) AS BIGINT) AS s, count(*) OVER (PARTITION BY o_orderstatus ORDER BY {N} RANGE BETWEEN 100 PRECEDING AND 100 FOLLOWING) AS c FROM data",
    "tq_window_lag_lead": f"SELECT o_orderkey, lag(o_orderkey) OVER w AS before, lead(o_orderkey, 2) OVER w AS after, first_value(o_orderkey) OVER w AS first, nth_value(o_orderkey, 2) OVER w AS second FROM data WINDOW w AS (PARTITION BY o_custkey ORDER BY {N})",
    "tq_qualify": (
        f"SELECT o_custkey, o_orderkey FROM (SELECT o_custkey, o_orderkey, row_number() OVER (PARTITION BY o_custkey ORDER BY {PRICE} DESC, {N}) AS rn FROM data) WHERE rn <= 2",
        f"SELECT o_custkey, o_orderkey FROM data QUALIFY row_number() OVER (PARTITION BY o_custkey ORDER BY {PRICE} DESC, {N}) <= 2",
    ),
    "tq_order_limit": f"SELECT o_orderkey, o_totalprice FROM data ORDER BY {PRICE} DESC NULLS LAST, {N} LIMIT 25 OFFSET 5",
    "tq_distinct": "SELECT DISTINCT o_orderstatus, o_orderpriority FROM data",
    "tq_union": "SELECT o_orderstatus AS v FROM data UNION SELECT o_orderpriority FROM data",
    "tq_union_all": f"SELECT o_orderkey FROM data UNION ALL SELECT o_orderkey FROM data",
    "tq_intersect": "SELECT o_custkey FROM data WHERE o_orderstatus = 'F' INTERSECT SELECT o_custkey FROM data WHERE o_orderstatus = 'O'",
    "tq_intersect_all": "SELECT o_custkey FROM data WHERE o_orderstatus = 'F' INTERSECT ALL SELECT o_custkey FROM data WHERE o_orderstatus = 'O'",
    "tq_except": "SELECT o_custkey FROM data WHERE o_orderstatus = 'O' EXCEPT SELECT o_custkey FROM data WHERE o_orderstatus = 'F'",
    "tq_except_all": "SELECT o_custkey FROM data WHERE o_orderstatus = 'O' EXCEPT ALL SELECT o_custkey FROM data WHERE o_orderstatus = 'F'",
    "tq_subquery_scalar": f"SELECT o_orderkey FROM data WHERE {PRICE} > (SELECT 1.9 * avg({PRICE}) FROM data)",
    "tq_subquery_in": f"SELECT o_orderkey FROM data WHERE o_custkey IN (SELECT o_custkey FROM data WHERE {PRICE} > 390000)",
    "tq_subquery_exists": f"SELECT o_orderkey FROM data a WHERE EXISTS (SELECT 1 FROM data b WHERE b.o_custkey = a.o_custkey AND b.o_orderstatus <> a.o_orderstatus)",
    "tq_subquery_correlated": f"SELECT o_orderkey FROM data a WHERE {PRICE.replace('o_', 'a.o_')} = (SELECT max({PRICE.replace('o_', 'b.o_')}) FROM data b WHERE b.o_custkey = a.o_custkey)",
    "tq_recursive": "WITH RECURSIVE r(n, total) AS (SELECT 1, 1 UNION ALL SELECT n + 1, total + n + 1 FROM r WHERE n < 40) SELECT n, total FROM r",
    "tq_pivot": (
        "SELECT * FROM (SELECT o_orderpriority, o_orderstatus FROM data) PIVOT (count(1) FOR o_orderstatus IN ('F' AS f, 'O' AS o, 'P' AS p))",
        "SELECT o_orderpriority, nullif(count(*) FILTER (o_orderstatus = 'F'), 0) AS f, nullif(count(*) FILTER (o_orderstatus = 'O'), 0) AS o, nullif(count(*) FILTER (o_orderstatus = 'P'), 0) AS p FROM data GROUP BY o_orderpriority",
    ),
    "tq_unpivot": (
        f"SELECT o_orderkey, name, value FROM (SELECT o_orderkey, o_orderstatus, o_orderpriority FROM data) UNPIVOT (value FOR name IN (o_orderstatus, o_orderpriority))",
        f"SELECT o_orderkey, 'o_orderstatus' AS name, o_orderstatus AS value FROM data UNION ALL SELECT o_orderkey, 'o_orderpriority', o_orderpriority FROM data",
    ),
    "tq_string_functions": f"SELECT o_orderkey, upper(o_orderpriority) AS u, substring(o_orderpriority, 3) AS s, replace(o_orderpriority, '-', '_') AS r, concat_ws('/', o_orderstatus, o_custkey) AS c, length(o_orderpriority) AS n, regexp_replace(o_orderpriority, '[0-9]', '#') AS x, lpad(o_custkey, 8, '0') AS p FROM data",
    "tq_date_functions": f"SELECT o_orderkey, year({DAY}) AS y, month({DAY}) AS m, day({DAY}) AS d, quarter({DAY}) AS q, CAST(CAST(date_trunc('month', {DAY}) AS DATE) AS STRING) AS first FROM data",
    "tq_math_functions": f"SELECT o_orderkey, round(sqrt({PRICE}), 6) AS r, CAST(floor({PRICE} / 1000) AS BIGINT) AS f, abs(50 - {CUST}) AS a, {CUST} % 7 AS m, round(ln({PRICE}), 6) AS l FROM data",
    "tq_array_functions": (
        "SELECT o_custkey, array_join(array_sort(collect_set(o_orderstatus)), ',') AS v, size(collect_set(o_orderpriority)) AS n FROM data GROUP BY o_custkey",
        "SELECT o_custkey, array_to_string(list_sort(list(DISTINCT o_orderstatus)), ',') AS v, len(list(DISTINCT o_orderpriority)) AS n FROM data GROUP BY o_custkey",
    ),
    "tq_struct_map_functions": (
        f"SELECT o_orderkey, map('s', o_orderstatus, 'p', o_orderpriority)['p'] AS p, named_struct('a', o_custkey).a AS a FROM data",
        f"SELECT o_orderkey, map {{'s': o_orderstatus, 'p': o_orderpriority}}['p'] AS p, {{'a': o_custkey}}.a AS a FROM data",
    ),
    "tq_json_functions": (
        f"SELECT o_orderkey, get_json_object(concat('{{\"s\": \"', o_orderstatus, '\", \"c\": ', o_custkey, '}}'), '$.c') AS c FROM data",
        f"SELECT o_orderkey, json_extract_string('{{\"s\": \"' || o_orderstatus || '\", \"c\": ' || o_custkey || '}}', '$.c') AS c FROM data",
    ),
    "tq_ordered_quantile": f"SELECT o_orderpriority, percentile_disc(0.5) WITHIN GROUP (ORDER BY {PRICE}) AS median FROM data GROUP BY o_orderpriority",
}
STATEMENTS["tq_string_functions"] = (STATEMENTS["tq_string_functions"], STATEMENTS["tq_string_functions"].replace("'[0-9]', '#')", "'[0-9]', '#', 'g')"))


def _query(sql: str):
    def query(spark: SparkSession, sf_dir: str) -> DataFrame:
        return table_query(spark, lambda own: table(own, sf_dir, "orders"), sql)

    return query


def _approximate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table_query(spark, lambda own: table(own, sf_dir, "orders"), "SELECT o_orderstatus, approx_count_distinct(o_custkey) AS customers, approx_percentile(CAST(o_totalprice AS DOUBLE), 0.5) AS median FROM data GROUP BY o_orderstatus")


QUERIES = {name: (_query(s if isinstance(s, str) else s[0]), f"WITH data AS ({DATA_SQL}) SELECT * FROM ({s if isinstance(s, str) else s[1]})") for name, s in STATEMENTS.items()}
QUERIES["tq_parameters"] = (
    lambda spark, d: table_query(spark, lambda own: table(own, d, "orders"), "SELECT o_orderkey FROM data WHERE o_orderstatus = ? AND CAST(o_custkey AS BIGINT) < ?", ["F", 100]),
    f"WITH data AS ({DATA_SQL}) SELECT o_orderkey FROM data WHERE o_orderstatus = 'F' AND CAST(o_custkey AS BIGINT) < 100",
)
QUERIES["tq_approximate"] = (_approximate, None)


def _first(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first rows as a caller sees them, one row for two statements: how many, and whether there are more."""
    shown = [(n, first_rows(table_query(spark, lambda own: table(own, sf_dir, "orders"), f"SELECT o_orderkey FROM data LIMIT {n}"), 100)) for n in (100, 101)]
    return spark.createDataFrame([(n, len(x["rows"]), x["truncated"]) for n, x in shown], "asked int, shown int, truncated boolean")


QUERIES["tq_first_rows"] = (_first, "SELECT 100 AS asked, 100 AS shown, false AS truncated UNION ALL SELECT 101, 100, true")
