"""Profiles and expectations of tables whose columns are strings. One unpivoting pass, then partial aggregates per column."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..session import table

INTEGER = "^[-+]?(0|[1-9][0-9]*)$"


def long(rows: DataFrame) -> DataFrame:
    """(name, value) of all cells, trimmed; empty and missing cells are null."""
    cell = lambda c: F.when(F.trim(F.col(c).cast("string")) != "", F.trim(F.col(c).cast("string")))
    pairs = F.array(*[F.struct(F.lit(c).alias("name"), cell(c).alias("value")) for c in rows.columns])
    return rows.select(F.explode(pairs).alias("p")).select("p.*")


def number(value: Column) -> Column:
    """A decimal with comma or point, else null; ``value`` is the column of that name."""
    return F.expr("try_cast(replace(value, ',', '.') AS decimal(38,9))")



def _types() -> list[Column]:
    filled = F.count("value")
    whole = F.count(F.when(F.col("value").rlike(INTEGER), 1))
    return [filled.alias("non_empty"), F.when(filled == 0, "string").when(whole == filled, "integer").when(F.count(number(F.col("value"))) == filled, "decimal").otherwise("string").alias("type")]


def infer_types(rows: DataFrame) -> DataFrame:
    """name, non_empty, type: integer if all filled cells are (no leading zeros), else decimal (comma or point), else string."""
    return long(rows).groupBy("name").agg(*_types())


def profile(rows: DataFrame) -> DataFrame:
    """Per column: type, non_empty, missing, missing_rate, exact distinct count, numeric min and max (null for strings)."""
    exact = long(rows).groupBy("name").agg(*_types(), F.count(F.lit(1)).alias("rows"), F.count_distinct("value").alias("distinct"), F.min(number(F.col("value"))).alias("low"), F.max(number(F.col("value"))).alias("high"))
    numeric = lambda c: F.when(F.col("type") != "string", F.col(c).cast("double"))
    missing = F.col("rows") - F.col("non_empty")
    return exact.select("name", "type", "non_empty", missing.alias("missing"), F.round(missing / F.col("rows"), 6).alias("missing_rate"), "distinct", numeric("low").alias("min"), numeric("high").alias("max"))


def expectations(rows: DataFrame, expected_rows: int | None = None, expected_columns: list[str] | None = None, primary_key: list[str] | None = None) -> DataFrame:
    """Violations as rows (check, detail, n); none if the table is as expected."""
    spark, parts = rows.sparkSession, []
    said = lambda check, detail, n: (F.lit(check).alias("check"), detail.alias("detail"), n.alias("n"))
    if expected_rows is not None:
        parts.append(rows.agg(F.count(F.lit(1)).alias("c")).filter(F.col("c") != expected_rows).select(*said("rows", F.lit(str(expected_rows)), F.col("c"))))
    if expected_columns is not None and rows.columns != expected_columns:
        parts.append(spark.range(1).select(*said("columns", F.lit(",".join(rows.columns)), F.lit(len(rows.columns)).cast("long"))))
    if primary_key:
        empty = F.lit(False)
        for c in primary_key:
            empty = empty | F.coalesce(F.col(c).cast("string") == "", F.lit(True))
        parts.append(rows.filter(empty).agg(F.count(F.lit(1)).alias("c")).filter("c > 0").select(*said("key empty", F.lit(",".join(primary_key)), F.col("c"))))
        text = F.concat_ws("|", *[F.col(c).cast("string") for c in primary_key])
        parts.append(rows.groupBy(text.alias("k")).agg(F.count(F.lit(1)).alias("c")).filter("c > 1").select(*said("key repeated", F.col("k"), F.col("c"))))
    out = spark.createDataFrame([], "check string, detail string, n long")
    for part in parts:
        out = out.unionByName(part)
    return out


def _parts(s, d):
    return table(s, d, "part").select("p_partkey", F.when(F.col("p_partkey") % 7 != 0, F.col("p_brand")).alias("p_brand"), F.when(F.col("p_partkey") % 5 == 0, " ").otherwise(F.col("p_size").cast("string")).alias("p_size"), F.round("p_retailprice", 2).cast("decimal(12,2)").alias("p_retailprice"))


_PARTS = "SELECT CAST(p_partkey AS VARCHAR) AS p_partkey, CASE WHEN p_partkey % 7 <> 0 THEN p_brand END AS p_brand, CASE WHEN p_partkey % 5 = 0 THEN ' ' ELSE CAST(p_size AS VARCHAR) END AS p_size, CAST(CAST(round(p_retailprice, 2) AS DECIMAL(12,2)) AS VARCHAR) AS p_retailprice FROM part"
_LONG = "SELECT name, CASE WHEN trim(value) <> '' THEN trim(value) END AS value FROM (" + " UNION ALL ".join(f"SELECT '{c}' AS name, {c} AS value FROM ({_PARTS})" for c in ("p_partkey", "p_brand", "p_size", "p_retailprice")) + ")"
_TYPE = "CASE WHEN count(value) = 0 THEN 'string' WHEN bool_and(regexp_matches(value, '^[-+]?(0|[1-9][0-9]*)$')) THEN 'integer' WHEN count(TRY_CAST(replace(value, ',', '.') AS DECIMAL(38,9))) = count(value) THEN 'decimal' ELSE 'string' END"

QUERIES = {
    "infer_types": (lambda s, d: infer_types(_parts(s, d)), f"SELECT name, count(value) AS non_empty, {_TYPE} AS type FROM ({_LONG}) GROUP BY name"),
    "table_profile": (
        lambda s, d: profile(_parts(s, d)),
        f"""SELECT name, type, non_empty, missing, missing_rate, "distinct", CASE WHEN type <> 'string' THEN lo END AS min, CASE WHEN type <> 'string' THEN hi END AS max FROM (
        SELECT name, {_TYPE} AS type, count(value) AS non_empty, count(*) - count(value) AS missing, round((count(*) - count(value)) / count(*)::DOUBLE, 6) AS missing_rate, count(DISTINCT value) AS "distinct",
        CAST(min(TRY_CAST(replace(value, ',', '.') AS DECIMAL(38,9))) AS DOUBLE) AS lo, CAST(max(TRY_CAST(replace(value, ',', '.') AS DECIMAL(38,9))) AS DOUBLE) AS hi FROM ({_LONG}) GROUP BY name)""",
    ),
    "quality_expectations": (
        lambda s, d: expectations(table(s, d, "orders"), expected_rows=7, primary_key=["o_custkey"]),
        "SELECT 'rows' AS check, '7' AS detail, count(*) AS n FROM orders HAVING count(*) <> 7 UNION ALL SELECT 'key repeated', CAST(o_custkey AS VARCHAR), count(*) FROM orders GROUP BY o_custkey HAVING count(*) > 1",
    ),
}
