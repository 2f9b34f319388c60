"""The engine's queries and their SQL, by name."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from .operators import catalog, checks, chunk, evaluate, hashtree, intake, inverted, labels, layout, pages, profile, quadtree, render, search, tree, vectors, versions
from .plans import table_query
from .streaming import stateful

FLAGSHIP = "hybrid_search"

MODULES = (search, tree, versions, profile, layout, evaluate, chunk, table_query, pages, checks, catalog, render, intake, inverted, vectors, hashtree, labels, quadtree, stateful)


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {name: query for module in MODULES for name, (query, _) in module.QUERIES.items()}


def oracle_sql() -> dict[str, str]:
    return {name: sql for module in MODULES for name, (_, sql) in module.QUERIES.items() if sql}
