"""All queries of the engine, each with the SQL that checks it.

A module of this folder fills a Registry: sql() registers one text that both engines run, pair() a
Spark form and a different oracle, rows() a query that SQL can't express.
"""

from __future__ import annotations

import importlib
import re
from collections.abc import Callable
from functools import cache

from pyspark.sql import DataFrame, SparkSession

from shardloom.catalog import TABLES, register_views

Query = Callable[[SparkSession, str], DataFrame]
MODULES = ("tpch", "filters", "joins", "aggregates", "windows", "sorting", "subqueries", "scalars", "modify", "scans", "streams", "tables", "types", "surfaces")


class Registry:
    """Queries and oracles by name."""

    def __init__(self) -> None:
        self.queries: dict[str, Query] = {}
        self.oracles: dict[str, str] = {}

    def add(self, name: str, query: Query, oracle: str | None) -> None:
        if name in self.queries:
            raise ValueError(f"two queries are named {name}")
        self.queries[name] = query
        if oracle is not None:
            self.oracles[name] = oracle

    def sql(self, name: str, text: str, oracle: str | None = None) -> None:
        """A query in Spark SQL; oracle is given where DuckDB's spelling differs."""

        def run(spark: SparkSession, sf_dir: str) -> DataFrame:
            register_views(spark, sf_dir, [t for t in TABLES if re.search(rf"\b{t}\b", text)])
            return spark.sql(text)

        self.add(name, run, oracle or text)

    def pair(self, name: str, oracle: str):
        """Decorator: a DataFrame query with its oracle."""
        return lambda f: self.add(name, f, oracle) or f

    def rows(self, name: str):
        """Decorator: a query that SQL can't express."""
        return lambda f: self.add(name, f, None) or f


@cache
def _all() -> Registry:
    found = Registry()
    for name in MODULES:
        importlib.import_module(f"shardloom.plans.{name}").register(found)
    return found


def queries() -> dict[str, Query]:
    return dict(_all().queries)


def oracle_sql() -> dict[str, str]:
    return dict(_all().oracles)
