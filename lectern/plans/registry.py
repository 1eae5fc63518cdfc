"""Where queries and their SQL oracles are registered, named by the operator they apply."""

from __future__ import annotations

from collections.abc import Callable
from functools import wraps

from pyspark.sql import DataFrame, SparkSession

from ..sources.shared import ship

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
SQL: dict[str, str] = {}


def query(name: str, sql: str, base: str = ""):
    """Register a query with its SQL; ``base`` are the table definitions that the SQL stands on."""

    def add(f: Query) -> Query:
        @wraps(f)
        def run(spark: SparkSession, sf_dir: str) -> DataFrame:
            ship(spark)
            return f(spark, sf_dir)

        QUERIES[name] = run
        SQL[name] = f"WITH {base}\n{sql}" if base else sql
        return f

    return add
