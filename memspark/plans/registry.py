"""Where the registered queries and their DuckDB SQL are kept."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .fixtures import Fixtures, with_tables

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}
R = 6


def query(tables: str = "", sql: str | None = None):
    """Registers f(fixtures) under its name, with the SQL over the named derived tables."""

    def add(f: Callable[[Fixtures], DataFrame]):
        QUERIES[f.__name__] = lambda spark, sf_dir: f(Fixtures(spark, sf_dir))
        if sql is not None:
            ORACLES[f.__name__] = with_tables(tables, sql) if tables else sql
        return f

    return add


def r6(c: str, name: str | None = None):
    return F.round(F.col(c), R).alias(name or c)
