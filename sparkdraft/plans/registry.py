"""Registry binding operators to the driver's tables.

Each query is ``(spark, sf_dir) -> DataFrame``; its oracle is an SQL
string DuckDB runs over the same Parquet tables. Stand-in projections
(how a driver table plays a reference input) live next to each query.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from sparkdraft.functions.text import STRIP_PATTERN

QueryFn = Callable[[SparkSession, str], DataFrame]

QUERIES: dict[str, QueryFn] = {}
ORACLES: dict[str, str] = {}


def strip_sql(expr: str) -> str:
    """DuckDB twin of ``functions.text.clean`` (same regex, RE2 dialect)."""
    return f"regexp_replace(coalesce(CAST({expr} AS VARCHAR), ''), '{STRIP_PATTERN}', '', 'g')"


def register(name: str, oracle: str | None = None) -> Callable[[QueryFn], QueryFn]:
    def deco(fn: QueryFn) -> QueryFn:
        if name in QUERIES:
            raise ValueError(f"duplicate query {name}")
        QUERIES[name] = fn
        if oracle is not None:
            ORACLES[name] = oracle
        return fn

    return deco


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")
