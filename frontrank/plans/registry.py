"""Where queries and their SQL are registered by name."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE_SQL: dict[str, str] = {}


def query(name: str, sql: str | None = None) -> Callable:
    """Registers a function (spark, sf_dir) -> DataFrame, and what DuckDB should find."""

    def put(f: Callable[[SparkSession, str], DataFrame]) -> Callable[[SparkSession, str], DataFrame]:
        if name in QUERIES:
            raise ValueError(f"{name} is registered twice")
        QUERIES[name] = f
        if sql:
            ORACLE_SQL[name] = sql
        return f

    return put


def r6(df: DataFrame) -> DataFrame:
    """Doubles rounded to six digits, so that engines that add in another order agree."""
    made = {c: F.round(F.col(c), 6) for c, kind in df.dtypes if kind == "double"}
    return df.withColumns(made) if made else df


def mean_sql(x: str) -> str:
    """exact_mean in SQL."""
    return f"(sum(floor({x} * 1e9 + 0.5)::HUGEINT)::DOUBLE / (1e9 * count({x})))"


def half_sql(x: str, digits: int) -> str:
    """half_up in SQL."""
    return f"(floor({x} * 1e{digits} + 0.5) / 1e{digits})"
