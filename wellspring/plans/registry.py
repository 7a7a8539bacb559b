"""Registered queries: each reads the given tables and returns a DataFrame."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}


def query(function: Query) -> Query:
    """Register a query under the name of its function."""
    QUERIES[function.__name__] = function
    return function


def rounded(df: DataFrame, digits: int, *names: str) -> DataFrame:
    """Round the named double columns (all double columns by default) for comparison."""
    chosen = names or [n for n, t in df.dtypes if t == "double"]
    return df.selectExpr(
        *[f"round(`{n}`, {digits}) AS `{n}`" if n in chosen else f"`{n}`" for n in df.columns]
    )
