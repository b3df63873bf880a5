"""Registry of named queries and their SQL counterparts."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, functions as F

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    def add(fn):
        if name in QUERIES:
            raise KeyError(name)
        QUERIES[name] = fn
        if sql is not None:
            ORACLES[name] = sql
        return fn

    return add


def rounded(df: DataFrame, digits: int = 6) -> DataFrame:
    """Round every double so that summation order does not show; adding 0.0 removes negative zero."""
    return df.select(
        *[(F.round(F.col(f"`{n}`"), digits) + F.lit(0.0)).alias(n) if t == "double" else F.col(f"`{n}`") for n, t in df.dtypes]
    )


def rounded_sql(sql: str, cols: str, digits: int = 6) -> str:
    with_part, body = ("", sql)
    if sql.lstrip().lower().startswith("with ") and "\n--body\n" in sql:
        with_part, body = sql.split("\n--body\n")
    reps = ", ".join(f"round({c}, {digits}) + 0.0::double as {c}" for c in cols.split())
    return f"{with_part}\nselect * replace ({reps}) from ({body})"
