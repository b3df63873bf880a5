"""Duplicate handling with an explicit order: nothing depends on file or partition order."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window, functions as F


def first_per_key(df: DataFrame, key: Sequence[str], order: Sequence[str | Column], n: int = 1) -> DataFrame:
    """First n rows per key. Spark limits each key on the map side, so a hot key shuffles n rows per task."""
    w = Window.partitionBy(*key).orderBy(*order)
    return df.withColumn("_rn", F.row_number().over(w)).where(F.col("_rn") <= n).drop("_rn")


def last_per_key(df: DataFrame, key: Sequence[str], order: Sequence[str]) -> DataFrame:
    return first_per_key(df, key, [F.col(o).desc_nulls_last() for o in order])


def duplicate_keys(df: DataFrame, key: Sequence[str]) -> DataFrame:
    return df.groupBy(*key).agg(F.count(F.lit(1)).alias("n_rows")).where(F.col("n_rows") > 1)


def duplicate_counts(df: DataFrame, key: Sequence[str]) -> DataFrame:
    """Rows, distinct keys, rows beyond the first of their key, rows sharing their key."""
    per_key = df.groupBy(*key).agg(F.count(F.lit(1)).alias("n"))
    return per_key.agg(
        F.coalesce(F.sum("n"), F.lit(0)).alias("n_rows"),
        F.count(F.lit(1)).alias("n_keys"),
        F.coalesce(F.sum(F.col("n") - 1), F.lit(0)).alias("n_extra"),
        F.coalesce(F.sum(F.when(F.col("n") > 1, F.col("n"))), F.lit(0)).alias("n_in_duplicates"),
    )


def conflicting_keys(df: DataFrame, key: Sequence[str], columns: Sequence[str] | None = None) -> DataFrame:
    """Keys with several rows that are not all alike; nulls compare as values."""
    columns = columns or [c for c in df.columns if c not in key]
    return (
        df.groupBy(*key, F.struct(*columns).alias("_row"))
        .agg(F.count(F.lit(1)).alias("_n"))
        .groupBy(*key)
        .agg(F.sum("_n").alias("n_rows"), F.count(F.lit(1)).alias("n_variants"))
        .where(F.col("n_variants") > 1)
    )


def first_non_null_per_key(df: DataFrame, key: Sequence[str], columns: Sequence[str], order: Sequence[str]) -> DataFrame:
    """One row per key: each column takes its first non-null value in the given order. Null keys stay."""
    rank = F.struct(*order)
    return df.groupBy(*key).agg(
        *[F.min_by(F.col(c), F.when(F.col(c).isNotNull(), rank)).alias(c) for c in columns]
    )


def varying_keys(df: DataFrame, key: Sequence[str], columns: Sequence[str], null_is_value: bool = False) -> DataFrame:
    """Per column, how many keys hold more than one value. Rows: column, n_varying."""
    per_key = df.groupBy(*key).agg(
        *[
            ((F.min(c) != F.max(c)) | (F.lit(null_is_value) & F.min(c).isNotNull() & (F.count(c) < F.count(F.lit(1))))).alias(c)
            for c in columns
        ]
    )
    one = per_key.agg(*[F.count_if(F.coalesce(F.col(c), F.lit(False))).alias(c) for c in columns])
    return one.unpivot([], list(columns), "column", "n_varying")


def keep_largest(df: DataFrame, key: Sequence[str], count: str, tie: Sequence[str]) -> DataFrame:
    """Rows with a count win over rows without, then the highest count, then the tie order."""
    return first_per_key(df, key, [F.col(count).desc_nulls_last(), *tie])
