"""Manifest projections, row numbering, filters, train-side thresholds and seeded samples."""

from __future__ import annotations

from collections.abc import Collection, Mapping, Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession, Window, functions as F

from ..functions import scalars as X
from ..session import cut_lineage
from . import ranks as R
from .dedupe import first_per_key


def canonical_manifest(df: DataFrame, columns: Mapping[str, str], constants: Mapping[str, object], extra: Sequence[str] = ()) -> DataFrame:
    """Target columns from named sources or constants, plus extra columns under their own name."""
    out = [F.col(src).alias(dst) for dst, src in columns.items()]
    out += [F.lit(v).cast("string").alias(dst) if v is None else F.lit(v).alias(dst) for dst, v in constants.items()]
    out += [F.col(c) for c in extra if c not in columns and c not in constants]
    return df.select(*out)


def passthrough(df: DataFrame, reserved: Collection[str]) -> DataFrame:
    """Columns that collide with output names get an `input_` prefix."""
    return df.withColumnsRenamed({c: f"input_{c}" for c in df.columns if c in reserved})


def row_filter(
    df: DataFrame,
    allowed: Mapping[str, Sequence] | None = None,
    ignore_case: Mapping[str, Sequence[str]] | None = None,
    listed: Mapping[str, DataFrame] | None = None,
) -> DataFrame:
    """Value lists as pushed-down filters; long allow-lists as semi-joins."""
    for c, values in (allowed or {}).items():
        df = df.where(F.col(c).isin(*values))
    for c, values in (ignore_case or {}).items():
        df = df.where(F.lower(c).isin(*[v.lower() for v in values]))
    for c, keys in (listed or {}).items():
        df = df.join(keys.select(c), c, "left_semi")
    return df


def pick_case(df: DataFrame, predicate: str, order: Sequence[Column]) -> DataFrame:
    """First row that satisfies the predicate; an empty result is the caller's error to raise (`require_case`)."""
    return df.where(F.expr(predicate)).orderBy(*order).limit(1)


def require_case(df: DataFrame, predicate: str, order: Sequence[Column]):
    row = pick_case(df, predicate, order).first()
    if row is None:
        raise ValueError(f"no row satisfies {predicate}")
    return row


def dense_row_index(df: DataFrame, order: Sequence[str], name: str) -> DataFrame:
    """0-based dense index in the given order, over range partitions instead of one task.

    The sorted partitions are written to the shared folder first: partition numbers must not change
    between the counting and the numbering.
    """
    ranged = cut_lineage(df.repartitionByRange(*order).withColumn("_part", F.spark_partition_id()))
    before = Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    # One row per partition.
    starts = ranged.groupBy("_part").agg(F.count(F.lit(1)).alias("_n")).select("_part", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_start"))
    inside = Window.partitionBy("_part").orderBy(*order)
    return (
        ranged.withColumn("_rn", F.row_number().over(inside) - 1).join(starts, "_part")
        .withColumn(name, F.col("_start") + F.col("_rn")).drop("_part", "_start", "_rn")
    )


def file_row_index(spark: SparkSession, path: str, name: str) -> DataFrame:
    """0-based index in file order from the reader's own row positions: nothing is sorted or shuffled."""
    df = spark.read.parquet(path).select("*", F.col("_metadata.file_path").alias("_file"), F.col("_metadata.row_index").alias("_pos"))
    before = Window.orderBy("_file").rowsBetween(Window.unboundedPreceding, -1)
    # One row per file.
    starts = df.groupBy("_file").agg(F.count(F.lit(1)).alias("_n")).select("_file", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_start"))
    return df.join(starts, "_file").withColumn(name, F.col("_start") + F.col("_pos")).drop("_file", "_pos", "_start")


def add_levels(df: DataFrame, source: str, output: str, labels: Sequence[str] = ("low", "mid", "high", "Missing"), low: float = 0.25, high: float = 0.75) -> DataFrame:
    """Level column by two quantiles of the whole column; the two cut points are read once as numbers."""
    v = X.number_or_null(source)
    cuts = R.exact_quantiles(df.select(v.alias("v")), [], "v", {"lo": low, "hi": high}).first()
    if cuts["lo"] is None:
        return df.withColumn(output, F.lit(labels[3]))
    return df.withColumn(output, X.level_label(v, F.lit(cuts["lo"]), F.lit(cuts["hi"]), labels))


def train_median(train: DataFrame, column: str) -> Column:
    return R.exact_quantiles(train, [], column, {"m": 0.5}).select("m").scalar()


def hard_rows(df: DataFrame, metric: str, label: str, train: str, quantile: float, min_count: int, cut: float | None = None) -> DataFrame:
    """Rows at or below the train quantile (`cut`, where it is known already); `retained` marks labels with enough train rows among them."""
    if cut is None:
        cut = R.exact_quantiles(df.where(F.col(train)), [], metric, {"q": quantile}).first()["q"]
    hard = df.where(F.col(metric) <= F.lit(cut))
    common = hard.where(F.col(train) & F.col(label).isNotNull()).groupBy(label).agg(F.count(F.lit(1)).alias("_n")).where(F.col("_n") >= min_count)
    # One line a label. Dealt by label, all rows of a label would be one task's.
    return hard.join(F.broadcast(common.select(label, F.lit(True).alias("_common"))), label, "left").withColumn("retained", F.coalesce("_common", F.lit(False))).drop("_common")


def first_rows(df: DataFrame, order: Sequence[Column], n: int) -> DataFrame:
    return df.orderBy(*order).limit(n)


def _draw(key: Sequence[str], seed: int) -> Column:
    return F.xxhash64(*key, F.lit(seed))


def seeded_sample(df: DataFrame, key: Sequence[str], n: int, seed: int) -> DataFrame:
    """n rows by a hash of the key: the same rows under any partitioning."""
    return df.orderBy(_draw(key, seed), *key).limit(n)


def seeded_sample_per_group(df: DataFrame, group: Sequence[str], key: Sequence[str], n: int, seed: int) -> DataFrame:
    return first_per_key(df, group, [_draw(key, seed), *key], n)


def seeded_shuffle(df: DataFrame, key: Sequence[str], seed: int) -> DataFrame:
    return df.orderBy(_draw(key, seed), *key)


def union_frames(frames: Sequence[DataFrame]) -> DataFrame:
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), frames)
