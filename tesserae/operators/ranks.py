"""Exact ranks, quantiles and cumulative counts without putting a group on one task.

Rows are first collapsed to one row per (group, value), so a value held by a third of all rows costs
one row. Groups that still have many distinct values are cut into value ranges; running sums are taken
inside a range and shifted by the totals of the ranges before it. The range bounds come from a mergeable
sketch over a hash-chosen part of the distinct values; they only balance the work, and every row goes
through, so results are exact for any bounds.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window, functions as F
from pyspark.sql.types import DoubleType, FloatType

from .spread import spread_join

_COARSE, _FINE = 32, 32
# One text literal instead of a thousand number literals keeps the plan small; it is folded to a constant.
_CUTS = "cast(split('" + ",".join(repr(i / (_COARSE * _FINE)) for i in range(1, _COARSE * _FINE)) + "', ',') as array<double>)"
SPLIT_ABOVE = 500_000  # distinct values of a group before it is cut into ranges
BOUND_EVERY = 64  # one in this many distinct values feeds the bounds


def _range_of(value: str) -> Column:
    """Number of cut points below the value, found through every 32nd cut and then the 31 between."""
    v = F.col(value)
    coarse = F.size(F.filter(F.col("_coarse"), lambda c: c < v))
    fine = F.size(F.filter(F.slice(F.col("_cuts"), coarse * _FINE + 1, _FINE - 1), lambda c: c < v))
    return F.when(F.col("_cuts").isNull(), F.lit(0)).otherwise(coarse * _FINE + fine)


def present(df: DataFrame, value: str) -> Column:
    """Whether a column holds a value; NaN is none."""
    held = F.col(value).isNotNull()
    return held & ~F.isnan(value) if isinstance(df.schema[value].dataType, (DoubleType, FloatType)) else held


def value_ranks(
    df: DataFrame,
    by: Sequence[str],
    value: str,
    sums: Mapping[str, Column] | None = None,
    split_above: int = SPLIT_ABOVE,
) -> DataFrame:
    """One row per (group, value): `n`, `before` (rows with a smaller value), `total`.

    Every entry of `sums` adds `<name>`, `before_<name>` and `total_<name>` in the same way.
    Null and NaN values are left out. Group keys may be null.
    """
    keys = [f"_g{i}" for i in range(len(by))]
    sums = {"n": F.count(F.lit(1)), **(sums or {})}
    names = list(sums)
    counted = (
        df.where(present(df, value))
        .groupBy(*[F.col(b).alias(k) for b, k in zip(by, keys)], F.col(value).alias("_v"))
        .agg(*[e.alias(n) for n, e in sums.items()])
    )
    # Null-safe group identity as one column, so that equi-joins keep null groups.
    ident = F.to_json(F.struct(*keys)) if keys else F.lit("")
    counted = counted.withColumn("_id", ident)
    # `_all` keeps every counted column in this branch, so that it reads the same shuffle as the others.
    cuts = (
        counted.withColumn("_b", F.when(F.pmod(F.xxhash64("_v"), F.lit(BOUND_EVERY)) == 0, F.col("_v")))
        .groupBy("_id")
        .agg(
            F.count(F.lit(1)).alias("_d"),
            F.expr(f"percentile_approx(_b, {_CUTS}, 10000)").alias("_cuts"),
            F.max(F.struct(*names)).alias("_all"),
        )
        .where((F.col("_d") > split_above) & F.col("_cuts").isNotNull() & F.col("_all").isNotNull())
        .select(
            "_id",
            "_cuts",
            F.transform(F.sequence(F.lit(_FINE), F.lit(_COARSE * _FINE - 1), F.lit(_FINE)), lambda i: F.get(F.col("_cuts"), i - 1)).alias("_coarse"),
        )
    )
    ranged = spread_join(counted, cuts, ["_id"], "left").withColumn("_r", _range_of("_v")).drop("_cuts", "_coarse")
    over_ranges = Window.partitionBy("_id").orderBy("_r").rowsBetween(Window.unboundedPreceding, -1)
    whole = Window.partitionBy("_id")
    offsets = (
        ranged.groupBy("_id", "_r")
        .agg(*[F.sum(n).alias(n) for n in names])
        .select(
            "_id",
            "_r",
            *[F.coalesce(F.sum(n).over(over_ranges), F.lit(0)).alias(f"_o_{n}") for n in names],
            *[F.sum(n).over(whole).alias(f"_t_{n}") for n in names],
        )
    )
    inside = Window.partitionBy("_id", "_r").orderBy("_v").rowsBetween(Window.unboundedPreceding, 0)
    joined = ranged.join(offsets, ["_id", "_r"])
    out = [F.col(k).alias(b) for b, k in zip(by, keys)] + [F.col("_v").alias(value)]
    for n in names:
        suffix = "" if n == "n" else f"_{n}"
        out.append(F.col(n))
        out.append((F.col(f"_o_{n}") + F.sum(n).over(inside) - F.col(n)).alias(f"before{suffix}"))
        out.append(F.col(f"_t_{n}").alias(f"total{suffix}"))
    return joined.select(*out)


def average_rank() -> Column:
    """Rank with ties averaged, from the columns of `value_ranks`."""
    return F.col("before") + (F.col("n") + 1) / 2.0


def quantile_columns(probs: Mapping[str, float], value: str) -> list[Column]:
    """Aggregates over `value_ranks` rows giving linearly interpolated quantiles."""
    out = []
    for name, p in probs.items():
        pos = F.lit(float(p)) * (F.col("total") - 1)
        lo, hi = F.floor(pos), F.ceil(pos)

        def at(i: Column) -> Column:
            return F.max(F.when((F.col("before") <= i) & (i < F.col("before") + F.col("n")), F.col(value)))

        frac = F.max(pos - lo)
        out.append((at(lo) + (at(hi) - at(lo)) * frac).alias(name))
    return out


def exact_quantiles(
    df: DataFrame, by: Sequence[str], value: str, probs: Mapping[str, float], split_above: int = SPLIT_ABOVE
) -> DataFrame:
    """One row per group with a column per probability, plus `n`."""
    ranks = value_ranks(df, by, value, split_above=split_above)
    return ranks.groupBy(*by).agg(*quantile_columns(probs, value), F.max("total").alias("n"))


def quantile_edges(df: DataFrame, by: Sequence[str], value: str, q: int, duplicates: str = "raise") -> DataFrame:
    """`edges` array of q+1 interpolated quantiles per group."""
    names = [f"_e{i}" for i in range(q + 1)]
    edges = exact_quantiles(df, by, value, {n: i / q for i, n in enumerate(names)})
    arr = F.array(*names)
    if duplicates == "drop":
        arr = F.array_distinct(arr)
    elif duplicates == "raise":
        arr = F.when(F.size(F.array_distinct(arr)) == q + 1, arr).otherwise(
            F.raise_error(F.lit("bucket edges are not unique")).cast("array<double>")
        )
    else:
        raise ValueError("duplicates is 'raise' or 'drop'")
    return edges.select(*by, arr.alias("edges"), "n")


def global_edges(df: DataFrame, value: str, q: int, duplicates: str = "raise") -> list[float]:
    """The q+1 bounds of the whole column as plain numbers; equal bounds raise or are dropped."""
    row = exact_quantiles(df, [], value, {f"e{i}": i / q for i in range(q + 1)}).first()
    bounds = [row[f"e{i}"] for i in range(q + 1)]
    if bounds[0] is None:
        return []
    distinct = sorted(set(bounds))
    if duplicates == "raise" and len(distinct) != q + 1:
        raise ValueError("bucket edges are not unique")
    return distinct


def bucket_by(value: str | Column, bounds: Sequence[float]) -> Column:
    """Like `bucket_of` for bounds known as numbers."""
    v = F.col(value) if isinstance(value, str) else value
    if len(bounds) < 2:
        return F.lit(None).cast("int")
    above = sum((F.when(v > b, 1).otherwise(0) for b in bounds[1:-1]), F.lit(0))
    return F.when((v >= bounds[0]) & (v <= bounds[-1]), above + 1)


def bucket_of(value: str | Column, edges: str | Column, q: int) -> Column:
    """1-based right-closed interval of the value; the lowest edge belongs to the first interval.

    `edges` is an array of at most q+1 increasing bounds (fewer once equal bounds are dropped).
    """
    v = F.col(value) if isinstance(value, str) else value
    e = F.col(edges) if isinstance(edges, str) else edges
    last = F.size(e) - 1
    above = sum(
        (F.when((F.lit(i) < last) & (v > F.get(e, F.lit(i))), 1).otherwise(0) for i in range(1, q)), F.lit(0)
    )
    return F.when((v >= F.get(e, F.lit(0))) & (v <= F.get(e, last)), above + 1)


def attach_by_value(
    rows: DataFrame, ranks: DataFrame, by: Sequence[str], value: str, payload: Sequence[str], heavy_share: int = 1000
) -> DataFrame:
    """Left join rows to their (group, value) line of `ranks`, whatever the skew of the value.

    Lines that hold more than 1/heavy_share of all rows (so fewer than heavy_share lines) are broadcast;
    their rows are spread over partitions instead of following the key.
    """
    keys = [*by, value]
    everything = ranks.agg(F.sum("n").alias("t")).scalar()
    heavy = ranks.where(F.col("n") * heavy_share > everything).select(
        *[F.col(k).alias(f"_h_{k}") for k in keys], *[F.col(p).alias(f"_hp_{p}") for p in payload], F.lit(True).alias("_heavy")
    )
    light = ranks.select(*keys, *[F.col(p).alias(f"_lp_{p}") for p in payload]).withColumn("_salt", F.lit(0))
    on_heavy = [F.col(k).eqNullSafe(F.col(f"_h_{k}")) for k in keys]
    cond = on_heavy[0]
    for c in on_heavy[1:]:
        cond = cond & c
    marked = rows.join(F.broadcast(heavy), cond, "left").drop(*[f"_h_{k}" for k in keys])
    marked = marked.withColumn(
        "_salt", F.when(F.col("_heavy"), F.lit(1) + F.pmod(F.xxhash64(*rows.columns), F.lit(1_000_003)).cast("int")).otherwise(F.lit(0))
    )
    joined = marked.join(light, [*keys, "_salt"], "left")
    return joined.select(
        *rows.columns, *[F.coalesce(F.col(f"_hp_{p}"), F.col(f"_lp_{p}")).alias(p) for p in payload]
    )
