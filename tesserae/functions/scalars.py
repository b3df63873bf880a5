"""Scalar rules shared by the operators (safe ratios, labels, row-wise statistics, rounding)."""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import Column, functions as F


def col(c: str | Column) -> Column:
    return F.col(c) if isinstance(c, str) else c


def no_nan(c: str | Column) -> Column:
    """NaN counts as missing everywhere; Spark would otherwise rank it largest."""
    return F.nanvl(col(c), F.lit(None).cast("double"))


def safe_divide(num: str | Column, den: str | Column, default: float = 0.0) -> Column:
    return F.when(col(den) > 0, col(num) / col(den)).otherwise(F.lit(default))


def ordinal_label(x: str | Column, thresholds: Sequence[float | Column], labels: Sequence[str]) -> Column:
    """Right-closed bins: label i holds thresholds[i-1] < x <= thresholds[i]. Null stays null."""
    if len(labels) != len(thresholds) + 1:
        raise ValueError("need one more label than thresholds")
    fixed = [t for t in thresholds if not isinstance(t, Column)]
    if any(b <= a for a, b in zip(fixed, fixed[1:])):
        raise ValueError("thresholds must increase strictly")
    x = col(x)
    out = F.when(x.isNull(), F.lit(None).cast("string"))
    for t, label in zip(thresholds, labels):
        out = out.when(x <= t, F.lit(label))
    return out.otherwise(F.lit(labels[-1]))


def level_label(
    x: str | Column,
    low: Column,
    high: Column,
    labels: Sequence[str] = ("low", "mid", "high", "Missing"),
    rtol: float = 1e-5,
    atol: float = 1e-8,
) -> Column:
    """Quantile level. Close cut points give every present value the middle label; high wins overlaps."""
    x = col(x)
    lo, mid, hi, missing = labels
    close = F.abs(low - high) <= F.lit(atol) + F.lit(rtol) * F.abs(high)
    return (
        F.when(x.isNull(), F.lit(missing))
        .when(close, F.lit(mid))
        .when(x >= high, F.lit(hi))
        .when(x <= low, F.lit(lo))
        .otherwise(F.lit(mid))
    )


def difficulty_tier(x: str | Column, low: Column, high: Column) -> Column:
    return level_label(x, low, high, ("hard", "medium", "easy", "Missing"))


def failure_flag(x: str | Column, threshold: float | Column) -> Column:
    """1 strictly below the threshold, 0 at or above it."""
    return (col(x) < threshold).cast("int")


def fraction_of(count: str | Column, total: str | Column) -> Column:
    return F.when(col(total) > 0, col(count) / col(total))


def at_max(cols: Sequence[str]) -> tuple[Column, Column]:
    """(row maximum, number of columns equal to it), nulls skipped."""
    top = F.greatest(*cols) if len(cols) > 1 else F.col(cols[0])
    hits = sum((F.coalesce((F.col(c) == top).cast("int"), F.lit(0)) for c in cols), F.lit(0))
    return top, hits


def unique_winner(cols: Sequence[str], names: Sequence[str] | None = None, tie: str = "tie") -> Column:
    """Name of the single largest column, else the tie label; null when every column is null."""
    names = names or cols
    top, hits = at_max(cols)
    out = F.when(top.isNull(), F.lit(None).cast("string")).when(hits > 1, F.lit(tie))
    for c, name in zip(cols, names):
        out = out.when(F.col(c) == top, F.lit(name))
    return out


def first_at_max(cols: Sequence[str], names: Sequence[str] | None = None) -> Column:
    """Name of the largest column, first one on ties."""
    names = names or cols
    top, _ = at_max(cols)
    out = F.when(top.isNull(), F.lit(None).cast("string"))
    for c, name in zip(cols, names):
        out = out.when(F.col(c) == top, F.lit(name))
    return out


def dominant_class(total: str | Column, cols: Sequence[str]) -> Column:
    return F.when(F.coalesce(col(total) > 0, F.lit(False)), unique_winner(cols)).otherwise(F.lit("none"))


def dominant_fraction(total: str | Column, cols: Sequence[str]) -> Column:
    return fraction_of(at_max(cols)[0], total)


def richness_label(
    total: str | Column,
    dominant: str | Column,
    fraction: str | Column,
    rich_labels: dict[str, str],
    threshold: float = 0.60,
) -> Column:
    total, dominant, fraction = col(total), col(dominant), col(fraction)
    out = F.when(F.coalesce(total <= 0, F.lit(True)), F.lit("no-nuclei"))
    for name, label in rich_labels.items():
        out = out.when((dominant == name) & (fraction >= threshold), F.lit(label))
    return out.otherwise(F.lit("mixed"))


def sorted_present(cols: Sequence[str | Column]) -> Column:
    return F.array_sort(F.array_compact(F.array(*[col(c) for c in cols])))


def row_median(cols: Sequence[str | Column]) -> Column:
    arr = sorted_present(cols)
    n = F.size(arr)
    upper = F.get(arr, F.floor(n / 2).cast("int"))
    lower = F.get(arr, F.floor((n - 1) / 2).cast("int"))
    return F.when(n > 0, (lower + upper) / 2)


def row_mean(cols: Sequence[str | Column]) -> Column:
    arr = sorted_present(cols)
    return F.when(F.size(arr) > 0, F.aggregate(arr, F.lit(0.0), lambda a, v: a + v) / F.size(arr))


def row_std(cols: Sequence[str | Column], ddof: int = 1) -> Column:
    arr = sorted_present(cols)
    mean = row_mean(cols)
    ss = F.aggregate(arr, F.lit(0.0), lambda a, v: a + (v - mean) * (v - mean))
    return F.when(F.size(arr) > ddof, F.sqrt(ss / (F.size(arr) - ddof)))


def top_two_gap(cols: Sequence[str | Column]) -> Column:
    """Largest minus second largest; null unless every column is present."""
    arr = F.sort_array(F.array(*[col(c) for c in cols]), asc=False)
    present = sum((col(c).isNotNull().cast("int") for c in cols), F.lit(0)) == len(cols)
    return F.when(present, F.get(arr, F.lit(0)) - F.get(arr, F.lit(1)))


def failure_mode(deficits: dict[str, str], margin: float) -> Column:
    """Label of the largest deficit when it leads by `margin`; first column wins equal deficits."""
    cols = list(deficits)
    gap = top_two_gap(cols)
    return F.when(gap >= margin, first_at_max(cols, [deficits[c] for c in cols]))


def circularity(area: str | Column, perimeter: str | Column) -> Column:
    p = col(perimeter)
    return F.when(p > 0, F.lit(4 * math.pi) * col(area) / (p * p))


def ratio_or_null(num: str | Column, den: str | Column) -> Column:
    return F.when(col(den) > 0, col(num) / col(den))


def equivalent_diameter(area: str | Column) -> Column:
    return F.sqrt(F.lit(4.0 / math.pi) * col(area))


def target_size(length: str | Column, factor: str | Column) -> Column:
    """Half-even rounding, at least one pixel."""
    return F.greatest(F.lit(1), F.bround(col(length) * col(factor), 0).cast("int"))


def clip(x: str | Column, lo: float | Column, hi: float | Column) -> Column:
    lo = lo if isinstance(lo, Column) else F.lit(lo)
    hi = hi if isinstance(hi, Column) else F.lit(hi)
    return F.least(F.greatest(col(x), lo), hi)


def tile_descriptor(x0: str | Column, y0: str | Column) -> Column:
    return F.format_string("%05dx_%05dy", col(x0), col(y0))


def affine(x: str | Column, y: str | Column, scale: tuple, shift: tuple, size: tuple | None = None) -> tuple[Column, Column]:
    """(x, y) scaled then shifted per axis; clamped to [0, size-1] when a size is given."""
    out = [col(v) * s + d for v, s, d in zip((x, y), scale, shift)]
    if size is not None:
        out = [clip(v, 0.0, F.lit(n) - 1.0) for v, n in zip(out, size)]
    return out[0], out[1]


def integer_or_null(c: str | Column) -> Column:
    """3.0 -> 3; missing -> null; fractional -> null (count those with `not_integer`)."""
    v = no_nan(col(c).cast("double"))
    return F.when(v == F.floor(v), v.cast("long"))


def not_integer(c: str | Column) -> Column:
    v = no_nan(col(c).cast("double"))
    return F.coalesce(v != F.floor(v), F.lit(False))


def number_or_null(c: str | Column) -> Column:
    return no_nan(col(c).try_cast("double"))


def finite_or_null(c: str | Column) -> Column:
    v = no_nan(c)
    return F.when(F.abs(v) < float("inf"), v)


def json_row(names: Sequence[str], doubles: Sequence[str] = ()) -> Column:
    """JSON text of the row; NaN and infinities become null and keep their key."""
    fields = [(finite_or_null(n) if n in doubles else F.col(n)).alias(n) for n in names]
    return F.to_json(F.struct(*fields), {"ignoreNullFields": "false"})
