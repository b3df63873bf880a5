"""Shape and intensity features of label masks."""

from __future__ import annotations

import math
from collections.abc import Sequence

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, functions as F

from ..functions import scalars as X
from .masks import foreground


def instance_shapes(mask: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Area, box, centroid, second-moment axes, eccentricity and orientation from one aggregation."""
    base = foreground(mask).groupBy(*keys, "label").agg(
        F.count(F.lit(1)).alias("area_pixels"),
        F.min("row").alias("bbox_min_row"),
        F.min("col").alias("bbox_min_col"),
        (F.max("row") + 1).alias("bbox_max_row"),
        (F.max("col") + 1).alias("bbox_max_col"),
        F.avg("row").alias("centroid_row"),
        F.avg("col").alias("centroid_col"),
        F.var_pop("row").alias("_rr"),
        F.var_pop("col").alias("_cc"),
        F.covar_pop("row", "col").alias("_rc"),
    )
    half = (F.col("_rr") + F.col("_cc")) / 2
    root = F.sqrt(F.pow((F.col("_rr") - F.col("_cc")) / 2, 2) + F.col("_rc") * F.col("_rc"))
    rr_cc = F.round(F.col("_rr") - F.col("_cc"), 12)
    rc = F.round(F.col("_rc"), 12)
    orientation = (
        F.when((rr_cc == 0) & (rc > 0), math.pi / 4)
        .when(rr_cc == 0, -math.pi / 4)
        .otherwise(F.atan2(2 * rc, rr_cc) / 2)
    )
    return (
        base.withColumn("_l1", half + root)
        .withColumn("_l2", F.greatest(half - root, F.lit(0.0)))
        .withColumns(
            {
                "bbox_area": ((F.col("bbox_max_row") - F.col("bbox_min_row")) * (F.col("bbox_max_col") - F.col("bbox_min_col"))).cast("bigint"),
                "equivalent_diameter": X.equivalent_diameter("area_pixels"),
                "major_axis_length": 4 * F.sqrt("_l1"),
                "minor_axis_length": 4 * F.sqrt("_l2"),
                "eccentricity": F.when(F.col("_l1") > 0, F.sqrt(F.greatest(1 - F.col("_l2") / F.col("_l1"), F.lit(0.0)))).otherwise(0.0),
                "orientation_deg": F.degrees(orientation),
            }
        )
        .withColumns(
            {
                "aspect_ratio": F.when(F.round("minor_axis_length", 9) > 0, F.col("major_axis_length") / F.col("minor_axis_length")),
                "fill_ratio": X.ratio_or_null("area_pixels", "bbox_area"),
            }
        )
        .withColumn("extent", F.col("fill_ratio"))
        .drop("_rr", "_cc", "_rc", "_l1", "_l2")
    )


# Neighbour code weights and the length each code adds to a perimeter.
_DIAGONAL, _STRAIGHT, _SELF = 10, 2, 1
_UNIT_CODES = (5, 7, 15, 17, 25, 27)
_DIAGONAL_CODES = (21, 33)
_MIXED_CODES = (13, 23)


def perimeters(mask: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Perimeter per instance from the neighbour codes of its border pixels (4-neighbour border)."""
    place = [*keys, "label", "row", "col"]
    fg = foreground(mask).select(*place)
    cross = F.array(*[F.struct(F.lit(r).alias("r"), F.lit(c).alias("c"), F.lit(s).alias("s")) for r, c, s in ((0, 0, 4), (-1, 0, 1), (1, 0, 1), (0, -1, 1), (0, 1, 1))])
    moved = fg.withColumn("_d", F.explode(cross)).select(
        *keys, "label", (F.col("row") + F.col("_d.r")).alias("row"), (F.col("col") + F.col("_d.c")).alias("col"), F.col("_d.s").alias("s")
    )
    # A pixel of the instance scores 4 for itself; below 8 some straight neighbour is missing.
    border = moved.groupBy(*place).agg(F.max("s").alias("own"), F.sum("s").alias("t")).where((F.col("own") == 4) & (F.col("t") < 8)).select(*place)
    around = F.array(
        *[
            F.struct(F.lit(r).alias("r"), F.lit(c).alias("c"), F.lit(_SELF if not (r or c) else _DIAGONAL if r and c else _STRAIGHT).alias("w"))
            for r in (-1, 0, 1)
            for c in (-1, 0, 1)
        ]
    )
    codes = (
        border.withColumn("_d", F.explode(around))
        .select(*keys, "label", (F.col("row") + F.col("_d.r")).alias("row"), (F.col("col") + F.col("_d.c")).alias("col"), F.col("_d.w").alias("w"))
        .groupBy(*place).agg(F.sum("w").alias("code"))
    )
    length = (
        F.when(F.col("code").isin(*_UNIT_CODES), 1.0)
        .when(F.col("code").isin(*_DIAGONAL_CODES), math.sqrt(2))
        .when(F.col("code").isin(*_MIXED_CODES), (1 + math.sqrt(2)) / 2)
        .otherwise(0.0)
    )
    return codes.groupBy(*keys, "label").agg(F.sum(length).alias("perimeter_pixels"))


def _hull_counter():
    """Pandas UDF body: pixel centres inside the hull of each instance, many instances per Arrow batch."""

    def one(r: np.ndarray, a: np.ndarray, b: np.ndarray) -> int:
        # Midpoints of the outer pixel edges: left and right of each row, above and below both of its ends.
        pts = np.concatenate(
            [
                np.column_stack([np.r_[r, r], np.r_[a - 0.5, b + 0.5]]),
                np.column_stack([np.r_[r - 0.5, r - 0.5], np.r_[a, b]]),
                np.column_stack([np.r_[r + 0.5, r + 0.5], np.r_[a, b]]),
            ]
        )
        pts = pts[np.lexsort((pts[:, 1], pts[:, 0]))].tolist()

        def side(sign: int) -> np.ndarray:
            out = []
            for p in pts:
                while len(out) > 1:
                    (r1, c1), (r2, c2) = out[-2], out[-1]
                    if sign * ((r2 - r1) * (p[1] - c1) - (c2 - c1) * (p[0] - r1)) > 0:
                        break
                    out.pop()
                out.append(p)
            return np.array(out)

        rows = np.arange(r.min(), r.max() + 1)
        ends = np.stack([np.interp(rows, chain[:, 0], chain[:, 1]) for chain in (side(1), side(-1))])
        left, right = ends.min(axis=0), ends.max(axis=0)
        return int(np.maximum(np.floor(right + 1e-10) - np.ceil(left - 1e-10) + 1, 0).sum())

    def count(rows: pd.Series, first: pd.Series, last: pd.Series) -> pd.Series:
        return pd.Series([one(*(np.asarray(x, dtype=float) for x in t)) for t in zip(rows, first, last)], dtype="int64")

    return count


def hull_areas(mask: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Pixels inside the convex hull of each instance.

    Spark reduces an instance to one (row, first col, last col) entry per row; only those short lists,
    as long as the instance is high, reach Python.
    """
    names = [*keys, "label"]
    lines = foreground(mask).groupBy(*names, "row").agg(F.min("col").alias("a"), F.max("col").alias("b"))
    lists = lines.groupBy(*names).agg(F.collect_list(F.struct("row", "a", "b")).alias("_l"))
    hull = F.pandas_udf(_hull_counter(), "bigint")
    return lists.select(*names, hull(F.col("_l.row"), F.col("_l.a"), F.col("_l.b")).alias("hull_area"))


def full_features(mask: DataFrame, keys: Sequence[str]) -> DataFrame:
    """All instance features including perimeter and hull ratios."""
    on = [*keys, "label"]
    return (
        instance_shapes(mask, keys)
        .join(perimeters(mask, keys), on)
        .join(hull_areas(mask, keys), on)
        .withColumns(
            {
                "circularity": X.circularity("area_pixels", "perimeter_pixels"),
                "perimeter_area_ratio": X.ratio_or_null("perimeter_pixels", "area_pixels"),
                "solidity": X.ratio_or_null("area_pixels", "hull_area"),
            }
        )
        .drop("hull_area")
    )


def patch_summary(images: DataFrame, objects: DataFrame, keys: Sequence[str], shape_columns: Sequence[str]) -> DataFrame:
    """One row per image: object count, area totals and means of finite values; empty images keep nulls.

    An image's objects form one group of its median; their number is bounded by its pixels.
    """
    finite = {c: X.finite_or_null(F.col(c).cast("double")) for c in ("area_pixels", *shape_columns)}
    per = objects.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("num_objects"),
        F.sum("area_pixels").alias("total_mask_area"),
        F.avg(finite["area_pixels"]).alias("mean_area"),
        F.median(finite["area_pixels"]).alias("median_area"),
        F.stddev_pop(finite["area_pixels"]).alias("std_area"),
        *[F.avg(finite[c]).alias(f"mean_{c}") for c in shape_columns],
    )
    return (
        images.select(*keys, "height", "width").join(per, list(keys), "left").na.fill(0, ["num_objects", "total_mask_area"])
        .withColumn("foreground_fraction", X.ratio_or_null("total_mask_area", F.col("height").cast("bigint") * F.col("width")))
    )


def object_filters(objects: DataFrame, keys: Sequence[str], min_area: int = 0, max_objects: int | None = None) -> tuple[DataFrame, DataFrame]:
    """(objects of accepted images, failed images): small objects go, images with too many objects fail whole."""
    kept = objects.where(F.col("area_pixels") >= min_area)
    if max_objects is None:
        return kept, kept.select(*keys).limit(0).withColumns({"n_objects": F.lit(0).cast("bigint"), "failure_stage": F.lit("")})
    counts = kept.groupBy(*keys).agg(F.count(F.lit(1)).alias("n_objects")).where(F.col("n_objects") > max_objects)
    return kept.join(counts, list(keys), "left_anti"), counts.withColumn("failure_stage", F.lit("feature_extraction"))


def intensity(pixels: DataFrame, keys: Sequence[str], channels: Sequence[str] = ("r", "g", "b")) -> DataFrame:
    """Mean and population std per channel, whole image and foreground (label > 0)."""
    aggs = []
    for c in channels:
        inside = F.when(F.col("label") > 0, F.col(c))
        aggs += [
            F.avg(c).alias(f"image_mean_{c}"),
            F.stddev_pop(c).alias(f"image_std_{c}"),
            F.avg(inside).alias(f"foreground_mean_{c}"),
            F.stddev_pop(inside).alias(f"foreground_std_{c}"),
        ]
    return pixels.groupBy(*keys).agg(*aggs)
