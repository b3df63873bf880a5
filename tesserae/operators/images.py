"""Tiles, rescaling, morphology and intensity over pixel tables."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window, functions as F

from ..functions import scalars as X
from .spread import spread_join


def _starts(length: Column, size: Column, stride: Column, at_least_one: bool) -> Column:
    last = length.cast("bigint") - size
    if at_least_one:
        last = F.greatest(last, F.lit(0).cast("bigint"))
    # An empty array, not a downward sequence, when the image is smaller than a tile.
    return F.when(last >= 0, F.sequence(F.lit(0).cast("bigint"), F.greatest(last, F.lit(0).cast("bigint")), stride.cast("bigint"))).otherwise(
        F.array().cast("array<bigint>")
    )


def full_tiles(images: DataFrame, sample: str, size: int, stride: int) -> DataFrame:
    """Tiles that fit whole; row-major index by arithmetic. Images smaller than a tile give no row."""
    s, d = F.lit(size), F.lit(stride)
    tiles = images.withColumn("patch_cols", F.size(_starts(F.col("width"), s, d, False)))
    tiles = tiles.select("*", F.posexplode(_starts(F.col("height"), s, d, False)).alias("patch_row", "y0"))
    tiles = tiles.select("*", F.posexplode(_starts(F.col("width"), s, d, False)).alias("patch_col", "x0"))
    return tiles.withColumns(
        {
            "x1": F.col("x0") + size,
            "y1": F.col("y0") + size,
            "patch_index": (F.col("patch_row") * F.col("patch_cols") + F.col("patch_col")).cast("bigint"),
            "patch_id": F.concat(F.col(sample).cast("string"), F.lit("."), X.tile_descriptor("x0", "y0")),
        }
    )


def tile_counts(images: DataFrame, sample: str, size: int, stride: int) -> DataFrame:
    """Tile rows, columns and total per image, zeros included, without making the tiles."""

    def n(length: str) -> Column:
        return F.when(F.col(length) >= size, F.floor((F.col(length) - size) / stride) + 1).otherwise(F.lit(0)).cast("bigint")

    return images.select(sample, n("height").alias("patch_rows"), n("width").alias("patch_cols")).withColumn(
        "patch_count", F.col("patch_rows") * F.col("patch_cols")
    )


def slide_tiles(slides: DataFrame, slide: str, tile_size: int, overlap: int, target_mpp: float) -> DataFrame:
    """Grid at a physical scale: size and stride grow with target/native mpp; a small slide still gives one tile."""
    if not 0 <= overlap < tile_size:
        raise ValueError("overlap must be in [0, tile_size)")
    scale = F.lit(float(target_mpp)) / F.col("mpp")
    sized = slides.withColumns(
        {
            "tile_size_level0": F.greatest(F.lit(1), F.bround(scale * tile_size).cast("int")),
            "stride_level0": F.greatest(F.lit(1), F.bround(scale * (tile_size - overlap)).cast("int")),
        }
    )
    xs = _starts(F.col("width"), F.col("tile_size_level0"), F.col("stride_level0"), True)
    ys = _starts(F.col("height"), F.col("tile_size_level0"), F.col("stride_level0"), True)
    return sized.select("*", F.explode(ys).alias("tile_y")).select("*", F.explode(xs).alias("tile_x"))


def crop_to_tiles(pixels: DataFrame, keys: Sequence[str], size: int, stride: int, height: str = "height", width: str = "width") -> DataFrame:
    """Each pixel goes to every whole tile that covers it: its tile rows and columns follow from division."""

    def covering(pos: str, length: str) -> Column:
        first = F.greatest(F.lit(0).cast("bigint"), F.ceil((F.col(pos) - size + 1) / stride))
        last = F.least(F.floor(F.col(pos) / stride), F.floor((F.col(length) - size) / stride))
        return F.when((F.col(length) >= size) & (last >= first), F.sequence(first, F.greatest(last, first))).otherwise(F.array().cast("array<bigint>"))

    placed = pixels.select("*", F.explode(covering("row", height)).alias("patch_row")).select(
        "*", F.explode(covering("col", width)).alias("patch_col")
    )
    return placed.withColumns(
        {"tile_row": F.col("row") - F.col("patch_row") * stride, "tile_col": F.col("col") - F.col("patch_col") * stride}
    )


def _down_bin(pos: Column, source: Column, target: Column) -> Column:
    """Output pixel whose window holds the centre of the input pixel; every input pixel has exactly one."""
    return F.least(F.ceil((pos + 0.5) * target / source) - 1, target - 1).cast("int")


def _byte_mean(total: Column, n: Column) -> Column:
    return F.floor(total / n + 0.5)


def _window_width(out: Column, source: Column, target: Column) -> Column:
    """Input pixels whose centres fall in one output window."""
    lo = F.floor(out * source / target - 0.5) + 1
    hi = F.floor((out + 1) * source / target - 0.5)
    return F.least(hi, source - 1) - F.greatest(lo, F.lit(0)) + 1


def downscale_mask(mask: DataFrame, sizes: DataFrame, keys: Sequence[str], factor: float, min_fraction: float) -> DataFrame:
    """Label mask shrunk by label: columns then rows averaged in 8-bit steps as the image library does,
    labels below the fraction dropped, highest share wins, lowest label on equal shares.

    Returns foreground pixels only; `sizes` carries height and width per image.
    """
    keys = list(keys)
    shape = sizes.select(*keys, "height", "width", X.target_size("height", F.lit(factor)).alias("_th"), X.target_size("width", F.lit(factor)).alias("_tw"))
    fg = spread_join(mask.where(F.col("label") > 0), shape, keys).select(
        *keys, "label", "row", "height", "width", "_th", "_tw", _down_bin(F.col("col"), F.col("width"), F.col("_tw")).alias("tcol")
    )
    dims = ["height", "width", "_th", "_tw"]
    across = fg.groupBy(*keys, *dims, "label", "row", "tcol").agg(F.count(F.lit(1)).alias("n")).withColumn(
        "q", _byte_mean(F.col("n") * 255.0, _window_width(F.col("tcol"), F.col("width"), F.col("_tw")))
    )
    down = (
        across.withColumn("trow", _down_bin(F.col("row"), F.col("height"), F.col("_th")))
        .groupBy(*keys, *dims, "label", "trow", "tcol").agg(F.sum("q").alias("q"))
        .withColumn("score", _byte_mean(F.col("q"), _window_width(F.col("trow"), F.col("height"), F.col("_th"))) / 255.0)
    )
    ok = down.where((F.col("score") >= min_fraction) & (F.col("score") > 0))
    best = ok.groupBy(*keys, "trow", "tcol").agg(F.min_by("label", F.struct(-F.col("score"), F.col("label"))).alias("label"))
    return best.select(*keys, F.col("trow").alias("row"), F.col("tcol").alias("col"), "label")


def upscale_mask(mask: DataFrame, sizes: DataFrame, keys: Sequence[str], factor: float) -> DataFrame:
    """Nearest-neighbour enlargement: each pixel is repeated over the output pixels that map back to it."""
    keys = list(keys)
    shape = sizes.select(*keys, "height", "width", X.target_size("height", F.lit(factor)).alias("_th"), X.target_size("width", F.lit(factor)).alias("_tw"))

    def outs(pos: str, source: str, target: str) -> Column:
        ratio = F.col(target) / F.col(source)
        lo, hi = F.ceil(F.col(pos) * ratio - 0.5), F.ceil((F.col(pos) + 1) * ratio - 0.5) - 1
        return F.when(hi >= lo, F.sequence(lo, F.greatest(hi, lo))).otherwise(F.array().cast("array<bigint>"))

    fg = spread_join(mask.where(F.col("label") > 0), shape, keys)
    return (
        fg.withColumn("_r", F.explode(outs("row", "height", "_th"))).withColumn("_c", F.explode(outs("col", "width", "_tw")))
        .select(*keys, F.col("_r").cast("int").alias("row"), F.col("_c").cast("int").alias("col"), "label")
    )


def downscale_channels(pixels: DataFrame, sizes: DataFrame, keys: Sequence[str], factor: float, channels: Sequence[str]) -> DataFrame:
    """Box downscale of colour values, columns then rows, rounded to whole values after each."""
    keys = list(keys)
    shape = sizes.select(*keys, "height", "width", X.target_size("height", F.lit(factor)).alias("_th"), X.target_size("width", F.lit(factor)).alias("_tw"))
    p = spread_join(pixels, shape, keys).withColumn("tcol", _down_bin(F.col("col"), F.col("width"), F.col("_tw")))
    across = p.groupBy(*keys, "height", "_th", "row", "tcol").agg(*[F.floor(F.avg(c) + 0.5).alias(c) for c in channels])
    down = across.withColumn("trow", _down_bin(F.col("row"), F.col("height"), F.col("_th")))
    return down.groupBy(*keys, F.col("trow").alias("row"), F.col("tcol").alias("col")).agg(*[F.floor(F.avg(c) + 0.5).alias(c) for c in channels])


def rescale_bookkeeping(before: DataFrame, after: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Instance counts before and after, and the sorted list of labels that vanished (an image's label list)."""
    keys = list(keys)
    a = before.where(F.col("label") > 0).select(*keys, "label").distinct()
    b = after.where(F.col("label") > 0).select(*keys, "label").distinct().withColumn("_kept", F.lit(1))
    return a.join(b, [*keys, "label"], "left").groupBy(*keys).agg(
        F.count(F.lit(1)).alias("original_instance_count"),
        F.count("_kept").alias("resized_instance_count"),
        F.count_if(F.col("_kept").isNull()).alias("dropped_instance_count"),
        F.array_join(F.array_sort(F.collect_list(F.when(F.col("_kept").isNull(), F.col("label")))).cast("array<string>"), ",").alias("dropped_instance_labels"),
    )


def merge_instances(pixels: DataFrame, keys: Sequence[str], instance: str) -> DataFrame:
    """Per-instance pixels to one mask: the later instance wins a pixel; `overlaps` counts the rewrites."""
    return pixels.groupBy(*keys, "row", "col").agg(F.max(instance).alias("label"), (F.count(F.lit(1)) - 1).alias("overlaps"))


def pad_offsets(images: DataFrame, target: int) -> DataFrame:
    """Centred square pad; images beyond the target carry a failure stage."""
    return images.withColumns(
        {
            "pad_y0": F.floor((F.lit(target) - F.col("height")) / 2).cast("int"),
            "pad_x0": F.floor((F.lit(target) - F.col("width")) / 2).cast("int"),
            "failure_stage": F.when((F.col("height") > target) | (F.col("width") > target), F.lit("image_larger_than_pad")),
        }
    )


def to_padded(pixels: DataFrame, offsets: DataFrame, keys: Sequence[str]) -> DataFrame:
    o = offsets.where(F.col("failure_stage").isNull()).select(*keys, "pad_y0", "pad_x0")
    return spread_join(pixels, o, keys).withColumns({"row": F.col("row") + F.col("pad_y0"), "col": F.col("col") + F.col("pad_x0")}).drop("pad_y0", "pad_x0")


def crop_to_extent(pixels: DataFrame, offsets: DataFrame, keys: Sequence[str]) -> DataFrame:
    o = offsets.where(F.col("failure_stage").isNull()).select(*keys, "pad_y0", "pad_x0", "height", "width")
    back = spread_join(pixels, o, keys).withColumns({"row": F.col("row") - F.col("pad_y0"), "col": F.col("col") - F.col("pad_x0")})
    return back.where(
        (F.col("row") >= 0) & (F.col("col") >= 0) & (F.col("row") < F.col("height")) & (F.col("col") < F.col("width"))
    ).drop("pad_y0", "pad_x0", "height", "width")


def _covered(runs: DataFrame, keys: list[str], need: Column) -> DataFrame:
    """Maximal runs of each image row covered by at least `need` of its runs: one sweep over their ends."""
    ends = F.explode(F.array(F.struct(F.col("c0").alias("at"), F.lit(1).alias("d")), F.struct(F.col("c1").alias("at"), F.lit(-1).alias("d"))))
    w = Window.partitionBy(*keys, "row").orderBy("at")
    # Ends at one place are peers of the running sum, so each of them sees the depth behind all of them.
    deep = runs.select(*keys, "row", "height", "width", ends.alias("e")).select(*keys, "row", "height", "width", "e.*").withColumn("_in", F.sum("d").over(w) >= need)
    borders = deep.withColumn("_was", F.coalesce(F.lag("_in").over(w), F.lit(False))).where(F.col("_in") != F.col("_was"))
    return borders.withColumn("c1", F.lead("at").over(w)).where("_in").select(*keys, "row", F.col("at").alias("c0"), "c1", "height", "width")


def _erode(runs: DataFrame, keys: list[str], reach: int) -> DataFrame:
    # Pixels outside the image do not count against a pixel, so an end on the border stays.
    c0, c1 = F.when(F.col("c0") > 0, F.col("c0") + reach).otherwise(F.lit(0)), F.when(F.col("c1") < F.col("width"), F.col("c1") - reach).otherwise(F.col("width"))
    narrow = runs.withColumns({"c0": c0, "c1": c1}).where("c0 < c1")
    lowest, highest = F.greatest(F.col("row") - reach, F.lit(0)), F.least(F.col("row") + reach, F.col("height") - 1)
    return _covered(narrow.withColumn("row", F.explode(F.sequence(lowest, highest))), keys, highest - lowest + 1)


def _dilate(runs: DataFrame, keys: list[str], reach: int) -> DataFrame:
    wide = runs.withColumns({"c0": F.greatest(F.col("c0") - reach, F.lit(0)), "c1": F.least(F.col("c1") + reach, F.col("width"))})
    rows = F.sequence(F.greatest(F.col("row") - reach, F.lit(0)), F.least(F.col("row") + reach, F.col("height") - 1))
    return _covered(wide.withColumn("row", F.explode(rows)), keys, F.lit(1))


def open_close_runs(runs: DataFrame, sizes: DataFrame, keys: Sequence[str], ksize: int = 5) -> DataFrame:
    """Binary opening then closing with a square kernel on the maximal runs (keys, row, c0, c1) of a mask.

    Along a row a kernel moves the ends of runs; across rows each run is laid on the rows it reaches and the depth of
    cover decides. The two dilations between the erosions are one of twice the reach. Nothing is unfolded to pixels
    and the sizes are joined once.
    """
    keys, reach = list(keys), ksize // 2
    found = spread_join(runs.select(*keys, "row", "c0", "c1"), sizes.select(*keys, F.col("height").cast("int"), F.col("width").cast("int")), keys)
    opened = _erode(found, keys, reach)
    return _erode(_dilate(opened, keys, 2 * reach), keys, reach).drop("height", "width")


def open_close(mask: DataFrame, sizes: DataFrame, keys: Sequence[str], ksize: int = 5) -> DataFrame:
    """`open_close_runs` for a pixel table (one row per pixel): foreground pixels of the result with label 1."""
    from .masks import to_runs

    on = mask.where(F.col("label") > 0).select(*keys, F.col("row").cast("int").alias("row"), F.col("col").cast("int").alias("col"), F.lit(1).alias("label"))
    done = open_close_runs(to_runs(on, keys), sizes, keys, ksize)
    return done.select(*keys, "row", F.explode(F.sequence(F.col("c0"), F.col("c1") - 1)).alias("col"), F.lit(1).alias("label"))


def percentile_normalise(pixels: DataFrame, keys: Sequence[str], value: str, low: float = 0.01, high: float = 0.998) -> DataFrame:
    """Linear rescale by two percentiles of the image channel; an 8-bit channel has at most 256 distinct values."""
    cuts = pixels.groupBy(*keys).agg(F.percentile(value, F.array(F.lit(low), F.lit(high))).alias("_q"))
    lo, hi = F.get("_q", F.lit(0)), F.get("_q", F.lit(1))
    return spread_join(pixels, cuts, keys).withColumn("normalised", (F.col(value) - lo) / (hi - lo + 1e-20)).drop("_q")


def gradient_magnitude(pixels: DataFrame, keys: Sequence[str], value: str) -> DataFrame:
    """Central differences over a dense pixel table; zero along the border of each axis."""
    across = Window.partitionBy(*keys, "row").orderBy("col")
    down = Window.partitionBy(*keys, "col").orderBy("row")

    def diff(w):
        return F.coalesce(F.lead(value).over(w) - F.lag(value).over(w), F.lit(0.0))

    return pixels.withColumn("gx", diff(across)).withColumn("gy", diff(down)).withColumn("gradient", F.hypot("gx", "gy"))


def boundaries(mask: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Instance pixels with a different label straight beside them inside the image (dense mask)."""
    across = Window.partitionBy(*keys, "row").orderBy("col")
    down = Window.partitionBy(*keys, "col").orderBy("row")
    lab = F.col("label")

    def differs(w):
        return F.coalesce(F.lag(lab).over(w) != lab, F.lit(False)) | F.coalesce(F.lead(lab).over(w) != lab, F.lit(False))

    return (
        mask.withColumn("_a", differs(across)).withColumn("_d", differs(down))
        .where((lab > 0) & (F.col("_a") | F.col("_d"))).drop("_a", "_d")
    )


def occupancy(tiles: DataFrame, tissue: DataFrame, slides: DataFrame, slide: str, tile: str, threshold: float, cell: int = 64) -> DataFrame:
    """Tissue share of each tile on the thumbnail, kept when strictly above the threshold.

    `slides` has thumb height, width and downsample. Tiles and tissue pixels meet through integer cells of
    the thumbnail, so a join key holds at most cell*cell pixels.
    """
    s = slides.select(slide, F.col("height").alias("_h"), F.col("width").alias("_w"), "downsample")
    d = F.col("downsample")
    boxed = tiles.join(s, slide).withColumns(
        {
            "mx0": F.greatest(F.floor(F.col("tile_x") / d), F.lit(0)),
            "my0": F.greatest(F.floor(F.col("tile_y") / d), F.lit(0)),
            "mx1": F.least(F.floor((F.col("tile_x") + F.col("tile_size_level0")) / d), F.col("_w")),
            "my1": F.least(F.floor((F.col("tile_y") + F.col("tile_size_level0")) / d), F.col("_h")),
        }
    )
    usable = boxed.where((F.col("mx1") > F.col("mx0")) & (F.col("my1") > F.col("my0")))
    cells = usable.select(
        slide, tile, "mx0", "my0", "mx1", "my1",
        F.explode(F.sequence(F.floor(F.col("my0") / cell), F.floor((F.col("my1") - 1) / cell))).alias("_cr"),
    ).select("*", F.explode(F.sequence(F.floor(F.col("mx0") / cell), F.floor((F.col("mx1") - 1) / cell))).alias("_cc"))
    px = tissue.where(F.col("label") > 0).select(
        slide, "row", "col", F.floor(F.col("row") / cell).alias("_cr"), F.floor(F.col("col") / cell).alias("_cc")
    )
    hits = (
        cells.join(px, [slide, "_cr", "_cc"])
        .where((F.col("row") >= F.col("my0")) & (F.col("row") < F.col("my1")) & (F.col("col") >= F.col("mx0")) & (F.col("col") < F.col("mx1")))
        .groupBy(slide, tile).agg(F.count(F.lit(1)).alias("_n"))
    )
    area = (F.col("mx1") - F.col("mx0")) * (F.col("my1") - F.col("my0"))
    return (
        boxed.join(hits, [slide, tile], "left")
        .withColumn("occupancy", F.when((F.col("mx1") > F.col("mx0")) & (F.col("my1") > F.col("my0")), F.coalesce("_n", F.lit(0)) / area).otherwise(0.0))
        .where(F.col("occupancy") > threshold)
        .drop("_h", "_w", "downsample", "_n", "mx0", "mx1", "my0", "my1")
    )


def otsu_thresholds(pixels: DataFrame, slide: str, value: str, bins: int = 256, whole_bins: bool = True) -> DataFrame:
    """Otsu threshold per slide over an equal-width histogram; a constant slide gets its median (that constant).

    Of equally good splits the first is taken. `whole_bins` adds up bin numbers, so such splits tie exactly; without it
    the bins' centres are added up in their order, as in SQL over centres, and rounding may tell such splits apart.
    """
    ends = pixels.groupBy(slide).agg(F.min(value).cast("double").alias("_lo"), F.max(value).cast("double").alias("_hi"))
    width = (F.col("_hi") - F.col("_lo")) / bins
    binned = spread_join(pixels, ends, [slide]).where(F.col("_hi") > F.col("_lo")).withColumn(
        "bin", F.least(F.floor((F.col(value) - F.col("_lo")) / width), F.lit(bins - 1))
    )
    hist = binned.groupBy(slide, "bin", "_lo", "_hi").agg(F.count(F.lit(1)).alias("n")).withColumn("centre", F.col("_lo") + (F.col("bin") + 0.5) * width)
    # At most `bins` rows per slide from here on.
    in_order = Window.partitionBy(slide).orderBy("bin")
    w = in_order.rowsBetween(Window.unboundedPreceding, 0)
    # Ordered too: a sum of doubles depends on the order of its terms.
    whole = in_order.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    m = F.col("n") * F.col("bin" if whole_bins else "centre")
    split = hist.select(
        slide, "bin", "centre", width.alias("_width"),
        F.sum("n").over(w).alias("w1"), F.sum(m).over(w).alias("m1"), F.sum("n").over(whole).alias("wt"), F.sum(m).over(whole).alias("mt"),
    ).withColumn("w2", F.col("wt") - F.col("w1")).where(F.col("w2") > 0)
    if whole_bins:
        # Centres lie evenly, so classes are as far apart as their mean bins times the width.
        w1, w2 = F.col("w1").cast("double"), F.col("w2").cast("double")
        apart = F.col("m1") * w2 - (F.col("mt") - F.col("m1")) * w1
        between = apart * apart / (w1 * w2) * F.col("_width") * F.col("_width")
    else:
        gap = F.col("m1") / F.col("w1") - (F.col("mt") - F.col("m1")) / F.col("w2")
        between = F.col("w1") * F.col("w2") * gap * gap
    scored = split.withColumn("between", F.round(between, 9))
    best = scored.groupBy(slide).agg(F.min_by("centre", F.struct(-F.col("between"), F.col("bin"))).alias("_t"))
    return ends.join(best, slide, "left").select(slide, F.coalesce("_t", "_lo").alias("threshold"))


def apply_threshold(pixels: DataFrame, thresholds: DataFrame, slide: str, value: str) -> DataFrame:
    """Foreground is darker than the threshold."""
    return spread_join(pixels, thresholds, [slide]).withColumn("label", (F.col(value) < F.col("threshold")).cast("int")).drop("threshold")


def luminance(channels: Sequence[str] = ("r", "g", "b")) -> Column:
    return sum((F.col(c).cast("double") for c in channels), F.lit(0.0)) / len(channels)
