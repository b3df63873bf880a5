"""Boxes against tiles, grid maps, and offset calibration."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Row, functions as F

from ..session import materialise
from . import ranks as R
from .dedupe import first_per_key
from .spread import spread_join


def positive_step(df: DataFrame, value: str) -> DataFrame:
    """One row `step`: exact median of the positive gaps between sorted distinct values.

    The value axis is cut into ranges with `value_ranks`; a gap is the distance to the next distinct value,
    and the next value across a range border is the smallest of a later range, so no window spans the table.
    """
    ranks = R.value_ranks(df.select(F.col(value).cast("double").alias("v")).distinct(), [], "v")
    nxt = ranks.select((F.col("before") - 1).alias("before"), F.col("v").alias("nv"))
    gaps = ranks.join(nxt, "before").select((F.col("nv") - F.col("v")).alias("gap")).where(F.col("gap") > 0)
    return R.exact_quantiles(gaps, [], "gap", {"step": 0.5}).select("step")


def grid_steps(tiles: DataFrame) -> DataFrame:
    """One row `x`, `y`: the positive step of each axis of a tile grid, both from one pass; null where an axis has fewer than two positions."""
    axes = F.array(*[F.struct(F.lit(a).alias("axis"), F.col(f"tile_{a}").cast("double").alias("v")) for a in ("x", "y")])
    # Ranks read their input in several branches, so what goes in and out of them is written once.
    ranks = materialise(R.value_ranks(tiles.select(F.explode(axes).alias("k")).select("k.*").distinct(), ["axis"], "v").select("axis", "v", "before"))
    nxt = ranks.select("axis", (F.col("before") - 1).alias("before"), F.col("v").alias("nv"))
    gaps = ranks.join(nxt, ["axis", "before"]).select("axis", (F.col("nv") - F.col("v")).alias("gap")).where(F.col("gap") > 0)
    steps = R.exact_quantiles(materialise(gaps), ["axis"], "gap", {"step": 0.5})
    return steps.agg(*[F.max(F.when(F.col("axis") == a, F.col("step"))).alias(a) for a in ("x", "y")])


def place_tiles(
    tiles: DataFrame,
    coord_mode: str = "xy",
    scale: tuple[float, float] = (1.0, 1.0),
    offset: tuple[float, float] = (0.0, 0.0),
) -> DataFrame:
    """Tile origins in slide coordinates: optional swap, then scale, then offset."""
    if coord_mode not in ("xy", "swap_xy"):
        raise ValueError(coord_mode)
    x, y = ("tile_x", "tile_y") if coord_mode == "xy" else ("tile_y", "tile_x")
    return tiles.withColumns({"tile_x": F.col(x).cast("double") * scale[0] + offset[0], "tile_y": F.col(y).cast("double") * scale[1] + offset[1]})


def tile_boxes(tiles: DataFrame, mode: str = "auto", override: float | None = None, width: str = "w_img", height: str = "h_img") -> DataFrame:
    """x0, y0, x1, y1 per tile. Span: image size, grid step, the larger of both (auto), or a fixed value."""
    w, h = F.col(width).cast("double"), F.col(height).cast("double")
    if override is not None:
        w = h = F.lit(float(override))
    elif mode in ("step", "auto"):
        # Two numbers, read once: as subqueries they would be copied into every use of a tile's far corner.
        sx, sy = (F.lit(step).cast("double") for step in grid_steps(tiles).first())
        w, h = (F.coalesce(sx, w), F.coalesce(sy, h)) if mode == "step" else (F.greatest(w, sx), F.greatest(h, sy))
    elif mode == "override":
        raise ValueError("mode 'override' needs an override span")
    elif mode != "image":
        raise ValueError(mode)
    return tiles.withColumns({"x0": F.col("tile_x"), "y0": F.col("tile_y"), "x1": F.col("tile_x") + w, "y1": F.col("tile_y") + h})


#: Boxes that one cell may hold before its rows are dealt to several keys, and the share of all rows from which
#: a cell is looked at for it: fewer than CROWD_SHARE cells can hold more, so their list may be broadcast.
PER_KEY, CROWD_SHARE = 100_000, 10_000
#: Rows of tiles in cells up to which they go to every task, so that boxes are not shuffled at all.
BROADCAST_ROWS = 100_000


def box_join(tiles: DataFrame, boxes: DataFrame, on: Sequence[str], cell: float, salts: int | None = None) -> DataFrame:
    """Pairs of tile (x0, y0, x1, y1) and box (xmin, ymin, xmax, ymax) that overlap, all four sides strict.

    Grids of doubling cells, `cell` the finest. A rectangle lies on the level whose cells are as large as it is, where
    it touches four cells at most, and on the coarser levels that the other side uses; a pair meets on the coarser of
    its two levels only, and is reported from the cell that holds the lower corner of its intersection, so nothing has
    to be made distinct afterwards. Rectangles outside the other side's bounds are left out before they are laid on
    cells. Up to BROADCAST_ROWS rows of tiles in cells are broadcast, counted and not estimated; with more both sides
    are shuffled. Then rows of crowded cells are dealt to as many keys as their count asks for and the tiles of the
    cell are repeated; `salts` asks for the shuffle with a fixed number instead. Rectangles with a missing or
    non-finite coordinate meet nothing.
    """
    keys = [*on, "_level", "_cx", "_cy"]
    inf = F.lit(float("inf"))

    def placed(df: DataFrame, a: Sequence[str], own: str) -> DataFrame:
        x0, y0, x1, y1 = (F.col(c).cast("double") for c in a)
        finite = F.lit(True)
        for c in (x0, y0, x1, y1):
            finite = finite & (F.abs(c) < inf)
        size = F.greatest(F.abs(x1 - x0), F.abs(y1 - y0))
        return df.where(finite).withColumn(own, F.greatest(F.ceil(F.log2(size / cell)), F.lit(0)).cast("int"))

    def cells(df: DataFrame, a: Sequence[str], own: str, used: Sequence[int]) -> DataFrame:
        levels = F.array_union(F.array(own), F.array(*map(F.lit, used)).cast("array<int>"))
        width = cell * F.pow(F.lit(2.0), F.col("_level"))

        def span(p: str, q: str) -> Column:
            return F.sequence(F.floor(F.least(p, q) / width), F.floor(F.greatest(p, q) / width))

        laid = df.withColumn("_level", levels).withColumn("_level", F.explode("_level")).where(F.col("_level") >= F.col(own))
        return laid.withColumn("_cx", F.explode(span(a[0], a[2]))).withColumn("_cy", F.explode(span(a[1], a[3])))

    def bounds(df: DataFrame, a: Sequence[str], own: str) -> Row:
        """Levels and outermost sides: a few dozen numbers at most, since each level doubles the size."""
        low, high = [F.min(F.col(c).cast("double")).alias(c) for c in a[:2]], [F.max(F.col(c).cast("double")).alias(c) for c in a[2:]]
        return df.agg(F.array_sort(F.collect_set(own)).alias("levels"), *low, *high).first()

    def within(df: DataFrame, a: Sequence[str], other: Row, o: Sequence[str]) -> DataFrame:
        out = df
        for lo, hi, other_lo, other_hi in zip(a[:2], a[2:], o[:2], o[2:], strict=True):
            out = out.where((F.col(lo) < F.lit(other[other_hi]).cast("double")) & (F.col(hi) > F.lit(other[other_lo]).cast("double")))
        return out

    t_at, b_at = ("x0", "y0", "x1", "y1"), ("xmin", "ymin", "xmax", "ymax")
    t, b = placed(tiles, t_at, "_ot"), placed(boxes, b_at, "_ob")
    b_bounds = bounds(b, b_at, "_ob")
    t = within(t, t_at, b_bounds, b_at)
    t_bounds = bounds(t, t_at, "_ot")
    b = within(b, b_at, t_bounds, t_at)
    t, b = cells(t, t_at, "_ot", b_bounds["levels"]), cells(b, b_at, "_ob", t_bounds["levels"])
    if salts is None and t.limit(BROADCAST_ROWS + 1).count() <= BROADCAST_ROWS:
        joined = b.join(F.broadcast(t), keys)
    else:
        if salts is None:
            held = b.groupBy(*keys).agg(F.count(F.lit(1)).alias("_n"))
            crowded = held.where((F.col("_n") > PER_KEY) & (F.col("_n") * CROWD_SHARE > held.agg(F.sum("_n")).scalar()))
            crowded = F.broadcast(crowded.select(*keys, F.ceil(F.col("_n") / PER_KEY).cast("int").alias("_keys")))
            t, b = (df.join(crowded, keys, "left").withColumn("_keys", F.coalesce("_keys", F.lit(1))) for df in (t, b))
        else:
            t, b = (df.withColumn("_keys", F.lit(salts)) for df in (t, b))
        t = t.withColumn("_salt", F.explode(F.sequence(F.lit(0), F.col("_keys") - 1))).drop("_keys")
        b = b.withColumn("_salt", F.pmod(F.xxhash64(*boxes.columns), F.col("_keys")).cast("int")).drop("_keys")
        # Spark would judge tiles by their size before they are laid on cells, and broadcast a table of any size.
        joined = t.hint("merge").join(b, [*keys, "_salt"]).drop("_salt")
    joined = joined.where(F.col("_level") == F.greatest("_ot", "_ob"))
    overlap = (F.col("xmax") > F.col("x0")) & (F.col("xmin") < F.col("x1")) & (F.col("ymax") > F.col("y0")) & (F.col("ymin") < F.col("y1"))
    width = cell * F.pow(F.lit(2.0), F.col("_level"))
    home = (F.floor(F.greatest("x0", "xmin") / width) == F.col("_cx")) & (F.floor(F.greatest("y0", "ymin") / width) == F.col("_cy"))
    return joined.where(overlap & home).select(*on, *[c for c in (*tiles.columns, *boxes.columns) if c not in on])


def mapping_coverage(pairs: DataFrame, boxes: DataFrame, tiles: DataFrame, mode: str, tile: str, box: str) -> DataFrame:
    """Per mode: tiles with boxes, distinct boxes mapped, share of all boxes; best mode first.

    A box is shuffled once for all modes that it meets, which are bits of a number, and so is a tile.
    """
    modes = tiles.select(mode).distinct()
    # A list of names, not data.
    names = modes.agg(F.array_sort(F.collect_set(mode))).scalar()
    place = F.array_position(names, F.col(mode)) - 1
    bits = pairs.select(F.col(tile).alias("_tile"), F.col(box).alias("_box"), F.floor(place / 63).alias("_word"), F.call_function("shiftleft", F.lit(1).cast("bigint"), (place % 63).cast("int")).alias("_bits"))
    sides = F.array(*[F.struct(*[(F.col(c) if c == side else F.lit(None)).alias(c) for c in ("_tile", "_box")]) for side in ("_tile", "_box")])
    once = bits.select("_word", "_bits", F.explode(sides).alias("_s")).select("_word", "_bits", "_s.*").where("_tile is not null or _box is not null")
    once = once.groupBy("_tile", "_box", "_word").agg(F.bit_or("_bits").alias("_bits"))
    met = once.groupBy("_word", "_bits").agg(F.count("_tile").alias("_tiles"), F.count("_box").alias("_boxes"))
    held = F.filter(F.sequence(F.lit(0), F.lit(62)), lambda i: F.call_function("getbit", F.col("_bits"), i) == 1)
    per_mode = (
        met.withColumn("_i", F.explode(held)).select(F.get(names, (F.col("_word") * 63 + F.col("_i")).cast("int")).alias(mode), "_tiles", "_boxes")
        .groupBy(mode).agg(F.sum("_tiles").alias("tiles_with_cells"), F.sum("_boxes").alias("cells_mapped"))
    )
    n_boxes = boxes.agg(F.count(F.lit(1))).scalar()
    filled = modes.join(per_mode, mode, "left").na.fill(0, ["tiles_with_cells", "cells_mapped"])
    return filled.withColumn("coverage", F.col("cells_mapped") / F.greatest(n_boxes, F.lit(1))).orderBy(
        F.desc("cells_mapped"), F.desc("tiles_with_cells"), F.asc(mode)
    )


def global_box(boxes: DataFrame) -> DataFrame:
    return boxes.agg(
        F.min("xmin").alias("xmin"), F.min("ymin").alias("ymin"), F.max("xmax").alias("xmax"), F.max("ymax").alias("ymax"), F.count(F.lit(1)).alias("n_boxes")
    )


def alignment(boxes: DataFrame, tiles: DataFrame, w_img: float, h_img: float) -> DataFrame:
    """Scale and offset taking tile coordinates to box coordinates, for both axis orders and both spans."""
    b = global_box(boxes)
    steps = grid_steps(tiles).first()
    parts = []
    for mode in ("xy", "swap_xy"):
        t = place_tiles(tiles, mode)
        step_x, step_y = (F.lit(v).cast("double") for v in (steps if mode == "xy" else reversed(steps)))
        ends = t.agg(
            F.min("tile_x").alias("tx0"), F.min("tile_y").alias("ty0"), F.max("tile_x").alias("tx1"), F.max("tile_y").alias("ty1")
        )
        row = ends.select(
            F.lit(mode).alias("coord_mode"),
            *ends.columns,
            F.coalesce(step_x, F.lit(w_img)).alias("step_x"),
            F.coalesce(step_y, F.lit(h_img)).alias("step_y"),
            *[b.select(c).scalar().alias(f"b_{c}") for c in ("xmin", "ymin", "xmax", "ymax")],
        )
        parts.append(row)
    both = parts[0].unionByName(parts[1])
    tiny = F.lit(1e-6)

    def fit(sx: Column, sy: Column, name: str) -> list[Column]:
        ax = F.greatest(F.col("b_xmax") - F.col("b_xmin"), tiny) / F.greatest(F.col("tx1") + sx - F.col("tx0"), tiny)
        ay = F.greatest(F.col("b_ymax") - F.col("b_ymin"), tiny) / F.greatest(F.col("ty1") + sy - F.col("ty0"), tiny)
        return [
            ax.alias(f"{name}_scale_x"), ay.alias(f"{name}_scale_y"),
            (F.col("b_xmin") - F.col("tx0") * ax).alias(f"{name}_offset_x"), (F.col("b_ymin") - F.col("ty0") * ay).alias(f"{name}_offset_y"),
        ]

    return both.select(
        "coord_mode", "step_x", "step_y", *fit(F.lit(w_img), F.lit(h_img), "image"), *fit(F.col("step_x"), F.col("step_y"), "step")
    )


def cell_groups(cells: DataFrame, order: str) -> DataFrame:
    """Cells per patch coordinate [row, col] with the first global offset, flipped to (x, y)."""
    ok = cells.where(F.size("patch_coordinates") == 2)
    has = F.size("offset_global") == 2
    first = F.min_by(F.struct(F.get("offset_global", F.lit(1)).alias("x"), F.get("offset_global", F.lit(0)).alias("y")), F.when(has, F.col(order)))
    return (
        ok.groupBy(F.get("patch_coordinates", F.lit(0)).alias("row"), F.get("patch_coordinates", F.lit(1)).alias("col"))
        .agg(F.count(F.lit(1)).alias("n_cells"), first.alias("_o"))
        .select("row", "col", "n_cells", F.col("_o.x").alias("offset_x"), F.col("_o.y").alias("offset_y"))
    )


def grid_map_candidates(files: DataFrame, index: str, dims: Sequence[tuple[str, int, int]], parsed: str | None = None) -> DataFrame:
    """(file, mode, row, col) for every way of reading the file order, or the parsed name, as a grid key."""
    modes, used = [], set()
    for label, rows, cols in dims:
        if rows <= 0 or cols <= 0 or (rows, cols) in used:
            continue
        used.add((rows, cols))
        r, c = F.floor(F.col(index) / cols), F.col(index) % cols
        inside = r < rows
        for order, a, b in (("rowcol", r, c), ("colrow", c, r)):
            modes.append(F.when(inside, F.struct(F.lit(f"grid_{label}_{order}").alias("mode"), a.cast("bigint").alias("row"), b.cast("bigint").alias("col"))))
    if parsed:
        a, b = F.col(f"{parsed}.a"), F.col(f"{parsed}.b")
        for name, x, y in (("filename_row_col", a, b), ("filename_col_row", b, a)):
            modes.append(F.when(a.isNotNull(), F.struct(F.lit(name).alias("mode"), x.cast("bigint").alias("row"), y.cast("bigint").alias("col"))))
    return files.select("*", F.explode(F.array_compact(F.array(*modes))).alias("_m")).select(*files.columns, "_m.*")


def score_grid_maps(candidates: DataFrame, groups: DataFrame) -> DataFrame:
    """Per mode: files mapped, patches and cells matched, coverage; best first."""
    keys = candidates.groupBy("mode", "row", "col").agg(F.count(F.lit(1)).alias("n_files"))
    g = groups.select(F.col("row").cast("bigint").alias("row"), F.col("col").cast("bigint").alias("col"), "n_cells")
    totals = g.agg(F.sum("n_cells").alias("c"), F.count(F.lit(1)).alias("p"))
    total_cells, total_patches = totals.select("c").scalar(), totals.select("p").scalar()
    scored = keys.join(g, ["row", "col"], "left").groupBy("mode").agg(
        F.count(F.lit(1)).alias("n_images_mapped"),
        F.count("n_cells").alias("n_cell_patches_matched"),
        F.coalesce(F.sum("n_cells"), F.lit(0)).alias("n_cells_matched"),
    )
    return scored.withColumns(
        {"cell_patch_coverage": F.col("n_cell_patches_matched") / total_patches, "cell_coverage": F.col("n_cells_matched") / F.greatest(total_cells, F.lit(1))}
    ).orderBy(F.desc("n_cells_matched"), F.desc("n_cell_patches_matched"), F.desc("n_images_mapped"), F.asc("mode"))


def candidates(spans: Sequence[float], shift_min: int, shift_max: int, shift_step: int) -> Column:
    """Array of (candidate, span, shift_x, shift_y) in scoring order; explode it on a patch table."""
    shifts = list(range(shift_min, shift_max + 1, shift_step))
    n = len(shifts)
    at = lambda i: F.lit(float(shift_min)) + i * float(shift_step)
    spans_arr = F.array(*[F.lit(float(s)) for s in spans])
    return F.transform(
        F.sequence(F.lit(0), F.lit(len(spans) * n * n - 1)),
        lambda i: F.struct(
            i.alias("candidate"),
            F.get(spans_arr, F.floor(i / (n * n)).cast("int")).alias("span"),
            at(F.floor(i / n).cast("int") % n).alias("shift_x"),
            at(i % n).alias("shift_y"),
        ),
    )


def edge_scores(patches: DataFrame, points: DataFrame, gradient: DataFrame, patch: str, cand: Column, stride: int = 1, side: int = 16) -> DataFrame:
    """Edge score and kept contours per (patch, candidate).

    `patches(patch, x0, y0, width, height)`; `points(patch, [span,] contour, ordinal, n_points, x, y)` are the
    contour points of the cells that meet the patch (at that span); `gradient(patch, row, col, gradient)` has one row
    per pixel; `cand` is an array of constants (see `candidates`). Points are moved per candidate, every `stride`-th
    point is looked up, contours with no point near the image are not kept. A candidate without any looked-up point
    scores minus infinity.

    Gradients travel as arrays of `side` x `side` pixels. A point meets the blocks that its candidates of a span can
    reach, and candidates are unfolded behind that join, so what is shuffled depends on the reach of the shifts and
    not on the number of candidates.
    """
    # One line per span of the caller's own constants.
    moves = patches.sparkSession.range(1).select(F.explode(cand).alias("k")).select("k.*").groupBy("span").agg(
        F.min("shift_x").alias("sx0"), F.max("shift_x").alias("sx1"), F.min("shift_y").alias("sy0"), F.max("shift_y").alias("sy1")
    )
    reach = F.array(*[F.struct(*[F.lit(v).alias(n) for n, v in r.asDict().items()]) for r in moves.orderBy("span").collect()])
    dims = patches.select(patch, "x0", "y0", "width", "height")
    ready = points.where(F.col("n_points") >= 2)
    own = "span" in points.columns
    if own:
        ready = ready.withColumnRenamed("span", "_span")
    laid = spread_join(ready, dims, [patch]).withColumn("r", F.explode(reach)).select("*", "r.*")
    if own:
        laid = laid.where(F.col("_span") == F.col("span"))
    fx = (F.col("x") - F.col("x0")) * (F.col("width") / F.col("span"))
    fy = (F.col("y") - F.col("y0")) * (F.col("height") / F.col("span"))
    laid = laid.select(patch, "contour", "ordinal", "span", "width", "height", "sx0", "sx1", "sy0", "sy1", fx.alias("fx"), fy.alias("fy")).where(
        (F.col("fx") + F.col("sx1") >= -1) & (F.col("fx") + F.col("sx0") <= F.col("width"))
        & (F.col("fy") + F.col("sy1") >= -1) & (F.col("fy") + F.col("sy0") <= F.col("height"))
    )
    px, py = F.col("fx") + F.col("k.shift_x"), F.col("fy") + F.col("k.shift_y")
    near = (px >= -1) & (px <= F.col("width")) & (py >= -1) & (py <= F.col("height"))

    def blocks(f: str, lo: str, hi: str, size: str) -> Column:
        first, last = F.greatest(F.rint(F.col(f) + F.col(lo)), F.lit(-1.0)), F.least(F.rint(F.col(f) + F.col(hi)), F.col(size).cast("double"))
        return F.explode(F.sequence(F.floor(first / side), F.floor(last / side)))

    packed = (
        gradient.where(F.col("row").isNotNull() & F.col("col").isNotNull())
        .groupBy(patch, F.floor(F.col("row") / side).alias("_br"), F.floor(F.col("col") / side).alias("_bc"))
        .agg(F.sort_array(F.collect_list(F.struct((F.pmod("row", F.lit(side)) * side + F.pmod("col", F.lit(side))).cast("int").alias("at"), "gradient"))).alias("_g"))
        .select(patch, "_br", "_bc", F.col("_g.at").alias("_at"), F.col("_g.gradient").alias("_value"))
    )
    meets = laid.where(F.col("ordinal") % stride == 0).select(patch, "span", "width", "height", "fx", "fy", "sy0", "sy1", blocks("fx", "sx0", "sx1", "width").alias("_bc"))
    meets = meets.select(patch, "span", "width", "height", "fx", "fy", "_bc", blocks("fy", "sy0", "sy1", "height").alias("_br"))
    row, col = F.rint(py).cast("int"), F.rint(px).cast("int")
    index = (F.pmod(row, F.lit(side)) * side + F.pmod(col, F.lit(side))).cast("int")
    # A full block holds pixel i at place i; in the others the place is searched.
    value = F.when(F.get("_at", index) == index, F.get("_value", index)).otherwise(F.get("_value", F.array_position("_at", index).cast("int") - 1))
    sums = (
        meets.join(packed, [patch, "_br", "_bc"])
        .withColumn("k", F.explode(cand))
        .where((F.col("k.span") == F.col("span")) & near & (F.floor(row / side) == F.col("_br")) & (F.floor(col / side) == F.col("_bc")))
        .select(patch, F.col("k.candidate").alias("candidate"), value.alias("_v"))
        .groupBy(patch, "candidate").agg(F.sum("_v").alias("_s"), F.count("_v").alias("_n"))
    )
    # A point that no shift of its span takes out of the image keeps its contour for all of them: one row, no candidate.
    always = (
        (F.col("fx") + F.col("sx0") >= -1) & (F.col("fx") + F.col("sx1") <= F.col("width"))
        & (F.col("fy") + F.col("sy0") >= -1) & (F.col("fy") + F.col("sy1") <= F.col("height"))
    )
    marks = (
        laid.where(F.col("contour").isNotNull()).withColumn("_always", always)
        .withColumn("k", F.explode(F.when(F.col("_always"), F.slice(cand, 1, 1)).otherwise(cand)))
        .where(F.col("_always") | ((F.col("k.span") == F.col("span")) & near))
        .groupBy(patch, "span", "contour")
        .agg(F.bool_or("_always").alias("_all"), F.collect_set(F.when(~F.col("_always"), F.col("k.candidate"))).alias("_some"))
        .withColumn("candidate", F.explode(F.when(F.col("_all"), F.array(F.lit(None).cast("int"))).otherwise(F.col("_some"))))
        .groupBy(patch, "span", "candidate").agg(F.count(F.lit(1)).alias("kept"))
    )
    of_span = F.transform(F.filter(cand, lambda k: k["span"] == F.col("span")), lambda k: k["candidate"])
    kept = marks.select(patch, "kept", F.explode(F.when(F.col("candidate").isNull(), of_span).otherwise(F.array("candidate"))).alias("candidate"))
    every = ready.select(patch).distinct().withColumn("k", F.explode(cand)).select(patch, "k.*")
    lines = every.unionByName(sums, allowMissingColumns=True).unionByName(kept, allowMissingColumns=True)
    total = lines.groupBy(patch, "candidate").agg(
        *[F.max(c).alias(c) for c in ("span", "shift_x", "shift_y")], F.sum("_s").alias("_s"), F.sum("_n").alias("_n"), F.sum("kept").alias("kept")
    )
    score = F.when(F.col("_n") > 0, F.col("_s") / F.col("_n")).otherwise(F.lit(float("-inf")))
    return total.select(patch, "candidate", "span", "shift_x", "shift_y", score.alias("score"), F.coalesce("kept", F.lit(0)).alias("kept"))


def best_candidates(scores: DataFrame, patch: str) -> DataFrame:
    """Best candidate per patch (first maximum), best and second score, margin (null with one finite score)."""
    finite = scores.where(F.col("score") > float("-inf"))
    top = first_per_key(finite, [patch], [F.desc("score"), F.asc("candidate")], n=2)
    return top.groupBy(patch).agg(
        F.min_by("candidate", F.struct(-F.col("score"), F.col("candidate"))).alias("best_candidate"),
        F.max("score").alias("best_score"),
        F.when(F.count(F.lit(1)) > 1, F.min("score")).alias("second_score"),
        F.when(F.count(F.lit(1)) > 1, F.max("score") - F.min("score")).alias("margin"),
    )


def calibration_summary(scores: DataFrame, patch: str) -> DataFrame:
    """Wins, win rate, mean and median score, mean kept per candidate; best first, with the offsets to apply.

    Patches without any finite score are left out; a minus infinity pulls a candidate's mean down to itself.
    """
    # Read by four branches: written once to the shared folder rather than scored again.
    scores = materialise(scores)
    winners = best_candidates(scores, patch).select(patch, F.col("best_candidate"))
    usable = scores.join(winners, patch)
    n_patches = winners.agg(F.count(F.lit(1))).scalar()
    stats = usable.groupBy("candidate", "span", "shift_x", "shift_y").agg(
        F.count_if(F.col("candidate") == F.col("best_candidate")).alias("wins"),
        F.avg("score").alias("mean_score"),
        F.avg("kept").alias("mean_kept"),
    )
    med = R.exact_quantiles(
        usable.withColumn("_f", F.when(F.col("score") > float("-inf"), F.col("score")).otherwise(F.lit(-1e300))), ["candidate"], "_f", {"median_score": 0.5}
    ).drop("n")
    med = med.withColumn("median_score", F.when(F.col("median_score") < -1e200, float("-inf")).otherwise(F.col("median_score")))
    return (
        stats.join(med, "candidate")
        .withColumns({"win_rate": F.col("wins") / n_patches, "offset_x": -F.col("shift_x"), "offset_y": -F.col("shift_y")})
        .orderBy(F.desc("wins"), F.desc("mean_score"), F.desc("median_score"), F.desc("mean_kept"), F.asc("candidate"))
    )


def contour_modes(points: DataFrame, patches: DataFrame, patch: Sequence[str], scale_to_patch: float, metadata_patch_size: int | None = None) -> DataFrame:
    """Vote per patch between local, shift and scaled_shift by all points that land inside the image.

    `points(patch.., x, y)`; `patches(patch.., offset_x, offset_y, height, width)`.
    Later modes win equal votes; a patch without points is local.
    """
    per = F.lit(1.0) / metadata_patch_size if metadata_patch_size else None
    sx = F.col("width") * per if per is not None else F.lit(1.0)
    sy = F.col("height") * per if per is not None else F.lit(1.0)
    ox, oy = F.coalesce("offset_x", F.lit(0.0)), F.coalesce("offset_y", F.lit(0.0))
    x, y = F.col("x"), F.col("y")

    def inside(px: Column, py: Column) -> Column:
        a, b = px * sx, py * sy
        return F.count_if((a >= 0) & (a < F.col("width")) & (b >= 0) & (b < F.col("height")))

    votes = spread_join(points, patches, patch).groupBy(*patch).agg(
        inside(x, y).alias("local"),
        inside(x - ox, y - oy).alias("shift"),
        inside(x * scale_to_patch - ox, y * scale_to_patch - oy).alias("scaled_shift"),
    )
    top = F.greatest("local", "shift", "scaled_shift")
    mode = F.when(F.col("scaled_shift") == top, "scaled_shift").when(F.col("shift") == top, "shift").otherwise("local")
    return patches.select(*patch).join(votes.withColumn("mode", mode), list(patch), "left").select(
        *patch, *[F.coalesce(c, F.lit(0)).alias(c) for c in ("local", "shift", "scaled_shift")], F.coalesce("mode", F.lit("local")).alias("mode")
    )
