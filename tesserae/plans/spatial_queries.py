"""Box joins, grid maps and calibration queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import keys as K, scalars as X
from ..operators import images as G, spatial as P
from . import views as V
from .registry import query, rounded, rounded_sql

_STEP = """, sx as (select median(d) as s from (select tile_x - lag(tile_x) over (order by tile_x) as d from (select distinct tile_x from v_tile)) where d > 0),
 sy as (select median(d) as s from (select tile_y - lag(tile_y) over (order by tile_y) as d from (select distinct tile_y from v_tile)) where d > 0)"""
_J13 = "with " + V.V_BOX + ", " + V.V_TILE + _STEP + """, t as (select tile_id, tile_x as x0, tile_y as y0, tile_x + greatest(w_img, (select s from sx)) as x1, tile_y + greatest(h_img, (select s from sy)) as y1 from v_tile),
 hit as (select tile_id, cell_id from t, v_box where xmax > x0 and xmin < x1 and ymax > y0 and ymin < y1)"""


def _pairs(spark, sf, mode="auto", coord="xy"):
    tiles = P.tile_boxes(P.place_tiles(V.plane_tiles(spark, sf), coord), mode)
    return P.box_join(tiles, V.boxes(spark, sf), [], 4000.0)


@query("j13_box_join", _J13 + " select * from hit")
def box_join(spark, sf):
    return _pairs(spark, sf).select("tile_id", "cell_id")


@query("j13_cells_per_tile", _J13 + " select tile_id, count(*) as n_cells from hit group by 1")
def cells_per_tile(spark, sf):
    return _pairs(spark, sf).groupBy("tile_id").agg(F.count(F.lit(1)).alias("n_cells"))


@query("a42_positive_step", "with " + V.V_TILE + _STEP + " select (select s from sx) as step_x, (select s from sy) as step_y")
def positive_step(spark, sf):
    return P.grid_steps(V.plane_tiles(spark, sf)).select(F.col("x").alias("step_x"), F.col("y").alias("step_y"))


_A29 = "with " + V.V_BOX + ", " + V.V_TILE + """, t as (select 'image' as mode, tile_id, tile_x as x0, tile_y as y0, tile_x + w_img as x1, tile_y + h_img as y1 from v_tile union all select 'fixed', tile_id, tile_x, tile_y, tile_x + 1000, tile_y + 1000 from v_tile),
 hit as (select mode, tile_id, cell_id from t, v_box where xmax > x0 and xmin < x1 and ymax > y0 and ymin < y1)"""


@query(
    "a29_mapping_coverage",
    rounded_sql(
        _A29 + "\n--body\nselect mode, count(distinct tile_id) as tiles_with_cells, count(distinct cell_id) as cells_mapped, count(distinct cell_id) / (select count(*) from v_box) as coverage from hit group by 1",
        "coverage",
    ),
)
def mapping_coverage(spark, sf):
    base = V.plane_tiles(spark, sf)
    tiles = P.tile_boxes(base, "image").withColumn("mode", F.lit("image")).unionByName(P.tile_boxes(base, override=1000.0).withColumn("mode", F.lit("fixed")))
    boxes = V.boxes(spark, sf)
    return rounded(P.mapping_coverage(P.box_join(tiles, boxes, [], 4000.0), boxes, tiles, "mode", "tile_id", "cell_id"))


@query("a30_global_box", rounded_sql("with " + V.V_BOX + "\n--body\nselect min(xmin) as xmin, min(ymin) as ymin, max(xmax) as xmax, max(ymax) as ymax, count(*) as n_boxes from v_box", "xmin ymin xmax ymax"))
def global_box(spark, sf):
    return rounded(P.global_box(V.boxes(spark, sf)))


_FIT = "step_x step_y image_scale_x image_scale_y image_offset_x image_offset_y step_scale_x step_scale_y step_offset_x step_offset_y"


def _fit_sql(mode, x, y, sx, sy):
    g = "select (select min(xmin) from v_box) b0, (select min(ymin) from v_box) b1, (select max(xmax) from v_box) b2, (select max(ymax) from v_box) b3"
    t = f"select min({x}) x0, min({y}) y0, max({x}) x1, max({y}) y1 from v_tile"

    def fit(wx, wy, n):
        ax, ay = f"(b2 - b0) / (x1 + {wx} - x0)", f"(b3 - b1) / (y1 + {wy} - y0)"
        return f"{ax} as {n}_scale_x, {ay} as {n}_scale_y, b0 - x0 * {ax} as {n}_offset_x, b1 - y0 * {ay} as {n}_offset_y"

    return f"select '{mode}' as coord_mode, {sx} as step_x, {sy} as step_y, {fit('3000', '3500', 'image')}, {fit(sx, sy, 'step')} from ({g}) g, ({t}) t"


@query(
    "a30_alignment",
    rounded_sql(
        "with " + V.V_BOX + ", " + V.V_TILE + _STEP + "\n--body\n" + _fit_sql("xy", "tile_x", "tile_y", "(select s from sx)", "(select s from sy)") + " union all " + _fit_sql("swap_xy", "tile_y", "tile_x", "(select s from sy)", "(select s from sx)"),
        _FIT,
    ),
)
def alignment(spark, sf):
    return rounded(P.alignment(V.boxes(spark, sf), V.plane_tiles(spark, sf), 3000.0, 3500.0))


def _cells(spark, sf):
    """Orders as nested cells: patch coordinates from the customer, offset from the price."""
    return V.table(spark, sf, "orders").select(
        "o_orderkey",
        F.when(F.col("o_orderkey") % 11 > 0, F.array((F.col("o_custkey") % 20).cast("int"), (F.floor(F.col("o_custkey") / 20) % 15).cast("int"))).alias("patch_coordinates"),
        F.when(F.col("o_orderkey") % 3 > 0, F.array(F.col("o_totalprice"), F.col("o_totalprice") / 2)).alias("offset_global"),
    )


_CELLS = """with c as (select o_orderkey, o_custkey % 20 as row, (o_custkey // 20) % 15 as col, case when o_orderkey % 3 > 0 then o_totalprice end as p from orders where o_orderkey % 11 > 0),
 g as (select cast(row as int) as row, cast(col as int) as col, count(*) as n_cells, arg_min(p, o_orderkey) filter (where p is not null) / 2 as offset_x, arg_min(p, o_orderkey) filter (where p is not null) as offset_y from c group by 1, 2)"""


@query("j25_cell_groups", rounded_sql(_CELLS + "\n--body\nselect * from g", "offset_x offset_y"))
def cell_groups(spark, sf):
    return rounded(P.cell_groups(_cells(spark, sf), "o_orderkey"))


_DIMS = (("meta", 20, 15), ("meta_swapped", 15, 20), ("cells", 20, 15))


def _files(spark, sf):
    named = F.concat((F.col("c_custkey") % 25).cast("string"), F.lit("_"), (F.floor(F.col("c_custkey") / 25) % 10).cast("string"), F.lit(".png"))
    return V.table(spark, sf, "customer").select(F.col("c_custkey").alias("i"), named.alias("file"), K.tile_key(named).alias("key"))


_J14 = _CELLS + """, f as (select c_custkey as i, c_custkey % 25 as a, (c_custkey // 25) % 10 as b from customer),
 m as (select i, 'grid_meta_rowcol' as mode, i // 15 as row, i % 15 as col from f where i // 15 < 20 union all select i, 'grid_meta_colrow', i % 15, i // 15 from f where i // 15 < 20
  union all select i, 'grid_meta_swapped_rowcol', i // 20, i % 20 from f where i // 20 < 15 union all select i, 'grid_meta_swapped_colrow', i % 20, i // 20 from f where i // 20 < 15
  union all select i, 'filename_row_col', a, b from f union all select i, 'filename_col_row', b, a from f),
 k as (select distinct mode, row, col from m),
 s as (select mode, count(*) as n_images_mapped, count(n_cells) as n_cell_patches_matched, cast(coalesce(sum(n_cells), 0) as bigint) as n_cells_matched from k left join g using (row, col) group by 1)"""


@query(
    "j14_grid_map",
    rounded_sql(
        _J14 + "\n--body\nselect *, n_cell_patches_matched / (select count(*) from g) as cell_patch_coverage, n_cells_matched / (select sum(n_cells) from g) as cell_coverage from s",
        "cell_patch_coverage cell_coverage",
    ),
)
def grid_map(spark, sf):
    cands = P.grid_map_candidates(_files(spark, sf), "i", _DIMS, "key")
    return rounded(P.score_grid_maps(cands, P.cell_groups(_cells(spark, sf), "o_orderkey")))


@query(
    "j23_candidates",
    "select c_custkey, cast(i as int) as candidate, [200.0::double, 300.0::double][i // 9 + 1] as span, -2.0::double + ((i // 3) % 3) * 2 as shift_x, -2.0::double + (i % 3) * 2 as shift_y from customer, range(0, 18) r(i)",
)
def candidate_rows(spark, sf):
    cand = P.candidates([200, 300], -2, 2, 2)
    return V.table(spark, sf, "customer").select("c_custkey", F.explode(cand).alias("k")).select("c_custkey", "k.*")


_SPANS = "[8.0::double, 10.0::double]"
_A28 = "with " + V.V_PX + """, g as (select image_id, row, col, sqrt(gx * gx + gy * gy) as gradient from (select image_id, row, col, coalesce(lead(v::double) over a - lag(v::double) over a, 0) as gx, coalesce(lead(v::double) over d - lag(v::double) over d, 0) as gy from v_px window a as (partition by image_id, row order by col), d as (partition by image_id, col order by row))),
 pts as (select image_id, row as contour, col as ordinal, col + v::double as x, row + v::double as y from v_px where v > 0),
 c as (select cast(i as int) as candidate, """ + _SPANS + """[i // 9 + 1] as span, -1.0::double + ((i // 3) % 3) as shift_x, -1.0::double + (i % 3) as shift_y from range(0, 18) r(i)),
 mv as (select image_id, candidate, span, shift_x, shift_y, contour, ordinal, x * (8 / span) + shift_x as px, y * (8 / span) + shift_y as py from pts, c),
 nr as (select *, px >= -1 and px <= 8 and py >= -1 and py <= 8 as near, cast(round_even(px, 0) as int) as col, cast(round_even(py, 0) as int) as row from mv),
 sc as (select image_id, candidate, span, shift_x, shift_y, coalesce(avg(gradient), '-inf'::double) as score, count(distinct case when near then contour end) as kept
  from nr left join g using (image_id, row, col) group by all)"""


def _scores(spark, sf):
    px = V.mask_pixels(spark, sf).withColumn("v", F.col("v").cast("double"))
    grad = G.gradient_magnitude(px, ["image_id"], "v")
    points = px.where("v > 0").select(
        "image_id", F.col("row").alias("contour"), F.col("col").alias("ordinal"), F.lit(8).alias("n_points"), (F.col("col") + F.col("v")).alias("x"), (F.col("row") + F.col("v")).alias("y")
    )
    patches = V.sizes(spark, sf).withColumns({"x0": F.lit(0.0), "y0": F.lit(0.0)})
    return P.edge_scores(patches, points, grad, "image_id", P.candidates([8, 10], -1, 1, 1))


@query("a28_edge_scores", rounded_sql(_A28 + "\n--body\nselect * from sc", "score"))
def edge_scores(spark, sf):
    return rounded(_scores(spark, sf))


_W07 = _A28 + """, rk as (select *, row_number() over (partition by image_id order by round(score, 12) desc, candidate) as rn from sc where score > '-inf'::double),
 best as (select image_id, max(candidate) filter (where rn = 1) as best_candidate, max(score) filter (where rn = 1) as best_score, max(score) filter (where rn = 2) as second_score from rk where rn <= 2 group by 1)"""


@query("w07_best_candidates", rounded_sql(_W07 + "\n--body\nselect *, best_score - second_score as margin from best", "best_score second_score margin"))
def best_candidates(spark, sf):
    s = _scores(spark, sf).withColumn("score", F.round("score", 12))
    return rounded(P.best_candidates(s, "image_id"))


@query(
    "a27_calibration_summary",
    rounded_sql(
        _W07 + "\n--body\nselect candidate, span, shift_x, shift_y, count(*) filter (where candidate = best_candidate) as wins, avg(score) as mean_score, avg(kept) as mean_kept, median(score) as median_score, count(*) filter (where candidate = best_candidate) / count(*) as win_rate, -shift_x as offset_x, -shift_y as offset_y from sc join best using (image_id) group by all",
        "mean_score mean_kept median_score win_rate offset_x offset_y",
    ),
)
def calibration_summary(spark, sf):
    s = _scores(spark, sf).withColumn("score", F.round("score", 12))
    return rounded(P.calibration_summary(s, "image_id"))


_X15 = "with " + V.V_PX + """, pts as (select image_id, row as cell_ordinal, col as point_ordinal, col * 1.5::double + v::double * 4 as x, row * 1.5::double + v::double * 4 as y from v_px where v > 0.25),
 pt as (select vec_id as image_id, (vec_id % 4)::double as ox, (vec_id % 3)::double as oy from embeddings),
 vt as (select image_id, count(*) filter (where x >= 0 and x < 8 and y >= 0 and y < 8) as local, count(*) filter (where x - ox >= 0 and x - ox < 8 and y - oy >= 0 and y - oy < 8) as shift,
  count(*) filter (where x * 0.5 - ox >= 0 and x * 0.5 - ox < 8 and y * 0.5 - oy >= 0 and y * 0.5 - oy < 8) as scaled_shift from pts join pt using (image_id) group by 1)
 select image_id, coalesce(local, 0) as local, coalesce(shift, 0) as shift, coalesce(scaled_shift, 0) as scaled_shift,
  case when local is null then 'local' when scaled_shift >= greatest(local, shift) then 'scaled_shift' when shift >= local then 'shift' else 'local' end as mode from pt left join vt using (image_id)"""


@query("x15_contour_modes", _X15)
def contour_modes(spark, sf):
    v = F.col("v").cast("double") * 4
    points = V.mask_pixels(spark, sf).where("v > 0.25").select(
        "image_id", F.col("row").alias("cell_ordinal"), F.col("col").alias("point_ordinal"), (F.col("col") * 1.5 + v).alias("x"), (F.col("row") * 1.5 + v).alias("y")
    )
    patches = V.sizes(spark, sf).withColumns({"offset_x": (F.col("image_id") % 4).cast("double"), "offset_y": (F.col("image_id") % 3).cast("double")})
    return P.contour_modes(points, patches, ["image_id"], 0.5)


@query(
    "x14_affine",
    rounded_sql("with " + V.V_BOX + "\n--body\nselect cell_id, least(greatest(xmin * 0.5 + 10, 0), 49999) as x, least(greatest(ymin * 0.25 - 5, 0), 19999) as y from v_box", "x y"),
)
def affine(spark, sf):
    x, y = X.affine("xmin", "ymin", (0.5, 0.25), (10.0, -5.0), (50000, 20000))
    return rounded(V.boxes(spark, sf).select("cell_id", x.alias("x"), y.alias("y")))
