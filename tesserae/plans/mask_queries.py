"""Mask evaluation, shape and image-table queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import scalars as X
from ..operators import images as G, masks as M, shape as S
from . import views as V
from .registry import query, rounded, rounded_sql

IMG, MOD = "image_id", "model_name"
_IOU = "with " + V.V_PRED + """, ov as (select t.image_id, p.model_name, t.label as gt_label, p.label as pred_label, count(*) as intersection
 from v_truth t join v_pred p using (image_id, row, col) where t.label > 0 and p.label > 0 group by all),
 gs as (select image_id, label, count(*) as area from v_truth where label > 0 group by all),
 ps as (select image_id, model_name, label, count(*) as area from v_pred where label > 0 group by all),
 iou as (select ov.*, intersection / (gs.area + ps.area - intersection) as iou from ov join gs on gs.image_id = ov.image_id and gs.label = gt_label
  join ps on ps.image_id = ov.image_id and ps.model_name = ov.model_name and ps.label = pred_label)"""


def _iou(spark, sf):
    t, p = V.truth_mask(spark, sf), V.pred_mask(spark, sf)
    return M.iou_table(M.pixel_overlap(t, p, IMG, MOD), M.instance_sizes(t, [IMG]), M.instance_sizes(p, [IMG, MOD]), IMG, MOD)


@query("j24_pixel_overlap", _IOU + " select * from ov")
def pixel_overlap(spark, sf):
    return M.pixel_overlap(V.truth_mask(spark, sf), V.pred_mask(spark, sf), IMG, MOD)


@query("j24_run_overlap", _IOU + " select * from ov")
def run_overlap(spark, sf):
    t, p = M.to_runs(V.truth_mask(spark, sf), [IMG]), M.to_runs(V.pred_mask(spark, sf), [IMG, MOD])
    return M.run_overlap(t, p, IMG, MOD, span=4)


_CONF = _IOU + """, hit as (select p.image_id, p.model_name, count(t.label) as tp, count(*) as np from v_pred p left join (select * from v_truth where label > 0) t using (image_id, row, col) where p.label > 0 group by all),
 c as (select i.image_id, i.model_name, coalesce(tp, 0) as pixel_tp, height * width - coalesce(np, 0) - coalesce(ng, 0) + coalesce(tp, 0) as pixel_tn,
  coalesce(np, 0) - coalesce(tp, 0) as pixel_fp, coalesce(ng, 0) - coalesce(tp, 0) as pixel_fn from v_images i left join hit using (image_id, model_name)
  left join (select image_id, count(*) as ng from v_truth where label > 0 group by 1) using (image_id)),
 r as (select *, case when pixel_tp + pixel_fp > 0 then pixel_tp / (pixel_tp + pixel_fp) else 0 end as pixel_precision, case when pixel_tp + pixel_fn > 0 then pixel_tp / (pixel_tp + pixel_fn) else 0 end as pixel_recall,
  case when 2 * pixel_tp + pixel_fp + pixel_fn > 0 then 2 * pixel_tp / (2 * pixel_tp + pixel_fp + pixel_fn) else 0 end as pixel_f1 from c)"""


@query("a20_pixel_confusion", rounded_sql(_CONF + "\n--body\nselect *, pixel_f1 as pixel_dice from r", "pixel_precision pixel_recall pixel_f1 pixel_dice"))
def pixel_confusion(spark, sf):
    return rounded(M.pixel_confusion(V.images(spark, sf), V.truth_mask(spark, sf), V.pred_mask(spark, sf), IMG, MOD))


@query("a21_iou_table", rounded_sql(_IOU + "\n--body\nselect * from iou", "iou"))
def iou_table(spark, sf):
    return rounded(_iou(spark, sf))


@query("a21_instance_counts", _IOU + " select image_id, count(*) as n_instances from gs group by 1")
def instance_counts(spark, sf):
    return M.instance_counts(M.instance_sizes(V.truth_mask(spark, sf), [IMG]), [IMG])


# An image has four truth labels, so the best assignment is the best of all ways to give each truth label
# one of the predicted labels or none; the SQL tries them all.
_PERM = _IOU + """, opts as (select image_id, model_name, gt_label, pred_label, iou from iou union all
  select distinct image_id, model_name, gt_label, 0, 0 from iou),
 ways as (select coalesce(a.image_id, b.image_id, c.image_id, d.image_id) as image_id, coalesce(a.model_name, b.model_name, c.model_name, d.model_name) as model_name,
   a.pred_label as pa, b.pred_label as pb, c.pred_label as pc, d.pred_label as pd, coalesce(a.iou, 0) as ia, coalesce(b.iou, 0) as ib, coalesce(c.iou, 0) as ic, coalesce(d.iou, 0) as id
  from (select * from opts where gt_label = 1) a full join (select * from opts where gt_label = 2) b on a.image_id = b.image_id and a.model_name = b.model_name
  full join (select * from opts where gt_label = 3) c on c.image_id = coalesce(a.image_id, b.image_id) and c.model_name = coalesce(a.model_name, b.model_name)
  full join (select * from opts where gt_label = 4) d on d.image_id = coalesce(a.image_id, b.image_id, c.image_id) and d.model_name = coalesce(a.model_name, b.model_name, c.model_name)),
 legal as (select * from ways where not coalesce(pa > 0 and (pa = pb or pa = pc or pa = pd), false) and not coalesce(pb > 0 and (pb = pc or pb = pd), false) and not coalesce(pc > 0 and pc = pd, false)),
 best as (select image_id, model_name, arg_max([ia, ib, ic, id], round(ia + ib + ic + id, 9)) as ious, count(*) as n from legal group by 1, 2),
 hits as (select image_id, model_name, len(list_filter(ious, lambda x: x >= 0.5)) as instance_tp, list_sum(list_filter(ious, lambda x: x >= 0.5)) as s from best)"""
_INST = _PERM + """, m as (select i.image_id, i.model_name, coalesce(instance_tp, 0) as instance_tp, coalesce(np, 0) - coalesce(instance_tp, 0) as instance_fp, coalesce(ng, 0) - coalesce(instance_tp, 0) as instance_fn, coalesce(s, 0) as s
  from v_images i left join hits using (image_id, model_name) left join (select image_id, count(*) as ng from gs group by 1) using (image_id) left join (select image_id, model_name, count(*) as np from ps group by 1, 2) using (image_id, model_name))"""
_INST_BODY = """select image_id, model_name, instance_tp, instance_fp, instance_fn,
 case when instance_tp + instance_fp > 0 then instance_tp / (instance_tp + instance_fp) else 0 end as instance_object_precision, case when instance_tp + instance_fn > 0 then instance_tp / (instance_tp + instance_fn) else 0 end as instance_object_recall,
 case when 2 * instance_tp + instance_fp + instance_fn > 0 then 2 * instance_tp / (2 * instance_tp + instance_fp + instance_fn) else 0 end as instance_rq,
 case when instance_tp > 0 then s / instance_tp else 0 end as instance_sq, case when 2 * instance_tp + instance_fp + instance_fn > 0 then 2 * s / (2 * instance_tp + instance_fp + instance_fn) else 0 end as instance_pq from m"""
_INST_COLS = "instance_object_precision instance_object_recall instance_rq instance_sq instance_pq"


def _pairs(spark, sf):
    return M.match_instances(_iou(spark, sf), [IMG, MOD], 0.5)


@query("a22_match_instances", rounded_sql(_PERM + "\n--body\nselect image_id, model_name, instance_tp as n_pairs, s as iou_sum from hits where instance_tp > 0", "iou_sum"))
def match_instances(spark, sf):
    return rounded(_pairs(spark, sf).groupBy(IMG, MOD).agg(F.count(F.lit(1)).alias("n_pairs"), F.sum("iou").alias("iou_sum")))


@query("a23_instance_metrics", rounded_sql(_INST + "\n--body\n" + _INST_BODY, _INST_COLS))
def instance_metrics(spark, sf):
    t, p = V.truth_mask(spark, sf), V.pred_mask(spark, sf)
    return rounded(M.instance_metrics(V.images(spark, sf), M.instance_sizes(t, [IMG]), M.instance_sizes(p, [IMG, MOD]), _pairs(spark, sf), IMG, MOD))


@query(
    "a24_batch_evaluation",
    rounded_sql(
        _CONF.replace("with ", "with ", 1) + ", " + _INST[len(_IOU) + 2 :] + ", e as (" + _INST_BODY + ")\n--body\nselect model_name, count(*) as n_images, avg(instance_pq) as mean_pq, avg(pixel_f1) as mean_dice from e join r using (image_id, model_name) group by 1",
        "mean_pq mean_dice",
    ),
)
def batch_evaluation(spark, sf):
    full = M.evaluate(V.images(spark, sf), V.truth_mask(spark, sf), V.pred_mask(spark, sf))
    return rounded(full.groupBy(MOD).agg(F.count(F.lit(1)).alias("n_images"), F.avg("instance_pq").alias("mean_pq"), F.avg("pixel_dice").alias("mean_dice")))


_STATUS = "with " + V.V_PRED + """, st as (select i.image_id, i.model_name, case when p.image_id is null then 'missing_prediction' else 'ok' end as status from v_images i left join (select distinct image_id, model_name from v_pred) p using (image_id, model_name))"""


def _status(spark, sf):
    have = V.pred_mask(spark, sf).groupBy(IMG, MOD).agg((F.max("row") + 1).alias("height"), (F.max("col") + 1).alias("width"))
    return M.evaluation_status(V.images(spark, sf), V.sizes(spark, sf), have, IMG, MOD)


@query("p29_evaluation_status", _STATUS + " select * from st")
def evaluation_status(spark, sf):
    return _status(spark, sf)


@query("a24_status_summary", _STATUS + " select model_name, count(*) as n_rows, count(*) filter (where status = 'ok') as n_ok, count(*) filter (where status <> 'ok') as n_error from st group by 1")
def status_summary(spark, sf):
    return M.status_summary(_status(spark, sf), MOD)


@query("p28_value_check", "with " + V.V_PX + " select image_id, true as finite, bool_and(v * 64 = floor(v * 64)) as whole, bool_and(v >= 0) as non_negative from v_px group by 1")
def value_check(spark, sf):
    return M.value_check(V.mask_pixels(spark, sf).withColumn("label", F.col("v") * 64), [IMG])


@query("x20_channel_check", "with " + V.V_RGB + " select image_id, bool_and(r = g and g = b) as replicated, min(a) = max(a) as constant_alpha, bool_and(r = g and g = b) and min(a) = max(a) as reducible from v_rgb group by 1")
def channel_check(spark, sf):
    return M.channel_check(V.colour_pixels(spark, sf), [IMG])


_SHAPE = "with " + V.V_TRUTH + """, s as (select image_id, label, count(*) as area_pixels, min(row) as bbox_min_row, min(col) as bbox_min_col, max(row) + 1 as bbox_max_row, max(col) + 1 as bbox_max_col,
 avg(row) as centroid_row, avg(col) as centroid_col, var_pop(row) as rr, var_pop(col) as cc, covar_pop(row, col) as rc from v_truth where label > 0 group by 1, 2),
 l as (select *, (rr + cc) / 2 + sqrt(((rr - cc) / 2) * ((rr - cc) / 2) + rc * rc) as l1, greatest((rr + cc) / 2 - sqrt(((rr - cc) / 2) * ((rr - cc) / 2) + rc * rc), 0) as l2 from s)"""
_SHAPE_COLS = "centroid_row centroid_col equivalent_diameter major_axis_length fill_ratio"
_SHAPE_OUT = ["image_id", "label", "area_pixels", "bbox_min_row", "bbox_min_col", "bbox_max_row", "bbox_max_col", "bbox_area", *_SHAPE_COLS.split()]


@query(
    "a45_instance_shapes",
    rounded_sql(
        _SHAPE + "\n--body\nselect image_id, label, area_pixels, bbox_min_row, bbox_min_col, bbox_max_row, bbox_max_col, cast((bbox_max_row - bbox_min_row) * (bbox_max_col - bbox_min_col) as bigint) as bbox_area, centroid_row, centroid_col, sqrt(4 / pi() * area_pixels) as equivalent_diameter, 4 * sqrt(l1) as major_axis_length, area_pixels / ((bbox_max_row - bbox_min_row) * (bbox_max_col - bbox_min_col)) as fill_ratio from l",
        _SHAPE_COLS,
    ),
)
def instance_shapes(spark, sf):
    return rounded(S.instance_shapes(V.truth_mask(spark, sf), [IMG]).select(*_SHAPE_OUT))


@query(
    "a45_shape_axes",
    rounded_sql(_SHAPE + "\n--body\nselect image_id, label, 4 * sqrt(l2) as minor_axis_length, case when l1 > 0 then sqrt(greatest(1 - l2 / l1, 0)) else 0 end as eccentricity from l", "minor_axis_length eccentricity", 3),
)
def shape_axes(spark, sf):
    return rounded(S.instance_shapes(V.truth_mask(spark, sf), [IMG]).select("image_id", "label", "minor_axis_length", "eccentricity"), 3)


@query(
    "a46_perimeter",
    rounded_sql(
        "with " + V.V_TRUTH + """, fg as (select * from v_truth where label > 0),
 border as (select f.* from fg f where (select count(*) from fg n where n.image_id = f.image_id and n.label = f.label and abs(n.row - f.row) + abs(n.col - f.col) = 1) < 4),
 codes as (select b.image_id, b.label, b.row, b.col, sum(case when n.row = b.row and n.col = b.col then 1 when n.row <> b.row and n.col <> b.col then 10 else 2 end) as code
  from border b join border n on n.image_id = b.image_id and n.label = b.label and abs(n.row - b.row) <= 1 and abs(n.col - b.col) <= 1 group by all)
--body
select image_id, label, sum(case when code in (5, 7, 15, 17, 25, 27) then 1 when code in (21, 33) then sqrt(2) when code in (13, 23) then (1 + sqrt(2)) / 2 else 0 end) as perimeter_pixels from codes group by 1, 2""",
        "perimeter_pixels",
    ),
)
def perimeter(spark, sf):
    return rounded(S.perimeters(V.truth_mask(spark, sf), [IMG]))


@query("a46_full_features")
def full_features(spark, sf):
    return rounded(S.full_features(V.truth_mask(spark, sf), [IMG]))


_A19 = "with " + V.V_TRUTH + ", o as (select image_id, label, count(*) as area from v_truth where label > 0 group by 1, 2 having count(*) > 10)"


@query(
    "a19_patch_summary",
    rounded_sql(
        _A19 + """
--body
select vec_id as image_id, 8 as height, 8 as width, count(area) as num_objects, coalesce(cast(sum(area) as bigint), 0) as total_mask_area, avg(area) as mean_area, median(area) as median_area, stddev_pop(area) as std_area, coalesce(sum(area), 0) / 64.0::double as foreground_fraction
 from embeddings left join o on image_id = vec_id group by vec_id""",
        "mean_area median_area std_area foreground_fraction",
    ),
)
def patch_summary(spark, sf):
    objects = M.instance_sizes(V.truth_mask(spark, sf), [IMG]).where("area > 10").withColumnRenamed("area", "area_pixels")
    return rounded(S.patch_summary(V.sizes(spark, sf), objects, [IMG], []))


_A47 = "with " + V.V_TRUTH + ", o as (select image_id, label, count(*) as area_pixels from v_truth where label > 0 group by 1, 2 having count(*) >= 8), bad as (select image_id, count(*) as n_objects from o group by 1 having count(*) > 2)"


@query("a47_object_filters", _A47 + " select * from o where image_id not in (select image_id from bad)")
def object_filters(spark, sf):
    objects = M.instance_sizes(V.truth_mask(spark, sf), [IMG]).withColumnRenamed("area", "area_pixels")
    return S.object_filters(objects, [IMG], 8, 2)[0]


@query("a47_rejected_images", _A47 + " select *, 'feature_extraction' as failure_stage from bad")
def rejected_images(spark, sf):
    objects = M.instance_sizes(V.truth_mask(spark, sf), [IMG]).withColumnRenamed("area", "area_pixels")
    return S.object_filters(objects, [IMG], 8, 2)[1]


_A43 = [f"{w}_{s}_{c}" for c in "rgb" for w in ("image", "foreground") for s in ("mean", "std")]


@query(
    "a43_intensity",
    rounded_sql(
        "with " + V.V_RGB + "\n--body\nselect image_id, " + ", ".join(
            f"avg({c}) as image_mean_{c}, stddev_pop({c}) as image_std_{c}, avg({c}) filter (where label > 0) as foreground_mean_{c}, stddev_pop({c}) filter (where label > 0) as foreground_std_{c}" for c in "rgb"
        ) + " from v_rgb group by 1",
        " ".join(_A43),
    ),
)
def intensity(spark, sf):
    return rounded(S.intensity(V.colour_pixels(spark, sf), [IMG]))


_PARTS = "select p_partkey as sample_id, 40 + p_size * 3 as height, 30 + cast(floor(p_retailprice) as int) % 97 as width, case when p_size % 2 = 0 then 0.25::double else 0.5::double end as mpp from part"


def _slides(spark, sf):
    return V.table(spark, sf, "part").select(
        F.col("p_partkey").alias("sample_id"), (40 + F.col("p_size") * 3).alias("height"), (30 + F.floor("p_retailprice").cast("int") % 97).alias("width"),
        F.when(F.col("p_size") % 2 == 0, 0.25).otherwise(0.5).alias("mpp"),
    )


_G01 = f"""with s as ({_PARTS}), t as (select sample_id, height, width, y0, unnest(case when width >= 32 then range(0, width - 32 + 1, 16) else []::bigint[] end) as x0
 from (select *, unnest(case when height >= 32 then range(0, height - 32 + 1, 16) else []::bigint[] end) as y0 from s))"""


@query(
    "g01_full_tiles",
    _G01 + """ select sample_id, x0, y0, x0 + 32 as x1, y0 + 32 as y1, row_number() over (partition by sample_id order by y0, x0) - 1 as patch_index,
 concat(sample_id, '.', lpad(cast(x0 as varchar), 5, '0'), 'x_', lpad(cast(y0 as varchar), 5, '0'), 'y') as patch_id from t""",
)
def full_tiles(spark, sf):
    return G.full_tiles(_slides(spark, sf), "sample_id", 32, 16).select("sample_id", "x0", "y0", "x1", "y1", "patch_index", "patch_id")


@query(
    "w09_patch_numbering",
    _G01 + " select sample_id, max(n) as last_index, count(*) as n_patches from (select sample_id, row_number() over (partition by sample_id order by y0, x0) - 1 as n from t) group by 1",
)
def patch_numbering(spark, sf):
    t = G.full_tiles(_slides(spark, sf), "sample_id", 32, 16)
    return t.groupBy("sample_id").agg(F.max("patch_index").alias("last_index"), F.count(F.lit(1)).alias("n_patches"))


@query("x12_tile_descriptor", _G01 + " select distinct x0, y0, concat(lpad(cast(x0 as varchar), 5, '0'), 'x_', lpad(cast(y0 as varchar), 5, '0'), 'y') as descriptor from t")
def tile_descriptor(spark, sf):
    t = G.full_tiles(_slides(spark, sf), "sample_id", 32, 16)
    return t.select("x0", "y0", X.tile_descriptor("x0", "y0").alias("descriptor")).distinct()


@query(
    "a41_tile_counts",
    f"with s as ({_PARTS}), c as (select sample_id, cast(case when height >= 64 then (height - 64) // 16 + 1 else 0 end as bigint) as patch_rows, cast(case when width >= 64 then (width - 64) // 16 + 1 else 0 end as bigint) as patch_cols from s) select *, patch_rows * patch_cols as patch_count from c",
)
def tile_counts(spark, sf):
    return G.tile_counts(_slides(spark, sf), "sample_id", 64, 16)


@query(
    "g02_slide_tiles",
    f"""with s as (select *, cast(round_even(64 * 0.3::double / mpp, 0) as int) as ts, cast(round_even(48 * 0.3::double / mpp, 0) as int) as st from ({_PARTS}))
 select sample_id, ts as tile_size_level0, st as stride_level0, tile_y, unnest(range(0, greatest(width - ts, 0) + 1, st)) as tile_x from (select *, unnest(range(0, greatest(height - ts, 0) + 1, st)) as tile_y from s)""",
)
def slide_tiles(spark, sf):
    return G.slide_tiles(_slides(spark, sf), "sample_id", 64, 16, 0.3).select("sample_id", "tile_size_level0", "stride_level0", "tile_y", "tile_x")


@query(
    "g03_crop_to_tiles",
    "with " + V.V_TRUTH + """ select image_id, cast(tr as bigint) as patch_row, cast(tc as bigint) as patch_col, cast(row - tr * 2 as bigint) as tile_row, cast(col - tc * 2 as bigint) as tile_col, label
 from v_truth, range(0, 3) a(tr), range(0, 3) b(tc) where row >= tr * 2 and row < tr * 2 + 4 and col >= tc * 2 and col < tc * 2 + 4""",
)
def crop_to_tiles(spark, sf):
    px = V.truth_mask(spark, sf).withColumns({"height": F.lit(8), "width": F.lit(8)})
    return G.crop_to_tiles(px, [IMG], 4, 2).select(IMG, "patch_row", "patch_col", "tile_row", "tile_col", "label")


_G04 = "with " + V.V_TRUTH + """, across as (select image_id, label, row, col // 2 as tcol, floor(count(*) * 255.0::double / 2 + 0.5) as q from v_truth where label > 0 group by all),
 down as (select image_id, label, row // 2 as trow, tcol, floor(sum(q) / 2 + 0.5) / 255.0::double as score from across group by all),
 small as (select image_id, cast(trow as int) as row, cast(tcol as int) as col, arg_min(label, (-score, label)) as label from down where score >= 0.5 group by all)"""


@query("g04_downscale_mask", _G04 + " select * from small")
def downscale_mask(spark, sf):
    return G.downscale_mask(V.truth_mask(spark, sf), V.sizes(spark, sf), [IMG], 0.5, 0.5)


@query(
    "g04_downscale_uneven",
    "with " + V.V_TRUTH + """, bin as (select c, cast(ceil((c + 0.5) * 5 / 8) - 1 as int) as o from range(0, 8) r(c)), wide as (select o, count(*) as n from bin group by 1),
 across as (select image_id, label, row, b.o as tcol, floor(count(*) * 255.0::double / any_value(n) + 0.5) as q from v_truth join bin b on b.c = col join wide w on w.o = b.o where label > 0 group by all),
 down as (select image_id, label, b.o as trow, tcol, floor(sum(q) / any_value(n) + 0.5) / 255.0::double as score from across join bin b on b.c = row join wide w on w.o = b.o group by all)
 select image_id, trow as row, tcol as col, arg_min(label, (-score, label)) as label from down where score >= 0.4 group by all""",
)
def downscale_uneven(spark, sf):
    return G.downscale_mask(V.truth_mask(spark, sf), V.sizes(spark, sf), [IMG], 0.625, 0.4)


@query(
    "g04_upscale_mask",
    "with " + V.V_TRUTH + " select image_id, cast(r as int) as row, cast(c as int) as col, label from v_truth, range(0, 12) a(r), range(0, 12) b(c) where label > 0 and row = cast(floor((r + 0.5) * 8 / 12) as int) and col = cast(floor((c + 0.5) * 8 / 12) as int)",
)
def upscale_mask(spark, sf):
    return G.upscale_mask(V.truth_mask(spark, sf), V.sizes(spark, sf), [IMG], 1.5)


@query(
    "g05_downscale_channels",
    "with " + V.V_RGB + """, across as (select image_id, row, col // 2 as c, """ + ", ".join(f"floor(avg({k}) + 0.5) as {k}" for k in "rgb") + """ from v_rgb group by all)
 select image_id, cast(row // 2 as int) as row, cast(c as int) as col, """ + ", ".join(f"cast(floor(avg({k}) + 0.5) as bigint) as {k}" for k in "rgb") + " from across group by image_id, row // 2, c",
)
def downscale_channels(spark, sf):
    return G.downscale_channels(V.colour_pixels(spark, sf), V.sizes(spark, sf), [IMG], 0.5, "rgb")


@query(
    "a44_rescale_bookkeeping",
    _G04 + """, a as (select distinct image_id, label from v_truth where label > 0), b as (select distinct image_id, label, 1 as k from small)
 select image_id, count(*) as original_instance_count, count(k) as resized_instance_count, count(*) filter (where k is null) as dropped_instance_count, coalesce(string_agg(case when k is null then cast(label as varchar) end, ',' order by label), '') as dropped_instance_labels from a left join b using (image_id, label) group by 1""",
)
def rescale_bookkeeping(spark, sf):
    t = V.truth_mask(spark, sf)
    return G.rescale_bookkeeping(t, G.downscale_mask(t, V.sizes(spark, sf), [IMG], 0.5, 0.5), [IMG])


@query(
    "g06_merge_instances",
    "with " + V.V_PRED + " select image_id, row, col, max(label) as label, count(*) - 1 as overlaps from v_pred where label > 0 group by 1, 2, 3",
)
def merge_instances(spark, sf):
    return G.merge_instances(M.foreground(V.pred_mask(spark, sf)), [IMG], "label")


@query(
    "g07_label_components",
    "with recursive " + V.V_TRUTH + """, fg as (select image_id, row, col, row * 8 + col as p from v_truth where label > 0),
 adj as (select a.image_id, a.p as a, b.p as b from fg a join fg b on a.image_id = b.image_id and abs(a.row - b.row) <= 1 and abs(a.col - b.col) <= 1),
 reach(image_id, a, b) as (select image_id, a, b from adj union select r.image_id, r.a, adj.b from reach r join adj on adj.image_id = r.image_id and adj.a = r.b),
 comp as (select image_id, a as p, min(b) as m from reach group by 1, 2)
 select image_id, cast(p // 8 as int) as row, cast(p % 8 as int) as col, dense_rank() over (partition by image_id order by m) as label from comp""",
)
def label_components(spark, sf):
    binary = V.truth_mask(spark, sf).withColumn("label", (F.col("label") > 0).cast("int"))
    return M.label_components(binary, [IMG])


_G08 = f"select sample_id as image_id, height, width, cast(floor((128 - height) / 2.0) as int) as pad_y0, cast(floor((128 - width) / 2.0) as int) as pad_x0, case when height > 128 or width > 128 then 'image_larger_than_pad' end as failure_stage from ({_PARTS})"


@query("g08_pad_offsets", _G08)
def pad_offsets(spark, sf):
    return G.pad_offsets(_slides(spark, sf).withColumnRenamed("sample_id", IMG).drop("mpp"), 128)


@query("g08_crop_to_extent", "with " + V.V_TRUTH + " select image_id, row, col, label from v_truth where label > 0")
def crop_to_extent(spark, sf):
    off = G.pad_offsets(V.sizes(spark, sf), 13)
    padded = G.to_padded(M.foreground(V.truth_mask(spark, sf)), off, [IMG])
    return G.crop_to_extent(padded, off, [IMG])


def _near(src: str, agg: str) -> str:
    return f"select a.image_id, a.row, a.col, {agg}(b.on_) as on_ from {src} a join {src} b on a.image_id = b.image_id and abs(a.row - b.row) <= 1 and abs(a.col - b.col) <= 1 group by all"


@query(
    "g09_open_close",
    "with " + V.V_TRUTH + ", s0 as materialized (select image_id, row, col, cast(label > 0 as int) as on_ from v_truth), s1 as materialized (" + _near("s0", "min") + "), s2 as materialized (" + _near("s1", "max") + "), s3 as materialized (" + _near("s2", "max") + "), s4 as materialized (" + _near("s3", "min") + ") select image_id, row, col, 1 as label from s4 where on_ = 1",
)
def open_close(spark, sf):
    return G.open_close(V.truth_mask(spark, sf), V.sizes(spark, sf), [IMG], 3)


@query(
    "g10_percentile_normalise",
    rounded_sql(
        "with " + V.V_RGB + ", q as (select image_id, quantile_cont(r::double, 0.01) as lo, quantile_cont(r::double, 0.998) as hi from v_rgb group by 1)\n--body\nselect image_id, row, col, r, (r - lo) / (hi - lo + 1e-20) as normalised from v_rgb join q using (image_id)",
        "normalised",
    ),
)
def percentile_normalise(spark, sf):
    return rounded(G.percentile_normalise(V.colour_pixels(spark, sf).select(IMG, "row", "col", "r"), [IMG], "r"))


@query(
    "w11_gradient",
    rounded_sql(
        "with " + V.V_PX + """, g as (select image_id, row, col, coalesce(lead(v::double) over a - lag(v::double) over a, 0) as gx, coalesce(lead(v::double) over d - lag(v::double) over d, 0) as gy from v_px window a as (partition by image_id, row order by col), d as (partition by image_id, col order by row))
--body
select image_id, row, col, sqrt(gx * gx + gy * gy) as gradient from g""",
        "gradient",
    ),
)
def gradient(spark, sf):
    px = V.mask_pixels(spark, sf).withColumn("v", F.col("v").cast("double"))
    return rounded(G.gradient_magnitude(px, [IMG], "v").select(IMG, "row", "col", "gradient"))


@query(
    "w11_boundaries",
    "with " + V.V_TRUTH + " select t.* from v_truth t where label > 0 and exists (select 1 from v_truth n where n.image_id = t.image_id and abs(n.row - t.row) + abs(n.col - t.col) = 1 and n.label <> t.label)",
)
def boundaries(spark, sf):
    return G.boundaries(V.truth_mask(spark, sf), [IMG])


@query(
    "a48_occupancy",
    rounded_sql(
        "with " + V.V_TRUTH + """, t as (select vec_id as image_id, ty, tx from embeddings, range(0, 33, 16) a(ty), range(0, 33, 16) b(tx)),
 b as (select *, tx // 6 as x0, ty // 6 as y0, least((tx + 16) // 6, 8) as x1, least((ty + 16) // 6, 8) as y1 from t),
 o as (select b.image_id, ty, tx, avg(cast(label > 0 as int)) as occupancy from b join v_truth v on v.image_id = b.image_id and row >= y0 and row < y1 and col >= x0 and col < x1 group by all)
--body
select image_id, ty as tile_y, tx as tile_x, occupancy from o where occupancy > 0.5""",
        "occupancy",
    ),
)
def occupancy(spark, sf):
    s = V.sizes(spark, sf)
    slides = s.withColumn("downsample", F.lit(6.0))
    step = F.sequence(F.lit(0).cast("bigint"), F.lit(32).cast("bigint"), F.lit(16).cast("bigint"))
    tiles = s.select(IMG, F.explode(step).alias("tile_y")).select("*", F.explode(step).alias("tile_x")).withColumns(
        {"tile_size_level0": F.lit(16), "tile_id": F.concat_ws("_", "tile_x", "tile_y")}
    )
    out = G.occupancy(tiles, V.truth_mask(spark, sf), slides, IMG, "tile_id", 0.5, cell=4)
    return rounded(out.select(IMG, "tile_y", "tile_x", "occupancy"))


_OTSU = "with " + V.V_RGB + """, p as (select image_id, row, col, (r::double + g + b) / 3 as lum from v_rgb), e as (select image_id, min(lum) lo, max(lum) hi from p group by 1),
 h as (select image_id, lo, hi, least(floor((lum - lo) / ((hi - lo) / 256)), 255) as bin, count(*) as n from p join e using (image_id) where hi > lo group by all),
 c as (select *, lo + (bin + 0.5) * ((hi - lo) / 256) as centre from h),
 s as (select image_id, bin, centre, sum(n) over w as w1, sum(n * centre) over w as m1, sum(n) over (partition by image_id) as wt, sum(n * centre) over (partition by image_id) as mt from c window w as (partition by image_id order by bin)),
 b as (select image_id, arg_min(centre, (-round(w1 * (wt - w1) * (m1 / w1 - (mt - m1) / (wt - w1)) * (m1 / w1 - (mt - m1) / (wt - w1)), 9), bin)) as t from s where wt > w1 group by 1),
 th as (select image_id, coalesce(t, lo) as threshold from e left join b using (image_id))"""


def _otsu(spark, sf):
    px = V.colour_pixels(spark, sf).withColumn("lum", G.luminance())
    return px, G.otsu_thresholds(px, IMG, "lum", whole_bins=False)


@query("a49_otsu_threshold", rounded_sql(_OTSU + "\n--body\nselect * from th", "threshold"))
def otsu_threshold(spark, sf):
    return rounded(_otsu(spark, sf)[1])


@query("a49_foreground", _OTSU + " select image_id, count(*) filter (where lum < threshold) as n_foreground from p join th using (image_id) group by 1")
def otsu_foreground(spark, sf):
    px, th = _otsu(spark, sf)
    return G.apply_threshold(px, th, IMG, "lum").groupBy(IMG).agg(F.count_if(F.col("label") == 1).alias("n_foreground"))


@query(
    "x16_target_size",
    f"select sample_id, greatest(1, cast(round_even(height * 0.5::double, 0) as int)) as th, greatest(1, cast(round_even(width * 0.01::double, 0) as int)) as tw from ({_PARTS})",
)
def target_size(spark, sf):
    return _slides(spark, sf).select("sample_id", X.target_size("height", F.lit(0.5)).alias("th"), X.target_size("width", F.lit(0.01)).alias("tw"))


@query(
    "x13_object_ratios",
    rounded_sql(
        "with " + V.V_TRUTH + ", o as (select image_id, label, count(*) as area, (count(*) % 5) * 4.0::double as perimeter from v_truth where label > 0 group by 1, 2)\n--body\nselect image_id, label, case when perimeter > 0 then 4 * pi() * area / (perimeter * perimeter) end as circularity, case when area > 0 then perimeter / area end as perimeter_area_ratio, sqrt(4 / pi() * area) as diameter from o",
        "circularity perimeter_area_ratio diameter",
    ),
)
def object_ratios(spark, sf):
    o = M.instance_sizes(V.truth_mask(spark, sf), [IMG]).withColumn("perimeter", (F.col("area") % 5) * 4.0)
    return rounded(o.select(IMG, "label", X.circularity("area", "perimeter").alias("circularity"), X.ratio_or_null("perimeter", "area").alias("perimeter_area_ratio"), X.equivalent_diameter("area").alias("diameter")))
