"""Key, path and validation queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import keys as K, scalars as X
from ..operators import joins as J, manifests as N
from . import views as V
from .registry import query, rounded, rounded_sql


def _refs(spark, sf):
    """Parts as path references in six spellings."""
    k = F.col("p_partkey").cast("string")
    form = F.col("p_partkey") % 6
    ref = (
        F.when(form == 0, F.concat(F.lit("samples/"), k, F.lit("/"), k, F.lit("_image.png")))
        .when(form == 1, F.concat(F.lit(" tiles/a b/"), k, F.lit("_mask.png ")))
        .when(form == 2, F.concat(F.lit("/data/run/images/"), k, F.lit(".v2.tif")))
        .when(form == 3, F.concat(F.lit("pre_"), k, F.lit("_class_labels")))
        .when(form == 4, F.lit("  "))
    )
    return V.table(spark, sf, "part").select("p_partkey", ref.alias("ref"), F.col("p_name").alias("name"), F.col("p_brand").alias("brand"), F.col("p_type").alias("type"))


V_REF = """v_ref as (select p_partkey, case p_partkey % 6 when 0 then concat('samples/', p_partkey, '/', p_partkey, '_image.png') when 1 then concat(' tiles/a b/', p_partkey, '_mask.png ')
 when 2 then concat('/data/run/images/', p_partkey, '.v2.tif') when 3 then concat('pre_', p_partkey, '_class_labels') when 4 then '  ' end as ref, p_name as name, p_brand as brand, p_type as type from part),
 v_base as (select *, coalesce(trim(ref), '') as t, regexp_extract(coalesce(trim(ref), ''), '[^/]*$') as base, regexp_replace(regexp_extract(coalesce(trim(ref), ''), '[^/]*$'), '\\.[^.]+$', '') as stem from v_ref)"""
_B = "with " + V_REF + " select p_partkey, "


@query("p01_patch_id", _B + "case when base like '%\\_image.png' escape '\\' then regexp_replace(base, '_image\\.png$', '') else stem end as patch_id from v_base")
def patch_id(spark, sf):
    return _refs(spark, sf).select("p_partkey", K.patch_id_from_image("ref").alias("patch_id"))


@query("p02_sample_id", _B + "case when ref like 'samples/%' then split_part(ref, '/', 2) when regexp_matches(base, '_(image|mask|class_labels)\\.png$') then regexp_replace(base, '_(image|mask|class_labels)\\.png$', '') else stem end as sample_id from v_base")
def sample_id(spark, sf):
    return _refs(spark, sf).select("p_partkey", K.sample_id_from_image("ref").alias("sample_id"))


@query("p03_join_key", _B + "regexp_replace(regexp_replace(base, '^pre_', ''), '\\.png$', '') as k from v_base")
def join_key(spark, sf):
    return _refs(spark, sf).select("p_partkey", K.join_key("ref", True, "pre_", ".png").alias("k"))


@query("p04_key_variants", _B + "t as raw, base as basename, stem as basename_stem, regexp_replace(stem, '_(image|mask|class_labels)$', '') as basename_strip_role from v_base")
def key_variants(spark, sf):
    return _refs(spark, sf).select("p_partkey", *[e.alias(n) for n, e in K.join_key_variants("ref").items()])


@query("p05_safe_token", "select page_id, coalesce(nullif(regexp_replace(regexp_replace(url, '[^A-Za-z0-9._-]+', '_', 'g'), '^_+|_+$', '', 'g'), ''), 'sample') as token from pages")
def safe_token(spark, sf):
    return V.table(spark, sf, "pages").select("page_id", K.safe_token("url").alias("token"))


@query(
    "p06_sample_id_from_path",
    _B + """array_to_string(list_transform(list_concat(list_filter(string_split(t, '/'), lambda p: p <> '')[:-2], [coalesce(nullif(regexp_replace(stem, '_image$', ''), ''), stem)]),
 lambda p: coalesce(nullif(regexp_replace(regexp_replace(p, '[^A-Za-z0-9._-]+', '_', 'g'), '^_+|_+$', '', 'g'), ''), 'sample')), '__') as sid from v_base where t <> ''""",
)
def sample_id_from_path(spark, sf):
    return _refs(spark, sf).where(~K.is_blank("ref")).select("p_partkey", K.sample_id_from_relative_path("ref", "_image").alias("sid"))


@query("p07_model_column", "select distinct p_name, regexp_replace(regexp_replace(lower(trim(p_name)), '[^0-9a-z]+', '_', 'g'), '^_+|_+$', '', 'g') as c from part")
def model_column(spark, sf):
    return V.table(spark, sf, "part").select("p_name", K.model_column_name("p_name").alias("c")).distinct()


@query("p08_group_id", "select p_partkey, regexp_replace(regexp_replace(p_brand, '^Brand#', ''), '[02]', '', 'g') as slide_id from part")
def group_id(spark, sf):
    return V.table(spark, sf, "part").select("p_partkey", K.group_id("p_brand", prefix="Brand#", pattern="[02]").alias("slide_id"))


@query(
    "p09_canonical_manifest",
    "with " + V.V_MANIFEST + " select patch_id, slide_id, 'demo' as dataset, null::varchar as split, embedding_path, mean_area from v_manifest",
)
def canonical_manifest(spark, sf):
    return N.canonical_manifest(
        V.manifest(spark, sf), {"patch_id": "patch_id", "slide_id": "slide_id", "embedding_path": "embedding_path"}, {"dataset": "demo", "split": None}, ["mean_area"]
    )


@query("p10_canonical_path", _B + "regexp_replace(t, '^/data/run/', '') as path from v_base")
def canonical_path(spark, sf):
    return _refs(spark, sf).select("p_partkey", K.canonical_path("ref", "/data/run").alias("path"))


@query("p11_first_present", _B + "coalesce(nullif(trim(ref), ''), case when p_partkey % 4 > 0 then trim(name) end, concat('row_', p_partkey)) as id from v_base")
def first_present(spark, sf):
    df = _refs(spark, sf).withColumn("name", F.when(F.col("p_partkey") % 4 > 0, F.col("name")))
    return df.select("p_partkey", K.first_present(["ref", "name"], "p_partkey").alias("id"))


@query("p13_passthrough", "select p_partkey as input_sample_id, p_type as input_status, p_name as name from part")
def passthrough(spark, sf):
    df = V.table(spark, sf, "part").select(F.col("p_partkey").alias("sample_id"), F.col("p_type").alias("status"), F.col("p_name").alias("name"))
    return N.passthrough(df, {"sample_id", "status", "image_path"})


@query("p15_blank_counts", "with " + V_REF + " select count(*) filter (where t = '') as ref, count(*) filter (where trim(coalesce(name, '')) = '') as name from v_base")
def blank_counts(spark, sf):
    return J.blank_counts(_refs(spark, sf), ["ref", "name"])


@query("p18_row_filters", "with " + V.V_RAW + " select patch_id, model_name, l_orderkey, l_linenumber from v_raw where status in ('ok') and lower(model_name) in ('m1', 'm3') and patch_id in (select p_partkey from part where lower(p_type) = 'economy')")
def row_filters(spark, sf):
    economy = V.table(spark, sf, "part").select(F.col("p_partkey").alias("patch_id"), "p_type")
    kept = N.row_filter(economy, ignore_case={"p_type": ["economy"]})
    df = N.row_filter(V.eval_raw(spark, sf), {"status": ["ok"]}, {"model_name": ["M1", "M3"]}, {"patch_id": kept})
    return df.select("patch_id", "model_name", "l_orderkey", "l_linenumber")


@query("p19_number_or_null", "select conv_id, turn, try_cast(left(text, 3) as double) as v, try_cast(cast(turn as varchar) as double) as t from conversations")
def number_or_null(spark, sf):
    return V.table(spark, sf, "conversations").select("conv_id", "turn", X.number_or_null(F.left("text", F.lit(3))).alias("v"), X.number_or_null(F.col("turn").cast("string")).alias("t"))


@query(
    "p20_integer_check",
    "select cast(count(*) filter (where l_quantity / 2 <> floor(l_quantity / 2)) as bigint) as n_bad, cast(sum(case when l_quantity / 2 = floor(l_quantity / 2) then l_quantity / 2 end) as bigint) as total from lineitem",
)
def integer_check(spark, sf):
    half = F.col("l_quantity") / 2
    return V.table(spark, sf, "lineitem").agg(F.count_if(X.not_integer(half)).alias("n_bad"), F.sum(X.integer_or_null(half)).alias("total"))


def _names(spark, sf):
    k, j = F.col("l_orderkey").cast("string"), F.col("l_suppkey").cast("string")
    form = F.col("l_orderkey") % 7
    cat = F.concat
    name = (
        F.when(form == 0, cat(k, F.lit("_"), j, F.lit(".png"))).when(form == 1, cat(k, F.lit("x_"), j, F.lit("y.png"))).when(form == 2, cat(F.lit("X"), k, F.lit("_y"), j, F.lit(".tif")))
        .when(form == 3, cat(F.lit("row"), k, F.lit("-col"), j, F.lit(".png"))).when(form == 4, cat(F.lit("c"), k, F.lit("_r"), j)).when(form == 5, cat(F.lit("a_"), k, F.lit("x-"), j, F.lit("y.viz_71.png")))
        .otherwise(cat(F.lit("tile"), k, F.lit(".png")))
    )
    return V.table(spark, sf, "lineitem").select("l_orderkey", "l_suppkey", name.alias("n")).distinct()


_N = """with n as (select distinct l_orderkey, l_suppkey, case l_orderkey % 7 when 0 then concat(l_orderkey, '_', l_suppkey, '.png') when 1 then concat(l_orderkey, 'x_', l_suppkey, 'y.png') when 2 then concat('X', l_orderkey, '_y', l_suppkey, '.tif')
 when 3 then concat('row', l_orderkey, '-col', l_suppkey, '.png') when 4 then concat('c', l_orderkey, '_r', l_suppkey) when 5 then concat('a_', l_orderkey, 'x-', l_suppkey, 'y.viz_71.png') else concat('tile', l_orderkey, '.png') end as n from lineitem)"""


@query("p21_tile_key", _N + " select n, case when l_orderkey % 7 < 5 then l_orderkey end as a, case when l_orderkey % 7 < 5 then l_suppkey end as b from n")
def tile_key(spark, sf):
    return _names(spark, sf).withColumn("k", K.tile_key("n")).select("n", "k.a", "k.b")


@query(
    "p21_coord_and_count",
    _N + " select n, case when l_orderkey % 7 in (1, 5) then concat(l_orderkey, 'x_', l_suppkey, 'y') end as coord_key, case when l_orderkey % 7 = 5 then 71::bigint end as n_cells, case when l_orderkey % 7 in (1, 5) then l_orderkey end as x, case when l_orderkey % 7 in (1, 5) then l_suppkey end as y from n",
)
def coord_and_count(spark, sf):
    df = _names(spark, sf).withColumns({"c": K.coord_and_count("n"), "p": K.xy_in_name("n")})
    return df.select("n", "c.coord_key", "c.n_cells", "p.x", "p.y")


@query("p22_source_label", "select p_partkey, case lower(split_part(p_name, ' ', 1)) when 'small' then 'Small things' when 'red' then 'Red things' else lower(split_part(p_name, ' ', 1)) end as source from part")
def source_label(spark, sf):
    df = V.table(spark, sf, "part").withColumn("id", F.replace("p_name", F.lit(" "), F.lit("_")))
    return df.select("p_partkey", K.source_prefix("id", {"small": "Small things", "red": "Red things"}).alias("source"))


@query("p26_case_pick", "with " + V.V_MANIFEST + " select patch_id, slide_id, foreground_fraction from v_manifest where foreground_fraction > 0.5 and dataset = 'ECONOMY' order by foreground_fraction desc, patch_id limit 1")
def case_pick(spark, sf):
    return N.pick_case(V.manifest(spark, sf), "foreground_fraction > 0.5 and dataset = 'ECONOMY'", [F.desc("foreground_fraction"), F.asc("patch_id")]).select("patch_id", "slide_id", "foreground_fraction")


@query("p27_root_from_tail", _B + "case when p_partkey % 6 = 2 then '/data/run' end as root from v_base")
def root_from_tail(spark, sf):
    tail = F.concat(F.lit("images/"), F.col("p_partkey").cast("string"), F.lit(".v2.tif"))
    return _refs(spark, sf).select("p_partkey", K.root_from_tail("ref", tail).alias("root"))


@query("p30_row_index", "select o_orderkey, row_number() over (order by o_orderdate, o_orderkey) - 1 as input_row_index from orders")
def row_index(spark, sf):
    return N.dense_row_index(V.table(spark, sf, "orders"), ["o_orderdate", "o_orderkey"], "input_row_index").select("o_orderkey", "input_row_index")


@query("p30_file_row_index", "select count(*) as n, min(p_partkey) as lo, max(p_partkey) as hi, cast(0 as bigint) as first_index, count(*) - 1 as last_index, count(*) as n_distinct from part")
def file_row_index(spark, sf):
    df = N.file_row_index(spark, f"{sf}/part.parquet", "input_row_index")
    return df.agg(
        F.count(F.lit(1)).alias("n"), F.min("p_partkey").alias("lo"), F.max("p_partkey").alias("hi"), F.min("input_row_index").alias("first_index"),
        F.max("input_row_index").alias("last_index"), F.count_distinct("input_row_index").alias("n_distinct"),
    )


@query("p31_embedding_id", _B + "case when p_partkey % 3 = 0 then regexp_replace(name, ' ', '_', 'g') else concat(coalesce(nullif(regexp_replace(stem, '^_+|_+$', '', 'g'), ''), 'row'), '__row', lpad(cast(p_partkey as varchar), 7, '0')) end as eid from v_base")
def embedding_id(spark, sf):
    df = _refs(spark, sf).withColumn("id", F.when(F.col("p_partkey") % 3 == 0, F.col("name")).otherwise(" "))
    return df.select("p_partkey", K.embedding_id("id", "ref", "p_partkey").alias("eid"))


# ---- scalar rules ----

_L = V.V_MANIFEST + ", q as (select quantile_cont(mean_area, 0.25) as lo, quantile_cont(mean_area, 0.75) as hi from v_manifest)"


@query("x01_safe_divide", rounded_sql("with " + V.V_COMP + "\n--body\nselect sample_id, case when count_total - 8 > 0 then epithelial / (count_total - 8) else 0 end as ratio from v_comp", "ratio"))
def safe_divide(spark, sf):
    return rounded(V.composition(spark, sf).select("sample_id", X.safe_divide("epithelial", F.col("count_total") - 8).alias("ratio")))


@query("x02_ordinal_label", "with " + V.V_MANIFEST + " select patch_id, case when foreground_fraction <= 0.3 then 'hard' when foreground_fraction <= 0.7 then 'medium' else 'easy' end as label from v_manifest")
def ordinal_label(spark, sf):
    return V.manifest(spark, sf).select("patch_id", X.ordinal_label("foreground_fraction", [0.3, 0.7], ["hard", "medium", "easy"]).alias("label"))


def _level_sql(lo, mid, hi):
    return f"with {_L} select patch_id, case when patch_id % 9 = 0 then 'Missing' when mean_area >= q.hi then '{hi}' when mean_area <= q.lo then '{lo}' else '{mid}' end as level from v_manifest, (select quantile_cont(mean_area, 0.25) as lo, quantile_cont(mean_area, 0.75) as hi from v_manifest where patch_id % 9 > 0) q"


@query("x03_level_label", _level_sql("low", "mid", "high"))
def level_label(spark, sf):
    df = V.manifest(spark, sf).withColumn("mean_area", F.when(F.col("patch_id") % 9 > 0, F.col("mean_area")))
    return N.add_levels(df, "mean_area", "level").select("patch_id", "level")


@query("x04_difficulty_tier", _level_sql("hard", "medium", "easy"))
def difficulty_tier(spark, sf):
    df = V.manifest(spark, sf).withColumn("mean_area", F.when(F.col("patch_id") % 9 > 0, F.col("mean_area")))
    return N.add_levels(df, "mean_area", "level", ("hard", "medium", "easy", "Missing")).select("patch_id", "level")


@query("x05_failure_flag", "with " + V.V_MANIFEST + " select patch_id, cast(mean_area < (select median(mean_area) from v_manifest where patch_id % 5 > 0) as int) as failed from v_manifest")
def failure_flag(spark, sf):
    df = V.manifest(spark, sf)
    return df.select("patch_id", X.failure_flag("mean_area", N.train_median(df.where("patch_id % 5 > 0"), "mean_area")).alias("failed"))


@query("x06_class_fractions", rounded_sql("with " + V.V_LABEL + "\n--body\nselect sample_id, " + ", ".join(f"case when count_total > 0 then {c} / count_total end as fraction_{c}" for c in V.CLASSES) + " from v_label", " ".join(f"fraction_{c}" for c in V.CLASSES)))
def class_fractions(spark, sf):
    return rounded(V.composition(spark, sf).select("sample_id", *[X.fraction_of(c, "count_total").alias(f"fraction_{c}") for c in V.CLASSES]))


@query("x07_dominant_class", rounded_sql("with " + V.V_LABEL + "\n--body\nselect sample_id, dominant_class, dominant_fraction from v_label", "dominant_fraction"))
def dominant_class(spark, sf):
    return rounded(V.composition_labels(spark, sf).select("sample_id", "dominant_class", "dominant_fraction"))


@query("x08_richness_label", "with " + V.V_LABEL + " select sample_id, richness_label from v_label")
def richness_label(spark, sf):
    return V.composition_labels(spark, sf).select("sample_id", "richness_label")


_DEF = {"d_rq": "instance_rq", "d_sq": "instance_sq", "d_pr": "pixel_precision", "d_re": "pixel_recall"}
_X09 = V.V_OK + """, d as (select patch_id, model_name, 1 - instance_rq as d_rq, 1 - instance_sq as d_sq, 1 - pixel_precision as d_pr, 1 - pixel_recall as d_re from v_ok),
 m as (select *, list_reverse_sort([d_rq, d_sq, d_pr, d_re])[1] as top, list_reverse_sort([d_rq, d_sq, d_pr, d_re])[2] as second from d),
 f as (select patch_id, model_name, d_rq, d_sq, case when top - second >= 0.1 then case top when d_rq then 'detection' when d_sq then 'shape' when d_pr then 'oversegmentation' else 'undersegmentation' end end as mode from m)"""
_MODE = {"d_rq": "detection", "d_sq": "shape", "d_pr": "oversegmentation", "d_re": "undersegmentation"}


def _modes(spark, sf):
    d = V.eval_ok(spark, sf).withColumns({k: 1 - F.col(v) for k, v in _DEF.items()})
    return d.withColumn("mode", X.failure_mode(_MODE, 0.1)).select("patch_id", "model_name", *_DEF, "mode")


@query("x09_failure_mode", "with " + _X09 + " select patch_id, model_name, mode from f")
def failure_mode(spark, sf):
    return _modes(spark, sf).select("patch_id", "model_name", "mode")


@query(
    "x10_hard_filter",
    "with " + _X09 + """, h as (select *, patch_id % 5 > 0 as train from f where d_sq <= (select quantile_cont(d_sq, 0.4) from f where patch_id % 5 > 0)),
 c as (select mode from h where train and mode is not null group by 1 having count(*) >= 60) select patch_id, model_name, mode, mode is not null and mode in (select mode from c) as retained from h""",
)
def hard_filter(spark, sf):
    return N.hard_rows(_modes(spark, sf).withColumn("train", F.col("patch_id") % 5 > 0), "d_sq", "mode", "train", 0.4, 60).select("patch_id", "model_name", "mode", "retained")


@query(
    "x11_row_statistics",
    rounded_sql(
        "with " + V.V_WIDE + "\n--body\nselect patch_id, consensus_pq as med, mean_pq as avg, list_stddev_samp([m0, m1, m2, m3]) as sd, greatest(m0, m1, m2, m3) as top, case greatest(m0, m1, m2, m3) when m0 then 'm0' when m1 then 'm1' when m2 then 'm2' else 'm3' end as arg_top from v_wide",
        "med avg sd top",
    ),
)
def row_statistics(spark, sf):
    w = V.wide_patches(spark, sf)
    return rounded(w.select("patch_id", F.col("consensus_pq").alias("med"), F.col("mean_pq").alias("avg"), X.row_std(V.MODELS).alias("sd"), X.at_max(V.MODELS)[0].alias("top"), X.first_at_max(V.MODELS).alias("arg_top")))


@query("x17_json_row", "select p_partkey, concat('{\"p_partkey\":', p_partkey, ',\"p_type\":\"', p_type, '\",\"v\":', case when p_size % 3 = 0 then 'null' else concat(p_size, '.0') end, '}') as j from part")
def json_row(spark, sf):
    bad = F.when(F.col("p_size") % 2 == 0, F.lit(float("nan"))).otherwise(F.lit(float("inf")))
    df = V.table(spark, sf, "part").withColumn("v", F.when(F.col("p_size") % 3 == 0, bad).otherwise(F.col("p_size").cast("double")))
    return df.select("p_partkey", X.json_row(["p_partkey", "p_type", "v"], ["v"]).alias("j"))


# ---- order, sampling, sets ----


@query("t01_mixed_sort", "with " + V.V_MANIFEST + " select patch_id, slide_id, foreground_fraction, cast(row_number() over (order by foreground_fraction desc, slide_id, patch_id) as bigint) as place from v_manifest")
def mixed_sort(spark, sf):
    df = V.manifest(spark, sf).withColumn("neg", -F.col("foreground_fraction"))
    out = N.dense_row_index(df, ["neg", "slide_id", "patch_id"], "place").withColumn("place", F.col("place") + 1)
    return out.select("patch_id", "slide_id", "foreground_fraction", "place").orderBy("place")


@query("t02_first_rows", "select o_orderkey, o_totalprice from orders order by o_totalprice desc, o_orderkey limit 100")
def first_rows(spark, sf):
    return N.first_rows(V.table(spark, sf, "orders").select("o_orderkey", "o_totalprice"), [F.desc("o_totalprice"), F.asc("o_orderkey")], 100)


@query("t03_seeded_sample")
def seeded_sample(spark, sf):
    return N.seeded_sample(V.table(spark, sf, "events").select("event_id", "user_id"), ["event_id"], 500, 42)


@query("t04_sample_per_group")
def sample_per_group(spark, sf):
    return N.seeded_sample_per_group(V.table(spark, sf, "events").select("event_id", "user_id"), ["user_id"], ["event_id"], 3, 42)


@query("t04_sample_sizes", "select user_id, least(count(*), 3) as n from events group by 1")
def sample_sizes(spark, sf):
    s = N.seeded_sample_per_group(V.table(spark, sf, "events"), ["user_id"], ["event_id"], 3, 42)
    return s.groupBy("user_id").agg(F.count(F.lit(1)).alias("n"))


@query("t05_seeded_shuffle")
def seeded_shuffle(spark, sf):
    return N.seeded_shuffle(V.table(spark, sf, "part").select("p_partkey", "p_brand"), ["p_partkey"], 42)


@query("u01_union", "with " + V.V_RAW + ", " + V.V_MANIFEST + " select patch_id, model_name, null::varchar as slide_id from v_raw union all select patch_id, null, slide_id from v_manifest")
def union(spark, sf):
    return N.union_frames([V.eval_raw(spark, sf).select("patch_id", "model_name"), V.manifest(spark, sf).select("patch_id", "slide_id")])


@query("u02_key_intersection", "with " + V.V_OK + " select patch_id from v_ok where model_name = 'm0' intersect select patch_id from v_ok where model_name = 'm1'")
def key_intersection(spark, sf):
    ok = V.eval_ok(spark, sf)
    return ok.where("model_name = 'm0'").select("patch_id").intersect(ok.where("model_name = 'm1'").select("patch_id"))


@query("u03_key_difference", "with " + V.V_OK + " select patch_id from v_ok where model_name = 'm0' except select patch_id from v_ok where model_name = 'm1'")
def key_difference(spark, sf):
    ok = V.eval_ok(spark, sf)
    return ok.where("model_name = 'm0'").select("patch_id").subtract(ok.where("model_name = 'm1'").select("patch_id"))


@query("u04_distinct_keys", "with " + V.V_RAW + " select distinct patch_id, status from v_raw")
def distinct_keys(spark, sf):
    return V.eval_raw(spark, sf).select("patch_id", "status").distinct()
