"""Validated joins, sources and sinks."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from ..functions import keys as K
from ..operators import joins as J, manifests as N, reports as P
from ..session import shared_folder
from ..sources import documents as D, tables as T
from . import views as V
from .registry import query, rounded, rounded_sql


def _scratch(spark) -> str:
    return f"{shared_folder(spark).rstrip('/')}/tesserae-{uuid.uuid4().hex}"


# m0 misses patches and some keys are unknown to the manifest, so that coverage is below one.
def _facts(spark, sf):
    return V.eval_ok(spark, sf).where("not (model_name = 'm0' and instance_sq < 0.3)").withColumn("patch_id", F.col("patch_id") + F.when(F.col("instance_sq") == 1, 1_000_000_000).otherwise(0))


_F = V.V_OK + ", " + V.V_MANIFEST + """, fx as (select * replace (patch_id + case when instance_sq = 1 then 1000000000 else 0 end as patch_id) from v_ok where not (model_name = 'm0' and instance_sq < 0.3)),
 ms as (select distinct model_name from fx), j as (select m.*, model_name, instance_pq, pixel_dice, instance_pq is not null as matched from v_manifest m cross join ms left join (select patch_id, model_name, instance_pq, pixel_dice from fx) using (patch_id, model_name))"""


def _joined(spark, sf):
    return J.attach_targets(V.manifest(spark, sf), _facts(spark, sf), "patch_id", "model_name", ["instance_pq", "pixel_dice"])


@query("j01_attach_targets", rounded_sql("with " + _F + "\n--body\nselect patch_id, slide_id, model_name, instance_pq, pixel_dice, matched from j", "instance_pq pixel_dice"))
def attach_targets(spark, sf):
    return rounded(_joined(spark, sf).select("patch_id", "slide_id", "model_name", "instance_pq", "pixel_dice", "matched"))


@query(
    "j01_target_coverage",
    rounded_sql(
        "with " + _F + """
--body
select model_name, count(*) as manifest_rows, count(*) filter (where matched) as matched_rows, count(*) filter (where matched) / count(*) as coverage, count(*) filter (where not matched) as unmatched_manifest,
 (select count(distinct patch_id) from fx where fx.model_name = j.model_name and patch_id not in (select patch_id from v_manifest)) as unmatched_eval from j group by 1""",
        "coverage",
    ),
)
def target_coverage(spark, sf):
    return rounded(J.target_coverage(_joined(spark, sf), _facts(spark, sf), V.manifest(spark, sf), "patch_id", "model_name"))


def _named_facts(spark, sf):
    k = F.col("patch_id").cast("string")
    return _facts(spark, sf).select(
        F.when(F.col("patch_id") % 2 == 0, k).alias("image_id"), F.concat(F.lit("out/"), k, F.lit("_mask.png")).alias("match_key"),
        F.concat(F.lit("pred/"), F.lit("x"), k, F.lit(".tif")).alias("pred_path"), "model_name", "instance_pq",
    )


def _variants_sql():
    parts, pos = [], 0
    for c in ("image_id", "match_key", "pred_path"):
        for v, e in {
            "raw": "{c}", "basename": "regexp_extract({c}, '[^/]*$')", "basename_stem": "regexp_replace(regexp_extract({c}, '[^/]*$'), '\\.[^.]+$', '')",
            "basename_strip_role": "regexp_replace(regexp_replace(regexp_extract({c}, '[^/]*$'), '\\.[^.]+$', ''), '_(image|mask|class_labels)$', '')",
        }.items():
            parts.append(f"select {pos} as position, '{c}' as join_column, '{v}' as variant, {e.format(c=c)} as k from nf")
            pos += 1
    return " union all ".join(parts)


@query(
    "j02_join_key_scores",
    "with " + _F + ", nf as (select case when patch_id % 2 = 0 then cast(patch_id as varchar) end as image_id, concat('out/', patch_id, '_mask.png') as match_key, concat('pred/x', patch_id, '.tif') as pred_path from fx), st as (" + _variants_sql() + ") select cast(position as int) as position, join_column, variant, count(distinct k) filter (where k in (select cast(patch_id as varchar) from v_manifest)) as n_matched, count(distinct k) as n_keys from st where k <> '' group by 1, 2, 3",
)
def join_key_scores(spark, sf):
    return J.score_join_keys(_named_facts(spark, sf), V.manifest(spark, sf), "patch_id", ["patch_id", "image_id", "match_key", "pred_path"])


def _left(spark, sf):
    return V.table(spark, sf, "part").where("p_size > 7").select("p_partkey", F.when(F.col("p_type") != "ECONOMY", F.col("p_size")).alias("size"), F.col("p_brand").alias("brand"))


def _right(spark, sf):
    return V.table(spark, sf, "part").where("p_size < 40").select("p_partkey", (F.col("p_size") + (F.col("p_brand") == "Brand#3").cast("int")).alias("size"), F.col("p_type").alias("type"))


_LR = "with l as (select p_partkey, case when p_type <> 'ECONOMY' then p_size end as size, p_brand as brand from part where p_size > 7), r as (select p_partkey, p_size + case when p_brand = 'Brand#3' then 1 else 0 end as size, p_type as type from part where p_size < 40) "


@query("j03_merge_coalesced", _LR + "select p_partkey, coalesce(l.size, r.size) as size, brand, r.size as right_size, type from l full join r using (p_partkey)")
def merge_coalesced(spark, sf):
    return J.merge_coalesced(_left(spark, sf), _right(spark, sf), ["p_partkey"], "full_outer", keep_both=["size"])


@query("j04_duplicate_keys", "with " + V.V_RAW + " select patch_id, model_name, count(*) as n_rows from v_raw group by 1, 2 having count(*) > 1")
def duplicate_keys(spark, sf):
    return J.duplicate_keys(V.eval_raw(spark, sf), ["patch_id", "model_name"])


@query("j05_unmatched_counts", _LR + "select count(*) filter (where rk is null) as left_only, count(*) filter (where lk is null) as right_only, count(*) filter (where lk is not null and rk is not null) as both from (select l.p_partkey as lk, r.p_partkey as rk from l full join r on l.p_partkey = r.p_partkey)")
def unmatched_counts(spark, sf):
    return J.unmatched_counts(_left(spark, sf), _right(spark, sf), ["p_partkey"])


@query("j06_shared_mismatches", _LR + "select 'size' as \"column\", count(*) filter (where l.size is distinct from r.size) as n_mismatched from l join r using (p_partkey)")
def shared_mismatches(spark, sf):
    return J.shared_column_mismatches(_left(spark, sf), _right(spark, sf), ["p_partkey"], ["size"])


@query("j07_matched_set", "with " + V.V_MATCHED + " select distinct patch_id from v_matched")
def matched_set(spark, sf):
    ok = V.eval_ok(spark, sf)
    return J.matched_keys(ok, "patch_id", "model_name", J.model_count(ok, "model_name"))


@query("j08_wide_models", rounded_sql("with " + V.V_WIDE + "\n--body\nselect patch_id, m0, m1, m2, m3, consensus_pq, mean_pq from v_wide", "m0 m1 m2 m3 consensus_pq mean_pq"))
def wide_models(spark, sf):
    return rounded(V.wide_patches(spark, sf).select("patch_id", *V.MODELS, "consensus_pq", "mean_pq"))


_J09 = [f"{m}__{k}" for m in ("instance_pq", "pixel_dice") for k in V.MODELS]


@query(
    "j09_matched_patch_table",
    rounded_sql(
        "with " + V.V_MATCHED + ", " + V.V_MANIFEST + "\n--body\nselect w.*, slide_id from (select patch_id, " + ", ".join(f"max({c.split('__')[0]}) filter (where model_name = '{c.split('__')[1]}') as {c}" for c in _J09)
        + ", median(instance_pq) as pq_median, avg(instance_pq) as pq_mean, stddev_samp(instance_pq) as pq_std, max(instance_pq) filter (where model_name = 'm0') - max(instance_pq) filter (where model_name = 'm1') as m0_minus_m1 from v_matched group by patch_id) w left join v_manifest using (patch_id)",
        " ".join([*_J09, "pq_median", "pq_mean", "pq_std", "m0_minus_m1"]),
    ),
)
def matched_patch_table(spark, sf):
    from ..functions import scalars as X

    w = P.wide_by_model(V.eval_ok(spark, sf), "patch_id", "model_name", V.MODELS, ["instance_pq", "pixel_dice"])
    pq = [f"instance_pq__{m}" for m in V.MODELS]
    w = w.withColumns({"pq_median": X.row_median(pq), "pq_mean": X.row_mean(pq), "pq_std": X.row_std(pq), "m0_minus_m1": F.col(pq[0]) - F.col(pq[1])})
    return rounded(w.join(V.manifest(spark, sf).select("patch_id", "slide_id"), "patch_id", "left"))


@query(
    "j10_metric_backfill",
    rounded_sql(
        "with " + V.V_OK + "\n--body\nselect a.patch_id, a.model_name, coalesce(case when a.instance_rq > 0.5 then a.instance_sq end, b.instance_sq) as instance_sq, b.instance_rq from v_ok a left join (select patch_id, model_name, instance_sq, instance_rq from v_ok where pixel_recall > 0.3) b using (patch_id, model_name)",
        "instance_sq instance_rq",
    ),
)
def metric_backfill(spark, sf):
    ok = V.eval_ok(spark, sf)
    table = ok.select("patch_id", "model_name", F.when(F.col("instance_rq") > 0.5, F.col("instance_sq")).alias("instance_sq"))
    return rounded(J.fill_missing(table, ok.where("pixel_recall > 0.3").select("patch_id", "model_name", "instance_sq", "instance_rq"), ["patch_id", "model_name"]))


@query("j11_optional_source", _LR + "select p_partkey, coalesce(l.size, r.size) as size, brand, type from l left join r using (p_partkey)")
def optional_source(spark, sf):
    return J.fill_missing(_left(spark, sf), _right(spark, sf), ["p_partkey"])


@query(
    "j12_metric_pivots",
    rounded_sql(
        "with " + V.V_OK + ", " + V.V_MANIFEST + "\n--body\nselect m.patch_id, slide_id, " + ", ".join(f"{x}_median" for x in ("instance_pq", "instance_sq")) + ", n as instance_pq_model_count from v_manifest m left join (select patch_id, median(instance_pq) as instance_pq_median, median(instance_sq) as instance_sq_median, count(instance_pq) as n from v_ok group by 1) using (patch_id)",
        "instance_pq_median instance_sq_median",
    ),
)
def metric_pivots(spark, sf):
    piv = P.consensus_pivot(V.eval_ok(spark, sf), "patch_id", "model_name", V.MODELS, ["instance_pq", "instance_sq"])
    return rounded(V.manifest(spark, sf).select("patch_id", "slide_id").join(piv, "patch_id", "left").select("patch_id", "slide_id", "instance_pq_median", "instance_sq_median", "instance_pq_model_count"))


@query(
    "j15_cross_model_alignment",
    "with " + V.V_OK + ", c as (select *, case when pixel_recall > 0.3 or model_name <> 'm1' then cast(round(instance_sq * 50) as bigint) end as n from v_ok) select patch_id, list_sort(list(distinct model_name)) as models, count(distinct model_name) as n_models, coalesce(max(n) filter (where model_name = 'm1'), max(n) filter (where model_name = 'm3'), max(n) filter (where model_name = 'm0')) as filter_count from c group by 1",
)
def cross_model_alignment(spark, sf):
    n = F.round(F.col("instance_sq") * 50).cast("bigint")
    df = V.eval_ok(spark, sf).withColumn("n", F.when((F.col("pixel_recall") > 0.3) | (F.col("model_name") != "m1"), n))
    return J.align_across_models(df, ["patch_id"], "model_name", "n", ["m1", "m3", "m0"])


@query(
    "j16_comparison_group",
    "with " + V.V_RAW + ", k as (select *, case when status = 'ok' then concat('o=', l_orderkey) else concat('p=', patch_id) end as mk from v_raw), a as (select distinct mk from k where instance_sq > 0.97) select patch_id, model_name, l_orderkey, l_linenumber from (select *, row_number() over (partition by mk, model_name order by l_orderkey, l_linenumber, l_suppkey, l_extendedprice, patch_id) as rn from k where mk in (select mk from a)) where rn = 1",
)
def comparison_group(spark, sf):
    df = V.eval_raw(spark, sf).withColumns({"o": F.when(F.col("status") == "ok", F.col("l_orderkey").cast("string")), "p": F.col("patch_id").cast("string")})
    return J.comparison_group(df, F.col("instance_sq") > 0.97, ["o", "p"], "model_name", [*V.ORDER, "patch_id"]).select("patch_id", "model_name", "l_orderkey", "l_linenumber")


def _listing(spark, sf):
    return V.manifest(spark, sf).where("foreground_fraction > 0.25").select(
        F.concat(F.when(F.col("dataset") == "ECONOMY", F.lit("/a/")).otherwise(F.lit("/b/")), F.col("image_path")).alias("path")
    )


@query(
    "j17_resolve_paths",
    "with " + V.V_MANIFEST + " select patch_id, case when foreground_fraction > 0.25 then concat(case when dataset = 'ECONOMY' then '/a/' else '/b/' end, image_path) end as resolved_path, case when not foreground_fraction > 0.25 then 'path_resolution' end as failure_stage from v_manifest",
)
def resolve_paths(spark, sf):
    m = V.manifest(spark, sf).select("patch_id", "image_path")
    return J.resolve_paths(m, "image_path", ["patch_id"], ["/a", "/b/"], _listing(spark, sf)).drop("image_path")


@query(
    "j18_locate_prediction",
    "with " + V.V_MANIFEST + " select patch_id, case when foreground_fraction > 0.25 then concat(case when dataset = 'ECONOMY' then '/a/' else '/b/' end, image_path) end as located_path, case when not foreground_fraction > 0.25 then null when dataset = 'ECONOMY' then 'rule_a' else 'recorded' end as located_by from v_manifest",
)
def locate_prediction(spark, sf):
    m = V.manifest(spark, sf)
    rules = {"recorded": F.concat(F.lit("/b/"), F.col("image_path")), "rule_a": F.concat(F.lit("/a/samples/"), F.col("patch_id").cast("string"), F.lit("/"), F.col("patch_id").cast("string"), F.lit("_image.png"))}
    return J.locate_by_priority(m, ["patch_id"], rules, _listing(spark, sf))


@query(
    "j19_pair_by_stem",
    "with t as (select cast(p_partkey % 1500 as varchar) as stem from part where p_size > 12), p as (select cast(p_partkey % 1800 as varchar) as stem from part where p_size < 40), a as (select stem, count(*) n from t group by 1), b as (select stem, count(*) n from p group by 1) select stem, coalesce(a.n, 0) as n_truth, coalesce(b.n, 0) as n_pred, case when a.n > 1 then 'duplicate_ground_truth' when b.n > 1 then 'duplicate_prediction' when b.n is null then 'missing_prediction' when a.n is null then 'missing_ground_truth' else 'ok' end as status from a full join b using (stem)",
)
def pair_by_stem(spark, sf):
    part = V.table(spark, sf, "part")
    t = part.where("p_size > 12").select((F.col("p_partkey") % 1500).cast("string").alias("stem"))
    p = part.where("p_size < 40").select((F.col("p_partkey") % 1800).cast("string").alias("stem"))
    return J.pair_by_stem(t, p, "stem")


@query(
    "j20_add_missing_copies",
    "with b as (select p_partkey, case when p_size = 10 then 'kidney_only' else lower(p_type) end as folder from part union all select p_partkey, 'kidney_only' from part where p_size = 3) select * from b union all select p_partkey, 'kidney_only' from b where folder = 'economy' and p_partkey not in (select p_partkey from b where folder = 'kidney_only')",
)
def add_missing_copies(spark, sf):
    part = V.table(spark, sf, "part")
    b = part.select("p_partkey", F.when(F.col("p_size") == 10, "kidney_only").otherwise(F.lower("p_type")).alias("folder"))
    b = b.unionByName(part.where("p_size = 3").select("p_partkey", F.lit("kidney_only").alias("folder")))
    return J.add_missing_copies(b, F.col("folder") == "economy", ["p_partkey", "folder"], {"folder": F.lit("kidney_only")})


@query("j21_upsert", _LR + "select p_partkey, coalesce(r.size, l.size) as size, brand, type, case when l.p_partkey is null then 'update' when r.p_partkey is null then 'base' else 'both' end as origin from l full join r using (p_partkey)")
def upsert(spark, sf):
    return J.upsert(_left(spark, sf), _right(spark, sf), ["p_partkey"])


@query("j22_attach_report_columns", _LR + "select l.*, type from l left join r using (p_partkey)")
def attach_report_columns(spark, sf):
    r = _right(spark, sf).select("p_partkey", "type")
    J.require_unique(r, ["p_partkey"], "report columns")
    return J.fill_missing(_left(spark, sf), r, ["p_partkey"])


# ---- sources and sinks ----

_PART = "p_partkey bigint, p_name string, p_brand string, p_type string, p_size int, p_retailprice double"


@query("s01_read_csv", "select * from part")
def read_csv(spark, sf):
    path = f"{_scratch(spark)}/part.csv.gz"
    T.write_table(V.table(spark, sf, "part"), path)
    return T.read_table(spark, path, _PART)


@query("s02_write_parquet", "select * from orders")
def write_parquet(spark, sf):
    path = f"{_scratch(spark)}/orders.parquet"
    T.write_table(V.table(spark, sf, "orders"), path)
    return T.read_table(spark, path)


def _model_files(spark, sf, with_model=True):
    """One CSV file per model, named after it; m3's own model column is blank."""
    root = _scratch(spark)
    facts = V.eval_ok(spark, sf).select("patch_id", "status", "instance_pq", F.when(F.col("model_name") != "m3", F.col("model_name")).alias("model_name"), F.col("model_name").alias("_m"))
    for m in V.MODELS:
        T.write_table(facts.where(F.col("_m") == m).drop("_m"), f"{root}/{m}_evaluation.csv")
    return root


_EVAL = "patch_id bigint, status string, instance_pq double, model_name string"


@query("s03_discover_files", "select * from (values ('m0', 1), ('m1', 1), ('m2', 1), ('m3', 1)) t(model, n)")
def discover_files(spark, sf):
    root = _model_files(spark, sf)
    found = T.list_files(spark, root, "*.csv")
    first = found.select("path").limit(1).first()["path"]
    seen = T.first_seen_paths(found, [first])
    model = F.regexp_extract("path", r"([^/]+)_evaluation\.csv/", 1).alias("model")
    return seen.select("path", model).groupBy("model").agg((F.count_distinct("path") > 0).cast("int").alias("n"))


@query("s04_model_from_file", "select p_partkey, concat('model_', p_size) as model from part")
def model_from_file(spark, sf):
    f = F.concat(F.lit("eval/model_"), F.col("p_size").cast("string"), F.when(F.col("p_partkey") % 2 == 0, F.lit("_evaluation.csv")).otherwise(F.lit(".csv.gz")))
    return V.table(spark, sf, "part").select("p_partkey", K.model_name_from_file(f).alias("model"))


@query("s05_model_or_file", "with " + V.V_OK + " select patch_id, case when model_name = 'm3' then 'fallback' else model_name end as model_name from v_ok")
def model_or_file(spark, sf):
    df = V.eval_ok(spark, sf).withColumn("m", F.when(F.col("model_name") != "m3", F.col("model_name")).otherwise("  "))
    return df.select("patch_id", K.model_name_or_file("m", F.lit("fallback_evaluation.csv")).alias("model_name"))


@query("s06_load_evaluations", "with " + V.V_OK + " select model_name as model, count(*) as n_rows from v_ok group by 1")
def load_evaluations(spark, sf):
    root = _model_files(spark, sf)
    df, _ = T.load_evaluations(spark, [f"{root}/{m}_evaluation.csv" for m in V.MODELS], schema=_EVAL)
    return df.groupBy(F.col("model_name").alias("model")).agg(F.count(F.lit(1)).alias("n_rows"))


@query("s07_load_model_facts", rounded_sql("with " + V.V_OK + "\n--body\nselect cast(patch_id as varchar) as patch_id, model_name, instance_pq, pixel_dice from v_ok", "instance_pq pixel_dice"))
def load_model_facts(spark, sf):
    df = V.eval_ok(spark, sf).withColumn("image_id", F.concat(F.lit("x/"), F.col("patch_id").cast("string"), F.lit("_image.png")))
    return rounded(T.load_model_facts(df, "image_id", ["instance_pq", "pixel_dice"], ["patch_id", "model_name"]))


@query("s08_list_files", "select * from (values ('customer'), ('documents'), ('embeddings'), ('events'), ('labels'), ('lineitem'), ('nation'), ('orders'), ('pages'), ('part'), ('region'), ('supplier')) t(stem)")
def list_files(spark, sf):
    return T.list_tables(spark, sf, suffixes=[".PARQUET"], excluded=["bench", "conversations"]).select("stem")


@query("s08_list_written_files", "select o_orderstatus, count(*) as n_rows, cast(1 as boolean) as filled from orders where o_orderstatus <> 'P' group by 1")
def list_written_files(spark, sf):
    """Rows of every listed file, by the file's name; the folder of one status lies outside the listing."""
    root = f"{_scratch(spark)}/orders"
    orders = V.table(spark, sf, "orders")
    orders.where("o_orderstatus <> 'P'").write.partitionBy("o_orderstatus").parquet(f"{root}/kept")
    orders.where("o_orderstatus = 'P'").write.parquet(f"{root}/other")
    listed = T.list_files(spark, f"{root}/kept", "*.parquet", recursive=True, suffixes=[".PARQUET"]).select("path", "name", "length")
    held = spark.read.parquet(f"{root}/kept").groupBy(F.col("_metadata.file_name").alias("name"), F.element_at(F.split("_metadata.file_path", "/"), -2).alias("_folder")).agg(F.count(F.lit(1)).alias("n"))
    folder = F.element_at(F.split("path", "/"), -2)
    rows = listed.withColumn("_folder", folder).join(held, ["name", "_folder"], "left")
    return rows.groupBy(F.regexp_extract("_folder", "=(.*)", 1).alias("o_orderstatus")).agg(F.sum("n").alias("n_rows"), F.bool_and(F.col("length") > 0).alias("filled"))


@query("s09_manifest_records", "select p_partkey, case when p_partkey % 3 = 0 then concat('a/', p_partkey, '.PNG') else concat('b/', p_partkey, '.tif') end as image_ref from part where p_partkey % 3 <> 1 or p_partkey % 2 = 0")
def manifest_records(spark, sf):
    k = F.col("p_partkey").cast("string")
    df = V.table(spark, sf, "part").select(
        "p_partkey",
        F.when(F.col("p_partkey") % 3 == 0, F.concat(F.lit("a/"), k, F.lit(".PNG"))).otherwise(" ").alias("patch_path"),
        F.when((F.col("p_partkey") % 3 == 1) & (F.col("p_partkey") % 2 == 1), F.concat(F.lit("b/"), k, F.lit(".txt"))).otherwise(F.concat(F.lit("b/"), k, F.lit(".tif"))).alias("image_path"),
    )
    return T.manifest_records(df, ["image", "patch_path", "image_path"], [".png", ".tif"]).select("p_partkey", "image_ref")


@query("s11_pair_images_masks", "select cast(p_partkey as varchar) as pair_key, concat('i/', p_partkey, '_image.png') as image_path, case when p_partkey % 4 > 0 then concat('m/', p_partkey, case when p_partkey % 2 = 0 then '_MASK.png' else '_mask.tif' end) end as mask_path, case when p_partkey % 4 > 0 then 'ok' else 'missing_mask' end as status from part")
def pair_images_masks(spark, sf):
    k = F.col("p_partkey").cast("string")
    part = V.table(spark, sf, "part")

    def files(*exprs):
        df = part.select("p_partkey", F.explode(F.array_compact(F.array(*exprs))).alias("path"))
        return df.withColumns({"stem": K.stem("path"), "suffix": F.lower(F.regexp_extract("path", r"\.[^./]+$", 0))})

    images = files(F.concat(F.lit("i/"), k, F.lit("_image.tif")), F.concat(F.lit("i/"), k, F.lit("_image.png")))
    masks = files(
        F.when(F.col("p_partkey") % 4 > 0, F.concat(F.lit("m/"), k, F.lit("_mask.tif"))), F.when(F.col("p_partkey") % 4 == 2, F.concat(F.lit("m/"), k, F.lit("_MASK.png")))
    )
    return T.pair_images_and_masks(images, masks)


@query("s12_cell_rows", rounded_sql("select o_custkey, cast(n as int) as cell_ordinal, x as xmin, x / 2 as ymin, x + 5 as xmax, x / 2 + 7 as ymax from (select o_custkey, o_orderkey, o_totalprice as x, row_number() over (partition by o_custkey order by o_orderkey) - 1 as n from orders) where o_orderkey % 4 > 0", "xmin ymin xmax ymax"))
def cell_rows(spark, sf):
    x = F.col("o_totalprice")
    box = F.when(F.col("o_orderkey") % 4 > 0, F.array(F.array(x / 2, x), F.array(x / 2 + 7, x + 5)))
    cell = F.struct("o_orderkey", box.alias("bbox"), F.array(F.array(x, x)).alias("contour"))
    docs = V.table(spark, sf, "orders").groupBy("o_custkey").agg(F.array_sort(F.collect_list(cell)).alias("cells"))
    return rounded(D.cell_rows(docs, ["o_custkey"]).select("o_custkey", "cell_ordinal", "xmin", "ymin", "xmax", "ymax"))


@query("s12_read_cells_json", "select count(*) as n_cells, count(distinct o_custkey) as n_documents from orders where o_orderkey % 4 > 0")
def read_cells_json(spark, sf):
    x = F.col("o_totalprice")
    box = F.when(F.col("o_orderkey") % 4 > 0, F.array(F.array(x / 2, x), F.array(x / 2 + 7, x + 5)))
    cell = F.struct(box.alias("bbox"), F.array(F.array(x, x)).alias("contour"))
    path = f"{_scratch(spark)}/cells"
    # JSON lines: each line is one document of the same shape as a whole-file document.
    V.table(spark, sf, "orders").groupBy("o_custkey").agg(F.collect_list(cell).alias("cells")).select(F.struct(F.col("o_custkey").alias("patch_size")).alias("wsi_metadata"), "cells").write.json(path)
    docs = spark.read.schema(D.CELLS_SCHEMA).json(path).withColumn("document", F.col("wsi_metadata.patch_size"))
    return D.cell_rows(docs).agg(F.count(F.lit(1)).alias("n_cells"), F.count_distinct("document").alias("n_documents"))


@query("s13_flatten_artifacts", 'select event_id, cast(json_extract(props, \'$.k\') as int) as "props.k", event_type as "meta.type", concat(\'["\', event_type, \'"]\') as "meta.tags" from events')
def flatten_artifacts(spark, sf):
    df = V.table(spark, sf, "events").select(
        "event_id", F.from_json("props", "k int").alias("props"), F.struct(F.col("event_type").alias("type"), F.array("event_type").alias("tags")).alias("meta")
    )
    return D.flatten(df)


def _slides(spark, sf):
    """Customers as cells of slide files: one JSON document a file, of at most 500 customers of a nation."""
    path = f"{_scratch(spark)}/slides"
    x = F.col("c_acctbal").cast("double")
    box = F.when(F.col("c_custkey") % 5 > 0, F.array(F.array(x / 2, x), F.array(x / 2 + 7, x + 5)))
    cell = F.struct("c_custkey", box.alias("bbox"), F.array(F.array(x, x), F.array(x + 1, x)).alias("contour"))
    slide = F.struct(F.col("c_nationkey").alias("patch_size"), F.col("part").alias("orig_n_tiles_rows")).alias("wsi_metadata")
    # Tasks of this step are weighed by their files and not by bytes, so a given number of them is not drawn together.
    tasks = int(spark.conf.get("spark.sql.shuffle.partitions"))
    cells = V.table(spark, sf, "customer").withColumn("part", F.floor(F.col("c_custkey") / 500).cast("int")).repartition(tasks, "c_nationkey", "part")
    docs = cells.groupBy("c_nationkey", "part").agg(F.array_sort(F.collect_list(cell)).alias("cells"))
    docs = docs.select(F.to_json(F.struct(slide, "cells"), {"pretty": "true"}).alias("value"))
    # One record a file in one folder: a folder for each file would be made, listed and moved one by one. Tasks move
    # their files themselves; the folder is read only after the write, and a repeated task writes the same names.
    docs.write.option("maxRecordsPerFile", 1).option("mapreduce.fileoutputcommitter.algorithm.version", "2").text(path)
    return path


_SLIDES = """with c as (select c_nationkey, cast(c_custkey // 500 as int) as part, c_custkey, c_acctbal::double as x, row_number() over (partition by c_nationkey, c_custkey // 500 order by c_custkey) - 1 as cell_ordinal from customer)"""


@query("s12_whole_files", rounded_sql(_SLIDES + "\n--body\nselect c_nationkey, part, cast(cell_ordinal as int) as cell_ordinal, x as xmin, x / 2 as ymin, x + 5 as xmax, x / 2 + 7 as ymax, cast(o as int) as ordinal, x + o as px from c, (values (0), (1)) v(o) where c_custkey % 5 > 0", "xmin ymin xmax ymax px"))
def whole_files(spark, sf):
    docs = D.read_cells(spark, _slides(spark, sf)).select("cells", F.col("wsi_metadata.patch_size").alias("c_nationkey"), F.col("wsi_metadata.orig_n_tiles_rows").alias("part"))
    cells = D.cell_rows(docs, ["c_nationkey", "part"])
    points = D.contour_points(cells, ["c_nationkey", "part", "cell_ordinal", "xmin", "ymin", "xmax", "ymax"])
    return rounded(points.select("c_nationkey", "part", "cell_ordinal", "xmin", "ymin", "xmax", "ymax", "ordinal", F.col("x").alias("px")))


@query("s12_variant_rows", rounded_sql(_SLIDES + "\n--body\nselect c_nationkey, part, cast(cell_ordinal as int) as ordinal, c_custkey as cell, case when c_custkey % 5 > 0 then x end as xmin, x + 1 as px from c", "xmin px"))
def variant_rows(spark, sf):
    docs = D.read_variants(spark, _slides(spark, sf))
    docs = docs.withColumns({"c_nationkey": F.try_variant_get("value", "$.wsi_metadata.patch_size", "int"), "part": F.try_variant_get("value", "$.wsi_metadata.orig_n_tiles_rows", "int")})
    fields = {"cell": "$.c_custkey bigint", "xmin": "$.bbox[0][1] double", "px": "$.contour[1][0] double"}
    return rounded(D.variant_rows(docs, "$.cells", fields, ["c_nationkey", "part"]))


@query("s13_flatten_variants", "select event_id, case when event_type <> 'error' then user_id end as \"run.user\", case when event_type = 'error' then 'failed' end as \"run.state.text\", case when event_type = 'error' then concat('[', event_id, ',1]') end as \"run.state.codes\" from events")
def flatten_variants(spark, sf):
    e = V.table(spark, sf, "events")
    bad = F.col("event_type") == "error"
    state = F.when(bad, F.struct(F.lit("failed").alias("text"), F.array(F.col("event_id").cast("bigint"), F.lit(1).cast("bigint")).alias("codes")))
    text = F.to_json(F.struct(F.struct(F.when(~bad, F.col("user_id")).alias("user"), state.alias("state")).alias("run")))
    return D.flatten_variants(e.select("event_id", F.try_parse_json(text).alias("value")), ["event_id"])


def _parts(spark, sf):
    e = V.table(spark, sf, "embeddings").withColumn("input_row_index", F.col("vec_id"))
    return D.part_rows(e, "input_row_index", 64, "emb")


@query("s14_fetch_vectors", "select vec_id as request, case when vec_id % 10 = 3 then 'missing_vector' when vec_id % 10 = 4 then 'bad_offset' end as stage, case when vec_id % 10 not in (3, 4) then round(embedding[1]::double, 6) end as first_value from embeddings")
def fetch_vectors(spark, sf):
    req = _parts(spark, sf).select(
        F.col("vec_id").alias("request"), F.when(F.col("vec_id") % 10 == 3, "emb/none.parquet").otherwise(F.col("embedding_path")).alias("embedding_path"),
        F.when(F.col("vec_id") % 10 == 4, -1).otherwise(F.col("embedding_row_offset")).alias("embedding_row_offset"),
    )
    got = D.fetch_vectors(req, _parts(spark, sf), 64)
    return got.select("request", "stage", F.round(F.get("embedding", F.lit(0)).cast("double"), 6).alias("first_value"))


def _written(spark, sf):
    folder = f"{_scratch(spark)}/vectors"
    return D.write_vector_parts(V.table(spark, sf, "embeddings").withColumn("embedding", F.col("embedding").cast("array<float>")), ["vec_id"], 128, folder), folder


_PLACED = "(select *, row_number() over (order by vec_id) - 1 as k, count(*) over () as n from embeddings)"


@query("s14_fetch_written_vectors", "select vec_id as request, case when vec_id % 10 = 3 then 'missing_part' when vec_id % 10 = 4 then 'bad_offset' when vec_id % 10 = 5 then 'offset_out_of_range' end as stage, case when vec_id % 10 not in (3, 4, 5) then round(embedding[1]::float::double, 5) end as first_value, case when vec_id % 10 not in (3, 4, 5) then round(embedding[64]::float::double, 5) end as last_value from embeddings")
def fetch_written_vectors(spark, sf):
    book, folder = _written(spark, sf)
    digit = F.col("vec_id") % 10
    asked = book.select(
        F.col("vec_id").alias("request"), F.when(digit == 3, F.lit(f"{folder}/part=999999")).otherwise(F.col("embedding_path")).alias("embedding_path"),
        F.when(digit == 4, -1).when(digit == 5, 128).otherwise(F.col("embedding_row_offset")).alias("embedding_row_offset"),
    )
    value = lambda i: F.round(F.get("embedding", F.lit(i)).cast("double"), 5)
    return D.fetch_written_vectors(asked, folder, 64).select("request", "stage", value(0).alias("first_value"), value(63).alias("last_value"))


@query("s16_write_vector_parts", f"select vec_id, label, concat('part=', k // 128) as part, cast(k % 128 as int) as embedding_row_offset, cast(len(embedding) as int) as embedding_dim, 'parquet' as embedding_format, cast(least(128, n - 128 * (k // 128)) as bigint) as rows_in_file from {_PLACED}")
def write_vector_parts(spark, sf):
    book, folder = _written(spark, sf)
    files = spark.read.parquet(folder).groupBy(F.concat(F.lit("part="), F.col("part").cast("string")).alias("part"), F.col("_metadata.file_path")).agg(F.count(F.lit(1)).alias("rows_in_file")).drop("file_path")
    return book.withColumn("part", K.basename("embedding_path")).join(files, "part").select("vec_id", "label", "part", "embedding_row_offset", "embedding_dim", "embedding_format", "rows_in_file")


@query("s15_widen_vectors", "select vec_id, label, " + ", ".join(f"embedding[{i + 1}] as emb_{i:04d}" for i in range(64)) + " from embeddings")
def widen_vectors(spark, sf):
    return D.widen_vectors(V.table(spark, sf, "embeddings"), 64)


@query("s16_part_rows", "select vec_id, concat('emb/part_', lpad(cast(vec_id // 64 as varchar), 6, '0'), '.parquet') as embedding_path, cast(vec_id % 64 as int) as embedding_row_offset, cast(len(embedding) as int) as embedding_dim, 'parquet' as embedding_format from embeddings")
def part_rows(spark, sf):
    return _parts(spark, sf).select("vec_id", "embedding_path", "embedding_row_offset", "embedding_dim", "embedding_format")


@query("s17_resume", "select event_id from events where event_type <> 'click' and value >= 5")
def resume(spark, sf):
    ev = V.table(spark, sf, "events")
    return T.remaining(ev, [ev.where("event_type = 'click'"), ev.where("value < 5")], ["event_id"]).select("event_id")


def _routed(spark, sf):
    return T.route(
        V.table(spark, sf, "lineitem").select("l_orderkey", "l_linenumber", "l_quantity", "l_discount"),
        [("read", F.col("l_quantity") > 45, "too many"), ("shape", F.col("l_discount") < 0.02, "too small")],
    )


@query("s19_row_routing", "select l_orderkey, l_linenumber, l_quantity, l_discount, case when l_quantity > 45 then 'read' else 'shape' end as stage, case when l_quantity > 45 then 'too many' else 'too small' end as error_message from lineitem where l_quantity > 45 or l_discount < 0.02")
def row_routing(spark, sf):
    return T.failed(_routed(spark, sf))


@query("s20_run_summary", "select count(*) as rows_total, count(*) filter (where not (l_quantity > 45 or l_discount < 0.02)) as rows_processed, count(*) filter (where l_quantity > 45 or l_discount < 0.02) as rows_failed, cast(sum(l_linenumber) filter (where not (l_quantity > 45 or l_discount < 0.02)) as bigint) as objects from lineitem")
def run_summary(spark, sf):
    return T.run_summary(_routed(spark, sf), "l_linenumber")


@query("s21_csv_to_parquet", "select * from part")
def csv_to_parquet(spark, sf):
    root = _scratch(spark)
    T.write_table(V.table(spark, sf, "part"), f"{root}/part.csv")
    return T.csv_to_parquet(spark, f"{root}/part.csv", f"{root}/part.parquet", _PART)


@query("s22_align_by_position", "with " + V.V_COMP + " select sample_id as release_index, concat('s', sample_id) as sample_key, source, epithelial, lymphocyte, connective, neutrophil, plasma, count_total from v_comp")
def align_by_position(spark, sf):
    c = V.composition(spark, sf).withColumnRenamed("sample_id", "release_index")
    info = c.select("release_index", F.concat(F.lit("s"), F.col("release_index").cast("string")).alias("sample_key"), "source")
    return T.align_by_position(info, c.select("release_index", *V.CLASSES), "release_index", "sample_key", V.CLASSES)


@query(
    "s23_merge_splits",
    """with u as (select p_partkey, p_type, p_name, case when p_size > 12 then 'train' else 'test' end as split from part), n as (select *, row_number() over (order by split = 'test', p_partkey) - 1 as merged_index from u)
 select p_partkey, split, merged_index, concat(lpad(cast(merged_index as varchar), cast(greatest(4, len(cast(merged_index as varchar))) as int), '0'), '_', split, '_', lpad(cast(p_partkey as varchar), cast(greatest(4, len(cast(p_partkey as varchar))) as int), '0'), '_', p_type, '_', replace(p_name, ' ', '_')) as unique_id from n""",
)
def merge_splits(spark, sf):
    p = V.table(spark, sf, "part").select("p_partkey", "p_type", "p_name", "p_size")
    out = T.merge_splits({"train": p.where("p_size > 12"), "test": p.where("p_size <= 12")}, "p_partkey", "p_type", "p_name")
    return out.select("p_partkey", "split", "merged_index", "unique_id")


@query("s26_skip_existing", "select case when p_size > 25 then 'skip' else 'write' end as action, count(*) as n from part group by 1")
def skip_existing(spark, sf):
    p = V.table(spark, sf, "part").select("p_partkey", "p_size")
    return T.split_existing(p, p.where("p_size > 25"), ["p_partkey"]).groupBy("action").agg(F.count(F.lit(1)).alias("n"))


@query("s27_per_source_manifests", "select p_brand, count(*) as n_rows, cast(sum(p_partkey) as bigint) as key_sum from part group by 1")
def per_source_manifests(spark, sf):
    root = _scratch(spark)
    T.write_per_source(V.table(spark, sf, "part").repartition("p_brand"), "p_brand", f"{root}/by_source.parquet", f"{root}/all.parquet")
    both = spark.read.parquet(f"{root}/by_source.parquet").join(spark.read.parquet(f"{root}/all.parquet").select("p_partkey"), "p_partkey", "left_semi")
    return both.groupBy("p_brand").agg(F.count(F.lit(1)).alias("n_rows"), F.sum("p_partkey").alias("key_sum"))
