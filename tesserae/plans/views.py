"""The driver tables seen as manifests, facts, compositions, masks and boxes.

Each view exists twice: as a DataFrame and as a SQL common table expression with the same meaning.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from ..operators.dedupe import first_per_key
from ..operators.joins import matched_rows
from ..session import materialise

MODELS = ("m0", "m1", "m2", "m3")
METRICS = ("instance_pq", "pixel_dice", "instance_rq", "instance_sq", "pixel_precision", "pixel_recall")
ORDER = ("l_orderkey", "l_linenumber", "l_suppkey", "l_extendedprice")
# Names of the cell classes.
CLASSES = ("epithelial", "lymphocyte", "connective", "neutrophil", "plasma")
# Order priorities standing for cell classes in the test tables.
PRIORITY_OF = {
    "epithelial": "1-URGENT",
    "lymphocyte": "2-HIGH",
    "connective": "3-MEDIUM",
    "neutrophil": "4-NOT SPECIFIED",
    "plasma": "5-LOW",
}


def table(spark: SparkSession, sf: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf}/{name}.parquet")


def eval_raw(spark: SparkSession, sf: str) -> DataFrame:
    """Patch x model rows, with repeats and with failed rows."""
    precision, recall = F.col("l_extendedprice") / 105000.0, F.col("l_linenumber") / 7.0
    return table(spark, sf, "lineitem").select(
        F.col("l_partkey").alias("patch_id"),
        F.concat(F.lit("m"), (F.col("l_suppkey") % 4).cast("string")).alias("model_name"),
        F.when(F.col("l_returnflag") == "R", "error").otherwise("ok").alias("status"),
        (F.col("l_discount") * 10.0).alias("instance_pq"),
        (F.col("l_tax") / 0.08).alias("instance_rq"),
        (F.col("l_quantity") / 50.0).alias("instance_sq"),
        precision.alias("pixel_precision"),
        recall.alias("pixel_recall"),
        (F.lit(2.0) * precision * recall / (precision + recall)).alias("pixel_dice"),
        *ORDER,
    )


V_RAW = """v_raw as (
 select l_partkey as patch_id, concat('m', cast(l_suppkey % 4 as varchar)) as model_name,
  case when l_returnflag = 'R' then 'error' else 'ok' end as status,
  l_discount * 10.0::double as instance_pq, l_tax / 0.08::double as instance_rq, l_quantity / 50.0::double as instance_sq,
  l_extendedprice / 105000.0::double as pixel_precision, l_linenumber / 7.0::double as pixel_recall,
  2.0::double * (l_extendedprice / 105000.0::double) * (l_linenumber / 7.0::double)
   / (l_extendedprice / 105000.0::double + l_linenumber / 7.0::double) as pixel_dice,
  l_orderkey, l_linenumber, l_suppkey, l_extendedprice
 from lineitem)"""


def eval_ok(spark: SparkSession, sf: str) -> DataFrame:
    """Successful rows, first one per (patch, model)."""
    return first_per_key(eval_raw(spark, sf).where("status = 'ok'"), ["patch_id", "model_name"], list(ORDER))


V_OK = V_RAW + """, v_ok as (
 select * exclude (rn) from (select *, row_number() over (partition by patch_id, model_name
   order by l_orderkey, l_linenumber, l_suppkey, l_extendedprice) as rn from v_raw where status = 'ok') where rn = 1)"""


def eval_matched(spark: SparkSession, sf: str) -> DataFrame:
    return matched_rows(eval_ok(spark, sf), "patch_id", "model_name", len(MODELS))


def matched_table(spark: SparkSession, sf: str) -> DataFrame:
    """The matched facts as a stored table, for reports that read them several times."""
    return materialise(eval_matched(spark, sf).select("patch_id", "model_name", *METRICS))


V_MATCHED = V_OK + """, v_matched as (
 select * from v_ok where patch_id in (select patch_id from v_ok group by patch_id having count(distinct model_name) = 4))"""


def manifest(spark: SparkSession, sf: str) -> DataFrame:
    key = F.col("p_partkey").cast("string")
    return table(spark, sf, "part").select(
        F.col("p_partkey").alias("patch_id"),
        F.col("p_brand").alias("slide_id"),
        F.col("p_type").alias("dataset"),
        (F.col("p_size") / 50.0).alias("foreground_fraction"),
        F.col("p_retailprice").alias("mean_area"),
        F.concat(F.lit("samples/"), key, F.lit("/"), key, F.lit("_image.png")).alias("image_path"),
        F.concat(F.lit("emb/"), F.replace("p_brand", F.lit("#"), F.lit("_")), F.lit(".parquet")).alias("embedding_path"),
    )


V_MANIFEST = """v_manifest as (
 select p_partkey as patch_id, p_brand as slide_id, p_type as dataset, p_size / 50.0::double as foreground_fraction,
  p_retailprice as mean_area,
  concat('samples/', cast(p_partkey as varchar), '/', cast(p_partkey as varchar), '_image.png') as image_path,
  concat('emb/', replace(p_brand, '#', '_'), '.parquet') as embedding_path
 from part)"""


def composition(spark: SparkSession, sf: str) -> DataFrame:
    """One row per sample with class counts; samples without cells have zeros."""
    orders = table(spark, sf, "orders").groupBy(F.col("o_custkey").alias("c_custkey")).agg(
        *[F.count_if(F.col("o_orderpriority") == p).alias(c) for c, p in PRIORITY_OF.items()]
    )
    total = sum((F.col(c) for c in CLASSES), F.lit(0).cast("bigint"))
    return (
        table(spark, sf, "customer").join(orders, "c_custkey", "left").na.fill(0, list(CLASSES))
        .select(F.col("c_custkey").alias("sample_id"), F.col("c_mktsegment").alias("source"), *CLASSES)
        .withColumn("count_total", total)
    )


V_COMP = (
    "v_comp as (select *, "
    + " + ".join(CLASSES)
    + " as count_total from (select c_custkey as sample_id, c_mktsegment as source, "
    + ", ".join(f"coalesce({c}, 0) as {c}" for c in CLASSES)
    + " from customer left join (select o_custkey, "
    + ", ".join(f"count(*) filter (where o_orderpriority = '{p}') as {c}" for c, p in PRIORITY_OF.items())
    + " from orders group by o_custkey) on o_custkey = c_custkey))"
)

# Dominant class to category, and the order of categories.
RICH = {"epithelial": "epithelial-rich", "lymphocyte": "lymphocyte-rich", "connective": "connective-tissue-rich"}
RICH_ORDER = ("connective-tissue-rich", "epithelial-rich", "mixed", "lymphocyte-rich", "no-nuclei")


def composition_labels(spark: SparkSession, sf: str, threshold: float = 0.4) -> DataFrame:
    from ..functions import scalars as X

    df = composition(spark, sf)
    return (
        df.withColumn("dominant_class", X.dominant_class("count_total", CLASSES))
        .withColumn("dominant_fraction", X.dominant_fraction("count_total", CLASSES))
        .withColumn("richness_label", X.richness_label("count_total", "dominant_class", "dominant_fraction", RICH, threshold))
    )


_TOP = f"greatest({', '.join(CLASSES)})"
_HITS = " + ".join(f"cast({c} = {_TOP} as int)" for c in CLASSES)
V_LABEL = V_COMP + f""", v_dom as (select *,
  case when not coalesce(count_total > 0, false) then 'none' when {_HITS} > 1 then 'tie'
  {' '.join(f"when {c} = {_TOP} then '{c}'" for c in CLASSES)} end as dominant_class,
  case when count_total > 0 then {_TOP} / count_total end as dominant_fraction from v_comp),
 v_label as (select *, case when count_total is null or count_total <= 0 then 'no-nuclei'
  when dominant_class = 'epithelial' and dominant_fraction >= 0.4 then 'epithelial-rich'
  when dominant_class = 'lymphocyte' and dominant_fraction >= 0.4 then 'lymphocyte-rich'
  when dominant_class = 'connective' and dominant_fraction >= 0.4 then 'connective-tissue-rich'
  else 'mixed' end as richness_label from v_dom)"""


def wide_patches(spark: SparkSession, sf: str) -> DataFrame:
    """Matched patches: instance_pq per model, consensus, morphology and richness label."""
    from ..functions import scalars as X
    from ..operators.reports import wide_by_model

    wide = wide_by_model(eval_ok(spark, sf), "patch_id", "model_name", MODELS, ["instance_pq"]).withColumnsRenamed(
        {f"instance_pq__{m}": m for m in MODELS}
    )
    labels = composition_labels(spark, sf).select(F.col("sample_id").alias("patch_id"), "richness_label", "count_total")
    return (
        wide.withColumn("consensus_pq", X.row_median(MODELS))
        .withColumn("mean_pq", X.row_mean(MODELS))
        .join(manifest(spark, sf).select("patch_id", "slide_id", "foreground_fraction", "mean_area"), "patch_id", "left")
        .join(labels, "patch_id", "left")
    )


def wide_table(spark: SparkSession, sf: str) -> DataFrame:
    return materialise(wide_patches(spark, sf))


V_WIDE = (
    V_MATCHED
    + ", "
    + V_MANIFEST
    + ", "
    + V_LABEL
    + ", v_wide as (select w.*, slide_id, foreground_fraction, mean_area, richness_label, count_total from (select *, "
    + "(list_sort([m0, m1, m2, m3])[2] + list_sort([m0, m1, m2, m3])[3]) / 2 as consensus_pq, (m0 + m1 + m2 + m3) / 4 as mean_pq"
    + " from (select patch_id, "
    + ", ".join(f"max(instance_pq) filter (where model_name = '{m}') as {m}" for m in MODELS)
    + " from v_matched group by patch_id)) w left join v_manifest using (patch_id)"
    + " left join v_label on sample_id = patch_id)"
)


def targets(spark: SparkSession, sf: str) -> DataFrame:
    """Documents as scored test rows: group, binary truth (null when unlabelled), score in [0, 1], prediction."""
    score = (F.col("n_chars") % 1000) / 1000.0
    return (
        table(spark, sf, "documents").select("doc_id", "source", "lang", "n_chars")
        .join(table(spark, sf, "labels"), "doc_id", "left")
        .select("doc_id", "source", "lang", "n_chars", F.col("quality").alias("target"), "toxic", score.alias("score"))
        .withColumn("predicted", (F.col("score") >= 0.5).cast("int"))
    )


V_TARGET = """v_target as (
 select doc_id, source, lang, n_chars, quality as target, toxic, (n_chars % 1000) / 1000.0::double as score,
  case when (n_chars % 1000) / 1000.0::double >= 0.5 then 1 else 0 end as predicted
 from documents left join labels using (doc_id))"""


def mask_pixels(spark: SparkSession, sf: str) -> DataFrame:
    """Embeddings as 8x8 value images."""
    px = table(spark, sf, "embeddings").select(F.col("vec_id").alias("image_id"), F.posexplode("embedding").alias("i", "v"))
    return px.select("image_id", F.floor(F.col("i") / 8).cast("int").alias("row"), (F.col("i") % 8).cast("int").alias("col"), "v")


V_PX = """v_px as (select vec_id as image_id, cast((i - 1) // 8 as int) as row, cast((i - 1) % 8 as int) as col, v
 from (select vec_id, unnest(embedding) as v, generate_subscripts(embedding, 1) as i from embeddings))"""


def truth_mask(spark: SparkSession, sf: str) -> DataFrame:
    px = mask_pixels(spark, sf)
    quadrant = 1 + 2 * F.floor(F.col("row") / 4) + F.floor(F.col("col") / 4)
    return px.select("image_id", "row", "col", F.when(F.col("v") > 0, quadrant).otherwise(0).cast("int").alias("label"))


V_TRUTH = V_PX + """, v_truth as (select image_id, row, col, cast(case when v > 0 then 1 + 2 * (row // 4) + col // 4 else 0 end as int) as label from v_px)"""


def pred_mask(spark: SparkSession, sf: str) -> DataFrame:
    """Two models: `near` lowers the bar and moves quadrants by a row, `far` reads the previous image."""
    px = mask_pixels(spark, sf)
    near = F.when(F.col("v") > -0.03125, 1 + 2 * F.floor((F.col("row") + 1) / 4) + F.floor(F.col("col") / 4)).otherwise(0)
    far = F.when(F.col("v") > 0, 1 + 2 * F.floor((F.col("row") + 1) / 4) + F.floor(F.col("col") / 4)).otherwise(0)
    return px.select("image_id", F.lit("near").alias("model_name"), "row", "col", near.cast("int").alias("label")).unionByName(
        px.select((F.col("image_id") - 1).alias("image_id"), F.lit("far").alias("model_name"), "row", "col", far.cast("int").alias("label"))
    )


V_PRED = V_TRUTH + """, v_pred as (select image_id, 'near' as model_name, row, col, cast(case when v > -0.03125::float then 1 + 2 * ((row + 1) // 4) + col // 4 else 0 end as int) as label from v_px
 union all select image_id - 1, 'far', row, col, cast(case when v > 0 then 1 + 2 * ((row + 1) // 4) + col // 4 else 0 end as int) from v_px),
 v_images as (select vec_id as image_id, m as model_name, 8 as height, 8 as width from embeddings, (values ('near'), ('far')) t(m))"""


def images(spark: SparkSession, sf: str) -> DataFrame:
    ids = table(spark, sf, "embeddings").select(F.col("vec_id").alias("image_id"))
    return ids.withColumns({"model_name": F.explode(F.array(F.lit("near"), F.lit("far"))), "height": F.lit(8), "width": F.lit(8)})


def sizes(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "embeddings").select(F.col("vec_id").alias("image_id"), F.lit(8).alias("height"), F.lit(8).alias("width"))


def colour_pixels(spark: SparkSession, sf: str) -> DataFrame:
    """8-bit channels derived from the value image."""
    v = F.col("v").cast("double")
    byte = lambda e: F.pmod(F.floor(e).cast("int"), F.lit(256))
    return mask_pixels(spark, sf).select(
        "image_id", "row", "col", byte(v * 512 + 128).alias("r"), byte(v * 256 + 128).alias("g"), byte(v * 1024 + 64).alias("b"),
        F.lit(255).alias("a"), F.when(F.col("v") > 0, 1).otherwise(0).alias("label"),
    )


V_RGB = V_PX + """, v_rgb as (select image_id, row, col, cast((cast(floor(v::double * 512 + 128) as int) % 256 + 256) % 256 as int) as r,
 cast((cast(floor(v::double * 256 + 128) as int) % 256 + 256) % 256 as int) as g, cast((cast(floor(v::double * 1024 + 64) as int) % 256 + 256) % 256 as int) as b,
 255 as a, case when v > 0 then 1 else 0 end as label from v_px)"""


def boxes(spark: SparkSession, sf: str) -> DataFrame:
    """Line items as boxes on a 105000 x 100000 plane."""
    x, y = F.col("l_extendedprice"), F.col("l_quantity") * 2000.0
    hw, hh = 200.0 + F.col("l_tax") * 2000.0, 150.0 + F.col("l_discount") * 3000.0
    return table(spark, sf, "lineitem").select(
        F.concat_ws("-", "l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", F.col("l_extendedprice").cast("decimal(18,2)")).alias("cell_id"),
        (x - hw).alias("xmin"), (y - hh).alias("ymin"), (x + hw).alias("xmax"), (y + hh).alias("ymax"),
    )


V_BOX = """v_box as (select concat_ws('-', l_orderkey, l_linenumber, l_partkey, l_suppkey, cast(l_extendedprice as decimal(18,2))) as cell_id,
 l_extendedprice - (200.0::double + l_tax * 2000.0::double) as xmin, l_quantity * 2000.0::double - (150.0::double + l_discount * 3000.0::double) as ymin,
 l_extendedprice + (200.0::double + l_tax * 2000.0::double) as xmax, l_quantity * 2000.0::double + (150.0::double + l_discount * 3000.0::double) as ymax from lineitem)"""


def plane_tiles(spark: SparkSession, sf: str) -> DataFrame:
    """Tiles placed at parts: every part is one tile on a 4000 grid."""
    return table(spark, sf, "part").select(
        F.col("p_partkey").alias("tile_id"),
        ((F.col("p_partkey") % 27) * 4000.0).alias("tile_x"),
        (F.floor(F.col("p_partkey") / 27) * 4000.0).alias("tile_y"),
        F.lit(3000.0).alias("w_img"), F.lit(3500.0).alias("h_img"),
    )


V_TILE = """v_tile as (select p_partkey as tile_id, (p_partkey % 27) * 4000.0::double as tile_x, (p_partkey // 27) * 4000.0::double as tile_y,
 3000.0::double as w_img, 3500.0::double as h_img from part)"""
