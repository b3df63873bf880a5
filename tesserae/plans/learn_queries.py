"""Splits, models, projections and incremental runs."""

from __future__ import annotations

from pyspark.ml import Pipeline
from pyspark.ml.evaluation import RegressionEvaluator
from pyspark.ml.functions import vector_to_array
from pyspark.sql import functions as F

from ..functions import scalars as X
from ..operators import learn as L, manifests as N, metrics as M, stages as S
from ..session import materialise
from ..streaming import incremental as I
from . import views as V
from .join_queries import _scratch
from .key_queries import _DEF, _MODE, _X09
from .registry import query, rounded, rounded_sql


def _split(spark, sf):
    return L.grouped_split(V.manifest(spark, sf), "slide_id", 0.2, 42)


@query("m01_grouped_split", "select count(distinct p_brand) as n_groups, cast(ceil(count(distinct p_brand) * 0.2) as bigint) as n_test_groups, cast(0 as bigint) as n_shared, count(*) as n_rows from part")
def grouped_split(spark, sf):
    per = _split(spark, sf).groupBy("slide_id").agg(F.min("split").alias("a"), F.max("split").alias("b"), F.count(F.lit(1)).alias("n"))
    return per.agg(
        F.count(F.lit(1)).alias("n_groups"), F.count_if(F.col("a") == "test").alias("n_test_groups"), F.count_if(F.col("a") != F.col("b")).alias("n_shared"), F.sum("n").alias("n_rows")
    )


@query("m02_grouped_folds", "select count(distinct p_brand) as n_groups, cast(5 as bigint) as n_folds, cast(0 as bigint) as n_split_groups, count(*) as n_rows, true as even from part")
def grouped_folds(spark, sf):
    return _fold_check(L.grouped_folds(V.manifest(spark, sf), "slide_id", 5, 42), "slide_id")


@query("m02_stratified_folds", "select count(distinct source) as n_groups, cast(4 as bigint) as n_folds, cast(0 as bigint) as n_split_groups, count(*) as n_rows, true as even from documents join labels using (doc_id)")
def stratified_folds(spark, sf):
    return _fold_check(L.grouped_folds(V.targets(spark, sf).where("target is not null"), "source", 4, 42, "target"), "source")


def _fold_check(df, group):
    per = df.groupBy(group).agg(F.min("fold").alias("a"), F.max("fold").alias("b"), F.count(F.lit(1)).alias("n"))
    sizes = per.groupBy("a").agg(F.sum("n").alias("s"))
    return per.agg(
        F.count(F.lit(1)).alias("n_groups"), F.count_distinct("a").alias("n_folds"), F.count_if(F.col("a") != F.col("b")).alias("n_split_groups"), F.sum("n").alias("n_rows")
    ).withColumn("even", sizes.agg(F.max("s") <= 1.5 * F.min("s")).scalar())


def _vectors(spark, sf):
    e = V.table(spark, sf, "embeddings")
    return e.select(
        "vec_id", (F.col("vec_id") % 40).alias("slide_id"), "embedding",
        (F.get("embedding", F.lit(0)) * 2 + F.get("embedding", F.lit(1)) + F.col("label") * 0.01).cast("double").alias("target"),
        F.when(F.col("vec_id") % 6 > 0, (F.col("vec_id") % 17).cast("double")).alias("size"), F.concat(F.lit("t"), (F.col("vec_id") % 3).cast("string")).alias("kind"),
    )


@query("m03_feature_frame", "select vec_id, cast(64 as int) as n_features, case when vec_id % 6 > 0 then (vec_id % 17)::double end as size from embeddings")
def feature_frame(spark, sf):
    df = L.feature_frame(_vectors(spark, sf), "vec_id", "target", "embedding", ["size"], ["residual"])
    return df.select("vec_id", F.size(vector_to_array("embedding_vector")).alias("n_features"), "size")


@query(
    "m04_preprocess",
    rounded_sql(
        "with v as (select vec_id, case when vec_id % 6 > 0 then (vec_id % 17)::double end as size, vec_id % 3 as kind, vec_id % 5 > 0 as train from embeddings), m as (select median(size) as med from v where train), f as (select v.*, coalesce(size, med) as s from v, m), z as (select avg(s) as mu, stddev_samp(s) as sd from f where train)\n--body\nselect vec_id, (s - mu) / sd as scaled, cast(3 as int) as n_hot from f, z",
        "scaled",
    ),
)
def preprocess(spark, sf):
    df = _vectors(spark, sf)
    train = df.where("vec_id % 5 > 0")
    out = Pipeline(stages=L.preprocessing(["size"], ["kind"])).fit(train).transform(df)
    return rounded(out.select("vec_id", F.get(vector_to_array("numeric_vector"), F.lit(0)).alias("scaled"), F.size(vector_to_array("kind_hot")).alias("n_hot")))


@query("m05_pca_step")
def pca_step(spark, sf):
    df = L.feature_frame(_vectors(spark, sf), "vec_id", "target", "embedding", [])
    out = Pipeline(stages=L.preprocessing(embedding=True, pca=8)).fit(df).transform(df)
    return out.select("vec_id", F.size(vector_to_array("features")).alias("n_features"))


@query(
    "m06_least_squares",
    rounded_sql(
        "with x as (select p_partkey, p_size::double as size, p_retailprice as target from part), r as (select regr_slope(target, size) as b, regr_intercept(target, size) as a, avg(size) as mu, count(*) as n, var_samp(size) * (count(*) - 1) as ss, covar_samp(target, size) * (count(*) - 1) as sxy, avg(target) as ty, stddev_samp(size) as sd from x)\n--body\nselect p_partkey, ty + (sxy / sd) / (ss / (sd * sd) + 10.0) * (size - mu) / sd as prediction from x, r",
        "prediction", 4,
    ),
)
def least_squares(spark, sf):
    df = V.table(spark, sf, "part").select("p_partkey", F.col("p_size").cast("double").alias("size"), F.col("p_retailprice").alias("target"))
    model = L.fit(df, L.preprocessing(["size"]), L.regressor("ridge", L.target_scale(df), 42, alpha=10.0))
    return rounded(model.transform(df).select("p_partkey", "prediction"), 4)


@query("m06_tree_regressors")
def tree_regressors(spark, sf):
    df = L.feature_frame(_vectors(spark, sf), "vec_id", "target", "embedding", ["size"])
    stages = L.preprocessing(["size"], embedding=True, pca=4)
    out = None
    for family in ("random_forest", "boosted"):
        p = L.predict_regression(L.fit(df, stages, L.regressor(family, L.target_scale(df), 42, trees=5, depth=4)), df, ["vec_id"]).withColumn("family", F.lit(family))
        out = p if out is None else out.unionByName(p)
    return out


def _classes(spark, sf):
    df = L.grouped_split(_vectors(spark, sf), "slide_id", 0.25, 7).withColumn("target", (F.col("target") > 0).cast("double"))
    df = L.feature_frame(df, "vec_id", "target", "embedding", ["size", "slide_id"])
    return L.balanced_weights(df, df.where("split = 'train'"))


@query("m07_classifiers")
def classifiers(spark, sf):
    df = _classes(spark, sf)
    train = df.where("split = 'train'")
    stages, out = L.preprocessing(["size"], embedding=True, pca=4), None
    for family in ("logistic", "linear_svm", "random_forest", "boosted"):
        p = L.predict_classes(L.fit(train, stages, L.classifier(family, train.count(), 2, 42, trees=4, depth=3, iterations=10)), df.where("split = 'test'"), ["vec_id"])
        p = p.select("vec_id", "target", "prediction").withColumn("family", F.lit(family))
        out = p if out is None else out.unionByName(p)
    return out


@query("m08_family_search")
def family_search(spark, sf):
    df = L.grouped_folds(_vectors(spark, sf), "slide_id", 3, 42)
    data = L.feature_frame(df, "vec_id", "target", "embedding", ["size"])
    scale = L.target_scale(data)
    families = {
        "ridge": [L.regressor("ridge", scale, 42, **p) for p in L.sample_params({"alpha": [0.1, 1.0, 10.0]}, 2, 1)],
        "random_forest": [L.regressor("random_forest", scale, 42, **p) for p in L.sample_params({"trees": [4], "depth": [2, 4]}, 1, 1)],
    }
    return L.search(data, L.preprocessing(["size"], embedding=True), families, "mae")[2]


@query("m08_classifier_search")
def classifier_search(spark, sf):
    """Best trial of each family by two metrics, from one stack of out-of-fold predictions."""
    df = L.grouped_folds(_vectors(spark, sf).withColumn("target", (F.col("target") > 0).cast("double")), "slide_id", 3, 42, "target")
    data = L.balanced_weights(L.feature_frame(df, "vec_id", "target", "embedding", ["size", "kind"], ["slide_id"]), df)
    n, out = data.count(), None
    families = {
        "logistic": [L.classifier("logistic", n, 2, 42, iterations=10, **p) for p in L.sample_params({"C": [0.1, 1.0]}, 2, 1)],
        "random_forest": [L.classifier("random_forest", n, 2, 42, trees=4, depth=3)],
    }
    predictions = L.out_of_fold(data, L.preprocessing(["size"], ["kind"], embedding=True, pca=4), families)
    for metric in ("macro_f1", "roc_auc"):
        best = L.best_trial(L.trial_table(predictions, metric), metric, ["family"]).withColumn("metric", F.lit(metric))
        out = best if out is None else out.unionByName(best)
    return out


@query(
    "m08_trial_scores",
    rounded_sql(
        "with " + V.V_OK + """, p as (select model_name as trial, (pixel_dice > 0.5)::int as t, (instance_pq > 0.4)::int as y, instance_pq as s from v_ok where pixel_dice is not null and instance_pq is not null),
 c as (select trial, k, count(*) filter (t = k) as held, count(*) filter (y = k) as said, count(*) filter (t = k and y = k) as hit from p, (values (0), (1)) v(k) group by all),
 f as (select trial, avg(2 * hit / (held + said)) as macro_f1, avg(hit / held) filter (held > 0) as balanced_accuracy from c where held + said > 0 group by trial),
 r as (select trial, t, rank() over (partition by trial order by s) + (count(*) over (partition by trial, s) - 1) / 2.0 as rk from p),
 a as (select trial, case when count(*) filter (t = 1) > 0 and count(*) filter (t = 0) > 0 then (sum(rk) filter (t = 1) - count(*) filter (t = 1) * (count(*) filter (t = 1) + 1) / 2.0) / (count(*) filter (t = 1) * count(*) filter (t = 0)) end as roc_auc from r group by trial)
--body
select trial, macro_f1, balanced_accuracy, roc_auc from f join a using (trial)""",
        "macro_f1 balanced_accuracy roc_auc",
    ),
)
def trial_scores(spark, sf):
    """Scores of given predictions, one row a trial."""
    e = V.eval_ok(spark, sf).where("pixel_dice is not null and instance_pq is not null")
    p = e.select(F.col("model_name").alias("trial"), (F.col("pixel_dice") > 0.5).cast("double").alias("target"), (F.col("instance_pq") > 0.4).cast("double").alias("prediction"), F.col("instance_pq").alias("score"))
    out = None
    for metric in ("macro_f1", "balanced_accuracy", "roc_auc"):
        s = L.grouped_scores(p, ["trial"], metric).withColumnRenamed("score", metric)
        out = s if out is None else out.join(s, "trial")
    return rounded(out)


@query("m09_fit_and_predict")
def fit_and_predict(spark, sf):
    df = L.feature_frame(L.grouped_split(_vectors(spark, sf), "slide_id", 0.2, 42), "vec_id", "target", "embedding", ["size"])
    train = df.where("split = 'train'")
    stages, est = L.preprocessing(["size"], embedding=True), L.regressor("ridge", L.target_scale(train), 42)
    scored = L.predict_regression(L.fit(train, stages, est), df, ["vec_id", "split"])
    refit = L.fit(df, L.preprocessing(["size"], embedding=True), est)
    return scored.join(refit.transform(df).select("vec_id", F.col("prediction").alias("refit_prediction")), "vec_id")


@query("m10_score_saved")
def score_saved(spark, sf):
    df = _classes(spark, sf)
    train = df.where("split = 'train'")
    path = f"{_scratch(spark)}/model"
    L.fit(train, L.preprocessing(["size"], embedding=True, pca=4), L.classifier("logistic", train.count(), 2, 42, iterations=10)).write().overwrite().save(path)
    fresh = _vectors(spark, sf).drop("target").withColumn("weight", F.lit(1.0))
    return L.score_saved(path, fresh, {"size": "double"}, ["vec_id"], "embedding", 64).select("vec_id", "predicted_failure_probability", "predicted_failure_label", "predicted_quality_label")


@query("m11_three_class_stage")
def three_class_stage(spark, sf):
    df = L.grouped_split(_vectors(spark, sf), "slide_id", 0.25, 7)
    train = df.where("split = 'train'")
    from ..operators.ranks import exact_quantiles

    cut = exact_quantiles(train, [], "target", {"a": 1 / 3, "b": 2 / 3}).first()
    names = ["hard", "medium", "easy"]
    label = X.ordinal_label("target", [cut["a"], cut["b"]], names)
    df = df.withColumn("target", (F.array_position(F.array(*[F.lit(n) for n in names]), label) - 1).cast("double"))
    data = L.feature_frame(df, "vec_id", "target", "embedding", ["size"])
    data = L.balanced_weights(data, data.where("split = 'train'"))
    train = data.where("split = 'train'")
    model = L.fit(train, L.preprocessing(["size"], embedding=True, pca=4), L.classifier("logistic", train.count(), 3, 42, iterations=10))
    return M.confusion(L.predict_classes(model, data.where("split = 'test'"), ["vec_id"]), "target", "prediction", [0.0, 1.0, 2.0])


@query("m11_failure_mode_stage", "select count(*) > 0 as any_rows, cast(0 as bigint) as n_unlabelled from lineitem")
def failure_mode_stage(spark, sf):
    d = V.eval_ok(spark, sf).withColumns({k: 1 - F.col(v) for k, v in _DEF.items()}).join(V.manifest(spark, sf).select("patch_id", "slide_id", "foreground_fraction"), "patch_id")
    # Read for the split, the threshold and the model: written once.
    d = materialise(d.select("patch_id", "model_name", "slide_id", "foreground_fraction", "d_sq", X.failure_mode(_MODE, 0.1).alias("mode")))
    d = L.grouped_split(d, "slide_id", 0.2, 42).withColumn("train", F.col("split") == "train")
    hard = N.hard_rows(d, "d_sq", "mode", "train", 0.4, 60).where("retained")
    modes = sorted(_MODE.values())
    data = hard.select("patch_id", "model_name", "split", "foreground_fraction", (F.array_position(F.array(*[F.lit(m) for m in modes]), F.col("mode")) - 1).cast("double").alias("target"))
    data = materialise(L.balanced_weights(data, data.where("split = 'train'")))
    train = data.where("split = 'train'")
    model = L.fit(train, L.preprocessing(["foreground_fraction"], ["model_name"]), L.classifier("random_forest", train.count(), len(modes), 42, trees=4, depth=4))
    p = L.predict_classes(model, data.where("split = 'test'"), ["patch_id"])
    return p.agg((F.count(F.lit(1)) > 0).alias("any_rows"), F.count_if(F.col("prediction").isNull()).alias("n_unlabelled"))


def _quality(spark, sf):
    """One row per (patch, model) with a split by patch."""
    d = V.eval_ok(spark, sf).join(V.manifest(spark, sf).select("patch_id", "foreground_fraction", "mean_area"), "patch_id")
    return d.withColumns({"row_id": F.concat_ws("/", "patch_id", "model_name"), "split": F.when(F.col("patch_id") % 5 > 0, "train").otherwise("test")})


_FEATURES = {"numeric": ["foreground_fraction", "mean_area"], "categorical": ["model_name"]}


def _judged(stage):
    """Rows per split and class, and how many of them the stage's model gave one of its classes."""
    p = stage.predictions(["row_id", "split"])
    name = F.get(F.array(*[F.lit(c) for c in stage.classes]), F.col("target").cast("int"))
    fine = F.col("prediction").isin([float(i) for i in range(len(stage.classes))])
    return p.groupBy("split", name.alias("label")).agg(F.count(F.lit(1)).alias("n_rows"), F.count_if(fine).alias("n_judged"))


@query(
    "m11_ordinal_stage",
    "with " + V.V_OK + """, q as (select quantile_cont(pixel_dice, 1.0 / 3) as a, quantile_cont(pixel_dice, 2.0 / 3) as b from v_ok where patch_id % 5 > 0)
 select case when patch_id % 5 > 0 then 'train' else 'test' end as split, case when pixel_dice <= a then 'hard' when pixel_dice <= b then 'medium' else 'easy' end as label, count(*) as n_rows, count(*) as n_judged from v_ok, q group by 1, 2""",
)
def ordinal_stage(spark, sf):
    make = lambda n, k: L.classifier("logistic", n, k, 42, iterations=10)
    return _judged(S.ordinal_stage(_quality(spark, sf), "row_id", "pixel_dice", make, **_FEATURES))


@query("m11_continuous_stage", "with " + V.V_OK + " select case when patch_id % 5 > 0 then 'train' else 'test' end as split, count(*) as n_rows, count(*) as n_judged, case when patch_id % 5 > 0 then true end as unbiased from v_ok group by all")
def continuous_stage(spark, sf):
    """A least-squares fit with an intercept leaves train residuals of mean zero."""
    stage = S.continuous_stage(_quality(spark, sf), "row_id", "pixel_dice", lambda scale: L.regressor("ridge", scale, 42), **_FEATURES)
    r = stage.predictions(["row_id", "split"]).groupBy("split").agg(F.count(F.lit(1)).alias("n_rows"), F.count("prediction").alias("n_judged"), F.avg("residual").alias("_r"))
    return r.withColumn("unbiased", F.when(F.col("split") == "train", F.abs("_r") < 1e-6)).drop("_r")


@query(
    "m11_mode_stage",
    "with " + _X09 + """, h as (select *, patch_id % 5 > 0 as train from f where d_sq <= (select quantile_cont(d_sq, 0.4) from f where patch_id % 5 > 0)),
 k as (select mode from h where train and mode is not null group by 1 having count(*) >= 5)
 select case when train then 'train' else 'test' end as split, mode as label, count(*) as n_rows, count(*) as n_judged from h where mode in (select mode from k) group by 1, 2""",
)
def mode_stage(spark, sf):
    d = _quality(spark, sf).withColumns({k: 1 - F.col(v) for k, v in _DEF.items()}).withColumn("mode", X.failure_mode(_MODE, 0.1))
    make = lambda n, k: L.classifier("random_forest", n, k, 42, trees=4, depth=4)
    return _judged(S.mode_stage(d, "row_id", "d_sq", "mode", sorted(_MODE.values()), 0.4, 5, make, **_FEATURES))


@query("m12_projection")
def projection(spark, sf):
    return L.project(V.table(spark, sf, "embeddings"), "embedding", ["vec_id", "label"])


@query("m13_exemplars")
def exemplars(spark, sf):
    pts = L.project(V.table(spark, sf, "embeddings"), "embedding", ["vec_id", "label"])
    return L.exemplars(pts, "vec_id", ["pc_1", "pc_2"], 3, [F.desc("label")])


@query("w10_nearest_to_centre", rounded_sql("with c as (select p_brand, avg(p_size) as cx, avg(p_retailprice) as cy from part group by 1), d as (select p_brand, p_partkey, round(sqrt((p_size - cx) * (p_size - cx) + (p_retailprice - cy) * (p_retailprice - cy)), 9) as distance, p_size from part join c using (p_brand))\n--body\nselect p_brand, p_partkey, distance from (select *, row_number() over (partition by p_brand order by distance, p_size desc, p_partkey) as rn from d) where rn = 1", "distance"))
def nearest_to_centre(spark, sf):
    from ..operators.dedupe import first_per_key

    p = V.table(spark, sf, "part")
    c = p.groupBy("p_brand").agg(F.avg("p_size").alias("cx"), F.avg("p_retailprice").alias("cy"))
    d = p.join(c, "p_brand").withColumn("distance", F.round(F.sqrt(F.pow(F.col("p_size") - F.col("cx"), 2) + F.pow(F.col("p_retailprice") - F.col("cy"), 2)), 9))
    return rounded(first_per_key(d, ["p_brand"], [F.asc("distance"), F.desc("p_size"), F.asc("p_partkey")]).select("p_brand", "p_partkey", "distance"))


@query("m14_learning_curve")
def learning_curve(spark, sf):
    df = L.grouped_folds(_vectors(spark, sf), "slide_id", 2, 42)
    data = L.feature_frame(df, "vec_id", "target", "embedding", ["size", "slide_id"])
    return L.learning_curve(data, "slide_id", L.preprocessing(["size"], embedding=True), L.regressor("ridge", L.target_scale(data), 42), RegressionEvaluator(labelCol="target", metricName="mae"), [0.2, 0.4, 0.6, 0.8, 1.0], 42)


@query(
    "m15_validation_report",
    "with " + V.V_RAW + """ select 'row_count' as "check", (select count(*) from v_raw) as "value", true as ok union all select 'missing_status', 0, true union all select 'missing_columns', 1, false
 union all select 'duplicate_keys', (select count(*) - count(distinct (patch_id, model_name)) from v_raw), false""",
)
def validation_report(spark, sf):
    return L.validation_report(V.eval_raw(spark, sf), ["patch_id", "model_name"], ["status", "absent"])


@query(
    "m16_compare_runs",
    rounded_sql("with " + V.V_OK + "\n--body\nselect model_name, count(*) as n_trials, arg_min(patch_id, (-pixel_dice, patch_id)) as best_trial, max(pixel_dice) as best_score, avg(pixel_dice) as mean_score from v_ok group by 1", "best_score mean_score"),
)
def compare_runs(spark, sf):
    return rounded(L.compare_runs(V.eval_ok(spark, sf).withColumnRenamed("patch_id", "trial"), ["model_name"], "pixel_dice"))


_EVENTS = "event_id bigint, ts timestamp, user_id bigint, event_type string, value double, props string"
_CHECKS_SQL = "event_type <> 'error' and value >= 5"


def _stream(spark, sf):
    root = _scratch(spark)
    # The events arrive twice, so that de-duplication has work to do.
    ev = V.table(spark, sf, "events").withColumn("ts", F.col("ts").cast("timestamp"))
    ev.write.parquet(f"{root}/in/first")
    ev.where("event_id % 3 = 0").write.parquet(f"{root}/in/second")
    source = I.arriving(spark, f"{root}/in/*", _EVENTS)
    checks = [("error_event", F.col("event_type") == "error", "error event"), ("small_value", F.col("value") < 5, "value below 5")]
    I.run_incremental(source, ["event_id"], ["ts", "value"], checks, f"{root}/ok", f"{root}/failed", f"{root}/checkpoint")
    return spark.read.parquet(f"{root}/ok"), spark.read.parquet(f"{root}/failed")


@query("r01_incremental_run", "select event_id, 'ok' as outcome from events where event_type <> 'error' and value >= 5 union all select event_id, case when event_type = 'error' then 'error_event' else 'small_value' end from events where event_type = 'error' or value < 5")
def incremental_run(spark, sf):
    ok, bad = _stream(spark, sf)
    return ok.select("event_id", F.lit("ok").alias("outcome")).unionByName(bad.select("event_id", F.col("stage").alias("outcome")))


@query("r02_row_function", "select event_id, case when user_id % 7 > 0 then cast(event_id // (user_id % 7) as bigint) end as value, case when user_id % 7 = 0 then 'row_function' end as stage from events")
def row_function(spark, sf):
    df = V.table(spark, sf, "events").select("event_id", "user_id")
    return I.apply_rows(df, lambda r: int(r["event_id"]) // (int(r["user_id"]) % 7), ["event_id", "user_id"], "bigint").select("event_id", "value", "stage")


@query("r03_score_batches", rounded_sql("select event_id, value * 2 + user_id as value, null::varchar as stage from events", "value"))
def score_batches(spark, sf):
    df = V.table(spark, sf, "events").select("event_id", "user_id", F.col("value").alias("v"))

    def load():
        return lambda pdf: pdf["v"] * 2 + pdf["user_id"]

    return rounded(I.score_batches(df, load, ["v", "user_id"]).select("event_id", "value", "stage"))
