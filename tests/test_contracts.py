"""Join contracts, missing numbers, imputation inside folds, trial scores, folds with many classes."""

import math
import random

import pytest
from pyspark.ml import Pipeline, PipelineModel
from pyspark.sql import functions as F

from tesserae.operators import joins as J, learn as L, metrics as M, reports as P
from tesserae.operators.impute import Imputer

NAN = float("nan")


def test_repeats_are_errors_in_the_join(spark):
    manifest = spark.createDataFrame([("a",), ("b",), (None,), (None,)], "k string")
    once = spark.createDataFrame([("a", "m", 1.0), ("b", "m", 2.0), (None, "m", 3.0), (None, "m", 4.0)], "k string, model string, v double")
    twice = once.unionByName(once.where("k = 'a'"))
    assert J.attach_targets(manifest, once, "k", "model", ["v"]).count() == 4
    for bad in (lambda: J.attach_targets(manifest, twice, "k", "model", ["v"]), lambda: J.attach_targets(manifest.union(manifest.limit(1)), once, "k", "model", ["v"])):
        with pytest.raises(Exception, match="duplicate keys"):
            bad().collect()
    left, right = spark.createDataFrame([(1, None), (2, 5)], "k int, x int"), spark.createDataFrame([(1, 7), (3, 8)], "k int, x int")
    assert sorted(J.merge_coalesced(left, right, ["k"], "full_outer").collect()) == [(1, 7), (2, 5), (3, 8)]
    assert sorted(J.fill_missing(left, right.union(right.selectExpr("cast(null as int)", "9")), ["k"]).collect()) == [(1, 7), (2, 5)]
    for bad in (lambda: J.merge_coalesced(left, right.union(right), ["k"]), lambda: J.merge_coalesced(left.union(left), right, ["k"]), lambda: J.fill_missing(left, right.union(right), ["k"])):
        with pytest.raises(Exception, match="duplicate keys"):
            bad().collect()


def test_nan_is_missing_in_reports(spark):
    rows = [(f"p{i}", "m", float(i), float(2 * i)) for i in range(8)] + [("n1", "m", NAN, 1.0), ("n2", "m", 3.0, NAN), ("n3", "m", None, None)]
    df = spark.createDataFrame(rows, "k string, model string, x double, y double")
    r = P.spearman(df, ["x"], ["y"]).first()
    assert (r["n"], r["spearman_rho"]) == (8, pytest.approx(1.0))
    b = P.bucket_report(df, ["x"], ["y"]).collect()
    assert sorted(x["bucket"] for x in b) == [1, 2, 3, 4] and sum(x["n"] for x in b) == 8
    t = {r["k"]: (r["target"], r["models_with_target"]) for r in P.patch_targets(df, "k", "model", "y", "mean").collect()}
    assert t["n2"] == (None, 0) and t["p3"] == (6.0, 1)
    s = M.inference_summary(df.withColumn("label", F.lit(1)).withColumn("a", F.lit("z")), "y", "label", "a").first()
    assert s["n_rows"] == 11 and s["score_mean"] == pytest.approx((sum(range(0, 16, 2)) + 1) / 9) and s["score_max"] == 14
    assert all(not math.isnan(v["value"]) for v in M.prediction_summary(df.withColumn("label", F.lit("u")), "x", "y", "y", "label", "label").collect() if v["value"] is not None)
    runs = spark.createDataFrame([("g", 1, 0.9), ("g", 2, NAN), ("g", 3, None)], "g string, trial int, s double")
    best = L.compare_runs(runs, ["g"], "s").first()
    assert (best["best_trial"], best["best_score"], best["mean_score"], best["n_trials"]) == (1, 0.9, 0.9, 3)


def test_imputer_is_fitted_on_its_own_rows(spark, tmp_path):
    rows = [(i, float(i), "a" if i % 3 else "b", 0) for i in range(9)] + [(9, NAN, None, 0), (10, None, "b", 0), (11, 1e9, "z", 1)]
    df = spark.createDataFrame(rows, "id int, x double, c string, fold int")
    inside, empty = df.where("fold = 0"), df.where("id < 0")
    model = Pipeline(stages=[Imputer(numeric=["x"], categorical=["c"])]).fit(inside)
    # The outlier and the new category of the held-out fold have no part in it.
    assert model.stages[0].values() == {"x": 4.0, "c": "a"}
    model.write().overwrite().save(str(tmp_path / "m"))
    again = PipelineModel.load(str(tmp_path / "m"))
    for m in (model, again):
        got = {r["id"]: (r["x_num"], r["c_cat"]) for r in m.transform(df).collect()}
        assert got[9] == (4.0, "a") and got[10] == (4.0, "b") and got[11] == (1e9, "z") and got[2] == (2.0, "a")
    assert Imputer(numeric=["x"], categorical=["c"]).fit(empty).values() == {"x": 0.0, "c": "missing"}


def test_trial_scores(spark):
    r = random.Random(2)
    rows = [(t, float(r.randrange(3)), float(r.randrange(4)), r.random()) for t in range(3) for _ in range(60)] + [(0, None, 1.0, 0.5)]
    df = spark.createDataFrame(rows, "trial int, target double, prediction double, score double")
    for metric in ("macro_f1", "balanced_accuracy", "accuracy", "mae", "rmse", "r2"):
        got = {x["trial"]: x["score"] for x in L.grouped_scores(df, ["trial"], metric).collect()}
        for t in range(3):
            y = [(a, p) for k, a, p, _ in rows if k == t and a is not None]
            classes = sorted({a for a, _ in y} | {p for _, p in y})
            hit = {c: sum(a == p == c for a, p in y) for c in classes}
            held, said = ({c: sum(x[i] == c for x in y) for c in classes} for i in (0, 1))
            mean = sum(a for a, _ in y) / len(y)
            want = {
                "macro_f1": sum(2 * hit[c] / (held[c] + said[c]) for c in classes) / len(classes),
                "balanced_accuracy": sum(hit[c] / held[c] for c in classes if held[c]) / sum(held[c] > 0 for c in classes),
                "accuracy": sum(hit.values()) / len(y),
                "mae": sum(abs(a - p) for a, p in y) / len(y), "rmse": (sum((a - p) ** 2 for a, p in y) / len(y)) ** 0.5,
                "r2": 1 - sum((a - p) ** 2 for a, p in y) / sum((a - mean) ** 2 for a, _ in y),
            }
            assert got[t] == pytest.approx(want[metric])
    binary = df.withColumn("target", (F.col("target") > 0).cast("double")).withColumn("score", F.round("score", 1))
    kept = [(x["trial"], x["target"], x["score"]) for x in binary.where("target is not null").collect()]
    for x in L.grouped_scores(binary, ["trial"], "roc_auc").collect():
        pos, neg = ([s for k, a, s in kept if k == x["trial"] and a == v] for v in (1.0, 0.0))
        assert x["score"] == pytest.approx(sum((p > n) + (p == n) / 2 for p in pos for n in neg) / (len(pos) * len(neg)))
    trials = spark.createDataFrame([("a", 0, 0.5, 0.0), ("a", 1, NAN, 0.0), ("b", 0, 0.5, 0.1), ("b", 1, None, None)], "family string, trial int, score double, score_std double")
    assert L.best_trial(trials, "roc_auc").first()["trial"] == 0
    assert sorted((x["family"], x["trial"]) for x in L.best_trial(trials, "mae", ["family"]).collect()) == [("a", 0), ("b", 0)]


def test_folds_with_thousands_of_classes(spark):
    df = spark.range(24_000).select((F.col("id") % 6000).alias("g"), F.concat(F.lit("c"), (F.col("id") % 3000).cast("string")).alias("y"))
    df = df.unionByName(spark.range(6000).select(F.lit(-1).cast("long").alias("g"), F.when(F.col("id") % 2 == 0, "c0").alias("y")))
    got = L.grouped_folds(df, "g", 3, 7, "y")
    per = got.groupBy("g").agg(F.count_distinct("fold").alias("n"), F.count("*").alias("rows")).agg(F.max("n").alias("n"), F.sum("rows").alias("rows"), F.count("*").alias("groups")).first()
    assert (per["n"], per["rows"], per["groups"]) == (1, 30_000, 6001)
    # Two classes over many groups of like size: each fold holds a third of each class.
    two = spark.range(30_000).select((F.col("id") % 5000).alias("g"), F.when(F.col("id") % 5000 % 5 == 0, "rare").otherwise("common").alias("y"))
    shares = L.grouped_folds(two, "g", 3, 7, "y").groupBy("y", "fold").count().collect()
    for r in shares:
        assert r["count"] == pytest.approx({"rare": 2000, "common": 8000}[r["y"]], rel=0.02)
