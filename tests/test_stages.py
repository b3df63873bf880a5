"""Stages: thresholds and classes of the train side, errors, predictions for all rows."""

import pytest
from pyspark.sql import functions as F

from tesserae.operators import learn as L, stages as S
from tesserae.operators.joins import JoinError
from tesserae.operators.manifests import hard_rows
from tesserae.plans import learn_queries

NAN = float("nan")


@pytest.fixture(scope="module")
def rows(spark):
    train = [(i, "train", float(i % 30), float(i % 30) + (i % 3) / 10, "ab"[i % 30 < 8]) for i in range(90)]
    test = [(100, "test", 1e9, 1e9, "a"), (101, "test", -5.0, 0.0, "new"), (102, "test", None, 3.0, "b"), (103, "test", NAN, 3.0, None), (104, "test", 10.0, None, "b")]
    return spark.createDataFrame([*train, *test], "id int, split string, y double, x double, mode string")


def logistic(n, k):
    return L.classifier("logistic", n, k, 1)


def test_ordinal_stage(rows):
    s = S.ordinal_stage(rows, "id", "y", logistic, numeric=["x"])
    assert s.cuts == pytest.approx([9.67, 19.33], abs=0.01) and s.classes == ["hard", "medium", "easy"]
    got = {r["id"]: r for r in s.predictions(["id"]).collect()}
    # Rows without a target are left out; a missing feature is imputed; the outlier of the test side moves no threshold.
    assert set(got) == {*range(90), 100, 101, 104} and got[100]["target"] == 2 and got[101]["target"] == 0
    assert sum(r["prediction"] == r["target"] for r in got.values()) > 80 and len(got[104]["probabilities"]) == 3
    with pytest.raises(JoinError, match="no train rows"):
        S.ordinal_stage(rows.where("split = 'test'"), "id", "y", logistic, numeric=["x"])
    with pytest.raises(JoinError, match="leaking"):
        S.ordinal_stage(rows, "id", "y", logistic, numeric=["y"])


def test_mode_stage(rows):
    s = S.mode_stage(rows, "id", "y", "mode", ["a", "b", "never"], 0.5, 6, logistic, numeric=["x"])
    assert s.classes == ["a", "b"] and s.cuts == [14.5]
    got = {r["id"]: r["target"] for r in s.predictions(["id"]).collect()}
    assert set(got) == {i for i in range(90) if i % 30 <= 14} | {104} and got[0] == 1 and got[9] == 0 and got[104] == 1
    with pytest.raises(JoinError, match="1 classes"):
        S.mode_stage(rows, "id", "y", "mode", ["a", "b"], 0.5, 22, logistic, numeric=["x"])


def test_continuous_stage(rows):
    s = S.continuous_stage(rows, "id", "y", lambda scale: L.regressor("ridge", scale, 1, alpha=0.01), numeric=["x"], categorical=["mode"])
    got = {r["id"]: r for r in s.predictions(["id", "split"]).collect()}
    assert set(got) == {*range(90), 100, 101, 104} and max(abs(got[i]["residual"]) for i in range(90)) < 1
    with pytest.raises(JoinError):
        S.continuous_stage(rows.where("split = 'test'"), "id", "y", lambda scale: L.regressor("ridge", scale, 1), numeric=["x"])


def test_a_fit_reads_written_rows(spark, rows):
    s = S.ordinal_stage(rows, "id", "y", logistic, numeric=["x"])
    m = S.mode_stage(rows, "id", "y", "mode", ["a", "b"], 0.5, 6, logistic, numeric=["x"])
    c = S.continuous_stage(rows, "id", "y", lambda scale: L.regressor("ridge", scale, 1), numeric=["x"])
    assert all(x.data.inputFiles() for x in (s, m, c))


def test_failure_mode_query_fits_written_rows(spark, monkeypatch):
    seen, fit = [], L.fit
    monkeypatch.setattr(L, "fit", lambda train, *a: seen.append(train) or fit(train, *a))
    learn_queries.failure_mode_stage(spark, "/root/testdata/sf0.001")
    assert seen and not any("lineitem" in f for df in seen for f in df.inputFiles())


def test_rows_are_not_dealt_by_class(spark, rows):
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        plans = [d._jdf.queryExecution().executedPlan().toString() for d in (L.balanced_weights(rows, rows, "mode"), hard_rows(rows.withColumn("t", F.lit(True)), "y", "mode", "t", 0.5, 1))]
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    assert all("BroadcastHashJoin" in p and "SortMergeJoin" not in p for p in plans)
