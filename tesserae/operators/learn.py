"""Leakage-safe splits, feature assembly, model families, search, scoring and projections with Spark ML."""

from __future__ import annotations

import functools
import itertools
import random
from collections.abc import Mapping, Sequence
from multiprocessing.pool import ThreadPool

from pyspark.ml import Estimator, Pipeline, PipelineModel
from pyspark.ml.classification import GBTClassifier, LinearSVC, LogisticRegression, OneVsRest, RandomForestClassifier
from pyspark.ml.clustering import KMeans
from pyspark.ml.feature import PCA, OneHotEncoder, StandardScaler, StringIndexer, VectorAssembler
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.regression import GBTRegressor, LinearRegression, RandomForestRegressor
from pyspark import inheritable_thread_target
from pyspark.sql import Column, DataFrame, functions as F

from . import ranks as R
from .dedupe import first_per_key
from .impute import Imputer
from .joins import JoinError, require_unique
from .metrics import ranking_scores
from ..session import materialise

HEAVY_SHARE = 1000


def _draw(group: str, seed: int) -> Column:
    return F.xxhash64(F.col(group), F.lit(seed))


def split_cut(df: DataFrame, group: str, test_size: float, seed: int) -> int:
    """Hash value from which groups are test groups, so that ceil(groups * test_size) groups are."""
    groups = df.select(_draw(group, seed).alias("h"), group).distinct()
    ranks = R.value_ranks(groups, [], "h")
    n_test = F.ceil(F.col("total") * test_size)
    row = ranks.where(F.col("before") >= F.col("total") - n_test).agg(F.min("h").alias("cut")).first()
    return row["cut"]


def grouped_split(df: DataFrame, group: str, test_size: float, seed: int) -> DataFrame:
    """`split` = train or test by whole groups. The side follows from the group's hash, so no join is made."""
    cut = split_cut(df, group, test_size, seed)
    return df.withColumn("split", F.when(_draw(group, seed) >= F.lit(cut), "test").otherwise("train"))


def shared_groups(df: DataFrame, group: str) -> int:
    """Groups on both sides; must be zero."""
    sides = df.groupBy(group).agg(F.min("split").alias("a"), F.max("split").alias("b"))
    return sides.where(F.col("a") != F.col("b")).limit(1).count()


def _greedy(items: Sequence[Mapping], totals: Mapping, k: int) -> tuple[list[int], dict]:
    """(fold per item, rows of each class in each fold): largest first, each to the fold that stays most even over all classes.

    Items are maps of class to rows. Adding x rows of a class to a fold raises its sum of squares by 2 * load * x and a
    term that is the same for all folds, so only the item's own classes are looked at.
    """
    load: dict = {}
    filled, out = [0] * k, []
    for item in items:
        cost = [round(sum(load[c][f] * x / totals[c] ** 2 for c, x in item.items() if c in load), 12) for f in range(k)]
        best = min(range(k), key=lambda f: (cost[f], filled[f], f))
        for c, x in item.items():
            load.setdefault(c, [0] * k)[best] += x
        filled[best] += sum(item.values())
        out.append(best)
    return out, load


def grouped_folds(df: DataFrame, group: str, folds: int, seed: int, label: str | None = None) -> DataFrame:
    """`fold` by whole groups, balanced by rows (and by class with `label`), for any number of groups and classes.

    Groups with at least 1/HEAVY_SHARE of the rows, so at most HEAVY_SHARE of them, are placed greedily.
    The many light groups fill what the folds have left, in hash order. With `label` each class has its own line of
    hashes, of the groups that hold a larger share of that class than of any other, so that every fold gets its share
    of every class. Classes are rows of a table throughout: there is no column, expression or driver-side list of them.
    """
    h = _draw(group, seed)
    if label is None:
        mixed = df.groupBy(group).agg(F.count(F.lit(1)).alias("_n")).withColumn("_c", F.lit("all"))
    else:
        mixed = df.groupBy(group, F.coalesce(F.concat(F.lit("="), F.col(label).cast("string")), F.lit("")).alias("_c")).agg(F.count(F.lit(1)).alias("_n"))
    mixed = materialise(mixed)
    sums = mixed.groupBy("_c").agg(F.sum("_n").alias("_total"))
    counts = mixed.groupBy(group).agg(F.sum("_n").alias("_n"))
    total, n_groups = (int(x or 0) for x in counts.agg(F.sum("_n"), F.count(F.lit(1))).first())
    k = min(folds, n_groups)
    if k < 2:
        raise ValueError("need at least two groups")
    is_heavy = F.col("_n") * HEAVY_SHARE >= total
    heavy_keys = counts.where(is_heavy).select(F.col(group).alias("_hg"), F.col("_n").alias("_size"))
    mine = F.col(group).eqNullSafe(F.col("_hg"))
    # At most HEAVY_SHARE groups, with the classes that they hold.
    heavy_rows = mixed.join(F.broadcast(heavy_keys), mine).join(sums, "_c").groupBy("_hg", "_size").agg(F.collect_list(F.struct("_c", "_n", "_total")).alias("mix")).collect()
    heavy_rows.sort(key=lambda r: (-r["_size"], str(r["_hg"])))
    totals = {m["_c"]: m["_total"] for r in heavy_rows for m in r["mix"]}
    placed, load = _greedy([{m["_c"]: m["_n"] for m in r["mix"]} for r in heavy_rows], totals, k)
    spark = df.sparkSession
    table = F.broadcast(spark.createDataFrame([(r["_hg"], f) for r, f in zip(heavy_rows, placed)], f"{heavy_keys.select('_hg').schema.simpleString()[7:-1]}, _hf int"))

    def edges(filled: Sequence[float], rows: float) -> list[float]:
        room = [max(rows / k - x, 0.0) for x in filled]
        room = room if sum(room) else [1.0] * k
        return list(itertools.accumulate(x / sum(room) for x in room))[:-1]

    # The class of which a group holds the largest share; of several the first by name.
    light = mixed.join(F.broadcast(heavy_keys), mine, "left_anti")
    even = F.array(*[F.lit((f + 1) / k) for f in range(k - 1)])
    if label is None:
        line = R.value_ranks(light.select(h.alias("h"), "_n"), [], "h", {"w": F.sum("_n")})
        at = edges(load.get("all", [0] * k), total)
        cuts = line.agg(*[F.min(F.when(F.col("before_w") >= F.col("total_w") * F.lit(float(e)), F.col("h"))).alias(f"e{i}") for i, e in enumerate(at)]).first()
        light_fold = sum(((h >= F.lit(c)).cast("int") for c in cuts if c is not None), F.lit(0))
        return df.join(table, mine, "left").withColumn("fold", F.coalesce("_hf", light_fold)).drop("_hg", "_hf") if heavy_rows else df.withColumn("fold", light_fold)
    owned = light.join(sums, "_c").groupBy(group).agg(F.min(F.struct((-F.col("_n") / F.col("_total")).alias("s"), "_c")).alias("best"), F.sum("_n").alias("_n"))
    owned = materialise(owned.select(group, h.alias("h"), "_n", F.col("best._c").alias("_c")))
    line = R.value_ranks(owned.select("_c", "h", "_n"), ["_c"], "h", {"w": F.sum("_n")})
    # Only classes of heavy groups have cuts of their own.
    own_edges = spark.createDataFrame([(c, edges(x, totals[c])) for c, x in load.items()], "_c string, _e array<double>")
    line = line.join(F.broadcast(own_edges), "_c", "left").select("_c", "h", F.size(F.filter(F.coalesce("_e", even), lambda e: F.col("before_w") >= F.col("total_w") * e)).alias("fold"))
    own = owned.join(line, ["_c", "h"]).select(F.col(group).alias("_g"), "fold")
    # Joined back to the rows of light groups only, so no key is hot.
    rest = df.join(table, mine, "left_anti").join(own, F.col(group).eqNullSafe(F.col("_g"))).drop("_g")
    return rest.unionByName(df.join(table, mine).withColumn("fold", F.col("_hf")).drop("_hg", "_hf")) if heavy_rows else rest


def feature_frame(
    df: DataFrame, key: str, target: str, embedding: str | None, metadata: Sequence[str], forbidden: Sequence[str] = ()
) -> DataFrame:
    """Key, target, embedding vector and metadata, after checks for repeats and target leakage."""
    leaks = [c for c in metadata if c == target or c in forbidden]
    if leaks:
        raise JoinError(f"leaking features: {leaks}")
    if embedding is None and not metadata:
        raise ValueError("no features")
    require_unique(df, [key], "feature table")
    keep = [c for c in df.columns if c in {key, target, "split", "fold", *metadata}]
    out = df.select(*keep, *([embedding] if embedding else []))
    return out.withColumn("embedding_vector", array_to_vector(F.transform(embedding, lambda v: v.cast("double")))).drop(embedding) if embedding else out


def preprocessing(numeric: Sequence[str] = (), categorical: Sequence[str] = (), embedding: bool = False, pca: int | None = None) -> list:
    """Pipeline stages: interpolated median and mode imputation, centred scaling, one-hot categories, optional PCA.

    Every stage is fitted on what the pipeline is fitted on, imputation included, so a fold's held-out rows have
    no part in it. A category not seen in training gets the indexer's last slot, which the encoder drops: all zeros.
    """
    parts, stages = [], []
    if numeric or categorical:
        stages.append(Imputer(numeric=numeric, categorical=categorical))
    if numeric:
        stages += [VectorAssembler(inputCols=[f"{c}_num" for c in numeric], outputCol="numeric_raw"), StandardScaler(inputCol="numeric_raw", outputCol="numeric_vector", withMean=True)]
        parts.append("numeric_vector")
    if categorical:
        stages += [
            StringIndexer(inputCols=[f"{c}_cat" for c in categorical], outputCols=[f"{c}_idx" for c in categorical], handleInvalid="keep"),
            OneHotEncoder(inputCols=[f"{c}_idx" for c in categorical], outputCols=[f"{c}_hot" for c in categorical], dropLast=True),
        ]
        parts += [f"{c}_hot" for c in categorical]
    if embedding:
        stages.append(StandardScaler(inputCol="embedding_vector", outputCol="embedding_scaled", withMean=True))
        if pca:
            stages.append(PCA(k=pca, inputCol="embedding_scaled", outputCol="embedding_pca"))
        parts.append("embedding_pca" if pca else "embedding_scaled")
    stages.append(VectorAssembler(inputCols=parts, outputCol="features"))
    return stages


def target_scale(train: DataFrame, target: str = "target") -> tuple[int, float]:
    """Rows and population standard deviation of the target, which the ridge penalty needs."""
    r = train.agg(F.count(target).alias("n"), F.stddev_pop(target).alias("s")).first()
    return int(r["n"]), float(r["s"] or 1.0)


def regressor(family: str, scale: tuple[int, float], seed: int, **p) -> Estimator:
    """ridge, random_forest or boosted; `scale` comes from `target_scale`.

    Spark averages the loss and scales the target to unit deviation before the penalty, so a ridge
    penalty of alpha * |w|^2 on the summed squares is regParam = alpha * deviation / n.
    """
    if family == "ridge":
        n, deviation = scale
        return LinearRegression(labelCol="target", elasticNetParam=0.0, regParam=p.get("alpha", 1.0) * deviation / n, standardization=False)
    if family == "random_forest":
        return RandomForestRegressor(labelCol="target", numTrees=p.get("trees", 50), maxDepth=p.get("depth", 8), seed=seed)
    if family == "boosted":
        return GBTRegressor(labelCol="target", maxIter=p.get("trees", 30), maxDepth=p.get("depth", 4), seed=seed)
    raise ValueError(family)


def classifier(family: str, n_rows: int, n_classes: int, seed: int, **p) -> Estimator:
    """logistic, linear_svm, random_forest or boosted; C becomes 1 / (C * n); more than two classes wrap binary families."""
    reg = 1.0 / (p.get("C", 1.0) * n_rows)
    weighted = {"weightCol": "weight"} if p.get("balanced", True) else {}
    if family == "logistic":
        return LogisticRegression(labelCol="target", regParam=reg, standardization=False, maxIter=p.get("iterations", 50), **weighted)
    if family == "random_forest":
        return RandomForestClassifier(labelCol="target", numTrees=p.get("trees", 50), maxDepth=p.get("depth", 8), seed=seed, **weighted)
    if family == "linear_svm":
        base = LinearSVC(labelCol="target", regParam=reg, maxIter=p.get("iterations", 50), **weighted)
    elif family == "boosted":
        base = GBTClassifier(labelCol="target", maxIter=p.get("trees", 20), maxDepth=p.get("depth", 4), seed=seed, **weighted)
    else:
        raise ValueError(family)
    return base if n_classes == 2 else OneVsRest(classifier=base, labelCol="target", **weighted)


def balanced_weights(df: DataFrame, train: DataFrame, label: str = "target") -> DataFrame:
    """`weight` = n / (classes * class count) from the train side; 1 for classes that it does not have."""
    counts = train.groupBy(label).agg(F.count(F.lit(1)).alias("_n"))
    total = counts.agg(F.sum("_n").alias("n"), F.count(F.lit(1)).alias("k"))
    n, k = total.first()
    weights = counts.select(F.col(label).alias("_label"), (F.lit(float(n or 0)) / (F.lit(k) * F.col("_n"))).alias("_weight"))
    # One line a class. Dealt by class, all rows of a class would be one task's.
    joined = df.join(F.broadcast(weights), df[label].eqNullSafe(F.col("_label")), "left")
    return joined.withColumn("weight", F.coalesce("_weight", F.lit(1.0))).drop("_label", "_weight")


def sample_params(space: Mapping[str, Sequence], n: int, seed: int) -> list[dict]:
    """n distinct seeded draws from a finite space (all of it when it is smaller)."""
    every = [dict(zip(space, v)) for v in itertools.product(*space.values())]
    random.Random(seed).shuffle(every)
    return every[:n]


LOWER_IS_BETTER = ("mae", "rmse")
SCORES = ("mae", "rmse", "r2", "accuracy", "balanced_accuracy", "macro_f1", "roc_auc", "average_precision")


def grouped_scores(predictions: DataFrame, by: Sequence[str], metric: str) -> DataFrame:
    """`score` of each group of rows with `target`, `prediction` and, for ranking metrics, `score` (of class 1).

    Rows without a target are left out. Macro F1 is the mean over all classes that occur as target or prediction,
    balanced accuracy the mean recall of those that occur as target; ROC AUC and average precision are null for
    groups with one class.
    """
    if metric not in SCORES:
        raise ValueError(f"metric must be one of {SCORES}")
    rows = predictions.where(R.present(predictions, "target"))
    if metric in ("roc_auc", "average_precision"):
        return ranking_scores(rows, "target", "score", by).select(*by, F.col(metric).alias("score"))
    error, target = F.col("target") - F.col("prediction"), F.col("target")
    if metric in ("mae", "rmse", "r2"):
        squares = F.var_pop(target) * F.count(target)
        score = {"mae": F.avg(F.abs(error)), "rmse": F.sqrt(F.avg(error * error)), "r2": F.when(squares > 0, 1 - F.sum(error * error) / squares)}[metric]
        return rows.groupBy(*by).agg(score.alias("score"))
    if metric == "accuracy":
        return rows.groupBy(*by).agg(F.avg((target == F.col("prediction")).cast("double")).alias("score"))
    pairs = rows.groupBy(*by, "target", "prediction").agg(F.count(F.lit(1)).alias("n"))
    hit = F.when(target == F.col("prediction"), F.col("n")).otherwise(0)
    sides = F.array(F.struct(target.alias("c"), F.col("n").alias("held"), F.lit(0).cast("long").alias("said"), hit.alias("hit")), F.struct(F.col("prediction").alias("c"), F.lit(0).cast("long").alias("held"), F.col("n").alias("said"), F.lit(0).cast("long").alias("hit")))
    classes = pairs.select(*by, F.explode(sides).alias("s")).select(*by, "s.*").where("c is not null").groupBy(*by, "c").agg(*[F.sum(x).alias(x) for x in ("held", "said", "hit")])
    one = 2 * F.col("hit") / (F.col("held") + F.col("said")) if metric == "macro_f1" else F.when(F.col("held") > 0, F.col("hit") / F.col("held"))
    return classes.groupBy(*by).agg(F.avg(one).alias("score"))


def _out_of_fold(fitted, rows: DataFrame) -> DataFrame:
    """target, prediction and the score of class 1 where the family has one (probability, else margin)."""
    out = fitted.transform(rows)
    named = next((c for c in ("probability", "rawPrediction") if c in out.columns), None)
    score = F.get(vector_to_array(named), F.lit(1)) if named else F.col("prediction")
    return out.select(F.col("target").cast("double").alias("target"), F.col("prediction").cast("double").alias("prediction"), score.cast("double").alias("score"))


def out_of_fold(train: DataFrame, stages: Sequence, families: Mapping[str, Sequence[Estimator]], parallelism: int = 4) -> DataFrame:
    """Out-of-fold predictions of every candidate, stacked: family, trial, fold, target, prediction, score; written.

    `train` carries `target` and `fold`. Preprocessing is fitted once inside each fold and shared by its candidates.
    """
    n_folds = train.agg(F.max("fold")).first()[0] + 1
    trials = [(family, i, e) for family, estimators in families.items() for i, e in enumerate(estimators)]
    stacked = []
    for fold in range(n_folds):
        prepared = Pipeline(stages=list(stages)).fit(train.where(F.col("fold") != fold))
        ready = prepared.transform(train).persist()
        inside, outside = ready.where(F.col("fold") != fold), ready.where(F.col("fold") == fold)

        def run(trial: tuple) -> DataFrame:
            family, i, estimator = trial
            return _out_of_fold(estimator.fit(inside), outside).withColumns({"family": F.lit(family), "trial": F.lit(i), "fold": F.lit(fold)})

        try:
            with ThreadPool(parallelism) as pool:
                parts = pool.map(inheritable_thread_target(train.sparkSession)(run), trials)
            stacked.append(materialise(functools.reduce(DataFrame.unionByName, parts)))
        finally:
            ready.unpersist()
    return functools.reduce(DataFrame.unionByName, stacked)


def trial_table(predictions: DataFrame, metric: str) -> DataFrame:
    """Mean score over folds and its spread for every candidate, all from one grouped aggregation."""
    scores = grouped_scores(predictions, ["family", "trial", "fold"], metric)
    return scores.groupBy("family", "trial").agg(F.avg("score").alias("score"), F.stddev_pop("score").alias("score_std"))


def best_trial(trials: DataFrame, metric: str, by: Sequence[str] = ()) -> DataFrame:
    """The best candidate, or the best of each group; ties go to the smaller trial. One without a score never wins."""
    sign = 1 if metric in LOWER_IS_BETTER else -1
    ok = trials.where(R.present(trials, "score"))
    return ok.groupBy(*by).agg(F.min(F.struct((F.col("score") * sign).alias("o"), "trial", "family", "score", "score_std")).alias("b")).select(*by, *[F.col(f"b.{c}").alias(c) for c in ("family", "trial", "score", "score_std") if c not in by])


def search(train: DataFrame, stages: Sequence, families: Mapping[str, Sequence[Estimator]], metric: str, parallelism: int = 4) -> tuple[str, Estimator, DataFrame]:
    """Grouped cross-validation of every candidate of every family: (best family, best estimator, trials table)."""
    if metric not in SCORES:
        raise ValueError(f"metric must be one of {SCORES}")
    trials = materialise(trial_table(out_of_fold(train, stages, families, parallelism), metric))
    best = best_trial(trials, metric).first()
    if best is None or best["family"] is None:
        raise ValueError(f"no candidate has a {metric}")
    return best["family"], families[best["family"]][best["trial"]], trials


def fit(train: DataFrame, stages: Sequence, estimator: Estimator) -> PipelineModel:
    return Pipeline(stages=[*stages, estimator]).fit(train)


def predict_regression(model: PipelineModel, df: DataFrame, keep: Sequence[str]) -> DataFrame:
    return model.transform(df).select(*keep, "target", "prediction", (F.col("target") - F.col("prediction")).alias("residual"))


def predict_classes(model: PipelineModel, df: DataFrame, keep: Sequence[str], threshold: float | None = None) -> DataFrame:
    """Prediction and, where the family has them, class probabilities; binary scores also as both label views."""
    out = model.transform(df)
    if "probability" not in out.columns:
        return out.select(*keep, "target", "prediction")
    p = vector_to_array("probability")
    out = out.select(*keep, "target", "prediction", p.alias("probabilities"))
    if threshold is None:
        return out
    failure = F.get("probabilities", F.lit(1))
    return out.withColumns(
        {
            "predicted_failure_probability": failure,
            "predicted_quality_probability": 1 - failure,
            "predicted_failure_label": (failure >= threshold).cast("int"),
            "predicted_quality_label": (failure < threshold).cast("int"),
        }
    )


def score_saved(spark_path: str, df: DataFrame, required: Mapping[str, str], keep: Sequence[str], embedding: str | None = None, dim: int | None = None, threshold: float = 0.5) -> DataFrame:
    """Score new rows with a saved pipeline; columns, types and vector length are checked first."""
    have = dict(df.dtypes)
    wrong = {c: (t, have.get(c)) for c, t in required.items() if have.get(c) != t}
    if wrong:
        raise JoinError(f"input does not fit the artifact: {wrong}")
    if embedding and dim is not None:
        bad = df.where(F.coalesce(F.size(embedding) != dim, F.lit(True))).limit(1).count()
        if bad:
            raise JoinError(f"embedding length is not {dim}")
        df = df.withColumn("embedding_vector", array_to_vector(F.transform(embedding, lambda v: v.cast("double"))))
    ready = df if "target" in df.columns else df.withColumn("target", F.lit(None).cast("double"))
    return predict_classes(PipelineModel.load(spark_path), ready, keep, threshold)


def project(df: DataFrame, embedding: str, keep: Sequence[str], k: int = 2, standardise: bool = False) -> DataFrame:
    """k principal coordinates of mean-centred vectors; vectors with non-finite entries are left out."""
    finite = F.forall(embedding, lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) < float("inf")))
    ok = df.where(finite).withColumn("_v", array_to_vector(F.transform(embedding, lambda v: v.cast("double"))))
    model = Pipeline(
        stages=[StandardScaler(inputCol="_v", outputCol="_c", withMean=True, withStd=standardise), PCA(k=k, inputCol="_c", outputCol="_p")]
    ).fit(ok)
    arr = vector_to_array("_p")
    return model.transform(ok).select(*keep, *[F.get(arr, F.lit(i)).alias(f"pc_{i + 1}") for i in range(k)])


def exemplars(points: DataFrame, key: str, coordinates: Sequence[str], k: int, tie: Sequence[Column], seed: int = 42) -> DataFrame:
    """KMeans clusters with the row nearest to each centre; ties by the given order, then the key."""
    ok = points.dropna(subset=list(coordinates))
    ready = VectorAssembler(inputCols=list(coordinates), outputCol="features").transform(ok)
    model = KMeans(k=k, seed=seed, initSteps=5).fit(ready)
    assigned = model.transform(ready)
    centre = F.array(*[F.array(*[F.lit(float(x)) for x in c]) for c in model.clusterCenters()])
    mine = F.get(centre, F.col("prediction"))
    d = F.sqrt(sum((F.pow(F.col(c) - F.get(mine, F.lit(i)), 2) for i, c in enumerate(coordinates)), F.lit(0.0)))
    measured = assigned.withColumns({"distance": d, "cluster": F.col("prediction")}).drop("features", "prediction")
    return first_per_key(measured, ["cluster"], [F.asc("distance"), *tie, F.asc(key)])


def learning_curve(train: DataFrame, group: str, stages: Sequence, estimator: Estimator, evaluator, fractions: Sequence[float], seed: int) -> DataFrame:
    """Train and validation score per fraction of train groups (nested subsets by hash) and fold."""
    rows = []
    n_folds = train.agg(F.max("fold")).first()[0] + 1
    span = float(2**63)
    share = (_draw(group, seed).cast("double") / span + 1) / 2
    data = train.withColumn("_share", share).persist()
    try:
        for f in fractions:
            for fold in range(n_folds):
                part = data.where((F.col("fold") != fold) & (F.col("_share") <= f))
                if part.limit(1).count() == 0:
                    rows.append((float(f), fold, None, None))
                    continue
                model = fit(part, stages, estimator)
                rows.append((float(f), fold, float(evaluator.evaluate(model.transform(part))), float(evaluator.evaluate(model.transform(data.where(F.col("fold") == fold))))))
    finally:
        data.unpersist()
    return train.sparkSession.createDataFrame(rows, "fraction double, fold int, train_score double, valid_score double")


def validation_report(df: DataFrame, key: Sequence[str], required: Sequence[str], expected_rows: Column | None = None) -> DataFrame:
    """(check, value, ok) rows: row count, repeated keys, missing required values."""
    from .dedupe import duplicate_counts

    dup = duplicate_counts(df, key)
    n_extra = dup.select("n_extra").scalar()
    present = [c for c in required if c in df.columns]
    one = df.agg(F.count(F.lit(1)).alias("row_count"), *[F.count_if(F.col(c).isNull()).alias(f"missing_{c}") for c in present])
    one = one.withColumns({"duplicate_keys": n_extra, "missing_columns": F.lit(len(required) - len(present)).cast("bigint")})
    names = [c for c in one.columns]
    rows = one.unpivot([], names, "check", "value")
    fine = F.when(F.col("check") == "row_count", (F.col("value") == expected_rows) if expected_rows is not None else F.col("value") > 0).otherwise(F.col("value") == 0)
    return rows.withColumn("ok", fine)


def compare_runs(runs: DataFrame, by: Sequence[str], score: str, higher_is_better: bool = True) -> DataFrame:
    """Best trial per run group with its spread over trials."""
    sign = -1 if higher_is_better else 1
    # NaN is no score. A null key is passed over, so a trial without a score never wins.
    runs = runs.withColumn(score, F.when(R.present(runs, score), F.col(score)))
    rank = F.when(F.col(score).isNotNull(), F.struct(F.col(score) * sign, F.col("trial")))
    return runs.groupBy(*by).agg(
        F.count(F.lit(1)).alias("n_trials"), F.min_by("trial", rank).alias("best_trial"),
        (F.max(score) if higher_is_better else F.min(score)).alias("best_score"), F.avg(score).alias("mean_score"),
    )
