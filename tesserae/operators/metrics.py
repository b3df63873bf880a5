"""Classifier and regression reports computed on prediction tables."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, functions as F

from ..functions import scalars as X
from . import ranks as R
from .reports import weighted_spearman


def confusion(df: DataFrame, truth: str, pred: str, labels: Sequence, by: Sequence[str] = ()) -> DataFrame:
    """Counts on the full label square: (by.., truth, pred, n), zeros kept."""
    pairs = F.array(
        *[
            F.struct(F.lit(a).alias(truth), F.lit(b).alias(pred), F.col(f"c{i}_{j}").alias("n"))
            for i, a in enumerate(labels)
            for j, b in enumerate(labels)
        ]
    )
    one = df.groupBy(*by).agg(
        *[F.count_if((F.col(truth) == a) & (F.col(pred) == b)).alias(f"c{i}_{j}") for i, a in enumerate(labels) for j, b in enumerate(labels)]
    )
    return one.select(*by, F.explode(pairs).alias("_p")).select(*by, "_p.*")


def per_class(square: DataFrame, truth: str, pred: str, labels: Sequence) -> DataFrame:
    """Support, predicted count, precision, recall, F1 per class; undefined ratios are 0."""
    named = square.withColumn("label", F.explode(F.array(*[F.lit(v) for v in labels])))
    agg = named.groupBy("label").agg(
        F.sum(F.when(F.col(truth) == F.col("label"), F.col("n")).otherwise(0)).alias("support"),
        F.sum(F.when(F.col(pred) == F.col("label"), F.col("n")).otherwise(0)).alias("predicted"),
        F.sum(F.when((F.col(truth) == F.col("label")) & (F.col(pred) == F.col("label")), F.col("n")).otherwise(0)).alias("_tp"),
    )
    return agg.select(
        "label", "support", "predicted",
        X.safe_divide("_tp", "predicted").alias("precision"), X.safe_divide("_tp", "support").alias("recall"),
        X.safe_divide(2 * F.col("_tp"), F.col("support") + F.col("predicted")).alias("f1"),
    )


def classification_summary(square: DataFrame, truth: str, pred: str, labels: Sequence) -> DataFrame:
    """Accuracy, macro F1, balanced accuracy over classes present in the truth, quadratic weighted kappa."""
    classes = per_class(square, truth, pred, labels)
    scores = classes.agg(
        F.avg("f1").alias("macro_f1"), F.avg(F.when(F.col("support") > 0, F.col("recall"))).alias("balanced_accuracy"), F.sum("support").alias("n_rows")
    )
    index = F.array(*[F.lit(v) for v in labels])
    i, j = F.array_position(index, F.col(truth)), F.array_position(index, F.col(pred))
    weight = ((i - j) * (i - j)).cast("double")
    support = F.map_from_entries(F.collect_list(F.struct("label", "support")))
    predicted = F.map_from_entries(F.collect_list(F.struct("label", "predicted")))
    # One map entry per class.
    margins = classes.agg(support.alias("s"), predicted.alias("p"))
    s, p = margins.select("s").scalar(), margins.select("p").scalar()
    weighed = square.withColumns({"_w": weight, "_e": F.element_at(s, F.col(truth)) * F.element_at(p, F.col(pred))})
    sums = weighed.agg(
        F.sum(F.col("_w") * F.col("n")).alias("o"),
        F.sum(F.col("_w") * F.col("_e")).alias("e"),
        F.sum(F.when(F.col(truth) == F.col(pred), F.col("n")).otherwise(0)).alias("hit"),
    )
    o, e, hit = (sums.select(c).scalar() for c in ("o", "e", "hit"))
    n = F.col("n_rows")
    return scores.select(
        n, X.safe_divide(hit, n).alias("accuracy"), "macro_f1", "balanced_accuracy",
        F.when(e > 0, 1 - o * n / e).alias("quadratic_kappa"),
    )


def correlation(x: str | Column, y: str | Column) -> Column:
    """Pearson correlation over rows with both values; null when either side is constant."""
    both = X.col(x).isNotNull() & X.col(y).isNotNull()
    a, b = F.when(both, X.col(x)), F.when(both, X.col(y))
    spread = (F.min(a) != F.max(a)) & (F.min(b) != F.max(b))
    return F.when(spread, F.covar_pop(a, b) / (F.stddev_pop(a) * F.stddev_pop(b)))


def regression_summary(df: DataFrame, truth: str, pred: str) -> DataFrame:
    """MAE, RMSE, R2, Pearson, Spearman; correlations are null when a side is constant."""
    t, p = F.col(truth).cast("double"), F.col(pred).cast("double")
    ok = df.where(t.isNotNull() & p.isNotNull()).select(t.alias("x"), p.alias("y"))
    base = ok.agg(
        F.count(F.lit(1)).alias("n"),
        F.avg(F.abs(F.col("x") - F.col("y"))).alias("mae"),
        F.avg((F.col("x") - F.col("y")) * (F.col("x") - F.col("y"))).alias("_mse"),
        F.var_pop("x").alias("_var"),
        correlation("x", "y").alias("pearson"),
    )
    pairs = ok.groupBy("x", "y").agg(F.count(F.lit(1)).alias("w")).withColumn("_g", F.lit(0))
    rho = weighted_spearman(pairs, ["_g"]).select("spearman_rho")
    return base.select(
        "n", "mae", F.sqrt("_mse").alias("rmse"), F.when(F.col("_var") > 0, 1 - F.col("_mse") / F.col("_var")).alias("r2"), "pearson", rho.scalar().alias("spearman")
    )


def ranking_scores(df: DataFrame, truth: str, score: str, by: Sequence[str] = ()) -> DataFrame:
    """ROC-AUC and average precision per group; equal scores are one step; null unless both classes exist."""
    positive = F.sum((F.col(truth) == 1).cast("bigint"))
    r = R.value_ranks(df.where(F.col(truth).isNotNull()), list(by), score, {"pos": positive})
    neg, before_neg = F.col("n") - F.col("pos"), F.col("before") - F.col("before_pos")
    n_neg = F.col("total") - F.col("total_pos")
    won = F.col("pos") * (before_neg + neg / 2.0)
    at_least = F.col("total") - F.col("before")
    hits = F.col("total_pos") - F.col("before_pos")
    step = F.col("pos") * (hits / at_least)
    agg = r.groupBy(*by).agg(
        F.sum(won).alias("_w"), F.sum(step).alias("_s"), F.max("total_pos").alias("_p"), F.max(n_neg).alias("_n")
    )
    both = (F.col("_p") > 0) & (F.col("_n") > 0)
    return agg.select(
        *by,
        F.when(both, F.col("_w") / (F.col("_p").cast("double") * F.col("_n"))).alias("roc_auc"),
        F.when(both, F.col("_s") / F.col("_p")).alias("average_precision"),
    )


def binary_aggregates(truth: str, pred: str) -> list[Column]:
    t, p = F.col(truth) == 1, F.col(pred) == 1
    return [
        F.count(F.lit(1)).alias("n"),
        F.count_if(t & p).alias("tp"), F.count_if(~t & p).alias("fp"), F.count_if(t & ~p).alias("fn"), F.count_if(~t & ~p).alias("tn"),
    ]


def binary_ratios() -> dict[str, Column]:
    tp, fp, fn, tn = (F.col(c) for c in ("tp", "fp", "fn", "tn"))
    classes = (tp + fn > 0).cast("int") + (tn + fp > 0).cast("int")
    return {
        "accuracy": X.safe_divide(tp + tn, "n"),
        "balanced_accuracy": X.safe_divide(X.safe_divide(tp, tp + fn) + X.safe_divide(tn, tn + fp), classes),
        "precision": X.safe_divide(tp, tp + fp),
        "recall": X.safe_divide(tp, tp + fn),
        "f1": X.safe_divide(2 * tp, 2 * tp + fp + fn),
    }


def log_loss(truth: str, score: str, eps: float = 1e-15) -> Column:
    p = X.clip(score, eps, 1 - eps)
    return F.avg(F.when(F.col(truth) == 1, -F.log(p)).otherwise(-F.log(1 - p)))


def binary_report(df: DataFrame, truth: str, pred: str, score: str, by: Sequence[str] = ()) -> DataFrame:
    """Threshold scores, ranking scores and log-loss, overall or per group. Unlabelled rows are left out."""
    ok = df.where(F.col(truth).isNotNull())
    base = ok.groupBy(*by).agg(*binary_aggregates(truth, pred), log_loss(truth, score).alias("log_loss")).withColumns(binary_ratios())
    ranked = ranking_scores(ok, truth, score, by)
    if by:
        return base.join(ranked, list(by), "left")
    return base.withColumns({c: ranked.select(c).scalar() for c in ("roc_auc", "average_precision")})


def subset_report(df: DataFrame, subset: str, group: str, truth: str, pred: str, score: str, small: int = 30) -> DataFrame:
    """Scores per source subset with the failure rate, distinct groups, and a caution on few rows."""
    rep = binary_report(df, truth, pred, score, [subset])
    groups = df.where(F.col(truth).isNotNull()).groupBy(subset).agg(F.count_distinct(group).alias("n_groups"))
    return rep.join(groups, subset).withColumns(
        {"failure_rate": (F.col("tp") + F.col("fn")) / F.col("n"), "caution": F.when(F.col("n") < small, "small_n").otherwise("")}
    )


def baselines(df: DataFrame, truth: str) -> DataFrame:
    """Majority-class and prevalence rows to compare a classifier with."""
    rate = df.where(F.col(truth).isNotNull()).agg(F.avg(F.col(truth).cast("double")).alias("p"))
    rows = F.array(
        F.struct(
            F.lit("majority").alias("method"), F.when(F.col("p") >= 0.5, F.col("p")).otherwise(1 - F.col("p")).alias("accuracy"),
            F.lit(0.5).alias("balanced_accuracy"), F.lit(None).cast("double").alias("roc_auc"), F.lit(None).cast("double").alias("average_precision"),
        ),
        F.struct(
            F.lit("prevalence").alias("method"), F.lit(None).cast("double").alias("accuracy"), F.lit(None).cast("double").alias("balanced_accuracy"),
            F.lit(0.5).alias("roc_auc"), F.col("p").alias("average_precision"),
        ),
    )
    return rate.select(F.explode(rows).alias("r")).select("r.*")


def calibration_curve(df: DataFrame, truth: str, score: str, bins: int = 10) -> DataFrame:
    """Quantile bins of the score: observed rate, mean score, rows. A score on an inner edge goes to the upper bin."""
    ok = df.where(F.col(truth).isNotNull()).select(F.col(truth).cast("double").alias("y"), F.col(score).alias("p"))
    bounds = R.global_edges(ok, "p", bins, duplicates="drop")
    # Empty bins vanish in the grouping; the last bound belongs to the last bin.
    above = sum(((F.col("p") >= b).cast("int") for b in bounds[1:-1]), F.lit(0))
    return ok.groupBy(above.alias("bin")).agg(F.avg("y").alias("observed"), F.avg("p").alias("mean_score"), F.count(F.lit(1)).alias("n"))


def brier(df: DataFrame, truth: str, score: str) -> DataFrame:
    return df.where(F.col(truth).isNotNull()).agg(F.avg(F.pow(F.col(score) - F.col(truth), 2)).alias("brier"), F.count(F.lit(1)).alias("n"))


def histogram(df: DataFrame, value: str, low: float, high: float, bins: int) -> DataFrame:
    """Equal-width counts, last bin closed on the right; zero bins kept."""
    v = F.col(value)
    b = F.least(F.floor((v - low) / ((high - low) / bins)), F.lit(bins - 1)).cast("int")
    counts = df.where((v >= low) & (v <= high)).groupBy(b.alias("bin")).agg(F.count(F.lit(1)).alias("n"))
    every = df.sparkSession.range(bins).select(F.col("id").cast("int").alias("bin"))
    return every.join(counts, "bin", "left").na.fill(0, ["n"])


def quality_trend(df: DataFrame, quality: str, score: str, bins: int = 20) -> DataFrame:
    """Median quality and mean score per equal-frequency quality bin, equal edges dropped."""
    ok = df.where(F.col(quality).isNotNull()).select(F.col(quality).cast("double").alias("x"), F.col(score).alias("p"))
    binned = ok.withColumn("bin", R.bucket_by("x", R.global_edges(ok, "x", bins, duplicates="drop")))
    centre = R.exact_quantiles(binned, ["bin"], "x", {"centre": 0.5})
    return centre.join(binned.groupBy("bin").agg(F.avg("p").alias("mean_score")), "bin")


def _numbers(df: DataFrame, *columns: str) -> DataFrame:
    """NaN is missing."""
    return df.withColumns({c: F.when(R.present(df, c), F.col(c)) for c in columns})


def prediction_summary(df: DataFrame, target: str, prediction: str, score: str, label: str, split: str) -> DataFrame:
    """Key/value rows: rows, rows per split, correlation, score mean and population std, label counts."""
    df = _numbers(df, target, prediction, score)
    one = df.agg(
        F.count(F.lit(1)).cast("double").alias("n_rows"),
        correlation(F.col(target).cast("double"), F.col(prediction).cast("double")).alias("target_prediction_corr"),
        F.avg(score).alias("score_mean"),
        F.stddev_pop(score).alias("score_std"),
    )
    base = one.unpivot([], one.columns, "key", "value")
    for c, name in ((split, "rows"), (label, "label")):
        counts = df.where(F.col(c).isNotNull()).groupBy(c).agg(F.count(F.lit(1)).cast("double").alias("value"))
        base = base.unionByName(counts.select(F.concat(F.lit(f"{name}_"), F.col(c).cast("string")).alias("key"), "value"))
    return base


def inference_summary(df: DataFrame, score: str, label: str, artifact: str) -> DataFrame:
    """One row: score spread, label counts, and the artifact when it is the same everywhere."""
    df = _numbers(df, score)
    return df.agg(
        F.count(F.lit(1)).alias("n_rows"), F.avg(score).alias("score_mean"), F.stddev_pop(score).alias("score_std"),
        F.min(score).alias("score_min"), F.max(score).alias("score_max"),
        F.count_if(F.col(label) == 0).alias("n_label_0"), F.count_if(F.col(label) == 1).alias("n_label_1"),
        F.when(F.min(artifact) == F.max(artifact), F.max(artifact)).alias("artifact"),
    )


def compare_classifiers(rows: DataFrame, name: str, first: str, second: str) -> DataFrame:
    return rows.orderBy(F.desc(first), F.desc(second), F.asc(name))
