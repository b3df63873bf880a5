"""Benchmark reports over a patch x model fact table."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window, functions as F

from ..functions import scalars as X
from ..session import materialise
from . import ranks as R


def _melt(df: DataFrame, ids: Sequence[str], metrics: Sequence[str], name: str = "metric", value: str = "value") -> DataFrame:
    cast = df.select(*ids, *[F.col(m).cast("double").alias(m) for m in metrics])
    return cast.unpivot(list(ids), list(metrics), name, value)


def grouped_quantiles(df: DataFrame, by: Sequence[str], metrics: Sequence[str], probs: Mapping[str, float]) -> DataFrame:
    """Exact quantiles of several metrics in one pass: columns `<metric>_<name>` per group."""
    long = R.exact_quantiles(_melt(df, by, metrics), [*by, "metric"], "value", probs)
    return long.groupBy(*by).agg(
        *[F.max(F.when(F.col("metric") == m, F.col(p))).alias(f"{m}_{p}") for m in metrics for p in probs]
    )


def metric_summary(facts: DataFrame, model: str, metrics: Sequence[str], raw_counts: DataFrame | None = None) -> DataFrame:
    """Per model: counts, then mean, median, sample std, q1, q3 and IQR of each metric, without nulls and NaN."""
    held = {m: F.when(R.present(facts, m), F.col(m)) for m in metrics}
    moments = facts.groupBy(model).agg(
        F.count(F.lit(1)).alias("n_compared_matched"),
        *[F.avg(held[m]).alias(f"{m}_mean") for m in metrics],
        *[F.stddev_samp(held[m]).alias(f"{m}_std") for m in metrics],
    )
    quants = grouped_quantiles(facts, [model], metrics, {"q1": 0.25, "median": 0.5, "q3": 0.75})
    out = moments.join(quants, model)
    for m in metrics:
        out = out.withColumn(f"{m}_iqr", F.col(f"{m}_q3") - F.col(f"{m}_q1"))
    if raw_counts is not None:
        out = out.join(raw_counts, model, "left")
    return out


def leaderboard(summary: DataFrame, model: str, metric: str) -> DataFrame:
    """Summary with `place`: by median then mean, highest first, name as the last tie-break.

    The window spans one row per model.
    """
    w = Window.orderBy(F.desc(f"{metric}_median"), F.desc(f"{metric}_mean"), F.asc(model))
    return summary.withColumn("place", F.row_number().over(w))


def wide_by_model(facts: DataFrame, key: str, model: str, models: Sequence[str], metrics: Sequence[str], complete: bool = True) -> DataFrame:
    """One row per key with `<metric>__<model>` columns; one aggregation for all metrics."""
    cols = [(f"{m}__{k}", m, k) for m in metrics for k in models]
    wide = facts.groupBy(key).agg(*[F.max(F.when(F.col(model) == k, F.col(m))).alias(n) for n, m, k in cols])
    if complete:
        for n, _, _ in cols:
            wide = wide.where(F.col(n).isNotNull())
    return wide


def win_counts(facts: DataFrame, key: str, model: str, metric: str, order: DataFrame, place: str = "place") -> DataFrame:
    """Keys won per model (highest metric; ties to the better placed model), zero rows kept.

    A missing metric (null or NaN) does not take part.
    """
    ranked = facts.select(key, model, metric).where(F.col(metric).isNotNull() & ~F.isnan(F.col(metric).cast("double"))).join(order.select(model, place), model)
    best = ranked.groupBy(key).agg(F.min_by(model, F.struct(-F.col(metric), F.col(place))).alias(model))
    won = best.groupBy(model).agg(F.count(F.lit(1)).alias("win_count"))
    n_keys = best.agg(F.count(F.lit(1))).scalar()
    return order.select(model, place).join(won, model, "left").select(
        model,
        place,
        F.coalesce("win_count", F.lit(0)).alias("win_count"),
        (F.lit(100.0) * F.coalesce("win_count", F.lit(0)) / n_keys).alias("win_percentage"),
    )


def pairwise_wins(wide: DataFrame, columns: Mapping[str, str]) -> DataFrame:
    """All ordered model pairs from one aggregation over the wide table (no self-join)."""
    pairs = [(a, b) for a in columns for b in columns if a != b]
    aggs = [F.count(F.lit(1)).alias("n")]
    for i, (a, b) in enumerate(pairs):
        aggs.append(F.count_if(F.col(columns[a]) > F.col(columns[b])).alias(f"w{i}"))
        aggs.append(F.count_if(F.col(columns[a]) < F.col(columns[b])).alias(f"l{i}"))
    rows = F.array(
        *[
            F.struct(F.lit(a).alias("model_a"), F.lit(b).alias("model_b"), F.col(f"w{i}").alias("w"), F.col(f"l{i}").alias("l"))
            for i, (a, b) in enumerate(pairs)
        ]
    )
    return wide.agg(*aggs).select("n", F.explode(rows).alias("r")).select(
        "r.model_a",
        "r.model_b",
        F.col("r.w").alias("a_beats_b_count"),
        F.col("r.l").alias("b_beats_a_count"),
        (F.col("n") - F.col("r.w") - F.col("r.l")).alias("tie_count"),
        (F.lit(100.0) * F.col("r.w") / F.col("n")).alias("a_beats_b_percentage"),
    )


def pairwise_matrix(pairs: DataFrame, models: Sequence[str]) -> DataFrame:
    return pairs.groupBy("model_a").agg(
        *[F.max(F.when(F.col("model_b") == m, F.col("a_beats_b_percentage"))).alias(f"vs_{m}") for m in models]
    )


def consensus_pivot(facts: DataFrame, key: str, model: str, models: Sequence[str], metrics: Sequence[str]) -> DataFrame:
    """Per key: `<metric>__<model>`, `<metric>_median` over present models and `<metric>_model_count`."""
    wide = wide_by_model(facts, key, model, models, metrics, complete=False)
    for m in metrics:
        cols = [f"{m}__{k}" for k in models]
        wide = wide.withColumn(f"{m}_median", X.row_median(cols)).withColumn(
            f"{m}_model_count", F.size(X.sorted_present(cols)).cast("bigint")
        )
    return wide


def patch_targets(facts: DataFrame, key: str, model: str, target: str, how: str = "median") -> DataFrame:
    """Patch-level target across models. A patch has one row per model, so its group is a model list. NaN is missing."""
    facts = facts.withColumn(target, F.when(R.present(facts, target), F.col(target)))
    agg = {"median": F.median, "mean": F.avg}[how](F.col(target))
    return facts.groupBy(key).agg(
        agg.alias("target"),
        F.count(F.lit(1)).alias("model_row_count"),
        F.size(F.collect_set(model)).cast("bigint").alias("model_count"),
        F.count(target).alias("models_with_target"),
        F.to_json(F.array_sort(F.collect_set(model))).alias("model_names"),
    )


def coverage_filter(targets: DataFrame, facts: DataFrame, model: str, complete: bool = True) -> tuple[DataFrame, DataFrame]:
    """(kept rows, one-row report): rows with a target, and with every model when `complete`."""
    n_models = facts.select(model).distinct().agg(F.count(F.lit(1))).scalar()
    full = F.col("model_count") == n_models
    has = F.col("target").isNotNull()
    report = targets.agg(
        F.count(F.lit(1)).alias("n_before"),
        F.count_if(~full).alias("n_incomplete"),
        F.count_if(~has).alias("n_missing_target"),
        F.count_if((full if complete else F.lit(True)) & has).alias("n_kept"),
    )
    return targets.where((full if complete else F.lit(True)) & has), report


def spearman(df: DataFrame, features: Sequence[str], metrics: Sequence[str], together: bool = True) -> DataFrame:
    """Spearman rho of every feature and metric, average ranks, null when either side is constant.

    Nulls and NaN are dropped per feature over the feature and all metrics (`together`), or per pair. All pairs run
    in one plan: pairs are collapsed to distinct (x, y) counts, ranked per pair, and correlated by weight.
    """
    items = []
    for f in features:
        present = F.lit(True)
        for m in metrics:
            present = present & R.present(df, m)
        for m in metrics:
            ok = R.present(df, f) & (present if together else R.present(df, m))
            items.append(
                F.when(ok, F.struct(F.lit(f).alias("feature"), F.lit(m).alias("metric"), F.col(f).cast("double").alias("x"), F.col(m).cast("double").alias("y")))
            )
    pairs = (
        df.select(F.explode(F.array(*items)).alias("p")).where(F.col("p").isNotNull()).select("p.*")
        .groupBy("feature", "metric", "x", "y").agg(F.count(F.lit(1)).alias("w"))
    )
    # Read four times below: written once to the shared folder rather than recomputed.
    return weighted_spearman(materialise(pairs), ["feature", "metric"])


def weighted_spearman(pairs: DataFrame, by: Sequence[str]) -> DataFrame:
    """Spearman from distinct (x, y) lines carrying their row count `w`."""
    ranked = pairs
    for v in ("x", "y"):
        spread = pairs.select(*by, F.col(v), "w")
        lines = _weighted_ranks(spread, by, v)
        ranked = R.attach_by_value(ranked, lines.withColumnRenamed("rank", f"r{v}"), by, v, [f"r{v}"])
    w = F.col("w")
    sums = ranked.groupBy(*by).agg(
        F.sum("w").alias("n"),
        (F.sum(w * F.col("rx")) / F.sum(w)).alias("mx"),
        *[F.sum(w * F.col(a) * F.col(b)).alias(f"s{a}{b}") for a, b in (("rx", "rx"), ("ry", "ry"), ("rx", "ry"))],
    )
    # Mean rank is (n + 1) / 2 on both sides, so the centred sums need no second pass.
    centre = F.col("n") * F.pow((F.col("n") + 1) / 2.0, 2)
    vx, vy, cxy = F.col("srxrx") - centre, F.col("sryry") - centre, F.col("srxry") - centre
    return sums.select(*by, F.col("n"), F.when((vx > 0) & (vy > 0), cxy / (F.sqrt(vx) * F.sqrt(vy))).alias("spearman_rho"))


def _weighted_ranks(lines: DataFrame, by: Sequence[str], v: str) -> DataFrame:
    r = R.value_ranks(lines, by, v, {"w": F.sum("w")})
    return r.select(*by, v, F.col("w").alias("n"), (F.col("before_w") + (F.col("w") + 1) / 2.0).alias("rank"))


def bucket_report(df: DataFrame, features: Sequence[str], metrics: Sequence[str], q: int = 4) -> DataFrame:
    """Per feature, equal-frequency bucket and metric: median, mean, count. Nulls and NaN dropped per feature."""
    present = F.lit(True)
    for m in metrics:
        present = present & R.present(df, m)
    long = _melt(df.where(present), metrics, features, "feature", "x")
    long = long.where(R.present(long, "x"))
    edges = R.quantile_edges(long, ["feature"], "x", q).drop("n")
    # One row per feature name: as small as the argument list.
    bucketed = long.join(F.broadcast(edges), "feature").select("feature", R.bucket_of("x", "edges", q).alias("bucket"), *metrics)
    return grouped_stats(bucketed, ["feature", "bucket"], metrics)


def grouped_stats(df: DataFrame, by: Sequence[str], metrics: Sequence[str]) -> DataFrame:
    """Long (group, metric) rows with median, mean and count, all from the same counted values."""
    keys = [*by, "metric"]
    r = R.value_ranks(_melt(df, by, metrics), keys, "value", {"s": F.sum("value")})
    stats = r.groupBy(*keys).agg(
        *R.quantile_columns({"median": 0.5}, "value"), (F.max("total_s") / F.max("total")).alias("mean"), F.max("total").alias("n")
    )
    return stats


def stratified_medians(facts: DataFrame, by: str, strata: str, metrics: Sequence[str], q: int = 4) -> tuple[DataFrame, DataFrame]:
    """(medians per group and stratum bucket, bucket bounds); edges come from the long rows as they are."""
    facts = facts.where(R.present(facts, strata))
    bounds = R.global_edges(facts, strata, q)
    bucketed = facts.withColumn("bucket", R.bucket_by(strata, bounds)).where(F.col("bucket").isNotNull())
    med = grouped_quantiles(bucketed, [by, "bucket"], metrics, {"median": 0.5})
    rows = [(i + 1, lo, hi) for i, (lo, hi) in enumerate(zip(bounds, bounds[1:]))]
    return med, facts.sparkSession.createDataFrame(rows, "bucket int, lower_bound double, upper_bound double")


def composition_report(df: DataFrame, label: str, labels: Sequence[str], metrics: Sequence[str]) -> DataFrame:
    """Label x metric skeleton with median, mean and patch count; labels without rows stay."""
    spark = df.sparkSession
    stats = grouped_stats(df.where(F.col(label).isin(*labels)), [label], metrics)
    counts = df.groupBy(label).agg(F.count(F.lit(1)).alias("patch_count"))
    skeleton = (
        spark.createDataFrame([(i, v) for i, v in enumerate(labels)], f"label_order int, {label} string")
        .withColumn("metric", F.explode(F.array(*[F.lit(m) for m in metrics])))
    )
    return (
        skeleton.join(stats.drop("n"), [label, "metric"], "left")
        .join(counts, label, "left")
        .select(label, "label_order", "metric", "median", "mean", F.coalesce("patch_count", F.lit(0)).alias("patch_count"))
    )


def matrix(df: DataFrame, row: str, column: str, columns: Sequence[str], value: str) -> DataFrame:
    return df.groupBy(row).agg(*[F.max(F.when(F.col(column) == c, F.col(value))).alias(c) for c in columns])


def winner_counts(df: DataFrame, label: str, labels: Sequence[str], columns: Mapping[str, str]) -> DataFrame:
    """Label rows x (models + tie): how often each is the unique maximum, zero-filled, all labels kept."""
    names = [*columns, "tie"]
    won = df.select(label, X.unique_winner(list(columns.values()), list(columns)).alias("winner"))
    counts = won.groupBy(label).agg(*[F.count_if(F.col("winner") == n).alias(n) for n in names])
    skeleton = df.sparkSession.createDataFrame([(v,) for v in labels], f"{label} string")
    return skeleton.join(counts, label, "left").na.fill(0, names)


def winner_percentages(counts: DataFrame, label: str, names: Sequence[str]) -> DataFrame:
    total = sum((F.col(n) for n in names), F.lit(0))
    return counts.select(label, *[F.when(total > 0, F.col(n) / total * 100.0).alias(n) for n in names])


def winner_long(counts: DataFrame, label: str, names: Sequence[str], value: str = "count") -> DataFrame:
    return counts.unpivot([label], list(names), "winner", value)


def missingness(df: DataFrame, columns: Sequence[str] | None = None) -> DataFrame:
    """Columns with missing values: count and fraction."""
    columns = list(columns or df.columns)
    doubles = {n for n, t in df.dtypes if t in ("double", "float")}
    miss = [(F.col(c).isNull() | F.isnan(c)) if c in doubles else F.col(c).isNull() for c in columns]
    one = df.agg(F.count(F.lit(1)).alias("_n"), *[F.count_if(m).alias(c) for m, c in zip(miss, columns)])
    return (
        one.unpivot(["_n"], columns, "column", "missing_count")
        .where(F.col("missing_count") > 0)
        .select("column", "missing_count", (F.col("missing_count") / F.col("_n")).alias("missing_fraction"))
    )


def source_composition(df: DataFrame, source: str, classes: Sequence[str]) -> DataFrame:
    """Per source: patches, cells, cells per patch; per class: total, share and presence rate."""
    total = sum((F.coalesce(F.col(c), F.lit(0)) for c in classes), F.lit(0))
    one = df.groupBy(source).agg(
        F.count(F.lit(1)).alias("n_patches"),
        F.sum(total).alias("n_cells"),
        *[F.sum(c).alias(f"t_{c}") for c in classes],
        *[F.avg((F.col(c) > 0).cast("double")).alias(f"p_{c}") for c in classes],
    )
    rows = F.array(*[F.struct(F.lit(c).alias("class"), F.col(f"t_{c}").alias("t"), F.col(f"p_{c}").alias("p")) for c in classes])
    return one.select(source, "n_patches", "n_cells", F.explode(rows).alias("r")).select(
        source,
        F.col("r.class").alias("class"),
        "n_patches",
        "n_cells",
        (F.col("n_cells") / F.col("n_patches")).alias("mean_cells_per_patch"),
        F.col("r.t").alias("class_total"),
        X.safe_divide("r.t", "n_cells").alias("class_fraction"),
        F.col("r.p").alias("presence_rate"),
    )


def total_mismatches(df: DataFrame, total: str, classes: Sequence[str]) -> DataFrame:
    s = sum((F.coalesce(X.number_or_null(c), F.lit(0.0)) for c in classes), F.lit(0.0))
    t = X.number_or_null(total)
    return df.agg(F.count_if(t.isNotNull() & (t != s)).alias("n_mismatched"), F.count(F.lit(1)).alias("n_rows"))


def major_categories(df: DataFrame, category: str, minimum: int = 30, k: int = 4) -> DataFrame:
    """The k most frequent categories with at least `minimum` rows."""
    counts = df.groupBy(category).agg(F.count(F.lit(1)).alias("n")).where(F.col("n") >= minimum)
    return counts.orderBy(F.desc("n"), F.asc(category)).limit(k)


def label_purity(df: DataFrame, cluster: str, label: str) -> DataFrame:
    """Share of each label within its cluster, and count x purity as the selection score."""
    counts = df.groupBy(cluster, label).agg(F.count(F.lit(1)).alias("n"))
    size = df.groupBy(cluster).agg(F.count(F.lit(1)).alias("cluster_size"))
    return counts.join(size, cluster).select(
        cluster, label, "n", "cluster_size",
        (F.col("n") / F.col("cluster_size")).alias("purity"),
        (F.col("n") * F.col("n") / F.col("cluster_size")).alias("score"),
    )


def best_label_cluster(purity: DataFrame, cluster: str, label: str) -> DataFrame:
    best = F.struct(-F.col("score"), F.col(cluster))
    return purity.groupBy(label).agg(F.min_by(cluster, best).alias(cluster), F.max("score").alias("score"))


def ecdf(df: DataFrame, by: Sequence[str], value: str, chunk: int = 100_000) -> DataFrame:
    """Row-wise empirical CDF: the k-th smallest of N rows gets k/N; equal values get consecutive steps.

    Runs of equal values are expanded in chunks that are spread before the second expansion.
    """
    r = R.value_ranks(df, by, value)
    parts = r.select(
        *by, value, "before", "n", "total",
        F.explode(F.sequence(F.lit(0).cast("bigint"), F.col("n") - 1, F.lit(chunk).cast("bigint"))).alias("_from"),
    )
    spread = parts.repartition(*by, value, "_from")
    step = F.explode(F.sequence(F.col("_from") + 1, F.least(F.col("_from") + chunk, F.col("n"))))
    return spread.select(*by, value, "before", "total", step.alias("_k")).select(
        *by, value, ((F.col("before") + F.col("_k")) / F.col("total")).alias("ecdf")
    )
