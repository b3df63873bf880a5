"""Training stages: thresholds and classes come from the train side alone, one model is fitted on it, all rows are kept.

`df` holds a `split` of 'train' and 'test' (see `learn.grouped_split`), one row per key. `make(n_rows, n_classes)` or
`make(scale)` gives the estimator for what the train side turned out to hold, so penalties follow the data. A train side
without rows is an error, as is one that holds a single class.

A fit reads its rows many times, so the columns that a stage needs are written once before it looks at them.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence
from typing import NamedTuple

from pyspark.ml import Estimator, PipelineModel
from pyspark.sql import Column, DataFrame, functions as F

from ..functions.scalars import ordinal_label
from . import learn as L, ranks as R
from ..session import materialise
from .joins import JoinError
from .manifests import hard_rows

TRAIN = "split = 'train'"


class Stage(NamedTuple):
    model: PipelineModel
    data: DataFrame  # key, split, target, features; `weight` for classes
    classes: list[str]  # name of target i; empty for a continuous target
    cuts: list[float]  # thresholds of the target, from train rows

    def predictions(self, keep: Sequence[str]) -> DataFrame:
        """All rows with their target and prediction, classes with their probabilities."""
        if self.classes:
            return L.predict_classes(self.model, self.data, keep)
        return L.predict_regression(self.model, self.data, keep)


def _needed(df: DataFrame, key: str, *columns: str | None) -> DataFrame:
    """The rows that have `columns[0]`, written, with the named columns only."""
    kept = [c for c in dict.fromkeys([key, "split", "fold", *columns]) if c in df.columns]
    return materialise(df.where(R.present(df, columns[0])).select(*kept))


def _quantiles(df: DataFrame, target: str, probs: Sequence[float]) -> list[float]:
    row = R.exact_quantiles(df.where(TRAIN), [], target, {f"q{i}": p for i, p in enumerate(probs)}).first()
    if row is None or row["q0"] is None:
        raise JoinError("no train rows with a target")
    return [row[f"q{i}"] for i in range(len(probs))]


def continuous_stage(
    df: DataFrame, key: str, target: str, make: Callable[[tuple[int, float]], Estimator], numeric: Sequence[str] = (), categorical: Sequence[str] = (),
    embedding: str | None = None, pca: int | None = None, forbidden: Sequence[str] = (),
) -> Stage:
    """A regression of `target`; rows without a target (null or NaN) take no part."""
    known = _needed(df, key, target, *numeric, *categorical, embedding).withColumn("target", F.col(target).cast("double"))
    data = L.feature_frame(known, key, "target", embedding, [*numeric, *categorical], [target, *forbidden])
    train = data.where(TRAIN)
    scale = L.target_scale(train)
    if not scale[0]:
        raise JoinError("no train rows with a target")
    return Stage(L.fit(train, L.preprocessing(numeric, categorical, bool(embedding), pca), make(scale)), data, [], [])


def _classes(
    rows: DataFrame, key: str, label: Column, names: Sequence[str], cuts: list[float], make: Callable[[int, int], Estimator],
    numeric: Sequence[str], categorical: Sequence[str], embedding: str | None, pca: int | None, forbidden: Sequence[str],
) -> Stage:
    named = rows.withColumn("_label", label)
    # At most one row per name.
    seen = {r[0] for r in named.where(TRAIN).where(F.col("_label").isin(list(names))).select("_label").distinct().collect()}
    held = [n for n in names if n in seen]
    if len(held) < 2:
        raise JoinError(f"the train side holds {len(held)} classes")
    # Classes are numbered without gaps; rows of a class that the train side lacks cannot be judged and go.
    index = (F.array_position(F.array(*[F.lit(n) for n in held]), F.col("_label")) - 1).cast("double")
    coded = named.where(F.col("_label").isin(held)).withColumn("target", index)
    data = L.feature_frame(coded, key, "target", embedding, [*numeric, *categorical], forbidden)
    data = materialise(L.balanced_weights(data, data.where(TRAIN)))
    train = data.where(TRAIN)
    model = L.fit(train, L.preprocessing(numeric, categorical, bool(embedding), pca), make(train.count(), len(held)))
    return Stage(model, data, held, cuts)


def ordinal_stage(
    df: DataFrame, key: str, target: str, make: Callable[[int, int], Estimator], names: Sequence[str] = ("hard", "medium", "easy"), numeric: Sequence[str] = (),
    categorical: Sequence[str] = (), embedding: str | None = None, pca: int | None = None, forbidden: Sequence[str] = (),
) -> Stage:
    """Equal shares of the train targets, right-closed, as ordered classes; test rows are cut by the same thresholds."""
    known = _needed(df, key, target, *numeric, *categorical, embedding)
    cuts = _quantiles(known, target, [i / len(names) for i in range(1, len(names))])
    return _classes(known, key, ordinal_label(target, cuts, names), names, cuts, make, numeric, categorical, embedding, pca, [target, *forbidden])


def mode_stage(
    df: DataFrame, key: str, metric: str, mode: str, modes: Sequence[str], quantile: float, min_count: int, make: Callable[[int, int], Estimator],
    numeric: Sequence[str] = (), categorical: Sequence[str] = (), embedding: str | None = None, pca: int | None = None, forbidden: Sequence[str] = (),
) -> Stage:
    """The failure mode of hard rows: those at or below the train quantile of `metric`, of modes with enough hard train rows."""
    known = _needed(df, key, metric, mode, *numeric, *categorical, embedding)
    cuts = _quantiles(known, metric, [quantile])
    hard = hard_rows(known.withColumn("_train", F.expr(TRAIN)), metric, mode, "_train", quantile, min_count, cuts[0]).where("retained")
    return _classes(hard, key, F.col(mode), modes, cuts, make, numeric, categorical, embedding, pca, [metric, mode, *forbidden])
