"""Median and mode imputation as a pipeline stage, fitted on whatever rows the pipeline is fitted on."""

from __future__ import annotations

import json
from collections.abc import Sequence

from pyspark import keyword_only
from pyspark.ml import Estimator, Model
from pyspark.ml.param import Param, Params, TypeConverters
from pyspark.ml.util import DefaultParamsReadable, DefaultParamsWritable
from pyspark.sql import DataFrame, functions as F

from . import ranks as R


class _Columns(Params):
    numeric = Param(Params._dummy(), "numeric", "numeric columns; <name>_num is added", TypeConverters.toListString)
    categorical = Param(Params._dummy(), "categorical", "categorical columns; <name>_cat is added", TypeConverters.toListString)

    def __init__(self):
        super().__init__()
        self._setDefault(numeric=[], categorical=[])


class Imputer(Estimator, _Columns, DefaultParamsReadable, DefaultParamsWritable):
    """Exact interpolated medians and the most frequent values (ties: the smallest), NaN counting as missing.

    Medians of all columns come from one pass of range-split ranks, so no column has to fit a task. Columns
    without any value get 0 and `missing`.
    """

    @keyword_only
    def __init__(self, numeric: Sequence[str] = (), categorical: Sequence[str] = ()):
        super().__init__()
        self._set(**{k: list(v) for k, v in self._input_kwargs.items()})

    def _fit(self, df: DataFrame) -> ImputerModel:
        numeric, categorical = self.getOrDefault(self.numeric), self.getOrDefault(self.categorical)
        fills: dict[str, float | str] = {}
        if numeric:
            long = df.select(*[F.col(c).cast("double").alias(c) for c in numeric]).unpivot([], list(numeric), "c", "v")
            medians = {r["c"]: r["m"] for r in R.exact_quantiles(long, ["c"], "v", {"m": 0.5}).collect()}
            fills |= {c: float(medians.get(c) or 0.0) for c in numeric}
        if categorical:
            long = df.select(*[F.col(c).cast("string").alias(c) for c in categorical]).unpivot([], list(categorical), "c", "v").where("v is not null")
            counts = long.groupBy("c", "v").agg(F.count(F.lit(1)).alias("n"))
            # The largest count wins; of several, the smallest value.
            top = counts.groupBy("c").agg(F.max("n").alias("n"))
            modes = {r["c"]: r["v"] for r in counts.join(top, ["c", "n"]).groupBy("c").agg(F.min("v").alias("v")).collect()}
            fills |= {c: modes.get(c, "missing") for c in categorical}
        return ImputerModel()._set(numeric=numeric, categorical=categorical, fills=json.dumps(fills))


class ImputerModel(Model, _Columns, DefaultParamsReadable, DefaultParamsWritable):
    fills = Param(Params._dummy(), "fills", "value of each column for missing ones, as JSON", TypeConverters.toString)

    def values(self) -> dict[str, float | str]:
        return json.loads(self.getOrDefault(self.fills))

    def _transform(self, df: DataFrame) -> DataFrame:
        fills, added = self.values(), {}
        for c in self.getOrDefault(self.numeric):
            value = F.col(f"`{c}`").cast("double")
            added[f"{c}_num"] = F.coalesce(F.nanvl(value, F.lit(None).cast("double")), F.lit(fills[c]))
        for c in self.getOrDefault(self.categorical):
            added[f"{c}_cat"] = F.coalesce(F.col(f"`{c}`").cast("string"), F.lit(fills[c]))
        return df.withColumns(added)
