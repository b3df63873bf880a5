"""Classifier, regression and calibration queries over labelled documents."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import scalars as X
from ..operators import metrics as M
from . import views as V
from .registry import query, rounded, rounded_sql

_T = "with " + V.V_TARGET + ", t as (select * from v_target where target is not null)"


@query(
    "a31_confusion",
    _T + " select a as target, b as predicted, (select count(*) from t where target = a and predicted = b) as n from range(0, 2) x(a), range(0, 2) y(b)"
    .replace("select a as", "select cast(a as int) as").replace("b as predicted", "cast(b as int) as predicted"),
)
def confusion(spark, sf):
    return M.confusion(V.targets(spark, sf), "target", "predicted", [0, 1])


_CLS = _T + """, c as (select cast(k as int) as label, (select count(*) from t where target = k) as support, (select count(*) from t where predicted = k) as predicted, (select count(*) from t where target = k and predicted = k) as tp from range(0, 2) r(k)),
 pc as (select label, support, predicted, case when predicted > 0 then tp / predicted else 0 end as precision, case when support > 0 then tp / support else 0 end as recall, case when support + predicted > 0 then 2 * tp / (support + predicted) else 0 end as f1, tp from c)"""


@query("a31_per_class", rounded_sql(_CLS + "\n--body\nselect * exclude (tp) from pc", "precision recall f1"))
def per_class(spark, sf):
    return rounded(M.per_class(M.confusion(V.targets(spark, sf), "target", "predicted", [0, 1]), "target", "predicted", [0, 1]))


@query(
    "a31_classification_summary",
    rounded_sql(
        _CLS + """
--body
select cast(sum(support) as bigint) as n_rows, sum(tp) / sum(support) as accuracy, avg(f1) as macro_f1, avg(recall) as balanced_accuracy,
 1 - (select count(*) from t where target <> predicted) * sum(support) / (max(support) filter (where label = 0) * max(predicted) filter (where label = 1) + max(support) filter (where label = 1) * max(predicted) filter (where label = 0)) as quadratic_kappa from pc""",
        "accuracy macro_f1 balanced_accuracy quadratic_kappa",
    ),
)
def classification_summary(spark, sf):
    return rounded(M.classification_summary(M.confusion(V.targets(spark, sf), "target", "predicted", [0, 1]), "target", "predicted", [0, 1]))


_RANK = "(rank() over (order by {c}) + (count(*) over (partition by {c}) - 1) / 2.0::double)"


@query(
    "a32_regression_summary",
    rounded_sql(
        f"""with r as (select l_extendedprice as x, l_quantity * 2000.0::double as y, {_RANK.format(c='l_extendedprice')} as a, {_RANK.format(c='l_quantity')} as b from lineitem)
--body
select count(*) as n, round(avg(abs(x - y)), 3) as mae, round(sqrt(avg((x - y) * (x - y))), 3) as rmse, 1 - avg((x - y) * (x - y)) / var_pop(x) as r2, corr(x, y) as pearson, corr(a, b) as spearman from r""",
        "mae rmse r2 pearson spearman", 5,
    ),
)
def regression_summary(spark, sf):
    df = V.table(spark, sf, "lineitem").select(F.col("l_extendedprice").alias("x"), (F.col("l_quantity") * 2000.0).alias("y"))
    # Errors are tens of thousands here: a double's last digits depend on the order of the sum.
    return rounded(M.regression_summary(df, "x", "y").withColumns({c: F.round(c, 3) for c in ("mae", "rmse")}), 5)


def _binary_sql(by: str = ""):
    g, grp = (f"{by}, ", f" group by {by}") if by else ("", "")
    key = f"and u.{by} = t.{by}" if by else ""
    return f"""{_T}, s as (select t.*, (select count(*) from t u where u.target = 0 and u.score < t.score {key}) + 0.5 * (select count(*) from t u where u.target = 0 and u.score = t.score {key}) as won,
 (select count(*) from t u where u.target = 1 and u.score >= t.score {key}) / (select count(*) from t u where u.score >= t.score {key}) as prec from t),
 b as (select {g}count(*) as n, count(*) filter (where target = 1 and predicted = 1) as tp, count(*) filter (where target = 0 and predicted = 1) as fp, count(*) filter (where target = 1 and predicted = 0) as fn, count(*) filter (where target = 0 and predicted = 0) as tn,
  avg(case when target = 1 then -ln(least(greatest(score, 1e-15), 1 - 1e-15)) else -ln(1 - least(greatest(score, 1e-15), 1 - 1e-15)) end) as log_loss,
  case when min(target) <> max(target) then sum(won) filter (where target = 1) / (count(*) filter (where target = 1) * count(*) filter (where target = 0)) end as roc_auc,
  case when min(target) <> max(target) then avg(prec) filter (where target = 1) end as average_precision from s{grp}),
 f as (select *, (tp + tn) / n as accuracy, (case when tp + fn > 0 then tp / (tp + fn) else 0 end + case when tn + fp > 0 then tn / (tn + fp) else 0 end) / (cast(tp + fn > 0 as int) + cast(tn + fp > 0 as int)) as balanced_accuracy,
  case when tp + fp > 0 then tp / (tp + fp) else 0 end as precision, case when tp + fn > 0 then tp / (tp + fn) else 0 end as recall, case when 2 * tp + fp + fn > 0 then 2 * tp / (2 * tp + fp + fn) else 0 end as f1 from b)"""


_BIN = "log_loss roc_auc average_precision accuracy balanced_accuracy precision recall f1"


@query("a33_binary_report", rounded_sql(_binary_sql() + "\n--body\nselect * from f", _BIN))
def binary_report(spark, sf):
    return rounded(M.binary_report(V.targets(spark, sf), "target", "predicted", "score"))


@query(
    "a34_subset_report",
    rounded_sql(
        _binary_sql("source") + "\n--body\nselect f.*, (select count(distinct lang) from t where t.source = f.source) as n_groups, (tp + fn) / n as failure_rate, case when n < 30 then 'small_n' else '' end as caution from f",
        _BIN + " failure_rate",
    ),
)
def subset_report(spark, sf):
    return rounded(M.subset_report(V.targets(spark, sf), "source", "lang", "target", "predicted", "score"))


@query(
    "a35_baselines",
    rounded_sql(
        _T + "\n--body\nselect 'majority' as method, case when avg(target) >= 0.5 then avg(target) else 1 - avg(target) end as accuracy, 0.5::double as balanced_accuracy, null::double as roc_auc, null::double as average_precision from t union all select 'prevalence', null, null, 0.5, avg(target) from t",
        "accuracy roc_auc average_precision",
    ),
)
def baselines(spark, sf):
    return rounded(M.baselines(V.targets(spark, sf), "target"))


_EDGES = ", ".join(f"quantile_cont(score, {i / 10}) as e{i}" for i in range(1, 10))


@query(
    "a36_calibration_curve",
    rounded_sql(
        _T + f", e as (select {_EDGES} from t)\n--body\nselect cast({' + '.join(f'cast(score >= e{i} as int)' for i in range(1, 10))} as int) as bin, avg(target::double) as observed, avg(score) as mean_score, count(*) as n from t, e group by 1",
        "observed mean_score",
    ),
)
def calibration_curve(spark, sf):
    return rounded(M.calibration_curve(V.targets(spark, sf), "target", "score"))


@query("a36_brier", rounded_sql(_T + "\n--body\nselect avg((score - target) * (score - target)) as brier, count(*) as n from t", "brier"))
def brier(spark, sf):
    return rounded(M.brier(V.targets(spark, sf), "target", "score"))


@query("a36_histogram", "with " + V.V_TARGET + " select cast(k as int) as bin, (select count(*) from v_target where least(floor(score / 0.1), 9) = k) as n from range(0, 10) r(k)")
def histogram(spark, sf):
    return M.histogram(V.targets(spark, sf), "score", 0.0, 1.0, 10)


_TE = ", ".join(f"quantile_cont(n_chars::double, {i / 20}) as e{i}" for i in range(1, 20))


@query(
    "a37_quality_trend",
    rounded_sql(
        "with " + V.V_TARGET + f", e as (select {_TE} from v_target)\n--body\nselect cast(1 + {' + '.join(f'cast(n_chars > e{i} as int)' for i in range(1, 20))} as int) as bin, median(n_chars::double) as centre, count(*) as n, avg(score) as mean_score from v_target, e group by 1",
        "centre mean_score",
    ),
)
def quality_trend(spark, sf):
    return rounded(M.quality_trend(V.targets(spark, sf), "n_chars", "score"))


@query(
    "a25_prediction_summary",
    rounded_sql(
        "with " + V.V_TARGET + """
--body
select 'n_rows' as "key", count(*)::double as "value" from v_target union all select 'target_prediction_corr', corr(target, predicted) from v_target union all select 'score_mean', avg(score) from v_target union all select 'score_std', stddev_pop(score) from v_target
 union all select concat('rows_', lang), count(*) from v_target group by lang union all select concat('label_', predicted), count(*) from v_target group by predicted""",
        '"value"',
    ),
)
def prediction_summary(spark, sf):
    return rounded(M.prediction_summary(V.targets(spark, sf), "target", "predicted", "score", "predicted", "lang"))


@query(
    "a26_inference_summary",
    rounded_sql(
        "with " + V.V_TARGET + "\n--body\nselect count(*) as n_rows, avg(score) as score_mean, stddev_pop(score) as score_std, min(score) as score_min, max(score) as score_max, count(*) filter (where predicted = 0) as n_label_0, count(*) filter (where predicted = 1) as n_label_1, case when min(source) = max(source) then max(source) end as artifact from v_target",
        "score_mean score_std",
    ),
)
def inference_summary(spark, sf):
    return rounded(M.inference_summary(V.targets(spark, sf), "score", "predicted", "source"))


@query("a38_classifier_comparison", rounded_sql(_binary_sql("lang") + "\n--body\nselect lang, roc_auc, balanced_accuracy from f", "roc_auc balanced_accuracy"))
def classifier_comparison(spark, sf):
    rep = M.binary_report(V.targets(spark, sf), "target", "predicted", "score", ["lang"]).select("lang", "roc_auc", "balanced_accuracy")
    return rounded(M.compare_classifiers(rep, "lang", "roc_auc", "balanced_accuracy"))


@query(
    "x19_score_complement",
    rounded_sql("with " + V.V_TARGET + "\n--body\nselect doc_id, least(greatest(score * 1.2 - 0.1, 0), 1) as failure, 1 - least(greatest(score * 1.2 - 0.1, 0), 1) as quality from v_target", "failure quality"),
)
def score_complement(spark, sf):
    p = X.clip(F.col("score") * 1.2 - 0.1, 0.0, 1.0)
    return rounded(V.targets(spark, sf).select("doc_id", p.alias("failure"), (1 - p).alias("quality")))
