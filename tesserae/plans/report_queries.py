"""Manifest, join and report queries over the fact table."""

from __future__ import annotations

from pyspark.sql import Window, functions as F

from ..functions import scalars as X
from ..operators import dedupe as D, joins as J, ranks as R, reports as P
from ..operators.spread import spread_join
from . import views as V
from .registry import query, rounded, rounded_sql

_SUM_COLS = [f"{m}_{s}" for m in V.METRICS for s in ("mean", "std", "q1", "median", "q3", "iqr")]
_SUM_SQL = ", ".join(
    f"avg({m}) as {m}_mean, stddev_samp({m}) as {m}_std, quantile_cont({m}, 0.25) as {m}_q1, median({m}) as {m}_median,"
    f" quantile_cont({m}, 0.75) as {m}_q3, quantile_cont({m}, 0.75) - quantile_cont({m}, 0.25) as {m}_iqr"
    for m in V.METRICS
)
V_SUMMARY = V.V_MATCHED + f""", v_summary as (
 select model_name, count(*) as n_compared_matched, {_SUM_SQL},
  (select count(*) from v_raw r where r.model_name = v_matched.model_name and r.status = 'ok') as n_evaluated_raw
 from v_matched group by model_name)
, v_place as (select *, cast(row_number() over (order by instance_pq_median desc, instance_pq_mean desc, model_name) as int) as place from v_summary)"""


def _summary(spark, sf, metrics=V.METRICS, facts=None):
    facts = facts if facts is not None else V.matched_table(spark, sf)
    raw = V.eval_raw(spark, sf).where("status = 'ok'").groupBy("model_name").agg(F.count(F.lit(1)).alias("n_evaluated_raw"))
    return P.leaderboard(P.metric_summary(facts, "model_name", metrics, raw), "model_name", "instance_pq")


@query(
    "a01_metric_summary",
    rounded_sql("with " + V_SUMMARY + f"\n--body\nselect model_name, place, n_evaluated_raw, n_compared_matched, {', '.join(_SUM_COLS)} from v_place", " ".join(_SUM_COLS)),
)
def metric_summary(spark, sf):
    return rounded(_summary(spark, sf).select("model_name", "place", "n_evaluated_raw", "n_compared_matched", *_SUM_COLS))


_A02 = ["instance_rq_mean", "instance_rq_median", "instance_rq_std", "instance_rq_iqr", "pixel_recall_mean", "pixel_recall_iqr"]


@query("a02_error_profile", rounded_sql("with " + V_SUMMARY + f"\n--body\nselect model_name, {', '.join(_A02)} from v_place", " ".join(_A02)))
def error_profile(spark, sf):
    return rounded(_summary(spark, sf).select("model_name", *_A02))


@query(
    "a03_win_counts",
    rounded_sql(
        "with " + V_SUMMARY + """, best as (select arg_min(model_name, (-instance_pq, place)) as model_name from v_matched join (select model_name, place from v_place) using (model_name) group by patch_id)
--body
select p.model_name, p.place, count(b.model_name) as win_count, 100.0::double * count(b.model_name) / (select count(*) from best) as win_percentage
from v_place p left join best b on b.model_name = p.model_name group by p.model_name, p.place""",
        "win_percentage",
    ),
)
def win_counts(spark, sf):
    facts = V.matched_table(spark, sf)
    return rounded(P.win_counts(facts, "patch_id", "model_name", "instance_pq", _summary(spark, sf, ["instance_pq"], facts)))


_PAIR = "with " + V.V_MATCHED + """, pairs as (select a.model_name as model_a, b.model_name as model_b,
 count(*) filter (where a.instance_pq > b.instance_pq) as a_beats_b_count, count(*) filter (where a.instance_pq < b.instance_pq) as b_beats_a_count,
 count(*) filter (where a.instance_pq = b.instance_pq) as tie_count, 100.0::double * count(*) filter (where a.instance_pq > b.instance_pq) / count(*) as a_beats_b_percentage
 from v_matched a join v_matched b on a.patch_id = b.patch_id and a.model_name <> b.model_name group by 1, 2)"""


def _pairs(spark, sf):
    wide = P.wide_by_model(V.eval_ok(spark, sf), "patch_id", "model_name", V.MODELS, ["instance_pq"])
    return P.pairwise_wins(wide, {m: f"instance_pq__{m}" for m in V.MODELS})


@query("a04_pairwise_wins", rounded_sql(_PAIR + "\n--body\nselect * from pairs", "a_beats_b_percentage"))
def pairwise_wins(spark, sf):
    return rounded(_pairs(spark, sf))


@query(
    "a04_pairwise_matrix",
    rounded_sql(
        _PAIR + "\n--body\nselect model_a, " + ", ".join(f"max(a_beats_b_percentage) filter (where model_b = '{m}') as vs_{m}" for m in V.MODELS) + " from pairs group by model_a",
        " ".join(f"vs_{m}" for m in V.MODELS),
    ),
)
def pairwise_matrix(spark, sf):
    return rounded(P.pairwise_matrix(_pairs(spark, sf), V.MODELS))


_A05M = ("instance_pq", "instance_rq", "pixel_precision")
_A05 = [f"{m}__{k}" for m in _A05M for k in V.MODELS]


@query(
    "a05_consensus_pivot",
    rounded_sql(
        "with " + V.V_OK + "\n--body\nselect patch_id, "
        + ", ".join(f"max({m}) filter (where model_name = '{k}') as {m}__{k}" for m in _A05M for k in V.MODELS) + ", "
        + ", ".join(f"median({m}) as {m}_median, count({m}) as {m}_model_count" for m in _A05M)
        + " from v_ok group by patch_id",
        " ".join([*_A05, *[f"{m}_median" for m in _A05M]]),
    ),
)
def consensus_pivot(spark, sf):
    return rounded(P.consensus_pivot(V.eval_ok(spark, sf), "patch_id", "model_name", V.MODELS, _A05M))


@query(
    "a06_first_non_null",
    rounded_sql(
        "with " + V.V_RAW + """
--body
select patch_id, arg_min(case when l_linenumber > 2 then instance_pq end, (l_orderkey, l_linenumber, l_suppkey, l_extendedprice)) filter (where l_linenumber > 2) as instance_pq,
 arg_min(model_name, (l_orderkey, l_linenumber, l_suppkey, l_extendedprice)) as model_name from v_raw group by patch_id""",
        "instance_pq",
    ),
)
def first_non_null(spark, sf):
    df = V.eval_raw(spark, sf).withColumn("instance_pq", F.when(F.col("l_linenumber") > 2, F.col("instance_pq")))
    return rounded(D.first_non_null_per_key(df, ["patch_id"], ["instance_pq", "model_name"], V.ORDER))


@query(
    "a07_varying_keys",
    "with " + V.V_RAW + """ select 'status' as "column", count(*) filter (where s > 1) as n_varying from (select count(distinct status) s from v_raw group by patch_id)
 union all select 'model_name', count(*) filter (where s > 1) from (select count(distinct model_name) s from v_raw group by patch_id)
 union all select 'patch_id', 0""",
)
def varying_keys(spark, sf):
    df = V.eval_raw(spark, sf).withColumn("k", F.col("patch_id"))
    return D.varying_keys(df, ["k"], ["status", "model_name", "patch_id"])


_A08 = rounded_sql(
    "with " + V.V_OK + """, v as (select *, case when instance_rq > 0 then instance_pq end as t from v_ok)
--body
select patch_id, median(t) as target, count(*) as model_row_count, count(distinct model_name) as model_count, count(t) as models_with_target,
 concat('["', array_to_string(list_sort(list(distinct model_name)), '","'), '"]') as model_names from v group by patch_id""",
    "target",
)


def _targets(spark, sf):
    return P.patch_targets(
        V.eval_ok(spark, sf).withColumn("t", F.when(F.col("instance_rq") > 0, F.col("instance_pq"))), "patch_id", "model_name", "t"
    )


@query("a08_patch_targets", _A08)
def patch_targets(spark, sf):
    return rounded(_targets(spark, sf))


@query(
    "a09_coverage_filter",
    "with " + V.V_OK + """, v as (select patch_id, count(distinct model_name) as mc, count(case when instance_rq > 0 then instance_pq end) as ct from v_ok group by patch_id)
 select count(*) as n_before, count(*) filter (where mc <> 4) as n_incomplete, count(*) filter (where ct = 0) as n_missing_target, count(*) filter (where mc = 4 and ct > 0) as n_kept from v""",
)
def coverage_filter(spark, sf):
    return P.coverage_filter(_targets(spark, sf), V.eval_ok(spark, sf), "model_name")[1]


_FEATURES = ("foreground_fraction", "mean_area", "count_total")
_MEAS = ("consensus_pq", *V.MODELS)


def _avg_rank(c: str, part: str = "") -> str:
    p = f"partition by {part} " if part else ""
    return f"(rank() over ({p}order by {c}) + (count(*) over (partition by {part + ', ' if part else ''}{c}) - 1) / 2.0::double)"


def _spearman_sql():
    parts = []
    for f in _FEATURES:
        for m in _MEAS:
            parts.append(
                f"select '{f}' as feature, '{m}' as metric, count(*) as n, corr(a, b) as spearman_rho from (select {_avg_rank(f)} as a, {_avg_rank(m)} as b from v_wide where {f} is not null)"
            )
    return "with " + V.V_WIDE + "\n--body\n" + " union all ".join(parts)


@query("a10_spearman", rounded_sql(_spearman_sql(), "spearman_rho"))
def spearman(spark, sf):
    return rounded(P.spearman(V.wide_patches(spark, sf), _FEATURES, _MEAS))


@query(
    "a10_spearman_matrix",
    rounded_sql(
        "with s as (" + _spearman_sql().replace("\n--body\n", "\n").replace("with ", "with ", 1) + ")\n--body\nselect feature, "
        + ", ".join(f"max(spearman_rho) filter (where metric = '{m}') as {m}" for m in _MEAS) + " from s group by feature",
        " ".join(_MEAS),
    ),
)
def spearman_matrix(spark, sf):
    return rounded(P.matrix(P.spearman(V.wide_patches(spark, sf), _FEATURES, _MEAS), "feature", "metric", _MEAS, "spearman_rho"))


def _bucket_case(x: str, edges: list[str]) -> str:
    return "case " + " ".join(f"when {x} <= {e} then {i + 1}" for i, e in enumerate(edges)) + f" else {len(edges) + 1} end"


def _buckets_sql():
    parts = []
    for f in ("foreground_fraction", "mean_area"):
        for m in _MEAS:
            parts.append(
                f"select '{f}' as feature, b as bucket, '{m}' as metric, median({m}) as median, avg({m}) as mean, count({m}) as n from "
                f"(select v_wide.*, cast({_bucket_case(f, ['q1', 'q2', 'q3'])} as int) as b from v_wide, (select quantile_cont({f}, 0.25) q1, quantile_cont({f}, 0.5) q2, quantile_cont({f}, 0.75) q3 from v_wide) where {f} is not null) group by b"
            )
    return "with " + V.V_WIDE + "\n--body\n" + " union all ".join(parts)


@query("a11_bucket_report", rounded_sql(_buckets_sql(), "median mean"))
def bucket_report(spark, sf):
    return rounded(P.bucket_report(V.wide_table(spark, sf), ("foreground_fraction", "mean_area"), _MEAS))


_A12M = ("instance_pq", "instance_rq", "instance_sq", "pixel_precision", "pixel_recall")
_A12 = "with " + V.V_OK + ", " + V.V_MANIFEST + """, v_long as (select v_ok.*, foreground_fraction from v_ok left join v_manifest using (patch_id)),
 e as (select min(foreground_fraction) q0, quantile_cont(foreground_fraction, 0.25) q1, quantile_cont(foreground_fraction, 0.5) q2, quantile_cont(foreground_fraction, 0.75) q3, max(foreground_fraction) q4 from v_long)"""


def _long_density(spark, sf):
    return V.eval_ok(spark, sf).join(V.manifest(spark, sf).select("patch_id", "foreground_fraction"), "patch_id", "left")


@query(
    "a12_stratified_medians",
    rounded_sql(
        _A12 + f"\n--body\nselect model_name, bucket, {', '.join(f'median({m}) as {m}_median' for m in _A12M)} from (select v_long.*, cast({_bucket_case('foreground_fraction', ['q1', 'q2', 'q3'])} as int) as bucket from v_long, e) group by 1, 2",
        " ".join(f"{m}_median" for m in _A12M),
    ),
)
def stratified_medians(spark, sf):
    return rounded(P.stratified_medians(_long_density(spark, sf), "model_name", "foreground_fraction", _A12M)[0])


@query(
    "a12_strata_bounds",
    rounded_sql(
        _A12 + "\n--body\nselect 1 as bucket, q0 as lower_bound, q1 as upper_bound from e union all select 2, q1, q2 from e union all select 3, q2, q3 from e union all select 4, q3, q4 from e",
        "lower_bound upper_bound",
    ),
)
def strata_bounds(spark, sf):
    return rounded(P.stratified_medians(_long_density(spark, sf), "model_name", "foreground_fraction", _A12M)[1])


def _composition_sql():
    skel = "(values " + ", ".join(f"('{v}', {i})" for i, v in enumerate(V.RICH_ORDER)) + ") s(richness_label, label_order)"
    parts = [
        f"select s.richness_label, label_order, '{m}' as metric, median({m}) as median, avg({m}) as mean, count(v_wide.patch_id) as patch_count from {skel} left join v_wide on v_wide.richness_label = s.richness_label group by 1, 2"
        for m in _MEAS
    ]
    return "with " + V.V_WIDE + "\n--body\n" + " union all ".join(parts)


@query("a13_composition_report", rounded_sql(_composition_sql(), "median mean"))
def composition_report(spark, sf):
    return rounded(P.composition_report(V.wide_table(spark, sf), "richness_label", V.RICH_ORDER, _MEAS))


@query(
    "a13_composition_matrix",
    rounded_sql(
        "with c as (" + _composition_sql().replace("\n--body\n", "\n") + ")\n--body\nselect richness_label, "
        + ", ".join(f"max(median) filter (where metric = '{m}') as {m}" for m in _MEAS) + " from c group by 1",
        " ".join(_MEAS),
    ),
)
def composition_matrix(spark, sf):
    rep = P.composition_report(V.wide_table(spark, sf), "richness_label", V.RICH_ORDER, _MEAS)
    return rounded(P.matrix(rep, "richness_label", "metric", _MEAS, "median"))


_W = [*V.MODELS, "tie"]
_A14 = "with " + V.V_WIDE + """, won as (select richness_label, case when cast(m0 = g as int) + cast(m1 = g as int) + cast(m2 = g as int) + cast(m3 = g as int) > 1 then 'tie'
 when m0 = g then 'm0' when m1 = g then 'm1' when m2 = g then 'm2' else 'm3' end as winner from (select *, greatest(m0, m1, m2, m3) as g from v_wide)),
 counts as (select s.richness_label, """ + ", ".join(f"count(*) filter (where winner = '{w}') as {w}" for w in _W) + " from (values " + ", ".join(f"('{v}')" for v in V.RICH_ORDER) + ") s(richness_label) left join won using (richness_label) group by 1)"


def _winners(spark, sf):
    return P.winner_counts(V.wide_patches(spark, sf), "richness_label", V.RICH_ORDER, {m: m for m in V.MODELS})


@query("a14_winner_counts", _A14 + " select * from counts")
def winner_counts(spark, sf):
    return _winners(spark, sf)


@query(
    "a14_winner_percentages",
    rounded_sql(
        _A14 + "\n--body\nselect richness_label, " + ", ".join(f"case when m0+m1+m2+m3+tie > 0 then 100.0::double * {w} / (m0+m1+m2+m3+tie) end as {w}" for w in _W) + " from counts",
        " ".join(_W),
    ),
)
def winner_percentages(spark, sf):
    return rounded(P.winner_percentages(_winners(spark, sf), "richness_label", _W))


@query("a14_winner_long", _A14 + " select * from (unpivot counts on m0, m1, m2, m3, tie into name winner value count)")
def winner_long(spark, sf):
    return P.winner_long(_winners(spark, sf), "richness_label", _W)


@query(
    "a15_missingness",
    rounded_sql(
        "with " + V.V_TARGET + """
--body
select * from (select 'target' as "column", count(*) filter (where target is null) as missing_count, count(*) filter (where target is null) / count(*) as missing_fraction from v_target
 union all select 'toxic', count(*) filter (where toxic is null), count(*) filter (where toxic is null) / count(*) from v_target) where missing_count > 0""",
        "missing_fraction",
    ),
)
def missingness(spark, sf):
    return rounded(P.missingness(V.targets(spark, sf)))


@query(
    "a16_duplicate_counts",
    "with " + V.V_RAW + """ select cast(sum(n) as bigint) as n_rows, count(*) as n_keys, cast(sum(n - 1) as bigint) as n_extra, cast(coalesce(sum(n) filter (where n > 1), 0) as bigint) as n_in_duplicates
 from (select count(*) n from v_raw group by patch_id, model_name)""",
)
def duplicate_counts(spark, sf):
    return D.duplicate_counts(V.eval_raw(spark, sf), ["patch_id", "model_name"])


@query(
    "a17_source_composition",
    rounded_sql(
        "with " + V.V_COMP + "\n--body\n" + " union all ".join(
            f"""select source, '{c}' as class, count(*) as n_patches, cast(sum(count_total) as bigint) as n_cells, sum(count_total) / count(*) as mean_cells_per_patch,
 cast(sum({c}) as bigint) as class_total, sum({c}) / sum(count_total) as class_fraction, avg(cast({c} > 0 as int)) as presence_rate from v_comp group by source"""
            for c in V.CLASSES
        ),
        "mean_cells_per_patch class_fraction presence_rate",
    ),
)
def source_composition(spark, sf):
    return rounded(P.source_composition(V.composition(spark, sf), "source", V.CLASSES))


@query(
    "a18_total_mismatches",
    "with " + V.V_COMP + " select count(*) filter (where count_total - (sample_id % 3 = 0)::int <> epithelial + lymphocyte + connective + neutrophil + plasma) as n_mismatched, count(*) as n_rows from v_comp",
)
def total_mismatches(spark, sf):
    df = V.composition(spark, sf).withColumn("count_total", F.col("count_total") - (F.col("sample_id") % 3 == 0).cast("int"))
    return P.total_mismatches(df, "count_total", V.CLASSES)


@query(
    "a39_major_categories",
    "with " + V.V_LABEL + " select dominant_class, count(*) as n from v_label group by 1 having count(*) >= 30 order by n desc, dominant_class limit 4",
)
def major_categories(spark, sf):
    return P.major_categories(V.composition_labels(spark, sf), "dominant_class")


_A40 = "with " + V.V_LABEL + """, c as (select source, richness_label, count(*) as n from v_label group by 1, 2),
 p as (select source, richness_label, n, cast(sum(n) over (partition by source) as bigint) as cluster_size, n / sum(n) over (partition by source) as purity, n * n / sum(n) over (partition by source) as score from c)"""


@query("a40_label_purity", rounded_sql(_A40 + "\n--body\nselect * from p", "purity score"))
def label_purity(spark, sf):
    return rounded(P.label_purity(V.composition_labels(spark, sf), "source", "richness_label"))


@query("a40_best_cluster", rounded_sql(_A40 + "\n--body\nselect richness_label, arg_min(source, (-score, source)) as source, max(score) as score from p group by 1", "score"))
def best_cluster(spark, sf):
    return rounded(P.best_label_cluster(P.label_purity(V.composition_labels(spark, sf), "source", "richness_label"), "source", "richness_label"))


# ---- windows ----


@query(
    "w01_average_rank",
    "with " + V.V_OK + f" select distinct model_name, instance_sq, {_avg_rank('instance_sq', 'model_name')} as rank from v_ok",
)
def average_rank(spark, sf):
    r = R.value_ranks(V.eval_ok(spark, sf), ["model_name"], "instance_sq")
    return r.select("model_name", "instance_sq", R.average_rank().alias("rank"))


_W02 = "select patch_id, model_name, l_orderkey, l_linenumber, l_suppkey, l_extendedprice from "


@query("w02_keep_first", "with " + V.V_OK + " " + _W02 + "v_ok")
def keep_first(spark, sf):
    return V.eval_ok(spark, sf).select("patch_id", "model_name", *V.ORDER)


@query(
    "w02_keep_last",
    "with " + V.V_RAW + " " + _W02 + """(select *, row_number() over (partition by patch_id, model_name order by l_orderkey desc, l_linenumber desc, l_suppkey desc, l_extendedprice desc) as rn
 from v_raw where status = 'ok') where rn = 1""",
)
def keep_last(spark, sf):
    return D.last_per_key(V.eval_raw(spark, sf).where("status = 'ok'"), ["patch_id", "model_name"], V.ORDER).select("patch_id", "model_name", *V.ORDER)


@query(
    "w03_quantile_bucket",
    "with " + V.V_OK + f""", e as (select model_name, quantile_cont(pixel_precision, 0.25) q1, quantile_cont(pixel_precision, 0.5) q2, quantile_cont(pixel_precision, 0.75) q3 from v_ok group by 1)
 select patch_id, model_name, cast({_bucket_case('pixel_precision', ['q1', 'q2', 'q3'])} as int) as bucket from v_ok join e using (model_name)""",
)
def quantile_bucket(spark, sf):
    facts = V.eval_ok(spark, sf).select("patch_id", "model_name", "pixel_precision")
    edges = R.quantile_edges(facts, ["model_name"], "pixel_precision", 4).drop("n")
    return spread_join(facts, edges, ["model_name"]).select("patch_id", "model_name", R.bucket_of("pixel_precision", "edges", 4).alias("bucket"))


@query(
    "w04_conflicting_keys",
    "with " + V.V_RAW + " select patch_id, cast(sum(c) as bigint) as n_rows, count(*) as n_variants from (select patch_id, model_name, status, count(*) c from v_raw group by all) group by 1 having count(*) > 1",
)
def conflicting_keys(spark, sf):
    return D.conflicting_keys(V.eval_raw(spark, sf), ["patch_id"], ["model_name", "status"])


@query(
    "w05_keep_largest",
    "with " + V.V_RAW + """ select patch_id, model_name, n, l_orderkey, l_linenumber from (select *, row_number() over (partition by patch_id, model_name order by n desc nulls last, l_orderkey, l_linenumber, l_suppkey, l_extendedprice) as rn
 from (select *, case when status = 'ok' then cast(round(instance_sq * 50) as bigint) end as n from v_raw)) where rn = 1""",
)
def keep_largest(spark, sf):
    df = V.eval_raw(spark, sf).withColumn("n", F.when(F.col("status") == "ok", F.round(F.col("instance_sq") * 50).cast("bigint")))
    return D.keep_largest(df, ["patch_id", "model_name"], "n", V.ORDER).select("patch_id", "model_name", "n", "l_orderkey", "l_linenumber")


@query(
    "w06_ecdf",
    "with " + V.V_MATCHED + " select model_name, instance_pq, round(row_number() over (partition by model_name order by instance_pq) / count(*) over (partition by model_name), 9) as ecdf from v_matched",
)
def ecdf(spark, sf):
    return P.ecdf(V.eval_matched(spark, sf), ["model_name"], "instance_pq").withColumn("ecdf", F.round("ecdf", 9))


@query(
    "w08_top_two_gap",
    rounded_sql("with " + V.V_WIDE + "\n--body\nselect patch_id, list_reverse_sort([m0, m1, m2, m3])[1] - list_reverse_sort([m0, m1, m2, m3])[2] as gap from v_wide", "gap"),
)
def top_two_gap(spark, sf):
    return rounded(V.wide_patches(spark, sf).select("patch_id", X.top_two_gap(V.MODELS).alias("gap")))
