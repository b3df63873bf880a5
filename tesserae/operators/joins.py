"""Validated joins: one-to-one checks, coverage gates, back-fills, key discovery, path resolution."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window, functions as F

from ..functions import keys as K
from .dedupe import duplicate_keys, first_per_key

MODEL_LIMIT = 10_000


class JoinError(ValueError):
    """A join broke its declared contract."""


def require_columns(df: DataFrame, columns: Sequence[str], context: str) -> None:
    missing = [c for c in columns if c not in df.columns]
    if missing:
        raise JoinError(f"{context} is missing required columns: {', '.join(missing)}")


def require_unique(df: DataFrame, key: Sequence[str], context: str) -> None:
    sample = duplicate_keys(df, key).limit(5).collect()
    if sample:
        raise JoinError(f"{context} has duplicate keys, e.g. {[r.asDict() for r in sample]}")


def one_row_per_key(df: DataFrame, key: Sequence[str], context: str) -> DataFrame:
    """The rows of df; a key that comes twice is an error when the rows are read.

    The count rides on the key's own shuffle, which a following join on that key uses too, so the check costs no
    extra job and no extra exchange. Null keys are keys here, as they are where tables are merged.
    """
    n = F.count(F.lit(1)).over(Window.partitionBy(*key))
    message = F.concat(F.lit(f"{context} has duplicate keys, e.g. "), F.to_json(F.struct(*key)))
    return df.withColumn("_n", n).where(F.when(F.col("_n") == 1, F.lit(True)).otherwise(F.raise_error(message).cast("boolean"))).drop("_n")


def blank_counts(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """One row with the number of null or blank values per column."""
    return df.agg(*[F.count_if(K.is_blank(c)).alias(c) for c in columns])


def require_present(df: DataFrame, columns: Sequence[str], context: str) -> None:
    bad = {c: n for c, n in blank_counts(df, columns).first().asDict().items() if n}
    if bad:
        raise JoinError(f"{context} has blank required values: {bad}")


def model_names(df: DataFrame, model: str) -> Column:
    """Sorted distinct model names as a scalar array (a name list, not data)."""
    names = df.select(model).distinct().agg(F.array_sort(F.collect_set(model)).alias("m"))
    checked = F.when(F.size("m") <= MODEL_LIMIT, F.col("m")).otherwise(F.raise_error(F.lit("too many models")).cast("array<string>"))
    return names.select(checked).scalar()


def attach_targets(
    manifest: DataFrame, facts: DataFrame, key: str, model: str, metrics: Sequence[str], fact_key: str | None = None
) -> DataFrame:
    """Every manifest row for every model, with the model's metrics where the key matches and a `matched` flag.

    Both sides are checked as they are joined: one manifest row per key, one fact per (key, model). Facts with a null
    key or model match nothing and are not checked; see `first_per_key` for tables with repeats.
    """
    fact_key = fact_key or key
    grid = one_row_per_key(manifest.where(F.col(key).isNotNull()), [key], "manifest").unionByName(manifest.where(F.col(key).isNull()))
    grid = grid.withColumn(model, F.explode(model_names(facts, model)))
    right = facts.where(F.col(fact_key).isNotNull() & F.col(model).isNotNull()).select(F.col(fact_key).alias(key), model, *metrics, F.lit(True).alias("matched"))
    right = one_row_per_key(right, [key, model], "evaluation table")
    return grid.join(right, [key, model], "left").withColumn("matched", F.coalesce("matched", F.lit(False)))


def target_coverage(joined: DataFrame, facts: DataFrame, manifest: DataFrame, key: str, model: str) -> DataFrame:
    """Per model: manifest rows, matched rows, coverage, unmatched on both sides."""
    left = joined.groupBy(model).agg(
        F.count(F.lit(1)).alias("manifest_rows"),
        F.count_if("matched").alias("matched_rows"),
        (F.count_if("matched") / F.count(F.lit(1))).alias("coverage"),
        F.count_if(~F.col("matched")).alias("unmatched_manifest"),
    )
    extra = facts.join(manifest.select(key), key, "left_anti").groupBy(model).agg(F.count_distinct(key).alias("unmatched_eval"))
    return left.join(extra, model, "left").withColumn("unmatched_eval", F.coalesce("unmatched_eval", F.lit(0)))


def require_coverage(coverage: DataFrame, model: str, minimum: float) -> None:
    bad = coverage.where((F.col("coverage") < minimum) | (F.col("matched_rows") == 0)).limit(5).collect()
    if bad:
        raise JoinError(f"coverage below {minimum}: {[(r[model], r['coverage']) for r in bad]}")


def score_join_keys(facts: DataFrame, manifest: DataFrame, manifest_key: str, candidates: Sequence[str]) -> DataFrame:
    """Every candidate column and spelling with the distinct keys it matches; the best one comes first.

    A column's values are made distinct before they are spelled, so that no task holds the spellings of repeated
    values. A key is one row for all columns and spellings that lead to it; these are bits of a number.
    """
    present = [c for c in candidates if c in facts.columns]
    if not present:
        raise JoinError("no supported join column is present")
    columns = F.array(*[F.struct(F.lit(i).alias("at"), K.text(c).alias("v")) for i, c in enumerate(present)])
    values = facts.select(F.explode(columns).alias("e")).select("e.*").where(F.col("v") != "").distinct()
    spelled = K.join_key_variants("v")
    position = F.col("at") * len(spelled) + F.col("j")
    # A number holds 63 bits; further spellings are in further words.
    word, bit = F.floor(position / 63).cast("int"), F.call_function("shiftleft", F.lit(1).cast("bigint"), position % 63)
    keys = (
        values.select("at", F.posexplode(F.array(*spelled.values())).alias("j", "k")).where(F.col("k") != "")
        .select("k", word.alias("word"), bit.alias("bits")).groupBy("k", "word").agg(F.bit_or("bits").alias("bits"))
    )
    known = manifest.select(K.text(manifest_key).alias("k")).distinct().withColumn("hit", F.lit(1))
    counts = keys.join(known, "k", "left").groupBy("word", "bits").agg(F.count("hit").alias("n_matched"), F.count(F.lit(1)).alias("n_keys"))
    named = F.array(*[
        F.struct(F.lit(i * len(spelled) + j).alias("position"), F.lit(c).alias("join_column"), F.lit(name).alias("variant"))
        for i, c in enumerate(present) for j, name in enumerate(spelled)
    ])
    of_bits = F.filter(named, lambda n: F.when(F.floor(n["position"] / 63) == F.col("word"), F.call_function("getbit", F.col("bits"), n["position"] % 63) == 1).otherwise(F.lit(False)))
    found = (
        counts.select("n_matched", "n_keys", F.explode(of_bits).alias("n")).groupBy("n.position", "n.join_column", "n.variant")
        .agg(F.sum("n_matched").alias("n_matched"), F.sum("n_keys").alias("n_keys"))
    )
    return found.orderBy(F.desc("n_matched"), F.desc("n_keys"), F.asc("position"))


def discover_join_key(facts: DataFrame, manifest: DataFrame, manifest_key: str, candidates: Sequence[str]) -> tuple[str, str]:
    best = score_join_keys(facts, manifest, manifest_key, candidates).first()
    if best is None or best["n_matched"] == 0:
        raise JoinError("no join column matches the manifest keys")
    return best["join_column"], best["variant"]


def merge_coalesced(left: DataFrame, right: DataFrame, on: Sequence[str], how: str = "inner", keep_both: Sequence[str] = ()) -> DataFrame:
    """Join two tables one to one; overlapping columns take the left value first. Columns in `keep_both` also keep the right one.

    A key that comes twice on either side is an error when the result is read.
    """
    left, right = one_row_per_key(left, on, "left table"), one_row_per_key(right, on, "right table")
    overlap = [c for c in left.columns if c in right.columns and c not in on]
    renamed = right.withColumnsRenamed({c: f"_r_{c}" for c in overlap})
    joined = left.join(renamed, list(on), how)
    out = [F.col(k) for k in on]
    out += [F.coalesce(F.col(c), F.col(f"_r_{c}")).alias(c) if c in overlap else F.col(c) for c in left.columns if c not in on]
    out += [F.col(f"_r_{c}").alias(f"right_{c}") for c in keep_both if c in overlap]
    out += [F.col(c) for c in right.columns if c not in left.columns]
    return joined.select(*out)


def unmatched_counts(left: DataFrame, right: DataFrame, on: Sequence[str]) -> DataFrame:
    """Distinct keys found on one side only, from one pass over both key sets."""
    both = (
        left.select(*on).withColumn("_l", F.lit(1)).withColumn("_r", F.lit(0))
        .unionByName(right.select(*on).withColumn("_l", F.lit(0)).withColumn("_r", F.lit(1)))
        .groupBy(*on).agg(F.max("_l").alias("_l"), F.max("_r").alias("_r"))
    )
    return both.agg(
        F.count_if(F.col("_r") == 0).alias("left_only"),
        F.count_if(F.col("_l") == 0).alias("right_only"),
        F.count_if((F.col("_l") == 1) & (F.col("_r") == 1)).alias("both"),
    )


def shared_column_mismatches(left: DataFrame, right: DataFrame, on: Sequence[str], columns: Sequence[str]) -> DataFrame:
    """Rows per shared column whose values differ (null equals null). Rows: column, n_mismatched."""
    r = right.select(*on, *[F.col(c).alias(f"_r_{c}") for c in columns])
    one = left.select(*on, *columns).join(r, list(on)).agg(
        *[F.count_if(~F.col(c).eqNullSafe(F.col(f"_r_{c}"))).alias(c) for c in columns]
    )
    return one.unpivot([], list(columns), "column", "n_mismatched")


def matched_keys(df: DataFrame, key: str, model: str, n_models: int | Column) -> DataFrame:
    """Keys seen with every model."""
    n = n_models if isinstance(n_models, Column) else F.lit(n_models)
    return df.groupBy(key).agg(F.count_distinct(model).alias("_m")).where(F.col("_m") == n).select(key)


def model_count(df: DataFrame, model: str) -> Column:
    return df.select(model).distinct().agg(F.count(F.lit(1))).scalar()


def matched_rows(df: DataFrame, key: str, model: str, n_models: int | Column, unique: bool = True) -> DataFrame:
    """Rows of the keys seen with every model.

    Distinct models are counted, so repeats do not stand for missing models; a null model is none. With one row per
    (key, model), the contract of a fact table, a key's rows are few and are counted in place, in one shuffle.
    Otherwise the keys are counted first and semi-joined, which a key with very many rows needs.
    """
    if not unique:
        return df.join(matched_keys(df, key, model, n_models), key, "left_semi")
    n = n_models if isinstance(n_models, Column) else F.lit(n_models)
    counted = df.withColumn("_m", F.size(F.collect_set(model).over(Window.partitionBy(key))))
    return counted.where(F.col("_m") == n).drop("_m")


def fill_missing(
    table: DataFrame, source: DataFrame, on: Sequence[str], columns: Sequence[str] | None = None, add_new: bool = True
) -> DataFrame:
    """Left join that fills existing columns only where they are null and appends the new ones.

    The source holds one row per key, or reading the result is an error; its rows with a null key match nothing.
    """
    columns = columns or [c for c in source.columns if c not in on]
    overlap = [c for c in columns if c in table.columns]
    new = [c for c in columns if c not in table.columns] if add_new else []
    known = source.dropna(subset=list(on))
    right = one_row_per_key(known.select(*on, *[F.col(c).alias(f"_s_{c}") for c in overlap], *new), on, "source table")
    joined = table.join(right, list(on), "left")
    return joined.select(
        *[F.coalesce(F.col(c), F.col(f"_s_{c}")).alias(c) if c in overlap else F.col(c) for c in table.columns], *new
    )


def resolve_paths(rows: DataFrame, path: str, key: Sequence[str], roots: Sequence[str], listing: DataFrame, listed: str = "path") -> DataFrame:
    """First candidate of `root/path` (or the path itself when absolute) that is in the file listing.

    Adds `resolved_path` and `failure_stage`; rows without a hit keep `path_resolution` there.
    """
    p = K.text(path)
    cands = [F.when(p.startswith("/"), p)] + [
        F.when(~p.startswith("/") & (p != ""), F.concat(F.lit(r.rstrip("/") + "/"), p) if r else p) for r in roots
    ]
    offered = rows.select(*key, F.posexplode(F.array(*cands)).alias("_prio", "_cand")).where(F.col("_cand").isNotNull())
    found = (
        offered.join(listing.select(F.col(listed).alias("_cand")).distinct(), "_cand", "left_semi")
        .groupBy(*key)
        .agg(F.min_by("_cand", "_prio").alias("resolved_path"))
    )
    return rows.join(found, list(key), "left").withColumn(
        "failure_stage", F.when(F.col("resolved_path").isNull(), F.lit("path_resolution"))
    )


def locate_by_priority(rows: DataFrame, key: Sequence[str], candidates: Mapping[str, Column], listing: DataFrame, listed: str = "path") -> DataFrame:
    """Like `resolve_paths` for named candidate expressions: recorded columns first, then naming rules."""
    entries = [
        F.struct(F.lit(i).alias("p"), F.lit(name).alias("rule"), expr.alias("c")) for i, (name, expr) in enumerate(candidates.items())
    ]
    offered = rows.select(*key, F.explode(F.array(*entries)).alias("e")).select(*key, "e.*").where(K.text("c") != "")
    found = (
        offered.join(listing.select(F.col(listed).alias("c")).distinct(), "c", "left_semi")
        .groupBy(*key)
        .agg(F.min_by("c", "p").alias("located_path"), F.min_by("rule", "p").alias("located_by"))
    )
    return rows.select(*key).join(found, list(key), "left")


def pair_by_stem(truth: DataFrame, pred: DataFrame, stem: str) -> DataFrame:
    """Full pairing of two file sets by stem; stems that repeat on a side are reported and not paired."""
    t = truth.groupBy(stem).agg(F.count(F.lit(1)).alias("n_truth"))
    p = pred.groupBy(stem).agg(F.count(F.lit(1)).alias("n_pred"))
    both = t.join(p, stem, "full_outer").select(
        stem, F.coalesce("n_truth", F.lit(0)).alias("n_truth"), F.coalesce("n_pred", F.lit(0)).alias("n_pred")
    )
    return both.withColumn(
        "status",
        F.when(F.col("n_truth") > 1, "duplicate_ground_truth")
        .when(F.col("n_pred") > 1, "duplicate_prediction")
        .when(F.col("n_pred") == 0, "missing_prediction")
        .when(F.col("n_truth") == 0, "missing_ground_truth")
        .otherwise("ok"),
    )


def add_missing_copies(df: DataFrame, source: Column, key: Sequence[str], changes: Mapping[str, Column]) -> DataFrame:
    """Append changed copies of the rows selected by `source` whose new key is not there yet."""
    copies = df.where(source).withColumns(dict(changes))
    return df.unionByName(copies.join(df.select(*key), list(key), "left_anti"))


def upsert(base: DataFrame, updates: DataFrame, key: Sequence[str]) -> DataFrame:
    """Full outer by key; update values win, and `origin` says where a row came from."""
    cols = [c for c in base.columns if c not in key]
    more = [c for c in updates.columns if c not in key and c not in cols]
    b = base.select(*key, *[F.col(c).alias(f"_b_{c}") for c in cols], F.lit(1).alias("_hb"))
    u = updates.select(*key, *[F.col(c).alias(f"_u_{c}") for c in updates.columns if c not in key], F.lit(1).alias("_hu"))
    j = b.join(u, list(key), "full_outer")
    out = [F.coalesce(F.col(f"_u_{c}"), F.col(f"_b_{c}")).alias(c) if f"_u_{c}" in u.columns else F.col(f"_b_{c}").alias(c) for c in cols]
    out += [F.col(f"_u_{c}").alias(c) for c in more]
    origin = F.when(F.col("_hb").isNull(), "update").when(F.col("_hu").isNull(), "base").otherwise("both")
    return j.select(*key, *out, origin.alias("origin"))


def comparison_group(rows: DataFrame, anchor: Column, match_keys: Sequence[str], model: str, order: Sequence[str]) -> DataFrame:
    """Rows that share the first usable match key with the anchor row, first row per model."""
    spelled = F.coalesce(*[F.when(~K.is_blank(k), F.concat(F.lit(f"{k}="), K.text(k))) for k in match_keys])
    keyed = rows.withColumn("_mk", spelled)
    anchor_keys = keyed.where(anchor).select("_mk").where(F.col("_mk").isNotNull()).distinct()
    return first_per_key(keyed.join(anchor_keys, "_mk", "left_semi"), ["_mk", model], order).drop("_mk")


def align_across_models(rows: DataFrame, key: Sequence[str], model: str, count: str, preferred: Sequence[str]) -> DataFrame:
    """One row per key: which models cover it and the count to filter on (first present in preferred order)."""
    aligned = rows.groupBy(*key).agg(
        F.array_sort(F.collect_set(model)).alias("models"),
        F.size(F.collect_set(model)).cast("bigint").alias("n_models"),
        *[F.max(F.when(F.col(model) == m, F.col(count))).alias(f"_c{i}") for i, m in enumerate(preferred)],
    )
    picks = [f"_c{i}" for i in range(len(preferred))]
    return aligned.withColumn("filter_count", F.coalesce(*picks)).drop(*picks)
