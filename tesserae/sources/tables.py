"""Tables by suffix, file listings, evaluation files, row routing and resumable writes."""

from __future__ import annotations

import re
from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, SparkSession, functions as F
from pyspark.sql.types import StructType

from ..functions import keys as K
from ..operators.dedupe import first_per_key
from ..operators.joins import JoinError, require_columns, require_present, require_unique

CSV_SUFFIXES = (".csv", ".csv.gz")


def _kind(path: str) -> str:
    p = path.rstrip("/").lower()
    if p.endswith(CSV_SUFFIXES):
        return "csv"
    if p.endswith(".parquet"):
        return "parquet"
    raise ValueError(f"unsupported table suffix: {path}")


def read_table(spark: SparkSession, paths: str | Sequence[str], schema: StructType | str | None = None) -> DataFrame:
    """CSV (plain or gzip) or Parquet by suffix. CSV without a schema is read as text columns."""
    paths = [paths] if isinstance(paths, str) else list(paths)
    kinds = {_kind(p) for p in paths}
    if len(kinds) != 1:
        raise ValueError("all paths must have one format")
    if kinds == {"parquet"}:
        return spark.read.parquet(*paths)
    reader = spark.read.option("header", True).option("escape", '"')
    return (reader.schema(schema) if schema else reader).csv(paths)


def write_table(df: DataFrame, path: str, mode: str = "overwrite", partition_by: Sequence[str] = ()) -> None:
    writer = df.write.mode(mode)
    if partition_by:
        writer = writer.partitionBy(*partition_by)
    if _kind(path) == "parquet":
        writer.parquet(path)
    else:
        gz = path.rstrip("/").lower().endswith(".gz")
        writer.option("header", True).option("escape", '"').option("compression", "gzip" if gz else "none").csv(path)


def csv_to_parquet(spark: SparkSession, source: str, target: str, schema: StructType | str) -> DataFrame:
    write_table(read_table(spark, source, schema), target)
    return spark.read.parquet(target)


def list_files(
    spark: SparkSession, folder: str | Sequence[str], glob: str = "*", recursive: bool = True, suffixes: Sequence[str] = (), excluded: Sequence[str] = ()
) -> DataFrame:
    """path, length, name, stem, suffix of the files below a folder; contents are never read."""
    reader = spark.read.format("binaryFile").option("pathGlobFilter", glob).option("recursiveFileLookup", str(recursive).lower())
    df = reader.load(folder if isinstance(folder, str) else list(folder)).select(F.regexp_replace("path", "^file:(//)?", "").alias("path"), "length")
    return _named(df, suffixes, excluded)


_SCHEME = r"^[A-Za-z][A-Za-z0-9+.-]*:(//[^/]*)?"


def list_tables(spark: SparkSession, folder: str, suffixes: Sequence[str] = (".parquet",), excluded: Sequence[str] = ()) -> DataFrame:
    """path, length, name, stem, suffix of the tables in a folder; one stored as a folder of part files is one row, as one file is.

    Part files may lie in partition folders and count with their lengths; contents are never read.
    """
    root = re.sub("/+", "/", re.sub(_SCHEME, "", folder)).rstrip("/")
    below = ("^" if root.startswith("/") or not root else "^.*?/") + re.escape(root) + "/"
    reader = spark.read.format("binaryFile").option("recursiveFileLookup", "true")
    found = reader.load(folder).select(F.regexp_replace("path", _SCHEME, "").alias("path"), "length")
    # The table is the first step below the folder.
    files = found.select(F.regexp_extract("path", f"({below}[^/]+)", 1).alias("path"), "length")
    return _named(files.groupBy("path").agg(F.sum("length").alias("length")), suffixes, excluded)


def _named(df: DataFrame, suffixes: Sequence[str], excluded: Sequence[str]) -> DataFrame:
    df = df.withColumns({"name": K.basename("path"), "stem": K.stem("path"), "suffix": F.lower(F.regexp_extract("path", r"\.[^./]+$", 0))})
    if suffixes:
        df = df.where(F.col("suffix").isin(*[s.lower() for s in suffixes]))
    for token in excluded:
        df = df.where(~F.lower("stem").contains(token.lower()))
    return df


def first_seen_paths(found: DataFrame, explicit: Sequence[str]) -> DataFrame:
    """Listed files in path order, then explicit ones in given order, each path once."""
    given = found.sparkSession.createDataFrame([(p, i) for i, p in enumerate(explicit)], "path string, position int")
    both = found.select("path", F.lit(-1).alias("position")).unionByName(given)
    return first_per_key(both, ["path"], ["position"]).orderBy("position", "path")


def with_file_model(df: DataFrame, model: str = "model_name") -> DataFrame:
    """Model column where it is filled, else the name of the file (or table folder) the row came from."""
    table_path = F.regexp_replace(F.col("_metadata.file_path"), "/part-[^/]*$", "")
    from_file = K.model_name_from_file(table_path)
    recorded = K.blank_to_null(model) if model in df.columns else F.lit(None).cast("string")
    others = [c for c in df.columns if c != model]
    return df.select(*others, F.coalesce(recorded, from_file).alias(model), K.basename(table_path).alias("source_file"))


def load_evaluations(spark: SparkSession, paths: Sequence[str], combined: str | None = None, schema: StructType | str | None = None) -> tuple[DataFrame, DataFrame]:
    """(facts, rows per source file): one combined file when given, else the union of the per-model files."""
    if combined:
        df = with_file_model(read_table(spark, combined, schema))
    elif schema is not None or _kind(paths[0]) == "parquet":
        df = with_file_model(read_table(spark, paths, schema))
    else:
        # CSV files with different columns are united by name.
        frames = [with_file_model(read_table(spark, p)) for p in paths]
        df = frames[0]
        for f in frames[1:]:
            df = df.unionByName(f, allowMissingColumns=True)
    return df, df.groupBy("source_file").agg(F.count(F.lit(1)).alias("n_rows"))


def load_model_facts(df: DataFrame, image: str, metrics: Sequence[str], key: Sequence[str], status: str = "status", check: bool = True) -> DataFrame:
    """Successful rows with only the needed columns and the derived patch id; repeats and gaps are errors."""
    require_columns(df, [status, image, *metrics], "evaluation table")
    extra = [k for k in key if k != "patch_id"]
    facts = df.where(F.col(status) == "ok").select(K.patch_id_from_image(image).alias("patch_id"), *extra, *metrics)
    if check:
        require_unique(facts, key, "evaluation table")
        require_present(facts, [*key, *metrics], "evaluation table")
    return facts


def manifest_records(df: DataFrame, image_columns: Sequence[str], suffixes: Sequence[str]) -> DataFrame:
    """Image reference from the first filled column; rows with an unsupported suffix go, other columns stay."""
    present = [c for c in image_columns if c in df.columns]
    if not present:
        raise JoinError(f"none of the image columns {list(image_columns)} is present")
    ref = F.coalesce(*[K.blank_to_null(c) for c in present])
    suffix = F.lower(F.regexp_extract(ref, r"\.[^./]+$", 0))
    return df.withColumn("image_ref", ref).where(suffix.isin(*[s.lower() for s in suffixes]))


def pair_images_and_masks(images: DataFrame, masks: DataFrame, image_suffix: str = "_image", mask_suffix: str = "_mask", extensions: Sequence[str] = (".png", ".tif", ".tiff", ".jpg")) -> DataFrame:
    """One row per image key, case-insensitive; among several files the earliest extension wins; null mask when missing."""
    order = F.array(*[F.lit(e) for e in extensions])

    def keyed(df: DataFrame, suffix: str, name: str) -> DataFrame:
        k = F.regexp_replace(F.lower("stem"), F.lit(suffix.lower() + "$"), F.lit(""))
        d = df.select(k.alias("pair_key"), F.col("path").alias(name), F.array_position(order, F.lower("suffix")).alias("_p"))
        return first_per_key(d.where(F.col("_p") > 0), ["pair_key"], ["_p", name]).drop("_p")

    paired = keyed(images, image_suffix, "image_path").join(keyed(masks, mask_suffix, "mask_path"), "pair_key", "left")
    return paired.withColumn("status", F.when(F.col("mask_path").isNull(), "missing_mask").otherwise("ok"))


def remaining(source: DataFrame, done: Sequence[DataFrame], key: Sequence[str]) -> DataFrame:
    """Rows whose key is in none of the finished tables."""
    seen = None
    for d in done:
        keys = d.select(*key)
        seen = keys if seen is None else seen.unionByName(keys)
    return source if seen is None else source.join(seen, list(key), "left_anti")


def split_existing(wanted: DataFrame, existing: DataFrame, key: Sequence[str], overwrite: bool = False) -> DataFrame:
    """`action` per row: write, or skip when the output is already there."""
    flagged = wanted.join(existing.select(*key).distinct().withColumn("_there", F.lit(True)), list(key), "left")
    keep = F.lit(overwrite) | F.col("_there").isNull()
    return flagged.withColumn("action", F.when(keep, "write").otherwise("skip")).drop("_there")


def route(df: DataFrame, checks: Sequence[tuple[str, Column, str]]) -> DataFrame:
    """Adds `stage` and `error_message` of the first failing check; rows that pass keep nulls."""
    failing = [F.when(F.coalesce(bad, F.lit(True)), F.struct(F.lit(stage).alias("stage"), F.lit(msg).alias("msg"))) for stage, bad, msg in checks]
    return df.withColumn("_f", F.coalesce(*failing)).withColumns({"stage": F.col("_f.stage"), "error_message": F.col("_f.msg")}).drop("_f")


def passed(routed: DataFrame) -> DataFrame:
    return routed.where(F.col("stage").isNull()).drop("stage", "error_message")


def failed(routed: DataFrame) -> DataFrame:
    return routed.where(F.col("stage").isNotNull())


def run_summary(routed: DataFrame, objects: str | None = None) -> DataFrame:
    """Rows in all, processed, failed, and objects in the processed rows, from one aggregation."""
    ok = F.col("stage").isNull()
    n_objects = F.coalesce(F.sum(F.when(ok, F.col(objects))), F.lit(0)) if objects else F.lit(0)
    return routed.agg(
        F.count(F.lit(1)).alias("rows_total"), F.count_if(ok).alias("rows_processed"), F.count_if(~ok).alias("rows_failed"), n_objects.cast("bigint").alias("objects")
    )


def require_all_passed(routed: DataFrame) -> None:
    bad = failed(routed).select("stage", "error_message").first()
    if bad is not None:
        raise RuntimeError(f"{bad['stage']}: {bad['error_message']}")


def align_by_position(left: DataFrame, right: DataFrame, index: str, key: str, classes: Sequence[str]) -> DataFrame:
    """Row-aligned tables joined on their explicit index, with the row total of the class columns.

    Both sides must have the same indices, and ids must be filled and unique.
    """
    joined = left.join(right, index, "full_outer").withColumn("count_total", sum((F.col(c) for c in classes), F.lit(0).cast("bigint")))
    right_only = [c for c in right.columns if c != index][0]
    left_only = [c for c in left.columns if c != index][0]
    gaps = joined.where(F.col(right_only).isNull() | F.col(left_only).isNull()).limit(1).count()
    if gaps:
        raise JoinError("tables differ in length")
    require_present(joined, [key], "aligned table")
    require_unique(joined, [key], "aligned table")
    return joined


def merge_splits(splits: Mapping[str, DataFrame], row: str, category: str, sample: str) -> DataFrame:
    """Splits united with a split tag and a composite id `<merged>_<split>_<row>_<category>_<sample>`."""
    out = None
    for name, df in splits.items():
        tagged = df.withColumn("split", F.lit(name))
        out = tagged if out is None else out.unionByName(tagged, allowMissingColumns=True)
    from ..operators.manifests import dense_row_index

    numbered = dense_row_index(out.withColumn("_so", F.array_position(F.array(*[F.lit(s) for s in splits]), F.col("split"))), ["_so", row], "merged_index").drop("_so")
    return numbered.withColumn(
        "unique_id", F.format_string("%04d_%s_%04d_%s_%s", "merged_index", "split", F.col(row), K.safe_token(category), K.safe_token(F.col(sample).cast("string")))
    )


def write_per_source(df: DataFrame, source: str, per_source: str, overall: str) -> None:
    """One folder per source value and the same rows as one table."""
    write_table(df, per_source, partition_by=[source])
    write_table(df, overall)
