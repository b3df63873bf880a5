"""Nested documents and vectors: cell JSON, artifact JSON, embeddings by address."""

from __future__ import annotations

import re
from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, SparkSession, functions as F
from pyspark.sql.types import ArrayType, MapType, StructType, VariantType

from ..operators.manifests import dense_row_index
from ..session import materialise

CELLS_SCHEMA = """wsi_metadata struct<patch_size: int, base_mpp: double, target_patch_mpp: double, orig_n_tiles_rows: int, orig_n_tiles_cols: int>,
 type_map map<string, string>,
 cells array<struct<bbox: array<array<double>>, contour: array<array<double>>, patch_coordinates: array<int>, offset_global: array<double>>>"""


def read_cells(spark: SparkSession, path: str | list[str]) -> DataFrame:
    return spark.read.schema(CELLS_SCHEMA).option("multiLine", True).json(path).withColumn("document", F.col("_metadata.file_path"))


def cell_rows(documents: DataFrame, keep: Sequence[str] = ("document",)) -> DataFrame:
    """One row per well-formed cell with its ordinal and box; [[ymin, xmin], [ymax, xmax]] is unfolded."""
    rows = documents.select(*keep, F.posexplode("cells").alias("cell_ordinal", "cell")).select(*keep, "cell_ordinal", "cell.*")

    def at(i: int, j: int) -> Column:
        return F.get(F.get("bbox", F.lit(i)), F.lit(j))

    well = (
        (F.size("bbox") == 2) & (F.size("contour") > 0) & at(0, 0).isNotNull() & at(0, 1).isNotNull() & at(1, 0).isNotNull() & at(1, 1).isNotNull()
        & F.forall("contour", lambda p: F.size(p) >= 2)
    )
    return rows.where(F.coalesce(well, F.lit(False))).withColumns({"ymin": at(0, 0), "xmin": at(0, 1), "ymax": at(1, 0), "xmax": at(1, 1)})


def contour_points(cells: DataFrame, keys: Sequence[str]) -> DataFrame:
    return cells.select(*keys, F.size("contour").alias("n_points"), F.posexplode("contour").alias("ordinal", "_p")).select(
        *keys, "n_points", "ordinal", F.get("_p", F.lit(0)).alias("x"), F.get("_p", F.lit(1)).alias("y")
    )


def flatten(df: DataFrame) -> DataFrame:
    """Nested structs to dotted columns; arrays and maps become JSON text."""

    def walk(schema: StructType, path: tuple[str, ...]) -> list[Column]:
        out = []
        for f in schema.fields:
            here = (*path, f.name)
            ref = F.col(".".join(f"`{p}`" for p in here))
            if isinstance(f.dataType, StructType):
                out += walk(f.dataType, here)
            elif isinstance(f.dataType, (ArrayType, MapType, VariantType)):
                out.append(F.to_json(ref).alias(".".join(here)))
            else:
                out.append(ref.alias(".".join(here)))
        return out

    return df.select(*walk(df.schema, ()))


def read_variants(spark: SparkSession, path: str | list[str]) -> DataFrame:
    """Whole JSON files of unknown form: (document, value variant); value is null where a file is no JSON; empty files are passed over."""
    text = spark.read.text(path, wholetext=True)
    return text.select(F.col("_metadata.file_path").alias("document"), F.try_parse_json("value").alias("value"))


def variant_rows(documents: DataFrame, path: str, fields: Mapping[str, str], keep: Sequence[str] = ("document",)) -> DataFrame:
    """One row per element of the array at `path` (say $.cells) with its ordinal and the named fields.

    `fields` maps a column to 'path type' inside the element (say "$.bbox[0][1] double"). A field that is missing or
    does not fit its type is null; a document without that array gives no rows, a null element gives null fields.
    """
    items = documents.select(*keep, F.posexplode(F.try_variant_get("value", path, "array<variant>")).alias("ordinal", "_item"))
    return items.select(*keep, "ordinal", *[F.try_variant_get("_item", *spec.rsplit(" ", 1)).alias(name) for name, spec in fields.items()])


_SCHEMA_PART = re.compile(r"`(?:[^`]|``)*`|\bOBJECT<|\bVOID\b")


def variant_schema(documents: DataFrame, value: str = "value") -> str:
    """The merged schema of all documents, found in one aggregation; keys without a common type stay variant."""
    found = documents.agg(F.schema_of_variant_agg(value)).first()[0]
    return _SCHEMA_PART.sub(lambda m: {"OBJECT<": "STRUCT<", "VOID": "STRING"}.get(m[0], m[0]), found)


def flatten_variants(documents: DataFrame, keep: Sequence[str] = ("document",), value: str = "value", schema: str | None = None) -> DataFrame:
    """Objects with keys unknown beforehand as dotted columns behind `keep`; arrays and mixed types become JSON text.

    A document that lacks a key, or is null, has null there. Without a given schema the documents are read once more
    for it; if no document is an object there is nothing to flatten and only `keep` is left.
    """
    schema = schema or variant_schema(documents, value)
    if not schema.startswith("STRUCT<"):
        return documents.select(*keep)
    typed = flatten(documents.select(F.struct(*keep).alias("k"), F.try_variant_get(value, "$", schema).alias("v")))
    return typed.select(*[F.col(f"`k.{c}`").alias(c) for c in keep], *[F.col("`" + c.replace("`", "``") + "`").alias(c[2:]) for c in typed.columns if c.startswith("v.")])


def fetch_vectors(requests: DataFrame, parts: DataFrame, dim: int, address: Sequence[str] = ("embedding_path", "embedding_row_offset")) -> DataFrame:
    """Vectors by address: an equi-join, so each part is scanned once. `stage` names what is wrong with a row."""
    have = parts.select(*address, "embedding")
    joined = requests.join(have, list(address), "left")
    return joined.withColumn(
        "stage",
        F.when(F.col(address[1]).isNull() | (F.col(address[1]) < 0), "bad_offset")
        .when(F.col("embedding").isNull(), "missing_vector")
        .when(F.size("embedding") != dim, "dimension_mismatch"),
    )


_PART_SCHEMA = "embedding array<float>, part bigint"


def _part_path(folder: str, part: Column) -> Column:
    return F.concat(F.lit(folder.rstrip("/") + "/part="), part.cast("string"))


def vector_column_names(dim: int, prefix: str = "emb_") -> list[str]:
    width = max(4, len(str(dim - 1)))
    return [f"{prefix}{i:0{width}d}" for i in range(dim)]


def widen_vectors(df: DataFrame, dim: int, vector: str = "embedding", prefix: str = "emb_", keep: Sequence[str] | None = None) -> DataFrame:
    """Vector as one column per dimension beside the kept columns."""
    keep = [c for c in df.columns if c != vector] if keep is None else list(keep)
    clash = set(keep) & set(vector_column_names(dim, prefix))
    if clash:
        raise ValueError(f"columns already present: {sorted(clash)[:5]}")
    return df.select(*keep, *[F.get(vector, F.lit(i)).alias(n) for i, n in enumerate(vector_column_names(dim, prefix))])


def part_rows(df: DataFrame, row_index: str, rows_per_part: int, folder: str, vector: str = "embedding") -> DataFrame:
    """Bookkeeping of vectors stored in parts: part path, offset inside it, dimension.

    The dense row index gives both by division, so no window is needed.
    """
    part = F.floor(F.col(row_index) / rows_per_part)
    return df.withColumns(
        {
            "embedding_path": F.concat(F.lit(folder.rstrip("/") + "/part_"), F.lpad(part.cast("string"), 6, "0"), F.lit(".parquet")),
            "embedding_row_offset": (F.col(row_index) % rows_per_part).cast("int"),
            "embedding_dim": F.size(vector),
            "embedding_format": F.lit("parquet"),
        }
    )


def write_vector_parts(df: DataFrame, order: Sequence[str], rows_per_part: int, folder: str, first_part: int = 0, vector: str = "embedding") -> DataFrame:
    """Write vectors as one file a part, rows in `order`; returns every row's address in place of its vector.

    Rows are numbered without gaps over the whole frame, so offset k of a part is row k of its file. A part is one
    task's work of a fixed size. A later call appends behind the others with first_part = next_part(...); a call
    that is repeated replaces the parts it wrote before.
    """
    spark = df.sparkSession
    placed = part_rows(dense_row_index(df, list(order), "_row"), "_row", rows_per_part, folder, vector)
    placed = placed.withColumn("part", F.floor(F.col("_row") / rows_per_part) + first_part)
    placed = materialise(placed.withColumn("embedding_path", _part_path(folder, F.col("part"))))
    (
        placed.select("part", F.col(vector).alias("embedding"), "_row").repartition("part").sortWithinPartitions("part", "_row").drop("_row")
        .write.mode("overwrite").option("partitionOverwriteMode", "dynamic").option("maxRecordsPerFile", 0).partitionBy("part").parquet(folder)
    )
    return placed.drop(vector, "_row", "part")


def next_part(spark: SparkSession, folder: str) -> int:
    """Number behind the highest part in the folder."""
    last = spark.read.schema(_PART_SCHEMA).parquet(folder).agg(F.max("part")).first()[0]
    return 0 if last is None else last + 1


def fetch_written_vectors(requests: DataFrame, folder: str, dim: int, address: Sequence[str] = ("embedding_path", "embedding_row_offset")) -> DataFrame:
    """Vectors at (part path, row in its file), read from the parts that the requests name and no others.

    The row's place comes from the scan itself. `stage` tells what is wrong with a request: no such part, an offset
    that is null, negative or past the part's end, or a vector of another length. The numbers of the named parts
    pass through the driver, which lists these files for the scan in any case.
    """
    spark, (path, offset) = requests.sparkSession, address
    pattern = "^" + re.escape(folder.rstrip("/")) + r"/part=(\d+)$"
    asked = requests.withColumn("_part", F.regexp_extract(F.col(path), pattern, 1).try_cast("bigint"))
    named = [r[0] for r in asked.select("_part").where("_part is not null").distinct().collect()]
    stored = spark.read.schema(_PART_SCHEMA).parquet(folder).where(F.col("part").isin(named))
    sizes = stored.groupBy(F.col("part").alias("_part")).agg(F.count(F.lit(1)).alias("_rows"))
    vectors = stored.select(F.col("part").alias("_part"), F.col("_metadata.row_index").alias("_row"), "embedding")
    found = asked.join(sizes, "_part", "left").join(vectors.withColumnRenamed("_part", "_stored"), (F.col("_part") == F.col("_stored")) & (F.col(offset) == F.col("_row")), "left")
    stage = (
        F.when(F.col("_rows").isNull(), "missing_part")
        .when(F.col(offset).isNull() | (F.col(offset) < 0), "bad_offset")
        .when(F.col(offset) >= F.col("_rows"), "offset_out_of_range")
        .when(F.col("embedding").isNull(), "missing_vector")
        .when(F.size("embedding") != dim, "dimension_mismatch")
    )
    return found.select(*[F.col(f"`{c}`") for c in requests.columns], "embedding", stage.alias("stage"))
