"""Key normalisation: ids from paths, join-key variants, names safe for columns and files."""

from __future__ import annotations

import re
from collections.abc import Mapping, Sequence

from pyspark.sql import Column, functions as F

from .scalars import col

# Role suffixes that file stems may carry.
ROLE_SUFFIX = "_(image|mask|class_labels)$"
ROLE_FILE_END = r"_(image|mask|class_labels)\.png$"


def text(c: str | Column) -> Column:
    """Trimmed string; missing becomes the empty string."""
    return F.coalesce(F.trim(col(c).cast("string")), F.lit(""))


def blank_to_null(c: str | Column) -> Column:
    return F.nullif(F.trim(col(c).cast("string")), F.lit(""))


def is_blank(c: str | Column) -> Column:
    return text(c) == ""


def basename(c: str | Column) -> Column:
    """Last path part; trailing slashes are ignored."""
    return F.regexp_extract(F.regexp_replace(text(c), "/+$", ""), "[^/]*$", 0)


def stem(c: str | Column) -> Column:
    """Basename without its last extension; a leading dot is part of the name."""
    return F.regexp_replace(basename(c), r"(?<=.)\.[^.]+$", "")


def join_stem(c: str | Column) -> Column:
    """Stem as the join variants define it: the last extension goes even after a leading dot."""
    return F.regexp_replace(basename(c), r"\.[^.]+$", "")


def patch_id_from_image(c: str | Column) -> Column:
    name = basename(c)
    return F.when(name.endswith("_image.png"), F.regexp_replace(name, r"_image\.png$", "")).otherwise(stem(c))


def sample_id_from_image(c: str | Column) -> Column:
    """`samples/<id>/...` gives <id>; otherwise the file name without its role ending, else the stem."""
    path = F.replace(F.coalesce(col(c).cast("string"), F.lit("")), F.lit("\\"), F.lit("/"))
    parts = F.split(path, "/")
    name = basename(path)
    return (
        F.when(path.startswith("samples/") & (F.size(parts) >= 2), F.get(parts, F.lit(1)))
        .when(name.rlike(ROLE_FILE_END), F.regexp_replace(name, ROLE_FILE_END, ""))
        .otherwise(stem(path))
    )


def join_key(c: str | Column, use_basename: bool = False, strip_prefix: str = "", strip_suffix: str = "") -> Column:
    k = basename(c) if use_basename else text(c)
    if strip_prefix:
        k = F.when(k.startswith(strip_prefix), k.substr(F.lit(len(strip_prefix) + 1), F.length(k))).otherwise(k)
    if strip_suffix:
        k = F.when(k.endswith(strip_suffix), k.substr(F.lit(1), F.length(k) - len(strip_suffix))).otherwise(k)
    return k


def join_key_variants(c: str | Column) -> dict[str, Column]:
    """The four spellings tried when a join column is discovered, in order of preference."""
    s = join_stem(c)
    return {
        "raw": text(c),
        "basename": basename(c),
        "basename_stem": s,
        "basename_strip_role": F.regexp_replace(s, ROLE_SUFFIX, ""),
    }


def safe_token(c: str | Column, default: str = "sample") -> Column:
    cleaned = F.regexp_replace(col(c).cast("string"), r"[^A-Za-z0-9._-]+", "_")
    return F.coalesce(F.nullif(F.regexp_replace(cleaned, "^_+|_+$", ""), F.lit("")), F.lit(default))


def sample_id_from_relative_path(c: str | Column, suffix: str = "") -> Column:
    """Cleaned parts joined with `__`; the leaf loses its extension and, unless that empties it, the suffix."""
    parts = F.filter(F.split(text(c), "/"), lambda p: p != "")
    folders = F.slice(parts, 1, F.greatest(F.size(parts) - 1, F.lit(0)))
    leaf = stem(c)
    if suffix:
        leaf = F.coalesce(F.nullif(F.regexp_replace(leaf, re.escape(suffix) + "$", ""), F.lit("")), leaf)
    return F.array_join(F.transform(F.concat(folders, F.array(leaf)), lambda p: safe_token(p)), "__")


def model_column_name(c: str | Column) -> Column:
    lowered = F.regexp_replace(F.lower(text(c)), "[^0-9a-z]+", "_")
    return F.regexp_replace(lowered, "^_+|_+$", "")


def model_name_from_file(c: str | Column) -> Column:
    return F.regexp_replace(stem(F.regexp_replace(text(c), r"\.gz$", "")), "_evaluation$", "")


def model_name_or_file(model: str | Column, file_name: str | Column) -> Column:
    return F.coalesce(blank_to_null(model), model_name_from_file(file_name))


def group_id(
    c: str | Column | None = None, constant: str | None = None, prefix: str = "", suffix: str = "", pattern: str = ""
) -> Column:
    """Slide id: a constant, or a column with prefix, suffix and pattern removed in that order."""
    if constant is not None:
        return F.lit(constant)
    if c is None:
        raise ValueError("give a column or a constant")
    k = join_key(c, strip_prefix=prefix, strip_suffix=suffix)
    return F.regexp_replace(k, pattern, "") if pattern else k


def canonical_path(c: str | Column, root: str) -> Column:
    """Absolute paths under the root become relative to it; relative ones are kept; others stay absolute."""
    root = root.rstrip("/") + "/"
    p = F.regexp_replace(text(c), "/{2,}", "/")
    p = F.regexp_replace(p, r"^(\./)+", "")
    return F.when(p.startswith(root), p.substr(F.lit(len(root) + 1), F.length(p))).otherwise(p)


def root_from_tail(path: str | Column, tail: str | Column) -> Column:
    """Root that turns `tail` into `path`; null when the path does not end with the tail."""
    p, t = text(path), F.concat(F.lit("/"), F.regexp_replace(text(tail), "^/+", ""))
    return F.when(p.endswith(t) & (F.length(t) > 1), p.substr(F.lit(1), F.length(p) - F.length(t)))


def first_present(cols: Sequence[str | Column], row_number: str | Column) -> Column:
    return F.coalesce(*[blank_to_null(c) for c in cols], F.concat(F.lit("row_"), col(row_number).cast("string")))


def embedding_id(id_col: str | Column | None, path: str | Column, row_index: str | Column) -> Column:
    """The cleaned id when present, else `<stem>__row0000000`."""
    made = F.concat(safe_token(stem(path), "row"), F.format_string("__row%07d", col(row_index)))
    if id_col is None:
        return made
    return F.coalesce(F.when(~is_blank(id_col), safe_token(text(id_col), "row")), made)


def source_prefix(c: str | Column, labels: Mapping[str, str] | None = None) -> Column:
    """Lower-cased part before the first underscore, mapped to a friendly label when there is one."""
    k = F.lower(F.get(F.split(text(c), "_"), F.lit(0)))
    if not labels:
        return k
    pairs = [F.lit(v) for kv in labels.items() for v in kv]
    return F.coalesce(F.try_element_at(F.create_map(*pairs), k), k)


# The spellings of a tile key that a whole lower-cased stem may have.
TILE_KEY_PATTERNS = (
    r"^(-?\d+)_(-?\d+)$",
    r"^(-?\d+)x[_-](-?\d+)y$",
    r"^x(-?\d+)_y(-?\d+)$",
    r"^(?:r|row)(-?\d+)[_-](?:c|col)(-?\d+)$",
    r"^(?:c|col)(-?\d+)[_-](?:r|row)(-?\d+)$",
)
# Fixed value: coordinates in a tile name.
XY_PATTERN = r"(?i)(-?\d+)x[_-](-?\d+)y"


def _group(s: Column, pattern: str, i: int) -> Column:
    return F.nullif(F.regexp_extract(s, pattern, i), F.lit(""))


def tile_key(c: str | Column) -> Column:
    """struct(a, b) when the whole stem is a tile key, numbers in written order; nulls otherwise."""
    # One search for all patterns. A stem holds no slash, so only a found key splits into three.
    n = len(TILE_KEY_PATTERNS)
    first, second = ("".join(f"${2 * i + j}" for i in range(n)) for j in (1, 2))
    found = F.split(F.regexp_replace(F.lower(stem(c)), "|".join(TILE_KEY_PATTERNS), f"/{first}/{second}"), "/")
    return F.struct(*[F.get(found, F.lit(i)).try_cast("bigint").alias(x) for i, x in ((1, "a"), (2, "b"))])


def xy_in_name(c: str | Column) -> Column:
    """struct(x, y) from `<x>x_<y>y` anywhere in the stem."""
    s = stem(c)
    return F.struct(
        _group(s, XY_PATTERN, 1).try_cast("bigint").alias("x"), _group(s, XY_PATTERN, 2).try_cast("bigint").alias("y")
    )


def coord_and_count(c: str | Column) -> Column:
    """struct(coord_key, n_cells): the coordinate as written and the number ending the rest of the stem."""
    s = stem(c)
    x, y = _group(s, XY_PATTERN, 1), _group(s, XY_PATTERN, 2)
    tail = F.replace(F.regexp_extract(s, XY_PATTERN + "(.*)$", 3), F.lit("."), F.lit("_"))
    tail = F.regexp_replace(tail, "^[_-]+|[_-]+$", "")
    n = _group(tail, r"(?:^|[_-])(\d+)$", 1)
    return F.struct(
        F.concat(x, F.lit("x_"), y, F.lit("y")).alias("coord_key"),
        F.when(x.isNotNull(), n.try_cast("bigint")).alias("n_cells"),
    )
