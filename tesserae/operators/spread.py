"""Join of a large side to a side with few rows per key, safe when one key holds a large share of the rows."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, functions as F

SALTS = 16


def spread_join(big: DataFrame, small: DataFrame, on: Sequence[str], how: str = "inner", salts: int = SALTS) -> DataFrame:
    """Rows of `big` are spread over `salts` keys by a hash of the row; `small` is repeated for each.

    A hot key then fills `salts` tasks, and a following aggregation starts from partial results. When
    `small` turns out small enough Spark broadcasts it and the salt costs nothing.
    """
    if how not in ("inner", "left"):
        raise ValueError("the large side decides which rows there are: inner or left")
    hashed = [c for c, t in big.dtypes if not t.startswith("map")]
    left = big.withColumn("_salt", F.pmod(F.xxhash64(*hashed), F.lit(salts)).cast("int"))
    right = small.withColumn("_salt", F.explode(F.sequence(F.lit(0), F.lit(salts - 1))))
    return left.join(right, [*on, "_salt"], how).drop("_salt")
