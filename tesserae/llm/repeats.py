"""Steps that the two repeat removers share: which sampled positions recur in another text, and putting results together.

Rows that tell where something occurs are combined within a batch: however many texts of the batch hold it, it
becomes one row that lists them. A passage that a third of all texts share therefore meets in one task once per
batch, not once per text.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window, functions as F

from .util import order_id, signed

_PLACE = pa.struct([("uid", pa.int64()), ("pos", pa.int32())])
SEEN = pa.schema([("hash", pa.int64()), ("uid", pa.int64()), ("last", pa.int64()), ("pos", pa.int32()), ("more", pa.list_(_PLACE))])
SEEN_SQL = "hash long, uid long, last long, pos int, more array<struct<uid: long, pos: int>>"


#: Places that are combined at once.
AT_ONCE = 400_000


def seen_rows(hashes: np.ndarray, uids: np.ndarray, positions: np.ndarray) -> pa.RecordBatch:
    """One row for each distinct hash: a place of it, its other places, and the uid of one in another text, if any."""
    order = np.argsort(hashes)
    hashes, uids, positions = hashes[order], uids[order], positions[order].astype(np.int32)
    rest, begins, more = grouped(hashes[1:] != hashes[:-1], _PLACE, [uids, positions])
    high, low = (f.reduceat(uids, begins) if len(begins) else uids for f in (np.maximum, np.minimum))
    lead = uids[begins]
    return pa.RecordBatch.from_arrays([pa.array(signed(hashes[begins])), pa.array(lead), pa.array(np.where(high != lead, high, low)), pa.array(positions[begins]), more], schema=SEEN)


def grouped(change: np.ndarray, kind: pa.StructType, columns: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray, pa.Array]:
    """(members that do not begin a group, where groups begin, their lists of those members; null if there are none)."""
    n = len(columns[0])
    begins = np.flatnonzero(np.append(True, change)) if n else np.zeros(0, np.int64)
    sizes = np.diff(np.append(begins, n))
    rest = np.ones(n, bool)
    rest[begins] = False
    places = pa.StructArray.from_arrays([pa.array(c[rest]) for c in columns], fields=list(kind))
    if not n:
        return rest, begins, pa.array([], pa.list_(kind))
    cuts = np.append(0, np.cumsum(sizes - 1)).astype(np.int32)
    return rest, begins, pa.ListArray.from_arrays(pa.array(cuts), places, mask=pa.array(sizes == 1))


def recurring(seen: DataFrame) -> DataFrame:
    """Rows of seen_rows -> (uid, places): the positions of each text whose hash occurs in another text too."""
    key = Window.partitionBy("hash")
    held = seen.withColumn("_low", F.min(F.least("uid", "last")).over(key)).withColumn("_high", F.max(F.greatest("uid", "last")).over(key)).where("_low < _high")
    first = F.array(F.struct("uid", "pos"))
    each = held.select(F.explode(F.when(F.col("more").isNull(), first).otherwise(F.concat(first, "more"))).alias("p"))
    return each.groupBy("p.uid").agg(F.collect_list("p.pos").alias("places"))


def batched(found) -> Iterator[list[np.ndarray]]:
    """Tuples of arrays put together until they hold AT_ONCE places."""
    held, n = [], 0
    for arrays in found:
        held.append(arrays)
        n += len(arrays[0])
        if n >= AT_ONCE:
            yield [np.concatenate(c) for c in zip(*held, strict=True)]
            held, n = [], 0
    if n:
        yield [np.concatenate(c) for c in zip(*held, strict=True)]


def covered(length: int, starts: np.ndarray, stops: np.ndarray) -> np.ndarray:
    """Positions below length that lie in one of the stretches."""
    step = np.bincount(starts, minlength=length + 1)[: length + 1] - np.bincount(stops, minlength=length + 1)[: length + 1]
    return np.cumsum(step[:length]) > 0


def answers(members: DataFrame, results: DataFrame, window: int, count: str, whole: dict[str, Column], none: dict[str, Column]) -> DataFrame:
    """Give every document the result of its text: doc_id, count and the columns that whole and none name.

    The document with the smallest doc_id of those with a text gets what was found for the text; for the others all
    windows occur in a smaller document, so nothing stays if the text is at least a window long: whole. A shorter
    one stays as it is: none.
    """
    joined = members.join(results, "key")
    smallest = order_id(F.col("doc_id")) == F.col("first")
    columns = [F.when(smallest, F.col(c)).when(F.col(count) >= window, whole[c]).otherwise(none[c]).alias(c) for c in whole]
    return joined.select("doc_id", count, *columns)
