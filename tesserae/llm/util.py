"""Helpers of the training-data operators: Arrow text buffers, vectorised words and hashes, written frames."""

from __future__ import annotations

import functools
import gc
import time
import uuid
from collections.abc import Callable, Iterator
from contextvars import ContextVar

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from ..session import shared_folder

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
SPACE = np.zeros(256, bool)
SPACE[[32, 9, 10, 11, 12, 13]] = True
#: Text of one batch is worked on in slices of about this many bytes, so that memory does not follow the batch.
SLICE = 1_200_000


#: Bytes of one Arrow batch that a Python worker is sent, for whole texts of any length.
BATCH = 4_000_000
_BATCH_SETTING = "spark.sql.execution.arrow.maxBytesPerBatch"


def bounded_batches(df: DataFrame) -> DataFrame:
    """df, in a session that cuts Arrow batches by their bytes as well as by rows; a smaller setting stays."""
    conf = df.sparkSession.conf
    held = conf.get(_BATCH_SETTING).rstrip("bB")
    if not held.isdigit() or not 0 < int(held) <= BATCH:
        conf.set(_BATCH_SETTING, str(BATCH))
    return df


def ascii_lower(text: Column) -> Column:
    """Lower-case A-Z only; null becomes the empty string."""
    return F.translate(F.coalesce(text, F.lit("")), UPPER, LOWER)


#: Paths written within `settled`, if there is one.
_meanwhile: ContextVar[list[str] | None] = ContextVar("meanwhile", default=None)


def written(df: DataFrame) -> DataFrame:
    """Write a frame to the shared folder, read it back, and let go of the shuffle files behind it."""
    spark, schema = df.sparkSession, df.schema
    path = f"{shared_folder(spark).rstrip('/')}/llm-{spark.sparkContext.applicationId}/{uuid.uuid4().hex}.parquet"
    if (paths := _meanwhile.get()) is not None:
        paths.append(path)
    df.write.option("compression", "zstd").parquet(path)
    del df  # the caller passes the only reference, so its shuffles are unused now
    release(spark)
    out = spark.read.schema(schema).parquet(path)
    out.written_paths = [path]
    return out


def together(frames: list[DataFrame]) -> DataFrame:
    """Union of written frames, itself written."""
    out = functools.reduce(DataFrame.unionByName, frames)
    out.written_paths = [path for frame in frames for path in frame.written_paths]
    return out


def discard(df: DataFrame) -> None:
    """Delete the files of a written frame that nothing reads any more."""
    _delete(df.sparkSession, df.written_paths)


def _delete(spark: SparkSession, paths: list[str]) -> None:
    context = spark.sparkContext
    for name in paths:
        path = context._jvm.org.apache.hadoop.fs.Path(name)
        path.getFileSystem(context._jsc.hadoopConfiguration()).delete(path, True)


def settled(spark: SparkSession, make: Callable[[], DataFrame]) -> DataFrame:
    """make(), written; whatever else was written on the way is deleted, so only the answer takes room later."""
    token = _meanwhile.set(left := [])
    try:
        out = written(make())
        left.remove(out.written_paths[0])
    finally:
        _meanwhile.reset(token)
        _delete(spark, left)
    if (outer := _meanwhile.get()) is not None:
        outer.extend(out.written_paths)
    return out


def release(spark: SparkSession) -> None:
    """Spark deletes shuffle files once the driver's garbage collector finds them unused.

    Listeners hold a query for a moment after its end, hence a second look.
    """
    for _ in range(2):
        gc.collect()
        spark.sparkContext._jvm.System.gc()
        time.sleep(0.3)


def free_name(df: DataFrame, base: str = "_key") -> str:
    """A column name that the frame does not have."""
    taken = {c.lower() for c in df.columns}
    while base in taken:
        base += "_"
    return base


def order_id(doc_id: Column) -> Column:
    """doc_id for comparisons: a null one is larger than any other."""
    return F.coalesce(doc_id.cast("long"), F.lit(2**63 - 1))


def distinct_texts(docs: DataFrame, text: Column, parts: int = 1) -> tuple[DataFrame, DataFrame]:
    """(members, texts): docs as (doc_id, key), and one written row per distinct text.

    texts: uid long (unique), key, first long (smallest doc_id), text. A text held by a third of the rows is
    combined within each task before it is shuffled, so it arrives as one row per task. With more parts, one after
    the other is shuffled, by the length in bytes of docs.text, which `text` must then keep.
    """
    docs = bounded_batches(docs)
    own = F.octet_length(F.coalesce("text", F.lit("")))

    def keyed(rows: DataFrame) -> DataFrame:
        rows = rows.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(text, F.lit("")).alias("text"))
        return rows.select("doc_id", "text", F.md5("text").alias("key"))

    done = []
    for part in range(parts):
        some = docs.where(F.pmod(F.xxhash64(own), F.lit(parts)) == part) if parts > 1 else docs
        texts = keyed(some).groupBy("key").agg(F.min(order_id(F.col("doc_id"))).alias("first"), F.first("text").alias("text"))
        done.append(written(texts.select((F.monotonically_increasing_id() * parts + part).alias("uid"), "key", "first", "text")))
    return keyed(docs).select("doc_id", "key"), together(done)


def text_buffer(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """UTF-8 bytes of a string column and its n+1 offsets into them; null is empty."""
    column = column.cast(pa.large_string()).fill_null("") if column.null_count else column.cast(pa.large_string())
    _, offsets, data = column.buffers()
    at = np.frombuffer(offsets, np.int64)[column.offset : column.offset + len(column) + 1]
    if data is None or not len(column):
        return np.zeros(0, np.uint8), np.zeros(len(column) + 1, np.int64)
    return np.frombuffer(data, np.uint8)[at[0] : at[-1]], at - at[0]


def slices(batch: pa.RecordBatch, column: str = "text") -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(first row, last row, bytes, offsets) of consecutive rows with about SLICE bytes of text together."""
    data, at = text_buffer(batch.column(batch.schema.get_field_index(column)))
    row = 0
    while row < len(at) - 1:
        end = max(row + 1, int(np.searchsorted(at, at[row] + SLICE, "right")) - 1)
        yield row, end, data[at[row] : at[end]], at[row : end + 1] - at[row]
        row = end
    pa.default_memory_pool().release_unused()


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective 64-bit finaliser."""
    x = x.astype(np.uint64, copy=True)
    x ^= x >> np.uint64(33)
    x *= np.uint64(0xFF51AFD7ED558CCD)
    x ^= x >> np.uint64(33)
    x *= np.uint64(0xC4CEB9FE1A85EC53)
    x ^= x >> np.uint64(33)
    return x


_BYTES = np.random.default_rng(20250101).integers(1, 2**63, 256, dtype=np.uint64) | np.uint64(1)
_BASE = 0x9E3779B97F4A7C15
_INVERSE = pow(_BASE, -1, 2**64)
_powers: dict[int, np.ndarray] = {}


def powers(base: int, n: int) -> np.ndarray:
    """base**0 .. base**(n-1) modulo 2**64."""
    got = _powers.get(base)
    if got is None or len(got) < n:
        got = np.full(max(n, 1 << 16), base, np.uint64)
        got[0] = 1
        _powers[base] = got = np.cumprod(got)
    return got[:n]


class Rolling:
    """Hashes of any stretch of a sequence of 64-bit values from one running sum (modulo 2**64)."""

    def __init__(self, values: np.ndarray, base: int = _BASE):
        self.inverse = powers(pow(base, -1, 2**64), len(values) + 1)
        self.sums = np.zeros(len(values) + 1, np.uint64)
        np.cumsum(values * powers(base, len(values)), out=self.sums[1:])

    def __call__(self, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
        return mix((self.sums[ends] - self.sums[starts]) * self.inverse[starts] + (ends - starts).astype(np.uint64))


def byte_values(data: np.ndarray) -> np.ndarray:
    return _BYTES[data]


def words_of(data: np.ndarray, offsets: np.ndarray, separator: np.ndarray = SPACE) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(starts, ends, first): byte ranges of all words, and the n+1 word numbers where each text begins."""
    inside = ~separator[data]
    if not len(data):
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(len(offsets), np.int64)
    begins, ends = inside.copy(), inside.copy()
    begins[1:] &= ~inside[:-1]
    ends[:-1] &= ~inside[1:]
    cuts = offsets[1:-1]
    cuts = cuts[(cuts > 0) & (cuts < len(data))]
    begins[cuts] = inside[cuts]
    ends[cuts - 1] = inside[cuts - 1]
    starts = np.flatnonzero(begins)
    return starts, np.flatnonzero(ends) + 1, np.searchsorted(starts, offsets, "left")


_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32


def lowered(data: np.ndarray) -> np.ndarray:
    return _LOWER[data]


def word_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    return Rolling(byte_values(data))(starts, ends)


def signed(x: np.ndarray) -> np.ndarray:
    """The same 64 bits as Spark's long."""
    return x.view(np.int64)


def stretches(starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """All positions of the given stretches, one after the other."""
    total = int(lengths.sum())
    if not total:
        return np.zeros(0, np.int64)
    ends = np.cumsum(lengths)
    return np.arange(total, dtype=np.int64) + np.repeat(starts - (ends - lengths), lengths)


def arrow(schema: pa.Schema, *columns) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([c if isinstance(c, pa.Array) else pa.array(c, f.type) for c, f in zip(columns, schema, strict=True)], schema=schema)
