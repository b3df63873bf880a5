"""Exact deduplication by Grace hashing.

Texts are equal when identical after lower-casing A-Z; null counts as the empty text. Of equal texts the row
with the largest doc_id stays; a null doc_id is smaller than any other, and of repeated rows with that doc_id
exactly one stays. Every row of the input gives one row of the result. An empty table gives an empty result.
Only doc_id and text are read, so further columns cannot clash.

How it runs. Each task first combines its own rows in an open-addressing table that compares whole texts, so a
text held by a third of all rows leaves a task as one row. These rows, and a narrow row for each document, are
written to the shared folder. The combined rows are then dealt to buckets by their hash; a bucket whose distinct
content is larger than a table may be is dealt again with further hash bits, written and weighed again, until
every bucket fits. Each bucket that fits is settled in one table. Documents get their answer by a join on the
row that their task made for their text, a key that never holds more rows than one task has read.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, functions as F

from .util import ascii_lower, free_name, settled, written

#: Bytes of distinct text that one table may hold when a bucket is settled, and while a task scans.
TABLE_BYTES = 16_000_000
SCAN_BYTES = 16_000_000
#: Buckets that an oversized bucket is dealt to.
FANOUT = 16

_SCHEMA = "rep long, row long, doc_id long, sha string, hash long, text string, size long, n long"
_ARROW = pa.schema([("rep", pa.int64()), ("row", pa.int64()), ("doc_id", pa.int64()), ("sha", pa.string()), ("hash", pa.int64()), ("text", pa.string()), ("size", pa.int64()), ("n", pa.int64())])


class TextTable:
    """Open addressing with linear probing; an entry is equal only if hash and complete text are equal."""

    def __init__(self, capacity: int = 1024):
        self.texts: list[str] = []
        self.hashes: list[int] = []
        self.slots = [-1] * capacity
        self.bytes = 0

    def find(self, key: int, text: str) -> int:
        """Number of the entry, which is added if it is new."""
        slots, mask = self.slots, len(self.slots) - 1
        at = key & mask
        while (entry := slots[at]) >= 0:
            if self.hashes[entry] == key and self.texts[entry] == text:
                return entry
            at = (at + 1) & mask
        slots[at] = entry = len(self.texts)
        self.texts.append(text)
        self.hashes.append(key)
        self.bytes += len(text)
        if 3 * len(self.texts) > 2 * len(slots):
            self._grow()
        return entry

    def _grow(self) -> None:
        self.slots = slots = [-1] * (2 * len(self.slots))
        mask = len(slots) - 1
        for entry, key in enumerate(self.hashes):
            at = key & mask
            while slots[at] >= 0:
                at = (at + 1) & mask
            slots[at] = entry


def _combine(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(rep, row, doc_id, sha) of each document and (rep, row, doc_id, hash, text, size, n) of each text of a task.

    row of a text is the document with the largest doc_id that the task has seen so far.
    """
    part = TaskContext.get().partitionId() << 33
    rows = reps = 0
    table, best, best_row, count = TextTable(), [], [], []

    def texts() -> Iterator[pa.RecordBatch]:
        n = len(table.texts)
        step = max(1, 4_000_000 * n // (table.bytes + 1))
        for i in range(0, n, step):
            some = slice(i, min(n, i + step))
            text = pa.array(table.texts[some], pa.string())
            sizes = [len(t.encode()) for t in table.texts[some]]
            yield pa.RecordBatch.from_arrays(
                [pa.array(range(part + reps + some.start, part + reps + some.stop), pa.int64()), pa.array(best_row[some], pa.int64()), pa.array(best[some], pa.int64()), pa.nulls(len(text), pa.string()), pa.array(table.hashes[some], pa.int64()), text, pa.array(sizes, pa.int64()), pa.array(count[some], pa.int64())],
                schema=_ARROW,
            )

    for batch in batches:
        ids, hashes, contents = (batch.column(i).to_pylist() for i in (0, 2, 3))
        found = []
        for number, (doc_id, key, text) in enumerate(zip(ids, hashes, contents, strict=True), rows):
            entry = table.find(key, text)
            if entry == len(best):
                best.append(doc_id)
                best_row.append(part + number)
                count.append(1)
            else:
                count[entry] += 1
                if doc_id is not None and (best[entry] is None or doc_id > best[entry]):
                    best[entry], best_row[entry] = doc_id, part + number
            found.append(part + reps + entry)
        n = len(ids)
        none = pa.nulls(n, pa.int64())
        yield pa.RecordBatch.from_arrays([pa.array(found, pa.int64()), pa.array(range(part + rows, part + rows + n), pa.int64()), pa.array(ids, pa.int64()), batch.column(1), none, pa.nulls(n, pa.string()), none, none], schema=_ARROW)
        rows += n
        if table.bytes > SCAN_BYTES:
            yield from texts()
            reps += len(table.texts)
            table, best, best_row, count = TextTable(), [], [], []
    yield from texts()


def _settle(rows: pd.DataFrame) -> pd.DataFrame:
    """Combined rows of one bucket -> (rep, keep_row, keep_id, group_size)."""
    table = TextTable()
    entry = [table.find(int(key), text) for key, text in zip(rows["hash"], rows["text"], strict=True)]
    rows = pd.DataFrame({"rep": rows["rep"], "entry": entry, "row": rows["row"], "best": rows["doc_id"].astype("Int64"), "n": rows["n"]})
    kept = rows.sort_values(["best", "row"], ascending=[False, True], na_position="last").drop_duplicates("entry").set_index("entry")
    sizes = rows.groupby("entry")["n"].sum()
    return pd.DataFrame({"rep": rows["rep"], "keep_row": rows["entry"].map(kept["row"]), "keep_id": rows["entry"].map(kept["best"]), "group_size": rows["entry"].map(sizes)})


def _buckets(level: DataFrame, table_bytes: int, fanout: int) -> list[DataFrame]:
    """Frames of (rep, row, doc_id, hash, text, n, bucket) whose buckets all fit a table."""
    total = level.agg(F.coalesce(F.sum("size"), F.lit(0))).first()[0]
    first = max(1, -(-2 * total // table_bytes))
    level, depth, fitting = level.withColumn("bucket", F.pmod(F.xxhash64("hash", F.lit(0)), F.lit(first))), 0, []
    while True:
        # Repeated texts share an entry of the table, so a bucket weighs as much as its distinct content.
        distinct = level.groupBy("bucket", "hash").agg(F.max("size").alias("size"))
        weights = distinct.groupBy("bucket").agg(F.sum("size").alias("bytes"), F.count(F.lit(1)).alias("keys"))
        large = written(weights.where((F.col("bytes") > table_bytes) & (F.col("keys") > 1)).select("bucket"))
        if not large.limit(1).count():
            return [*fitting, level]
        fitting.append(level.join(large, "bucket", "left_anti"))
        depth += 1
        deal = F.xxhash64("bucket", F.pmod(F.xxhash64("hash", F.lit(depth)), F.lit(fanout)))
        level = written(level.join(large, "bucket", "left_semi").withColumn("bucket", deal))


def exact_dedup(docs: DataFrame, table_bytes: int = TABLE_BYTES, fanout: int = FANOUT) -> DataFrame:
    """docs(doc_id, text, ...) -> doc_id, keep_id, group_size, kept, text_sha256, one row per document."""
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), ascii_lower(F.col("text")).alias("text"))
    rows = rows.select("doc_id", F.sha2("text", 256).alias("sha"), F.xxhash64("text").alias("hash"), "text")
    combined = written(rows.mapInArrow(_combine, _SCHEMA))
    answers = None
    for part in _buckets(combined.where("n is not null").drop("sha"), table_bytes, fanout):
        one = part.groupBy("bucket").applyInPandas(_settle, "rep long, keep_row long, keep_id long, group_size long")
        answers = one if answers is None else answers.unionByName(one)
    found = combined.where("n is null").select("rep", "row", "doc_id", "sha").join(answers, "rep")
    return found.select("doc_id", "keep_id", "group_size", (F.col("row") == F.col("keep_row")).alias("kept"), F.col("sha").alias("text_sha256"))


def kept_rows(docs: DataFrame, **options) -> DataFrame:
    """The rows of docs that stay, with all their columns; of rows repeated in doc_id and text one stays."""
    key = free_name(docs)
    named = F.sha2(F.concat_ws(":", "doc_id", "text_sha256"), 256).alias(key)
    stay = settled(docs.sparkSession, lambda: exact_dedup(docs, **options).where("kept").select(named))
    lowered = F.sha2(ascii_lower(F.col("text")), 256)
    keyed = docs.withColumn(key, F.sha2(F.concat_ws(":", F.col("doc_id").cast("long"), lowered), 256))
    return keyed.join(stay, key, "left_semi").dropDuplicates([key]).drop(key)
