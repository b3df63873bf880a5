"""Sequence packing: first-fit decreasing with a tournament tree over the bins, in randomised groups.

Documents become token ids (a null text is empty) with one closing id, and are cut at multiples of the sequence
length; a document that fits a sequence stays whole. The pieces are dealt at random, with a fixed seed, to
groups of about GROUP pieces; within a group they are taken from the longest to the shortest and each goes to
the first sequence with enough room, found by descending a tree of maxima over the free room. Groups are
independent, so memory and time of a task are bounded by GROUP, and one unfilled sequence or two per group is
what independence costs. Ties in length are taken in the order of doc_id and start. Repeated rows are packed
as often as they occur; a null doc_id is kept as it is; an empty table gives no piece. Columns of the input other
than doc_id and text are not read.
"""

from __future__ import annotations

import functools
import struct
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from .util import written

LENGTH = 4096
GROUP = 20_000
#: Encoded words that a worker remembers before it starts afresh.
REMEMBERED = 450_000
#: ASCII punctuation but the apostrophe, which belongs to contractions.
_TRAILING = "!\"#$%&()*+,-./:;<=>?@[\\]^_`{|}~"

#: Byte-level models show bytes that are not printable in Latin-1 as the characters from 256 on.
_SHOWN = {b: 256 + i for i, b in enumerate(b for b in range(256) if not (33 <= b <= 126 or 161 <= b <= 172 or 174 <= b))}


class Remembered(dict):
    """Values of a function, kept while they are in use: when full, what was not asked for lately is let go."""

    def __init__(self, make, most: int = REMEMBERED):
        super().__init__()
        self.make, self.most, self.older = make, most, {}

    def __missing__(self, key: str) -> bytes:
        value = self.older.get(key)
        if value is None:
            value = self.make(key)
        if len(self) >= self.most:
            self.older = dict(self)
            self.clear()
        self[key] = value
        return value


class WordEncoder:
    """Token ids of texts by way of their words.

    For tokenizers whose pre-tokeniser drops white space and parts letters from punctuation, the ids of a text are
    those of its words one after the other, and those of a word of letters with punctuation after it are those of
    the two. ASCII letters in lower case are what the model itself sees.
    """

    def __init__(self, path: str):
        import os

        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # a task has one core
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.model = self.tokenizer.model
        self.parts = Remembered(self._part)
        self.words = Remembered(self._word)

    def _part(self, part: str) -> bytes:
        if part.isalpha() and max(part) < "\u0130":  # letters whose lower case and composed form are plain
            return _code([t.id for t in self.model.tokenize(part.lower().encode().decode("latin-1").translate(_SHOWN))])
        return _code(self.tokenizer.encode(part, add_special_tokens=False).ids)

    def _word(self, word: str) -> bytes:
        core = word.rstrip(_TRAILING)
        if not core.isalpha():
            return self.parts[word]
        return self.parts[core.lower() if core.isascii() else core] + (self.parts[word[len(core) :]] if len(core) < len(word) else b"")

    def __call__(self, text: str) -> bytes:
        """Little-endian unsigned 32-bit ids."""
        words = self.words
        return b"".join([words[w] for w in text.replace("\n", " ").replace("\t", " ").replace("\r", " ").split(" ")])


def _code(ids: list[int]) -> bytes:
    return struct.pack(f"<{len(ids)}I", *ids)


@functools.lru_cache(maxsize=1)
def encoder(path: str) -> WordEncoder:
    """One encoder for all tasks of a Python worker."""
    return WordEncoder(path)


_PIECES = pa.schema([("doc_id", pa.int64()), ("start", pa.int64()), ("length", pa.int64()), ("doc_tokens", pa.int64()), ("ids", pa.binary())])


def pieces(docs: DataFrame, tokenizer: str, closing: int, length: int = LENGTH) -> DataFrame:
    """docs(doc_id, text) -> doc_id, start, length, doc_tokens, ids (little-endian unsigned 32-bit)."""

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode, end = encoder(tokenizer), np.array([closing], "<u4").tobytes()
        for batch in (b.slice(i, 512) for b in batches for i in range(0, b.num_rows, 512)):
            ids, texts = batch.column(0).to_pylist(), batch.column(1).to_pylist()
            rows: list[list] = [[], [], [], [], []]
            held = 0

            def out(rows=rows):
                return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(rows, _PIECES, strict=True)], schema=_PIECES)

            for doc_id, text in zip(ids, texts, strict=True):
                code = encode(text) + end
                total = len(code) // 4
                for start in range(0, total, length):
                    piece = code[4 * start : 4 * (start + length)]
                    for column, value in zip(rows, (doc_id, start, len(piece) // 4, total, piece), strict=True):
                        column.append(value)
                    held += len(piece)
                    if held > 8_000_000:
                        yield out()
                        held = 0
                        for column in rows:
                            column.clear()
            yield out()

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text"))
    return rows.mapInArrow(cut, "doc_id long, start long, length long, doc_tokens long, ids binary")


class Bins:
    """Free room of open bins under a tournament tree of maxima; find() is the first bin that has the room."""

    def __init__(self, capacity: int, most: int):
        self.size = 1 << max(0, (most - 1).bit_length())
        self.tree = [capacity] * (2 * self.size)

    def put(self, length: int) -> tuple[int, int]:
        """(bin, room before) of the first bin with room for `length`, which is taken."""
        tree, node, size = self.tree, 1, self.size
        while node < size:
            node *= 2
            if tree[node] < length:
                node += 1
        room = tree[node]
        tree[node] = room - length
        at = node
        while at > 1:
            at //= 2
            best = tree[2 * at] if tree[2 * at] >= tree[2 * at + 1] else tree[2 * at + 1]
            if tree[at] == best:
                break
            tree[at] = best
        return node - size, room


def first_fit_decreasing(lengths: list[int], capacity: int) -> tuple[list[int], list[int]]:
    """(bin, offset) of each item, given from the longest to the shortest."""
    bins = Bins(capacity, max(1, len(lengths)))
    where = [bins.put(n) for n in lengths]
    return [b for b, _ in where], [capacity - room for _, room in where]


def pack(items: DataFrame, length: int = LENGTH, group: int = GROUP, seed: int = 17) -> DataFrame:
    """items(doc_id, start, length, ...) -> the same columns with sequence_id and offset.

    Other columns travel along, ids for instance. An item longer than a sequence is an error.
    """
    items = written(items)
    groups = max(1, -(-items.count() // group))
    dealt = items.withColumn("_group", F.floor(F.rand(seed) * groups).cast("long"))

    def place(key: tuple, rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values(["length", "doc_id", "start"], ascending=[False, True, True], kind="stable").drop(columns="_group")
        if len(rows) and rows["length"].iloc[0] > length:
            raise ValueError("an item is longer than a sequence")
        bins, offsets = first_fit_decreasing(rows["length"].tolist(), length)
        return rows.assign(sequence_id=np.array(bins, np.int64) + (int(key[0]) << 32), offset=np.array(offsets, np.int64))

    schema = ", ".join(f"`{n}` {t}" for n, t in items.dtypes)
    return dealt.groupBy("_group").applyInPandas(place, f"{schema}, sequence_id long, offset long")


def sequences(packed: DataFrame, pad: int, length: int = LENGTH) -> DataFrame:
    """Packed pieces with ids -> sequence_id, tokens, ids: whole sequences, padded unless they hold a power of two."""
    ordered = F.array_sort(F.collect_list(F.struct("offset", "length", "ids")))
    rows = packed.groupBy("sequence_id").agg(ordered.alias("parts"), F.sum("length").alias("tokens"))
    joined = F.aggregate("parts", F.lit(b"").cast("binary"), lambda a, p: F.concat(a, p["ids"]))
    one = F.lit(int(pad).to_bytes(4, "little")).cast("binary")
    full = F.bit_count("tokens") == 1
    padding = F.when(full, F.lit(b"").cast("binary")).otherwise(F.unhex(F.repeat(F.hex(one), (F.lit(length) - F.col("tokens")).cast("int"))))
    return rows.select("sequence_id", "tokens", F.concat(joined, padding).alias("ids"))
