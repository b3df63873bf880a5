"""Substring deduplication by difference-cover anchors.

A window is `window` consecutive words of one document, words being [^\\x20\\x09-\\x0D]+ of the whole text, unchanged.
A word is removed if a window covers it whose word sequence also starts in a document with a smaller doc_id.

How it runs. Anchors are stretches of window - period + 1 words that start at positions whose remainder modulo
`period` lies in a difference cover: for any two windows, wherever they start, some offset below period puts both
on the cover. So two equal windows share an anchor at the same offset, and only a fifth of all positions need a
hash. Anchors that occur in one text only are dropped; around the others the windows that contain them are
extended to and compared in full by a hash of 128 bits, and the smallest doc_id that holds each is found. Equal
texts are worked on once.

Null texts have no words. A null doc_id is larger than any other; documents with the same doc_id do not remove
from each other. Repeated rows repeat; an empty table gives an empty result; further columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window, functions as F

from . import repeats
from .util import Rolling, discard, distinct_texts, mix, signed, slices, stretches, together, word_hashes, words_of, written

WINDOW, PERIOD = 50, 31
#: Windows are shuffled in so many parts by their hash, one after the other, so that shuffle files take less room.
PARTS = 2
_SECOND = 0xD1342543DE82EF95


def difference_cover(period: int) -> list[int]:
    """Residues such that every residue is a difference of two of them; greedy, and perfect where known."""
    if period == 31:
        return [1, 5, 11, 24, 25, 27]
    cover, open_ = [0], set(range(1, period))
    while open_:
        best = max(range(period), key=lambda x: len(open_ & {(s * (x - c)) % period for c in cover for s in (1, -1)}))
        open_ -= {(s * (best - c)) % period for c in cover for s in (1, -1)}
        cover.append(best)
    return sorted(cover)


def _anchors(batches: Iterator[pa.RecordBatch], window: int, period: int) -> Iterator[pa.RecordBatch]:
    on_cover = np.zeros(period, bool)
    on_cover[difference_cover(period)] = True
    length = window - period + 1

    def found():
        for batch in batches:
            uid = batch.column(0).to_numpy()
            for a, _, data, offsets in slices(batch):
                starts, ends, first = words_of(data, offsets)
                count = np.diff(first)
                # Texts shorter than a window have none, and need no anchor.
                places = np.where(count >= window, count - length + 1, 0)
                pos = stretches(np.zeros(len(count), np.int64), places)
                text = np.repeat(np.arange(len(count)), places)
                keep = on_cover[pos % period]
                pos, text = pos[keep], text[keep]
                at = first[text] + pos
                yield Rolling(word_hashes(data, starts, ends))(at, at + length), uid[a + text], pos

    for arrays in repeats.batched(found()):
        yield repeats.seen_rows(*arrays)


_PLACE = pa.struct([("uid", pa.int64()), ("first", pa.int64()), ("start", pa.int32())])
_WINDOW = pa.schema([("hash", pa.int64()), ("other", pa.int64()), ("first", pa.int64()), ("uid", pa.int64()), ("start", pa.int32()), ("more", pa.list_(_PLACE))])
_WINDOW_SQL = "hash long, other long, first long, uid long, start int, more array<struct<uid: long, first: long, start: int>>"


def _windows(batches: Iterator[pa.RecordBatch], window: int, period: int, part: int) -> Iterator[pa.RecordBatch]:
    """Windows around recurring anchors whose hash falls into the part; one row for each distinct one of a batch, led
    by its smallest document."""

    def found():
        for batch in batches:
            uid, smallest = batch.column(0).to_numpy(), batch.column(1).to_numpy()
            lists = batch.column(3)
            cuts, values = lists.offsets.to_numpy(), lists.values.to_numpy()
            for a, b, data, offsets in slices(batch):
                starts, ends, first = words_of(data, offsets)
                text = np.repeat(np.arange(b - a), np.diff(cuts[a : b + 1]))
                pos = values[cuts[a] : cuts[b]].astype(np.int64)
                # A window contains the anchor at offset 0 .. period - 1; it must lie inside its text.
                low = np.maximum(pos - period + 1, 0)
                high = np.minimum(pos, np.diff(first)[text] - window)
                ok = high >= low
                base = first[text][ok]
                hit = np.flatnonzero(repeats.covered(len(starts), base + low[ok], base + high[ok] + 1))
                words = word_hashes(data, starts, ends)
                one = Rolling(words)(hit, hit + window)
                mine = np.flatnonzero(one % np.uint64(PARTS) == part)
                hit, one = hit[mine], one[mine]
                owner = np.searchsorted(first, hit, "right") - 1
                two = Rolling(mix(words + np.uint64(1)), _SECOND)(hit, hit + window)
                yield one, two, uid[a + owner], smallest[a + owner], (hit - first[owner]).astype(np.int32)

    for one, *rest in repeats.batched(found()):
        order = np.argsort(one)
        one, two, uid, head, start = one[order], *(c[order] for c in rest)
        change = (one[1:] != one[:-1]) | (two[1:] != two[:-1])
        # Where a window occurs more than once, its smallest document comes first.
        group = np.cumsum(np.append(True, change))
        shared = np.flatnonzero(np.append(~change, False) | np.append(False, ~change))
        inner = shared[np.lexsort((head[shared], group[shared]))]
        uid[shared], start[shared], head[shared] = uid[inner], start[inner], head[inner]
        _, begins, more = repeats.grouped(change, _PLACE, [uid, head, start])
        yield pa.RecordBatch.from_arrays([pa.array(signed(one[begins])), pa.array(signed(two[begins])), pa.array(head[begins]), pa.array(uid[begins]), pa.array(start[begins]), more], schema=_WINDOW)


_RESULT = pa.schema([("key", pa.string()), ("first", pa.int64()), ("n_words", pa.int64()), ("n_removed", pa.int64()), ("kept_text", pa.string()), ("full_text", pa.string())])


def _joined(data: np.ndarray, starts: np.ndarray, ends: np.ndarray, first: np.ndarray, keep: np.ndarray) -> list[bytes]:
    """The kept words of each text, joined by one space."""
    number = np.flatnonzero(keep)
    size = ends[number] - starts[number]
    line = np.full(int(size.sum()) + len(number), 32, np.uint8)
    line[np.arange(int(size.sum())) + np.repeat(np.arange(len(number)), size)] = data[stretches(starts[number], size)]
    at = np.append(0, np.cumsum(size + 1))[np.searchsorted(number, first)]
    raw = line.tobytes()
    return [raw[i : max(i, j - 1)] for i, j in zip(at[:-1], at[1:], strict=True)]


def _remove(batches: Iterator[pa.RecordBatch], window: int) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        lists = batch.column(4)
        cuts, values = lists.offsets.to_numpy(), lists.values.to_numpy()
        for a, b, data, offsets in slices(batch):
            starts, ends, first = words_of(data, offsets)
            text = np.repeat(np.arange(b - a), np.diff(cuts[a : b + 1]))
            at = first[text] + values[cuts[a] : cuts[b]]
            gone = repeats.covered(len(starts), at, at + window)
            removed = np.bincount(np.repeat(np.arange(b - a), np.diff(first))[gone], minlength=b - a)
            count = np.diff(first)
            kept = _joined(data, starts, ends, first, ~gone)
            # The text as it is matters for copies of it only if it has no window.
            full = [t if n < window else b"" for t, n in zip(kept, count, strict=True)]
            part = batch.slice(a, b - a)
            yield pa.RecordBatch.from_arrays([part.column(1), part.column(2), pa.array(count), pa.array(removed), pa.array(kept, pa.binary()).cast(pa.string()), pa.array(full, pa.binary()).cast(pa.string())], schema=_RESULT)


def by_text(docs: DataFrame, window: int = WINDOW, period: int = PERIOD) -> tuple[DataFrame, DataFrame]:
    """(members, results): docs as (doc_id, key); key, first, n_words, n_removed, kept_text, full_text per text.

    full_text is the words of a text that is shorter than a window, for its copies; else it is empty.
    """
    if not 0 < period <= window:
        raise ValueError("the period must not exceed the window")
    members, texts = distinct_texts(docs, F.col("text"))
    seen = texts.select("uid", "text").mapInArrow(lambda b: _anchors(b, window, period), repeats.SEEN_SQL)
    places = written(repeats.recurring(seen))
    near = written(texts.select("uid", "first", "text").join(places, "uid").select("uid", "first", "text", "places"))
    discard(places)

    def removals(part: int) -> DataFrame:
        windows = near.mapInArrow(lambda b: _windows(b, window, period, part), _WINDOW_SQL)
        held = windows.withColumn("smallest", F.min("first").over(Window.partitionBy("hash", "other")))
        # Rows whose only place is the smallest document remove nothing.
        held = held.where("more is not null or first > smallest")
        lead = F.array(F.struct("uid", "first", "start"))
        each = held.select("smallest", F.explode(F.when(F.col("more").isNull(), lead).otherwise(F.concat(lead, "more"))).alias("p")).where("p.first > smallest")
        return each.groupBy("p.uid").agg(F.collect_list("p.start").alias("starts"))

    starts = together([written(removals(part)) for part in range(PARTS)])
    discard(near)
    starts = starts.groupBy("uid").agg(F.flatten(F.collect_list("starts")).alias("starts"))
    rows = texts.join(starts, "uid", "left").select("uid", "key", "first", "text", F.coalesce("starts", F.array().cast("array<int>")).alias("starts"))
    return members, rows.mapInArrow(lambda b: _remove(b, window), "key string, first long, n_words long, n_removed long, kept_text string, full_text string")


def substring_dedup(docs: DataFrame, window: int = WINDOW, period: int = PERIOD) -> DataFrame:
    """docs(doc_id, text) -> doc_id, n_words, n_removed, kept_text (kept words joined by one space)."""
    members, results = by_text(docs, window, period)
    return repeats.answers(members, results, window, "n_words", {"n_removed": F.col("n_words"), "kept_text": F.lit("")}, {"n_removed": F.lit(0).cast("long"), "kept_text": F.col("full_text")})
