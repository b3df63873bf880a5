"""Removal of repeated byte strings by suffix arrays that are built in two stages.

A text is its UTF-8 bytes. A byte is removed if a string of `window` bytes covers it that also starts in a document
with a smaller doc_id. Matches never cross documents, overlaps count.

How it runs. A suffix array of all texts would pass through one task, so the strings are first dealt out: each
string of `window` bytes belongs to the smallest of the hashes of its GRAM-byte pieces, which equal strings share.
Hashes that occur in one text only are dropped, as no string of theirs can recur. For the others the stretch of
text whose strings belong to that occurrence is cut out and sent to the bucket of its hash; equal stretches are sent
and sorted once. In a bucket the stretches are laid end to end and their suffix array is built: suffixes that are
smaller than their successor are sorted directly, the rest follow from them by scans over the buckets of first
bytes; sorting goes as deep as `window` bytes, since nothing beyond is asked for. Neighbours in the array whose
common prefix is `window` long hold the same string, and the smallest doc_id of each such group decides.

Null texts are empty. A null doc_id is larger than any other; documents with the same doc_id do not remove from
each other. Equal texts are worked on once. Repeated rows repeat; an empty table gives an empty result; further
columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from . import repeats
from .util import distinct_texts, signed, slices, stretches, written

WINDOW, GRAM = 50, 16
#: Bytes of all texts for each bucket of stretches; a bucket holds a share of those that recur.
PER_BUCKET = 2_000_000
#: The byte between stretches; UTF-8 has no such byte.
_BETWEEN = 255


# --- suffix arrays ----------------------------------------------------------------------------------------------


def _eight(line: np.ndarray, n: int, at: np.ndarray | None = None) -> np.ndarray:
    """The eight bytes from each position on, as a number that sorts like them; line is padded."""
    view = np.ndarray((n,), ">u8", line.data, strides=(1,))
    return (view if at is None else view[at]).astype(np.uint64)


def suffix_array(text: np.ndarray, depth: int) -> np.ndarray:
    """Positions in the order of their suffixes, compared as far as `depth` bytes; the end is smaller than any byte."""
    n = len(text)
    if not n:
        return np.zeros(0, np.int64)
    line = np.concatenate([text, np.zeros(depth + 16, np.uint8)])
    # A suffix is smaller than its successor if the next byte that differs from its first is larger.
    change = np.flatnonzero(text[1:] != text[:-1])
    rises = text[np.minimum(change + 1, n - 1)] > text[change]
    run = np.repeat(np.arange(len(change) + 1), np.diff(np.concatenate([[-1], change, [n - 1]])))
    smaller = np.append(rises, False)[run]
    direct = _sort_directly(line, np.flatnonzero(smaller), n, depth)

    # Second stage: buckets of first bytes in ascending order; in each, the induced suffixes, then the direct ones.
    first = text[direct]
    own = np.searchsorted(first, np.arange(257))
    pending: list[list[np.ndarray]] = [[] for _ in range(256)]
    if not smaller[n - 1]:
        pending[text[n - 1]].append(np.array([n - 1]))  # the empty suffix comes first and induces the last one

    def induce(done: np.ndarray, byte: int) -> np.ndarray:
        """Predecessors that are larger than their successors go to their buckets; those of this one are returned."""
        before = done[done > 0] - 1
        before = before[~smaller[before]]
        lead = text[before]
        here = before[lead == byte]
        rest = before[lead != byte]
        lead = text[rest]
        order = np.argsort(lead, kind="stable")
        rest, cuts = rest[order], np.searchsorted(lead[order], np.arange(257))
        for b in np.flatnonzero(np.diff(cuts)):
            pending[b].append(rest[cuts[b] : cuts[b + 1]])
        return here

    out = []
    for byte in range(256):
        wave = np.concatenate(pending[byte]) if pending[byte] else np.zeros(0, np.int64)
        while len(wave):  # runs of one byte induce within their own bucket
            out.append(wave)
            wave = induce(wave, byte)
        part = direct[own[byte] : own[byte + 1]]
        if len(part):
            out.append(part)
            induce(part, byte)
    return np.concatenate(out)


def _sort_directly(line: np.ndarray, rows: np.ndarray, n: int, depth: int) -> np.ndarray:
    """rows in the order of their suffixes, eight bytes at a time; only ties go on."""
    order = np.argsort(_eight(line, n, rows), kind="stable")
    rows = rows[order]
    key = _eight(line, n, rows)
    same = np.append(key[1:] == key[:-1], False)
    tied = np.flatnonzero(same | np.append(False, same[:-1]))
    group = np.cumsum(np.append(True, ~same[:-1]))[tied] if len(rows) else tied
    for offset in range(8, depth, 8):
        if not len(tied):
            break
        key = _eight(line, n + offset, rows[tied] + offset)
        order = np.lexsort((key, group))
        rows[tied] = rows[tied][order]
        key, group = key[order], group[order]
        same = np.append((key[1:] == key[:-1]) & (group[1:] == group[:-1]), False)
        keep = same | np.append(False, same[:-1])
        fresh = np.cumsum(np.append(True, ~same[:-1]))
        tied, group = tied[keep], fresh[keep]
    return rows


def common_prefixes(text: np.ndarray, order: np.ndarray, depth: int) -> np.ndarray:
    """Length of the common prefix of each suffix in order and the one before it, as far as depth; 0 for the first."""
    line = np.concatenate([text, np.zeros(depth + 16, np.uint8)])
    out = np.zeros(len(order), np.int64)
    left = np.arange(1, len(order))
    for offset in range(0, depth, 8):
        a, b = (_eight(line, len(text) + offset, order[left - k] + offset) for k in (0, 1))
        differ = a ^ b
        equal = differ == 0
        zeros = np.zeros(len(left), np.int64)
        for shift in range(8, 65, 8):  # leading bytes that agree
            zeros += (differ >> np.uint64(64 - shift)) == 0 if shift < 64 else equal
        out[left] += zeros
        left = left[equal]
    limit = len(text) - np.maximum(order, np.append(order[:1], order[:-1]))
    return np.minimum(np.minimum(out, depth), limit)


# --- dealing strings out ----------------------------------------------------------------------------------------


def _smallest(data: np.ndarray, offsets: np.ndarray, window: int, gram: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(window starts, position of the piece each belongs to, hash of that piece); all inside one text."""
    n, span = len(data), window - gram + 1
    if n < window:
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.uint64)
    line = np.concatenate([data, np.zeros(16, np.uint8)])
    count = n - gram + 1
    hashes = np.full(count, gram, np.uint64)
    for at in range(0, gram, 8):
        part = _eight(line, n, None)[at : at + count] if at + 8 <= gram else _eight(line, n, None)[at : at + count] >> np.uint64(8 * (8 - gram % 8))
        hashes = (hashes ^ part) * np.uint64(0x9E3779B97F4A7C15)
        hashes ^= hashes >> np.uint64(29)
    hashes *= np.uint64(0xC4CEB9FE1A85EC53)
    hashes ^= hashes >> np.uint64(32)
    # The leftmost piece with the smallest leading bits: they and the position make one number.
    low = np.uint64((1 << int(count).bit_length()) - 1)
    least = (hashes & ~low) | np.arange(count, dtype=np.uint64)
    reach = 1
    while 2 * reach <= span:
        least = np.minimum(least[:-reach], least[reach:])
        reach *= 2
    if reach < span:
        least = np.minimum(least[: len(least) - (span - reach)], least[span - reach :])
    sizes = np.maximum(np.diff(offsets) - window + 1, 0)
    starts = stretches(offsets[:-1], sizes)
    at = (least[starts] & low).astype(np.int64)
    return starts, at, hashes


def _pieces(batches: Iterator[pa.RecordBatch], window: int, gram: int) -> Iterator[pa.RecordBatch]:
    def found():
        for batch in batches:
            uid = batch.column(0).to_numpy()
            for a, _, data, offsets in slices(batch):
                _, at, hashes = _smallest(data, offsets, window, gram)
                if len(at):
                    at = at[np.append(True, at[1:] != at[:-1])]
                    text = np.searchsorted(offsets, at, "right") - 1
                    yield hashes[at], uid[a + text], at - offsets[text]

    for arrays in repeats.batched(found()):
        yield repeats.seen_rows(*arrays)


_PLACE = pa.struct([("uid", pa.int64()), ("first", pa.int64()), ("start", pa.int32())])
_STRETCH = pa.schema([("hash", pa.int64()), ("bytes", pa.binary()), ("first", pa.int64()), ("places", pa.list_(_PLACE))])
_STRETCH_SQL = "hash long, bytes binary, first long, places array<struct<uid: long, first: long, start: int>>"


def _stretches(batches: Iterator[pa.RecordBatch], window: int, gram: int) -> Iterator[pa.RecordBatch]:
    """Stretches of text whose strings belong to a recurring piece; equal ones of a batch share a row."""
    held: dict[bytes, int] = {}
    parts: list[tuple[np.ndarray, ...]] = []

    def out() -> Iterator[pa.RecordBatch]:
        kind, hashes, uid, first, start = (np.concatenate(c) for c in zip(*parts, strict=True))
        order = np.argsort(kind, kind="stable")
        cuts = np.searchsorted(kind[order], np.arange(len(held) + 1)).astype(np.int32)
        uid, first, start = uid[order], first[order], start[order]
        places = pa.StructArray.from_arrays([pa.array(uid), pa.array(first), pa.array(start)], fields=list(_PLACE))
        least = np.minimum.reduceat(first, cuts[:-1])
        yield pa.RecordBatch.from_arrays([pa.array(hashes[order][cuts[:-1]]), pa.array(list(held), pa.binary()), pa.array(least), pa.ListArray.from_arrays(pa.array(cuts), places)], schema=_STRETCH)
        held.clear()
        parts.clear()

    for batch in batches:
        uid, smallest = batch.column(0).to_numpy(), batch.column(1).to_numpy()
        lists = batch.column(3)
        cuts, values = lists.offsets.to_numpy(), lists.values.to_numpy()
        for a, b, data, offsets in slices(batch):
            starts, at, hashes = _smallest(data, offsets, window, gram)
            text = np.repeat(np.arange(b - a), np.diff(cuts[a : b + 1]))
            wanted = np.zeros(len(data) + 1, bool)
            wanted[offsets[text] + values[cuts[a] : cuts[b]]] = True
            hit = np.flatnonzero(wanted[at])
            if not len(hit):
                continue
            starts, at = starts[hit], at[hit]
            begins = np.flatnonzero(np.append(True, at[1:] != at[:-1]))
            ends = np.append(begins[1:], len(at)) - 1
            owner = np.searchsorted(offsets, at[begins], "right") - 1
            raw, low, high = data.tobytes(), starts[begins], starts[ends] + window
            kind = np.array([held.setdefault(raw[i:j], len(held)) for i, j in zip(low.tolist(), high.tolist(), strict=True)], np.int64)
            parts.append((kind, signed(hashes[at[begins]]), uid[a + owner], smallest[a + owner], (low - offsets[owner]).astype(np.int32)))
            if len(held) > 100_000:
                yield from out()
    if held:
        yield from out()


_GONE = pa.schema([("uid", pa.int64()), ("start", pa.int32()), ("stop", pa.int32())])


def _compare(rows: pa.Table, window: int) -> pa.Table:
    """Stretches of one bucket -> the bytes that go: (uid, start, stop)."""
    kinds: dict[bytes, int] = {}
    kind = np.array([kinds.setdefault(t, len(kinds)) for t in rows.column("bytes").to_pylist()], np.int64)
    text = np.frombuffer(bytes([_BETWEEN]).join(kinds), np.uint8)
    sizes = np.array([len(t) for t in kinds], np.int64)
    begins = np.append(0, np.cumsum(sizes + 1)[:-1])
    leader = np.full(len(kinds), np.iinfo(np.int64).max)
    np.minimum.at(leader, kind, rows.column("first").to_numpy())
    order = suffix_array(text, window)
    owner = np.repeat(np.arange(len(sizes)), sizes + 1)[order]
    inside = order - begins[owner] <= sizes[owner] - window
    order, owner = order[inside], owner[inside]
    # Between two suffixes that stay, those left out share what both share, so neighbours may be compared directly.
    group = np.cumsum(common_prefixes(text, order, window) < window) - 1
    least = np.full(int(group[-1]) + 1 if len(group) else 0, np.iinfo(np.int64).max)
    np.minimum.at(least, group, leader[owner])
    best = np.zeros(len(text), np.int64)
    best[order] = least[group]

    lists = rows.column("places").combine_chunks()
    cuts, places = lists.offsets.to_numpy(), lists.flatten()
    uid, first, start = (places.field(i).to_numpy() for i in range(3))
    kind = np.repeat(kind, np.diff(cuts))
    # Places where every string is new, or where the document is the smallest of all, need no look.
    lowest = np.minimum.reduceat(np.where(text == _BETWEEN, np.iinfo(np.int64).max, _reach(best, begins, sizes, window)), begins) if len(kinds) else leader
    look = np.flatnonzero(first > lowest[kind])
    width = sizes[kind[look]] - window + 1
    row = np.repeat(np.arange(len(look)), width)
    offset = stretches(np.zeros(len(look), np.int64), width)
    gone = best[begins[kind[look]][row] + offset] < first[look][row]
    row, offset = row[gone], offset[gone]
    new = np.append(True, (row[1:] != row[:-1]) | (offset[1:] != offset[:-1] + 1)) if len(row) else np.zeros(0, bool)
    at = np.flatnonzero(new)
    last = np.append(at[1:], len(row)) - 1 if len(at) else at
    base = start[look][row[at]].astype(np.int64)
    return pa.Table.from_arrays([pa.array(uid[look][row[at]]), pa.array((base + offset[at]).astype(np.int32)), pa.array((base + offset[last] + window).astype(np.int32))], schema=_GONE)


def _reach(best: np.ndarray, begins: np.ndarray, sizes: np.ndarray, window: int) -> np.ndarray:
    """best where a whole string starts, the largest number elsewhere."""
    out = np.full(len(best), np.iinfo(np.int64).max)
    at = stretches(begins, sizes - window + 1)
    out[at] = best[at]
    return out


_RESULT = pa.schema([("key", pa.string()), ("first", pa.int64()), ("n_bytes", pa.int64()), ("n_removed", pa.int64()), ("spans", pa.list_(pa.list_(pa.int64()))), ("kept", pa.binary()), ("full", pa.binary())])


def _remove(batches: Iterator[pa.RecordBatch], window: int) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        lists = batch.column(4)
        cuts, places = lists.offsets.to_numpy(), lists.values
        start, stop = (places.field(i).to_numpy().astype(np.int64) for i in range(2))
        for a, b, data, offsets in slices(batch):
            base = np.repeat(offsets[:-1], np.diff(cuts[a : b + 1]))
            here = slice(cuts[a], cuts[b])
            gone = repeats.covered(len(data), base + start[here], base + stop[here])
            raw, rest = data.tobytes(), data[~gone].tobytes()
            left = np.append(0, np.cumsum(~gone))[offsets]
            edge = np.flatnonzero(np.diff(np.concatenate([[False], gone, [False]]).astype(np.int8)))
            # A removed run ends where its text ends, even if the next text begins with one.
            inner = offsets[1:-1][(offsets[1:-1] > 0) & (offsets[1:-1] < len(data))]
            split = np.unique(inner[gone[inner - 1] & gone[inner]]) if len(inner) else inner
            begins, ends = np.sort(np.concatenate([edge[::2], split])), np.sort(np.concatenate([edge[1::2], split]))
            owner = np.searchsorted(offsets, begins, "right") - 1
            spans = [[] for _ in range(b - a)]
            for o, i, j in zip(owner.tolist(), begins.tolist(), ends.tolist(), strict=True):
                spans[o].append([i - int(offsets[o]), j - int(offsets[o])])
            size = np.diff(offsets)
            part = batch.slice(a, b - a)
            yield pa.RecordBatch.from_arrays(
                [part.column(1), part.column(2), pa.array(size), pa.array(size - np.diff(left)), pa.array(spans, _RESULT.field("spans").type), pa.array([rest[i:j] for i, j in zip(left[:-1], left[1:], strict=True)], pa.binary()),
                 pa.array([raw[i:j] if j - i < window else b"" for i, j in zip(offsets[:-1], offsets[1:], strict=True)], pa.binary())],
                schema=_RESULT,
            )


def by_text(docs: DataFrame, window: int = WINDOW, gram: int = GRAM, per_bucket: int = PER_BUCKET) -> tuple[DataFrame, DataFrame]:
    """(members, results): docs as (doc_id, key); key, first, n_bytes, n_removed, spans, kept, full per text.

    spans are the maximal removed runs as [start, stop); full is a text shorter than a window, for its copies.
    """
    if not 8 <= gram <= window:
        raise ValueError("a piece has eight bytes at least and fits the window")
    members, texts = distinct_texts(docs, F.col("text"))
    pieces = texts.select("uid", "text").mapInArrow(lambda b: _pieces(b, window, gram), repeats.SEEN_SQL)
    places = written(repeats.recurring(pieces))
    near = texts.select("uid", "first", "text").join(places, "uid").select("uid", "first", "text", "places")
    cut = near.mapInArrow(lambda b: _stretches(b, window, gram), _STRETCH_SQL)
    total = texts.agg(F.coalesce(F.sum(F.octet_length("text")), F.lit(0))).first()[0]
    dealt = cut.withColumn("bucket", F.pmod("hash", F.lit(total // per_bucket + 1)))
    gone = dealt.groupBy("bucket").applyInArrow(lambda rows: _compare(rows, window), "uid long, start int, stop int")
    gone = written(gone.groupBy("uid").agg(F.collect_list(F.struct("start", "stop")).alias("gone")))
    none = F.array().cast("array<struct<start: int, stop: int>>")
    rows = texts.join(gone, "uid", "left").select("uid", "key", "first", "text", F.coalesce("gone", none).alias("gone"))
    return members, rows.mapInArrow(lambda b: _remove(b, window), "key string, first long, n_bytes long, n_removed long, spans array<array<bigint>>, kept binary, full binary")


def suffix_dedup(docs: DataFrame, window: int = WINDOW, **options) -> DataFrame:
    """docs(doc_id, text) -> doc_id, n_bytes, n_removed, spans, kept (remaining bytes)."""
    members, results = by_text(docs, window, **options)
    everything = F.array(F.array(F.lit(0).cast("long"), F.col("n_bytes")))
    whole = {"n_removed": F.col("n_bytes"), "spans": everything, "kept": F.lit(b"").cast("binary")}
    none = {"n_removed": F.lit(0).cast("long"), "spans": F.array().cast("array<array<bigint>>"), "kept": F.col("full")}
    return repeats.answers(members, results, window, "n_bytes", whole, none)
