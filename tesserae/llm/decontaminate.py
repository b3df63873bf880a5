"""Benchmark decontamination by spaced seeds.

Words are runs of letters, digits and non-ASCII characters, A-Z lower-cased; punctuation does not count. In scripts
without spaces (Chinese, Japanese, Thai, Lao, Khmer, Burmese; also Korean) every character is a word. A mask
selects some positions of a stretch of SPAN words and ignores the others, so two passages give the same seed
although words at ignored positions were substituted. Seeds of the benchmark and of the documents are joined by
hash. Around each hit the two texts are laid side by side and the overlap is extended both ways, as long as at
least IDENTITY of its words agree. Overlaps on one diagonal (the same shift between document and item) that touch are
joined, and the longest stretch of them with that share counts, so an overlap may be as long as the item. One of MIN_WORDS words or more (or of the whole item, if that is
shorter) is contamination. An item shorter than SPAN words must occur unchanged; one of fewer than SHORTEST
words says too little and is not searched for.

Before anything is shuffled, document seeds are held against a bitmap of the benchmark's seeds. Its size is
fixed (2**BITS bits), so it may be broadcast; what passes is joined exactly, so it drops nothing. A seed that
very many documents share is spread over salted keys in that join.

The result has one row per document; rows that share a doc_id (nulls included) share their answer. Null and
empty texts are clean, items without text or id are ignored, items that are given twice are found twice; empty
tables give clean documents or no rows. Further columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from ..operators.spread import spread_join
from .util import free_name, lowered, mix, order_id, settled, signed, slices, word_hashes, words_of, written

#: Selected positions are 1. Whatever a fifth of 11 or more words is substituted, one of these masks hits what is left.
MASKS = ("11101101", "110010111", "1010110011", "11001000111")
#: Words of the longest mask.
SPAN = max(map(len, MASKS))
SHORTEST = 5
IDENTITY = 0.8
MIN_WORDS = 13
#: Words laid side by side before and after one seed; a stretch that goes on holds further seeds.
AROUND = 24
BITS = 24
_OTHER = np.array([not (chr(b).isalnum() or b >= 128) if b < 128 else False for b in range(256)])
_FACTORS = np.random.default_rng(7).integers(0, 2**63, 64, dtype=np.uint64) | np.uint64(1)


def _unspaced(data: np.ndarray) -> np.ndarray:
    """Places where a character of a script without spaces begins; all of them have three bytes."""
    first = data[:-2] if len(data) > 2 else data[:0]
    # UTF-8 of U+3000 to U+D7FF, Thai and Lao, Burmese, Khmer.
    lead = (first >= 0xE3) & (first <= 0xED)
    near = np.flatnonzero((first == 0xE0) | (first == 0xE1))
    second = data[near + 1]
    lead[near] = np.where(first[near] == 0xE0, (second >= 0xB8) & (second <= 0xBB), ((second >= 0x80) & (second <= 0x82)) | (second == 0x9E) | (second == 0x9F))
    return np.flatnonzero(lead)


def _words(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """As `words_of`, with characters of scripts without spaces apart."""
    starts, ends, first = words_of(data, offsets, _OTHER)
    at = _unspaced(data)
    if not len(at):
        return starts, ends, first
    # A word goes on after such a character unless it ended there.
    cuts = np.concatenate([at, at + 3])
    word = np.searchsorted(starts, cuts, "right") - 1
    cuts = cuts[(word >= 0) & (cuts < ends[word])]
    all_starts = np.unique(np.concatenate([starts, cuts]))
    all_ends = np.minimum(np.append(all_starts[1:], len(data)), ends[np.searchsorted(starts, all_starts, "right") - 1])
    return all_starts, all_ends, np.searchsorted(all_starts, offsets, "left")


def _seeds(words: np.ndarray, first: np.ndarray, mask: str) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(text number, word position, hash) of each stretch of a mask's length inside one text."""
    span = len(mask)
    if len(words) < span:
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.uint64)
    total = np.zeros(len(words) - span + 1, np.uint64)
    for j, bit in enumerate(mask):
        if bit == "1":
            total += words[j : j + len(total)] * _FACTORS[j]
    text = np.repeat(np.arange(len(first) - 1), np.diff(first))
    inside = np.flatnonzero(text[: len(total)] == text[span - 1 :])
    return text[inside], inside - first[text[inside]], mix(total[inside] + np.uint64(int(mask, 2)))


_ROW = pa.schema([("id", pa.int64()), ("row", pa.int64()), ("hash", pa.int64()), ("pos", pa.int64()), ("span", pa.int32()), ("n_words", pa.int64()), ("around", pa.binary())])
_ROW_SQL = "id long, row long, hash long, pos long, span int, n_words long, around binary"


def _rows(batches: Iterator[pa.RecordBatch], masks: list[str], bitmap: np.ndarray | None, whole: bool) -> Iterator[pa.RecordBatch]:
    """Seeds with the words around them; with a bitmap only those that pass it. whole: masks without gaps fit whole texts only, others not those
    shorter than SPAN."""
    for batch in batches:
        ids, row = (np.asarray(batch.column(c).to_numpy(zero_copy_only=False), np.int64) for c in ("doc_id", "row"))
        for a, b, data, offsets in slices(batch):
            data = lowered(data)
            starts, ends, first = _words(data, offsets)
            words = word_hashes(data, starts, ends)
            # Zero stands for "no word here"; a margin on both sides keeps look-ups inside the array.
            short = np.concatenate([np.zeros(AROUND, np.uint32), (words >> np.uint64(32)).astype(np.uint32) | np.uint32(1), np.zeros(AROUND + SPAN, np.uint32)])
            count = np.diff(first)
            for mask in masks:
                text, pos, seed = _seeds(words, first, mask)
                keep = np.ones(len(seed), bool)
                if bitmap is not None:
                    slot = seed >> np.uint64(64 - BITS)
                    keep = (bitmap[slot >> np.uint64(6)] >> (slot & np.uint64(63))) & np.uint64(1) == 1
                if whole:
                    keep &= count[text] >= SPAN if "0" in mask else count[text] == len(mask)
                text, pos, seed = text[keep], pos[keep], seed[keep]
                for i in range(0, len(seed), 20_000):
                    t, p, s = text[i : i + 20_000], pos[i : i + 20_000], seed[i : i + 20_000]
                    offset = np.arange(-AROUND, SPAN + AROUND)
                    at = p[:, None] + offset
                    side = short[np.maximum((first[t] + p)[:, None] + offset + AROUND, 0)]
                    side[(at < 0) | (at >= count[t][:, None])] = 0
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(ids[a + t]), pa.array(row[a + t]), pa.array(signed(s)), pa.array(p), pa.array(np.full(len(t), len(mask), np.int32)), pa.array(count[t]), pa.array([r.tobytes() for r in side], pa.binary())], schema=_ROW
                    )


def _bitmap(seeds: DataFrame) -> np.ndarray:
    """2**BITS bits, set for each seed; at most 2**BITS / 64 rows come to the driver, whatever the benchmark's size."""
    slot = F.shiftrightunsigned("hash", 64 - BITS)
    words = seeds.groupBy(F.shiftright(slot, 6).alias("word")).agg(F.bit_or(F.expr(f"shiftleft(1L, int(shiftrightunsigned(hash, {64 - BITS}) & 63))")).alias("bits")).toPandas()
    out = np.zeros(1 << (BITS - 6), np.uint64)
    out[words["word"].to_numpy(np.int64)] = words["bits"].to_numpy(np.int64).view(np.uint64)
    return out


def _overlaps(mine: np.ndarray, item: np.ndarray, span: np.ndarray, identity: float) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(words before the seed, words after it, agreeing words) of the longest overlap around each seed."""
    n, width = mine.shape
    same = (mine == item) & (mine != 0)
    valid = (mine != 0) & (item != 0)
    gain = np.where(valid, same - identity, -1e3)
    place = np.arange(width)
    core = (place >= AROUND) & (place < AROUND + span[:, None])
    middle = np.where(core, gain, 0).sum(1)
    left = np.concatenate([np.zeros((n, 1)), np.cumsum(gain[:, AROUND - 1 :: -1], 1)], 1)
    after = np.where(place >= AROUND + span[:, None], gain, 0)
    after = np.stack([np.roll(r, -(AROUND + s)) for r, s in zip(after, span, strict=True)])[:, :AROUND] if n else after[:, :AROUND]
    right = np.concatenate([np.zeros((n, 1)), np.cumsum(after, 1)], 1)
    total = left[:, :, None] + right[:, None, :] + middle[:, None, None]
    length = np.add.outer(np.arange(left.shape[1]), np.arange(right.shape[1]))
    best = np.where(total >= -1e-9, length, -1).reshape(n, -1).argmax(1)
    before, behind = best // right.shape[1], best % right.shape[1]
    ok = np.where(total >= -1e-9, length, -1).reshape(n, -1).max(1) >= 0
    inside = (place >= AROUND - before[:, None]) & (place < AROUND + (span + behind)[:, None])
    agree = np.where(ok, (same & inside).sum(1), 0)
    return before, behind, agree


_WINDOW = pa.schema([("id", pa.int64()), ("row", pa.int64()), ("item_id", pa.int64()), ("item_words", pa.int64()), ("shift", pa.int64()), ("first", pa.int64()), ("agree", pa.binary())])
_WINDOW_SQL = "id long, row long, item_id long, item_words long, shift long, first long, agree binary"
_FOUND = pa.schema([("id", pa.int64()), ("item_id", pa.int64()), ("words", pa.int64()), ("agree", pa.int64()), ("first_word", pa.int64()), ("last_word", pa.int64())])


def longest(agree: np.ndarray, identity: float) -> tuple[int, int]:
    """First word and length of the longest stretch of which at least `identity` agree; the first of several."""
    total = np.concatenate([[0.0], np.cumsum(agree - identity)])
    low = np.minimum.accumulate(total)
    # For each end, the earliest start whose running sum is not above: the running minimum never rises.
    start = np.searchsorted(-low, -(total + 1e-9), "left")
    length = np.arange(len(total)) - start
    best = int(length.argmax())
    return int(start[best]), int(length[best])


def _joined(identity: float, min_words: int):
    """Windows of one document, item and shift, joined where they touch, and the longest stretch of each run."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            columns = ("id", "item_id", "item_words", "windows")
            for doc, item, item_words, windows in zip(*(batch.column(c).to_pylist() for c in columns)):
                at, end, parts = None, 0, []
                for w in [*sorted(windows, key=lambda w: w["first"]), None]:
                    if w is None or at is None or w["first"] > end:
                        if at is not None:
                            bits = np.zeros(end - at, np.uint8)
                            for p in parts:
                                bits[p["first"] - at : p["first"] - at + len(p["agree"])] |= np.frombuffer(p["agree"], np.uint8)
                            start, words = longest(bits, identity)
                            if words >= min(min_words, item_words):
                                out.append((doc, item, words, int(bits[start : start + words].sum()), at + start, at + start + words - 1))
                        if w is None:
                            break
                        at, end, parts = w["first"], 0, []
                    parts.append(w)
                    end = max(end, w["first"] + len(w["agree"]))
            yield pa.RecordBatch.from_arrays([pa.array([r[c] for r in out], f.type) for c, f in enumerate(_FOUND)], schema=_FOUND)

    return run


def overlaps(docs: DataFrame, benchmark: DataFrame, identity: float = IDENTITY, min_words: int = MIN_WORDS) -> DataFrame:
    """docs(doc_id, text), benchmark(item_id, text) -> one row per document and item that overlap: id (doc_id, or the
    largest long for null), item_id, words and agree of the longest overlap, first_word and last_word of all."""
    items = benchmark.where("item_id is not null and text is not null").select(F.col("item_id").cast("long").alias("doc_id"), F.lit(0).cast("long").alias("row"), "text")
    lengths = [SPAN, *range(SHORTEST, SPAN)]
    masks = [*MASKS, *("1" * n for n in lengths[1:])]
    seeds = written(items.mapInArrow(lambda b: _rows(b, masks, None, True), _ROW_SQL))
    # Masks for short items are laid over the documents only if there are such items.
    used = {r[0] for r in seeds.where(F.col("n_words") < SPAN).select("n_words").distinct().collect()}
    active = [m for m in masks if "0" in m or len(m) in used]
    bitmap = docs.sparkSession.sparkContext.broadcast(_bitmap(seeds))
    # Rows that share a doc_id are told apart by their text while overlaps are joined.
    rows = docs.select(order_id(F.col("doc_id")).alias("doc_id"), F.xxhash64("text").alias("row"), F.coalesce("text", F.lit("")).alias("text"))
    hits = rows.mapInArrow(lambda b: _rows(b, active, bitmap.value, False), _ROW_SQL)
    theirs = seeds.select("hash", "span", F.col("id").alias("item_id"), F.col("pos").alias("item_pos"), F.col("n_words").alias("item_words"), F.col("around").alias("item_around"))
    pairs = spread_join(hits, theirs, ["hash", "span"])

    def verify(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(0, batch.num_rows, 2000):
                part = batch.slice(i, 2000)
                pos, span, item_pos = (part.column(n).to_numpy() for n in ("pos", "span", "item_pos"))
                mine, item = (np.frombuffer(b"".join(part.column(n).to_pylist()), np.uint32).reshape(len(pos), -1) for n in ("around", "item_around"))
                before, behind, agree = _overlaps(mine, item, span.astype(np.int64), identity)
                ok = np.flatnonzero((agree >= identity * (before + span + behind) - 1e-9) & (agree > 0))
                same = ((mine == item) & (mine != 0)).astype(np.uint8)
                bits = [same[k, AROUND - before[k] : AROUND + span[k] + behind[k]].tobytes() for k in ok]
                some = part.take(pa.array(ok))
                yield pa.RecordBatch.from_arrays([*(some.column(n) for n in ("id", "row", "item_id", "item_words")), pa.array(pos[ok] - item_pos[ok]), pa.array(pos[ok] - before[ok]), pa.array(bits, pa.binary())], schema=_WINDOW)

    columns = ["id", "row", "item_id", "item_words", "item_pos", "pos", "span", "around", "item_around"]
    windows = pairs.select(*columns).mapInArrow(verify, _WINDOW_SQL)
    # A group holds the seeds of one copy of one item: as many as the item has words, whatever the corpus.
    runs = windows.groupBy("id", "row", "item_id", "item_words", "shift").agg(F.collect_set(F.struct("first", "agree")).alias("windows"))
    found = runs.select("id", "item_id", "item_words", "windows").mapInArrow(_joined(identity, min_words), "id long, item_id long, words long, agree long, first_word long, last_word long")
    best = F.max(F.struct("words", "agree")).alias("best")
    return found.groupBy("id", "item_id").agg(best, F.min("first_word").alias("first_word"), F.max("last_word").alias("last_word")).select("id", "item_id", "best.*", "first_word", "last_word")


def decontaminate(docs: DataFrame, benchmark: DataFrame, **options) -> DataFrame:
    """-> doc_id, contaminated, item_ids (ascending), overlap_words (longest overlap, 0 if none), one row per document."""
    found = overlaps(docs, benchmark, **options)
    by_doc = found.groupBy(F.col("id").alias("_id")).agg(F.array_sort(F.collect_set("item_id")).alias("item_ids"), F.max("words").alias("overlap_words"))
    joined = docs.select(F.col("doc_id").cast("long").alias("doc_id")).withColumn("_id", order_id(F.col("doc_id"))).join(by_doc, "_id", "left")
    return joined.select("doc_id", F.col("item_ids").isNotNull().alias("contaminated"), F.coalesce("item_ids", F.array().cast("array<bigint>")).alias("item_ids"), F.coalesce("overlap_words", F.lit(0)).cast("long").alias("overlap_words"))


def clean_rows(docs: DataFrame, benchmark: DataFrame, **options) -> DataFrame:
    """The rows of docs that are not contaminated, with all their columns."""
    key = free_name(docs)
    bad = settled(docs.sparkSession, lambda: overlaps(docs, benchmark, **options).select(F.col("id").alias(key)).distinct())
    return docs.withColumn(key, order_id(F.col("doc_id"))).join(bad, key, "left_anti").drop(key)
