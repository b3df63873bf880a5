"""Language-model scores by context-tree weighting over bytes.

A byte is eight binary decisions, each at a node of the binary tree of bytes. For every context, the up to DEPTH
bytes before it, a node keeps how often it went either way in the training texts and the Krichevsky-Trofimov
estimate of that. The probability of a decision mixes the estimates of all depths: going from depth d to depth
d+1 weighs the node's own estimate against the product of its children with 1/2 a priori, and with their
likelihoods on the training texts a posteriori. A context becomes an inner node of the tree if it occurs SUPPORT
times or more in the training texts, however large they are, so the tree grows with them; the contexts below the
same parent that occur less often share one leaf. Contexts with the same last SPLIT bytes make a subtree; subtrees
are weighed in parallel, in partitions of these bytes. Only the nodes of shorter contexts, whose number the alphabet
bounds (256 for each context of up to one byte), come to the driver and are broadcast. The tree is learned from all
training texts and then stays as it is, so a document's score does not depend on others that are scored.

Texts are dealt into batches of some megabytes. Each batch names its distinct (context, byte) codes, these are
joined with their probabilities, and what was found meets the texts of the batch again.

A text is modelled as its bytes, A-Z lower-cased, and one end symbol; before its first byte stand end symbols.
The base model is the smoothed unigram of words. Counts of frequent words (2**-COMMON of all tokens or more, so
at most 2**COMMON) are broadcast; the others are looked up by a join, in which no key is hot.

Null texts are empty: one token, the end. A null doc_id is hashed as the empty string. Repeated rows repeat, and
count repeatedly in training. Without training texts every bit has probability 1/2 and all base counts are 0. An
empty table gives an empty result. Only doc_id and text are read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, functions as F

from .util import bounded_batches, discard, lowered, signed, slices, stretches, together, word_hashes, words_of, written

DEPTH = 5
#: Occurrences from which a context is kept.
SUPPORT = 2
#: Bytes of context that make a subtree, codes that are weighed together (or one larger subtree), bytes of text in a batch.
SPLIT, WEIGHED, BATCH_TEXT = 2, 150_000, 12_000_000
#: Batches are scored in so many parts, one after the other, so that less is shuffled at a time.
PARTS = 4
COMMON = 19
#: The symbol after the last byte; UTF-8 has no such byte.
END = 255
#: The token after the last word.
_END_TOKEN = -1
_LN2, _LOG10_2 = np.log(2.0), np.log10(2.0)


# --- counts -----------------------------------------------------------------------------------------------------


def _summed(keys: list[np.ndarray], counts: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    key, count = np.concatenate(keys), np.concatenate(counts)
    if not len(key):
        return key, count
    order = np.argsort(key, kind="stable")  # merges what is sorted already
    key, count = key[order], count[order]
    begins = np.flatnonzero(np.append(True, key[1:] != key[:-1]))
    return key[begins], np.add.reduceat(count, begins)


_COUNT = pa.schema([("key", pa.int64()), ("n", pa.int64())])


def _word_counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        keys, counts = [np.array([_END_TOKEN])], [np.array([batch.num_rows])]
        for _, _, data, offsets in slices(batch):
            data = lowered(data)
            key, count = np.unique(signed(word_hashes(data, *words_of(data, offsets)[:2])), return_counts=True)
            keys.append(key)
            counts.append(count)
        yield pa.RecordBatch.from_arrays([pa.array(c) for c in _summed(keys, counts)], schema=_COUNT)


def _codes(data: np.ndarray, offsets: np.ndarray, depth: int) -> tuple[np.ndarray, np.ndarray]:
    """Codes of all symbols with the `depth` bytes before them, and how many symbols each text has."""
    sizes = np.diff(offsets)
    line = np.full(len(data) + len(sizes) * (depth + 1), END, np.uint8)
    line[np.arange(len(data)) + np.repeat((np.arange(len(sizes)) + 1) * (depth + 1) - 1, sizes)] = lowered(data)
    code = line[depth:].astype(np.uint64)
    for j in range(1, depth + 1):
        code |= line[depth - j : len(line) - j].astype(np.uint64) << np.uint64(8 * j)
    # Every text has `depth` end symbols before it and one after it; only the last counts.
    keep = np.ones(len(code), bool)
    if depth:
        begins = offsets[1:-1] + np.arange(1, len(sizes)) * (depth + 1) - depth
        keep[stretches(begins, np.full(len(begins), depth))] = False
    return code[keep], sizes + 1


_BATCHED = pa.schema([("batch", pa.int64()), ("row", pa.int64()), ("doc_id", pa.int64()), ("text", pa.string()), ("held_out", pa.bool_())])
_BATCHED_SQL = "batch long, row long, doc_id long, text string, held_out boolean"
_GRAM = pa.schema([("batch", pa.int64()), ("key", pa.int64()), ("n", pa.int64())])


def _batched(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Numbers for rows and for the batches they come in."""
    row = number = TaskContext.get().partitionId() << 33
    size = 0
    for batch in batches:
        n, more = batch.num_rows, batch.column(1).nbytes
        if size and size + more > BATCH_TEXT:
            number, size = number + 1, 0
        size += more
        columns = [pa.array(np.full(n, number)), pa.array(np.arange(row, row + n)), *(batch.column(c).cast(_BATCHED.field(f).type) for c, f in enumerate(("doc_id", "text", "held_out")))]
        yield pa.RecordBatch.from_arrays(columns, schema=_BATCHED)
        row += n


def _gram_counts(batches: Iterator[pa.RecordBatch], depth: int) -> Iterator[pa.RecordBatch]:
    """Distinct codes of each batch and how often its training texts have them."""
    for arrived in batches:
        number = arrived.column(0).to_numpy()
        cuts = np.flatnonzero(np.concatenate([[True], number[1:] != number[:-1], [True]])) if len(number) else np.zeros(1, int)
        for i, j in zip(cuts[:-1], cuts[1:], strict=True):
            batch, keys, counts = arrived.slice(i, j - i), [], []
            training = ~batch.column(4).fill_null(True).to_numpy(zero_copy_only=False)
            for a, b, data, offsets in slices(batch):
                code, sizes = _codes(data, offsets, depth)
                code, count = np.unique(code << np.uint64(1) | np.repeat(training[a:b], sizes), return_counts=True)
                keys.append(signed(code >> np.uint64(1)))
                counts.append(count * (code & np.uint64(1)).astype(np.int64))
            key, n = _summed(keys, counts)
            yield pa.RecordBatch.from_arrays([pa.array(np.full(len(key), number[i])), pa.array(key), pa.array(n)], schema=_GRAM)


# --- the tree ---------------------------------------------------------------------------------------------------


def _lgamma(x: np.ndarray) -> np.ndarray:
    """Logarithm of the gamma function for x > 0 by Stirling's series, moved up by eight."""
    shift = np.log(x)
    for i in range(1, 8):
        shift += np.log(x + i)
    y = x + 8
    return (y - 0.5) * np.log(y) - y + 0.5 * np.log(2 * np.pi) + 1 / (12 * y) - 1 / (360 * y**3) + 1 / (1260 * y**5) - shift


def _kt(zeros: np.ndarray, ones: np.ndarray) -> np.ndarray:
    """Log likelihood of a sequence with these counts under the Krichevsky-Trofimov estimator."""
    return _lgamma(zeros + 0.5) + _lgamma(ones + 0.5) - np.log(np.pi) - _lgamma(zeros + ones + 1.0)


class Table:
    """Open-addressing table from 64-bit codes to row numbers, filled and read in bulk."""

    def __init__(self, keys: np.ndarray):
        self.bits = max(4, int(2 * len(keys)).bit_length())
        self.keys = np.full(1 << self.bits, -1, np.int64).view(np.uint64)
        self.rows = np.full(1 << self.bits, -1, np.int32)
        row, slot = np.arange(len(keys), dtype=np.int32), self._slot(keys)
        mask = (1 << self.bits) - 1
        while len(row):
            free = self.rows[slot] < 0
            self.rows[slot[free]] = row[free]  # of several for a slot the last one stays
            held = self.rows[slot] == row
            self.keys[slot[held]] = keys[row[held]]
            row, slot = row[~held], (slot[~held] + 1) & mask

    def _slot(self, keys: np.ndarray) -> np.ndarray:
        return ((keys * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(64 - self.bits)).astype(np.int64)

    def find(self, keys: np.ndarray) -> np.ndarray:
        """Row numbers, -1 where a code is not held."""
        slot, mask = self._slot(keys), (1 << self.bits) - 1
        out = self.rows[slot]
        open_ = np.flatnonzero((out >= 0) & (self.keys[slot] != keys))
        while len(open_):
            slot[open_] = (slot[open_] + 1) & mask
            out[open_] = self.rows[slot[open_]]
            open_ = open_[(out[open_] >= 0) & (self.keys[slot[open_]] != keys[open_])]
        return out


def _mask(depth: int) -> int:
    """What a code, or the key of a node, has with `depth` bytes of context."""
    return (1 << 8 * (depth + 1)) - 1


def _nodes(byte: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(node, bit) of the eight decisions of bytes; node 1 is the root of the binary tree."""
    for k in range(8):
        yield (1 << k) | (byte >> (8 - k)), (byte >> (7 - k)) & 1


class Level:
    """Nodes of the kept contexts of one depth, keys (context, then the node) ascending.

    below: (keys of this depth, zeros, ones, log likelihoods) summed over kept children; None at full depth.
    """

    def __init__(self, code: np.ndarray, n: np.ndarray, depth: int, support: int, below):
        code, n = _summed([code & _mask(depth)], [n])
        if depth and len(code):
            begins = np.flatnonzero(np.append(True, code[1:] >> 8 != code[:-1] >> 8))
            keep = np.repeat(np.add.reduceat(n, begins) >= support, np.diff(np.append(begins, len(code))))
            code, n = code[keep], n[keep]
        parts = list(_nodes(code & 255))
        self.keys, at = np.unique(np.concatenate([code & ~255 | node for node, _ in parts]), return_inverse=True)
        bit, weight, size = np.concatenate([b for _, b in parts]) == 1, np.tile(n.astype(float), 8), len(self.keys)
        self.zeros, self.ones = np.bincount(at, weight * ~bit, size), np.bincount(at, weight * bit, size)
        self.weighted = _kt(self.zeros, self.ones)
        self.own, self.rest = np.ones(size), np.full(size, 0.5)
        if below is not None:
            up = np.searchsorted(self.keys, below[0])
            left0, left1 = self.zeros - np.bincount(up, below[1], size), self.ones - np.bincount(up, below[2], size)
            likelihood = self.weighted
            # What no kept child holds is one leaf.
            self.weighted = np.logaddexp(likelihood, np.bincount(up, below[3], size) + _kt(left0, left1)) - _LN2
            self.own = np.exp(likelihood - _LN2 - self.weighted)
            self.rest = (left1 + 0.5) / (left0 + left1 + 1)

    def upwards(self, depth: int) -> tuple[np.ndarray, ...]:
        """What the next smaller depth, `depth`, needs."""
        key, at = np.unique(self.keys & _mask(depth), return_inverse=True)
        return key, *(np.bincount(at, x, len(key)) for x in (self.zeros, self.ones, self.weighted))


def _levels(code: np.ndarray, n: np.ndarray, deepest: int, least: int, support: int, below=None) -> list[Level]:
    """Levels from depth `least` to `deepest`, made bottom up."""
    out = []
    for d in range(deepest, least - 1, -1):
        out.insert(0, Level(code, n, d, support, below))
        if d > least:
            below = out[0].upwards(d - 1)
    return out


def _log2(code: np.ndarray, levels: list[Level]) -> np.ndarray:
    """log2 probability of each byte after its context, top down through levels of all depths from 0 on."""
    out, kept = np.zeros(len(code)), []
    for node, bit in _nodes(code & 255):
        given, left, chance = np.zeros(len(code)), np.ones(len(code)), np.full(len(code), 0.5)
        for d, level in enumerate(levels):
            key = code & _mask(d) & ~255 | node
            at = np.minimum(np.searchsorted(level.keys, key), max(len(level.keys) - 1, 0))
            hit = level.keys[at] == key if len(level.keys) else np.zeros(len(code), bool)
            if len(kept) == d:
                kept.append(hit)  # the first node is node 1, at which every kept context has data
            at, bare = at[hit], kept[d] & ~hit
            # A context without data at this node says 1/2 with all the weight that is left.
            given[bare] += left[bare] * 0.5
            left[bare] = 0
            chance[bare] = given[bare]
            given[hit] += left[hit] * level.own[at] * ((level.ones[at] + 0.5) / (level.zeros[at] + level.ones[at] + 1))
            left[hit] *= 1 - level.own[at]
            chance[hit] = given[hit] + left[hit] * level.rest[at]
        out += np.log2(np.where(bit == 1, chance, 1 - chance))
    return out


_UP = pa.schema([("kind", pa.int32()), ("key", pa.int64()), ("n", pa.int64()), ("zeros", pa.float64()), ("ones", pa.float64()), ("weighted", pa.float64())])
_BITS = pa.schema([("key", pa.int64()), ("bits", pa.float64())])


def _subtrees(batches: Iterator[pa.RecordBatch], split: int) -> Iterator[list[np.ndarray]]:
    """Columns (code, count, is it wanted) of some whole subtrees at a time; a partition holds whole subtrees."""
    arrived = [[c.to_numpy(zero_copy_only=False) for c in batch.columns] for batch in batches]
    if not arrived:
        return
    columns = [np.concatenate(c) for c in zip(*arrived, strict=True)]
    group = columns[0] & _mask(split) & ~255
    order = np.argsort(group, kind="stable")
    group, columns = group[order], [c[order] for c in columns]
    begins = np.flatnonzero(np.append(True, group[1:] != group[:-1])) if len(group) else np.zeros(0, int)
    ends, start = np.append(begins[1:], len(group)), 0
    while start < len(group):
        fit = ends[(ends > start) & (ends <= start + WEIGHED)]
        end = int(fit[-1]) if len(fit) else int(ends[np.searchsorted(ends, start, "right")])
        yield [c[start:end] for c in columns]
        start = end


class ContextTree:
    """The frozen mixture of codes(key, n): context of `depth` bytes, then the byte, and how often it occurred; unique."""

    def __init__(self, codes: DataFrame, depth: int, support: int):
        self.codes, self.depth, self.support, self.split = codes, depth, support, min(SPLIT, depth)
        self.top: list[Level] = []
        if not self.split:
            return
        split = self.split

        def rise(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for code, n, _ in _subtrees(batches, split):
                key, count = _summed([code & _mask(split - 1)], [n])
                up, *sums = _levels(code, n, depth, split, support)[0].upwards(split - 1)
                none = np.zeros(len(key))
                yield pa.RecordBatch.from_arrays([pa.array(np.zeros(len(key), np.int32)), pa.array(key), pa.array(count), *[pa.array(none)] * 3], schema=_UP)
                yield pa.RecordBatch.from_arrays([pa.array(np.ones(len(up), np.int32)), pa.array(up), pa.array(np.zeros(len(up), np.int64)), *map(pa.array, sums)], schema=_UP)

        rows = self._dealt(codes.where("n > 0").select("key", "n", F.lit(False).alias("wanted"))).mapInArrow(rise, "kind int, key long, n long, zeros double, ones double, weighted double")
        # At most 256 * 256 codes and as many nodes.
        rows = rows.groupBy("kind", "key").agg(*[F.sum(c).alias(c) for c in ("n", "zeros", "ones", "weighted")]).orderBy("kind", "key").toArrow()
        kind, key, n, *sums = (rows.column(c).to_numpy() for c in ("kind", "key", "n", "zeros", "ones", "weighted"))
        self.top = _levels(key[kind == 0], n[kind == 0], split - 1, 0, support, (key[kind == 1], *(x[kind == 1] for x in sums)))

    def _dealt(self, rows: DataFrame) -> DataFrame:
        """Rows with the same subtree to the same partition."""
        spark = rows.sparkSession
        subtree = F.shiftrightunsigned("key", 8).bitwiseAND(F.lit((1 << 8 * self.split) - 1))
        return rows.repartition(int(spark.conf.get("spark.sql.shuffle.partitions")), subtree)

    def bits(self, wanted: DataFrame | None = None) -> DataFrame:
        """wanted(key), unique, by default all codes -> key, bits: log2 probability of each byte after its context."""
        rows = self.codes.select("key", "n", F.lit(wanted is None).alias("wanted"))
        if wanted is not None:
            rows = rows.unionByName(wanted.select("key", F.lit(0).cast("long").alias("n"), F.lit(True).alias("wanted")))
        top = rows.sparkSession.sparkContext.broadcast(self.top)
        depth, split, support = self.depth, self.split, self.support

        def fall(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for code, n, asked in _subtrees(batches, split):
                levels = [*top.value, *_levels(code[n > 0], n[n > 0], depth, split, support)]
                code = code[asked]
                for i in range(0, len(code), WEIGHED):
                    some = np.sort(code[i : i + WEIGHED])
                    yield pa.RecordBatch.from_arrays([pa.array(some), pa.array(_log2(some, levels))], schema=_BITS)

        return self._dealt(rows).mapInArrow(fall, "key long, bits double")

    def log2(self, code: np.ndarray) -> np.ndarray:
        """bits() for some codes that the driver holds."""
        key, back = np.unique(signed(code), return_inverse=True)
        found = self.bits(self.codes.sparkSession.createDataFrame([(int(k),) for k in key], "key long")).orderBy("key").toArrow()
        return found.column("bits").to_numpy()[back]


def _batches(rows: DataFrame) -> DataFrame:
    """rows(doc_id, text, held_out), dealt into numbered batches."""
    return written(bounded_batches(rows).mapInArrow(_batched, _BATCHED_SQL))


def _grams(batched: DataFrame, depth: int) -> tuple[DataFrame, DataFrame]:
    """(batch, key, n) of each batch, and (key, n) of all together."""
    grams = written(batched.mapInArrow(lambda b: _gram_counts(b, depth), "batch long, key long, n long"))
    return grams, written(grams.groupBy("key").agg(F.sum("n").alias("n")))


def learn_tree(train: DataFrame, depth: int = DEPTH, support: int = SUPPORT) -> ContextTree:
    """train(text) -> the tree."""
    rows = train.select(F.lit(None).cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text"), F.lit(False).alias("held_out"))
    return ContextTree(_grams(_batches(rows), depth)[1], depth, support)


# --- scores -----------------------------------------------------------------------------------------------------

_SCORED = pa.schema([("row", pa.int64()), ("doc_id", pa.int64()), ("held_out", pa.bool_()), ("n_tokens", pa.int64()), ("known", pa.int64()), ("base", pa.float64()), ("score", pa.float64()), ("rare", pa.list_(pa.int64()))])


_SCORED_SQL = "row long, doc_id long, held_out boolean, n_tokens long, known long, base double, score double, rare array<bigint>"


def _score(texts: pa.Table, found: pa.Table, depth: int, model) -> pa.Table:
    """Scores of the texts of one batch, given the bits of all its codes."""
    words, gain = model.value
    codes, bits = Table(found.column("key").to_numpy().view(np.uint64)), found.column("bits").to_numpy()
    out = []
    for batch in texts.combine_chunks().to_batches():
        for a, b, data, offsets in slices(batch):
            part, n = batch.slice(a, b - a), b - a
            code, sizes = _codes(data, offsets, depth)
            score = np.add.reduceat(bits[codes.find(code)], np.cumsum(sizes) - sizes) * _LOG10_2
            data = lowered(data)
            starts, ends, first = words_of(data, offsets)
            hashes = word_hashes(data, starts, ends)
            at = words.find(hashes)
            text = np.repeat(np.arange(n), np.diff(first))
            common = at >= 0
            known, base = np.bincount(text[common], minlength=n), np.bincount(text[common], gain[at[common]], n)
            rare = signed(hashes[~common])
            lists = pa.ListArray.from_arrays(pa.array(np.searchsorted(np.flatnonzero(~common), first), pa.int32()), pa.array(rare))
            columns = [*(part.column(part.schema.get_field_index(c)) for c in ("row", "doc_id", "held_out")), pa.array(np.diff(first) + 1), pa.array(known), pa.array(base), pa.array(score), lists]
            out.append(pa.RecordBatch.from_arrays(columns, schema=_SCORED))
    return pa.Table.from_batches(out, _SCORED)


def held_out(doc_id: Column) -> Column:
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")) % 7 == 2


def lm_scores(docs: DataFrame, training: Column | None = None, depth: int = DEPTH, support: int = SUPPORT, common: int = COMMON) -> DataFrame:
    """docs(doc_id, text) -> doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score (both log10).

    training: condition on doc_id of the rows to learn from; by default crc32(doc_id as text) mod 7 is not 2.
    """
    rest = held_out(F.col("doc_id")) if training is None else ~training
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text"), rest.alias("held_out"))
    batched = _batches(rows)
    train = batched.where(~F.col("held_out")).select("text")
    words = written(train.mapInArrow(_word_counts, "key long, n long").groupBy("key").agg(F.sum("n").alias("n")))
    total, distinct, ends = words.agg(F.sum("n"), F.count(F.lit(1)), F.sum(F.when(F.col("key") == _END_TOKEN, F.col("n")))).first()
    total, ends = total or 0, ends or 0
    often = words.where((F.col("n") * (1 << common) >= total) & (F.col("key") != _END_TOKEN)).toArrow()
    key, n = (often.column(c).to_numpy().astype(np.int64) for c in ("key", "n"))
    model = docs.sparkSession.sparkContext.broadcast((Table(key.view(np.uint64)), np.log10(n + 1.0)))
    grams, codes = _grams(batched, depth)
    bits = written(ContextTree(codes, depth, support).bits())
    discard(codes)
    done = []
    for part in range(PARTS):
        texts, some = (x.where(F.pmod(F.xxhash64("batch"), F.lit(PARTS)) == part) for x in (batched, grams.select("batch", "key")))
        found = some.join(bits, "key").groupBy("batch")
        done.append(written(texts.groupBy("batch").cogroup(found).applyInArrow(lambda texts, values: _score(texts, values, depth, model), _SCORED_SQL)))
        del texts, some, found
    for frame in (grams, bits, batched):
        discard(frame)
    scored = together(done)

    rare = scored.select("row", F.explode("rare").alias("key"))
    found = rare.join(words, "key").groupBy("row").agg(F.count(F.lit(1)).alias("more"), F.sum(F.log10(F.col("n") + 1.0)).alias("gain"))
    last = float(np.log10(ends + 1.0))
    base = F.col("base") + F.coalesce("gain", F.lit(0.0)) + F.lit(last) - F.col("n_tokens") * F.lit(float(np.log10(total + distinct + 1.0)))
    known = F.col("known") + F.coalesce("more", F.lit(0)) + F.lit(int(ends > 0))
    return scored.drop("rare").join(found, "row", "left").select("doc_id", "held_out", "n_tokens", known.cast("long").alias("n_known"), F.lit(int(total)).cast("long").alias("train_tokens"), base.alias("base_score"), "score")
