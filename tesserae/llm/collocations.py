"""Phrase collocation mining by direct-address tiling.

Words get ids by falling frequency, so frequent pairs crowd into few square tiles of the (left id, right id) plane.
A task counts its pairs tile by tile: crowded tiles by one dense `numpy.bincount`, the rest as sorted coordinates
with run lengths. Spark adds the tiles of all tasks up. Pairs that reach the minimum are ranked again by frequency
and stand on the left of the same plane for three words: a triple is a (pair, word) cell.

Only the HEAD most frequent symbols have ids that tasks know (a broadcast of fixed size); cells with any rarer
symbol travel as coordinates of 64-bit symbol hashes, which are exact as well. Words and pairs below the minimum
cannot be part of a candidate; a bitmap of fixed size keeps most of them out, and the final counts keep out the rest.

Texts are lower-cased (A-Z only), cut into pieces at ``[.,;:!?\\x0A-\\x0D]`` and those into words ``[^\\x20\\x09]+``.
Null and empty texts have no words; a null lang is `und`; repeated rows count each time; an empty table gives no
rows; further columns are ignored. A null doc_id does not matter.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from .util import Rolling, arrow, bounded_batches, byte_values, lowered, mix, signed, slices, stretches, words_of, written

#: Symbols with an id known to every task: 2 MB of hashes at most.
HEAD = 1 << 18
#: Ids along the side of a tile; a tile has SIDE * SIDE cells.
SIDE = 1 << 10
CELLS = SIDE * SIDE
#: A tile with this many pairs in one chunk is counted densely.
CROWDED = 1 << 17
#: Values of eight bytes that a task holds before it counts them.
CHUNK = 2_000_000
#: Bits of the map of symbols that reach the minimum.
BITS = 1 << 26
#: Partial tiles added up by one task in one step.
FAN_IN = 64

_GAP = np.zeros(256, bool)
_GAP[[32, 9]] = True
_BREAK = np.zeros(256, bool)
_BREAK[[ord(c) for c in ".,;:!?"]] = True
_BREAK[10:14] = True
_APART = _GAP | _BREAK

_WORDS = pa.schema([("s", pa.int64()), ("lang", pa.string()), ("word", pa.binary()), ("n", pa.int64())])
_CELLS = pa.schema([("tile", pa.int64()), ("part", pa.int64()), ("left", pa.binary()), ("right", pa.binary()), ("n", pa.binary())])
_TILES = "tile long, part long, left binary, right binary, n binary"
_PAIRS = pa.schema([("p", pa.int64()), ("left", pa.int64()), ("right", pa.int64()), ("n", pa.int64())])


def _tokens(batch: pa.RecordBatch) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray, list[str]]]:
    """Per slice of texts: bytes, starts, ends, symbols and language numbers of words, True where the next word follows.

    A symbol is a 64-bit hash of language and word.
    """
    langs = batch.column(1).dictionary_encode()
    names = langs.dictionary.to_pylist()
    number = np.asarray(langs.indices.to_numpy(zero_copy_only=False), np.int64)
    seeds = mix(Rolling(byte_values(np.frombuffer("\0".join(names).encode(), np.uint8)))(*_ranges(names))) if names else np.zeros(0, np.uint64)
    for row, end, data, at in slices(batch):
        data = lowered(data)
        starts, ends, first = words_of(data, at, _APART)
        if not len(starts):
            continue
        doc = np.repeat(np.arange(row, end), np.diff(first))
        lang = number[doc]
        breaks = np.concatenate([[0], np.cumsum(_BREAK[data])])
        joined = np.zeros(len(starts), bool)
        joined[:-1] = (doc[1:] == doc[:-1]) & (breaks[starts[1:]] == breaks[ends[:-1]])
        yield data, starts, ends, mix(Rolling(byte_values(data))(starts, ends) ^ seeds[lang]), lang, joined, names


def _ranges(names: list[str]) -> tuple[np.ndarray, np.ndarray]:
    sizes = np.array([len(x.encode()) for x in names], np.int64)
    starts = np.concatenate([[0], np.cumsum(sizes + 1)[:-1]]).astype(np.int64)
    return starts, starts + sizes


def _totals(keys: np.ndarray, weights: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Distinct keys in order, the index of one occurrence, and the sum of their weights."""
    order = np.argsort(keys, kind="stable")
    keys = keys[order]
    new = np.flatnonzero(np.concatenate([[True], keys[1:] != keys[:-1]])) if len(keys) else np.zeros(0, np.int64)
    return keys[new], order[new], np.add.reduceat(weights[order], new) if len(keys) else weights


def _count_words(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    held, tokens = [], 0

    def flush():
        s = np.concatenate([h[0] for h in held])
        keys, index, n = _totals(s, np.concatenate([h[1] for h in held]))
        langs = pa.concat_arrays([h[2] for h in held]).take(pa.array(index))
        words = pa.concat_arrays([h[3] for h in held]).take(pa.array(index))
        for i in range(0, len(keys), 100_000):
            yield arrow(_WORDS, signed(keys[i : i + 100_000]), langs[i : i + 100_000], words[i : i + 100_000], n[i : i + 100_000])

    for batch in batches:
        for data, starts, ends, s, lang, _, names in _tokens(batch):
            keys, index, n = _totals(s, np.ones(len(s), np.int64))
            sizes = ends[index] - starts[index]
            offsets = np.concatenate([[0], np.cumsum(sizes)]).astype(np.int32)
            words = pa.Array.from_buffers(pa.binary(), len(keys), [None, pa.py_buffer(offsets), pa.py_buffer(data[stretches(starts[index], sizes)])])
            held.append((keys, n, pa.array(names, pa.string()).take(pa.array(lang[index])), words))
            tokens += len(keys)
            if tokens > CHUNK // 4:
                yield from flush()
                held, tokens = [], 0
    if held:
        yield from flush()


def word_counts(docs: DataFrame, text: Column | str = "text", lang: Column | str = "lang") -> DataFrame:
    """(s, lang, word, n): every word of every language with its occurrences, written. s is its symbol."""
    rows = _rows(docs, text, lang)
    parts = rows.mapInArrow(_count_words, "s long, lang string, word binary, n long")
    return written(parts.groupBy("s", "lang", "word").agg(F.sum("n").alias("n")))


def _rows(docs: DataFrame, text: Column | str, lang: Column | str) -> DataFrame:
    as_column = lambda c: F.col(c) if isinstance(c, str) else c
    return bounded_batches(docs).select(F.coalesce(as_column(text), F.lit("")).alias("text"), F.coalesce(as_column(lang), F.lit("und")).alias("lang"))


class Symbols:
    """What tasks know of the symbols that reach the minimum: ids of the most frequent, a bitmap of all."""

    def __init__(self, frequent: DataFrame, key: str, n: str, head: int):
        top = frequent.orderBy(F.desc(n), F.asc(key)).limit(head).select(key).toArrow().column(0).to_numpy().view(np.uint64)
        self.by_rank = top
        order = np.argsort(top)
        self.hashes, self.ids = top[order], order.astype(np.int64)
        words = frequent.select(F.expr(f"shiftrightunsigned({key}, 38)").alias("bit")).groupBy(F.expr("shiftright(bit, 5)").alias("at")).agg(F.bit_or(F.expr("shiftleft(1L, cast(bit & 31 as int))")).alias("bits")).toArrow()
        self.map = np.zeros(BITS >> 5, np.uint32)
        self.map[words.column("at").to_numpy()] = words.column("bits").to_numpy().astype(np.uint32)

    def maybe(self, s: np.ndarray) -> np.ndarray:
        """False only for symbols below the minimum."""
        bit = s >> np.uint64(38)
        return (self.map[bit >> np.uint64(5)] >> (bit & np.uint64(31)).astype(np.uint32)) & np.uint32(1) != 0

    def id(self, s: np.ndarray) -> np.ndarray:
        """Rank by frequency, or -1 for a symbol without an id."""
        if not len(self.hashes):
            return np.full(len(s), -1, np.int64)
        at = np.minimum(np.searchsorted(self.hashes, s), len(self.hashes) - 1)
        return np.where(self.hashes[at] == s, self.ids[at], -1)


def pair_symbol(left: np.ndarray, right: np.ndarray) -> np.ndarray:
    return mix(mix(left) + right * np.uint64(0x9E3779B97F4A7C15))


def _codes(left: np.ndarray, right: np.ndarray, left_id: np.ndarray, right_id: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Pairs as tile * CELLS + cell where both symbols have ids, and the symbols of the others."""
    known = (left_id >= 0) & (right_id >= 0)
    i, j = left_id[known], right_id[known]
    code = ((i // SIDE) * (HEAD // SIDE) + j // SIDE) * CELLS + (i % SIDE) * SIDE + j % SIDE
    return code, left[~known], right[~known]


def _tiles(codes: np.ndarray, left: np.ndarray, right: np.ndarray, part: int, loose: int) -> Iterator[pa.RecordBatch]:
    """Counts of the given cells: (tile, cells, counts) for codes, hashed coordinates in `loose` buckets for the pairs without ids."""
    rows: list[tuple] = []
    crowd = np.bincount(codes // CELLS) if len(codes) else np.zeros(0, np.int64)
    for t in np.flatnonzero(crowd >= CROWDED):
        here = codes // CELLS == t
        dense = np.bincount(codes[here] % CELLS, minlength=CELLS)
        cells = np.flatnonzero(dense)
        rows.append((int(t), cells.astype(np.uint32).tobytes(), b"", dense[cells].astype(np.uint32).tobytes()))
        codes = codes[~here]
    codes = np.sort(codes)
    new = np.flatnonzero(np.concatenate([[True], codes[1:] != codes[:-1]])) if len(codes) else np.zeros(0, np.int64)
    counts = np.diff(np.append(new, len(codes))).astype(np.uint32)
    codes = codes[new]
    at = codes // CELLS
    cuts = np.flatnonzero(np.concatenate([[True], at[1:] != at[:-1]])) if len(at) else np.zeros(0, np.int64)
    cells = (codes % CELLS).astype(np.uint32)
    for a, b in zip(cuts, np.append(cuts[1:], len(at))):
        rows.append((int(at[a]), cells[a:b].tobytes(), b"", counts[a:b].tobytes()))
    if len(left):
        x, y, n = _coordinates(left, right, np.ones(len(left), np.int64))
        bucket = (mix(x ^ mix(y)) % np.uint64(loose)).astype(np.int64)
        order = np.argsort(bucket, kind="stable")
        x, y, n, bucket = x[order], y[order], n[order], bucket[order]
        cuts = np.flatnonzero(np.concatenate([[True], bucket[1:] != bucket[:-1]]))
        for a, b in zip(cuts, np.append(cuts[1:], len(bucket))):
            rows.append((-1 - int(bucket[a]), x[a:b].tobytes(), y[a:b].tobytes(), n[a:b].astype(np.uint32).tobytes()))
    for k in range(0, len(rows), 4096):
        some = rows[k : k + 4096]
        yield arrow(_CELLS, [r[0] for r in some], [part] * len(some), *([r[c] for r in some] for c in (1, 2, 3)))


def _coordinates(left: np.ndarray, right: np.ndarray, n: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Sorted distinct (left, right) with summed counts."""
    order = np.lexsort((right, left))
    left, right = left[order], right[order]
    new = np.flatnonzero(np.concatenate([[True], (left[1:] != left[:-1]) | (right[1:] != right[:-1])])) if len(left) else np.zeros(0, np.int64)
    return left[new], right[new], np.add.reduceat(n[order], new) if len(left) else n


def _cells(rows: DataFrame, words, pairs, loose: int) -> DataFrame:
    """Partial tiles of (word, word) cells, or with `pairs` of (pair, word) cells."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        part = TaskContext.get().partitionId()
        vocabulary, ranked = words.value, pairs.value if pairs is not None else None
        held, size = [], 0
        for batch in batches:
            for _, _, _, s, _, joined, _ in _tokens(batch):
                frequent = vocabulary.maybe(s)
                both = np.flatnonzero(joined[:-1] & frequent[:-1] & frequent[1:])
                if ranked is None:
                    ids = np.full(len(s), -1, np.int64)
                    ids[frequent] = vocabulary.id(s[frequent])
                    cells = _codes(s[both], s[both + 1], ids[both], ids[both + 1])
                else:
                    symbol = pair_symbol(s[both], s[both + 1])
                    keep = ranked.maybe(symbol)
                    both, symbol = both[keep], symbol[keep]
                    go = np.flatnonzero(both[1:] == both[:-1] + 1) if len(both) else both
                    third = s[both[go] + 2]
                    cells = _codes(symbol[go], third, ranked.id(symbol[go]), vocabulary.id(third))
                held.append(cells)
                size += len(cells[0]) + 2 * len(cells[1])
                if size > CHUNK:
                    held, full = [], [np.concatenate([h[c] for h in held]) for c in range(3)]
                    yield from _tiles(*full, part, loose)
                    size, full = 0, None
                    pa.default_memory_pool().release_unused()
        if size:
            yield from _tiles(*(np.concatenate([h[c] for h in held]) for c in range(3)), part, loose)

    return rows.mapInArrow(run, _TILES)


class _Sum:
    """Running counts of one tile (dense once crowded) or of one bucket of coordinates."""

    def __init__(self, tile: int):
        self.tile, self.dense, self.held, self.size = tile, None, [], 0

    def add(self, left: bytes, right: bytes, n: bytes) -> None:
        coordinates = self.tile < 0
        self.held.append((np.frombuffer(left, np.uint64 if coordinates else np.uint32), np.frombuffer(right, np.uint64), np.frombuffer(n, np.uint32 if len(n) * (2 if coordinates else 1) == len(left) else np.uint64)))
        self.size += len(self.held[-1][0])
        if self.size > CHUNK // 4:
            self.settle()

    def settle(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        left, right, n = (np.concatenate([h[c] for h in self.held]) for c in range(3))
        n = n.astype(np.int64)
        if self.tile < 0:
            left, right, n = _coordinates(left, right, n)
        else:
            # Weighted counts are sums of whole numbers in doubles: exact below 2**53.
            dense = np.bincount(left, weights=n, minlength=CELLS) if len(left) > 2048 else None
            if dense is not None:
                left = np.flatnonzero(dense).astype(np.uint32)
                n = dense[left].astype(np.int64)
            else:
                left, _, n = _totals(left, n)
        self.held = [(left, right, n.astype(np.uint64))]
        self.size = len(left)
        return left, right, n


def _sums(batches: Iterator[pa.RecordBatch]) -> Iterator[_Sum]:
    """Rows come sorted by tile; one tile is held at a time."""
    now = None
    for batch in batches:
        for tile, left, right, n in zip(*(batch.column(c).to_pylist() for c in ("tile", "left", "right", "n"))):
            if now is None or tile != now.tile:
                if now is not None:
                    yield now
                now = _Sum(tile)
            now.add(left, right, n)
    if now is not None:
        yield now


def _added(tiles: DataFrame, parts: int) -> DataFrame:
    """Partial tiles of many tasks, brought down to at most FAN_IN for a tile, in as many steps as that takes."""

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part = -1

        def parted():
            nonlocal part
            for batch in batches:
                parts_of = batch.column("part").to_numpy()
                cuts = np.flatnonzero(np.concatenate([[True], parts_of[1:] != parts_of[:-1]]))
                for a, b in zip(cuts, np.append(cuts[1:], len(parts_of))):
                    yield int(parts_of[a]), batch.slice(a, b - a)

        now = None
        for p, rows in parted():
            for tile, left, right, n in zip(*(rows.column(c).to_pylist() for c in ("tile", "left", "right", "n"))):
                if now is None or (tile, p) != (now.tile, part):
                    if now is not None:
                        yield _packed(now, part)
                    now, part = _Sum(tile), p
                now.add(left, right, n)
        if now is not None:
            yield _packed(now, part)

    while parts > FAN_IN:
        parts = -(-parts // FAN_IN)
        grouped = tiles.withColumn("part", F.expr(f"part div {FAN_IN}")).repartition("tile", "part").sortWithinPartitions("tile", "part")
        tiles = grouped.mapInArrow(add, _TILES)
    return tiles


def _packed(now: _Sum, part: int) -> pa.RecordBatch:
    left, right, n = now.settle()
    return arrow(_CELLS, [now.tile], [part], [left.tobytes()], [right.tobytes()], [n.astype(np.uint64).tobytes()])


def _frequent(tiles: DataFrame, left_names, right_names, least: int) -> DataFrame:
    """(p, left, right, n) of all cells that reach the minimum, by symbols; p is the symbol of the two together."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lefts, rights = left_names.value.by_rank, right_names.value.by_rank
        for sums in _sums(batches):
            left, right, n = sums.settle()
            keep = n >= least
            left, n = left[keep], n[keep]
            if sums.tile < 0:
                right = right[keep]
            else:
                i, j = divmod(sums.tile, HEAD // SIDE)
                right = rights[j * SIDE + left % SIDE]
                left = lefts[i * SIDE + left // SIDE]
            for k in range(0, len(n), 50_000):
                x, y = left[k : k + 50_000], right[k : k + 50_000]
                yield arrow(_PAIRS, signed(pair_symbol(x, y)), signed(x), signed(y), n[k : k + 50_000])

    return tiles.repartition("tile").sortWithinPartitions("tile").mapInArrow(run, "p long, left long, right long, n long")


def phrase_counts(docs: DataFrame, least: int = 10, text: Column | str = "text", lang: Column | str = "lang", head: int = HEAD) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(words, pairs, triples), written: all words; all phrases of two and three words that occur `least` times or more.

    words: s, lang, word (bytes), n. pairs: p, left, right (symbols of words), n. triples: left (symbol of the pair of
    the first two words), right (symbol of the last word), n.
    """
    if not 1 <= head <= HEAD or least < 1:
        raise ValueError(f"head must be between 1 and {HEAD}, least at least 1")
    spark: SparkSession = docs.sparkSession
    rows = _rows(docs, text, lang)
    words = word_counts(docs, text, lang)
    if words.groupBy("s").count().where("count > 1").limit(1).count():
        raise ValueError("two words share a 64-bit symbol; change the hash base")
    parts = max(rows.rdd.getNumPartitions(), 1)
    loose = 16 * parts
    vocabulary = spark.sparkContext.broadcast(Symbols(words.where(F.col("n") >= least), "s", "n", head))
    pairs = written(_frequent(_added(_cells(rows, vocabulary, None, loose), parts), vocabulary, vocabulary, least))
    ranked = spark.sparkContext.broadcast(Symbols(pairs, "p", "n", head))
    triples = written(_frequent(_added(_cells(rows, vocabulary, ranked, loose), parts), ranked, vocabulary, least).drop("p"))
    return words, pairs, triples


def _score(a: Column, left: Column, right: Column) -> Column:
    """floor(1000000 * a * a / (left * right)) in decimals of 38 digits; as a is at most either part, it fits a long."""
    wide = lambda c: c.cast("decimal(18,0)")
    return F.call_function("div", wide(a) * wide(a) * F.lit(1_000_000).cast("decimal(7,0)"), wide(left) * wide(right)).cast("long")


def collocations(docs: DataFrame, least: int = 10, first: int = 2000, covered: int = 50, text: Column | str = "text", lang: Column | str = "lang", head: int = HEAD) -> DataFrame:
    """Each language's best phrases: lang, rank (from 1), phrase, a, l, r, n, score.

    a: occurrences of the phrase. l and r: those of its two parts at the cut with the lowest score (ties: the earlier
    cut). n: all words of the language. A phrase goes if a longer one that contains it has `covered` percent of its
    occurrences or more. Order: score, a (both falling), phrase by its bytes.
    """
    words, pairs, triples = phrase_counts(docs, least, text, lang, head)
    known = words.where(F.col("n") >= least).select("s", "lang", F.col("word").cast("string").alias("word"), "n")
    word = lambda i: known.select(F.col("s").alias(f"s{i}"), F.col("word").alias(f"w{i}"), F.col("n").alias(f"n{i}"))
    two = pairs.select(F.col("left").alias("s1"), F.col("right").alias("s2"), F.col("n").alias("a"), "p")
    three = (
        triples.select(F.col("left").alias("p"), F.col("right").alias("s3"), F.col("n").alias("a"))
        .join(two.select("p", "s1", "s2", F.col("a").alias("n12")), "p")
        .join(two.select(F.col("s1").alias("s2"), F.col("s2").alias("s3"), F.col("a").alias("n23"), F.col("p").alias("q")), ["s2", "s3"])
    )
    longer = three.select("p", "a").unionByName(three.select(F.col("q").alias("p"), "a")).groupBy("p").agg(F.max("a").alias("longest"))
    two = two.join(longer, "p", "left").where(F.col("longest").isNull() | (F.col("longest") * 100 < F.col("a") * covered))
    two = two.join(known.select(F.col("s").alias("s1"), "lang", F.col("word").alias("w1"), F.col("n").alias("l")), "s1").join(word(2), "s2")
    two = two.select("lang", F.concat_ws(" ", "w1", "w2").alias("phrase"), "a", "l", F.col("n2").alias("r"))
    three = three.join(known.select(F.col("s").alias("s1"), "lang", F.col("word").alias("w1"), F.col("n").alias("n1")), "s1").join(word(2), "s2").join(word(3), "s3")
    early = _score(F.col("a"), F.col("n1"), F.col("n23")) <= _score(F.col("a"), F.col("n12"), F.col("n3"))
    three = three.select("lang", F.concat_ws(" ", "w1", "w2", "w3").alias("phrase"), "a", F.when(early, F.col("n1")).otherwise(F.col("n12")).alias("l"), F.when(early, F.col("n23")).otherwise(F.col("n3")).alias("r"))
    found = two.unionByName(three).withColumn("score", _score(F.col("a"), F.col("l"), F.col("r")))
    rank = F.expr("row_number() over (partition by lang order by score desc, a desc, phrase)").cast("long")
    best = found.withColumn("rank", rank).where(F.col("rank") <= first)
    totals = words.groupBy("lang").agg(F.sum("n").alias("n"))
    return best.join(totals, "lang").select("lang", "rank", "phrase", "a", "l", "r", "n", "score")
