"""N-gram Jaccard join by set-relation skipping.

A document's set holds the distinct shingles of `words` consecutive words ([^\\x20\\x09-\\x0D]+, A-Z lower-cased) of
its whole text; a text with fewer words has its whole sequence as its only shingle, one without words the empty set,
which is linked with nothing. Two documents link if 100 * intersection >= percent * union. The result names the
classes of documents that links connect.

How it runs. The shingles of a set, in the order of their hashes, are cut into blocks at fixed positions of the hash
line, so many that two linked sets must agree on at least one whole block that is not empty. Index lists are kept by
(size class, block, content of the block): a probe skips every block but those on which both sets agree entirely.
Lists with the same first set are taken together, so that a set is compared, and sent, once for each first set and
not once for each block it shares with it. For each first set its answers are computed: who of its lists links with
it. Sets that link with the same set are in one class, whatever their own similarity, so for lists whose sets have
thereby all met in one class nothing is left to do. In the others sets of different classes are compared. Before any
set is sent anywhere, sketches of about a tenth of their size bound from below in how many shingles two sets differ; a
pair that cannot link for that is left out, and so is a set of a long list that can link with no other of it. Only
texts that are left then, a small share of those on lists, get sets, and what may link is compared whole. In long
lists the answers of a set follow from those of the first set: each set is reduced to its difference from it, two
sets link if their differences cancel out but for a few shingles, and only sets that share one of the rarest shingles
of these (small) differences are looked at. Lists longer than BLOCK, or with more than WEIGHT shingles, are worked on
in pairs of blocks.

Equal texts are one text. Null texts have no words. A null doc_id is larger than any other; a class of nulls has the
class id null. Repeated rows repeat; an empty table gives an empty result; further columns are not read.
"""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from ..operators.components import connected_components
from .util import Rolling, ascii_lower, discard, distinct_texts, free_name, mix, order_id, settled, signed, slices, stretches, together, word_hashes, words_of, written

WORDS, PERCENT = 5, 80
#: Lists up to this length are compared pair by pair; longer ones by differences.
SHORT = 12
#: Sets of a list, and their shingles, that one task compares at once; twice as many for a pair of blocks.
BLOCK, WEIGHT = 4000, 1_000_000
#: Texts are shuffled in so many parts, one after the other, so that shuffle files take less room.
PARTS = 2
#: Index lists, which hold more than the texts, are made and shuffled in so many parts; no list is in two of them.
LISTS = 4
#: Bytes of sketches that are compared at once in a long list.
SCREEN = 4_000_000
#: Pairs with sketches that are shuffled at once, for each set: together about as large as the sets.
SKETCHED = 8


def size_class(percent: int, largest: int) -> np.ndarray:
    """Smallest sizes of the classes; linked sets are in the same class or in adjacent ones."""
    bounds = [1]
    while bounds[-1] <= largest:
        bounds.append(max(bounds[-1] + 1, -(-100 * bounds[-1] // percent)))
    return np.array(bounds, np.int64)


def blocks_of(bounds: np.ndarray, percent: int) -> tuple[np.ndarray, np.ndarray]:
    """(number of blocks, empty blocks that are allowed for) of each class, by the class of the larger set of a pair.

    Linked sets differ in at most d shingles, so of d + 1 + e blocks they agree on e + 1 or more; a set with at most e
    empty blocks then agrees on one that is not empty. e is large enough for nearly all sets; others list their empty
    blocks as well.
    """
    counts, spare = [], []
    for k in range(len(bounds) - 1):
        d = 2 * (int(bounds[k + 1]) - 1) * (100 - percent) // (100 + percent)
        least = int(bounds[max(0, k - 1)])
        e = 0
        while True:
            m = d + 1 + e
            mean = m * (1 - 1 / m) ** least
            if e >= mean + 3 * math.sqrt(mean) or e > d + 8:
                break
            e += 1
        counts.append(m)
        spare.append(e)
    return np.array(counts, np.int64), np.array(spare, np.int64)


def shingle_sets(data: np.ndarray, offsets: np.ndarray, words: int) -> tuple[np.ndarray, np.ndarray]:
    """(shingle hashes of all texts, ascending and distinct within a text; the n+1 places where texts begin)."""
    starts, ends, first = words_of(data, offsets)
    count = np.diff(first)
    places = np.where(count >= words, count - words + 1, (count > 0).astype(np.int64))
    text = np.repeat(np.arange(len(count)), places)
    at = stretches(first[:-1], places)
    hashes = Rolling(word_hashes(data, starts, ends))(at, at + np.minimum(count[text], words))
    order = np.lexsort((hashes, text))
    hashes, text = hashes[order], text[order]
    keep = np.ones(len(hashes), bool)
    keep[1:] = (hashes[1:] != hashes[:-1]) | (text[1:] != text[:-1])
    return hashes[keep], np.searchsorted(text[keep], np.arange(len(count) + 1))


_LISTED = pa.schema([("list", pa.int64()), ("uid", pa.int64())])


def _lists(batches: Iterator[pa.RecordBatch], words: int, percent: int, part: int, parts: int) -> Iterator[pa.RecordBatch]:
    """(list, uid) for each list that a text is on, of every parts-th list."""
    for batch in batches:
        uid = batch.column(0).to_numpy()
        for a, _, data, offsets in slices(batch):
            hashes, first = shingle_sets(data, offsets, words)
            size = np.diff(first)
            bounds = size_class(percent, int(size.max(initial=1)) + 1)
            bounds = np.append(bounds, max(int(bounds[-1]) + 1, -(-100 * int(bounds[-1]) // percent)))
            counts, spare = blocks_of(bounds, percent)
            own = np.searchsorted(bounds, size, "right") - 1
            sums = np.append(np.uint64(0), np.cumsum(mix(hashes + np.uint64(0x9E3779B97F4A7C15))))
            for step in (0, 1):
                some = np.flatnonzero(size > 0)
                kind = own[some] + step
                blocks = counts[kind]
                text = np.repeat(np.arange(len(some)), size[some])
                at = stretches(first[some], size[some])
                # Block of each shingle: its place on the hash line; ascending, like the hashes.
                base = np.append(0, np.cumsum(blocks))
                block = base[text] + (((hashes[at] >> np.uint64(32)) * blocks[text].astype(np.uint64)) >> np.uint64(32)).astype(np.int64)
                held = np.bincount(block, minlength=base[-1])
                ends = np.cumsum(held)
                # Texts without shingles are left out of `at`, which is otherwise the whole line in order.
                content = sums[ends] - sums[ends - held]
                owner = np.repeat(np.arange(len(some)), blocks)
                empty = np.bincount(owner, held == 0, len(some))
                keep = (held > 0) | (empty > spare[kind])[owner]
                place = (np.arange(base[-1]) - base[owner]).astype(np.uint64)
                tag = mix((place << np.uint64(32)) | kind[owner].astype(np.uint64))
                lists = mix(content + tag)
                keep &= lists % np.uint64(parts) == np.uint64(part)
                yield pa.RecordBatch.from_arrays([pa.array(signed(lists[keep])), pa.array(uid[a + some[owner[keep]]])], schema=_LISTED)


def _firsts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(list, uid) in this order -> (uid, first uid of a list it is on), for all uids but the first."""
    current = head = None
    for batch in batches:
        lists, uid = batch.column(0).to_numpy(), batch.column(1).to_numpy()
        if not len(lists):
            continue
        begins = np.ones(len(lists), bool)
        begins[1:] = lists[1:] != lists[:-1]
        begins[0] = lists[0] != current
        at = np.maximum.accumulate(np.where(begins, np.arange(len(lists)), -1))
        heads = np.where(at >= 0, uid[at], 0 if head is None else head)
        current, head = lists[-1], heads[-1]
        keep = uid != heads
        yield pa.RecordBatch.from_arrays([pa.array(uid[keep]), pa.array(heads[keep])], names=["u", "v"])


_SET = pa.schema([("uid", pa.int64()), ("shingles", pa.binary())])


def _sets(batches: Iterator[pa.RecordBatch], words: int) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for a, b, data, offsets in slices(batch):
            hashes, first = shingle_sets(data, offsets, words)
            held = pa.array([hashes[i:j].tobytes() for i, j in zip(first[:-1], first[1:], strict=True)], pa.binary())
            yield pa.RecordBatch.from_arrays([batch.column(0).slice(a, b - a), held], schema=_SET)


_SKETCH = pa.schema([("uid", pa.int64()), ("n", pa.int64()), ("sketch", pa.binary())])


def sketch(hashes: np.ndarray, first: np.ndarray) -> list[bytes]:
    """One byte for each of 2**k <= n buckets of a set's n shingles: the sum, modulo 256, of a byte of their hashes.

    A shingle that only one of two sets has changes one bucket at most, so sets differ in at least as many shingles as
    in buckets. Sums of half as many buckets follow from these, by adding the second half to the first.
    """
    size = np.diff(first)
    buckets = np.where(size > 0, 1 << np.frexp(np.maximum(size, 1))[1].astype(np.int64) - 1, 0)
    base = np.append(0, np.cumsum(buckets))
    text = np.repeat(np.arange(len(size)), size)
    at = base[text] + (hashes & (buckets[text] - 1).astype(np.uint64)).astype(np.int64)
    sums = np.bincount(at, ((hashes >> np.uint64(40)) & np.uint64(255)).astype(float), base[-1]).astype(np.int64).astype(np.uint8)
    return [sums[i:j].tobytes() for i, j in zip(base[:-1], base[1:], strict=True)]


def least_difference(x: bytes, y: bytes) -> int:
    """Shingles in which sets with these sketches differ at least."""
    x, y = np.frombuffer(x, np.uint8), np.frombuffer(y, np.uint8)
    if not len(x) or not len(y):
        return 0
    x, y = (z.reshape(-1, min(len(x), len(y))).sum(0, dtype=np.uint8) for z in (x, y))
    return int(np.count_nonzero(x != y))


def _sketches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        held = batch.column(1).to_pylist()
        first = np.append(0, np.cumsum([len(s) // 8 for s in held])).astype(np.int64)
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(np.diff(first)), pa.array(sketch(np.frombuffer(b"".join(held), np.uint64), first), pa.binary())], schema=_SKETCH)


_SIZED = pa.schema([("uid", pa.int64()), ("key", pa.string()), ("first", pa.int64()), ("n", pa.int64()), ("sketch", pa.binary())])


def _sized(batches: Iterator[pa.RecordBatch], words: int) -> Iterator[pa.RecordBatch]:
    """(uid, key, first, text) -> the same with the size and the sketch of the text's set in place of the text."""
    for batch in batches:
        for a, b, data, offsets in slices(batch):
            hashes, first = shingle_sets(data, offsets, words)
            held = [c.slice(a, b - a) for c in batch.columns[:3]]
            yield pa.RecordBatch.from_arrays([*held, pa.array(np.diff(first)), pa.array(sketch(hashes, first), pa.binary())], schema=_SIZED)


def _alike(batches: Iterator[pa.RecordBatch], percent: int) -> Iterator[pa.RecordBatch]:
    """Pairs whose sketches leave it open whether they link."""
    for batch in batches:
        u, v, n, x, m, y = (batch.column(i) for i in range(6))
        ok = [
            _linked(a, b, max(abs(a - b), least_difference(s, t)), percent)
            for a, s, b, t in zip(n.to_pylist(), x.to_pylist(), m.to_pylist(), y.to_pylist(), strict=True)
        ]
        keep = pa.array(ok, pa.bool_())
        yield pa.RecordBatch.from_arrays([u.filter(keep), v.filter(keep)], names=["u", "v"])


def _linked(n: int, m: int, differ: int, percent: int) -> bool:
    """Whether sets of n and m shingles that differ in `differ` of them link."""
    return 100 * (n + m - differ) >= percent * (n + m + differ)


def _verify(batches: Iterator[pa.RecordBatch], percent: int) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        a, b = batch.column(0), batch.column(1)
        ok = []
        for x, y in zip(batch.column(2).to_pylist(), batch.column(3).to_pylist(), strict=True):
            x, y = np.frombuffer(x, np.uint64), np.frombuffer(y, np.uint64)
            both = np.concatenate([x, y])
            both.sort()
            common = int((both[1:] == both[:-1]).sum())
            ok.append(_linked(len(x), len(y), len(both) - 2 * common, percent))
        keep = pa.array(ok, pa.bool_())
        yield pa.RecordBatch.from_arrays([a.filter(keep), b.filter(keep)], names=["u", "v"])


def _candidates(pairs: DataFrame, sketches: DataFrame, percent: int) -> DataFrame:
    """pairs(u, v), written -> those that may link as far as sketches(uid, n, sketch) tell, written."""
    left = sketches.select(F.col("uid").alias("u"), F.col("n").alias("a"), F.col("sketch").alias("x"))
    right = sketches.select(F.col("uid").alias("v"), F.col("n").alias("b"), F.col("sketch").alias("y"))
    parts = max(1, -(-pairs.count() // max(1, SKETCHED * sketches.count())))
    done = []
    for part in range(parts):
        some = pairs.where(F.pmod(F.xxhash64("u", "v"), F.lit(parts)) == part)
        both = some.join(left, "u").join(right, "v").select("u", "v", "a", "x", "b", "y")
        done.append(written(both.mapInArrow(lambda b: _alike(b, percent), "u long, v long")))
        del both
    return together(done)


def _links(pairs: DataFrame, sets: DataFrame, sketches: DataFrame, percent: int) -> DataFrame:
    """pairs(u, v), written -> those that link, written; pairs that the sketches rule out take no sets along."""
    return _verified(_candidates(pairs, sketches, percent), sets, percent)


def _verified(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """pairs(u, v), written -> those that link, written; both sets are compared whole.

    Pairs are worked on in parts, each about as large as all sets together, so that the files of a shuffle stay in
    proportion to the sets however many pairs there are.
    """
    left = sets.select(F.col("uid").alias("u"), F.col("shingles").alias("x"))
    right = sets.select(F.col("uid").alias("v"), F.col("shingles").alias("y"))
    parts = max(1, -(-pairs.count() // max(1, sets.count())))
    done = []
    for part in range(parts):
        some = pairs.where(F.pmod(F.xxhash64("u", "v"), F.lit(parts)) == part)
        both = some.join(left, "u").join(right, "v").select("u", "v", "x", "y")
        done.append(written(both.mapInArrow(lambda b: _verify(b, percent), "u long, v long")))
        del both
    return together(done)


def may_link(sizes: np.ndarray, sketches: list[bytes], percent: int) -> np.ndarray:
    """For each set whether the sketches leave it open that it links with another one; none of the sets is empty.

    A set that has been found to link, perhaps, with an earlier one is not tried again itself, so many near copies
    take little time.
    """
    buckets = np.array([len(s) for s in sketches])
    groups = {int(k): np.flatnonzero(buckets == k) for k in np.unique(buckets)}
    whole = {k: np.frombuffer(b"".join(sketches[i] for i in at), np.uint8).reshape(-1, k) for k, at in groups.items()}
    halved = {(k, to): whole[k].reshape(-1, k // to, to).sum(1, dtype=np.uint8) for k in groups for to in groups if to <= k}
    found = np.zeros(len(sketches), bool)
    for k, mine in groups.items():
        step, at = max(1, SCREEN // (k * len(sketches))), 0
        while at < len(mine):
            place = at + np.flatnonzero(~found[mine[at:]])[:step]
            if not len(place):
                break
            at, rows = int(place[-1]) + 1, mine[place]
            for other, theirs in groups.items():
                to = min(k, other)
                differ = (halved[k, to][place][:, None, :] != halved[other, to][None, :, :]).sum(2, dtype=np.int32)
                n, m = sizes[rows][:, None], sizes[theirs][None, :]
                ok = _linked(n, m, np.maximum(differ, abs(n - m)), percent) & (rows[:, None] != theirs[None, :])
                found[rows] |= ok.any(1)
                found[theirs] |= ok.any(0)
    return found


def _screen(rows: pd.DataFrame, percent: int) -> pd.DataFrame:
    return rows.loc[may_link(rows["n"].to_numpy(), rows["sketch"].tolist(), percent), ["head", "p", "q", "uid"]]


def difference_links(sets: list[frozenset], label: list[int], percent: int) -> list[tuple[int, int]]:
    """Links that connect classes of one long list, by differences from its first set; label: class of each set so far."""
    parent = {x: x for x in label}

    def root(x):
        while parent[x] != x:
            parent[x] = parent[parent[x]]
            x = parent[x]
        return x

    links = []

    def meet(i: int, j: int) -> None:
        x, y = root(label[i]), root(label[j])
        if x != y:
            parent[max(x, y)] = min(x, y)
            links.append((i, j))

    first = sets[0]
    differ = [s ^ first for s in sets]
    for i, d in enumerate(differ):
        if i and _linked(len(sets[i]), len(first), len(d), percent):
            meet(i, 0)
    seen = Counter(x for d in differ for x in d)
    index: dict[int, list[int]] = {}
    # Sets with small differences first. The sum of two differences exceeds what linked sets may differ in, unless one
    # of them is empty or both link with the first set; so they must have some of their shingles in common.
    for i in sorted(range(len(sets)), key=lambda i: len(differ[i])):
        d = differ[i]
        if not d:
            continue
        ranked = sorted(d, key=lambda x: (seen[x], x))
        # At most this much may differ from a set of any size that could link.
        most = len(sets[i]) * (100 - percent) // percent
        tried = set()
        for x in ranked[: min(len(ranked), most + 1)]:
            for j in index.get(x, ()):
                if j not in tried:
                    tried.add(j)
                    if root(label[i]) != root(label[j]) and _linked(len(sets[i]), len(sets[j]), len(d ^ differ[j]), percent):
                        meet(i, j)
        shared = max(1, -(-(2 * len(d) - most) // 2))
        for x in ranked[: len(d) - shared + 1]:
            index.setdefault(x, []).append(i)
    return links


def _compare(rows: pd.DataFrame, percent: int) -> pd.DataFrame:
    rows = rows.sort_values("uid")
    sets = [frozenset(np.frombuffer(s, np.uint64).tolist()) for s in rows["shingles"]]
    uid = rows["uid"].tolist()
    links = difference_links(sets, rows["component"].tolist(), percent)
    return pd.DataFrame([(uid[i], uid[j]) for i, j in links], columns=["u", "v"], dtype="int64")


def jaccard_classes(docs: DataFrame, words: int = WORDS, percent: int = PERCENT, short: int = SHORT, block: int = BLOCK) -> DataFrame:
    """docs(doc_id, text) -> doc_id, n_shingles, component_id (smallest doc_id that links lead to, its own included)."""
    members, texts = distinct_texts(docs, ascii_lower(F.col("text")), PARTS)
    sized = written(texts.select("uid", "key", "first", "text").mapInArrow(lambda b: _sized(b, words), "uid long, key string, first long, n long, sketch binary"))
    names, sketches = sized.drop("sketch"), sized.select("uid", "n", "sketch")
    # One shuffle of the lists: a list arrives in order, so its first set is known without a second look.
    firsts = []
    for part in range(LISTS):
        listed = texts.select("uid", "text").mapInArrow(lambda b, part=part: _lists(b, words, percent, part, LISTS), "list long, uid long")
        listed = listed.repartition("list").sortWithinPartitions("list", "uid")
        firsts.append(written(listed.mapInArrow(_firsts, "u long, v long").distinct()))
        del listed
    near = written(together(firsts).distinct())
    lists = near.select(F.col("v").alias("head"), F.col("u").alias("uid"))
    lists = lists.unionByName(lists.select("head", F.col("head").alias("uid")).distinct()).join(names.select("uid", "n"), "uid")
    held = lists.groupBy("head").agg(F.count(F.lit(1)).alias("held"), F.sum("n").alias("weight"))
    lists = written(lists.select("uid", "head").join(held.where("held > 2"), "head"))

    # What may link as far as sketches tell: with the first set of a list, in a short list, in a long one.
    heads = _candidates(near, sketches, percent)
    brief = lists.where(F.col("held") <= short).groupBy("head").agg(F.array_sort(F.collect_list("uid")).alias("all"))
    each = brief.select("head", F.posexplode("all").alias("i", "u"), "all").select("head", "u", F.explode(F.expr("slice(all, i + 2, size(all))")).alias("v"))
    among = _candidates(written(each.where("u != head").select("u", "v").distinct()), sketches, percent)
    parts = F.greatest(F.ceil(F.col("held") / block), F.ceil(F.col("weight") / WEIGHT)).cast("int")
    part = F.pmod(F.xxhash64("uid"), parts).cast("int")
    long_ = lists.where(F.col("held") > short).withColumn("part", part).withColumn("other", F.explode(F.sequence(F.lit(0), parts - 1)))
    long_ = long_.select("head", F.least("part", "other").alias("p"), F.greatest("part", "other").alias("q"), "uid").join(sketches, "uid")
    tiles = written(long_.groupBy("head", "p", "q").applyInPandas(lambda rows: _screen(rows, percent), "head long, p int, q int, uid long"))
    del long_

    # Only what may link gets sets.
    pairs = heads.unionByName(among)
    wanted = written(pairs.select(F.col("u").alias("uid")).unionByName(pairs.select(F.col("v").alias("uid"))).unionByName(tiles.select("uid")).distinct())
    held = []
    for part in range(PARTS):
        some = texts.where(F.pmod("uid", F.lit(PARTS)) == part).join(wanted, "uid").select("uid", "text")
        held.append(written(some.mapInArrow(lambda b: _sets(b, words), "uid long, shingles binary")))
        del some
    sets = together(held)
    discard(texts)

    # Answers of the first sets.
    links = _verified(heads, sets, percent)
    classes = written(connected_components(wanted.select(F.col("uid").alias("u")), links).select(F.col("u").alias("uid"), "component"))

    # Sets of different classes.
    apart = among
    for end in ("u", "v"):
        apart = apart.join(classes.select(F.col("uid").alias(end), F.col("component").alias(f"{end}_component")), end)
    more = _verified(written(apart.where("u_component != v_component").select("u", "v")), sets, percent)
    tiles = tiles.join(classes, "uid")
    mixed = tiles.groupBy("head", "p", "q").agg(F.min("component").alias("a"), F.max("component").alias("b")).where("a < b")
    tiles = tiles.join(mixed.drop("a", "b"), ["head", "p", "q"]).join(sets, "uid")
    found = tiles.groupBy("head", "p", "q").applyInPandas(lambda rows: _compare(rows, percent), "u long, v long")
    links = written(links.unionByName(more).unionByName(found))

    classes = connected_components(wanted.select(F.col("uid").alias("u")), links).select(F.col("u").alias("uid"), "component")
    named = names.join(classes, "uid", "left").withColumn("component", F.coalesce("component", "uid"))
    smallest = named.groupBy("component").agg(F.min("first").alias("least"))
    answers = named.join(smallest, "component").select("key", "n", "least")
    none = F.lit(2**63 - 1)
    component = F.when(F.col("n") == 0, F.col("doc_id")).otherwise(F.when(F.col("least") != none, F.col("least")))
    return members.join(answers, "key").select("doc_id", F.col("n").alias("n_shingles"), component.alias("component_id"))


def kept_rows(docs: DataFrame, **options) -> DataFrame:
    """One document of each class, that with the class's smallest doc_id, with all its columns; documents without
    shingles stay. Rows that share a doc_id stay or go together; of a class of nulls all stay."""
    key, gone = free_name(docs), "component_id is not null and (doc_id is null or doc_id != component_id)"
    go = settled(docs.sparkSession, lambda: jaccard_classes(docs, **options).where(gone).select(order_id(F.col("doc_id")).alias(key)).distinct())
    return docs.withColumn(key, order_id(F.col("doc_id"))).join(go, key, "left_anti").drop(key)
