"""Prefix trie of conversations, rolled up by centroid decomposition of its parent edges.

A node is a distinct sequence of first turns; its key is a pair of 64-bit polynomial sums over the turns, so a node's
parent follows from its last turn. Subtree sums come from splitting: every component (at first the whole trie) gives
up its centroid, the deepest node that holds more than half of the component's weight. The nodes that hold more than
half are exactly the path from the centroid to the component's top: they receive the total of the centroid's
subtree, and the parts above and below become components of at most half the weight. Weights are turns of members,
summed over the subtree; they come from one grouping. Components above `limit` are split by joins, all at once in each
round; smaller ones are split to the end inside a task. So a trie that is one deep path takes rounds in the
logarithm of its depth.

Rows without conv_id belong to no conversation and are left out. Null roles and texts are empty; a null turn comes
first; equal turns go by role and text; repeated rows are turns of their own; further columns are ignored; an empty
table has no nodes. ``conv_id % 5`` is SQL's remainder (it has the sign of conv_id).
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from .util import arrow, bounded_batches, discard, powers, written

_BASES = (0x9E3779B97F4A7C15, 0xD6E8FEB86659FD93)
_MASK = 2**64 - 1
ROOT = bytes(16)
#: Turns of members in a component that one task splits to the end.
LIMIT = 100_000

_TURNS = pa.schema([("part", pa.int32()), ("conv_id", pa.int64()), ("at", pa.int64()), *((f"{k}{i}", pa.int64()) for k in "ph" for i in (0, 1)), ("bytes", pa.int64())])
_TURNS_SQL = "part int, conv_id long, at long, p0 long, p1 long, h0 long, h1 long, bytes long"
_PATHS = pa.schema([("conv_id", pa.int64()), ("depth", pa.int64()), ("turns", pa.int64()), ("key", pa.binary()), ("parent", pa.binary()), ("bytes", pa.int64())])
_PATHS_SQL = "conv_id long, depth long, turns long, key binary, parent binary, bytes long"


def _unsigned(column: pa.ChunkedArray | pa.Array) -> np.ndarray:
    return column.to_numpy(zero_copy_only=False).astype(np.int64, copy=False).view(np.uint64)


def _number(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Place of each turn within this task's share of its conversation, and the sum of hash * base**place up to it."""
    from pyspark import TaskContext

    part, conv, count, sums = TaskContext.get().partitionId(), None, 0, [0, 0]
    for batch in batches:
        ids = batch.column("conv_id").to_numpy()
        n = len(ids)
        if not n:
            continue
        cuts = np.flatnonzero(np.concatenate([[True], ids[1:] != ids[:-1]]))
        sizes = np.diff(np.append(cuts, n))
        at = np.arange(n) - np.repeat(cuts, sizes)
        held = count if conv == ids[0] else 0
        hashes = [_unsigned(batch.column(f"h{i}")) for i in (0, 1)]
        prefix = []
        for i, base in enumerate(_BASES):
            running = np.concatenate([np.zeros(1, np.uint64), np.cumsum(hashes[i] * powers(base, n))])
            back = powers(pow(base, -1, 2**64), n)
            p = (running[1:] - np.repeat(running[cuts], sizes)) * np.repeat(back[cuts], sizes)
            if held:
                p[: sizes[0]] = p[: sizes[0]] * np.uint64(pow(base, held, 2**64)) + np.uint64(sums[i])
            prefix.append(p)
        at[: sizes[0]] += held
        conv, count, sums = ids[-1], int(at[-1]) + 1, [int(p[-1]) for p in prefix]
        yield arrow(_TURNS, np.full(n, part, np.int32), ids, at, *(p.view(np.int64) for p in prefix), *(h.view(np.int64) for h in hashes), batch.column("bytes"))


def _offsets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Where each task's share of a conversation that spans several tasks begins, and the sums before it."""
    schema = pa.schema([("part", pa.int32()), ("conv_id", pa.int64()), ("before", pa.int64()), ("b0", pa.int64()), ("b1", pa.int64())])
    for batch in batches:
        out = []
        for conv, shares in zip(batch.column("conv_id").to_pylist(), batch.column("shares").to_pylist()):
            before, sums = 0, [0, 0]
            for share in shares:
                out.append((share["part"], conv, before, *(int(np.uint64(s).view(np.int64)) for s in sums)))
                for i, base in enumerate(_BASES):
                    sums[i] = (sums[i] + pow(base, before, 2**64) * (share[f"p{i}"] & _MASK)) & _MASK
                before += share["n"]
        yield arrow(schema, *([r[c] for r in out] for c in range(5)))


def _keys(first: np.ndarray, second: np.ndarray) -> pa.Array:
    n = len(first)
    return pa.Array.from_buffers(pa.binary(), n, [None, pa.py_buffer((np.arange(n + 1) * 16).astype(np.int32)), pa.py_buffer(np.stack([first, second], 1).tobytes())])


def _rebuilt(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Keys of rebuilt prefixes. A row's sum moves from place `at` to `at + shift` once the sum before its stretch is replaced."""
    for batch in batches:
        column = {name: batch.column(name) for name in batch.schema.names}
        at, before = (column[c].to_numpy() for c in ("at", "before"))
        at = at + before
        shift = column["shift"].to_numpy()
        keys, parents = [], []
        for i, base in enumerate(_BASES):
            own = _unsigned(column[f"b{i}"]) + _unsigned(column[f"p{i}"]) * _power(base, before)
            last = _unsigned(column[f"h{i}"]) * _power(base, at)
            moved = _power(pow(base, -1, 2**64), -shift)
            lost, gained = _unsigned(column[f"lost{i}"]), _unsigned(column[f"gained{i}"])
            keys.append(gained + (own - lost) * moved)
            parents.append(gained + (own - last - lost) * moved)
        yield arrow(_PATHS, column["conv_id"], at + shift + 1, column["turns"], _keys(*keys), _keys(*parents), column["bytes"])


def _power(base: int, exponents: np.ndarray) -> np.ndarray:
    """base**exponents modulo 2**64, by squaring, for exponents of any size."""
    out, square, left = np.ones(len(exponents), np.uint64), np.uint64(base), exponents.astype(np.int64)
    while left.any():
        out = np.where(left & 1 == 1, out * square, out)
        left = left >> 1
        square = np.uint64(int(square) * int(square) & _MASK)
    return out


def _numbered(rows: DataFrame) -> DataFrame:
    """Turns in order, written: places and sums within a task's share, and what lies before that share.

    The sort cuts a conversation of any length into shares, so none has to fit a task.
    """
    order = ["conv_id", F.col("turn").asc_nulls_first(), "role", "text"]
    turns = rows.repartitionByRange(*order).sortWithinPartitions(*order).select("conv_id", "h0", "h1", "bytes")
    turns = written(turns.mapInArrow(_number, _TURNS_SQL))
    shares = turns.groupBy("conv_id", "part").agg(F.count("*").alias("n"), *(F.max_by(f"p{i}", "at").alias(f"p{i}") for i in (0, 1)))
    split = shares.groupBy("conv_id").agg(F.array_sort(F.collect_list(F.struct("part", "n", "p0", "p1"))).alias("shares")).where("size(shares) > 1")
    before = split.mapInArrow(_offsets, "part int, conv_id long, before long, b0 long, b1 long")
    zero = F.lit(0).cast("long")
    joined = turns.join(before, ["conv_id", "part"], "left")
    return joined.withColumns({c: F.coalesce(c, zero) for c in ("before", "b0", "b1")})


def paths(conversations: DataFrame, block: int = 5, spread: int = 9) -> tuple[DataFrame, DataFrame]:
    """(convs, paths), written. convs: conv_id, turns (after rebuilding). paths: every first d turns of every rebuilt
    conversation, as conv_id, depth, turns, key, parent, bytes (of the last text).

    Conversation c takes its first h = crc32(c) % spread turns from conversation c - c % block.
    """
    text = F.coalesce("text", F.lit(""))
    rows = bounded_batches(conversations).where("conv_id is not null").select(F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"), F.coalesce("role", F.lit("")).alias("role"), text.alias("text"))
    rows = rows.withColumns({"h0": F.xxhash64("role", "text"), "h1": F.xxhash64(F.lit(1), "text", "role"), "bytes": F.octet_length("text").cast("long")})
    turns = written(_numbered(rows))
    taken = F.crc32(F.col("conv_id").cast("string").cast("binary")) % spread
    convs = turns.groupBy("conv_id").agg(F.count("*").alias("n")).select("conv_id", "n", taken.alias("h"), (F.col("conv_id") - F.col("conv_id") % block).alias("base"))
    # The sums over the first turns of each conversation, fewer than `spread` of them; only its first task's share can hold them whole.
    place = F.col("at") + F.col("before")
    early = turns.where(place < spread - 1)
    sums = early.select("conv_id", place.alias("at"), *(f"{k}{i}" for k in "pb" for i in (0, 1)), "before").mapInArrow(_whole_sums, "conv_id long, at long, s0 long, s1 long")
    heads = sums.groupBy("conv_id").agg(F.map_from_entries(F.collect_list(F.struct("at", F.struct("s0", "s1").alias("s")))).alias("sums"), F.count("*").alias("seen"))
    zero = F.lit(0).cast("long")
    at = lambda m, k, i: F.coalesce(F.col(m)[k][f"s{i}"], zero)
    plan = convs.join(heads.select("conv_id", F.col("sums").alias("own")), "conv_id").join(heads.select(F.col("conv_id").alias("base"), F.col("sums").alias("given"), "seen"), "base", "left")
    m = F.least(F.col("h"), F.coalesce("seen", zero))
    plan = plan.withColumn("m", m).select(
        "conv_id", "base", "h", "m", (F.col("m") + F.greatest(F.col("n") - F.col("h"), zero)).alias("turns"),
        *(F.try_element_at("own", F.col("h") - 1)[f"s{i}"].alias(f"lost{i}") for i in (0, 1)),
        *(F.try_element_at("given", F.col("m") - 1)[f"s{i}"].alias(f"gained{i}") for i in (0, 1)),
    ).fillna(0)
    plan = written(plan)
    given = early.withColumnRenamed("conv_id", "base").join(plan.select("conv_id", "base", "m", "turns"), "base").where(place < F.col("m"))
    given = given.withColumns({c: zero for c in ("lost0", "lost1", "gained0", "gained1", "shift")}).select("conv_id", *_MOVES)
    own = turns.join(plan.drop("base"), "conv_id").where(place >= F.col("h")).withColumn("shift", F.col("m") - F.col("h")).select("conv_id", *_MOVES)
    found = written(given.unionByName(own).mapInArrow(_rebuilt, _PATHS_SQL))
    discard(turns)
    return plan.select("conv_id", "turns"), found


_MOVES = ("at", "before", "shift", "turns", "bytes", *(f"{k}{i}" for k in ("p", "b", "h", "lost", "gained") for i in (0, 1)))


def _whole_sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    schema = pa.schema([("conv_id", pa.int64()), ("at", pa.int64()), ("s0", pa.int64()), ("s1", pa.int64())])
    for batch in batches:
        before = batch.column("before").to_numpy()
        sums = [_unsigned(batch.column(f"b{i}")) + _unsigned(batch.column(f"p{i}")) * _power(base, before) for i, base in enumerate(_BASES)]
        yield arrow(schema, batch.column("conv_id"), batch.column("at"), *(s.view(np.int64) for s in sums))


def _split(parent: list[int], weight: list[int], tops: list[int], values: list[list[int]], extra: list[list[int]]) -> list[list[int]]:
    """Subtree sums of each value over a forest, by centroids; extra holds what was added to a node before."""
    below: list[list[int]] = [[] for _ in parent]
    for v, p in enumerate(parent):
        if p >= 0:
            below[p].append(v)
    gone, left = bytearray(len(parent)), list(tops)
    out = [[0] * len(parent) for _ in values]
    while left:
        top = left.pop()
        half, path, centre = weight[top], [], top
        while (heavy := next((u for u in below[centre] if not gone[u] and 2 * weight[u] > half), None)) is not None:
            path.append(centre)
            centre = heavy
        under = [centre]
        for u in under:
            under.extend(w for w in below[u] if not gone[w])
        for value, more, result in zip(values, extra, out):
            total = sum(map(value.__getitem__, under))
            result[centre] = more[centre] + total
            for u in path:
                more[u] += total
        for u in path:
            weight[u] -= weight[centre]
        gone[centre] = 1
        for u in below[centre]:
            if not gone[u]:
                gone[u] = 1
                left.append(u)
        if path:
            left.append(top)
    return out


def _split_all(columns: list[str]):
    """Components come whole and one after the other; those of about LIMIT nodes together are split at once."""

    def solve(table: pa.Table) -> pa.Table:
        keys, comps = table.column("key").to_pylist(), table.column("comp").to_pylist()
        index = {k: i for i, k in enumerate(keys)}
        parent = [-1 if k == c else index[p] for k, c, p in zip(keys, comps, table.column("parent").to_pylist())]
        weight = table.column("weight").to_pylist()
        tops = [i for i, p in enumerate(parent) if p < 0]
        sums = _split(parent, weight, tops, [table.column(c).to_pylist() for c in columns], [table.column(f"extra_{c}").to_pylist() for c in columns])
        for c, values in zip(columns, sums):
            table = table.set_column(table.schema.get_field_index(f"extra_{c}"), f"extra_{c}", pa.array(values, pa.int64()))
        return table

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        rows = 0
        for batch in batches:
            if not batch.num_rows:
                continue
            held.append(batch)
            rows += batch.num_rows
            if rows < LIMIT:
                continue
            table = pa.Table.from_batches(held)
            comps = table.column("comp")
            last = comps[len(comps) - 1].as_py()
            # The last component may go on in the next batch.
            own = comps.combine_chunks().to_pylist()
            cut = next((i + 1 for i in range(len(own) - 1, -1, -1) if own[i] != last), 0)
            if cut:
                yield from solve(table.slice(0, cut)).to_batches()
                held = table.slice(cut).to_batches()
                rows = table.num_rows - cut
        if rows:
            yield from solve(pa.Table.from_batches(held)).to_batches()

    return run


def rollup(nodes: DataFrame, members: DataFrame, columns: list[str], limit: int = LIMIT) -> DataFrame:
    """Every column's sum over each node's subtree, in place of the column.

    nodes: key, parent, depth, conv_id (a member), weight (positive; summed over the subtree) and further columns.
    members: conv_id, key, parent of each node on each conversation's path. The root has the key ROOT.
    """
    extras = [f"extra_{c}" for c in columns]
    root = F.lit(bytearray(ROOT))
    live = written(nodes.withColumns({"comp": root, **{e: F.lit(0).cast("long") for e in extras}}))
    done, small = [], []
    while True:
        tops = live.where("key = comp").select("comp", F.col("weight").alias("whole"))
        large = tops.where(F.col("whole") > limit)
        if not large.limit(1).count():
            small.append(live)
            break
        marked = live.join(large, "comp", "left")
        small.append(written(marked.where("whole is null").drop("whole")))
        heavy = F.col("weight") * 2 > F.col("whole")
        centres = marked.where(heavy).groupBy("comp", "whole").agg(F.max_by(F.struct(F.col("key").alias("centre"), F.col("depth").alias("centre_depth"), F.col("weight").alias("centre_weight")), "depth").alias("c")).select("comp", "whole", "c.*")
        centres = written(centres)
        through = members.join(centres.select("comp", F.col("centre").alias("parent")), "parent").select("comp", "conv_id", F.col("key").alias("child"))
        placed = live.join(centres, "comp").join(through, ["comp", "conv_id"], "left")
        is_centre, is_below = F.col("key") == F.col("centre"), F.col("child").isNotNull() & (F.col("depth") > F.col("centre_depth"))
        placed = placed.withColumn("place", F.when(is_centre, 0).when(is_below, 1).when(heavy, 2).otherwise(3))
        placed = written(placed.withColumn("next", F.when(is_below, F.col("child")).otherwise(F.col("comp"))).drop("child", "centre", "centre_depth", "whole"))
        totals = placed.where("place < 2").groupBy("comp").agg(*(F.sum(c).alias(f"total_{c}") for c in columns))
        added = placed.join(totals, "comp")
        kept = [*nodes.columns, *extras]
        gains = {f"extra_{c}": F.col(f"extra_{c}") + F.when(F.col("place").isin(0, 2), F.col(f"total_{c}")).otherwise(0) for c in columns}
        added = added.withColumns({**gains, "weight": F.col("weight") - F.when(F.col("place") == 2, F.col("centre_weight")).otherwise(0)}).drop("comp")
        done.append(written(added.where("place = 0").select(*kept)))
        old, live = live, written(added.where("place > 0").select(*kept, F.col("next").alias("comp")))
        discard(old)
        discard(placed)
    rest = small[0]
    for frame in small[1:]:
        rest = rest.unionByName(frame)
    rest = rest.repartition("comp").sortWithinPartitions("comp", "key")
    out = rest.mapInArrow(_split_all(columns), rest.schema).drop("comp")
    for frame in done:
        out = out.unionByName(frame)
    return out.drop(*columns, "weight").withColumnsRenamed({f"extra_{c}": c for c in columns})


def _hash_lists(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """SHA-256 of each key's sorted ids, joined by commas. A list is fed to the hash as it streams by, never held."""
    schema = pa.schema([("key", pa.binary()), ("ends_sha256", pa.string())])
    now, state = None, None
    for batch in batches:
        keys, digests = [], []
        for key, conv in zip(batch.column("key").to_pylist(), batch.column("conv_id").to_pylist()):
            if key == now:
                state.update(b",%d" % conv)
                continue
            if now is not None:
                keys.append(now)
                digests.append(state.hexdigest())
            now, state = key, hashlib.sha256(b"%d" % conv)
        yield arrow(schema, keys, digests)
    if now is not None:
        yield arrow(schema, [now], [state.hexdigest()])


def prefix_trie(conversations: DataFrame, block: int = 5, spread: int = 9, limit: int = LIMIT) -> DataFrame:
    """One row per node: conv_id (its smallest member), depth, parent_conv_id (null for the root), n_convs,
    n_children, n_leaves, saved_tokens, ends_sha256, and the node's key."""
    convs, found = paths(conversations, block, spread)
    below = F.col("turns") - F.col("depth") + 1
    inner = found.groupBy("key").agg(F.min("parent").alias("parent"), F.min("depth").alias("depth"), F.count("*").alias("n_convs"), F.min("conv_id").alias("conv_id"), F.min("bytes").alias("bytes"), F.sum(below).alias("weight"))
    root = F.lit(bytearray(ROOT))
    # The root counts once for each conversation, like any node for its members.
    top = convs.agg(F.count("*").alias("n_convs"), F.min("conv_id").alias("conv_id"), F.sum(F.col("turns") + 1).alias("weight")).where("n_convs > 0")
    top = top.select(root.alias("key"), F.lit(None).cast("binary").alias("parent"), F.lit(0).cast("long").alias("depth"), "n_convs", "conv_id", F.lit(0).cast("long").alias("bytes"), "weight")
    nodes = written(inner.unionByName(top.select(*inner.columns)))
    children = nodes.where("parent is not null").groupBy(F.col("parent").alias("key")).agg(F.count("*").alias("n_children"))
    nodes = nodes.join(children, "key", "left").withColumn("n_children", F.coalesce("n_children", F.lit(0).cast("long")))
    nodes = nodes.withColumns({"n_leaves": (F.col("n_children") == 0).cast("long"), "saved_tokens": (F.col("n_convs") - 1) * F.col("bytes")}).drop("bytes")
    summed = written(rollup(nodes, found, ["n_leaves", "saved_tokens"], limit))
    ends = found.where("depth = turns").select("key", "conv_id").unionByName(convs.where("turns = 0").select(root.alias("key"), "conv_id"))
    ends = ends.repartition("key").sortWithinPartitions("key", "conv_id").mapInArrow(_hash_lists, "key binary, ends_sha256 string")
    # Every conversation passes the root, so its member is known without joining the many nodes below it.
    first = nodes.where("depth = 0").select("conv_id").collect()
    first = F.lit(first[0][0] if first else None).cast("long")
    deeper = summed.where("depth > 1").join(summed.select(F.col("key").alias("parent"), F.col("conv_id").alias("parent_conv_id")), "parent", "left")
    shallow = summed.where("depth <= 1").withColumn("parent_conv_id", F.when(F.col("depth") == 1, first))
    out = deeper.unionByName(shallow.select(*deeper.columns)).join(ends, "key", "left")
    empty = hashlib.sha256(b"").hexdigest()
    return out.select("conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", F.coalesce("ends_sha256", F.lit(empty)).alias("ends_sha256"), "key")
