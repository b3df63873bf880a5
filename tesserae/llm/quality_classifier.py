"""Quality classifier by co-training on two views of a document.

The text view sees which tokens a text holds (runs of letters and runs of symbols, hashed) and how varied they
are; the metadata view sees language, source and recorded size, never the text. Both start from labelled rows.
In each round either view labels those unlabelled documents of which it is confident and hands them to the other
view's training set. All unlabelled documents take part: executors add up the gradients of their rows, the driver
only moves the weights. A held-out fold of the labelled rows calibrates both views (Platt scaling) and weighs them
against each other; the combined probability scores all documents.

A document is good if it is labelled of good quality and not toxic; several labels of a document count as their
worst. Of labelled documents at most FIT_ROWS are fitted on, those with the smallest hash of doc_id, whole texts
each; unlabelled ones without any limit; scoring covers every document. Null texts are empty, null metadata is a value of
its own, labels without doc_id or quality are left out, a null toxic counts as 0. Without labelled documents of
both kinds there is nothing to learn from: all documents score the share of good ones (1 without labels) and
are kept. Repeated rows repeat; an empty table gives an empty result; further columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from .util import arrow, bounded_batches, discard, lowered, mix, slices, word_hashes, words_of, written

#: Labelled documents that are fitted on: the bound on the labelled sample.
FIT_ROWS = 12_000
ROUNDS = 2
#: Passes over all confident documents in each round.
STEPS = 6
#: Probability from which a view's word is taken as a label.
CONFIDENT = 0.97
THRESHOLD = 0.5
#: Hashed tokens, then the two measures of variety; hashed metadata values.
TOKENS, META = 1 << 18, 1 << 12
#: Numbers of a gradient in one row, and partial gradients that one task adds up.
BLOCK, FAN_IN = 1 << 13, 64
_LETTER = np.array([chr(b).isalpha() or b >= 128 for b in range(256)])
_SYMBOL = np.array([33 <= b < 127 and not chr(b).isalnum() for b in range(256)])


def _tokens(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(text number, bucket) of the distinct tokens of each text, sorted, and the two measures of each text."""
    data = lowered(data)
    texts = len(offsets) - 1
    number, bucket = [], []
    for kind in (_LETTER, _SYMBOL):
        starts, ends, first = words_of(data, offsets, ~kind)
        number.append(np.repeat(np.arange(texts), np.diff(first)))
        bucket.append((word_hashes(data, starts, ends) & np.uint64(TOKENS - 1)).astype(np.int64))
    number, bucket = np.concatenate(number), np.concatenate(bucket)
    count = np.maximum(np.bincount(number, minlength=texts), 1)
    held = np.unique(number * TOKENS + bucket)
    distinct = np.bincount(held // TOKENS, minlength=texts)
    return held // TOKENS, held % TOKENS, np.stack([distinct / count, 1 / np.sqrt(count)], 1).astype(np.float32)


def _meta_buckets(lang: list, source: list, size: list) -> np.ndarray:
    """Three buckets for each document: language, source, order of magnitude of the recorded size."""
    import zlib

    rows = [(f"l{a}", f"s{b}", "n?" if c is None else f"n{max(int(c), 1).bit_length()}") for a, b, c in zip(lang, source, size, strict=True)]
    raw = np.array([[zlib.crc32(v.encode()) for v in row] for row in rows], np.uint64).reshape(len(rows), 3)
    return (mix(raw) & np.uint64(META - 1)).astype(np.int64)


class View:
    """Logistic regression on sparse binary features and dense ones; theta holds their weights and the offset."""

    def __init__(self, dimensions: int, dense: int = 0):
        self.dimensions, self.theta = dimensions, np.zeros(dimensions + dense + 1)

    def margin(self, row: np.ndarray, column: np.ndarray, dense: np.ndarray) -> np.ndarray:
        """row must be sorted; there are as many rows as dense has."""
        return np.bincount(row, self.theta[: self.dimensions][column], len(dense)) + dense @ self.theta[self.dimensions : -1] + self.theta[-1]

    def slope(self, row, column, dense, label) -> np.ndarray:
        """The gradient of the summed loss."""
        error = _sigmoid(self.margin(row, column, dense)) - label
        return np.concatenate([np.bincount(column, error[row], self.dimensions), error @ dense, [error.sum()]])

    def fit(self, row, column, dense, label, steps: int = 60) -> View:
        held = np.unique(column)
        small = View(len(held), dense.shape[1])
        at, move = np.searchsorted(held, column), Adam(small)
        for _ in range(steps):
            move(small.slope(row, at, dense, label) / len(label))
        self.theta[held], self.theta[self.dimensions :] = small.theta[: len(held)], small.theta[len(held) :]
        return self


class Adam:
    """Steps along mean gradients with a ridge penalty on the sparse weights."""

    def __init__(self, view: View, rate: float = 0.05, ridge: float = 2e-5):
        self.view, self.rate, self.ridge, self.step = view, rate, ridge, 0
        self.m, self.v = np.zeros_like(view.theta), np.zeros_like(view.theta)

    def __call__(self, slope: np.ndarray) -> None:
        self.step += 1
        n = self.view.dimensions
        slope[:n] += self.ridge * self.view.theta[:n]
        self.m += 0.1 * (slope - self.m)
        self.v += 0.01 * (slope**2 - self.v)
        self.view.theta -= self.rate * (self.m / (1 - 0.9**self.step)) / (np.sqrt(self.v / (1 - 0.99**self.step)) + 1e-8)


def _sigmoid(z: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(z, -50, 50)))


def _platt(margins: np.ndarray, label: np.ndarray) -> np.ndarray:
    """Weights of the margins and an offset: a small logistic regression by Newton steps."""
    x = np.column_stack([margins, np.ones(len(label))])
    w = np.zeros(x.shape[1])
    for _ in range(30):
        p = _sigmoid(x @ w)
        w -= np.linalg.solve((x * (p * (1 - p))[:, None]).T @ x + 1e-3 * np.eye(len(w)), x.T @ (p - label) + 1e-3 * w)
    return w


class Features:
    """Both views of some documents."""

    def __init__(self, row, column, dense, meta):
        self.row, self.column, self.dense, self.meta = row, column, dense, meta

    def where(self, keep: np.ndarray) -> Features:
        new = np.cumsum(keep) - 1
        held = keep[self.row]
        return Features(new[self.row[held]], self.column[held], self.dense[keep], self.meta[keep])

    def view(self, name: str) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        if name == "text":
            return self.row, self.column, self.dense
        return np.repeat(np.arange(len(self.meta)), 3), self.meta.ravel(), np.zeros((len(self.meta), 0), np.float32)


NAMES = ("text", "meta")


def _new(name: str) -> View:
    return View(TOKENS, 2) if name == "text" else View(META)


def _drawn(ids: DataFrame, most: int) -> DataFrame:
    """The `most` ids with the smallest hash: a bounded frame, which may therefore be broadcast."""
    return ids.orderBy(F.xxhash64("doc_id"), "doc_id").limit(most)


_FEATURES = pa.schema([("doc_id", pa.int64()), ("buckets", pa.binary()), ("dense", pa.binary()), ("meta", pa.binary())])
_FEATURES_SQL = "doc_id long, buckets binary, dense binary, meta binary"
_BLOCKS = pa.schema([("block", pa.int32()), ("part", pa.int32()), ("values", pa.binary())])
_BLOCKS_SQL = "block int, part int, values binary"
_SCORES = pa.schema([("doc_id", pa.int64()), ("text_score", pa.float64()), ("meta_score", pa.float64()), ("score", pa.float64())])
_READ = ("doc_id", "text", "lang", "source", "n_chars")


def _featured(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for a, b, data, offsets in slices(batch):
            part = batch.slice(a, b - a).to_pydict()
            row, column, dense = _tokens(data, offsets)
            cuts = np.searchsorted(row, np.arange(b - a + 1))
            meta = _meta_buckets(part["lang"], part["source"], part["n_chars"])
            held = [column[i:j].astype("<i4").tobytes() for i, j in zip(cuts[:-1], cuts[1:], strict=True)]
            yield arrow(_FEATURES, part["doc_id"], held, [d.astype("<f4").tobytes() for d in dense], [m.astype("<i4").tobytes() for m in meta])


def _numbers(column: pa.Array, kind: str) -> tuple[np.ndarray, np.ndarray]:
    """All numbers of a column of packed numbers, and how many each row has."""
    values = column.to_pylist()
    numbers = np.frombuffer(b"".join(values), kind)
    return numbers, np.array([len(v) // numbers.itemsize for v in values], np.int64)


def _read(batch: pa.RecordBatch) -> tuple[Features, np.ndarray, np.ndarray]:
    """Features, label (NaN: none) and calibration mark of stored rows."""
    at = {n: batch.column(n) for n in batch.schema.names}
    column, count = _numbers(at["buckets"], "<i4")
    features = Features(np.repeat(np.arange(len(count), dtype=np.int32), count), column, _numbers(at["dense"], "<f4")[0].reshape(-1, 2), _numbers(at["meta"], "<i4")[0].reshape(-1, 3))
    return features, at["label"].to_numpy(zero_copy_only=False).astype(float), at["held"].to_numpy(zero_copy_only=False).astype(bool)


def _first_views(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Both views fitted on the labelled sample, which is bounded and comes to one task."""
    parts = [_read(b) for b in batches if b.num_rows]
    if not parts:
        return
    at = np.cumsum([0] + [len(label) for _, label, _ in parts])
    features = Features(
        np.concatenate([f.row + np.int32(k) for (f, _, _), k in zip(parts, at)]), np.concatenate([f.column for f, _, _ in parts]),
        np.concatenate([f.dense for f, _, _ in parts]), np.concatenate([f.meta for f, _, _ in parts]),
    )
    label = np.concatenate([x for _, x, _ in parts])
    del parts
    thetas = [_new(v).fit(*features.view(v), label).theta for v in NAMES]
    yield arrow(_BLOCKS, list(range(2)), [0, 0], [t.tobytes() for t in thetas])


def _round_slopes(teachers: dict[str, View], pupils: dict[str, View], confident: float):
    """Per task: summed gradients of both pupils over labelled rows and those of which the other view is sure, with counts."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        total = np.zeros(sum(len(pupils[v].theta) + 1 for v in NAMES))
        for batch in batches:
            features, label, held = _read(batch)
            slopes = []
            for pupil, teacher in (NAMES, NAMES[::-1]):
                chance = _sigmoid(teachers[teacher].margin(*features.view(teacher)))
                pool = np.isnan(label)
                use = np.where(pool, (chance >= confident) | (chance <= 1 - confident), ~held)
                said = np.where(pool, chance >= 0.5, label)
                slopes += [pupils[pupil].slope(*features.where(use).view(pupil), said[use]), [use.sum()]]
            total += np.concatenate(slopes)
        yield from _blocks(total, TaskContext.get().partitionId())

    return run


def _blocks(total: np.ndarray, part: int) -> Iterator[pa.RecordBatch]:
    cuts = range(0, len(total), BLOCK)
    yield arrow(_BLOCKS, [c // BLOCK for c in cuts], [part] * len(cuts), [total[c : c + BLOCK].tobytes() for c in cuts])


def _add_blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows come sorted by (block, part); one sum is held at a time."""
    now, total = None, None
    for batch in batches:
        for block, part, values in zip(*(batch.column(c).to_pylist() for c in range(3))):
            if now != (block, part):
                if now is not None:
                    yield arrow(_BLOCKS, [now[0]], [now[1]], [total.tobytes()])
                now, total = (block, part), np.zeros(len(values) // 8)
            total += np.frombuffer(values)
    if now is not None:
        yield arrow(_BLOCKS, [now[0]], [now[1]], [total.tobytes()])


def _summed(partial: DataFrame, parts: int) -> np.ndarray:
    """One gradient from those of all tasks, added up in steps of FAN_IN; a gradient's length comes to the driver."""
    while True:
        parts = -(-parts // FAN_IN)
        partial = partial.withColumn("part", F.expr(f"part div {FAN_IN}").cast("int")).repartition("block", "part").sortWithinPartitions("block", "part")
        partial = partial.mapInArrow(_add_blocks, _BLOCKS_SQL)
        if parts <= 1:
            break
    return np.concatenate([np.frombuffer(v) for v in partial.orderBy("block").select("values").toArrow().column(0).to_pylist()])


def co_train(stored: DataFrame, views: dict[str, View], rounds: int, confident: float, steps: int = STEPS) -> tuple[dict[str, View], list[dict[str, int]]]:
    """Views after some rounds of exchange over all stored rows, and how many rows each was fitted on by round."""
    context, parts, used = stored.sparkSession.sparkContext, max(stored.rdd.getNumPartitions(), 1), []
    for _ in range(rounds):
        pupils = {v: _new(v) for v in NAMES}
        for v in NAMES:
            pupils[v].theta = views[v].theta.copy()
        moves = {v: Adam(pupils[v]) for v in NAMES}
        for _ in range(steps):
            shared = context.broadcast((views, pupils))
            total = _summed(stored.mapInArrow(lambda b, s=shared: _round_slopes(*s.value, confident)(b), _BLOCKS_SQL), parts)
            at, counts = 0, {}
            for v in NAMES:
                size = len(pupils[v].theta)
                counts[v] = int(total[at + size])
                moves[v](total[at : at + size] / max(counts[v], 1))
                at += size + 1
            shared.unpersist()
        used.append(counts)
        views = pupils
    return views, used


def _needed(docs: DataFrame) -> list:
    text = [F.col("doc_id").cast("long"), F.coalesce("text", F.lit(""))]
    return [c.alias(n) for c, n in zip([*text, F.col("lang").cast("string"), F.col("source").cast("string"), F.col("n_chars").cast("long")], _READ, strict=True)]


def fit(docs: DataFrame, labels: DataFrame, fit_rows: int = FIT_ROWS, rounds: int = ROUNDS, confident: float = CONFIDENT):
    """The views, their calibrations and their combination; a number, the share of good documents, if nothing can be learnt."""
    known = labels.where("doc_id is not null and quality is not null").groupBy(F.col("doc_id").cast("long").alias("doc_id"))
    known = known.agg(((F.min("quality") == 1) & (F.coalesce(F.max("toxic"), F.lit(0)) == 0)).cast("double").alias("label"))
    needed = bounded_batches(docs).select(*_needed(docs))
    ids = needed.select("doc_id").where("doc_id is not null").distinct()
    chosen = written(_drawn(ids.join(known, "doc_id"), fit_rows))
    held = F.pmod(F.xxhash64("doc_id", F.lit("calibration")), F.lit(5)) == 0
    kinds = {(r.held, r.label): r["count"] for r in chosen.groupBy(held.alias("held"), "label").count().collect()}
    if any((fold, label) not in kinds for fold in (True, False) for label in (0.0, 1.0)):
        total = sum(kinds.values())
        return sum(n for (_, label), n in kinds.items() if label) / total if total else 1.0
    # One row of each labelled document: of rows that share a doc_id the one with the smallest text.
    sample = needed.join(F.broadcast(chosen), "doc_id").groupBy("doc_id").agg(F.min(F.struct("text", "lang", "source", "n_chars")).alias("r")).select("doc_id", "r.*")
    sample = written(sample.mapInArrow(_featured, _FEATURES_SQL).join(F.broadcast(chosen), "doc_id").withColumn("held", held))
    first = sample.where("not held").repartition(1).sortWithinPartitions("doc_id").mapInArrow(_first_views, _BLOCKS_SQL).orderBy("block").toArrow().column(2).to_pylist()
    views = {v: _new(v) for v in NAMES}
    for v, theta in zip(NAMES, first):
        views[v].theta = np.frombuffer(theta).copy()
    if rounds:
        pool = needed.mapInArrow(_featured, _FEATURES_SQL).join(known.select("doc_id"), "doc_id", "left_anti")
        pool = written(pool.select("*", F.lit(None).cast("double").alias("label"), F.lit(False).alias("held")))
        views, _ = co_train(pool.unionByName(sample.where("not held").select(pool.columns)), views, rounds, confident)
        discard(pool)
    shared = docs.sparkSession.sparkContext.broadcast(views)

    def margins(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        schema = pa.schema([(n, pa.float64()) for n in ("text", "meta", "label")])
        for batch in batches:
            features, label, _ = _read(batch)
            yield arrow(schema, *(shared.value[v].margin(*features.view(v)) for v in NAMES), label)

    # The calibration fold of the bounded sample: three numbers a document.
    fold = sample.where("held").orderBy("doc_id").mapInArrow(margins, "text double, meta double, label double").toArrow()
    x, label = np.column_stack([fold.column(v).to_numpy() for v in NAMES]), fold.column("label").to_numpy()
    alone = {v: _platt(x[:, [i]], label) for i, v in enumerate(NAMES)}
    return views, alone, _platt(x, label)


def _probabilities(batch: pa.RecordBatch, model) -> Iterator[tuple[int, int, list[np.ndarray]]]:
    """(first row, last row, probabilities of the text view, the metadata view and both) of parts of a batch."""
    views, alone, combined = model
    for a, b, data, offsets in slices(batch):
        lang, source, size = (batch.column(n).slice(a, b - a).to_pylist() for n in ("lang", "source", "n_chars"))
        features = Features(*_tokens(data, offsets), _meta_buckets(lang, source, size))
        margins = np.column_stack([views[v].margin(*features.view(v)) for v in ("text", "meta")])
        single = [_sigmoid(margins[:, i] * alone[v][0] + alone[v][1]) for i, v in enumerate(("text", "meta"))]
        yield a, b, [*single, _sigmoid(margins @ combined[:-1] + combined[-1])]


def quality_scores(docs: DataFrame, labels: DataFrame, threshold: float = THRESHOLD, **options) -> DataFrame:
    """docs(doc_id, text, lang, source, n_chars), labels(doc_id, quality, toxic) -> doc_id, text_score, meta_score, score, keep."""
    fitted = fit(docs, labels, **options)
    needed = docs.select(*_needed(docs))
    if isinstance(fitted, float):
        share = F.lit(fitted)
        return needed.select("doc_id", share.alias("text_score"), share.alias("meta_score"), share.alias("score"), F.lit(True).alias("keep"))
    model = docs.sparkSession.sparkContext.broadcast(fitted)

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for a, b, chances in _probabilities(batch, model.value):
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(a, b - a), *map(pa.array, chances)], schema=_SCORES)

    scored = needed.mapInArrow(score, "doc_id long, text_score double, meta_score double, score double")
    return scored.withColumn("keep", F.col("score") >= threshold)


def kept_rows(docs: DataFrame, labels: DataFrame, threshold: float = THRESHOLD, **options) -> DataFrame:
    """The rows of docs that the classifier does not reject, with all their columns; nothing is shuffled."""
    fitted = fit(docs, labels, **options)
    if isinstance(fitted, float):
        return docs
    model = docs.sparkSession.sparkContext.broadcast(fitted)
    rows = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"), *_needed(docs))
    shape = rows.schema["row"].dataType

    def keep(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for a, b, chances in _probabilities(batch, model.value):
                part = pa.RecordBatch.from_arrays([batch.column(0).slice(a, b - a)], names=["row"])
                yield part.filter(pa.array(chances[2] >= threshold))

    return rows.mapInArrow(keep, f"row {shape.simpleString()}").select("row.*")
