"""What the pipeline's stages leave in the shared folder, and the sketches that spare the Jaccard join most pairs of sets."""

import random

import numpy as np
import pytest

from tesserae.llm import decontaminate, exact_dedup, jaccard_join, util


@pytest.fixture
def folder(monkeypatch, tmp_path):
    """An empty shared folder; lists the sizes of the written files in it."""
    monkeypatch.setattr(util, "shared_folder", lambda spark: f"file://{tmp_path}")
    return lambda: [p.stat().st_size for p in tmp_path.rglob("part-*.parquet")]


def noise(n=60, words=400, seed=3):
    """Texts of random letters, which do not compress away, with some near copies and exact copies."""
    r = random.Random(seed)
    texts = [" ".join("".join(r.choices("abcdefghijklmnopqrstuvwxyz", k=7)) for _ in range(words)) for _ in range(n)]
    texts += [t + " and more" for t in texts[:10]] + texts[:5]
    return list(enumerate(texts))


def stages(spark):
    bench = spark.createDataFrame([(1, " ".join(noise()[30][1].split()[50:90]))], "item_id long, text string")
    return {"exact": (exact_dedup.kept_rows, 70), "near": (jaccard_join.kept_rows, 60), "leaks": (lambda d: decontaminate.clean_rows(d, bench), 74)}


@pytest.mark.parametrize("name", ["exact", "near", "leaks"])
def test_a_stage_leaves_its_answer_only(spark, make, folder, name):
    stage, rows = stages(spark)[name]
    docs = util.written(make(noise()))
    given = sum(folder())
    out = stage(docs)
    # An answer names documents; texts, sets and seeds of them are gone before the stage's rows are read.
    assert sum(folder()) - given < given / 5
    assert out.count() == rows and out.columns == docs.columns


def test_settled_keeps_what_is_asked_for(spark, folder):
    outside = util.written(spark.range(5))

    def make():
        util.written(spark.range(100))
        return util.settled(spark, lambda: util.written(spark.range(9)).where("id > 1")).where("id > 2")

    out = util.settled(spark, make)
    assert out.count() == 6 and outside.count() == 5
    left = len(folder())
    with pytest.raises(ZeroDivisionError):
        util.settled(spark, lambda: util.written(spark.range(3)) and 1 / 0)
    assert len(folder()) == left


def test_sketches_never_exceed_the_difference():
    r = np.random.default_rng(5)
    out = 0
    for trial in range(600):
        n, changed, more = int(r.integers(1, 300)), int(r.integers(0, 80)), int(r.integers(0, 80))
        x = np.unique(r.integers(0, 2**63, n, dtype=np.uint64))
        y = np.unique(np.concatenate([x[min(changed, len(x) - 1) :], r.integers(0, 2**63, more, dtype=np.uint64)]))
        a, b, none = jaccard_join.sketch(np.concatenate([x, y]), np.array([0, len(x), len(x) + len(y), len(x) + len(y)]))
        differ = len(np.setxor1d(x, y))
        assert len(x) / 2 < len(a) <= len(x) and none == b""
        assert jaccard_join.least_difference(a, b) <= differ and jaccard_join.least_difference(a, none) == 0
        out += jaccard_join.least_difference(a, b) >= differ / 3
    assert out > 400


def test_pairs_that_cannot_link_are_left_out_before_sets_travel(spark):
    r = np.random.default_rng(6)
    base = r.integers(0, 2**63, 200, dtype=np.uint64)
    near = [np.unique(np.append(base[k:], r.integers(0, 2**63, k, dtype=np.uint64))) for k in (0, 5, 18, 25)]
    far = [np.unique(np.append(base[:20], r.integers(0, 2**63, 180, dtype=np.uint64))) for _ in range(6)]
    sets = util.written(spark.createDataFrame([(i, bytearray(s.tobytes())) for i, s in enumerate([*near, *far])], "uid long, shingles binary"))
    sketches = util.written(sets.mapInArrow(jaccard_join._sketches, "uid long, n long, sketch binary"))
    pairs = util.written(spark.createDataFrame([(i, j) for i in range(10) for j in range(i)], "u long, v long"))
    left = {tuple(p) for p in jaccard_join._candidates(pairs, sketches, 80).collect()}
    linked = {tuple(p) for p in jaccard_join._links(pairs, sets, sketches, 80).collect()}
    want = {(i, j) for i in range(10) for j in range(i) if 100 * len(np.intersect1d(x := [*near, *far][i], y := [*near, *far][j])) >= 80 * len(np.union1d(x, y))}
    assert linked == want and want <= left and len(want) >= 3 and len(left) <= len(want) + 6


def test_only_texts_that_may_link_get_sets(spark, make, folder, monkeypatch):
    r = random.Random(8)
    word = lambda: "".join(r.choices("abcdefghijklmnopqrstuvwxyz", k=7))
    line = " ".join(word() for _ in range(25))
    texts = [" ".join([*(word() for _ in range(60)), line]) for _ in range(80)]
    texts += [f"{t} more" for t in texts[:4]]
    made = []
    monkeypatch.setattr(jaccard_join, "written", lambda df: made.append(util.written(df)) or made[-1])
    counts, discard = {}, jaccard_join.discard
    monkeypatch.setattr(jaccard_join, "discard", lambda df: counts.update(sets=sum(x.count() for x in made if x.columns == ["uid", "shingles"])) or discard(df))
    got = {x.doc_id: x.component_id for x in jaccard_join.jaccard_classes(make(list(enumerate(texts)))).collect()}
    assert got == {i: i - 80 if i >= 80 else i for i in range(84)}
    # The line puts other texts on common lists, in which they are told apart by sketches; the lists themselves are never written.
    assert 8 <= counts["sets"] <= 12
    assert not any("list" in x.columns for x in made)


@pytest.mark.parametrize("screen", [1, 4_000_000])
def test_screening_of_a_list_keeps_every_set_that_links(monkeypatch, screen):
    monkeypatch.setattr(jaccard_join, "SCREEN", screen)
    r = np.random.default_rng(9)
    kept = linked = total = 0
    for trial in range(60):
        percent, base = int(r.choice([60, 80, 90])), r.integers(0, 2**63, int(r.integers(1, 120)), dtype=np.uint64)
        sets = []
        for _ in range(int(r.integers(2, 25))):
            own = r.random() < 0.6
            x = np.concatenate([base[: int(r.integers(1, len(base) + 1))] if own else base[:1], r.integers(0, 2**63, int(r.integers(0, 20 if own else 150)), dtype=np.uint64)])
            sets.append(np.unique(x))
        first = np.append(0, np.cumsum([len(x) for x in sets]))
        open_ = jaccard_join.may_link(np.diff(first), jaccard_join.sketch(np.concatenate(sets), first), percent)
        for i, x in enumerate(sets):
            links = any(100 * len(np.intersect1d(x, y)) >= percent * len(np.union1d(x, y)) for j, y in enumerate(sets) if j != i)
            assert open_[i] or not links
            kept, linked, total = kept + open_[i], linked + links, total + 1
    assert 20 < linked <= kept < total / 2
