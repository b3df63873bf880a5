"""Boxes of all sizes, gathered gradients, sparse assignment and morphology on runs, against brute force."""

import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from tesserae.operators import images as G, masks as M, spatial as B

NAN, INF = float("nan"), float("inf")


@pytest.mark.parametrize("per_key", [100_000, 7])
def test_boxes_of_all_sizes(spark, monkeypatch, per_key):
    monkeypatch.setattr(B, "PER_KEY", per_key)
    rng = random.Random(6)

    def some(n, sizes):
        out = []
        for i in range(n):
            x, y = rng.choice([16.0, rng.uniform(-200, 200)]), rng.uniform(-200, 200)
            out.append((i, x, y, x + rng.choice(sizes), y + rng.choice(sizes)))
        return out

    tiles = some(40, [0.0, 5.0, 64.0, 300.0]) + [(100, 5.0, 5.0, 1.0, 9.0), (101, NAN, 0.0, 9.0, 9.0), (102, None, 0.0, 9.0, 9.0)]
    # A third of the boxes sits in one place; some are larger than everything else.
    boxes = some(120, [0.0, 1.0, 33.0, 1000.0]) + [(200 + i, 3.0, 3.0, 4.0 + i % 5, 4.0) for i in range(60)] + [(300, 3.0, 0.0, INF, 9.0), (301, 9.0, 9.0, 2.0, 2.0)]
    t = spark.createDataFrame(tiles, "tile int, x0 double, y0 double, x1 double, y1 double")
    b = spark.createDataFrame(boxes, "box int, xmin double, ymin double, xmax double, ymax double")
    fine = lambda r: all(v is not None and math.isfinite(v) for v in r)
    want = sorted((t[0], b[0]) for t in tiles for b in boxes if fine(t) and fine(b) and b[3] > t[1] and b[1] < t[3] and b[4] > t[2] and b[2] < t[4])
    got = B.box_join(t, b, [], 8.0)
    assert sorted((r.tile, r.box) for r in got.collect()) == want
    assert got.columns == [*t.columns, *b.columns]
    slides = [df.withColumn("slide", F.col(c) % 2) for df, c in ((t, "tile"), (b, "box"))]
    assert sorted((r.tile, r.box) for r in B.box_join(*slides, ["slide"], 8.0).collect()) == [(a, c) for a, c in want if a % 2 == c % 2]
    assert B.box_join(t.where("tile < 0"), b, [], 8.0).count() == B.box_join(t, b.where("box < 0"), [], 8.0).count() == 0


def _plan(df):
    df.collect()
    return df._jdf.queryExecution().executedPlan().toString()


def test_box_join_broadcasts_tiles_by_their_rows_in_cells(spark):
    boxes = spark.range(300).selectExpr("id as box", "id * 10.0 as xmin", "0.0 as ymin", "id * 10.0 + 4 as xmax", "4.0 as ymax")
    # 150,000 tiles, of which 30 lie where the boxes are: they go to every task, and no box is shuffled.
    far = spark.range(150_000).selectExpr("id as tile", "id * 100.0 as x0", "0.0 as y0", "id * 100.0 + 100 as x1", "9.0 as y1")
    held = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        pairs = B.box_join(far, boxes, [], 100.0)
        plan = _plan(pairs)
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", held)
    assert sorted((r.tile, r.box) for r in pairs.collect()) == [(b // 10, b) for b in range(300)]
    assert "SortMergeJoin" not in plan and "hashpartitioning" not in plan.split("Subquery")[0]
    # 150,000 tiles where boxes are: none are broadcast, though Spark takes their table for small.
    near = far.selectExpr("tile", "cast(tile % 300 as double) * 10 as x0", "y0", "cast(tile % 300 as double) * 10 + 4 as x1", "y1")
    pairs = B.box_join(near, boxes, [], 100.0)
    assert "SortMergeJoin" in _plan(pairs)
    assert pairs.count() == pairs.where("tile % 300 = box").count() == 150_000


@pytest.mark.parametrize("per_key", [100_000, 7])
def test_boxes_of_all_sizes_shuffled(spark, monkeypatch, per_key):
    monkeypatch.setattr(B, "BROADCAST_ROWS", 0)
    test_boxes_of_all_sizes(spark, monkeypatch, per_key)


def test_mapping_coverage_shuffles_a_box_once(spark):
    """70 modes, more than a number has bits; every box meets every mode with an odd number in two tiles."""
    tiles = spark.range(140).selectExpr("id as tile", "concat('m', id % 70) as mode")
    boxes = spark.range(1000).selectExpr("id as box").unionByName(spark.createDataFrame([(None,)], "box bigint"))
    pairs = tiles.crossJoin(boxes).where("cast(substr(mode, 2) as int) % 2 = 1 and (mode <> 'm69' or box < 10)")
    got = B.mapping_coverage(pairs.coalesce(1), boxes, tiles, "mode", "tile", "box")
    rows = got.collect()
    assert [(r.mode, r.tiles_with_cells, r.cells_mapped) for r in rows if r.cells_mapped < 1000] == [("m69", 2, 10)] + sorted((f"m{i}", 0, 0) for i in range(0, 70, 2))
    assert len(rows) == 70 and all(r.tiles_with_cells == 2 and r.coverage == 1000 / 1001 for r in rows if r.cells_mapped == 1000)
    assert "Expand" not in got._jdf.queryExecution().executedPlan().toString()


@pytest.mark.parametrize("by_span", [False, True])
def test_edge_scores_against_brute_force(spark, by_span):
    rng = random.Random(8)
    spans, shifts, stride = [20.0, 26.0], [-6.0, -3.0, 0.0, 3.0, 6.0], 2
    cands = [(i, s, x, y) for i, (s, x, y) in enumerate((s, x, y) for s in spans for x in shifts for y in shifts)]
    patches = [(0, 0.0, 0.0, 20, 18), (1, 100.0, 50.0, 5, 33), (2, 0.0, 0.0, 9, 9)]
    grad = {(p, r, c): rng.choice([None, rng.random(), rng.random()]) for p, _, _, w, h in patches[:2] for r in range(h) for c in range(w) if rng.random() < 0.9}
    points = []
    for p, x0, y0, w, h in patches:
        for contour in range(12):
            cx, cy, n = x0 + rng.uniform(-15, w + 15), y0 + rng.uniform(-15, h + 15), rng.choice([1, 6])
            points += [(p, rng.choice(spans), contour, o, n, cx + rng.uniform(-3, 3), cy + rng.uniform(-3, 3)) for o in range(n)]
    points += [(0, 20.0, None, 0, 6, 3.0, 3.0), (0, 20.0, 50, 0, 6, NAN, 3.0), (0, 20.0, 51, 0, 6, None, 3.0), (7, 20.0, 0, 0, 6, 3.0, 3.0)]
    want = {}
    for p in {q[0] for q in points if q[4] >= 2}:
        for i, s, sx, sy in cands:
            seen, kept = [], set()
            for q, span, contour, o, n, x, y in points:
                box = next((b for b in patches if b[0] == p), None)
                if q != p or n < 2 or box is None or x is None or (by_span and span != s):
                    continue
                px, py = (x - box[1]) * (box[3] / s) + sx, (y - box[2]) * (box[4] / s) + sy
                if -1 <= px <= box[3] and -1 <= py <= box[4]:
                    kept |= {contour} - {None}
                    g = grad.get((p, round(py), round(px))) if o % stride == 0 else None
                    seen += [g] if g is not None else []
            want[p, i] = (s, sx, sy, sum(seen) / len(seen) if seen else -INF, len(kept))
    pts = spark.createDataFrame(points, "patch int, span double, contour int, ordinal int, n_points int, x double, y double")
    got = B.edge_scores(
        spark.createDataFrame(patches, "patch int, x0 double, y0 double, width int, height int"), pts if by_span else pts.drop("span"),
        spark.createDataFrame([(*k, v) for k, v in grad.items()], "patch int, row int, col int, gradient double"), "patch", B.candidates(spans, -6, 6, 3), stride, side=8,
    ).collect()
    assert len(got) == len(want) and len({r["score"] for r in got}) > 20
    for r in got:
        w = want[r["patch"], r["candidate"]]
        assert (r["span"], r["shift_x"], r["shift_y"], r["kept"]) == (*w[:3], w[4])
        assert r["score"] == pytest.approx(w[3])


def best_total(weights, n_right):
    """Largest total by subsets of the right side."""
    best = {0: 0.0}
    for row in weights:
        new = dict(best)
        for used, total in best.items():
            for j, w in row:
                if not used >> j & 1:
                    new[used | 1 << j] = max(new.get(used | 1 << j, 0.0), total + w)
        best = new
    return max(best.values())


def test_sparse_assignment_against_subsets():
    rng = random.Random(9)
    for case in range(500):
        n, m = rng.randint(1, 7), rng.randint(1, 7)
        weight = (lambda: rng.randint(0, 3) / 4) if case % 2 else rng.random  # ties in every other case
        links = [[(j, weight()) for j in range(m) if rng.random() < 0.6] for _ in range(n)]
        got = M.best_assignment(links)
        used = [j for j in got if j >= 0]
        assert len(used) == len(set(used)) and all(j < 0 or j in dict(links[i]) for i, j in enumerate(got))
        assert sum(dict(links[i])[j] for i, j in enumerate(got) if j >= 0) == pytest.approx(best_total(links, m))
    # A chain of ten thousand objects: memory follows its links.
    chain = [[(i, 0.4), (i + 1, 0.3)] for i in range(10_000)]
    assert M.best_assignment(chain) == list(range(10_000))


def test_matching_settles_most_pairs_by_windows(spark):
    rng, rows = random.Random(10), []
    for image in range(300):
        n, m = rng.randint(1, 4), rng.randint(1, 4)
        inter = [[rng.choice([0, rng.randint(1, 3), rng.randint(1, 60)]) for _ in range(m)] for _ in range(n)]
        a, b = [sum(x) + 1 for x in inter], [sum(x[j] for x in inter) + 1 for j in range(m)]
        rows += [(image, i, j, inter[i][j] / (a[i] + b[j] - inter[i][j])) for i in range(n) for j in range(m) if inter[i][j]]
    df = spark.createDataFrame(rows, "image int, gt_label int, pred_label int, iou double")
    got = M.match_instances(df, ["image"], 1e-9).collect()
    per = {}
    for i, g, p, w in rows:
        per.setdefault(i, {}).setdefault(g, []).append((p, w))
    for i, links in per.items():
        mine = [r for r in got if r["image"] == i]
        assert len({r["gt_label"] for r in mine}) == len({r["pred_label"] for r in mine}) == len(mine)
        assert sum(r["iou"] for r in mine) == pytest.approx(best_total(list(links.values()), 4))
    assert M.match_instances(df.where("image < 0"), ["image"]).count() == 0


@pytest.mark.parametrize("ksize", [3, 5])
def test_morphology_on_runs(spark, ksize):
    rng, reach = np.random.default_rng(ksize), ksize // 2
    shapes = [(1, 1), (2, 9), (30, 24), (17, 40)]
    masks = [rng.random(s) < d for s, d in zip(shapes, (1.0, 0.9, 0.93, 0.85))] + [np.ones((6, 6), bool), np.zeros((5, 5), bool)]

    def window(m, take):
        h, w = m.shape
        return np.array([[take(m[max(r - reach, 0) : r + reach + 1, max(c - reach, 0) : c + reach + 1]) for c in range(w)] for r in range(h)])

    want = set()
    for i, m in enumerate(masks):
        for take in (np.min, np.max, np.max, np.min):
            m = window(m, take)
        want |= {(i, int(r), int(c)) for r, c in zip(*np.nonzero(m))}
    rows = [(i, r, c, int(m[r, c])) for i, m in enumerate(masks) for r in range(m.shape[0]) for c in range(m.shape[1])]
    mask = spark.createDataFrame(rows, "image int, row int, col int, label int")
    sizes = spark.createDataFrame([(i, *m.shape) for i, m in enumerate(masks)], "image int, height int, width int")
    got = [(r["image"], r["row"], r["col"]) for r in G.open_close(mask, sizes, ["image"], ksize).collect()]
    assert len(got) == len(set(got)) and set(got) == want
    assert G.open_close(mask.where("label > 1"), sizes, ["image"], ksize).count() == 0
