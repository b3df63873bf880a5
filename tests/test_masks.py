"""Literal mask cases, brute-force checks and invariants of the mask operators."""

import itertools
import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from tesserae.operators import images as G, masks as M, shape as S

ID = "image_id"


def pixels(text, image=0):
    return [(image, r, c, int(v)) for r, line in enumerate(text.split("/")) for c, v in enumerate(line.split())]


def table(spark, rows, model=None):
    df = spark.createDataFrame(rows, "image_id int, row int, col int, label int")
    return df.withColumn("model_name", F.lit(model)) if model else df


PIXEL_CASES = {
    "perfect": ("0 1 / 1 0", "0 5 / 9 0", (2, 2, 0, 0), (1, 1, 1)),
    "partial": ("1 1 / 0 0", "1 0 / 1 0", (1, 1, 1, 1), (0.5, 0.5, 0.5)),
    "empty prediction": ("1 0 / 1 0", "0 0 / 0 0", (0, 2, 0, 2), (0, 0, 0)),
    "empty truth": ("0 0 / 0 0", "1 0 / 1 0", (0, 2, 2, 0), (0, 0, 0)),
    "both empty": ("0 0 0 / 0 0 0", "0 0 0 / 0 0 0", (0, 6, 0, 0), (0, 0, 0)),
}

INSTANCE_CASES = {
    # truth, prediction, pairs, tp fp fn, rq sq pq
    "perfect": ("0 1 1 / 0 1 1 / 0 0 0", "0 9 9 / 0 9 9 / 0 0 0", {(1, 9): 1.0}, (1, 0, 0), (1, 1, 1)),
    "one against two": ("1 1 0 / 1 1 0", "10 20 0 / 10 0 0", {(1, 10): 0.5}, (1, 1, 0), (2 / 3, 0.5, 1 / 3)),
    "background only": ("0 0 / 0 0", "0 0 / 0 0", {}, (0, 0, 0), (0, 0, 0)),
    "missed": ("1 1 / 0 0", "0 0 / 0 0", {}, (0, 0, 1), (0, 0, 0)),
    "extra": ("0 0 / 0 0", "7 7 / 0 0", {}, (0, 1, 0), (0, 0, 0)),
    "imperfect overlap": ("1 1 0 2 / 1 1 0 2", "5 5 0 6 / 5 0 0 6", {(1, 5): 0.75, (2, 6): 1.0}, (2, 0, 0), (1, 0.875, 0.875)),
}


def build(spark, cases):
    names = list(cases)
    truth, pred, sizes = [], [], []
    for i, n in enumerate(names):
        truth += pixels(cases[n][0], i)
        pred += pixels(cases[n][1], i)
        lines = cases[n][0].split("/")
        sizes.append((i, "m", len(lines), len(lines[0].split())))
    images = spark.createDataFrame(sizes, "image_id int, model_name string, height int, width int")
    return names, table(spark, truth), table(spark, pred, "m"), images


def test_pixel_cases(spark):
    names, truth, pred, images = build(spark, PIXEL_CASES)
    for r in M.pixel_confusion(images, truth, pred, ID, "model_name").collect():
        _, _, counts, ratios = PIXEL_CASES[names[r[ID]]]
        assert (r.pixel_tp, r.pixel_tn, r.pixel_fp, r.pixel_fn) == counts
        assert (r.pixel_precision, r.pixel_recall, r.pixel_f1) == ratios and r.pixel_dice == r.pixel_f1


def test_instance_cases(spark):
    names, truth, pred, images = build(spark, INSTANCE_CASES)
    gs, ps = M.instance_sizes(truth, [ID]), M.instance_sizes(pred, [ID, "model_name"])
    iou = M.iou_table(M.pixel_overlap(truth, pred, ID, "model_name"), gs, ps, ID, "model_name")
    pairs = M.match_instances(iou, [ID, "model_name"], 0.5)
    got = {}
    for r in pairs.collect():
        got.setdefault(names[r[ID]], {})[(r.gt_label, r.pred_label)] = r.iou
    for n in names:
        assert got.get(n, {}) == pytest.approx(INSTANCE_CASES[n][2])
    metrics = M.instance_metrics(images, gs, ps, pairs, ID, "model_name").collect()
    assert len(metrics) == len(names)
    for r in metrics:
        case = INSTANCE_CASES[names[r[ID]]]
        assert (r.instance_tp, r.instance_fp, r.instance_fn) == case[3]
        assert (r.instance_rq, r.instance_sq, r.instance_pq) == pytest.approx(case[4])
    left = {(names[r[ID]], r.pred_label) for r in M.unmatched(ps, pairs, [ID, "model_name"], "pred_label").collect()}
    assert left == {("one against two", 20), ("extra", 7)}


def iou_rows(spark, rows):
    return spark.createDataFrame(rows, "image_id int, gt_label int, pred_label int, iou double")


def matched(spark, rows, threshold=0.5):
    return {(r[ID], r.gt_label, r.pred_label) for r in M.match_instances(iou_rows(spark, rows), [ID], threshold).collect()}


def test_assignment_is_global_and_before_the_threshold(spark):
    rows = [
        (0, 1, 9, 0.7), (0, 2, 9, 0.4),  # two truths, one prediction
        (1, 1, 10, 0.90), (1, 1, 20, 0.80), (1, 2, 10, 0.85), (1, 2, 20, 0.10),  # global beats greedy; values from overlapping labels
        (2, 1, 1, 0.538), (2, 1, 2, 0.3), (2, 2, 1, 0.3),  # the anti-diagonal wins, then falls below the threshold
    ]
    assert matched(spark, [r for r in rows if r[0] != 1]) == {(0, 1, 9)}
    with pytest.raises(ValueError):
        M.match_instances(iou_rows(spark, rows), [ID], 0.0)


def test_assignment_against_brute_force(spark):
    rng, rows, want = random.Random(5), [], {}
    for image in range(60):
        # Non-overlapping labels: areas and intersections of a random partition.
        n, m = rng.randint(1, 4), rng.randint(1, 4)
        inter = [[rng.choice([0, 0, rng.randint(1, 30)]) for _ in range(m)] for _ in range(n)]
        a = [sum(x) + rng.randint(1, 10) for x in inter]
        b = [sum(inter[i][j] for i in range(n)) + rng.randint(1, 10) for j in range(m)]
        iou = [[inter[i][j] / (a[i] + b[j] - inter[i][j]) for j in range(m)] for i in range(n)]
        rows += [(image, i, j, iou[i][j]) for i in range(n) for j in range(m) if inter[i][j]]
        pad = max(n, m)
        full = [[iou[i][j] if i < n and j < m else 0.0 for j in range(pad)] for i in range(pad)]
        best = max(itertools.permutations(range(pad)), key=lambda p: sum(full[i][p[i]] for i in range(pad)))
        want[image] = round(sum(full[i][best[i]] for i in range(pad)), 9)
    got = M.match_instances(iou_rows(spark, rows), [ID], 1e-9).groupBy(ID).agg(F.sum("iou").alias("s")).collect()
    assert {r[ID]: round(r.s, 9) for r in got} == {k: v for k, v in want.items() if v > 0}


def random_masks(n, h, w, labels, seed):
    rng = np.random.default_rng(seed)
    return [rng.integers(0, labels + 1, (h, w)) * (rng.random((h, w)) < 0.6) for _ in range(n)]


def as_rows(masks):
    return [(i, r, c, int(m[r, c])) for i, m in enumerate(masks) for r in range(m.shape[0]) for c in range(m.shape[1])]


def test_runs_and_pixels_agree(spark):
    t = table(spark, as_rows(random_masks(3, 6, 40, 3, 1)))
    p = table(spark, as_rows(random_masks(3, 6, 40, 3, 2)), "m")
    want = {tuple(r) for r in M.pixel_overlap(t, p, ID, "model_name").collect()}
    runs = M.run_overlap(M.to_runs(t, [ID]), M.to_runs(p, [ID, "model_name"]), ID, "model_name", span=7)
    assert {tuple(r) for r in runs.collect()} == want


def flood(mask):
    out, n = np.zeros(mask.shape, int), 0
    for r, c in zip(*np.nonzero(mask)):
        if out[r, c]:
            continue
        n += 1
        todo = [(r, c)]
        while todo:
            y, x = todo.pop()
            if 0 <= y < mask.shape[0] and 0 <= x < mask.shape[1] and mask[y, x] and not out[y, x]:
                out[y, x] = n
                todo += [(y + dy, x + dx) for dy in (-1, 0, 1) for dx in (-1, 0, 1)]
    return out


def test_label_components(spark):
    rng = np.random.default_rng(3)
    masks = [(rng.random((9, 300)) < 0.35).astype(int) * 4 for _ in range(2)]
    spiral = np.zeros((7, 7), int)
    spiral[0, :] = spiral[:, 6] = spiral[6, :] = spiral[2:, 0] = spiral[2, :5] = spiral[2:5, 4] = 1
    masks += [spiral, np.array([[1, 2], [2, 1]])]
    got = {(r[ID], r.row, r.col): r.label for r in M.label_components(table(spark, as_rows(masks)), [ID]).collect()}
    for i, m in enumerate(masks):
        want = flood(m) if len(set(m[m > 0].tolist())) == 1 else m
        assert {k[1:]: v for k, v in got.items() if k[0] == i} == {(r, c): want[r, c] for r, c in zip(*np.nonzero(want))}


def test_shapes_of_rectangles(spark):
    m = np.zeros((10, 12), int)
    m[1:4, 2:8] = 1  # 3 x 6
    m[6:9, 1:4] = 2  # 3 x 3
    m[5, 11] = 3
    got = {r.label: r for r in S.full_features(table(spark, as_rows([m])), [ID]).collect()}
    r = got[1]
    assert (r.area_pixels, r.bbox_area, r.bbox_min_row, r.bbox_max_col) == (18, 18, 1, 8)
    assert r.solidity == 1.0 and r.extent == 1.0 and r.fill_ratio == 1.0
    assert r.major_axis_length == pytest.approx(4 * math.sqrt((36 - 1) / 12)) and r.minor_axis_length == pytest.approx(4 * math.sqrt((9 - 1) / 12))
    assert abs(r.orientation_deg) == pytest.approx(90.0)
    # Border pixel centres: 2 * (rows - 1) + 2 * (cols - 1).
    assert r.perimeter_pixels == pytest.approx(2 * 2 + 2 * 5)
    assert got[2].perimeter_pixels == pytest.approx(8.0) and got[2].eccentricity == pytest.approx(0.0)
    assert got[3].circularity is None and got[3].aspect_ratio is None and got[3].solidity == 1.0


def test_hull_of_a_corner(spark):
    m = np.zeros((6, 6), int)
    m[0, 0:5] = m[0:5, 0] = 1
    area = S.hull_areas(table(spark, as_rows([m])), [ID]).collect()[0].hull_area
    # Pixel centres within the hull of the pixel edge midpoints: the triangle r + c <= 4.5.
    assert area == sum(1 for r in range(5) for c in range(5) if r + c <= 4.5)


def box_windows(n, target):
    scale = n / target
    return [[x for x in range(n) if o * scale - 0.5 < x <= (o + 1) * scale - 0.5] for o in range(target)]


def shrink(mask, factor, fraction):
    th, tw = (max(1, round(s * factor)) for s in mask.shape)
    rows, cols = box_windows(mask.shape[0], th), box_windows(mask.shape[1], tw)
    out, best = np.zeros((th, tw), int), np.zeros((th, tw))
    for label in np.unique(mask[mask > 0]):
        b = (mask == label) * 255
        across = np.stack([np.floor(b[:, w].mean(axis=1) + 0.5) for w in cols], axis=1)
        score = np.stack([np.floor(across[w].mean(axis=0) + 0.5) for w in rows]) / 255
        better = (score >= fraction) & (score > best)
        out[better], best[better] = label, score[better]
    return out


@pytest.mark.parametrize("factor", [0.5, 0.625, 0.3])
def test_downscale_against_numpy(spark, factor):
    masks = random_masks(4, 11, 9, 2, 9)
    sizes = spark.createDataFrame([(i, 11, 9) for i in range(4)], "image_id int, height int, width int")
    got = {(r[ID], r.row, r.col): r.label for r in G.downscale_mask(table(spark, as_rows(masks)), sizes, [ID], factor, 0.4).collect()}
    want = {(i, r, c): int(s[r, c]) for i, m in enumerate(masks) for s in [shrink(m, factor, 0.4)] for r, c in zip(*np.nonzero(s))}
    assert got == want


def test_open_close_against_numpy(spark):
    rng = np.random.default_rng(11)
    masks = [(rng.random((14, 15)) < 0.8).astype(int) for _ in range(3)]

    def step(m, pick, edge):
        p = np.pad(m, 2, constant_values=edge)
        return pick([p[a : a + m.shape[0], b : b + m.shape[1]] for a in range(5) for b in range(5)], axis=0)

    sizes = spark.createDataFrame([(i, 14, 15) for i in range(3)], "image_id int, height int, width int")
    got = {(r[ID], r.row, r.col) for r in G.open_close(table(spark, as_rows(masks)), sizes, [ID], 5).collect()}
    want = set()
    for i, m in enumerate(masks):
        m = step(step(step(step(m, np.min, 1), np.max, 0), np.max, 0), np.min, 1)
        want |= {(i, r, c) for r, c in zip(*np.nonzero(m))}
    assert got == want


def test_counts_add_up(spark):
    truth = table(spark, as_rows(random_masks(5, 8, 8, 4, 21)))
    pred = table(spark, as_rows(random_masks(5, 8, 8, 4, 22)), "m")
    images = spark.createDataFrame([(i, "m", 8, 8) for i in range(5)], "image_id int, model_name string, height int, width int")
    gs = {r[ID]: r.n_instances for r in M.instance_counts(M.instance_sizes(truth, [ID]), [ID]).collect()}
    for r in M.evaluate(images, truth, pred).collect():
        assert r.instance_tp + r.instance_fn == gs[r[ID]]
        assert r.pixel_tp + r.pixel_tn + r.pixel_fp + r.pixel_fn == 64


def test_otsu_takes_the_first_of_equal_splits(spark):
    # Counts and bins are symmetric, so the splits behind the first and behind the third bin are equally good.
    rows = [(1, (1 + v) / 3) for v, n in ((0, 3), (60, 5), (83, 5), (143, 3)) for _ in range(n)]
    got = G.otsu_thresholds(spark.createDataFrame(rows, "image_id int, v double"), ID, "v").first()["threshold"]
    assert got == pytest.approx(1 / 3 + 0.5 * (143 / 3) / 256)
