"""Evaluation of label masks given as tables.

A mask is a long table (keys, row, col, label), background 0, or its run-length form
(keys, row, c0, c1, label) with c1 exclusive. Background never enters a join; true negatives are
derived from the image size.
"""

from __future__ import annotations

import heapq
import math
from collections.abc import Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window, functions as F

from ..functions.scalars import safe_divide
from ..session import materialise
from .components import connected_components
from .spread import spread_join

# A pair above this IoU is in every assignment of largest total IoU between non-overlapping labels.
SURE_IOU = (math.sqrt(17.0) - 3.0) / 2.0


def foreground(mask: DataFrame) -> DataFrame:
    return mask.where(F.col("label") > 0)


def to_runs(mask: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Horizontal runs of equal foreground label."""
    w = Window.partitionBy(*keys, "row").orderBy("col")
    fg = foreground(mask).select(*keys, "row", "col", "label")
    start = (F.lag("col").over(w) + 1 != F.col("col")) | (F.lag("label").over(w) != F.col("label"))
    marked = fg.withColumn("_s", F.coalesce(start, F.lit(True)).cast("int"))
    numbered = marked.withColumn("_r", F.sum("_s").over(w.rowsBetween(Window.unboundedPreceding, 0)))
    return numbered.groupBy(*keys, "row", "_r", "label").agg(
        F.min("col").alias("c0"), (F.max("col") + 1).alias("c1")
    ).drop("_r")


def pixel_overlap(truth: DataFrame, pred: DataFrame, image: str, model: str) -> DataFrame:
    """Shared pixels of every overlapping (truth label, predicted label) pair."""
    t = foreground(truth).select(image, "row", "col", F.col("label").alias("gt_label"))
    p = foreground(pred).select(image, model, "row", "col", F.col("label").alias("pred_label"))
    return t.join(p, [image, "row", "col"]).groupBy(image, model, "gt_label", "pred_label").agg(F.count(F.lit(1)).alias("intersection"))


def run_overlap(truth: DataFrame, pred: DataFrame, image: str, model: str, span: int = 256) -> DataFrame:
    """The same from runs. Runs are cut at column multiples of `span`, so a join key holds few runs."""

    def cut(runs: DataFrame) -> DataFrame:
        bins = F.explode(F.sequence(F.floor(F.col("c0") / span), F.floor((F.col("c1") - 1) / span)))
        return runs.withColumn("_bin", bins).withColumn("c0", F.greatest("c0", F.col("_bin") * span)).withColumn(
            "c1", F.least("c1", (F.col("_bin") + 1) * span)
        )

    t = cut(truth).select(image, "row", "_bin", F.col("c0").alias("t0"), F.col("c1").alias("t1"), F.col("label").alias("gt_label"))
    p = cut(pred).select(image, model, "row", "_bin", F.col("c0").alias("p0"), F.col("c1").alias("p1"), F.col("label").alias("pred_label"))
    shared = F.least("t1", "p1") - F.greatest("t0", "p0")
    return (
        t.join(p, [image, "row", "_bin"])
        .where((F.col("t0") < F.col("p1")) & (F.col("p0") < F.col("t1")))
        .groupBy(image, model, "gt_label", "pred_label")
        .agg(F.sum(shared).cast("bigint").alias("intersection"))
    )


def instance_sizes(mask: DataFrame, keys: Sequence[str]) -> DataFrame:
    return foreground(mask).groupBy(*keys, "label").agg(F.count(F.lit(1)).alias("area"))


def instance_counts(sizes: DataFrame, keys: Sequence[str]) -> DataFrame:
    return sizes.groupBy(*keys).agg(F.count(F.lit(1)).alias("n_instances"))


def iou_table(overlap: DataFrame, gt_sizes: DataFrame, pred_sizes: DataFrame, image: str, model: str) -> DataFrame:
    g = gt_sizes.select(image, F.col("label").alias("gt_label"), F.col("area").alias("gt_area"))
    p = pred_sizes.select(image, model, F.col("label").alias("pred_label"), F.col("area").alias("pred_area"))
    both = overlap.join(g, [image, "gt_label"]).join(p, [image, model, "pred_label"])
    return both.select(
        image, model, "gt_label", "pred_label", "intersection",
        (F.col("intersection") / (F.col("gt_area") + F.col("pred_area") - F.col("intersection"))).alias("iou"),
    )


def pixel_confusion(images: DataFrame, truth: DataFrame, pred: DataFrame, image: str, model: str) -> DataFrame:
    """tp, tn, fp, fn, precision, recall, f1, dice per (image, model) listed in `images(height, width)`."""
    t = foreground(truth).select(image, "row", "col", F.lit(1).alias("_t"))
    p = foreground(pred).select(image, model, "row", "col")
    hits = p.join(t, [image, "row", "col"], "left").groupBy(image, model).agg(
        F.count("_t").alias("pixel_tp"), F.count(F.lit(1)).alias("_pred")
    )
    gt = t.groupBy(image).agg(F.count(F.lit(1)).alias("_gt"))
    return _confusion(images.join(hits, [image, model], "left").join(gt, image, "left"), image, model)


def confusion_of_overlaps(images: DataFrame, overlap: DataFrame, gt_sizes: DataFrame, pred_sizes: DataFrame, image: str, model: str) -> DataFrame:
    """`pixel_confusion` from the overlap table and the instance sizes: no second join of pixels."""
    tp = overlap.groupBy(image, model).agg(F.sum("intersection").alias("pixel_tp"))
    said = pred_sizes.groupBy(image, model).agg(F.sum("area").alias("_pred"))
    held = gt_sizes.groupBy(image).agg(F.sum("area").alias("_gt"))
    return _confusion(images.join(tp, [image, model], "left").join(said, [image, model], "left").join(held, image, "left"), image, model)


def _confusion(counted: DataFrame, image: str, model: str) -> DataFrame:
    j = counted.na.fill(0, ["pixel_tp", "_pred", "_gt"])
    tp, fp, fn = F.col("pixel_tp"), F.col("_pred") - F.col("pixel_tp"), F.col("_gt") - F.col("pixel_tp")
    counts = j.select(
        image, model, "pixel_tp",
        (F.col("height").cast("bigint") * F.col("width") - tp - fp - fn).alias("pixel_tn"),
        fp.alias("pixel_fp"),
        fn.alias("pixel_fn"),
    )
    return counts.withColumns(pixel_ratios())


def pixel_ratios() -> dict[str, Column]:
    tp, fp, fn = F.col("pixel_tp"), F.col("pixel_fp"), F.col("pixel_fn")
    dice = safe_divide(2 * tp, 2 * tp + fp + fn)
    return {
        "pixel_precision": safe_divide(tp, tp + fp),
        "pixel_recall": safe_divide(tp, tp + fn),
        "pixel_f1": dice,
        "pixel_dice": dice,
    }


def best_assignment(links: Sequence[Sequence[tuple[int, float]]]) -> list[int]:
    """Largest total weight of a one-to-one choice: the right node of each left node, -1 for none.

    `links[i]` lists (right node, weight >= 0) of left node i. Shortest augmenting paths with prices over these lists,
    so memory follows the number of links; a private link of weight 0 stands for leaving a node alone.
    """
    owner: dict[int, int] = {}
    price: dict[int, float] = {}
    gain, match = [0.0] * len(links), [0] * len(links)
    lists = []
    for i, own in enumerate(links):
        top = max((w for _, w in own), default=0.0)
        lists.append([(j, top - w) for j, w in own] + [(-1 - i, top)])
    for start in range(len(lists)):
        dist: dict[int, float] = {}
        back: dict[int, int] = {}
        done: dict[int, float] = {}
        heap: list[tuple[float, int]] = []
        i, base = start, 0.0
        while True:
            for j, cost in lists[i]:
                d = base + cost - gain[i] - price.get(j, 0.0)
                if j not in done and d < dist.get(j, math.inf):
                    dist[j], back[j] = d, i
                    heapq.heappush(heap, (d, j))
            base, j = heapq.heappop(heap)
            while j in done:
                base, j = heapq.heappop(heap)
            if j not in owner:
                break
            done[j] = base
            i = owner[j]
        gain[start] += base
        for k, d in done.items():
            gain[owner[k]] += base - d
            price[k] = price.get(k, 0.0) - (base - d)
        while True:
            i = back[j]
            match[i], owner[j], j = j, i, match[i]
            if i == start:
                break
    return [j if j >= 0 else -1 for j in match]


def _assigner(columns: Sequence[str]):
    """mapInPandas body over rows sorted by component: largest total IoU inside each component.

    Batches are cut at component borders; only the last, possibly unfinished component is carried over.
    """
    columns = list(columns)

    def picked(pdf: pd.DataFrame) -> pd.DataFrame:
        names = pdf["_c"].to_numpy()
        starts = np.flatnonzero(np.r_[True, names[1:] != names[:-1]])
        gt, pr, iou = (pdf[c].to_numpy() for c in ("gt_label", "pred_label", "iou"))
        keep = []
        for lo, hi in zip(starts, np.r_[starts[1:], len(pdf)]):
            g, gi = np.unique(gt[lo:hi], return_inverse=True)
            pi = np.unique(pr[lo:hi], return_inverse=True)[1]
            line = {(a, b): at for a, b, at in zip(gi.tolist(), pi.tolist(), range(lo, hi))}
            links: list[list[tuple[int, float]]] = [[] for _ in g]
            for (a, b), at in sorted(line.items()):
                links[a].append((b, float(iou[at])))
            keep += [line[a, b] for a, b in enumerate(best_assignment(links)) if b >= 0]
        return pdf.iloc[keep][columns]

    def run(batches):
        rest = None
        for pdf in batches:
            pdf = pdf if rest is None else pd.concat([rest, pdf], ignore_index=True)
            names = pdf["_c"].to_numpy()
            cut = int(np.searchsorted(names == names[-1], True)) if len(pdf) else 0
            rest = pdf.iloc[cut:].reset_index(drop=True)
            if cut:
                yield picked(pdf.iloc[:cut])
        if rest is not None and len(rest):
            yield picked(rest)

    return run


def match_instances(iou: DataFrame, keys: Sequence[str], threshold: float = 0.5) -> DataFrame:
    """One-to-one pairs maximising total IoU over all pairs, then only those at or above the threshold.

    A pair is in every best assignment when it exceeds SURE_IOU, or the sum of the best other pair of either of its
    objects, which is all that taking it can cost. Such pairs are settled by windows over the objects' own pairs.
    Pairs whose objects are both still free split into connected components, solved one by one.
    """
    if threshold <= 0:
        raise ValueError("threshold must be positive")
    keys = list(keys)
    cols = [*keys, "gt_label", "pred_label", "iou"]
    value = F.col("iou")

    def other(label: str) -> Column:
        order = Window.partitionBy(*keys, label).orderBy(F.desc("iou"), "gt_label", "pred_label")
        whole = order.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
        best = F.when(F.row_number().over(order) > 1, F.first("iou").over(whole)).otherwise(F.nth_value("iou", 2).over(whole))
        return F.coalesce(best, F.lit(0.0))

    ranked = iou.select(*cols).where(value > 0).withColumn("_g", other("gt_label")).withColumn("_p", other("pred_label"))
    settled = ranked.withColumn("_sure", (value > SURE_IOU) | (value > F.col("_g") + F.col("_p")))
    for name, label in (("_tp", "pred_label"), ("_tg", "gt_label")):
        settled = settled.withColumn(name, F.max("_sure").over(Window.partitionBy(*keys, label)))
    # Read by the settled and the open pairs: written once to the shared folder rather than recomputed.
    marked = materialise(settled.select(*cols, "_sure", (F.col("_tg") | F.col("_tp")).alias("_taken")))
    sure = marked.where("_sure").select(*cols)
    gt_node = F.struct(*keys, F.lit(0).alias("side"), F.col("gt_label").cast("bigint").alias("label"))
    pred_node = F.struct(*keys, F.lit(1).alias("side"), F.col("pred_label").cast("bigint").alias("label"))
    linked = marked.where(~F.col("_taken")).select(*cols, gt_node.alias("u"), pred_node.alias("v"))
    comps = connected_components(linked.select("u"), linked.select("u", "v"))
    types = dict(iou.dtypes)
    schema = ", ".join(f"`{c}` {types[c]}" for c in cols)
    tangled = linked.join(comps, "u").select(*cols, F.to_json("component").alias("_c"))
    solved = tangled.repartition("_c").sortWithinPartitions("_c").mapInPandas(_assigner(cols), schema)
    return sure.unionByName(solved).where(value >= threshold)


def unmatched(sizes: DataFrame, pairs: DataFrame, keys: Sequence[str], label: str) -> DataFrame:
    """Instances without an accepted pair; `label` is gt_label or pred_label."""
    return sizes.withColumnRenamed("label", label).join(pairs.select(*keys, label), [*keys, label], "left_anti").select(*keys, label)


def instance_metrics(images: DataFrame, gt_sizes: DataFrame, pred_sizes: DataFrame, pairs: DataFrame, image: str, model: str) -> DataFrame:
    """tp, fp, fn, object precision and recall, RQ, SQ, PQ per (image, model); empty images give zeros."""
    hit = pairs.groupBy(image, model).agg(F.count(F.lit(1)).alias("instance_tp"), F.sum("iou").alias("_iou"))
    n_gt = gt_sizes.groupBy(image).agg(F.count(F.lit(1)).alias("_g"))
    n_pred = pred_sizes.groupBy(image, model).agg(F.count(F.lit(1)).alias("_p"))
    j = (
        images.select(image, model)
        .join(hit, [image, model], "left").join(n_pred, [image, model], "left").join(n_gt, image, "left")
        .na.fill(0, ["instance_tp", "_g", "_p"]).na.fill(0.0, ["_iou"])
    )
    tp, fp, fn = F.col("instance_tp"), F.col("_p") - F.col("instance_tp"), F.col("_g") - F.col("instance_tp")
    den = tp + fp * 0.5 + fn * 0.5
    return j.select(
        image, model, "instance_tp", fp.alias("instance_fp"), fn.alias("instance_fn"),
        safe_divide(tp, tp + fp).alias("instance_object_precision"),
        safe_divide(tp, tp + fn).alias("instance_object_recall"),
        safe_divide(tp, den).alias("instance_rq"),
        safe_divide("_iou", tp).alias("instance_sq"),
        safe_divide("_iou", den).alias("instance_pq"),
    )


def evaluate(images: DataFrame, truth: DataFrame, pred: DataFrame, image: str = "image_id", model: str = "model_name", threshold: float = 0.5) -> DataFrame:
    """Pixel and instance metrics of every (image, model) in one plan."""
    gt_sizes, pred_sizes = instance_sizes(truth, [image]), instance_sizes(pred, [image, model])
    # Pixels meet once: the table of overlaps is written and read by both halves.
    overlap = materialise(pixel_overlap(truth, pred, image, model))
    pairs = match_instances(iou_table(overlap, gt_sizes, pred_sizes, image, model), [image, model], threshold)
    return confusion_of_overlaps(images, overlap, gt_sizes, pred_sizes, image, model).join(
        instance_metrics(images, gt_sizes, pred_sizes, pairs, image, model), [image, model]
    )


def evaluation_status(images: DataFrame, truth_images: DataFrame, pred_images: DataFrame, image: str, model: str) -> DataFrame:
    """ok, missing_ground_truth, missing_prediction or shape_mismatch for every expected (image, model)."""
    t = truth_images.select(image, F.col("height").alias("_th"), F.col("width").alias("_tw"))
    p = pred_images.select(image, model, F.col("height").alias("_ph"), F.col("width").alias("_pw"))
    j = images.select(image, model).join(t, image, "left").join(p, [image, model], "left")
    return j.select(
        image, model,
        F.when(F.col("_th").isNull(), "missing_ground_truth")
        .when(F.col("_ph").isNull(), "missing_prediction")
        .when((F.col("_th") != F.col("_ph")) | (F.col("_tw") != F.col("_pw")), "shape_mismatch")
        .otherwise("ok").alias("status"),
    )


def status_summary(status: DataFrame, model: str) -> DataFrame:
    return status.groupBy(model).agg(
        F.count(F.lit(1)).alias("n_rows"), F.count_if(F.col("status") == "ok").alias("n_ok"), F.count_if(F.col("status") != "ok").alias("n_error")
    )


def value_check(mask: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Per mask: are all labels finite, whole and non-negative."""
    v = F.col("label").cast("double")
    finite = ~F.isnan(v) & (F.abs(v) < float("inf"))
    return mask.groupBy(*keys).agg(
        F.bool_and(F.coalesce(finite, F.lit(False))).alias("finite"),
        F.bool_and(F.coalesce(v == F.floor(v), F.lit(False))).alias("whole"),
        F.bool_and(F.coalesce(v >= 0, F.lit(False))).alias("non_negative"),
    )


def channel_check(pixels: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Can a colour mask be reduced to one channel: equal channels, constant alpha."""
    return pixels.groupBy(*keys).agg(
        F.bool_and((F.col("r") == F.col("g")) & (F.col("g") == F.col("b"))).alias("replicated"),
        (F.min("a") == F.max("a")).alias("constant_alpha"),
    ).withColumn("reducible", F.col("replicated") & F.col("constant_alpha"))


def label_components(mask: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Masks with at most one positive label become 8-connected components numbered in scan order; others stay.

    Vertices are horizontal runs, edges join touching runs of neighbouring rows.
    """
    keys = list(keys)
    fg = foreground(mask)
    plural = fg.groupBy(*keys).agg((F.min("label") != F.max("label")).alias("_many"))
    flagged = spread_join(fg, plural, keys)
    kept = flagged.where("_many").select(*keys, "row", "col", F.col("label").cast("bigint").alias("label"))
    single = flagged.where(~F.col("_many")).withColumn("label", F.lit(1))
    runs = to_runs(single.select(*keys, "row", "col", "label"), keys)
    span = 256
    # A run may touch up to one column beyond its ends, so both sides are binned with that margin.
    up = runs.select(*keys, "row", F.col("c0").alias("a0"), F.col("c1").alias("a1")).withColumn(
        "_bin", F.explode(F.sequence(F.floor((F.col("a0") - 1) / span), F.floor(F.col("a1") / span)))
    )
    down = runs.select(*keys, (F.col("row") - 1).alias("row"), F.col("c0").alias("b0"), F.col("c1").alias("b1")).withColumn(
        "_bin", F.explode(F.sequence(F.floor(F.col("b0") / span), F.floor((F.col("b1") - 1) / span)))
    )
    touch = up.join(down, [*keys, "row", "_bin"]).where((F.col("a0") <= F.col("b1")) & (F.col("b0") <= F.col("a1")))
    node = lambda row, c: F.struct(*keys, row.cast("bigint").alias("row"), c.cast("bigint").alias("col"))
    edges = touch.select(node(F.col("row"), F.col("a0")).alias("u"), node(F.col("row") + 1, F.col("b0")).alias("v"))
    placed = runs.select("*", node(F.col("row"), F.col("c0")).alias("u"))
    comps = connected_components(placed.select("u"), edges)
    firsts = comps.select("component").distinct().select(*[F.col(f"component.{k}").alias(k) for k in keys], "component")
    numbered = firsts.withColumn("label", F.row_number().over(Window.partitionBy(*keys).orderBy("component")).cast("bigint"))
    labelled = placed.join(comps, "u").join(numbered.select("component", "label").withColumnRenamed("label", "_l"), "component")
    pixels = labelled.select(*keys, "row", F.explode(F.sequence(F.col("c0"), F.col("c1") - 1)).alias("col"), F.col("_l").alias("label"))
    return kept.unionByName(pixels)
