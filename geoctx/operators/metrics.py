"""Classification, segmentation and depth metrics as partial aggregates plus a small final step.

Every metric first reduces its rows to a small table (class pairs, per-class areas, per-image sums)
with a map-side combined aggregate; what follows runs on that table.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

# --- fixed values ---
EPS = 1e-10
FLOAT32_EPS = 1.1920928955078125e-07
IGNORE = 255
HIGH_IOU = 0.8
LOW_F1 = 0.4
DEPTH_CROP = (45, 470, 41, 600)  # first and last row, first and last column, inclusive
# --- end of fixed values ---


def _n() -> Column:
    return F.count(F.lit(1))


# ---- classification ---------------------------------------------------------

def pair_counts(df: DataFrame, gt: str = "gt", pred: str = "pred", ignore: int = IGNORE) -> DataFrame:
    return df.where(F.col(gt) != ignore).groupBy(F.col(gt).alias("gt"), F.col(pred).alias("pred")).agg(_n().alias("n"))


def confusion_matrix(df: DataFrame, classes: int, gt: str = "gt", pred: str = "pred") -> DataFrame:
    """All ``classes`` squared cells; rows are the ground truth. Out-of-range truth is left out."""
    cells = df.sparkSession.range(classes * classes).select(
        F.floor(F.col("id") / classes).cast("int").alias("gt"), (F.col("id") % classes).cast("int").alias("pred"))
    counts = pair_counts(df, gt, pred)
    return cells.join(counts, ["gt", "pred"], "left").select("gt", "pred", F.coalesce("n", F.lit(0)).alias("n"))


def normalised_confusion(matrix: DataFrame) -> DataFrame:
    """Row percentages of a confusion matrix (a small table)."""
    w = Window.partitionBy("gt")
    return matrix.withColumn("percent", 100.0 * F.col("n") / F.sum("n").over(w))


def class_report(matrix: DataFrame, eps: float = EPS) -> DataFrame:
    """Precision, recall, F1 and support per class. ``eps`` = 0 gives 0 where a denominator is 0."""
    tp = F.sum(F.when(F.col("gt") == F.col("pred"), F.col("n")).otherwise(0))
    rows = matrix.groupBy(F.col("gt").alias("cls")).agg(tp.alias("tp"), F.sum("n").alias("support"))
    cols = matrix.groupBy(F.col("pred").alias("cls")).agg(F.sum("n").alias("predicted"))

    def ratio(a, b):
        return a / (b + eps) if eps else F.when(b == 0, 0.0).otherwise(a / b)

    out = rows.join(cols, "cls")
    out = out.withColumn("precision", ratio(F.col("tp"), F.col("predicted")))
    out = out.withColumn("recall", ratio(F.col("tp"), F.col("support")))
    both = F.col("precision") + F.col("recall")
    return out.withColumn("f1", ratio(2 * F.col("precision") * F.col("recall"), both))


def summary(report: DataFrame) -> DataFrame:
    """One row: macro and weighted figures and overall accuracy, in percent."""
    return report.agg(
        (F.avg("f1") * 100).alias("macro_f1"),
        (F.avg("precision") * 100).alias("macro_precision"),
        (F.avg("recall") * 100).alias("macro_recall"),
        (F.sum(F.col("f1") * F.col("support")) / F.sum("support") * 100).alias("weighted_f1"),
        (F.sum("tp") / F.sum("support") * 100).alias("overall_acc"),
    )


def weak_classes(report: DataFrame, limit: float = LOW_F1) -> DataFrame:
    return report.where(F.col("f1") < limit).select("cls", "f1")


def topk_accuracy(df: DataFrame, ks: Sequence[int], scores: str = "scores", gt: str = "gt",
                  thresh: float | None = None, ignore: int | None = None) -> DataFrame:
    """Percent of rows whose true class is among the k best scores (and above ``thresh``)."""
    t = df if ignore is None else df.where(F.col(gt) != ignore)
    own = F.element_at(F.col(scores), (F.col(gt) + 1).cast("int"))
    better = F.size(F.filter(F.col(scores), lambda s, i: (s > own) | ((s == own) & (i < F.col(gt)))))
    t = t.select(better.alias("rank"), own.alias("own"))
    above = F.col("own") > thresh if thresh is not None else F.lit(True)
    total = _n() + FLOAT32_EPS
    return t.agg(*[
        ((F.sum(((F.col("rank") < k) & above).cast("long")) + FLOAT32_EPS) * 100.0 / total).alias(f"top{k}") for k in ks
    ])


def weighted_mean(df: DataFrame, groups: Sequence[str], value: str, weight: str) -> DataFrame:
    return df.groupBy(*groups).agg((F.sum(F.col(value) * F.col(weight)) / F.sum(weight)).alias("mean"))


# ---- segmentation -----------------------------------------------------------

def foreground_areas(pixels: DataFrame, groups: Sequence[str] = (), ignore: int = IGNORE) -> DataFrame:
    """Intersection, union and areas of class 1; rows with ignored truth count nowhere."""
    valid = F.col("gt") != ignore
    g, p = valid & (F.col("gt") == 1), valid & (F.col("pred") == 1)

    def total(c):
        return F.sum(c.cast("long"))

    return pixels.groupBy(*groups).agg(
        total(g & p).alias("inter"), total(g | p).alias("uni"), total(p).alias("pred_area"), total(g).alias("gt_area"))


def foreground_metrics(areas: DataFrame) -> DataFrame:
    """IoU, Dice, precision and recall in percent over the summed areas (one row)."""
    t = areas.agg(*[F.sum(c).alias(c) for c in ("inter", "uni", "pred_area", "gt_area")])
    i = F.col("inter")
    return t.select(
        (i / (F.col("uni") + EPS) * 100).alias("iou"),
        (2 * i / (F.col("pred_area") + F.col("gt_area") + EPS) * 100).alias("dice"),
        (i / (F.col("pred_area") + EPS) * 100).alias("precision"),
        (i / (F.col("gt_area") + EPS) * 100).alias("recall"),
    )


def sample_iou(areas: DataFrame) -> DataFrame:
    return areas.withColumn("iou", F.col("inter") / (F.col("uni") + EPS))


def class_areas(pixels: DataFrame, classes: int, groups: Sequence[str] = (), ignore: int = IGNORE) -> DataFrame:
    """Per class: intersection, union, predicted and labelled area. Out-of-range classes drop out."""
    groups = list(groups)
    pairs = pixels.where(F.col("gt") != ignore).groupBy(*groups, "gt", "pred").agg(_n().alias("n"))
    same = F.col("gt") == F.col("pred")
    zero = F.lit(0).cast("long")
    sides = F.array(
        F.struct(F.col("gt").cast("int").alias("cls"), F.when(same, F.col("n")).otherwise(zero).alias("inter"),
                 zero.alias("pred_area"), F.col("n").alias("label_area")),
        F.struct(F.col("pred").cast("int").alias("cls"), zero.alias("inter"), F.col("n").alias("pred_area"),
                 zero.alias("label_area")),
    )
    t = pairs.select(*groups, F.explode(sides).alias("s")).select(*groups, "s.*")
    t = t.where(F.col("cls").between(0, classes - 1)).groupBy(*groups, "cls").agg(
        *[F.sum(c).alias(c) for c in ("inter", "pred_area", "label_area")])
    return t.withColumn("union_area", F.col("pred_area") + F.col("label_area") - F.col("inter"))


def class_metrics(areas: DataFrame, classes: int, beta: float = 1.0, nan_to_num: float | None = None) -> DataFrame:
    """IoU, accuracy, Dice, F score, precision, recall per class; NULL where undefined unless replaced."""
    every = areas.sparkSession.range(classes).select(F.col("id").cast("int").alias("cls"))
    t = areas.groupBy("cls").agg(*[F.sum(c).alias(c) for c in ("inter", "union_area", "pred_area", "label_area")])
    t = every.join(t, "cls", "left").na.fill(0)

    def div(a, b):
        return a / F.nullif(b, F.lit(0))

    i, u, p, g = (F.col(c) for c in ("inter", "union_area", "pred_area", "label_area"))
    prec, rec = div(i, p), div(i, g)
    b2 = beta * beta
    out = {
        "iou": div(i, u), "acc": div(i, g), "dice": div(2 * i, p + g),
        "fscore": (1 + b2) * prec * rec / F.nullif(b2 * prec + rec, F.lit(0.0)),
        "precision": prec, "recall": rec,
    }
    if nan_to_num is not None:
        out = {k: F.coalesce(v, F.lit(float(nan_to_num))) for k, v in out.items()}
    return t.select("cls", "inter", "label_area", *[v.alias(k) for k, v in out.items()])


def mean_metrics(per_class: DataFrame) -> DataFrame:
    """Means over the defined classes and overall accuracy, percent, two digits."""
    names = {"iou": "mIoU", "acc": "mAcc", "dice": "mDice", "fscore": "mFscore", "precision": "mPrecision", "recall": "mRecall"}
    return per_class.agg(
        F.round(F.sum("inter") / F.sum("label_area") * 100, 2).alias("aAcc"),
        *[F.round(F.avg(c) * 100, 2).alias(n) for c, n in names.items()],
    )


def instance_masks(pixels: DataFrame, ignore: int = IGNORE) -> DataFrame:
    """One binary mask per image and class present."""
    present = pixels.where(F.col("gt") != ignore).select("image_id", F.col("gt").alias("cls")).distinct()
    return pixels.join(present, "image_id").select(
        "image_id", "cls", "row", "col", (F.col("gt") == F.col("cls")).cast("int").alias("mask"))


# ---- depth --------------------------------------------------------------------

def depth_metrics(df: DataFrame, image: str = "image_id", gt: str = "gt", pred: str = "pred",
                  low: float = 0.0, high: float = float("inf"), crop=None) -> DataFrame:
    """Nine depth figures per image, over pixels whose true depth lies strictly between the limits."""
    g, p = F.col(gt), F.col(pred)
    t = df.where((g > low) & (g < high))
    if crop:
        r0, r1, c0, c1 = crop
        t = t.where(F.col("row").between(r0, r1) & F.col("col").between(c0, c1))
    diff, dlog = p - g, F.log(p) - F.log(g)
    worst = F.greatest(g / p, p / g)

    def within(power):
        return F.avg((worst < 1.25**power).cast("double"))

    return t.groupBy(image).agg(
        within(1).alias("d1"), within(2).alias("d2"), within(3).alias("d3"),
        F.avg(F.abs(diff) / g).alias("abs_rel"), F.avg(diff * diff / g).alias("sq_rel"),
        F.sqrt(F.avg(diff * diff)).alias("rmse"), F.sqrt(F.avg(dlog * dlog)).alias("rmse_log"),
        F.avg(F.abs(F.log10(p) - F.log10(g))).alias("log10"),
        F.sqrt(F.greatest(F.avg(dlog * dlog) - 0.5 * F.avg(dlog) * F.avg(dlog), F.lit(0.0))).alias("silog"),
    )


DEPTH_NAMES = ("d1", "d2", "d3", "abs_rel", "sq_rel", "rmse", "rmse_log", "log10", "silog")


def mean_depth_metrics(per_image: DataFrame) -> DataFrame:
    return per_image.agg(*[F.avg(c).alias(c) for c in DEPTH_NAMES])
