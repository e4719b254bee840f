"""Evaluation of a prediction run: segmentation and classification figures from two tables."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from geoctx.operators import metrics


def evaluate_run(samples: DataFrame, pixels: DataFrame, classes: int, high_iou: float = metrics.HIGH_IOU) -> dict[str, DataFrame]:
    """``samples``: image_id, gt, scores. ``pixels``: image_id, row, col, gt, pred (255 is ignored).

    Returns the tables ``segmentation``, ``classes``, ``confusion``, ``overall``, ``high_iou``, ``weak``.
    Pixels are reduced once, to one row of areas per image; everything else starts from there.
    """
    areas = metrics.sample_iou(metrics.foreground_areas(pixels, ["image_id"]))
    pred = (F.array_position("scores", F.array_max("scores")) - 1).cast("int")
    labelled = samples.select("image_id", "gt", pred.alias("pred"))
    matrix = metrics.confusion_matrix(labelled, classes)
    report = metrics.class_report(matrix)
    good = areas.where(F.col("iou") > high_iou).select("image_id")
    high = metrics.class_report(metrics.confusion_matrix(labelled.join(good, "image_id", "left_semi"), classes))
    return {
        "segmentation": metrics.foreground_metrics(areas),
        "classes": report,
        "confusion": matrix,
        "overall": metrics.summary(report),
        "high_iou": metrics.summary(high),
        "weak": metrics.weak_classes(report),
    }
