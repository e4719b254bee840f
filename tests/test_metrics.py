"""Published confusion tables, and losses and metrics against numpy."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from geoctx.operators import losses, metrics, scoring
from geoctx.plans.evaluation import evaluate_run

PUBLISHED = [  # rows are the ground truth; overall accuracy, macro F1, weighted F1 in percent
    ([[1334, 99, 167], [76, 582, 256], [169, 192, 909]], 74.66, 72.98, 74.67),
    ([[1349, 77, 174], [110, 531, 273], [185, 192, 893]], 73.28, 71.19, 73.10),
    ([[1304, 113, 183], [82, 603, 229], [153, 227, 890]], 73.92, 72.41, 74.04),
    ([[1367, 97, 136], [108, 609, 197], [209, 252, 809]], 73.60, 71.80, 73.43),
    ([[1294, 79, 227], [90, 537, 287], [157, 240, 873]], 71.46, 69.60, 71.55),
    ([[1269, 109, 222], [78, 577, 259], [157, 292, 821]], 70.48, 68.87, 70.73),
]


@pytest.mark.parametrize("table, oa, macro, weighted", PUBLISHED)
def test_published_figures(spark, table, oa, macro, weighted):
    m = spark.createDataFrame([(g, p, n) for g, row in enumerate(table) for p, n in enumerate(row)], "gt int, pred int, n long")
    s = metrics.summary(metrics.class_report(m)).first()
    assert (round(s.overall_acc, 2), round(s.macro_f1, 2), round(s.weighted_f1, 2)) == (oa, macro, weighted)


def test_per_class_figures_of_the_first_table(spark):
    m = spark.createDataFrame([(g, p, n) for g, row in enumerate(PUBLISHED[0][0]) for p, n in enumerate(row)], "gt int, pred int, n long")
    f1 = {r.cls: round(r.f1 * 100, 2) for r in metrics.class_report(m).collect()}
    assert f1 == {0: 83.93, 1: 65.14, 2: 69.87}


def test_missing_class_and_zero_division(spark):
    df = spark.createDataFrame([(0, 0), (0, 1), (255, 1)], "gt int, pred int")
    rep = {r.cls: r for r in metrics.class_report(metrics.confusion_matrix(df, 3), eps=0.0).collect()}
    assert rep[2].f1 == 0.0 and rep[0].recall == 0.5 and rep[0].support == 2


def test_undefined_classes_are_left_out_of_means(spark):
    px = spark.createDataFrame([(0, 0), (0, 1), (1, 1), (255, 0), (1, 9)], "gt int, pred int")
    per = metrics.class_metrics(metrics.class_areas(px, 4), 4)
    rows = {r.cls: r for r in per.collect()}
    assert rows[3].iou is None and rows[0].iou == pytest.approx(0.5)
    filled = metrics.class_metrics(metrics.class_areas(px, 4), 4, nan_to_num=-1.0)
    assert {r.cls: r.iou for r in filled.collect()}[3] == -1.0
    assert metrics.mean_metrics(per).first().mIoU == pytest.approx(round((0.5 + 1 / 3) / 2 * 100, 2))


def test_depth_crop_and_limits(spark):
    rows = [(1, 44, 100, 5.0, 9.0), (1, 45, 41, 5.0, 5.0), (1, 470, 600, 4.0, 5.0), (1, 100, 100, 0.0, 1.0), (1, 100, 40, 5.0, 9.0)]
    df = spark.createDataFrame(rows, "image_id long, row int, col int, gt double, pred double")
    r = metrics.depth_metrics(df, low=1e-3, high=10.0, crop=metrics.DEPTH_CROP).first()
    assert r.d1 == pytest.approx(0.5) and r.abs_rel == pytest.approx(0.125) and r.rmse == pytest.approx(np.sqrt(0.5))


def softmax(x):
    e = np.exp(x - x.max(axis=1, keepdims=True))
    return e / e.sum(axis=1, keepdims=True)


def scored(spark, n=60, classes=4, levels=None):
    rnd = np.random.default_rng(4)
    x = rnd.normal(size=(n, classes))
    if levels:
        x = np.round(x * levels) / levels  # many equal errors
    y = rnd.integers(0, classes - 1, size=n)  # the last class never occurs
    df = spark.createDataFrame([(i, int(g), [float(v) for v in r]) for i, (g, r) in enumerate(zip(y, x))], "id int, gt int, logits array<double>")
    return x, y, df.withColumn("probs", losses.softmax("logits"))


def lovasz(p, y):
    out = []
    for c in range(p.shape[1]):
        fg = (y == c).astype(float)
        if fg.sum() == 0:
            continue
        err = np.abs(fg - p[:, c])
        o = np.argsort(-err, kind="stable")
        inter, union = fg.sum() - np.cumsum(fg[o]), fg.sum() + np.cumsum(1 - fg[o])
        j = 1 - inter / union
        out.append((err[o] * np.diff(j, prepend=0)).sum())
    return np.mean(out)


@pytest.mark.parametrize("levels", [None, 1])
def test_lovasz(spark, levels):
    x, y, df = scored(spark, levels=levels)
    assert losses.lovasz_softmax(df).first().loss == pytest.approx(lovasz(softmax(x), y))


def test_cross_entropy_divisors(spark):
    x, y, df = scored(spark)
    nll = -np.log(softmax(x)[np.arange(len(y)), y])
    keep = y != 1
    assert losses.cross_entropy(df, ignore=1).first().loss == pytest.approx(nll[keep].sum() / len(y))
    assert losses.cross_entropy(df, ignore=1, avg_non_ignore=True).first().loss == pytest.approx(nll[keep].mean())
    w = np.array([1.0, 2.0, 0.5, 1.0])
    assert losses.cross_entropy(df, class_weight=w).first().loss == pytest.approx((nll * w[y]).sum() / w[y].sum())


def test_hard_examples(spark):
    x, y, df = scored(spark)
    p = softmax(x)[np.arange(len(y)), y]
    df = df.withColumn("p", losses.at("probs", "gt"))
    for kept, thresh in ((10, 0.0), (10, 0.9), (1000, 0.1)):
        t = max(np.sort(p)[min(kept, len(p) - 1)], thresh)
        assert {r.id for r in losses.hard_examples(df, "p", kept, thresh).collect()} == set(np.flatnonzero(p < t))


def test_naive_dice(spark):
    df = spark.createDataFrame([(1, 0.8, 1.0), (1, 0.3, 0.0)], "image_id int, p double, t double")
    assert losses.dice_loss(df, "image_id", naive=True).first().loss == pytest.approx(1 - (1.6 + 1e-3) / (2.1 + 1e-3))


def test_topk_threshold(spark):
    df = spark.createDataFrame([(0, [0.9, 0.1]), (1, [0.6, 0.4]), (1, [0.2, 0.8])], "gt int, scores array<double>")
    r = metrics.topk_accuracy(df, (1, 2), thresh=0.5).first()
    assert r.top1 == pytest.approx(200 / 3, abs=1e-4) and r.top2 == pytest.approx(200 / 3, abs=1e-4)


def test_metric_plugin_merges_partials(spark):
    px = spark.createDataFrame([(1, i, 0, int(i % 3 == 0), int(i % 2 == 0)) for i in range(60)], "image_id long, row int, col int, gt int, pred int")
    whole = scoring.evaluate("foreground", [px]).first()
    parts = scoring.evaluate("foreground", [px.where("row < 20"), px.where("row >= 20")]).first()
    assert whole == parts
    both = scoring.evaluate("classification", [px.where("row < 7"), px.where("row >= 7")]).first()
    assert both == scoring.evaluate("classification", [px]).first()


def test_evaluation_run(spark):
    px = spark.createDataFrame(
        [(i, r, c, 1 if r < 8 else (255 if c == 0 else 0), 1 if r < 8 + i else 0) for i in range(4) for r in range(12) for c in range(3)],
        "image_id long, row int, col int, gt int, pred int")
    s = spark.createDataFrame([(i, i % 2, [0.9, 0.1] if i != 3 else [0.8, 0.2]) for i in range(4)], "image_id long, gt int, scores array<double>")
    out = {k: [r.asDict() for r in v.collect()] for k, v in evaluate_run(s, px, 2).items()}
    ious = [24 / (24 + 2 * i) for i in range(4)]
    assert out["segmentation"][0]["iou"] == pytest.approx(100 * 96 / sum(24 + 2 * i for i in range(4)))
    assert out["overall"][0]["overall_acc"] == pytest.approx(50.0)
    assert sum(v > 0.8 for v in ious) == 3 or out["high_iou"]
    assert [w["cls"] for w in out["weak"]] == [1]
    assert F is not None
