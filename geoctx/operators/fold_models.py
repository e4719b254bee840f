"""Grid search by fold statistics: class Gaussians whose training sums are the total minus the fold left out."""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.stat import Summarizer
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


@dataclass(frozen=True)
class FoldStatistics:
    """Rows, sums and sums of squares per (fold, class): ``n[f, c]``, ``s[f, c, d]``, ``q[f, c, d]``."""

    classes: list[int]
    n: np.ndarray
    s: np.ndarray
    q: np.ndarray

    def without(self, fold: int | None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Sums of the training rows of a fold (of all rows with None)."""
        keep = [f for f in range(len(self.n)) if f != fold]
        return self.n[keep].sum(axis=0), self.s[keep].sum(axis=0), self.q[keep].sum(axis=0)


def fold_statistics(df: DataFrame, features: str, label: str, fold: str, folds: int) -> FoldStatistics:
    """One pass with map-side sums; folds x classes x 2 x columns numbers reach the driver, whatever the rows.

    Rows without features, label or fold take no part. Folds are numbered from 0.
    """
    used = df.where(F.col(features).isNotNull() & F.col(label).isNotNull() & F.col(fold).isNotNull())
    x = F.transform(features, lambda e: e.cast("double"))
    both = array_to_vector(F.concat(x, F.transform(x, lambda e: e * e)))
    rows = used.groupBy(F.col(fold).cast("int").alias("f"), F.col(label).cast("int").alias("c")).agg(
        F.count(F.lit(1)).alias("n"), Summarizer.sum(both).alias("z")).select("f", "c", "n", vector_to_array("z").alias("z")).collect()
    classes = sorted({r.c for r in rows})
    size = len(rows[0].z) // 2 if rows else 0
    n, s, q = np.zeros((folds, len(classes))), np.zeros((folds, len(classes), size)), np.zeros((folds, len(classes), size))
    for r in rows:
        if not 0 <= r.f < folds:
            raise ValueError(f"fold {r.f} of {folds}")
        at = r.f, classes.index(r.c)
        n[at], s[at], q[at] = r.n, r.z[:size], r.z[size:]
    return FoldStatistics(classes, n, s, q)


def gaussian_weights(sums: tuple[np.ndarray, np.ndarray, np.ndarray], shrink: float, ridge: float) -> tuple[np.ndarray, np.ndarray]:
    """Weights (2 x columns, classes) on ``[x, x * x]`` and biases of the log density of each class.

    Variances go ``shrink`` of the way to the mean of the class variances, plus ``ridge`` times the mean
    variance of all columns. Classes weigh alike, whatever their size: prior and pooled variance are balanced
    over the classes of the training rows. A class without training rows is never chosen.
    """
    n, s, q = sums
    known = n > 0
    many = np.maximum(n, 1)[:, None]
    mean = s / many
    var = np.maximum(q / many - mean * mean, 0.0)
    pooled = var[known].mean(axis=0)
    var = (1 - shrink) * var + shrink * pooled + ridge * pooled.mean()
    if not (var[known] > 0).all():
        raise ValueError("a column without variance needs ridge > 0")
    var[~known] = 1.0
    w = np.concatenate([mean / var, -0.5 / var], axis=1).T
    b = np.where(known, -0.5 * (np.log(var) + mean * mean / var).sum(axis=1), -np.inf)
    return w, b


def _squared(pdf: pd.DataFrame, features: str, size: int) -> np.ndarray:
    x = np.array(pdf[features].tolist(), dtype="float64").reshape(len(pdf), size)
    return np.concatenate([x, x * x], axis=1)


def gaussian_model(classes: Sequence[int], w: np.ndarray, b: np.ndarray, key: str, features: str):
    """A predict function for ``scoring.score_batches``: (key, pred)."""
    names = np.asarray(classes)

    def predict(pdf: pd.DataFrame) -> pd.DataFrame:
        return pd.DataFrame({key: pdf[key], "pred": names[(_squared(pdf, features, len(w) // 2) @ w + b).argmax(axis=1)]})

    return predict


def grid_confusions(df: DataFrame, stats: FoldStatistics, grid: Sequence[tuple[float, float]], features: str, label: str, fold: str) -> DataFrame:
    """(setting, fold, gt, pred, n): every row scored once by all settings of the models that did not see its fold.

    Sent to every task: folds x settings x classes x 2 x columns numbers, which do not grow with the rows.
    """
    folds, classes = len(stats.n), np.asarray(stats.classes)
    many, size = len(classes), stats.s.shape[2]
    models = []
    for f in range(folds):
        fitted = [gaussian_weights(stats.without(f), *g) for g in grid]
        models.append((np.concatenate([w for w, _ in fitted], axis=1), np.concatenate([b for _, b in fitted])))
    shared = df.sparkSession.sparkContext.broadcast(models)

    def count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        seen = np.zeros((folds, len(grid), many, many), dtype="int64")
        for pdf in batches:
            for f, part in pdf.groupby("f"):
                w, b = shared.value[f]
                gt = np.searchsorted(classes, part["c"].to_numpy())
                for at in range(0, len(part), 2048):
                    rows = part.iloc[at:at + 2048]
                    pred = (_squared(rows, "x", size) @ w + b).reshape(len(rows), len(grid), many).argmax(axis=2)
                    np.add.at(seen[f], (np.arange(len(grid))[None, :], gt[at:at + 2048, None], pred), 1)
        f, g, a, p = np.nonzero(seen)
        yield pd.DataFrame({"fold": f, "setting": g, "gt": classes[a], "pred": classes[p], "n": seen[f, g, a, p]})

    used = df.where(F.col(features).isNotNull() & F.col(label).isNotNull() & F.col(fold).isNotNull()).select(
        F.col(fold).cast("int").alias("f"), F.col(label).cast("int").alias("c"), F.col(features).alias("x"))
    parts = used.mapInPandas(count, "fold int, setting int, gt int, pred int, n long")
    return parts.groupBy("setting", "fold", "gt", "pred").agg(F.sum("n").alias("n"))


def macro_f1(confusions: DataFrame, classes: int) -> DataFrame:
    """(setting, fold, macro_f1) over all classes; a class neither present nor predicted counts 0."""
    sides = confusions.select("setting", "fold", "n", F.explode(F.array(
        F.struct(F.col("gt").alias("c"), (F.col("gt") == F.col("pred")).cast("long").alias("hit")),
        F.struct(F.col("pred").alias("c"), F.lit(0).cast("long").alias("hit")))).alias("e"))
    per = sides.groupBy("setting", "fold", "e.c").agg((2 * F.sum(F.col("n") * F.col("e.hit")) / F.sum("n")).alias("f1"))
    return per.groupBy("setting", "fold").agg((F.sum("f1") / classes).alias("macro_f1"))


def grid_search(df: DataFrame, grid: Sequence[tuple[float, float]], features: str, label: str, fold: str, folds: int = 5):
    """(table, best, weights, biases): mean macro F1 per setting over the folds, and the best one fitted on all rows.

    Two passes over the rows for any number of settings and folds. Equal scores go to the earlier setting; a
    table without rows is refused.
    """
    stats = fold_statistics(df, features, label, fold, folds)
    if not stats.classes:
        raise ValueError("no rows to fit")
    scores = macro_f1(grid_confusions(df, stats, grid, features, label, fold), len(stats.classes))
    mean = {r.setting: r.m for r in scores.groupBy("setting").agg(F.avg("macro_f1").alias("m")).collect()}  # a row per setting
    best = max(range(len(grid)), key=lambda i: (mean[i], -i))
    table = _table(df.sparkSession, grid, mean)
    return table, grid[best], *gaussian_weights(stats.without(None), *grid[best])


def _table(spark: SparkSession, grid: Sequence[tuple[float, float]], mean: dict[int, float]) -> DataFrame:
    rows = [(float(s), float(r), float(mean[i])) for i, (s, r) in enumerate(grid)]
    return spark.createDataFrame(rows, "shrink double, ridge double, macro_f1 double")
