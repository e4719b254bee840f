"""User models over tables: batch scoring, grid search, named pipelines, metric plug-ins."""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.ml import Estimator
from pyspark.ml.evaluation import Evaluator
from pyspark.ml.functions import array_to_vector
from pyspark.ml.tuning import CrossValidator
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from geoctx.operators import metrics


def score_batches(df: DataFrame, predict: Callable[[pd.DataFrame], pd.DataFrame], schema: str) -> DataFrame:
    """Arrow batches through ``predict``: one row in, one row out. No shuffle, no group."""
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            out = predict(pdf)
            if len(out) != len(pdf):
                raise ValueError(f"model gave {len(out)} rows for {len(pdf)}")
            yield out

    return df.mapInPandas(run, schema)


def linear_model(weights: np.ndarray, bias: np.ndarray, key: str, features: str, extra: Sequence[str] = ()):
    """A predict function for ``score_batches``: scores x W + b and their best class."""
    def predict(pdf: pd.DataFrame) -> pd.DataFrame:
        x = np.array(pdf[features].tolist(), dtype="float64").reshape(len(pdf), weights.shape[0])
        s = x @ weights + bias
        out = {key: pdf[key], **{c: pdf[c] for c in extra}, "scores": list(s), "pred": s.argmax(axis=1)}
        return pd.DataFrame(out)

    return predict


def class_centroids(train: DataFrame, features: str, label: str) -> tuple[np.ndarray, np.ndarray]:
    """Weights and bias of the nearest-centroid rule; one row per class comes to the driver."""
    size = len(train.select(features).first()[0])
    means = train.groupBy(label).agg(F.array(*[F.avg(F.col(features)[i].cast("double")) for i in range(size)]).alias("m"))
    rows = sorted(means.collect(), key=lambda r: r[label])
    w = np.array([r.m for r in rows]).T
    return w, -0.5 * (w * w).sum(axis=0)


def fourier_features(df: DataFrame, column: str, size: int, out: int, gamma: float, seed: int = 42) -> DataFrame:
    """Fixed random Fourier columns: a linear model on them approximates one with an RBF kernel."""
    rng = np.random.default_rng(seed)
    w = rng.normal(scale=np.sqrt(2 * gamma), size=(size, out))
    b = rng.uniform(0, 2 * np.pi, size=out)

    @F.pandas_udf("array<double>")
    def lift(x: pd.Series) -> pd.Series:
        m = np.array(x.tolist(), dtype="float64").reshape(len(x), size)
        return pd.Series(list(np.sqrt(2.0 / out) * np.cos(m @ w + b)))

    return df.withColumn(column, lift(column))


def with_balanced_weights(df: DataFrame, label: str, name: str = "weight") -> DataFrame:
    """Row weight n / (classes * class size)."""
    counts = df.groupBy(label).agg(F.count(F.lit(1)).alias("_n"))
    whole = counts.agg(F.sum("_n").alias("_t"), F.count(F.lit(1)).alias("_k"))
    weights = counts.join(whole).select(label, (F.col("_t") / (F.col("_k") * F.col("_n"))).alias(name))
    return df.join(weights, label)


class MacroF1(Evaluator):
    """Macro F1 over the classes, for Spark's cross validation."""

    def __init__(self, classes: int, label: str = "label", prediction: str = "prediction"):
        super().__init__()
        self.classes, self.label, self.prediction = classes, label, prediction

    def _evaluate(self, dataset: DataFrame) -> float:
        pairs = dataset.select(F.col(self.label).cast("int").alias("gt"), F.col(self.prediction).cast("int").alias("pred"))
        report = metrics.class_report(metrics.confusion_matrix(pairs, self.classes), eps=0.0)
        return metrics.summary(report).first()["macro_f1"]

    def isLargerBetter(self) -> bool:
        return True


def grid_search(train: DataFrame, estimator: Estimator, grid, classes: int, label: str, fold: str, folds: int = 5,
                parallelism: int = 4):
    """Cross validation on given fold numbers, scored by macro F1, best setting refitted on all rows."""
    cv = CrossValidator(
        estimator=estimator, estimatorParamMaps=grid, evaluator=MacroF1(classes, label), numFolds=folds,
        foldCol=fold, parallelism=parallelism)
    return cv.fit(train)


def as_features(df: DataFrame, column: str, name: str = "features") -> DataFrame:
    return df.withColumn(name, array_to_vector(F.transform(column, lambda e: e.cast("double"))))


# ---- named steps -----------------------------------------------------------------

Step = Callable[..., DataFrame]


class Steps:
    """Named DataFrame steps, composed from a configuration list ``[{"type": name, **options}]``."""

    def __init__(self) -> None:
        self._steps: dict[str, Step] = {}

    def register(self, name: str) -> Callable[[Step], Step]:
        def keep(fn: Step) -> Step:
            if name in self._steps:
                raise KeyError(f"{name} is registered twice")
            self._steps[name] = fn
            return fn

        return keep

    def compose(self, config: Sequence[dict]) -> Callable[[DataFrame], DataFrame]:
        plan = []
        for item in config:
            options = {k: v for k, v in item.items() if k != "type"}
            if item["type"] not in self._steps:
                raise KeyError(f"unknown step {item['type']}")
            plan.append((self._steps[item["type"]], options))

        def run(df: DataFrame) -> DataFrame:
            for fn, options in plan:
                df = df.transform(fn, **options)
            return df

        return run


@dataclass(frozen=True)
class Metric:
    """A mergeable metric: ``partials`` reduces rows to sums, ``final`` turns summed partials into figures."""

    partials: Callable[[DataFrame], DataFrame]
    final: Callable[[DataFrame], DataFrame]


METRICS: dict[str, Metric] = {
    "foreground": Metric(lambda df: metrics.foreground_areas(df), metrics.foreground_metrics),
    "classification": Metric(
        lambda df: metrics.pair_counts(df),
        lambda p: metrics.summary(metrics.class_report(p.groupBy("gt", "pred").agg(F.sum("n").alias("n"))))),
    "depth": Metric(lambda df: metrics.depth_metrics(df), metrics.mean_depth_metrics),
}


def evaluate(name: str, batches: Sequence[DataFrame]) -> DataFrame:
    """A registered metric over several batches: partials of each, united, then the final step."""
    m = METRICS[name]
    parts = [m.partials(b) for b in batches]
    united = parts[0]
    for p in parts[1:]:
        united = united.unionByName(p)
    return m.final(united)
