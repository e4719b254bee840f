"""Quality classifier: histogram gradient-boosted trees over document statistics."""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass
from operator import eq

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, DoubleType

from geoctx.catalog.base import Catalog
from geoctx.llm.common import doc_bucket, documents

CATALOG = Catalog()
#: Labelled rows a model is fitted on at most: those with the smallest hash of doc_id.
FIT_ROWS = 20_000
#: Score from which a document counts as good.
GOOD = 0.3

FEATURES = (
    "log_bytes log_words mean_word longest_word distinct_share top_share repeat_share alnum_edge_share upper_share digit_share "
    "blank_share punct_share symbol_share high_share marks_share stops_share log_lines mean_line distinct_lines pipe_share byte_entropy short_share"
).split()


def _mask(chars: bytes) -> np.ndarray:
    return np.isin(np.arange(256), np.frombuffer(chars, np.uint8))


_UPPER, _LOWER, _DIGIT = (_mask(bytes(range(a, b + 1))) for a, b in ((65, 90), (97, 122), (48, 57)))
_BLANK, _STOP, _MARKS, _SYMBOL = _mask(b" \t\n\r\x0b\x0c"), _mask(b".,;:"), _mask(b"!?"), _mask(b"#$%&*+/<=>@[\\]^_`{}~")
_PUNCT = _mask(b"\"'()-")
_HIGH = np.arange(256) >= 128


def statistics(text: bytes) -> list[float]:
    """The numbers of ``FEATURES`` for one whole text; all are finite, also for an empty one."""
    n = len(text)
    seen = np.bincount(np.frombuffer(text, np.uint8), minlength=256)
    words, lines = text.split(), text.split(b"\n")
    w, letters = len(words), int(seen[_UPPER | _LOWER].sum())
    counts = Counter(words)
    lengths = np.fromiter(map(len, words), np.int64, w)
    share = seen[seen > 0] / max(n, 1)
    per = 1 / max(n, 1)
    return [
        np.log1p(n), np.log1p(w), float(lengths.mean()) if w else 0.0, float(lengths.max()) if w else 0.0,
        len(counts) / max(w, 1), max(counts.values(), default=0) / max(w, 1), sum(map(eq, words, words[1:])) / max(w - 1, 1),
        sum(1 for x in counts if x[-1:].isalnum() or x[-1] >= 128) / max(len(counts), 1),
        float(seen[_UPPER].sum()) / max(letters, 1), float(seen[_DIGIT].sum()) * per, float(seen[_BLANK].sum()) * per, float(seen[_PUNCT].sum()) * per,
        float(seen[_SYMBOL].sum()) * per, float(seen[_HIGH].sum()) * per, float(seen[_MARKS].sum()) * per, float(seen[_STOP].sum()) * per,
        np.log1p(len(lines)), n / len(lines), len(set(lines)) / len(lines), float(seen[124]) * per, float(-(share * np.log2(share)).sum()) if n else 0.0,
        float((lengths <= 3).mean()) if w else 0.0,
    ]


@dataclass(frozen=True)
class Trees:
    """Complete trees of equal depth as arrays: node i has children 2i+1 and 2i+2, leaves are stored apart."""

    prior: float
    feature: np.ndarray  # trees x (2^depth - 1)
    threshold: np.ndarray
    leaf: np.ndarray  # trees x 2^depth

    def scores(self, x: np.ndarray) -> np.ndarray:
        """Probability of label 1 for each row, all rows stepping down a tree together."""
        total, rows = np.full(len(x), self.prior), np.arange(len(x))
        depth = int(np.log2(self.leaf.shape[1])) if len(self.leaf) else 0
        for feature, threshold, leaf in zip(self.feature, self.threshold, self.leaf):
            node = np.zeros(len(x), dtype=np.int64)
            for _ in range(depth):
                node = 2 * node + 1 + (x[rows, feature[node]] > threshold[node])
            total += leaf[node - (leaf.size - 1)]
        return 1 / (1 + np.exp(-np.clip(total, -40, 40)))


def fit_trees(x: np.ndarray, y: np.ndarray, rounds: int = 80, depth: int = 4, rate: float = 0.15, bins: int = 64, ridge: float = 1.0, least: int = 10) -> Trees:
    """Boosted trees on gradient histograms of ``bins`` quantile bins; no rows give an even score, one class its rate."""
    inner, leaves, width = 2**depth - 1, 2**depth, x.shape[1] if x.ndim == 2 else 0
    rate_1 = (y.sum() + 1) / (len(y) + 2)
    prior = float(np.log(rate_1 / (1 - rate_1)))
    empty = Trees(prior, np.zeros((0, inner), np.int64), np.zeros((0, inner)), np.zeros((0, leaves)))
    if len(y) == 0 or y.min() == y.max():
        return empty
    edges = [np.unique(np.quantile(x[:, f], np.linspace(0, 1, bins + 1)[1:-1])) for f in range(width)]
    binned = np.stack([np.searchsorted(edges[f], x[:, f], side="left") for f in range(width)], axis=1)
    offset = binned + np.arange(width) * bins
    total = np.full(len(y), prior)
    features, thresholds, values = [], [], []
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-total))
        grad, hess = y - p, p * (1 - p)
        feature, threshold = np.zeros(inner, np.int64), np.full(inner, np.inf)
        node = np.zeros(len(y), dtype=np.int64)
        for level in range(depth):
            first, n = 2**level - 1, 2**level
            at = ((node - first)[:, None] * (width * bins) + offset).ravel()
            sums = [np.bincount(at, np.repeat(v, width), n * width * bins).reshape(n, width, bins).cumsum(axis=2) for v in (grad, hess, np.ones(len(y)))]
            g, h, c = sums
            G, H, C = (s[:, :, -1:] for s in sums)
            gain = g**2 / (h + ridge) + (G - g) ** 2 / (H - h + ridge) - G**2 / (H + ridge)
            gain = np.where((c >= least) & (C - c >= least), gain, 0)
            best = gain.reshape(n, -1).argmax(axis=1)
            for i, b in enumerate(best):
                f, cut = divmod(int(b), bins)
                if gain[i, f, cut] > 1e-9 and cut < len(edges[f]):
                    feature[first + i], threshold[first + i] = f, edges[f][cut]
            node = 2 * node + 1 + (x[np.arange(len(y)), feature[node]] > threshold[node])
        slot = node - inner
        leaf = rate * np.bincount(slot, grad, leaves) / (np.bincount(slot, hess, leaves) + ridge)
        total += leaf[slot]
        features.append(feature), thresholds.append(threshold), values.append(leaf)
    return Trees(prior, np.array(features), np.array(thresholds), np.array(values))


@F.pandas_udf(ArrayType(DoubleType()))
def _statistics(texts: pd.Series) -> pd.Series:
    return pd.Series([statistics(t) for t in texts])


def _bytes(text: Column) -> Column:
    return F.coalesce(text, F.lit("")).cast("binary")


def fit_quality(docs: DataFrame, labels: DataFrame, rows: int = FIT_ROWS) -> Trees:
    """A model of ``labels.quality`` from the texts of ``docs``.

    Fits on at most ``rows`` labelled documents whose crc32(doc_id as text) mod 5 is not 0, taken by hash of the
    id; labels that are NULL, or of no document, count for nothing. Only texts enter a score.
    """
    usable = labels.select(labels["doc_id"].cast("long").alias("_id"), labels["quality"].cast("int").alias("_label")).where(F.col("_label").isin(0, 1) & F.col("_id").isNotNull())
    chosen = usable.where(doc_bucket(F.col("_id")) != 0).orderBy(F.xxhash64("_id"), "_id", "_label").limit(rows)
    # the sample is bounded by `rows`, two numbers each
    fitted = docs.select(docs["doc_id"].alias("_doc"), docs["text"].alias("_text")).join(F.broadcast(chosen), F.col("_doc") == F.col("_id"))
    got = fitted.select("_label", _statistics(_bytes(F.col("_text"))).alias("x"), "_doc").orderBy("_doc", "_label").limit(rows).collect()
    return fit_trees(np.array([r.x for r in got]).reshape(len(got), len(FEATURES)), np.array([r._label for r in got], dtype=float))


def quality_score(model: Trees):
    """A column function: text (NULL as empty) to the probability that its label is 1."""

    @F.pandas_udf("double")
    def score(texts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for batch in texts:
            yield pd.Series(model.scores(np.array([statistics(t) for t in batch]).reshape(len(batch), len(FEATURES))))

    return lambda text: score(_bytes(text))


def keep_good(docs: DataFrame, labels: DataFrame, least: float = GOOD) -> DataFrame:
    """The rows of ``docs`` that score ``least`` or more, with all their columns.

    NULL and empty texts are scored like any other; repeated rows score alike; an empty table stays empty.
    """
    return docs.where(quality_score(fit_quality(docs, labels))(docs["text"]) >= least)


@CATALOG.add("op6_quality")
def op6(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir)
    score = quality_score(fit_quality(docs, spark.read.parquet(f"{sf_dir}/labels.parquet")))
    scored = docs.select("doc_id", (doc_bucket(F.col("doc_id")) == 0).alias("held_out"), score(F.col("text")).alias("score"))
    return scored.withColumn("predicted", (F.col("score") >= GOOD).cast("int"))
