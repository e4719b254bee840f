"""The classifier on held-out labels, its trees against a plain walk, and odd tables."""

import zlib

import numpy as np
import pytest

from geoctx.llm.quality import FEATURES, fit_quality, fit_trees, keep_good, quality_score, statistics


def plain_walk(model, row):
    total = model.prior
    for feature, threshold, leaf in zip(model.feature, model.threshold, model.leaf):
        node = 0
        while node < len(feature):
            node = 2 * node + (2 if row[feature[node]] > threshold[node] else 1)
        total += leaf[node - len(feature)]
    return 1 / (1 + np.exp(-total))


def test_held_out_labels(spark):
    import __spark_entry__ as entry

    sf_dir = "/root/testdata/sf0.1"
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    scored = entry.queries()["op6_quality"](spark, sf_dir)
    rows = scored.join(spark.read.parquet(f"{sf_dir}/labels.parquet"), "doc_id", "left").collect()
    assert len(rows) == docs.count()
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 5 == 0) and 0 <= r.score <= 1 and r.predicted == (r.score >= 0.3) for r in rows)
    held = [r for r in rows if r.held_out and r.quality is not None]
    good, bad = ([r.score for r in held if r.quality == q] for q in (1, 0))
    auc = np.mean([[(g > b) + 0.5 * (g == b) for b in bad] for g in good])
    assert auc > 0.99 and np.mean([r.predicted == r.quality for r in held]) > 0.98


def test_trees_step_like_a_plain_walk():
    rng = np.random.default_rng(4)
    x = np.round(rng.normal(size=(800, 6)), 1)
    y = ((x[:, 0] > 0.2) ^ (x[:, 3] > 0)).astype(float)
    model = fit_trees(x, y, rounds=25, depth=3)
    assert np.allclose(model.scores(x), [plain_walk(model, r) for r in x])
    assert np.mean((model.scores(x) >= 0.5) == y) > 0.95


@pytest.mark.parametrize("y", [np.zeros(0), np.ones(7), np.zeros(7)])
def test_nothing_to_tell_apart(y):
    model = fit_trees(np.zeros((len(y), 3)), y)
    p = model.scores(np.zeros((2, 3)))
    assert np.allclose(p, (y.sum() + 1) / (len(y) + 2))


def test_statistics_are_finite():
    for text in (b"", b" ", b"\n\n", b"word", "é 数 😀".encode(), b"a " * 100_000, b"x" * 300_000, bytes(range(256))):
        values = statistics(text)
        assert len(values) == len(FEATURES) and np.isfinite(values).all()


def test_odd_labels_and_rows(spark):
    docs = spark.createDataFrame([(i, None if i % 9 == 0 else "some words here " * (i % 7), 1.5, 0) for i in range(60)] + [(None, "null id", 0.1, 1), (3, "again", 0.2, 1)], "doc_id long, text string, score double, quality int")
    labels = spark.createDataFrame([(i, None if i % 8 == 0 else i % 2, 0, "x") for i in range(80)] + [(None, 1, 0, "x"), (5, 1, 0, "x")], "doc_id long, quality int, toxic int, text string")
    model = fit_quality(docs, labels)
    assert len(docs.select("doc_id", quality_score(model)(docs["text"]).alias("s")).where("s BETWEEN 0 AND 1").collect()) == 62
    assert keep_good(docs, labels).columns == docs.columns
    assert keep_good(docs, labels.where("doc_id > 999")).count() == 62
    assert keep_good(docs.where("doc_id > 999"), labels).collect() == []
