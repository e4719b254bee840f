"""Features against numpy."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from geoctx.operators import features, raster, scoring


def vectors(spark, n=80, size=6, seed=0):
    rnd = np.random.default_rng(seed)
    x = rnd.normal(size=(n, size)) * np.arange(1, size + 1) + 3
    return x, spark.createDataFrame([(i, [float(v) for v in r]) for i, r in enumerate(x)], "id int, v array<double>")


def unit(x):
    return x / np.linalg.norm(x, axis=1, keepdims=True)


def collected(df, column):
    return np.array([r[column] for r in sorted(df.collect(), key=lambda r: r.id)])


def test_scaler_is_fitted_on_train_only(spark):
    x, df = vectors(spark)
    df = features.as_vector(df, "v")
    scaler = features.fit_scaler(df.where("id < 50"), "v")
    want = unit((x - x[:50].mean(axis=0)) / x[:50].std(axis=0))
    assert collected(features.standardise(df, scaler, "v"), "v") == pytest.approx(want)


def test_pca(spark):
    x, df = vectors(spark)
    model = features.fit_pca(features.as_vector(df, "v"), "v", 3)
    s = np.linalg.svd(x - x.mean(axis=0), compute_uv=False) ** 2
    assert model.explainedVariance.toArray() == pytest.approx(s[:3] / s.sum())
    got = collected(features.project(features.as_vector(df, "v"), model, "v"), "v")
    assert np.linalg.norm(got, axis=1) == pytest.approx(np.ones(80))


def test_truncated_svd(spark):
    rnd = np.random.default_rng(1)
    x = rnd.random((60, 20)) * (rnd.random((60, 20)) < 0.4) * np.linspace(3, 0.1, 20)
    rows = [(i, [int(j) for j in np.flatnonzero(r)], [float(v) for v in r[r != 0]]) for i, r in enumerate(x)]
    df = spark.createDataFrame(rows, "id int, idx array<int>, val array<double>").repartition(3)
    v, s = features.fit_svd(df, 20, 4, oversample=8, passes=8)
    u, want, vt = np.linalg.svd(x, full_matrices=False)
    assert s == pytest.approx(want[:4], rel=1e-6)
    assert np.abs((v * vt[:4].T).sum(axis=0)) == pytest.approx(np.ones(4), abs=1e-5)
    got = collected(features.project_svd(df, v), "features")
    keep = np.linalg.norm(x @ vt[:4].T, axis=1) > 1e-9
    assert np.abs(got[keep]) == pytest.approx(np.abs(unit((x @ vt[:4].T)[keep])), abs=1e-4)


def test_tfidf_by_hand(spark):
    docs = spark.createDataFrame([(1, "The red park, the park"), (2, "Red shop!"), (3, "x")], "id int, t string")
    vocab = features.fit_tfidf(docs, "id", "t", ["the"], 4)
    terms = {r.term: (r.total, r.df, r.idf) for r in vocab.collect()}
    assert set(terms) == {"park", "red", "park park", "red park"}  # ties by term
    assert terms["park"][:2] == (2, 1) and terms["red"][2] == pytest.approx(math.log(4 / 3) + 1)
    w = {(r.id, r.term): r.weight for r in features.tfidf_weights(docs, vocab, "id", "t", ["the"]).collect()}
    assert w[(2, "red")] == pytest.approx(1.0) and not any(k[0] == 3 for k in w)
    assert sum(v * v for k, v in w.items() if k[0] == 1) == pytest.approx(1.0)


def test_vocabulary_counts_leave_batches_added_up(spark, monkeypatch):
    """A row per distinct term and slice, equal to the terms of the documents counted one by one."""
    texts = ["The cat, the CAT and\u212aat dog", None, "", "x yy", "yy", "\u00fcber-all ÉcOle the\u0130the the", "9", "cat dog cat dog"] * 3 + ["ab " * 50, "a b c"]
    df = spark.createDataFrame(list(enumerate(texts)), "id long, t string").coalesce(1)
    terms = [r.terms for r in features.with_terms(df, "id", "t", ["the", "and"]).collect()]
    want = {}
    for row in filter(None, terms):
        for t in row:
            tf, docs = want.get(t, (0, 0))
            want[t] = (tf + 1, docs)
        for t in set(row):
            want[t] = (want[t][0], want[t][1] + 1)
    got = features._term_counts(df, "t", ["the", "and"]).collect()
    assert len(got) == len(want) and {r.term: (r.tf, r.df) for r in got} == want
    monkeypatch.setattr(features, "SLICE_BYTES", 8)
    counts = features.fit_tfidf(df, "id", "t", ["the", "and"]).collect()
    assert {r.term: (r.total, r.df) for r in counts} == want
    assert features.fit_tfidf(df.where("id < 0"), "id", "t", []).collect() == []


def test_sequences_and_means(spark):
    docs = spark.createDataFrame([(1, "aa bb zz aa"), (2, "zz")], "id int, t string")
    vocab = spark.createDataFrame([("aa", 0), ("bb", 1)], "token string, vec_id long")
    vecs = spark.createDataFrame([(0, [1.0, 0.0]), (1, [0.0, 3.0])], "vec_id long, embedding array<double>")
    seq = {r.id: (r.length, r.ids) for r in features.token_sequences(docs, vocab, "id", "t", 2).collect()}
    assert seq == {1: (2, [0, 1]), 2: (0, [-1, -1])}
    mean = {r.id: r.vector for r in features.mean_vectors(docs, vocab, vecs, "id", "t", 2).collect()}
    assert mean[1] == pytest.approx([2 / 3, 1.0]) and mean[2] == [0.0, 0.0]


def test_batch_scoring_keeps_rows(spark):
    x, df = vectors(spark)
    model = scoring.linear_model(np.eye(6), np.zeros(6), "id", "v")
    out = scoring.score_batches(df, model, "id int, scores array<double>, pred long")
    assert [r.pred for r in sorted(out.collect(), key=lambda r: r.id)] == list(x.argmax(axis=1))
    with pytest.raises(Exception, match="model gave"):
        scoring.score_batches(df, lambda pdf: pdf.head(0)[["id"]], "id int").collect()


def test_gradient_histogram(spark):
    rnd = np.random.default_rng(3)
    img = rnd.integers(0, 255, size=(12, 12)).astype(float)
    df = spark.createDataFrame([(1, r, c, float(img[r, c])) for r in range(12) for c in range(12)], "image_id long, row int, col int, v double")
    got = {(r.by, r.bx): r.hog for r in raster.gradient_histogram(df, "image_id", "v", 12, 12, cell=4).collect()}
    gy, gx = np.zeros_like(img), np.zeros_like(img)
    gy[1:-1], gx[:, 1:-1] = img[2:] - img[:-2], img[:, 2:] - img[:, :-2]
    ang, mag = np.rad2deg(np.arctan2(gy, gx)) % 180, np.hypot(gy, gx)
    h = np.zeros((3, 3, 9))
    for r in range(12):
        for c in range(12):
            h[r // 4, c // 4, min(int(ang[r, c] // 20), 8)] += mag[r, c] / 16
    for y in range(2):
        for x in range(2):
            b = h[y:y + 2, x:x + 2].ravel()
            b = np.minimum(b / np.sqrt((b * b).sum() + 1e-10), 0.2)
            assert got[(y, x)] == pytest.approx(b / np.sqrt((b * b).sum() + 1e-10))


def test_closing_is_idempotent_and_keeps_the_mask(spark):
    rnd = np.random.default_rng(5)
    cells = {(int(r), int(c)) for r, c in np.argwhere(rnd.random((9, 9)) < 0.3)}
    df = spark.createDataFrame([(1, r, c) for r, c in cells], "image_id long, row int, col int")
    once = raster.closing(df, ["image_id"], 9, 9)
    a = {(r.row, r.col) for r in once.collect()}
    b = {(r.row, r.col) for r in raster.closing(once, ["image_id"], 9, 9).collect()}
    assert cells <= a == b


def test_flat_texture_has_correlation_one(spark):
    df = spark.createDataFrame([(1, r, c, 7) for r in range(3) for c in range(3)], "image_id long, row int, col int, level int")
    t = raster.texture(raster.cooccurrence(df, "image_id", "level"), "image_id").collect()
    assert [(r.contrast, r.homogeneity, r.energy, r.correlation) for r in t] == [(0.0, 1.0, 1.0, 1.0)] * 4


def test_window_starts(spark):
    df = spark.createDataFrame([(1000,), (512,), (300,)], "n int")
    starts = {r.n: (r.s, r.c) for r in df.select("n", raster.sliding_starts("n", 512, 312).alias("s"), raster.covering_starts("n", 512, 341).alias("c")).collect()}
    assert starts == {1000: ([0, 312, 488, 488], [0, 341, 488]), 512: ([0, 0], [0]), 300: ([0, 0], [0])}


def test_crop_is_shifted_inside_or_skipped(spark):
    df = spark.createDataFrame([(5, 5), (500, 990)], "r int, c int")
    got = [(r.row_off, r.col_off) for r in raster.centred_crop(df, "r", "c", 100, 1000, 1000).collect()]
    assert got == [(0, 0), (450, 900)]
    assert raster.centred_crop(df, "r", "c", 100, 60, 1000).count() == 0
    assert F is not None
