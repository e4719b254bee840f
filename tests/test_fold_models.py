"""Grid search by fold statistics against a model fitted anew for every fold and setting."""

import numpy as np
import pytest

from geoctx.operators import features, fold_models, scoring

GRID = [(s, r) for s in (0.0, 0.5, 1.0) for r in (0.01, 0.5)]


def _plain(x, y, train, shrink, ridge, classes):
    """Log densities fitted on the training rows by their definition."""
    var = {c: x[train & (y == c)].var(axis=0) for c in classes if (train & (y == c)).any()}
    pooled = np.mean(list(var.values()), axis=0)
    out = np.full((len(x), len(classes)), -np.inf)
    for i, c in enumerate(classes):
        if c in var:
            v = (1 - shrink) * var[c] + shrink * pooled + ridge * pooled.mean()
            out[:, i] = -0.5 * (np.log(v) + (x - x[train & (y == c)].mean(axis=0)) ** 2 / v).sum(axis=1)
    return np.array(classes)[out.argmax(axis=1)]


def _f1(y, p, classes):
    f = [2 * ((y == c) & (p == c)).sum() / max((y == c).sum() + (p == c).sum(), 1) for c in classes]
    return float(np.mean(f))


def test_grid_equals_refitting(spark):
    rng = np.random.default_rng(7)
    y = rng.choice([2, 5, 9], size=400, p=[0.7, 0.25, 0.05])
    x = rng.normal(size=(400, 6)) + y[:, None] * rng.normal(scale=0.25, size=6)
    fold = rng.integers(0, 4, size=400)
    y[0], fold[0] = 11, 2  # a class of one row: unknown to the model that leaves its fold out
    rows = [(i, x[i].tolist(), int(y[i]), int(fold[i]), "x") for i in range(400)]
    rows += [(900, None, 2, 1, "x"), (901, x[0].tolist(), None, 1, "x"), (902, x[0].tolist(), 2, None, "x")]  # take no part
    df = spark.createDataFrame(rows, "id int, v array<double>, cls int, fold int, n string").repartition(7)
    table, best, w, b = fold_models.grid_search(df, GRID, "v", "cls", "fold", 4)
    classes = sorted(set(y.tolist()))
    got = {(r.shrink, r.ridge): r.macro_f1 for r in table.collect()}
    want = {g: np.mean([_f1(y[fold == f], _plain(x, y, fold != f, *g, classes)[fold == f], classes) for f in range(4)]) for g in GRID}
    assert got.keys() == want.keys() and all(abs(got[g] - want[g]) < 1e-12 for g in GRID)
    assert want[best] == max(want.values())
    scored = scoring.score_batches(df.where("id < 900").select("id", "v"), fold_models.gaussian_model(classes, w, b, "id", "v"), "id int, pred int")
    pred = {r.id: r.pred for r in scored.collect()}
    plain = _plain(x, y, np.full(400, True), *best, classes)
    assert [pred[i] for i in range(400)] == plain.tolist()


def test_odd_tables(spark):
    schema = "v array<double>, cls int, fold int"
    with pytest.raises(ValueError, match="no rows"):
        fold_models.grid_search(spark.createDataFrame([], schema), GRID, "v", "cls", "fold", 2)
    with pytest.raises(ValueError, match="fold 5"):
        fold_models.fold_statistics(spark.createDataFrame([([1.0], 0, 5)], schema), "v", "cls", "fold", 2)
    flat = spark.createDataFrame([([1.0], 0, 0), ([1.0], 0, 1)], schema)
    with pytest.raises(ValueError, match="ridge"):
        fold_models.grid_search(flat, [(0.0, 0.0)], "v", "cls", "fold", 2)


def test_svd_with_empty_and_long_rows(spark):
    rng = np.random.default_rng(3)
    dense = np.where(rng.random((60, 40)) < 0.2, rng.normal(size=(60, 40)), 0.0)
    dense[5], dense[6] = 0.0, rng.normal(size=40)
    rows = [(i, np.flatnonzero(r).tolist(), r[np.flatnonzero(r)].tolist()) for i, r in enumerate(dense)]
    df = spark.createDataFrame(rows, "id int, idx array<int>, val array<double>").repartition(5)
    v, s = features.fit_svd(df, 40, 6, oversample=34, passes=4)
    assert np.allclose(s, np.linalg.svd(dense, compute_uv=False)[:6])
    got = {r.id: r.features for r in features.project_svd(df, v).collect()}
    want = dense @ v
    for i in range(60):
        size = np.linalg.norm(want[i])
        assert np.allclose(got[i], want[i] / size if size else 0.0)
    assert [list(features._slices([[1] * 5, [], [1] * 9, [1]], cells=6))] == [[(0, 2), (2, 3), (3, 4)]]
    with pytest.raises(ValueError, match="exceed"):
        features.fit_svd(df, 1_000_000, 256)
