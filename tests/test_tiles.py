"""Nearest points by tiles: the kernel against brute force, both routes, and no pairs in a shuffle."""

import numpy as np
import pytest

from geoctx.operators import context, spatial_join
from geoctx.operators.spatial_join import _nearest, nearest_k
from geoctx.plans.context_corpus import context_prompts


def brute(x, y, px, py, reach, k):
    out = set()
    for i in range(len(x)):
        d = np.sqrt((x[i] - px) ** 2 + (y[i] - py) ** 2)
        out |= {(i, int(j), n + 1) for n, j in enumerate(np.lexsort((np.arange(len(d)), d))[:k]) if d[j] <= reach}
    return out


@pytest.mark.parametrize("kind", ["even", "lattice", "crowd", "line"])
def test_nearest_of_a_tile(kind):
    rng = np.random.default_rng(3)
    px, py = rng.random((2, 3000)) * 900
    if kind == "lattice":
        px, py = np.floor(px / 30) * 30, np.floor(py / 30) * 30
    elif kind == "crowd":
        px[500:], py[500:] = 400 + px[500:] / 300, 400 + py[500:] / 300
    elif kind == "line":
        px[:] = 7.0
    x, y = rng.random((2, 120)) * 1000 - 50
    x[0], y[0], px[0] = np.nan, 5.0, np.nan
    for k in (1, 9, 200):
        c, p, d, r = _nearest(x, y, np.full(len(x), 250.0), px, py, k, 5000)
        assert set(zip(c.tolist(), p.tolist(), r.tolist())) == brute(x, y, px, py, 250.0, k)


@pytest.mark.parametrize("most", [500_000, 40])
def test_crowded_tiles_and_keys_that_come_again(spark, monkeypatch, most):
    monkeypatch.setattr(spatial_join, "TILE_POINTS", most)
    rng = np.random.default_rng(4)
    px, py = np.floor(rng.random((2, 700)) * 1500)
    x, y = np.floor(rng.random((2, 50)) * 1500)
    c = spark.createDataFrame([(int(min(i, 47)), float(a), float(b)) for i, (a, b) in enumerate(zip(x, y))], "build_id long, x double, y double")
    p = spark.createDataFrame([(i, float(a), float(b)) for i, (a, b) in enumerate(zip(px, py))], "poi_id long, x double, y double")
    rows = nearest_k(c, p, 300.0, 6).collect()
    got = {(r.build_id, r.poi_id, r.rk) for r in rows if r.build_id < 47}
    assert got == {r for r in brute(x, y, px, py, 300.0, 6) if r[0] < 47}
    assert sorted(r.rk for r in rows if r.build_id == 47) == list(range(1, 7))  # three centres of one key are ranked together


def test_no_pairs_are_shuffled(spark):
    c = spark.createDataFrame([(i, float(i), 0.0) for i in range(40)], "build_id long, x double, y double")
    p = spark.createDataFrame([(i, float(i), 1.0) for i in range(400)], "poi_id long, x double, y double")
    plan = nearest_k(c, p, 300.0, 5)._jdf.queryExecution().executedPlan().toString()
    assert "CoGroups" in plan and "rk" not in plan.split("CoGroups", 1)[1].split("\n", 1)[1]


@pytest.mark.parametrize("most", [500_000, 40])
def test_lists_hold_the_rows(spark, monkeypatch, most):
    """Lists from the tasks, and what is packed and counted from them, against rows; repeated and missing keys and types."""
    monkeypatch.setattr(spatial_join, "TILE_POINTS", most)
    rng = np.random.default_rng(5)
    px, py = np.floor(rng.random((2, 600)) * 1500)
    x, y = np.floor(rng.random((2, 50)) * 1500)
    c = spark.createDataFrame([(None if i == 3 else min(i, 47), float(a), float(b)) for i, (a, b) in enumerate(zip(x, y))], "build_id long, x double, y double")
    p = spark.createDataFrame([(i, float(a), float(b), [None, "a", "b", "c", "d", "e", "f"][i * i % 7]) for i, (a, b) in enumerate(zip(px, py))],
                              "poi_id long, x double, y double, type_en string")
    rows = context.with_bands(nearest_k(c, p, 300.0, 40))
    lists = context.with_bands(nearest_k(c, p, 300.0, 40, lists=["type_en"]))
    same = lambda f: sorted(map(str, f(lists).collect())) == sorted(map(str, f(rows).collect())) != []
    assert same(lambda t: context.packed_lists(t, min_count=5))
    assert same(lambda t: context.band_profile(t, top=3))
    assert same(lambda t: context.prompts(t))


def test_lists_are_not_shuffled(spark):
    c = spark.createDataFrame([(i, float(i), 0.0) for i in range(40)], "build_id long, x double, y double")
    p = spark.createDataFrame([(i, float(i), 1.0, "a") for i in range(400)], "poi_id long, x double, y double, type_en string")
    lists = context.with_bands(nearest_k(c, p, 300.0, 5, lists=["type_en"]))
    for made in (context.packed_lists(lists), context.band_profile(lists), context.prompts(lists), context_prompts(c, p)):
        above = made._jdf.queryExecution().executedPlan().toString().split("FlatMapCoGroupsInArrow")[0]
        assert "Exchange" not in above
