"""Boxes of any size on grids of their size: every touching pair once, few cells each."""

import numpy as np
from pyspark.sql import functions as F

from geoctx.operators import spatial_join

SIDES = "minx double, miny double, maxx double, maxy double"


def _boxes(seed, n):
    rng = np.random.default_rng(seed)
    side = np.exp(rng.uniform(-1, 11, size=(n, 2)))  # 0.4 to 60,000
    low = np.round(rng.uniform(-50_000, 50_000, size=(n, 2)) / 60) * 60  # many on the edges of cells
    low[: n // 3] = rng.uniform(0, 200, size=(n // 3, 2))  # a third in one place
    rows = [(i, *map(float, low[i]), *map(float, low[i] + side[i])) for i in range(n)]
    return rows + [(n, 0.0, 0.0, 0.0, 0.0), (n + 1, -60.0, -60.0, 180.0, 60.0), (n + 2, None, 0.0, 1.0, 1.0), (n + 3, 60.0, 0.0, 60.0, 60.0)]


def _frame(spark, rows, prefix):
    df = spark.createDataFrame(rows, f"{prefix}id long, " + SIDES).repartition(4)
    return df.withColumnsRenamed({c: prefix + c for c in ("minx", "miny", "maxx", "maxy")})


def test_every_touching_pair_once(spark):
    left, right = _boxes(1, 240), _boxes(2, 200)
    got = spatial_join.bbox_join(_frame(spark, left, "a_"), _frame(spark, right, "b_"), 60.0)
    assert sorted(got.columns) == sorted([p + c for p in ("a_", "b_") for c in ("id", "minx", "miny", "maxx", "maxy")])
    want = sorted((a[0], b[0]) for a in left for b in right if a[1] is not None and b[1] is not None
                  and a[1] <= b[3] and b[1] <= a[3] and a[2] <= b[4] and b[2] <= a[4])
    assert sorted((r.a_id, r.b_id) for r in got.collect()) == want


def test_cells_are_few(spark):
    df = _frame(spark, [*_boxes(3, 300), (900, -3e7, -3e7, 3e7, 3e7)], "a_")
    levels = spatial_join._levels(df, "a_", 60.0)
    per = spatial_join._cells(df, "a_", 60.0, levels, "_l").groupBy("a_id", "_lv").count()
    assert per.agg(F.max("count")).first()[0] <= 4 and len(levels) <= 11
    one = df.where("a_id = 900")
    assert spatial_join._cells(one, "a_", 60.0, [0], "_l").count() <= 4


def test_no_boxes(spark):
    df = _frame(spark, _boxes(4, 5), "a_")
    assert spatial_join.bbox_join(df, _frame(spark, [], "b_"), 60.0).count() == 0
