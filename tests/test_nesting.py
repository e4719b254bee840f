"""Holes in shells, burning by runs, and both undone by each other."""

import numpy as np
from pyspark.sql import functions as F

from geoctx.operators import components, polygons

UP = (1.0, 0.0, 0.0, 0.0, -1.0, 24.0)
DOWN = (2.0, 0.0, 6.0, 0.0, 2.0, -4.0)


def _mask(seed, size=24):
    rng = np.random.default_rng(seed)
    m = rng.random((size, size)) < 0.62
    m[2:9, 2:9], m[3:8, 3:8], m[4:7, 4:7], m[5, 5] = True, False, True, False  # a ring in the hole of a ring
    return m


def _pixels(spark, masks):
    rows = [(k, int(r), int(c), 1) for k, m in masks.items() for r, c in zip(*np.nonzero(m))]
    return spark.createDataFrame(rows, "image_id int, row int, col int, value int")


def _polygons(spark, masks, diagonal, affine):
    lab = components.label_components(_pixels(spark, masks), tile=8, diagonal=diagonal)
    rings = polygons.rings_of(polygons.outlines(lab), "image_id", affine)
    return polygons.nested(rings, "image_id", cell=5.0, north_up=affine[4] < 0), lab


def test_nested_polygons_burn_back(spark):
    masks = {1: _mask(1), 2: _mask(2), 3: np.zeros((24, 24), bool)}
    for diagonal, affine in ((False, UP), (True, UP), (True, DOWN)):
        got, lab = _polygons(spark, masks, diagonal, affine)
        got = got.persist()
        n = got.count()
        assert sorted(r.build_id for r in got.collect()) == list(range(1, n + 1))
        # every shell with its holes, burnt by itself: each pixel once, and all of its own component
        burnt = polygons.burn(got.select("build_id", F.array("polygon").alias("p")), "build_id", affine, 24, 24, None, "p")
        back = burnt.join(got.select("build_id", "image_id", "component"), "build_id").select("image_id", "component", "row", "col")
        want = sorted(tuple(r) for r in lab.select("image_id", "component", "row", "col").collect())
        assert sorted(tuple(r) for r in back.collect()) == want
        if not diagonal:
            assert n == lab.select("image_id", "component").distinct().count()
        got.unpersist()


def test_no_rings(spark):
    got, _ = _polygons(spark, {1: np.zeros((4, 4), bool)}, False, UP)
    assert got.count() == 0


def test_runs_of_holes_and_parts(spark):
    def ring(*p):
        return [{"x": float(x), "y": float(y)} for x, y in p]

    shell, hole = ring((0, 0), (8, 0), (8, 6), (0, 6), (0, 0)), ring((2, 1), (5, 1), (5, 4), (2, 4), (2, 1))
    part, slope = ring((9, 1), (12, 1), (12, 3), (9, 3), (9, 1)), ring((0, 0), (6, 0), (0, 6), (0, 0))
    rows = [(1, [[shell, hole], [part]], "x"), (2, [[slope]], "x"), (3, None, "x"), (4, [], "x"), (5, [[[]]], "x")]
    df = spark.createDataFrame(rows, "id int, p array<array<array<struct<x:double,y:double>>>>, row string")
    affine = (1.0, 0.0, 0.0, 0.0, -1.0, 6.0)
    got = {(r.id, r.row, r.c0, r.c1) for r in polygons.burn_spans(df, "id", affine, 6, 11, None, "p").collect()}
    want = {(1, r, 0, 7) for r in (0, 1, 5)} | {(1, r, a, b) for r in (2, 3, 4) for a, b in ((0, 1), (5, 7))}
    want |= {(1, r, 9, 10) for r in (3, 4)}  # cut at the edge of the raster
    # centres on the slanted side count as outside
    want |= {(2, r, 0, r - 1) for r in range(1, 6)}
    assert got == want
