"""Neighbourhoods behind a halo exchange: every operator against whole planes, with tiles much smaller than the image."""

import math
import random
from collections import Counter

import pytest

from geoctx.operators import halo, raster

H, W = 23, 31


def image(seed, share):
    rng = random.Random(seed)
    return {(r, c) for r in range(H) for c in range(W) if rng.random() < share}


def table(spark, planes):
    return spark.createDataFrame([(k, r, c, 0.5, 7) for k, p in planes.items() for r, c in p], "image_id long, row int, col int, _tr double, _h int").repartition(3)


def around(p, reach):
    return {(r + i, c + j) for r, c in p for i in range(-reach, reach + 1) for j in range(-reach, reach + 1) if 0 <= r + i < H and 0 <= c + j < W}


def kept(p):
    return {(r, c) for r in range(H) for c in range(W) if all((r + i, c + j) in p for i in (-1, 0, 1) for j in (-1, 0, 1) if 0 <= r + i < H and 0 <= c + j < W)}


def places(df, name="image_id"):
    rows = df.collect()
    assert len({tuple(r) for r in rows}) == len(rows)
    out = {}
    for r in rows:
        out.setdefault(r[name], set()).add((r.row, r.col))
    return out


@pytest.mark.parametrize("tile", [3, 4, 16, 256])
def test_masks(spark, tile):
    planes = {1: image(1, 0.3), 2: image(2, 0.85), None: image(3, 0.6), 4: {(0, 0), (H - 1, W - 1)}}
    df = table(spark, planes)
    want = lambda fn: {k: v for k, p in planes.items() if (v := fn(p))}
    assert places(raster.dilate(df, ["image_id"], H, W, 5, tile)) == want(lambda p: around(p, 2))
    assert places(raster.erode(df, ["image_id"], H, W, tile)) == want(kept)
    assert places(raster.closing(df, ["image_id"], H, W, tile)) == want(lambda p: kept(around(p, 1)))


@pytest.mark.parametrize("tile", [3, 8, 256])
def test_labels(spark, tile):
    rng = random.Random(8)
    labels = {k: {(r, c): rng.choice((0, 1, 1, 2, 255)) for r in range(H) for c in range(W) if rng.random() < 0.95} for k in ("a", "b")}
    df = spark.createDataFrame([(k, r, c, v) for k, p in labels.items() for (r, c), v in p.items()], "image_id string, row int, col int, gt int").repartition(4)

    def edge(p):
        known = {at: v for at, v in p.items() if v != 255}
        return {(r, c) for (r, c), v in known.items() if any(known.get((r + i, c + j), v) != v for i, j in ((-1, 0), (0, 1), (1, 1), (1, -1)))}

    assert places(raster.edges(df, "image_id", "gt", tile=tile)) == {k: edge(p) for k, p in labels.items()}
    assert places(raster.dilated_edges(df, "image_id", "gt", H, W, 3, tile=tile)) == {k: around(edge(p), 1) for k, p in labels.items()}
    want = Counter()
    for k, p in labels.items():
        for (r, c), v in p.items():
            for angle, (i, j) in enumerate(raster.GLCM_OFFSETS):
                o = p.get((r + i, c + j), 0)
                if v > 0 and o > 0:
                    want[k, angle, v, o] += 1
                    want[k, angle, o, v] += 1
    assert {(r.image_id, r.angle, r.i, r.j): r.n for r in raster.cooccurrence(df, "image_id", "gt", tile).collect()} == want


@pytest.mark.parametrize("tile", [4, 9, 64])
def test_gradients(spark, tile):
    rng = random.Random(6)
    v = {(r, c): rng.random() * 255 for r in range(16) for c in range(24)}
    df = spark.createDataFrame([(1, r, c, x) for (r, c), x in v.items()], "image_id long, row int, col int, v double").repartition(4)
    got = {(r.by, r.bx): r.hog for r in raster.gradient_histogram(df, "image_id", "v", 16, 24, cell=4, tile=tile).collect()}
    cells = {}
    for (r, c) in v:
        gy = 0 if r in (0, 15) else v[r + 1, c] - v[r - 1, c]
        gx = 0 if c in (0, 23) else v[r, c + 1] - v[r, c - 1]
        angle = math.degrees(math.atan2(gy, gx)) % 180
        cells.setdefault((r // 4, c // 4), [0.0] * 9)[min(int(angle // 20), 8)] += math.hypot(gy, gx) / 16
    for by in range(3):
        for bx in range(5):
            block = [x for a in (0, 1) for b in (0, 1) for x in cells[by + a, bx + b]]
            for clip in (0.2, 9.0):
                n = math.sqrt(sum(x * x for x in block) + 1e-10)
                block = [min(x / n, clip) for x in block]
            assert got[by, bx] == pytest.approx(block, abs=1e-9)
    assert len(got) == 15


def test_pixels_travel_about_once(spark):
    df = spark.range(512 * 512).selectExpr("1L AS image_id", "cast(id div 512 AS int) AS row", "cast(id % 512 AS int) AS col")
    plan = raster.closing(df, ["image_id"], 512, 512)._jdf.queryExecution().toString()
    assert plan.split("== Physical Plan ==")[1].count("Exchange hashpartitioning") == 1
    moved = df.selectExpr("explode(array_distinct(array(floor((row-2)/256), floor(row/256), floor((row+2)/256)))) a", "col").selectExpr("explode(array_distinct(array(floor((col-2)/256), floor(col/256), floor((col+2)/256)))) b").count()
    assert moved < 1.04 * 512 * 512


def test_nothing_and_bad_rows(spark):
    df = spark.createDataFrame([], "image_id long, row int, col int")
    assert raster.closing(df, ["image_id"], 5, 5).collect() == []
    df = spark.createDataFrame([(1, None, 3), (1, 2, None), (1, 2, 2), (1, 2, 2), (1, -4, 9)], "image_id long, row int, col int")
    assert places(raster.dilate(df, ["image_id"], 5, 5)) == {1: {(r, c) for r in (1, 2, 3) for c in (1, 2, 3)}}
    with pytest.raises(ValueError):
        halo.neighbourhoods(df, ["image_id"], {}, 9, lambda w: {}, "row long", tile=8)
