"""Overlap, validity, transfer decisions, rasterising, components and outlines."""

import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from geoctx.functions import geo
from geoctx.operators import components, polygons, transfer
from geoctx.plans.label_transfer import transfer_labels

RING = "ring array<struct<x:double,y:double>>"


def closed(pts):
    return [(float(x), float(y)) for x, y in [*pts, pts[0]]]


def square(x, y, s):
    return closed([(x, y), (x + s, y), (x + s, y + s), (x, y + s)])


def regular(cx, cy, r, n, turn=0.0):
    return closed([(cx + r * math.cos(turn + 2 * math.pi * i / n), cy + r * math.sin(turn + 2 * math.pi * i / n)) for i in range(n)])


L_SHAPE = closed([(0, 0), (10, 0), (10, 4), (4, 4), (4, 10), (0, 10)])


@pytest.mark.parametrize("a, b, area", [
    (square(0, 0, 10), square(5, 5, 10), 25.0),
    (square(0, 0, 10), square(2, 2, 3), 9.0),
    (square(0, 0, 10), square(20, 20, 3), 0.0),
    (square(0, 0, 10), square(10, 0, 10), 0.0),
    (L_SHAPE, square(0, 0, 10), 64.0),
    (L_SHAPE, square(3, 3, 5), 1 * 5 + 1 * 5 - 1),
    (closed([(0, 0), (4, 0), (2, 4)]), closed([(0, 2), (4, 2), (4, 3), (0, 3)]), (2 + 1) / 2),
    (closed([(0, 0), (10, 10), (0, 10)]), closed([(0, 10), (10, 0), (10, 10)]), 25.0),
])
def test_overlap_area(a, b, area):
    (ax, ay), (bx, by) = (np.array(r).T for r in (a, b))
    assert polygons._overlap_area(ax, ay, bx, by) == pytest.approx(area)
    assert polygons._overlap_area(bx, by, ax[::-1], ay[::-1]) == pytest.approx(area)


def test_overlap_area_against_sampling():
    rnd = np.random.default_rng(0)
    for i in range(5):
        a = np.array(regular(0, 0, 5, 5 + i, i)).T
        b = np.array(regular(2, 1, 4, 9 - i, 2 * i)).T
        pts = rnd.uniform(-7, 7, size=(60000, 2))

        def inside(r, p):
            x, y = p[:, 0, None], p[:, 1, None]
            x0, y0, x1, y1 = r[0][:-1], r[1][:-1], r[0][1:], r[1][1:]
            return (((y0 > y) != (y1 > y)) & (x < x0 + (y - y0) * (x1 - x0) / (y1 - y0))).sum(axis=1) % 2 == 1

        want = (inside(a, pts) & inside(b, pts)).mean() * 14 * 14
        assert polygons._overlap_area(a[0], a[1], b[0], b[1]) == pytest.approx(want, rel=0.03)


def test_validity(spark):
    bowtie = closed([(0, 0), (10, 10), (10, 0), (0, 10)])
    rows = [(1, square(0, 0, 5)), (2, bowtie), (3, closed([(0, 0), (5, 0)])), (4, closed([(0, 0), (5, 0), (9, 0)])), (5, None), (6, L_SHAPE),
            (7, [(0.0, 0.0), (5.0, 5.0), (5.0, 0.0), (0.0, 6.0), (0.0, 0.0)])]
    got = {r.id: r.valid for r in polygons.with_validity(spark.createDataFrame(rows, f"id int, {RING}")).collect()}
    assert got == {1: True, 2: False, 3: False, 4: False, 5: False, 6: True, 7: False}


def test_polygon_transfer_statuses(spark):
    ours = [(1, square(0, 0, 10)), (2, square(1000, 0, 10)), (3, closed([(500, 0), (510, 10), (510, 0), (500, 10)])),
            (4, closed([(2000, 0), (2010, 0), (2000, 10)])), (5, square(3000, 0, 10)), (6, square(4000, 0, 10))]
    theirs = [(10, 3, square(0, 0, 10)), (11, 4, square(8, 8, 10)), (12, 5, closed([(2010, 10), (2010, 2), (2002, 10)])),
              (13, 6, square(3006, 0, 10)), (14, 1, square(4000, 0, 10)), (15, 2, square(4000, 0, 10))]
    a = spark.createDataFrame(ours, f"build_id long, {RING}")
    b = spark.createDataFrame(theirs, f"cand_id long, func int, {RING}")
    got = {r.build_id: (r.status, r.matched_func) for r in transfer_labels(a, b).collect()}
    assert got == {1: ("Auto_Match", 3), 2: ("No_Match", None), 3: ("Invalid_Geometry", None),
                   4: ("No_Intersect_Precise", None), 5: ("Low_Score_Check", None), 6: ("Conflict_Ambiguous", None)}


def test_polygon_path_agrees_with_rectangle_path(spark):
    from geoctx import fixtures as fx

    d = "/root/testdata/sf0.001"
    ours, theirs = fx.buildings(spark, d), fx.candidates(spark, d)
    ring = geo.ring_of_rect("minx", "miny", "maxx", "maxy").alias("ring")
    by_box = sorted(map(tuple, transfer_labels(ours, theirs, "SH").collect()))
    by_ring = sorted(tuple(r) for r in transfer_labels(ours.select("build_id", ring), theirs.select("cand_id", "func", ring), "SH").select(
        "build_id", "matched_func", "status", "match_score", "match_info").collect())
    assert by_box == by_ring and by_box[0][0].startswith("SH_")


@pytest.mark.parametrize("scores, status", [
    ([0.60], "Low_Score_Check"), ([0.600001], "Auto_Match"), ([0.90, 0.85], "Auto_Match"), ([0.90, 0.851], "Conflict_Ambiguous"),
    ([0.5, 0.49], "Low_Score_Check"),
])
def test_decision_thresholds(spark, scores, status):
    rows = [(1, i, i + 1, s, 0.5, 0.5, 1.0) for i, s in enumerate(scores)]
    df = spark.createDataFrame(rows, "build_id long, cand_id long, func int, score double, iou double, overlap double, cdist double")
    row = transfer.decide(df, "build_id", "cand_id", "func").first()
    assert row.status == status and row.matched_func == (1 if status == "Auto_Match" else None)


def test_score_ties_keep_the_lower_candidate(spark):
    rows = [(1, 9, 9, 0.9, 0.5, 0.5, 1.0), (1, 4, 4, 0.9, 0.5, 0.5, 1.0), (1, 5, 5, 0.2, 0.5, 0.5, 1.0)]
    df = spark.createDataFrame(rows, "build_id long, cand_id long, func int, score double, iou double, overlap double, cdist double")
    row = transfer.decide(df, "build_id", "cand_id", "func").first()
    assert row.match_info == "Ambiguous: Top1(0.90) vs Top2(0.90)"


def test_merge_layers_ignores_start_and_direction(spark):
    sq = square(0, 0, 5)
    turned = sq[2:-1] + sq[:3]
    a = spark.createDataFrame([(1, sq), (2, L_SHAPE)], f"id long, {RING}")
    b = spark.createDataFrame([(3, turned), (4, list(reversed(turned))), (5, square(1, 0, 5))], f"id long, {RING}")
    assert sorted(r.id for r in polygons.merge_layers([a, b], "id").collect()) == [1, 2, 5]


def test_wkt_round_trip(spark):
    df = spark.createDataFrame([(L_SHAPE,)], RING)
    back = df.select(geo.ring_from_wkt(geo.ring_to_wkt("ring")).alias("ring")).first().ring
    assert [tuple(p) for p in back] == L_SHAPE


def test_burn_uses_pixel_centres(spark):
    df = spark.createDataFrame([(1, closed([(0, 0), (6, 0), (0, 6)])), (2, square(2.6, 2.6, 1.0)), (3, square(50, 50, 3))], f"id long, {RING}")
    got = {(r.id, r.row, r.col) for r in polygons.burn(df, "id", (1.0, 0.0, 0.0, 0.0, -1.0, 10.0), 10, 10).collect()}
    want = {(1, 9 - y, x) for x in range(10) for y in range(10) if x + 0.5 + y + 0.5 < 6} | {(2, 6, 3)}
    assert got == want


# ---- components --------------------------------------------------------------------

def flood(cells, diagonal):
    cells, out = set(cells), {}
    for start in sorted(cells):
        if start in out:
            continue
        stack, members = [start], {start}
        while stack:
            r, c = stack.pop()
            for dr in (-1, 0, 1):
                for dc in (-1, 0, 1):
                    n = (r + dr, c + dc)
                    if n in cells and n not in members and (diagonal or abs(dr) + abs(dc) == 1):
                        members.add(n)
                        stack.append(n)
        for m in members:
            out[m] = start[0] * (1 << 24) + start[1]
    return out


def spiral(n):
    """One long winding component: the hardest case for labels that travel."""
    cells, r, c, dr, dc, seen = [], 0, 0, 0, 1, set()
    for _ in range(n * n):
        cells.append((r, c))
        seen.add((r, c))
        ahead, two = (r + dr, c + dc), (r + 2 * dr, c + 2 * dc)
        if not (0 <= ahead[0] < n and 0 <= ahead[1] < n) or two in seen:
            dr, dc = dc, -dr
            ahead, two = (r + dr, c + dc), (r + 2 * dr, c + 2 * dc)
            if not (0 <= ahead[0] < n and 0 <= ahead[1] < n) or two in seen or ahead in seen:
                break
        r, c = ahead
    return cells


@pytest.mark.parametrize("diagonal", [False, True])
def test_components_across_seams(spark, diagonal):
    rnd = random.Random(2)
    cells = [(r, c) for r in range(24) for c in range(24) if rnd.random() < 0.5]
    images = {1: cells, 2: spiral(20)}
    df = spark.createDataFrame([(k, r, c) for k, v in images.items() for r, c in v], "image_id long, row int, col int")
    got = {(r.image_id, r.row, r.col): r.component for r in components.label_components(df, tile=4, diagonal=diagonal).collect()}
    want = {(k, *p): lab for k, v in images.items() for p, lab in flood(v, diagonal).items()}
    assert got == want


def test_single_component_is_required(spark):
    df = spark.createDataFrame([(1, 0, 0), (1, 0, 1), (2, 0, 0), (2, 5, 5)], "image_id long, row int, col int")
    stats = components.component_stats(components.label_components(df, tile=4, diagonal=True))
    ok = components.require_single(stats.where("image_id = 1")).first()
    assert (ok.area, ok.row, ok.col) == (2, 0.0, 0.5)
    with pytest.raises(Exception, match="more than one component"):
        components.require_single(stats).collect()


def test_outline_of_a_ring_and_of_diagonal_neighbours(spark):
    donut = [(r, c) for r in range(5) for c in range(5) if not (1 <= r <= 3 and 1 <= c <= 3)]
    pinch = [(0, 0), (0, 1), (1, 0), (1, 2), (2, 1), (2, 2), (0, 2), (2, 0)]  # a 3 x 3 ring around one hole
    rows = [(1, r, c) for r, c in donut] + [(2, r, c) for r, c in pinch] + [(3, 0, 0), (3, 1, 1)]
    df = spark.createDataFrame(rows, "image_id long, row int, col int")
    lab = components.label_components(df, tile=2)
    rings = polygons.rings_of(polygons.outlines(lab), "image_id", (1.0, 0.0, 0.0, 0.0, 1.0, 0.0))
    got = sorted((r.image_id, len(r.outline), abs(r.area)) for r in rings.withColumn("area", geo.ring_signed_area("outline")).collect())
    assert got == [(1, 5, 9.0), (1, 5, 25.0), (2, 5, 1.0), (2, 5, 9.0), (3, 5, 1.0), (3, 5, 1.0)]


def test_burning_an_outline_gives_the_pixels_back(spark):
    rnd = random.Random(7)
    cells = {(r, c) for r in range(10) for c in range(10) if rnd.random() < 0.55}
    df = spark.createDataFrame([(1, r, c) for r, c in cells], "image_id long, row int, col int")
    rings = polygons.rings_of(polygons.outlines(components.label_components(df, tile=4)), "image_id", (1.0, 0.0, 0.0, 0.0, -1.0, 10.0))
    burnt = polygons.burn(rings.withColumn("rid", F.monotonically_increasing_id()), "rid", (1.0, 0.0, 0.0, 0.0, -1.0, 10.0), 10, 10, "outline")
    odd = {(r.row, r.col) for r in burnt.groupBy("row", "col").count().where("count % 2 = 1").collect()}
    assert odd == cells


def test_rings_inside_a_tile_need_no_rounds_and_those_over_seams_are_the_same(spark):
    rng = np.random.default_rng(11)
    snake = [(r, c) for r in range(11) for c in range(11) if r % 2 == 0 or (c == 10 if r % 4 == 1 else c == 0)]
    rows = [(f"i{i}", r, c) for i in range(3) for r in range(11) for c in range(11) if rng.random() < 0.6] + [("s", r, c) for r, c in snake]
    rows += [("d", r, c) for r, c in [(2, 2), (2, 2), (3, 3), (2, 3), (7, 0)]] + [(None, 0, 0)]
    df = spark.createDataFrame(rows, "image_id string, row int, col int")
    for diagonal in (False, True):
        lab = components.label_components(df, tile=4, diagonal=diagonal).localCheckpoint()
        whole = sorted(map(tuple, polygons.outlines(lab, rounds=0).collect()))
        sides = {(r.image_id, r.component): 0 for r in lab.collect() if r.image_id}
        assert {v[:2] for v in whole} == set(sides)
        at = {}
        for image, component, ring, pos, r, c in whole:
            at.setdefault((image, component, ring), []).append((pos, r, c))
        for (_, _, ring), points in at.items():  # corners in order, the first side's start is the ring's number, the last is its end
            turns = [(r, c) for _, r, c in points]
            steps = [abs(a[0] - b[0]) + abs(a[1] - b[1]) for a, b in zip(turns, turns[1:] + turns[:1])]
            assert all((a[0] == b[0]) != (a[1] == b[1]) for a, b in zip(turns, turns[1:] + turns[:1]))
            assert steps[:-1] == [b[0] - a[0] for a, b in zip(points, points[1:])] and points[-1][0] <= -1
        for tile in (1, 3, 5):
            assert sorted(map(tuple, polygons.outlines(lab, tile=tile).collect())) == whole


def test_components_on_wide_rasters_and_text_keys(spark):
    from geoctx.operators.components import label_components

    rows = [("SH_1", 0, 2**24 - 1), ("SH_1", 1, 0), ("SH_1", 1, 2**24), ("SH_1", 0, 2**24), ("NJ_2", 5, 5)]
    df = spark.createDataFrame(rows, "image_id string, row int, col int")
    got = {(r.image_id, r.row, r.col): r.component for r in label_components(df, tile=512).collect()}
    assert got["SH_1", 0, 2**24 - 1] == got["SH_1", 0, 2**24] == got["SH_1", 1, 2**24]
    assert got["SH_1", 1, 0] not in (got["SH_1", 0, 2**24 - 1], got["NJ_2", 5, 5])
    with pytest.raises(ValueError):
        label_components(df, width=1 << 24)


def test_components_are_dealt_to_tasks_by_rows(spark, monkeypatch):
    """Tasks grow with the pixels and not with the size of files; labels stay the same."""
    from geoctx.operators import components as co

    rng = np.random.default_rng(8)
    px = [(i, r, c) for i in range(6) for r in range(12) for c in range(12) if rng.random() < 0.6]
    df = spark.createDataFrame(px, "image_id long, row int, col int")
    whole = set(co.label_components(df, tile=4, diagonal=True).collect())
    monkeypatch.setattr(co, "TASK_ROWS", 10)
    assert set(co.label_components(df, tile=4, diagonal=True).collect()) == whole
    local = df.withColumn("local", (F.col("row") * 100 + F.col("col")).cast("long"))
    for n in (500, 5000):
        plan = co._seam_pairs(local, "image_id", 4, True, n)._jdf.queryExecution().executedPlan().toString()
        assert plan.count("REPARTITION_BY_NUM") == 3 and f", {n // 10})" in plan and f", {n * 4 // 10})" in plan
