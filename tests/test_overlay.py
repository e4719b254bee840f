"""Overlay of features with holes and parts: against single-pair geometry, rasters of unit cells, and odd shapes."""

import random

import numpy as np
import pytest

from geoctx.operators import overlay as ov
from geoctx.operators import polygons


def edges_of(rings):
    return np.concatenate([np.hstack([np.array(r[:-1], float), np.array(r[1:], float)]) for r in rings]) if rings else np.zeros((0, 4))


def batch(pairs):
    a, b = [edges_of(p) for p, _ in pairs], [edges_of(q) for _, q in pairs]
    stack = lambda parts: (np.concatenate(parts), np.repeat(np.arange(len(parts)), [len(p) for p in parts]))
    (ea, pa), (eb, pb) = stack(a), stack(b)
    return ov.overlay(ea, eb, pa, pb, len(pairs))


def star(rng, cx, cy, size):
    angle = sorted(rng.random() * 6.283 for _ in range(rng.randint(3, 12)))
    ring = [(cx + (r := size * (0.2 + rng.random())) * np.cos(t), cy + r * np.sin(t)) for t in angle]
    return [*ring, ring[0]]


@pytest.mark.parametrize("cells", [2_000_000, 7])
def test_single_rings_match_pairwise_geometry(monkeypatch, cells):
    monkeypatch.setattr(ov, "CELLS", cells)
    rng = random.Random(3)
    pairs = [([star(rng, 0, 0, 5)], [star(rng, rng.uniform(-8, 8), rng.uniform(-8, 8), rng.choice((1, 5)))]) for _ in range(150)]
    touch, area = batch(pairs)
    for i, ((a,), (b,)) in enumerate(pairs):
        ax, ay, bx, by = *np.array(a).T, *np.array(b).T
        want = polygons._overlap_area(ax, ay, bx, by)
        assert area[i] == pytest.approx(want, abs=1e-9)
        assert touch[i] == polygons._touch(ax, ay, bx, by)


def rect(x1, y1, x2, y2):
    return [(x1, y1), (x2, y1), (x2, y2), (x1, y2), (x1, y1)]


@pytest.mark.parametrize("cells", [2_000_000, 11])
def test_holes_and_parts_match_unit_cells(monkeypatch, cells):
    monkeypatch.setattr(ov, "CELLS", cells)
    rng = random.Random(4)

    def feature():
        rings, cover = [], set()
        for part in range(rng.randint(1, 3)):
            x, y, w, h = 10 * part + rng.randint(0, 3), rng.randint(0, 5), rng.randint(1, 6), rng.randint(1, 6)
            rings.append(rect(x, y, x + w, y + h))
            cover |= {(i, j) for i in range(x, x + w) for j in range(y, y + h)}
            if w > 2 and h > 2:
                hole = x + 1, y + 1, x + rng.randint(2, w - 1), y + rng.randint(2, h - 1)
                rings.append(rect(*hole)[::-1])
                cover -= {(i, j) for i in range(hole[0], hole[2]) for j in range(hole[1], hole[3])}
        return rings, cover

    made = [(feature(), feature()) for _ in range(200)]
    touch, area = batch([(a, b) for (a, _), (b, _) in made])
    for i, ((_, a), (_, b)) in enumerate(made):
        assert area[i] == pytest.approx(len(a & b), abs=1e-9)
        closed = any(abs(p[0] - q[0]) <= 1 and abs(p[1] - q[1]) <= 1 for p in a for q in b)
        assert touch[i] == closed


def test_special_places():
    frame = [rect(0, 0, 9, 9), rect(3, 3, 6, 6)[::-1]]
    pairs = [
        (frame, [rect(4, 4, 5, 5)]),  # in the hole, apart
        (frame, [rect(3, 3, 6, 6)]),  # fills the hole
        (frame, [rect(1, 1, 2, 2)]),  # inside, no boundary met
        (frame, frame), (frame, [rect(20, 0, 30, 9)]), (frame, [rect(9, 9, 12, 12)]), (frame, []), ([], []),
    ]
    touch, area = batch(pairs)
    assert touch.tolist() == [False, True, True, True, False, True, False, False]
    assert area == pytest.approx([0, 0, 1, 72, 0, 0, 0, 0])


def test_many_corners_in_few_pairs(monkeypatch):
    monkeypatch.setattr(ov, "CELLS", 50_000)
    angle = np.linspace(0, 2 * np.pi, 3_001)
    ring = lambda x: [*map(tuple, np.stack([x + np.cos(angle), np.sin(angle)], axis=1))]
    circle = ring(0.0)
    circle[-1] = circle[0]
    other = ring(1.0)
    other[-1] = other[0]
    touch, area = batch([([circle], [other])])
    assert touch[0] and area[0] == pytest.approx(2 * np.pi / 3 - np.sqrt(3) / 2, abs=1e-5)


def test_features_in_tables(spark):
    kind = "polygons array<array<array<struct<x:double,y:double>>>>"
    box = lambda *at: [dict(zip(("x", "y"), map(float, p))) for p in rect(*at)]
    ours = spark.createDataFrame(
        [(1, [[box(0, 0, 9, 9), box(3, 3, 6, 6)]]), (2, [[box(0, 0, 2, 2)], [box(100, 0, 104, 4)]]), (3, None), (4, []), (5, [[box(0, 0, 9, 0)]]), (6, [[box(500, 500, 501, 501)]])],
        f"build_id long, {kind}")
    theirs = spark.createDataFrame([(10, "res", [[box(4, 4, 5, 5)]]), (11, "pub", [[box(100, 0, 104, 4)]]), (12, "pub", None)], f"cand_id long, func string, {kind}")
    got = {r.build_id: (r.status, r.matched_func) for r in ov.transfer_features(ours, theirs).collect()}
    assert got == {1: ("No_Intersect_Precise", None), 2: ("Auto_Match", "pub"), 3: ("Invalid_Geometry", None), 4: ("Invalid_Geometry", None), 5: ("Invalid_Geometry", None), 6: ("No_Match", None)}
    rows = {r.build_id: r.of for r in ov.with_measures(ours.where("build_id < 3")).collect()}
    assert tuple(rows[2]) == pytest.approx((20, (4 * 1 + 16 * 102) / 20, (4 * 1 + 16 * 2) / 20))
    assert tuple(rows[1]) == pytest.approx((72, 4.5, 4.5))


def test_only_edges_in_the_common_box_are_compared(monkeypatch):
    """Combs whose boxes share a corner: every edge of one met every edge of the other, and every height cut all of them."""
    teeth = lambda x, y: [rect(x + 2 * i, y, x + 2 * i + 1, y + 9) for i in range(50)]
    seen = []
    meet = ov._meetings
    monkeypatch.setattr(ov, "_meetings", lambda a, b, *rest: (seen.append((len(a), len(b))), meet(a, b, *rest))[1])
    pairs = [(teeth(0, 0), teeth(98, 8)), (teeth(0, 0), teeth(99, 0)), (teeth(0, 0), teeth(0, 20))]
    touch, area = batch(pairs)
    assert touch.tolist() == [True, True, False] and area == pytest.approx([1, 0, 0])
    assert max(seen[0]) < 20  # of 600
    assert batch([([], teeth(0, 0)), (teeth(0, 0), [])])[0].tolist() == [False, False]


def test_features_are_measured_once(spark):
    """What makes the features stood in the sizes of boxes, and on both sides of the join, each time anew."""
    box = "array(array(array(struct(d as x, d as y), struct(d + 3 as x, d as y), struct(d + 3 as x, d + 3 as y), struct(d as x, d as y))))"
    ours, theirs = (spark.range(6).selectExpr(f"id as {k}", "cast(id * 2 as double) as d").selectExpr(k, f"{box} as polygons") for k in ("build_id", "cand_id"))
    scored = ov.candidate_features(ours, theirs)
    plan = scored._jdf.queryExecution().executedPlan().toString()
    assert "Range (" not in plan and "aggregate(" not in plan
    assert {(r.build_id, r.cand_id) for r in scored.where("touch").collect()} == {(i, j) for i in range(6) for j in range(6) if abs(i - j) < 2}
