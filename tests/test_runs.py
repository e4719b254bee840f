"""Run-length masks against sets of pixels."""

import random

from geoctx.operators import runs


def test_runs_against_pixel_sets(spark):
    rnd, rows = random.Random(3), []
    for image in (1, 2):
        for row in range(6):
            gt, pred = rnd.randint(0, 2), rnd.randint(0, 2)
            for col in range(-5, 600):
                gt = rnd.choice([0, 1, 2, 255, None]) if rnd.random() < 0.05 else gt
                pred = rnd.randint(0, 2) if rnd.random() < 0.05 else pred
                if rnd.random() < 0.98:  # missing pixels
                    rows.append((image, row, col, gt, pred))
    df = spark.createDataFrame(rows, "image_id int, row int, col int, gt int, pred int")
    coded = runs.instance_runs(df)
    got = sorted((r.image_id, r.cls, r.row, r.col) for r in runs.pixels(coded).collect())
    assert got == sorted((i, g, r, c) for i, r, c, g, _ in rows if g not in (255, None))
    spans = sorted((r.image_id, r.row, r.cls, r.start, r.stop) for r in coded.collect())
    assert all(a[:3] != b[:3] or a[4] + 1 < b[3] for a, b in zip(spans, spans[1:]))  # as long as they can be
    valid = [(i, r, c, g, p) for i, r, c, g, p in rows if g not in (255, None)]
    for r in runs.class_areas(df).collect():
        t = {(a, b) for i, a, b, g, _ in valid if (i, g) == (r.image_id, r.cls)}
        f = {(a, b) for i, a, b, _, p in valid if (i, p) == (r.image_id, r.cls)}
        assert (r.inter, r.union_area, r.pred_area, r.label_area) == (len(t & f), len(t | f), len(f), len(t))


def test_empty_and_touching(spark):
    assert runs.class_areas(spark.createDataFrame([], "image_id int, row int, col int, gt int, pred int")).collect() == []
    some = spark.createDataFrame([(1, 0, 0, 3), (1, 0, 4, 6), (1, 0, 2, 5), (1, 0, 8, 9), (1, 0, 8, 9)], "image_id int, row int, start int, stop int")
    assert sorted(tuple(r)[2:] for r in runs.union(some, ["image_id"]).collect()) == [(0, 6), (8, 9)]
