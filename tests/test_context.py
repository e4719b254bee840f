"""Nearest points, bands, prompts, tier sampling: hand cases, brute force, crowded places."""

import math
import random

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import Window
from pyspark.sql import functions as F

from geoctx import fixtures as fx
from geoctx.functions import geo, text
from geoctx.operators import context, ranking
from geoctx.operators.spatial_join import Best, nearest_k, radius_join
from geoctx.plans.context_corpus import context_prompts


def pairs_of(spark, dists_types, build_id=1):
    rows = [(build_id, i, i + 1, float(d), t) for i, (d, t) in enumerate(dists_types)]
    return context.with_bands(spark.createDataFrame(rows, "build_id long, poi_id long, rk int, dist double, type_en string"))


def prompt(spark, dists_types, words=text.DENSITY_WORDS_VIVID, min_count=1):
    rows = context.prompts(pairs_of(spark, dists_types), words=words, min_count=min_count).collect()
    return rows[0].prompt if rows else None


def test_band_edges(spark):
    d = spark.createDataFrame([(x,) for x in (99.9, 100.0, 100.1, 200.0, 200.1, 300.0)], "dist double")
    assert [r[0] for r in d.select(geo.distance_band("dist")).collect()] == ["100", "100", "200", "200", "300", "300"]


@pytest.mark.parametrize("count, plain, vivid", [
    (0, "is empty", "is empty"), (1, "has few", "is sparsely featured with"), (3, "has few", "is sparsely featured with"),
    (4, "has some", "is dotted with"), (20, "has some", "is dotted with"), (21, "has many", "is filled with"),
    (40, "has many", "is filled with"), (41, "is dense with", "is crowded with"), (80, "is dense with", "is crowded with"),
    (81, "is packed with", "is packed with"),
])
def test_density_ladder(spark, count, plain, vivid):
    rows = [(150.0, "park")] * count + [(250.0, "shop")]
    for words, expected in ((text.DENSITY_WORDS_PLAIN, plain), (text.DENSITY_WORDS_VIVID, vivid)):
        assert f"the nearby area {expected}" in prompt(spark, rows, words)


def test_shares_at_the_thresholds(spark):
    six = [(150.0, "a")] * 6 + [(150.0, "b")] * 4
    assert "primarily a alongside some b" in prompt(spark, six)
    three = [(150.0, "a")] * 3 + [(150.0, x) for x in "bbccdde"]
    assert "a mix of a, b, c, d, and e" in prompt(spark, three)
    two = [(150.0, x) for x in "aabbccddee"]
    assert "a diverse range of a, b, c, d, and e" in prompt(spark, two)
    assert "primarily a." in prompt(spark, [(250.0, "a")] * 5)


def test_plural_label_and_ties_in_first_seen_order(spark):
    p = prompt(spark, [(10.0, "z"), (20.0, "y"), (30.0, "y"), (40.0, "z")])
    assert p.startswith("Urban building context: the immediate surroundings are dotted with a mix of z and y; ")


def test_at_most_five_types_and_minimum_count(spark):
    p = prompt(spark, [(10.0 + i, f"t{i}") for i in range(7)])
    assert "t4" in p and "t5" not in p
    assert prompt(spark, [(10.0, "a"), (20.0, "b")], min_count=3) is None


def test_prompt_parts(spark):
    df = spark.createDataFrame([("Urban building context: the a is x; the b is y; the c is z.",)], "p string")
    assert df.select(text.prompt_bands("p")).first()[0] == ["the a is x", "the b is y", "the c is z."]


def test_enumeration(spark):
    rows = [([],), (["a"],), (["a", "b"],), (["a", "b", "c"],)]
    out = [r[0] for r in spark.createDataFrame(rows, "l array<string>").select(text.enumerate_words("l")).collect()]
    assert out == ["", "a", "a and b", "a, b, and c"]


def test_packing(spark):
    df = spark.createDataFrame([("a?b?c",), ("",), (None,)], "s string")
    assert [r[0] for r in df.select(text.packed_count("s")).collect()] == [3, 0, 0]


# ---- tier sampling -----------------------------------------------------------------

def sample(spark, dists):
    rows = [(1, i, float(d)) for i, d in enumerate(dists)]
    df = spark.createDataFrame(rows, "build_id long, poi_id long, dist double")
    out = context.tier_sample(df, ranking.portable_key(F.col("poi_id")))
    return [(r.poi_id, r.tier) for r in out.collect()]


def test_few_points_are_all_kept(spark):
    assert len(sample(spark, [10] * 10 + [300] * 10)) == 20


def test_unused_quota_moves_outwards(spark):
    got = sample(spark, [10, 20, 30, 40] + [150] * 30 + [250] * 30)
    tiers = [t for _, t in got]
    assert (tiers.count("A"), tiers.count("B"), tiers.count("C")) == (4, 11, 5)


def test_last_tier_fills_up_and_300_is_out(spark):
    got = sample(spark, [10] * 3 + [150] * 2 + [250] * 12 + [300] * 9)
    tiers = [t for _, t in got]
    assert (tiers.count("A"), tiers.count("B"), tiers.count("C"), tiers.count("-")) == (3, 2, 12, 0)


def test_near_tier_takes_the_nearest(spark):
    got = sample(spark, list(range(1, 61)) + [150] * 10 + [250] * 10)
    assert sorted(i for i, t in got if t == "A") == list(range(10))
    assert len(got) == 20


# ---- joins against brute force ---------------------------------------------------------

def brute(centers, points, radius, k):
    out = set()
    for b, x, y in centers:
        near = []
        for p, px, py, _ in points:
            d = math.sqrt((x - px) * (x - px) + (y - py) * (y - py))
            if d <= radius:
                near.append((d, p))
        out |= {(b, p, i + 1) for i, (_, p) in enumerate(sorted(near)[:k])}
    return out


def crowded(seed):
    """A third of the points at one spot, a third in one small cell, the rest spread; negative coordinates too."""
    rnd = random.Random(seed)
    pts = [(i, 1000.0, 1000.0, "a") for i in range(300)]
    pts += [(300 + i, 1500 + rnd.random() * 5, 1500 + rnd.random() * 5, "b") for i in range(300)]
    pts += [(600 + i, rnd.uniform(-500, 3000), rnd.uniform(-500, 3000), "c") for i in range(300)]
    ctr = [(i, rnd.uniform(-500, 3000), rnd.uniform(-500, 3000)) for i in range(60)]
    ctr += [(100 + i, 1000 + rnd.uniform(-300, 300), 1000 + rnd.uniform(-300, 300)) for i in range(40)]
    ctr += [(200 + i, 1502 + rnd.uniform(-10, 10), 1502 + rnd.uniform(-10, 10)) for i in range(40)]
    rnd.shuffle(pts)
    return ctr, pts


@pytest.mark.parametrize("depth", [2, 4, 6])
@pytest.mark.parametrize("k", [1, 7, 50])
def test_nearest_k_in_crowded_places(spark, depth, k):
    ctr, pts = crowded(k)
    c = spark.createDataFrame(ctr, "build_id long, x double, y double")
    p = spark.createDataFrame(pts, "poi_id long, x double, y double, type_en string")
    got = {(r.build_id, r.poi_id, r.rk) for r in nearest_k(c, p, 300.0, k, depth=depth).collect()}
    assert got == brute(ctr, pts, 300.0, k)


def test_bounded_search_forms_far_fewer_pairs(spark):
    from geoctx.operators.spatial_join import _bounded_pairs

    ctr, pts = crowded(1)
    c = spark.createDataFrame([x for x in ctr if x[0] >= 200], "build_id long, x double, y double")
    p = spark.createDataFrame(pts, "poi_id long, x double, y double, type_en string")
    assert _bounded_pairs(c, p, 300.0, 5, 6).count() < radius_join(c, p, 300.0).count()


def test_search_goes_deeper_in_a_crowded_cell(spark):
    """100,000 distinct spots in one cell of the first depth, and centres inside it, at its edge and far away."""
    from geoctx.operators.spatial_join import _candidates

    rng = np.random.default_rng(5)
    xy = np.concatenate([1000 + 9 * rng.random((100_000, 2)), 1000 + 600 * rng.random((500, 2))])
    pts = pd.DataFrame({"poi_id": np.arange(len(xy)), "x": xy[:, 0], "y": xy[:, 1]})
    at = np.concatenate([1000 + 9 * rng.random((60, 2)), [[1009.0, 1009.0], [1012.0, 1000.0], [1030.0, 1030.0], [1400.0, 1400.0], [5000.0, 0.0]]])
    ctr = pd.DataFrame({"build_id": np.arange(len(at)), "x": at[:, 0], "y": at[:, 1]})
    c, p = spark.createDataFrame(ctr), spark.createDataFrame(pts).repartition(8)
    k = 7
    got = {(r.build_id, r.poi_id, r.rk) for r in nearest_k(c, p, 300.0, k).select("build_id", "poi_id", "rk").collect()}
    want = set()
    for i, (x, y) in enumerate(at.tolist()):
        d = np.sqrt((x - xy[:, 0]) ** 2 + (y - xy[:, 1]) ** 2)
        want |= {(i, int(j), n + 1) for n, j in enumerate(np.lexsort((np.arange(len(d)), d))[:k]) if d[j] <= 300.0}
    assert got == want
    inside = _candidates(c.where("build_id < 60"), p, 300.0, k, 4)
    assert inside.groupBy("build_id").count().agg({"count": "max"}).first()[0] < 16 * 9 * 8 * k  # not 100,000


def test_radius_is_inclusive_and_pairs_are_unique(spark):
    c = spark.createDataFrame([(1, 0.0, 0.0)], "build_id long, x double, y double")
    p = spark.createDataFrame([(1, 300.0, 0.0), (2, 0.0, -300.0), (3, 300.0, 0.1), (4, -0.0, 0.0)], "poi_id long, x double, y double")
    assert sorted(r.poi_id for r in radius_join(c, p, 300.0).collect()) == [1, 2, 4]


def test_join_is_no_nested_loop(spark):
    c = spark.createDataFrame([(1, 0.0, 0.0)], "build_id long, x double, y double")
    p = spark.createDataFrame([(1, 300.0, 0.0, "a")], "poi_id long, x double, y double, type_en string")
    plan = context_prompts(c, p)._jdf.queryExecution().executedPlan().toString()
    assert "NestedLoop" not in plan and "Cartesian" not in plan
    assert "WindowGroupLimit" in plan  # ranks are cut before the shuffle


@pytest.mark.parametrize("closed, by, near, slices", [(True, None, None, 1), (False, "h", 1, 1), (False, "h", 1, 4)])
def test_radius_join_keeps_the_best_of_a_range(spark, monkeypatch, closed, by, near, slices):
    """Against all pairs ranked by a window: repeated and missing keys, equal spots, points on edges, slices of a tile."""
    from geoctx.operators import spatial_join as sj

    monkeypatch.setattr(sj, "SLICE_POINTS", 10_000 // slices)
    monkeypatch.setattr(sj, "PART_PAIRS", 400)
    c = spark.range(40).select(F.when(F.col("id") % 9 != 4, F.col("id") % 30).alias("build_id"), (F.col("id") * 37 % 900 - 300.0).alias("x"),
                               F.when(F.col("id") != 7, F.col("id") * 53 % 700 + 0.0).alias("y"))
    p = spark.range(600).select(F.col("id").alias("poi_id"), (F.col("id") * 10 % 970 - 300.0).alias("x"), (F.col("id") * 70 % 610 + 0.0).alias("y"),
                                F.when(F.col("id") % 50 != 3, F.col("id") * 7919 % 101).alias("h"))
    p = p.unionByName(p.where("poi_id = 5").withColumn("x", F.lit(None).cast("double")))
    edges = (100.0, 200.0)
    best = sj.Best(edges, 3, "poi_id", by, near, closed)
    got = radius_join(c, p, 300.0, best)
    at = lambda e: F.col("dist") <= e if closed else F.col("dist") < e
    band = F.when(at(100.0), 0).when(at(200.0), 1).otherwise(2)
    order = F.col("dist") if by is None else F.when(F.col("band") == 0, F.col("dist")).otherwise(F.col("h"))
    w = Window.partitionBy("build_id", "band")
    cut = lambda df: {tuple(r) for r in df.withColumn("r", F.row_number().over(w.orderBy("o", "poi_id", "dist"))).where("r <= 3").select(
        "build_id", "band", "r", "poi_id", "dist", "n").collect()}
    every = radius_join(c, p, 300.0).withColumn("band", band).withColumn("o", order).withColumn("n", F.count(F.lit(1)).over(w))
    ours = got.withColumn("band", band).withColumn("o", order).withColumn("n", F.sum("_count").over(w))
    assert cut(ours) == cut(every)
    assert got.count() <= 40 * 3 * 3 * (slices + 1) < radius_join(c, p, 300.0).count() or slices > 1


def odd_points(spark):
    """Centres with repeated and missing keys, points with repeated and missing places and hashes; lattice, so that many lie on edges."""
    c = spark.range(60).select(F.when(F.col("id") % 9 != 4, F.col("id") % 45).alias("build_id"), (F.col("id") * 37 % 900 - 300.0).alias("x"),
                               F.when(F.col("id") != 7, F.col("id") * 53 % 700 + 0.0).alias("y"))
    p = spark.range(900).select(F.col("id").alias("poi_id"), (F.col("id") * 10 % 970 - 300.0).alias("x"),
                                F.when(F.col("id") != 11, F.col("id") * 70 % 610 + 0.0).alias("y"))
    return c, p.withColumn("h", ranking.portable_key(F.col("poi_id")).cast("double"))


@pytest.mark.parametrize("points, centers", [(1_000_000, 100_000), (300, 5), (40, 3)])
def test_tiers_of_lists_are_those_of_all_pairs(spark, monkeypatch, points, centers):
    """Whole tiles, smaller ones, and cells dealt by points and by centres, against the sample of all pairs."""
    from geoctx.operators import spatial_join as sj

    monkeypatch.setattr(sj, "SLICE_POINTS", points)
    monkeypatch.setattr(sj, "PART_CENTERS", centers)
    monkeypatch.setattr(sj, "PART_PAIRS", 100)
    c, p = odd_points(spark)
    rows = lambda df: sorted(map(tuple, df.select("build_id", "poi_id", "tier").collect()), key=str)
    key = ranking.portable_key(F.col("poi_id"))
    want = rows(context.tier_sample(radius_join(c, p, 300.0), key))
    lists = radius_join(c, p, 300.0, context.tier_best("h"), "build_id", ["poi_id"])
    assert rows(context.tier_sample(lists, key)) == want and {t for *_, t in want} >= {"A", "B", "C"}
    counts = {r.build_id: [v.n for v in r.ranges] for r in lists.collect()}
    d = F.col("dist")
    every = radius_join(c, p, 300.0).groupBy("build_id").agg(*[F.count_if(x) for x in (d < 100, (d >= 100) & (d < 200), (d >= 200) & (d < 300), d >= 300)])
    assert counts == {r[0]: [*r[1:]] for r in every.collect()}


def test_tiers_of_lists_need_no_shuffle(spark):
    c, p = odd_points(spark)
    c = c.dropDuplicates(["build_id"])
    sample = context.tier_sample(radius_join(c, p, 300.0, context.tier_best("h"), "build_id", ["poi_id"]), F.lit(0))
    plan = sample._jdf.queryExecution().executedPlan().toString()
    assert "FlatMapCoGroupsInArrow" in plan
    plan = plan.split("FlatMapCoGroupsInArrow")[0]
    assert "Exchange" not in plan and "Window" not in plan


def test_tiles_are_sized_by_points_and_points_copied_for_full_tasks_only(spark, monkeypatch):
    """Points went to as many tasks as a tile's pairs filled, so that their copies grew with the square of the input."""
    from geoctx.operators import spatial_join as sj

    monkeypatch.setattr(sj, "PART_PAIRS", 1)
    c, p = (df.where("y IS NOT NULL").withColumns({v: F.col(v) * 4 for v in "xy"}) for df in odd_points(spark))
    p = p.withColumnsRenamed({"x": "_px", "y": "_py"})
    for most, cells in ((1_000_000, 16), (200, 4), (5, 1)):
        monkeypatch.setattr(sj, "SLICE_POINTS", most)
        homes, around, _ = sj._sized_tiles(c, p, 300.0)
        tiles = {}
        for r in homes.collect():
            tiles.setdefault((r._tile, r._slices, r._parts), set()).add((r._cx, r._cy))
        assert max(map(len, tiles.values())) <= cells and len(tiles) > 1
        near = sj.with_cell(p, 300.0, "_px", "_py").join(around, ["_cx", "_cy"]).select(F.explode("_t").alias("t")).groupBy("t._tile").count()
        held = dict(map(tuple, near.collect()))
        for (tile, slices, parts), own in tiles.items():
            assert parts == 1 and slices == math.ceil(held[tile] / most)
            assert slices == 1 or len(own) == 1


def test_minimum_count_takes_in_what_lies_behind_the_k_nearest(spark):
    c = spark.createDataFrame([(1, 0.0, 0.0), (2, 5000.0, 0.0), (None, 0.0, 10.0), (3, 0.0, 0.0), (3, 5000.0, 0.0)], "build_id long, x double, y double")
    p = spark.createDataFrame([(i, float(i), 0.0, "a") for i in range(9)] + [(20 + i, 5000.0 + i, 0.0, "b") for i in range(4)], "poi_id long, x double, y double, type_en string")
    lists = context.with_bands(nearest_k(c, p, 300.0, 3, lists=["type_en"]))
    counts = radius_join(c, p.drop("type_en"), 300.0, Best((), 1, "poi_id")).groupBy("build_id").agg(F.sum("_count").alias("n_poi"))
    got = {tuple(r)[:3] for r in context.packed_lists(lists, min_count=5, counts=counts).collect()}
    assert got == {(1, 9, "a?a?a"), (None, 9, "a?a?a"), (3, 13, "a?b?a")}


def test_p10_counts_every_point(spark, tmp_path):
    """A building with 130 points around it counted 100."""
    import __spark_entry__ as entry

    spark.createDataFrame([(1, 0)], "c_custkey long, c_nationkey int").write.parquet(f"{tmp_path}/customer.parquet")
    centre = fx.centers(spark, str(tmp_path)).first()
    near = [k for k in range(200_000) if ((k * 6151) % 9949 - centre.x) ** 2 + ((k * 4219) % 9941 - centre.y) ** 2 <= 90_000][:130]
    spark.createDataFrame([(k, "a") for k in near], "o_orderkey long, o_orderpriority string").write.parquet(f"{tmp_path}/orders.parquet")
    assert [tuple(r) for r in entry.queries()["p10_minimum_points"](spark, str(tmp_path)).collect()] == [(1, 130)]


def test_all_pairs_do_not_pass_a_side_through_the_driver(spark):
    """Centres of a small file, nine times as many in cells, were broadcast and filled the driver's memory."""
    c, p = odd_points(spark)
    plan = radius_join(c, p, 300.0)._jdf.queryExecution().executedPlan().toString()
    assert "SortMergeJoin" in plan and "Broadcast" not in plan
