"""Distributed ranks and order statistics against plain Python, hot keys included."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from geoctx.operators import ordered, ranking, sampling


def test_random_rank_with_a_hot_stratum(spark):
    rows = [("hot" if i % 3 else f"s{i % 7}", i) for i in range(900)]
    df = spark.createDataFrame(rows, "s string, id long")
    key = ranking.portable_key(F.col("id"))
    got = {r.id: r["rank"] for r in ranking.random_rank(df, ["s"], key, "id").collect()}
    for s in {r[0] for r in rows}:
        ids = [i for t, i in rows if t == s]
        order = sorted(ids, key=lambda i: ((i * 2654435761 + 42 * 40503) % 2147483647, i))
        assert [got[i] for i in order] == list(range(1, len(ids) + 1))


@pytest.mark.parametrize("buckets", [1, 3, 64])
def test_ordered_rank(spark, buckets):
    names = [f"n{random.Random(i).randint(0, 10**6):07d}_{i}" for i in range(500)]
    df = spark.createDataFrame([(n,) for n in names], "name string").repartition(5)
    got = {r.name: r["rank"] for r in ranking.ordered_rank(df, ["name"], buckets=buckets).collect()}
    assert got == {n: i + 1 for i, n in enumerate(sorted(names))}


@pytest.mark.parametrize("small", [4, 65536])
def test_kth_smallest(spark, small):
    rnd = random.Random(3)
    values = [rnd.random() for _ in range(400)] + [0.5] * 300
    df = spark.createDataFrame([(v,) for v in values], "v double")
    for k in (0, 1, 199, 350, 698, 699, 5000):
        assert ranking.kth_smallest(df, "v", k, bins=8, small=small) == sorted(values)[min(k, 699)]


def test_kth_smallest_of_nothing(spark):
    assert ranking.kth_smallest(spark.createDataFrame([], "v double"), "v", 3) is None


def test_running_sums(spark):
    rows = [("g" if i % 4 else "h", i / 100, i) for i in range(100)]
    df = spark.createDataFrame(rows, "g string, v double, n long")
    out = ranking.running_sums(df, ["g"], F.floor(F.col("v") * 8), [F.col("v")], {"c": "n"}).collect()
    for g in "gh":
        part = sorted([r for r in out if r.g == g], key=lambda r: r.v)
        assert [r.c for r in part] == list(np.cumsum([r.n for r in part]))


# ---- logs --------------------------------------------------------------------------

def replay(metrics, patience, delta):
    best, best_epoch, bad = -1.0, 0, 0
    for e, m in enumerate(metrics, 1):
        if m > best + delta:
            best, best_epoch, bad = m, e, 0
        else:
            bad += 1
        if bad >= patience:
            break
    return best_epoch, best, e


@pytest.mark.parametrize("patience, delta", [(1, 0.0), (3, 0.0), (3, 0.05), (8, 0.2), (100, 0.0)])
def test_early_stopping(spark, patience, delta):
    runs = {s: [random.Random(s * 100 + i).random() + i * (s % 3) / 60 for i in range(40)] for s in range(12)}
    runs[50] = [0.1 * i for i in range(1, 30)]
    runs[51] = [-5.0] * 20  # never above the starting value
    rows = [(s, i + 1, float(m)) for s, ms in runs.items() for i, m in enumerate(ms)]
    df = spark.createDataFrame(rows, "run int, epoch long, metric double")
    got = {r.run: (r.best_epoch, r.best_metric, r.last_epoch) for r in ordered.early_stopping(df, patience, delta).collect()}
    assert got == {s: replay(ms, patience, delta) for s, ms in runs.items()}


def test_early_stopping_goes_from_block_to_block(spark):
    runs = {s: [random.Random(s).random() + i * s / 200 for i in range(60 + 5 * s)] for s in range(6)}
    rows = [(s, i + 1, float(m)) for s, ms in runs.items() for i, m in enumerate(ms)]
    df = spark.createDataFrame(rows, "run int, epoch long, metric double")
    got = {r.run: (r.best_epoch, r.best_metric, r.last_epoch) for r in ordered.early_stopping(df, 9, 0.03, block=8).collect()}
    assert got == {s: replay(ms, 9, 0.03) for s, ms in runs.items()}


def test_records_and_steps_across_blocks(spark):
    rnd = random.Random(5)
    rows = [(1, i + 1, rnd.random(), rnd.choice([0, 0, i + 1])) for i in range(100)]
    df = spark.createDataFrame(rows, "run int, epoch long, metric double, step long")
    got = sorted(r.epoch for r in ordered.records(df, block=7).collect())
    best, want = -1.0, []
    for _, e, m, _ in rows:
        if m > best:
            best = m
            want.append(e)
    assert got == want
    steps = {r.epoch: r.full_step for r in ordered.carry_step(df, line="epoch", block=7).collect()}
    last, want = 0, {}
    for _, e, _, s in rows:
        last = s or last
        want[e] = last
    assert steps == want


# ---- samples and splits ----------------------------------------------------------------

def index(spark, n=600):
    rnd = random.Random(1)
    rows = [(i, rnd.choice("AB"), 0 if rnd.random() < 0.6 else rnd.randint(1, 6), rnd.randint(3, 12)) for i in range(n)]
    return rows, spark.createDataFrame(rows, "image_id long, city string, fun_cls int, poi_num int")


def test_capped_sample_sizes(spark):
    rows, df = index(spark)
    got = sampling.capped_sample(df, ranking.portable_key(F.col("image_id")), "image_id", caps={0: 100, 1: 5000}).collect()
    by = {c: sum(r.fun_cls == c for r in got) for c in range(7)}
    assert by[0] == 100
    assert all(by[c] == sum(r[2] == c for r in rows) for c in range(1, 7))
    assert len({r.image_id for r in got}) == len(got)


def test_split_is_complete_and_near_its_shares(spark):
    rows, df = index(spark)
    got = sampling.stratified_split(df, ranking.portable_key(F.col("image_id")), "image_id", ["city", "fun_cls"]).collect()
    assert {r.image_id for r in got} == {r[0] for r in rows} and len(got) == len(rows)
    share = {s: sum(r.split == s for r in got) / len(got) for s in ("train", "val", "test")}
    assert share["train"] == pytest.approx(0.6, abs=0.02) and share["val"] == pytest.approx(0.2, abs=0.02)


def test_class_weights_add_up(spark):
    _, df = index(spark)
    w = sampling.class_weights(df).collect()
    assert sum(r.weight for r in w) == pytest.approx(len(w))


def test_quantile_edges_match_numpy(spark):
    rows, df = index(spark)
    want = sorted(set(np.quantile([r[3] for r in rows], np.arange(9) / 8)))[1:-1]
    assert sampling.quantile_edges(df, "poi_num") == pytest.approx(want)


def test_kmeans_edges_are_a_fixed_point(spark):
    values = [1, 1, 2, 10, 11, 12, 30, 31, 32, 33]
    df = spark.createDataFrame([(v,) for v in values], "v int")
    edges = sampling.kmeans_edges(df, "v", 3)
    assert edges == pytest.approx([(4 / 3 + 11) / 2, (11 + 31.5) / 2])


def test_shuffle_is_repeatable(spark):
    _, df = index(spark, 50)
    key = ranking.hash_key(F.col("image_id"))
    one = [r.image_id for r in sampling.shuffled(df, key, "image_id").collect()]
    two = [r.image_id for r in sampling.shuffled(df.repartition(7), key, "image_id").collect()]
    assert one == two != sorted(one)


def test_large_class_samples_agree_with_small_ones(spark):
    rows = [(i, i % 3) for i in range(4000)]
    df = spark.createDataFrame(rows, "id long, c int")
    key = ranking.portable_key(F.col("id"))
    got = sampling.per_class_sample(df, key, "id", "c", 1100).collect()
    order = sorted(range(4000), key=lambda i: ((i * 2654435761 + 42 * 40503) % 2147483647, i))
    want = {i for c in range(3) for i in [j for j in order if j % 3 == c][:1100]}
    assert {r.id for r in got} == want


def test_any_id_has_a_key_in_range(spark):
    ids = [0, 1, -1, 4_000_000_000, -4_000_000_000, 2**62, -(2**63), 2**63 - 1]
    df = spark.createDataFrame([(i,) for i in ids], "id long")
    got = {r.id: r.k for r in df.select("id", ranking.portable_key(F.col("id")).alias("k")).collect()}
    assert got == {i: (i % ranking.KEY_RANGE * 2654435761 + 42 * 40503) % ranking.KEY_RANGE for i in ids}
    assert all(0 <= k < ranking.KEY_RANGE for k in got.values())


def test_sampled_bounds_spread_a_confident_models_errors(spark):
    df = spark.range(20_000).select((F.lit(1e-9) * F.col("id")).alias("err"), "id")
    bounds = ranking.sampled_bounds(df, "err", 64)
    bucket = F.size(F.filter(F.array(*[F.lit(b) for b in bounds]), lambda b: b > F.col("err")))
    most = df.groupBy(bucket.alias("b")).count().agg(F.max("count")).first()[0]
    assert most < 20_000 * 0.06
