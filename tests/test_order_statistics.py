"""Quantiles of many groups, the map side of a best-n, packed lists of unequal length, buckets of ranks."""

import numpy as np
import pytest
from pyspark.errors import PySparkException
from pyspark.sql import functions as F

from geoctx.operators import context, lookup, ranking, sampling

PROBS = [0.0, 0.1, 0.25, 0.5, 0.9, 1.0]


def test_quantiles_of_crowded_and_small_groups(spark):
    rng = np.random.default_rng(5)
    groups = {"hot": rng.normal(size=4000), "ties": rng.integers(0, 3, 500).astype(float), "one": np.array([7.5]), None: np.array([1.0, 4.0])}
    rows = [(g, "b", float(v), "x") for g, vs in groups.items() for v in vs] + [("hot", "b", None, "x"), ("none", "b", None, "x")]
    df = spark.createDataFrame(rows, "g string, h string, freq double, _k string").repartition(6)  # names the operator uses itself
    got = {r.g: r.quantiles for r in ranking.order_statistics(df, ["g", "h"], "freq", PROBS).collect()}
    assert got.keys() == groups.keys()
    for g, vs in groups.items():
        assert got[g] == pytest.approx(np.quantile(vs, PROBS).tolist(), abs=1e-12)
    whole = ranking.order_statistics(df, [], "freq", PROBS).collect()
    assert len(whole) == 1 and whole[0].quantiles == pytest.approx(np.quantile(np.concatenate(list(groups.values())), PROBS).tolist())
    assert ranking.order_statistics(df.where("freq IS NULL"), ["g"], "freq", PROBS).count() == 0
    assert sampling.quantile_edges(df.limit(0), "freq") == []
    with pytest.raises(ValueError, match="between"):
        ranking.order_statistics(df, [], "freq", [1.5])


def test_no_percentile_and_no_list_in_the_plan(spark):
    df = spark.range(1000).select((F.col("id") % 3).alias("g"), F.col("id").cast("double").alias("v"))
    plan = ranking.order_statistics(df, ["g"], "v", [0.5])._jdf.queryExecution().toString().lower()
    assert "percentile" not in plan and "collect_" not in plan


def test_best_and_counts(spark):
    rng = np.random.default_rng(2)
    rows = [(int(rng.choice([1, 1, 1, 2, 3])), float(rng.integers(0, 9)), i) for i in range(700)] + [(None, 1.0, 900), (None, None, 901), (1, None, 902)]
    df = spark.createDataFrame(rows, "k int, d double, i int").repartition(4)
    out = context.best_and_counts(df, ["k"], ["d", "i"], 5).collect()
    keys = {r[0] for r in rows}
    size = {k: sum(r[0] == k for r in rows) for k in keys}
    assert {k: sum(r._count for r in out if r.k == k) for k in keys} == size
    order = lambda r: (r[0] is not None, r[0] or 0.0, r[1])
    for k in keys:
        want = sorted([(r[1], r[2]) for r in rows if r[0] == k], key=order)[:5]
        assert sorted([(r.d, r.i) for r in out if r.k == k], key=order)[:5] == want
    assert context.best_and_counts(df.limit(0), ["k"], ["d", "i"], 5).count() == 0


def test_tier_sample_reads_the_pairs_once(spark):
    pairs = spark.range(100).select((F.col("id") % 7).alias("build_id"), F.col("id").alias("poi_id"), F.col("id").cast("double").alias("dist"))
    plan = context.tier_sample(pairs, ranking.portable_key(F.col("poi_id")))._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("Range (0, 100") == 1


def test_lists_of_unequal_length(spark):
    df = spark.createDataFrame([(1, "a?b", "c?d"), (2, "a", "c?d"), (3, None, ""), (4, None, "x")], "id int, t string, l string")
    packed = {"t": "t", "l": "l"}
    assert [(r.id, r.n_t, r.n_l) for r in lookup.list_violations(df, packed).orderBy("id").collect()] == [(2, 1, 2), (4, 0, 1)]
    assert lookup.require_aligned(df.where("id IN (1, 3)"), packed).count() == 2
    with pytest.raises(PySparkException, match="unequal length"):
        lookup.require_aligned(df, packed).count()
