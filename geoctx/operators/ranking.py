"""Distributed ranks, order statistics and running sums.

A plain ``row_number`` over one big partition sends the whole partition to one
task. The helpers here cut a partition into buckets that follow the order,
count the buckets (a small table), and rank inside each bucket, so that one
group holding a third of the rows is still spread over many tasks.
"""

from __future__ import annotations

import math

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

KEY_RANGE = 2147483647  # hash keys lie in [0, KEY_RANGE)


def portable_key(id_col: Column, seed: int = 42) -> Column:
    """Pseudo-random key of a numeric id that any SQL engine can repeat.

    The id is reduced before it is multiplied, so that no 64-bit id overflows or leaves the range.
    """
    return (F.pmod(id_col.cast("long"), F.lit(KEY_RANGE)) * F.lit(2654435761) + F.lit(seed * 40503)) % F.lit(KEY_RANGE)


def bucket_count(df: DataFrame, buckets: int | None) -> int:
    """``buckets``, or a few per shuffle partition: it grows with the partitions that a job's size asks for."""
    return buckets or max(16, 4 * int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")))


def hash_key(*cols: Column, seed: int = 42) -> Column:
    """Pseudo-random key of any columns, for when no other engine has to repeat it."""
    return F.pmod(F.xxhash64(*cols, F.lit(seed)), F.lit(KEY_RANGE))


def _prefix(sizes: DataFrame, strata: Sequence[str], value: str, out: str) -> DataFrame:
    w = Window.partitionBy(*strata).orderBy("_bucket").rowsBetween(Window.unboundedPreceding, -1)
    return sizes.withColumn(out, F.coalesce(F.sum(value).over(w), F.lit(0)))


def bucket_rank(
    df: DataFrame, strata: Sequence[str], bucket: Column, order: Sequence[Column], name: str = "rank"
) -> DataFrame:
    """1-based rank of each row in its stratum by ``order``.

    ``bucket`` must not decrease along ``order``; rows are ranked inside
    (stratum, bucket) and shifted by the size of the earlier buckets.
    """
    strata = list(strata)
    keyed = df.withColumn("_bucket", bucket)
    sizes = keyed.groupBy(*strata, "_bucket").agg(F.count(F.lit(1)).alias("_size"))
    offsets = _prefix(sizes, strata, "_size", "_before").drop("_size")
    local = keyed.withColumn(
        "_local", F.row_number().over(Window.partitionBy(*strata, "_bucket").orderBy(*order))
    )
    return (
        local.join(offsets, [*strata, "_bucket"])
        .withColumn(name, (F.col("_local") + F.col("_before")).cast("long"))
        .drop("_local", "_before", "_bucket")
    )


def random_rank(
    df: DataFrame, strata: Sequence[str], key: Column, tie: str, name: str = "rank", buckets: int | None = None
) -> DataFrame:
    """Rank in a stratum by a hash key in [0, KEY_RANGE): equal buckets by construction."""
    buckets = bucket_count(df, buckets)
    keyed = df.withColumn("_key", key)
    width = KEY_RANGE // buckets + 1
    ranked = bucket_rank(
        keyed, strata, F.floor(F.col("_key") / width), [F.col("_key"), F.col(tie)], name
    )
    return ranked.drop("_key")


def _bounds_up_to(bounds: list[Column], key: Column) -> Column:
    """Number of the ascending ``bounds`` at or below ``key``: every n-th of them first, then n, for n their square root."""
    n = math.isqrt(len(bounds) - 1) + 1
    whole = F.size(F.filter(F.array(*bounds[n - 1::n]), lambda b: b <= key)) if len(bounds) >= n else F.lit(0)
    return whole * n + F.size(F.filter(F.slice(F.array(*bounds), whole * n + 1, F.lit(n)), lambda b: b <= key))


def ordered_rank(
    df: DataFrame, order: Sequence[str], name: str = "rank", buckets: int | None = None
) -> DataFrame:
    """1-based rank over the whole table by ``order`` (which must be unique).

    Bucket bounds come from a bounded hash sample of the keys; any sample gives
    the same ranks, a good one gives even buckets.
    """
    buckets = bucket_count(df, buckets)
    key = F.struct(*[F.col(c) for c in order])
    sample = (
        df.select(key.alias("k"), F.xxhash64(*order).alias("h")).orderBy("h").limit(buckets * 8).select("k").collect()
    )
    keys = sorted(tuple(r.k) for r in sample)
    step = max(1, len(keys) // buckets)
    listed = [F.struct(*[F.lit(v).alias(c) for v, c in zip(k, order)]) for k in keys[step::step]]
    bucket = _bounds_up_to(listed, key) if listed else F.lit(0)
    return bucket_rank(df, [], bucket, [F.col(c) for c in order], name)


def sampled_bounds(df: DataFrame, value: str, buckets: int | None = None) -> list[float]:
    """Values that cut ``value`` into about equally full ranges, from a bounded hash sample of distinct values' rows."""
    buckets = bucket_count(df, buckets)
    sample = df.select(value, F.xxhash64(*df.columns).alias("h")).where(F.col(value).isNotNull()).orderBy("h").limit(buckets * 8).collect()
    found = sorted(r[0] for r in sample)
    return sorted(set(found[8::8]))


def running_sums(
    df: DataFrame, strata: Sequence[str], bucket: Column, order: Sequence[Column], sums: dict[str, str]
) -> DataFrame:
    """Inclusive running sums ``{output: input}`` along ``order`` inside each stratum.

    Same bucket scheme as ``bucket_rank``: totals per bucket, a prefix sum over the
    small bucket table, and a running sum inside each bucket.
    """
    strata = list(strata)
    keyed = df.withColumn("_bucket", bucket)
    totals = keyed.groupBy(*strata, "_bucket").agg(*[F.sum(v).alias(f"_t_{o}") for o, v in sums.items()])
    for o in sums:
        totals = _prefix(totals, strata, f"_t_{o}", f"_p_{o}")
    totals = totals.drop(*[f"_t_{o}" for o in sums])
    w = Window.partitionBy(*strata, "_bucket").orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    for o, v in sums.items():
        keyed = keyed.withColumn(f"_l_{o}", F.sum(v).over(w))
    out = keyed.join(totals, [*strata, "_bucket"])
    for o in sums:
        out = out.withColumn(o, F.col(f"_l_{o}") + F.col(f"_p_{o}")).drop(f"_l_{o}", f"_p_{o}")
    return out.drop("_bucket")


def value_counts(df: DataFrame, groups: Sequence[str], value: str) -> DataFrame:
    """Distinct values with their counts: the compact form weighted statistics start from."""
    return df.groupBy(*groups, value).agg(F.count(F.lit(1)).alias("freq"))


def kth_smallest(df: DataFrame, value: str, k: int, bins: int = 1024, small: int = 65536) -> float | None:
    """The k-th smallest (0-based) of a numeric column, exact, without a global sort.

    Each pass counts ``bins`` equal ranges and keeps the one that holds the rank;
    once that range is small (or one value) a bounded top-k finishes.
    """
    data = df.select(F.col(value).cast("double").alias("v")).where(F.col("v").isNotNull())
    lo, hi, n = data.agg(F.min("v"), F.max("v"), F.count("v")).first()
    if not n:
        return None
    k = min(k, n - 1)
    while lo < hi and n > small:
        width = (hi - lo) / bins
        if lo + width <= lo:
            break
        part = data.where(F.col("v").between(lo, hi))
        at = F.least(F.lit(bins - 1), F.floor((F.col("v") - lo) / width)).alias("b")
        rows = part.groupBy(at).agg(F.count("v").alias("n"), F.min("v").alias("lo"), F.max("v").alias("hi"))
        for r in rows.orderBy("b").collect():
            if k < r.n:
                lo, hi, n = r.lo, r.hi, r.n
                break
            k -= r.n
    if lo == hi:
        return lo
    part = data.where(F.col("v").between(lo, hi))
    if n > small:  # neighbouring doubles only: few distinct values, counted
        for r in part.groupBy("v").count().orderBy("v").collect():
            if k < r["count"]:
                return r.v
            k -= r["count"]
    return part.orderBy("v").limit(k + 1).agg(F.max("v")).first()[0]


def order_statistics(df: DataFrame, groups: Sequence[str], value: str, probs: Sequence[float]) -> DataFrame:
    """(groups, quantiles array<double>): exact quantiles of every group at once, linear between neighbours.

    Values are counted, counts summed along the values in buckets, and only the values at a wanted rank leave
    their bucket, so neither the rows nor the distinct values of a group come together in one place. NULL values
    take no part; a group without values has no row.
    """
    groups, probs = list(groups), [float(p) for p in probs]
    if not all(0 <= p <= 1 for p in probs):
        raise ValueError(f"shares between 0 and 1: {probs}")
    keys = [f"_g{i}" for i in range(len(groups))] or ["_g"]  # names of their own; a lone table is one group
    named = [F.col(g).alias(k) for g, k in zip(groups, keys)] or [F.lit(0).alias("_g")]
    # a NULL key is a group like any other: joins below compare whole key structs
    rows = df.where(F.col(value).isNotNull()).select(F.struct(*named).alias("_k"), F.col(value).cast("double").alias("_v"))
    hashed = rows.select("_k", F.xxhash64("_k").alias("_h"), "_v")
    counts = value_counts(hashed, ["_h", "_k"], "_v")
    bounds = sampled_bounds(counts, "_v")
    bucket = F.size(F.filter(F.array(*[F.lit(b) for b in bounds]), lambda b: b <= F.col("_v"))) if bounds else F.lit(0)
    summed = running_sums(counts, ["_h", "_k"], bucket, [F.col("_v")], {"_cum": "freq"})
    sizes = counts.groupBy("_h", "_k").agg(F.sum("freq").alias("_n")).withColumnsRenamed({"_h": "_h2", "_k": "_k2"})
    ranked = summed.join(sizes, F.expr("_h = _h2 AND _k = _k2"))

    def at(rank: Column) -> Column:
        return F.max(F.when((F.col("_cum") - F.col("freq") <= rank) & (rank < F.col("_cum")), F.col("_v")))

    places = [F.lit(p) * (F.col("_n") - 1) for p in probs]
    wanted = [F.struct(at(F.floor(x)).alias("lo"), at(F.ceil(x)).alias("hi")) for x in places]
    found = ranked.groupBy("_h", "_k").agg(F.max("_n").alias("_n"), *[w.alias(f"_q{i}") for i, w in enumerate(wanted)])
    parts = [F.col(f"_q{i}.lo") + (F.col(f"_q{i}.hi") - F.col(f"_q{i}.lo")) * (x - F.floor(x)) for i, x in enumerate(places)]
    return found.select(*[F.col(f"_k.{k}").alias(g) for g, k in zip(groups, keys)], F.array(*parts).alias("quantiles"))
