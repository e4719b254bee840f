"""Strata, class statistics, bins, capped down-sampling, splits and folds.

Strata are few and may be huge, so nothing here ranks a stratum in one window
partition: sizes come from aggregates, ranks from ``ranking.random_rank``.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from geoctx.operators import ranking

# --- fixed values: class caps and split shares ---
CAPS = {0: 8000, 5: 2000, 6: 2000}
SHARES = {"train": 0.6, "val": 0.2, "test": 0.2}
# --- end of fixed values ---


def class_counts(df: DataFrame, cls: str = "fun_cls") -> DataFrame:
    return df.groupBy(cls).agg(F.count(F.lit(1)).alias("n"))


def class_weights(df: DataFrame, cls: str = "fun_cls") -> DataFrame:
    """Inverse square root of the class share, scaled to sum up to the number of classes."""
    whole = Window.partitionBy()  # one row per class
    raw = class_counts(df, cls).withColumn("raw", 1.0 / F.sqrt(F.col("n") / F.sum("n").over(whole)))
    return raw.withColumn("weight", F.col("raw") / F.sum("raw").over(whole) * F.count(F.lit(1)).over(whole)).drop("raw")


def split_distribution(df: DataFrame, split: str = "split", city: str = "city", value: str = "poi_num") -> DataFrame:
    """Per split and city: rows, share of the whole and of the split; per split mean, median and max of ``value``.

    The median is exact and found by ranks in buckets, so no group of rows or distinct values is held.
    """
    whole = Window.partitionBy()
    per_split = Window.partitionBy(split)
    cities = df.groupBy(split, city).agg(F.count(F.lit(1)).alias("n_city"))
    cities = (
        cities.withColumn("n_split", F.sum("n_city").over(per_split))
        .withColumn("global_ratio", F.col("n_split") / F.sum("n_city").over(whole))
        .withColumn("city_share", F.col("n_city") / F.col("n_split"))
    )
    stats = df.groupBy(split).agg(F.avg(value).alias("mean"), F.max(value).alias("max"))
    middle = ranking.order_statistics(df, [split], value, [0.5]).select(split, F.col("quantiles")[0].alias("median"))
    return cities.join(stats, split).join(middle, split, "left")


def drop_rare(df: DataFrame, keys: Sequence[str], minimum: int = 3) -> DataFrame:
    """Rows whose key combination occurs at least ``minimum`` times."""
    rare = df.groupBy(*keys).agg(F.count(F.lit(1)).alias("_n")).where(F.col("_n") < minimum).drop("_n")
    return df.join(rare, list(keys), "left_anti")


def quantile_edges(df: DataFrame, value: str, bins: int = 8) -> list[float]:
    """Inner bin edges at exact quantiles, repeated edges dropped; none without values."""
    found = ranking.order_statistics(df, [], value, [i / bins for i in range(bins + 1)]).first()
    return sorted(set(found.quantiles))[1:-1] if found else []


def bin_of(value: str | Column, edges: Sequence[float]) -> Column:
    """Number of inner edges at or below the value."""
    c = F.col(value) if isinstance(value, str) else value
    out = F.lit(0)
    for e in edges:
        out = out + (c >= F.lit(e)).cast("int")
    return out


def kmeans_edges(df: DataFrame, value: str, bins: int = 10, rounds: int = 5000) -> list[float]:
    """Inner edges between ordered 1-D k-means centres, started at the middles of equal ranges.

    Each round is one pass over distinct values with counts (a small table for counts and scores), until no centre
    moves; edges that have not settled after ``rounds`` passes are refused.
    """
    counts = ranking.value_counts(df, [], value).cache()
    lo, hi = counts.agg(F.min(value), F.max(value)).first()
    if lo is None or lo == hi:
        counts.unpersist()
        return []
    width = (hi - lo) / bins
    centres = [lo + width * (i + 0.5) for i in range(bins)]
    for _ in range(rounds):
        edges = [(a + b) / 2 for a, b in zip(centres, centres[1:])]
        rows = counts.groupBy(bin_of(F.col(value), edges).alias("b")).agg(
            (F.sum(F.col(value) * F.col("freq")) / F.sum("freq")).alias("c")).collect()
        moved = {r.b: r.c for r in rows}
        new = sorted(moved.get(i, c) for i, c in enumerate(centres))
        if new == centres:
            break
        centres = new
    else:
        counts.unpersist()
        raise RuntimeError(f"centres still move after {rounds} rounds")
    counts.unpersist()
    return [(a + b) / 2 for a, b in zip(centres, centres[1:])]


def one_hot(df: DataFrame, categories: dict[str, Sequence]) -> DataFrame:
    """0/1 column per listed category: ``{column: values}``."""
    cols = [
        (F.col(c) == F.lit(v)).cast("int").alias(f"{c}_{v}") for c, values in categories.items() for v in values
    ]
    return df.select("*", *cols)


def _largest_remainder(strata: DataFrame, group: Sequence[str], keys: Sequence[str], target: str) -> DataFrame:
    """Integer quotas per stratum in proportion to ``n``, adding up to ``target`` in each group."""
    g = Window.partitionBy(*group)
    exact = F.col(target) * F.col("n") / F.sum("n").over(g)
    out = strata.withColumn("_e", F.round(exact, 9)).withColumn("quota", F.floor("_e"))
    order = Window.partitionBy(*group).orderBy(F.desc("_f"), *keys)
    return (
        out.withColumn("_f", F.round(F.col("_e") - F.col("quota"), 9))
        .withColumn("_r", F.row_number().over(order))
        .withColumn("_left", F.col(target) - F.sum("quota").over(g))
        .withColumn("quota", F.col("quota") + (F.col("_r") <= F.col("_left")).cast("long"))
        .drop("_e", "_f", "_r", "_left")
    )


def capped_sample(
    df: DataFrame, key: Column, id_col: str, cls: str = "fun_cls", strata: Sequence[str] = ("city", "poi_num"),
    caps: dict[int, int] | None = None,
) -> DataFrame:
    """Per class at most its cap, drawn in proportion to the strata; classes below their cap stay whole.

    In a class that is cut, strata of a single row take no part.
    """
    caps = CAPS if caps is None else caps
    cap = F.create_map(*[F.lit(x) for kv in caps.items() for x in kv])[F.col(cls)] if caps else F.lit(None)
    strata = list(strata)
    sizes = df.groupBy(cls, *strata).agg(F.count(F.lit(1)).alias("n"))
    sizes = sizes.withColumn("_cap", cap).withColumn("_total", F.sum("n").over(Window.partitionBy(cls)))
    cut = sizes.where((F.col("_cap").isNotNull()) & (F.col("_total") > F.col("_cap")) & (F.col("n") >= 2))
    quotas = _largest_remainder(cut, [cls], strata, "_cap").select(cls, *strata, "quota")
    whole_classes = sizes.where(F.col("_cap").isNull() | (F.col("_total") <= F.col("_cap"))).select(
        cls, F.lit(True).alias("_whole")).distinct()
    ranked = ranking.random_rank(df, [cls, *strata], key, id_col, "_rank")
    return (
        ranked.join(whole_classes, cls, "left").join(quotas, [cls, *strata], "left")
        .where(F.coalesce("_whole", F.lit(False)) | (F.col("_rank") <= F.coalesce("quota", F.lit(0))))
        .drop("_whole", "_rank", "quota")
    )


def stratified_split(
    df: DataFrame, key: Column, id_col: str, strata: Sequence[str], shares: dict[str, float] | None = None,
) -> DataFrame:
    """Adds ``split``: inside each joint stratum, hash ranks are cut at the cumulative shares.

    Joint strata stand in for sequential multi-label balancing, which has no parallel form;
    ``split_distribution`` reports how far the margins drift.
    """
    shares = shares or SHARES
    strata = list(strata)
    sizes = df.groupBy(*strata).agg(F.count(F.lit(1)).alias("_n"))
    ranked = ranking.random_rank(df, strata, key, id_col, "_rank").join(sizes, strata)
    out, total, names = None, 0.0, list(shares)
    for name in names[:-1]:
        total += shares[name]
        cond = F.col("_rank") <= F.round(F.col("_n") * F.lit(round(total, 9)))
        out = F.when(cond, name) if out is None else out.when(cond, name)
    return ranked.withColumn("split", out.otherwise(names[-1])).drop("_rank", "_n")


def stratified_folds(df: DataFrame, key: Column, id_col: str, cls: str, folds: int = 5) -> DataFrame:
    ranked = ranking.random_rank(df, [cls], key, id_col, "_rank")
    return ranked.withColumn("fold", ((F.col("_rank") - 1) % folds).cast("int")).drop("_rank")


def per_class_sample(df: DataFrame, key: Column, id_col: str, cls: str, n: int) -> DataFrame:
    """``n`` pseudo-random rows per class.

    Up to 1,000 rows Spark cuts the rank before the shuffle (its window limit); beyond that the bucketed
    rank keeps a large class from landing in one task.
    """
    if n > 1000:
        return ranking.random_rank(df, [cls], key, id_col, "_r").where(F.col("_r") <= n).drop("_r")
    w = Window.partitionBy(cls).orderBy(key, id_col)
    return df.withColumn("_r", F.row_number().over(w)).where(F.col("_r") <= n).drop("_r")


def shuffled(df: DataFrame, key: Column, tie: str) -> DataFrame:
    """Rows in pseudo-random, repeatable order (a range-partitioned sort)."""
    return df.orderBy(key, tie)


def assign_listed_split(df: DataFrame, lists: DataFrame, name: str, default: str = "val") -> DataFrame:
    """Split by membership in a name list; unlisted names get the default."""
    return df.join(lists.select(name, "split"), name, "left").withColumn("split", F.coalesce("split", F.lit(default)))
