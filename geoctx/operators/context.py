"""Surroundings of a building: packed lists, per-band statistics, prompts, tier sampling.

``pairs`` are the rows of ``nearest_k``, or its lists (a row per building, with ``items``): these hold all points of a
building already, so packing, statistics and prompts read them row by row, without a shuffle.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from geoctx.functions import geo, text
from geoctx.operators.spatial_join import Best

TOP_TYPES = 5


def with_bands(pairs: DataFrame) -> DataFrame:
    if "items" in pairs.columns:
        return pairs.withColumn("items", F.transform("items", lambda i: i.withField("band", geo.distance_band(i["dist"]))))
    return pairs.withColumn("band", geo.distance_band("dist"))


def packed_lists(pairs: DataFrame, key: str = "build_id", min_count: int = 1, counts: DataFrame | None = None) -> DataFrame:
    """Nearest first, one packed string per attribute; groups are at most k rows after the top-k.

    ``counts`` (key, n_poi), of all points around a building, stand for the lengths of lists that end at k.
    """
    item = F.struct("rk", "type_en", "band")
    grouped = pairs if "items" in pairs.columns else pairs.groupBy(key).agg(F.array_sort(F.collect_list(item)).alias("items"))
    n = F.size("items")
    if counts is not None:
        every = counts.select(F.col(key).alias("_key"), F.col("n_poi").alias("_all"))
        grouped, n = grouped.join(every, F.col(key).eqNullSafe(F.col("_key"))), F.col("_all")
    return grouped.where(n >= min_count).select(
        key,
        n.alias("n_poi"),
        text.pack(F.transform("items", lambda i: i["type_en"])).alias("poi_text"),
        text.pack(F.transform("items", lambda i: i["band"])).alias("poi_distance"),
    )


def type_counts(pairs: DataFrame, key: str = "build_id") -> DataFrame:
    """Count and first rank of every type in every band."""
    return pairs.groupBy(key, "band", "type_en").agg(
        F.count(F.lit(1)).alias("cnt"), F.min("rk").alias("first_rk")
    )


def band_profile(pairs: DataFrame, key: str = "build_id", top: int = TOP_TYPES) -> DataFrame:
    """Per band: total, the commonest types (ties: nearest first) and the top type's count."""
    if "items" in pairs.columns:
        return _profiles(pairs, key, top).select(key, F.explode("profiles").alias("_b")).select(key, "_b.*")
    ranked = F.array_sort(F.collect_list(F.struct((-F.col("cnt")).alias("neg"), "first_rk", "type_en")))
    return (
        type_counts(pairs, key)
        .groupBy(key, "band")
        .agg(F.sum("cnt").alias("n"), ranked.alias("_r"))
        .select(
            key, "band", "n",
            F.transform(F.slice("_r", 1, top), lambda r: r["type_en"]).alias("types"),
            (-F.col("_r")[0]["neg"]).alias("top_count"),
        )
    )


def _profiles(lists: DataFrame, key: str, top: int) -> DataFrame:
    """(key, n_poi, profiles): the rows of ``band_profile`` of a building as a list, counted for an Arrow batch of lists at once."""
    whole, words = T.LongType(), T.StringType()
    profile = T.StructType().add("band", words).add("n", whole).add("types", T.ArrayType(words)).add("top_count", whole)
    schema = T.StructType([lists.schema[key], T.StructField("n_poi", whole), T.StructField("profiles", T.ArrayType(profile))])

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            items, sizes = batch.column(1).flatten(), batch.column(1).value_lengths().to_numpy()
            band, kind = (items.field(c).dictionary_encode(null_encoding="encode") for c in ("band", "type_en"))
            bands, kinds = len(band.dictionary), len(kind.dictionary)
            row = np.repeat(np.arange(batch.num_rows), sizes)
            code = (row * bands + band.indices.to_numpy()) * kinds + kind.indices.to_numpy()
            code, first, cnt = np.unique(code, return_index=True, return_counts=True)
            at = np.lexsort((first, -cnt, code // kinds))  # items come by rank
            part, cnt, code = (code // kinds)[at], cnt[at], (code % kinds)[at]
            starts = np.flatnonzero(np.append(True, part[1:] != part[:-1]))
            held = np.diff(np.append(starts, len(part)))
            best = np.arange(len(part)) - np.repeat(starts, held) < top
            ends = np.append(0, np.cumsum(np.minimum(held, top)))
            types = pa.ListArray.from_arrays(pa.array(ends, pa.int32()), kind.dictionary.take(pa.array(code[best])))
            profiles = pa.StructArray.from_arrays(
                [band.dictionary.take(pa.array(part[starts] % bands)), pa.array(np.add.reduceat(cnt, starts)), types, pa.array(cnt[starts])], profile.names)
            rows = np.searchsorted(part[starts] // bands, np.arange(batch.num_rows + 1))
            lists = pa.ListArray.from_arrays(pa.array(rows, pa.int32()), profiles)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(sizes, pa.int64()), lists], names=schema.names)

    return lists.select(key, "items").mapInArrow(count, schema)


def prompts(pairs: DataFrame, key: str = "build_id", words=None, min_count: int = 3) -> DataFrame:
    """Context prompt per building with at least ``min_count`` points.

    Rows of ``pairs`` come with all of a building in one task, so the counts below are as good as final
    before they are shuffled; lists are not shuffled.
    """
    words = words or text.DENSITY_WORDS_VIVID
    if "items" in pairs.columns:
        wide = _profiles(pairs, key, TOP_TYPES).select(key, "n_poi", *[
            F.get(F.filter("profiles", lambda p: p["band"] == band), F.lit(0)).alias(f"b{band}") for band in text.BAND_LABELS])  # noqa: B023
    else:
        picked = []
        for band in text.BAND_LABELS:
            here = F.when(F.col("band") == band, F.struct("n", "types", "top_count"))
            picked.append(F.max_by(here, here.isNotNull()).alias(f"b{band}"))
        wide = band_profile(pairs, key).groupBy(key).agg(F.sum("n").alias("n_poi"), *picked)
    clauses = [
        text.band_sentence(label, F.col(f"b{band}.n"), F.col(f"b{band}.types"), F.col(f"b{band}.top_count"), words)
        for band, label in text.BAND_LABELS.items()
    ]
    body = F.concat_ws("; ", *clauses)
    return wide.where(F.col("n_poi") >= min_count).select(
        key, "n_poi", F.concat(F.lit(text.PROMPT_PREFIX), body, F.lit(".")).alias("prompt")
    )


def tier_sample(
    pairs: DataFrame, hash_key: Column, key: str = "build_id", tie: str = "poi_id",
    total: int = 20, near: int = 10, middle: int = 5, edges=(100.0, 200.0, 300.0),
) -> DataFrame:
    """Adaptive sample of at most ``total`` points per building.

    Up to ``total`` points: keep all. Else the ``near`` nearest below the first edge, then
    ``middle`` plus what the first tier left unused from the second tier, then the rest from the
    third, the last two by ``hash_key``. A point at exactly the last edge is in no tier.

    ``pairs`` is read once. Each Arrow batch keeps its ``total`` first points of a (building, tier) and the number
    of all, so a crowded building never reaches one task whole and the join behind ``pairs`` runs once. Pairs with a
    ``_count``, as ``radius_join`` leaves them with ``tier_best``, are cut already. Its ``ranges`` (a row per building)
    are sampled row by row, without a shuffle, and come in the order of ``hash_key`` already.
    """
    if "ranges" in pairs.columns:
        return _tiers(pairs, key, total, near, middle)
    d = F.col("dist")
    a, b, c = edges
    tier = F.when(d < a, "A").when(d < b, "B").when(d < c, "C").otherwise("-")
    order = F.when(F.col("tier") == "A", d).otherwise(hash_key.cast("double"))
    tiers = pairs.withColumn("tier", tier).withColumn("_o", order)
    short = tiers if "_count" in pairs.columns else best_and_counts(tiers, [key, "tier"], ["_o", tie], total)
    whole = Window.partitionBy(key)
    sizes = {n: F.sum(F.when(cond, F.col("_count")).otherwise(0)).over(whole) for n, cond in (
        ("_n", F.lit(True)), ("_na", F.col("tier") == "A"), ("_nb", F.col("tier") == "B"))}
    short = short.withColumns(sizes).withColumn("_rn", F.row_number().over(Window.partitionBy(key, "tier").orderBy("_o", tie)))
    taken_a = F.least("_na", F.lit(near))
    quota_b = F.lit(middle + near) - taken_a
    taken_b = F.least(F.col("_nb"), quota_b)
    quota = (
        F.when(F.col("tier") == "A", F.lit(near)).when(F.col("tier") == "B", quota_b)
        .when(F.col("tier") == "C", F.lit(total) - taken_a - taken_b).otherwise(0)
    )
    return short.where((F.col("_n") <= total) | (F.col("_rn") <= quota)).drop("_o", "_rn", "_n", "_na", "_nb", "_count")


def _tiers(lists: DataFrame, key: str, total: int, near: int, middle: int) -> DataFrame:
    """``tier_sample`` of the ranges of ``tier_best``: its tiers, and what lies at the last edge."""
    n = [F.col("ranges")[i]["n"] for i in range(4)]
    taken_a = F.least(n[0], F.lit(near))
    quota_b = F.lit(middle + near) - taken_a
    quotas = [F.lit(near), quota_b, F.lit(total) - taken_a - F.least(n[1], quota_b), F.lit(0)]
    every = n[0] + n[1] + n[2] + n[3] <= total
    picked = [
        F.transform(F.slice(F.col("ranges")[i]["items"], F.lit(1), F.when(every, total).otherwise(quota).cast("int")), lambda v: F.struct(v.alias("v"), F.lit(tier).alias("tier")))  # noqa: B023
        for i, (tier, quota) in enumerate(zip("ABC-", quotas))]
    return lists.select(key, F.explode(F.concat(*picked)).alias("_p")).select(key, "_p.v.*", "_p.tier")


def tier_best(by: str, tie: str = "poi_id", total: int = 20, edges=(100.0, 200.0, 300.0)) -> Best:
    """What ``tier_sample`` needs of the pairs of a radius join; ``by`` is the hash key as a column of the points."""
    return Best(tuple(edges), total, tie, by, near=1, closed=False)


def best_and_counts(df: DataFrame, keys: list[str], order: list[str], n: int) -> DataFrame:
    """The map side of a best-n with counts: rows that can be among the ``n`` first of their group, and ``_count``.

    ``_count`` adds up over the rows left to the size of the whole group. Keeps at most ``n`` rows of a group per
    Arrow batch, without a shuffle; the final rank is the caller's. NULL keys are a group, NULLs in the order come first.
    """
    schema = T.StructType([*df.schema.fields, T.StructField("_count", T.LongType())])

    def codes(batch: pa.RecordBatch, name: str, ranked: bool) -> np.ndarray:
        return pd.factorize(batch.column(batch.schema.get_field_index(name)).to_pandas(), sort=ranked)[0]  # NULL: -1

    def first(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            groups = [codes(batch, k, False) for k in keys]
            at = np.lexsort([codes(batch, o, True) for o in reversed(order)] + groups[::-1])
            new = np.ones(len(at), bool)
            new[1:] = np.any([g[at][1:] != g[at][:-1] for g in groups], axis=0)
            starts = np.flatnonzero(new)
            sizes = np.diff(np.append(starts, len(at)))
            place = np.arange(len(at)) - np.repeat(starts, sizes)
            count = np.where(place == 0, np.repeat(sizes, sizes), 0)
            kept = place < n
            out = batch.take(pa.array(at[kept]))
            yield pa.RecordBatch.from_arrays([*out.columns, pa.array(count[kept], pa.int64())], names=[*out.schema.names, "_count"])

    return df.mapInArrow(first, schema)
