"""Equi-joins with the checks the record pipelines need."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from geoctx.functions import text


def last_per_key(df: DataFrame, key: str, order: Sequence[str], keep: Sequence[str]) -> DataFrame:
    """Last row per key by ``order``: an aggregate with map-side combine, safe for hot keys."""
    packed = F.max_by(F.struct(*keep), F.struct(*order)).alias("_v")
    return df.groupBy(key).agg(packed).select(key, "_v.*")


def first_per_key(df: DataFrame, keys: Sequence[str], order: Sequence[str], keep: Sequence[str]) -> DataFrame:
    """First row per key by ``order``, same plan."""
    packed = F.min_by(F.struct(*keep), F.struct(*order)).alias("_v")
    return df.groupBy(*keys).agg(packed).select(*keys, "_v.*")


def lookup_required(df: DataFrame, labels: DataFrame, key: str, values: Sequence[str]) -> DataFrame:
    """Left join that fails the job on a key without a label. ``labels`` must be unique on ``key``."""
    found = labels.select(key, F.lit(True).alias("_hit"), *values)
    joined = df.join(found, key, "left")
    message = F.concat(F.lit(f"no label for {key} "), F.col(key).cast("string"))
    first = F.when(F.col("_hit").isNull(), F.raise_error(message)).otherwise(F.col(values[0]))
    return joined.withColumn(values[0], first).drop("_hit")


def map_category(df: DataFrame, dim: DataFrame, on: str, value: str, new: str) -> DataFrame:
    """Dictionary map; unknown categories become NULL. The optimizer broadcasts the dimension if it is small."""
    return df.join(dim.select(on, F.col(value).alias(new)), on, "left")


def differing(a: DataFrame, b: DataFrame, key: str, columns: Sequence[str]) -> DataFrame:
    """Keys present in both versions whose listed columns differ, with both values."""
    left = a.select(key, *[F.col(c).alias(c + "_a") for c in columns])
    right = b.select(key, *[F.col(c).alias(c + "_b") for c in columns])
    changed = None
    for c in columns:
        diff = ~F.col(c + "_a").eqNullSafe(F.col(c + "_b"))
        changed = diff if changed is None else changed | diff
    return left.join(right, key).where(changed)


def verified_copy(target: DataFrame, source: DataFrame, key: str, checks: Sequence[str], column: str) -> DataFrame:
    """Copy ``column`` from ``source`` only where all ``checks`` agree; ``copy_status`` says what happened."""
    src = source.select(key, F.lit(True).alias("_hit"), *[F.col(c).alias("_s_" + c) for c in (*checks, column)])
    agree: Column = F.col("_hit").isNotNull()
    for c in checks:
        agree = agree & F.col(c).eqNullSafe(F.col("_s_" + c))
    status = F.when(F.col("_hit").isNull(), "missing").when(agree, "matched").otherwise("mismatch")
    return (
        target.join(src, key, "left")
        .withColumn("copy_status", status)
        .withColumn(column, F.when(agree, F.col("_s_" + column)))
        .drop("_hit", *["_s_" + c for c in (*checks, column)])
    )


def missing_keys(df: DataFrame, others: Sequence[DataFrame], key: str) -> DataFrame:
    """Keys of ``df`` absent from at least one of ``others``."""
    parts = [df.select(key).join(o.select(key), key, "left_anti") for o in others]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out.distinct()


def assemble(df: DataFrame, features: dict[str, DataFrame], key: str) -> DataFrame:
    """Join one column per modality by key; a sample without a modality fails the job."""
    out = df
    for name, table in features.items():
        out = lookup_required(out, table, key, [name])
    return out


def copy_plan(wanted: DataFrame, source: DataFrame, target: DataFrame, key: str) -> DataFrame:
    """What to do with each wanted file: copy, already there, or missing at the source."""
    src = source.select(key).distinct().withColumn("_src", F.lit(True))
    dst = target.select(key).distinct().withColumn("_dst", F.lit(True))
    status = (
        F.when(F.col("_dst").isNotNull(), "already_there")
        .when(F.col("_src").isNull(), "missing_at_source")
        .otherwise("copy")
    )
    return (
        wanted.select(key).distinct().join(dst, key, "left").join(src, key, "left")
        .select(key, status.alias("status"))
    )


def assert_subset(custom: DataFrame, known: DataFrame, key: str) -> DataFrame:
    """Values of ``custom`` that ``known`` lacks (empty when custom is a subset)."""
    return custom.select(key).distinct().join(known.select(key).distinct(), key, "left_anti")


def label_map(old: DataFrame, new: DataFrame, name: str = "name") -> DataFrame:
    """Old class id to new class id by name; a class missing from ``new`` maps to 255 (ignored)."""
    a = old.select(name, F.col("class_id").alias("old_id"))
    b = new.select(name, F.col("class_id").alias("new_id"))
    return a.join(b, name, "left").select("old_id", F.coalesce("new_id", F.lit(255)).cast("int").alias("new_id"))


def list_violations(df: DataFrame, packed: dict[str, str]) -> DataFrame:
    """Rows whose packed lists differ in length, with ``n_<name>`` for each ``{name: column}``. NULL and empty lists have length 0."""
    counted = df.select("*", *[text.packed_count(c).alias(f"n_{n}") for n, c in packed.items()])
    return counted.where(F.size(F.array_distinct(F.array(*[F.col(f"n_{n}") for n in packed]))) > 1)


def require_aligned(df: DataFrame, packed: dict[str, str]) -> DataFrame:
    """``df`` itself; a job that reaches a row with lists of different lengths fails and names the lengths."""
    sizes = F.array(*[text.packed_count(c) for c in packed.values()])
    message = F.concat(F.lit(f"lists of unequal length ({', '.join(packed)}): "), F.array_join(sizes.cast("array<string>"), ", "))
    return df.where(F.when(F.size(F.array_distinct(sizes)) == 1, F.lit(True)).otherwise(F.raise_error(message).cast("boolean")))
