"""Masks as runs: (row, start, stop) of equal class along an image row, ends included.

A mask costs as many rows as it has runs, whatever its area; unions, overlaps and areas are computed on runs, and
``pixels`` reads them back. A row of pixels is the largest group that one task sees.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from geoctx.operators.metrics import IGNORE

IMAGE = ("image_id",)


def encode(pixels: DataFrame, value: str, keys: Sequence[str] = IMAGE, name: str = "cls") -> DataFrame:
    """``keys, name, row, start, stop``: the runs of each value in ``pixels (keys, row, col, value)``; pixels are distinct.

    Pixels that are missing end a run, and NULL is no value. Within a row the column less the rank among pixels of one
    value is the same all along a run.
    """
    own = Window.partitionBy(*keys, "row", value).orderBy("col")
    t = pixels.where(F.col(value).isNotNull()).select(*keys, "row", "col", value, (F.col("col") - F.row_number().over(own)).alias("_run"))
    t = t.groupBy(*keys, "row", value, "_run").agg(F.min("col").alias("start"), F.max("col").alias("stop"))
    return t.select(*keys, F.col(value).alias(name), "row", "start", "stop")


def instance_runs(pixels: DataFrame, ignore: int = IGNORE) -> DataFrame:
    """One binary mask per image and class present, as runs of its ones."""
    return encode(pixels.where(F.col("gt") != ignore), "gt")


def pixels(runs: DataFrame) -> DataFrame:
    """One row per pixel of the runs."""
    return runs.withColumn("col", F.explode(F.sequence("start", "stop"))).drop("start", "stop")


def area(runs: DataFrame, keys: Sequence[str], name: str = "area") -> DataFrame:
    return runs.groupBy(*keys).agg(F.sum(F.col("stop") - F.col("start") + 1).cast("long").alias(name))


def union(runs: DataFrame, keys: Sequence[str]) -> DataFrame:
    """The runs of each group of ``keys`` with overlapping and touching ones joined."""
    line = Window.partitionBy(*keys, "row").orderBy("start", "stop")
    reach = F.max("stop").over(line.rowsBetween(Window.unboundedPreceding, -1))
    t = runs.select(*keys, "row", "start", "stop", F.coalesce(F.col("start") > reach + 1, F.lit(True)).cast("int").alias("_new"))
    t = t.withColumn("_group", F.sum("_new").over(line.rowsBetween(Window.unboundedPreceding, 0)))
    return t.groupBy(*keys, "row", "_group").agg(F.min("start").alias("start"), F.max("stop").alias("stop")).drop("_group")


def overlap(a: DataFrame, b: DataFrame, keys: Sequence[str]) -> DataFrame:
    """The runs of pixels that lie in both, ``keys`` equal; each side's runs of a group must not overlap (``union``).

    Runs meet in strips of 256 columns, so that a row of very many runs is no group of its own.
    """
    strips = lambda t, s, e: t.withColumn("_strip", F.explode(F.sequence(F.floor(F.col(s) / 256), F.floor(F.col(e) / 256))))
    left = strips(a.select(*keys, "row", "start", "stop"), "start", "stop")
    right = strips(b.select(*keys, "row", F.col("start").alias("_s"), F.col("stop").alias("_e")), "_s", "_e")
    first, last = F.greatest("start", "_s"), F.least("stop", "_e")
    met = left.join(right, [*keys, "row", "_strip"]).where((first <= last) & (F.floor(first / 256) == F.col("_strip")))
    return met.select(*keys, "row", first.alias("start"), last.alias("stop"))


def class_areas(pixels: DataFrame, ignore: int = IGNORE, keys: Sequence[str] = IMAGE) -> DataFrame:
    """Per group and class: overlap, joined, predicted and labelled area, from runs alone; truth ``ignore`` counts nowhere."""
    valid = pixels.where(F.col("gt") != ignore)
    truth, found = encode(valid, "gt", keys), encode(valid, "pred", keys)
    by = [*keys, "cls"]
    both = area(union(truth.unionByName(found), by), by, "union_area")
    for runs, name in ((overlap(truth, found, by), "inter"), (found, "pred_area"), (truth, "label_area")):
        both = both.join(area(runs, by, name), by, "left")
    return both.na.fill(0, ["inter", "pred_area", "label_area"])
