"""Projections and predicates on sample and point records."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def _col(c) -> Column:
    return F.col(c) if isinstance(c, str) else c


def prefixed_id(prefix, key) -> Column:
    return F.concat_ws("_", _col(prefix), _col(key).cast("string"))


def stem(name) -> Column:
    """File name without its last extension (and without folders)."""
    return F.regexp_replace(F.regexp_extract(_col(name), r"([^/]*)$", 1), r"\.[^.]*$", "")


def city_of(name) -> Column:
    """Text before the first underscore; "Unknown" without one."""
    name = _col(name)
    return F.when(F.contains(name, F.lit("_")), F.split_part(name, F.lit("_"), F.lit(1))).otherwise("Unknown")


def id_of(name) -> Column:
    """Text between the first and the second underscore of the stem; NULL without one."""
    s = stem(name)
    return F.when(F.contains(s, F.lit("_")), F.split_part(s, F.lit("_"), F.lit(2)))


def zero_based_class(value) -> Column:
    """"3.0" or 3 to 2."""
    return _col(value).cast("double").cast("int") - 1


def seven_to_three(cls) -> Column:
    cls = _col(cls)
    return F.when(cls == 0, 0).when(cls.isin(1, 2), 1).when(cls >= 3, 2).cast("int")


def two_levels(type_text) -> Column:
    """First two levels of "big;mid;sub"."""
    return F.concat_ws(";", F.slice(F.split(F.trim(_col(type_text)), ";"), 1, 2))


def plain_type(type_text) -> Column:
    return F.replace(F.coalesce(_col(type_text), F.lit("")), F.lit(";"), F.lit(" "))


def match_flag(value) -> Column:
    return F.when(_col(value).isNull(), "not found").otherwise("ok")


def inside(df: DataFrame, extent, x: str = "x", y: str = "y") -> DataFrame:
    """Rows whose point lies in (minx, miny, maxx, maxy); a plain range, so it reaches the scan."""
    minx, miny, maxx, maxy = extent
    return df.where(F.col(x).between(minx, maxx) & F.col(y).between(miny, maxy))


def category_of_name(name) -> Column:
    """Text before "_<digit>" at the start of a name; empty if there is none."""
    return F.regexp_extract(_col(name), r"^([^0-9]*)_[0-9]", 1)
