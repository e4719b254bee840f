"""JSON-lines scans."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from geoctx.schemas import SAMPLE

BAD = "_bad"


def _lines(spark: SparkSession, path, schema: T.StructType) -> DataFrame:
    wide = T.StructType([*schema.fields, T.StructField(BAD, T.StringType())])
    return (
        spark.read.schema(wide).option("mode", "PERMISSIVE").option("columnNameOfCorruptRecord", BAD)
        .option("encoding", "UTF-8").option("lineSep", "\n").json(path)
    )


def read_lenient(spark: SparkSession, path, schema: T.StructType = SAMPLE) -> tuple[DataFrame, DataFrame]:
    """(good rows, quarantined lines). Blank lines are skipped; malformed ones keep their text."""
    rows = _lines(spark, path, schema)
    bad = (
        spark.read.text(path).where(F.trim("value") != "")
        .select(F.col("value").alias("line"),
                F.from_json("value", T.StructType([*schema.fields, T.StructField(BAD, T.StringType())]),
                            {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": BAD})[BAD].alias(BAD))
        .where(F.col(BAD).isNotNull()).select("line")
    )
    # the text of the broken line must be part of the projection for the reader to fill it
    good = rows.select("*", F.col(BAD).isNull().alias("_ok")).where("_ok").drop("_ok", BAD)
    return good, bad


def read_strict(spark: SparkSession, path, schema: T.StructType = SAMPLE, required: Sequence[str] = ()) -> DataFrame:
    """Fails on malformed lines, on a missing required field and on a file without rows."""
    rows = spark.read.schema(schema).option("mode", "FAILFAST").option("encoding", "UTF-8").json(path)
    missing = [F.count(F.when(F.col(c).isNull(), 1)).alias(c) for c in required]
    check = rows.agg(F.count(F.lit(1)).alias("_n"), *missing).first()
    if check["_n"] == 0:
        raise ValueError(f"{path}: no records")
    lacking = {c: check[c] for c in required if check[c]}
    if lacking:
        raise ValueError(f"{path}: records without required fields: {lacking}")
    return rows


def read_fields(spark: SparkSession, path, fields: Sequence[str], schema: T.StructType = SAMPLE) -> DataFrame:
    """Only some fields are parsed; text fields are trimmed, missing text is empty."""
    chosen = T.StructType([schema[f] for f in fields])
    out = []
    for f in chosen.fields:
        text = isinstance(f.dataType, T.StringType)
        out.append(F.trim(F.coalesce(F.col(f.name), F.lit(""))).alias(f.name) if text else F.col(f.name))
    return spark.read.schema(chosen).option("encoding", "UTF-8").json(path).select(*out)


def read_dataset(spark: SparkSession, path) -> DataFrame:
    """Any JSON-lines file as one split, fields as found in it."""
    return spark.read.option("encoding", "UTF-8").json(path)
