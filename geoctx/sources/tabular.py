"""CSV, dimension, Parquet and multi-file scans."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

# --- fixed values: field names cut to ten characters by the shapefile format ---
CUT_NAMES = {"Matched_Fu": "Matched_Func", "Match_Stat": "Match_Status", "Match_Scor": "Match_Score"}
# --- end of fixed values ---


def read_csv(spark: SparkSession, path, schema: T.StructType) -> DataFrame:
    """CSV with a header; a byte-order mark at the start is not part of the first name."""
    return spark.read.schema(schema).option("header", True).option("encoding", "UTF-8").option("enforceSchema", True).csv(path)


def read_dimension(spark: SparkSession, path, source: Sequence[str], target: str) -> DataFrame:
    """Category table (CSV or Parquet): joined source levels as ``type_2lvl``, and the new name."""
    raw = spark.read.parquet(path) if str(path).endswith(".parquet") else spark.read.option("header", True).csv(path)
    return raw.select(F.concat_ws(";", *[F.trim(F.col(c)) for c in source]).alias("type_2lvl"), F.col(target).alias("name")).distinct()


def read_layers(spark: SparkSession, paths: Sequence[str]) -> DataFrame:
    """Several Parquet layers, by name, missing columns empty; cut field names are restored."""
    out = None
    for p in paths:
        layer = spark.read.parquet(p)
        layer = layer.withColumnsRenamed({k: v for k, v in CUT_NAMES.items() if k in layer.columns})
        out = layer if out is None else out.unionByName(layer, allowMissingColumns=True)
    return out


def layer_schema(spark: SparkSession, path) -> T.StructType:
    """From the file footer; no rows are read."""
    return spark.read.parquet(path).schema


def read_box(spark: SparkSession, path, extent, x: str = "x", y: str = "y") -> DataFrame:
    """Rows inside an extent; the ranges are pushed to the Parquet scan and skip row groups."""
    minx, miny, maxx, maxy = extent
    return spark.read.parquet(path).where(F.col(x).between(minx, maxx) & F.col(y).between(miny, maxy))


def write_clustered(df: DataFrame, path: str, cell: float, x: str = "x", y: str = "y", mode: str = "errorifexists") -> None:
    """Points laid out by grid cell, so that ``read_box`` finds narrow row groups."""
    keyed = df.withColumn("_cx", F.floor(F.col(x) / cell)).withColumn("_cy", F.floor(F.col(y) / cell))
    keyed.repartitionByRange("_cx", "_cy").sortWithinPartitions("_cx", "_cy").drop("_cx", "_cy").write.mode(mode).parquet(path)
