"""Feature tables: WKT in, rings inside, WKT or GeoJSON out."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from geoctx.functions import geo


def read_features(spark: SparkSession, path, wkt: str = "wkt", crs: int = 3857) -> DataFrame:
    """Parquet feature table in metres: ``polygons`` (each a shell and its holes), and ``ring``, the outline of features
    that are one polygon without holes, else NULL. Longitude and latitude are projected."""
    df = spark.read.parquet(path).withColumn("polygons", geo.polygons_from_wkt(wkt)).drop(wkt)
    if crs == 4326:
        df = df.withColumn("polygons", F.transform("polygons", lambda g: F.transform(g, lambda r: F.transform(r, lambda p: F.struct(
            geo.mercator_x(p["x"]).alias("x"), geo.mercator_y(p["y"]).alias("y"))))))
    elif crs != 3857:
        raise ValueError("layers must come in EPSG:3857 or EPSG:4326")
    plain = (F.size("polygons") == 1) & (F.size(F.col("polygons")[0]) == 1)
    return df.withColumn("ring", F.when(plain, F.col("polygons")[0][0]))


def write_features(df: DataFrame, path: str, form: str = "wkt", mode: str = "errorifexists") -> None:
    geometry = geo.ring_to_wkt("ring") if form == "wkt" else geo.ring_to_geojson("ring")
    df.withColumn(form, geometry).drop("ring").write.mode(mode).parquet(path)
