"""Explicit schemas of the records the engine reads and writes."""

from pyspark.sql import types as T

POINT = T.StructType([T.StructField("x", T.DoubleType()), T.StructField("y", T.DoubleType())])
RING = T.ArrayType(POINT)

POI = T.StructType([
    T.StructField("poi_id", T.LongType()),
    T.StructField("type", T.StringType()),
    T.StructField("lng_wgs", T.DoubleType()),
    T.StructField("lat_wgs", T.DoubleType()),
    T.StructField("x", T.DoubleType()),
    T.StructField("y", T.DoubleType()),
    T.StructField("type_en", T.StringType()),
    T.StructField("geohash", T.StringType()),
])

# Packed sample record: lists are joined by "?" at the JSON-lines edge only.
SAMPLE = T.StructType([
    T.StructField("split", T.StringType()),
    T.StructField("image_id", T.StringType()),
    T.StructField("file_name", T.StringType()),
    T.StructField("fun_cls", T.IntegerType()),
    T.StructField("fun_score", T.DoubleType()),
    T.StructField("poi_text", T.StringType()),
    T.StructField("poi_distance", T.StringType()),
    T.StructField("poi_location", T.StringType()),
    T.StructField("poi_geohash", T.StringType()),
    T.StructField("poi_prompt", T.StringType()),
])

SAMPLE_MIN = T.StructType([
    T.StructField("image_id", T.StringType()),
    T.StructField("poi_prompt", T.StringType()),
    T.StructField("fun_cls", T.IntegerType()),
])

PIXEL = T.StructType([
    T.StructField("image_id", T.LongType()),
    T.StructField("row", T.IntegerType()),
    T.StructField("col", T.IntegerType()),
    T.StructField("value", T.IntegerType()),
])

TRAIN_LOG = T.StructType([
    T.StructField("step", T.LongType()),
    T.StructField("metrics", T.MapType(T.StringType(), T.DoubleType())),
])
