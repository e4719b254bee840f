"""Directory listings, name lists and nested annotation files."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from geoctx.functions.text import strip_suffix


def list_files(spark: SparkSession, folder: str, suffix: str) -> DataFrame:
    """(stem, path) of the files below a folder; the scan never opens them."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).option("pathGlobFilter", f"*{suffix}").load(folder)
    rel = F.regexp_replace(F.regexp_replace("path", r"^file:/*", "/"), "^.*?" + _quoted(folder.rstrip("/")) + "/", "")
    return files.select(strip_suffix(rel, suffix).alias("stem"), "path")


def _quoted(text: str) -> str:
    import re

    return re.escape(text)


def pair_listing(spark: SparkSession, images: str, masks: str, image_suffix: str = ".png", mask_suffix: str = ".png",
                 second_images: str | None = None) -> DataFrame:
    """Images with their mask (and a second image for change pairs) by stem, sorted by path."""
    out = list_files(spark, images, image_suffix).withColumnRenamed("path", "img_path")
    if second_images:
        out = out.join(list_files(spark, second_images, image_suffix).withColumnRenamed("path", "img_path2"), "stem")
    out = out.join(list_files(spark, masks, mask_suffix).withColumnRenamed("path", "seg_map_path"), "stem", "left")
    return out.orderBy("img_path")


def read_name_list(spark: SparkSession, path, images: str, masks: str, image_suffix: str = ".jpg", mask_suffix: str = ".png") -> DataFrame:
    """One name per line to image and mask paths; blank lines are skipped."""
    name = F.trim("value")
    return spark.read.text(path).where(name != "").select(
        name.alias("name"), F.concat(F.lit(images + "/"), name, F.lit(image_suffix)).alias("img_path"),
        F.concat(F.lit(masks + "/"), name, F.lit(mask_suffix)).alias("seg_map_path"))


def read_pair_list(spark: SparkSession, path) -> DataFrame:
    """Two white-space separated columns per line."""
    parts = F.split(F.trim("value"), r"\s+")
    return spark.read.text(path).where(F.trim("value") != "").select(parts[0].alias("image"), parts[1].alias("label"))


_PAIR = T.StructType([T.StructField("image", T.StringType()), T.StructField("label", T.StringType())])


def read_nested_annotations(spark: SparkSession, path, training: bool = True) -> DataFrame:
    """Annotation file with ``training`` objects or ``test`` strings; a leading "./" is dropped."""
    schema = T.StructType([
        T.StructField("training", T.ArrayType(_PAIR)), T.StructField("test", T.ArrayType(T.StringType())),
        T.StructField("labels", T.MapType(T.StringType(), T.StringType())),
    ])
    doc = spark.read.schema(schema).option("multiLine", True).json(path)

    def clean(c):
        return F.regexp_replace(c, r"^\./", "")

    if training:
        rows = doc.select(F.explode("training").alias("t"))
        return rows.select(clean("t.image").alias("img_path"), clean("t.label").alias("seg_map_path"))
    return doc.select(F.explode("test").alias("t")).select(
        clean("t").alias("img_path"), F.lit(None).cast("string").alias("seg_map_path"))


def annotation_labels(spark: SparkSession, path) -> DataFrame:
    schema = T.StructType([T.StructField("labels", T.MapType(T.StringType(), T.StringType()))])
    doc = spark.read.schema(schema).option("multiLine", True).json(path)
    return doc.select(F.explode("labels").alias("class_id", "name")).select(F.col("class_id").cast("int"), "name")
