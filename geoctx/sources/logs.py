"""Training logs: JSON lines with an optional step and free metric names."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from geoctx.operators.ordered import carry_step
from geoctx.session import cut_lineage


def read_log(spark: SparkSession, path) -> DataFrame:
    """(run, line, full_step, metric, value): one row per metric of a line.

    The line's place in its file is the offset the reader gives rows of one file: lines of a split
    follow each other, and splits of a file are numbered in file order.
    """
    text = spark.read.text(path, wholetext=False).select(
        F.col("_metadata.file_path").alias("run"), F.col("_metadata.file_block_start").alias("_start"),
        F.monotonically_increasing_id().alias("_id"), "value")
    # numbered once: the table is used twice below
    text = cut_lineage(text.where(F.trim("value") != ""))
    # ids grow inside a split; the split's start offset orders splits of a file
    fields = F.from_json("value", "map<string,string>")
    rows = text.withColumn("m", fields).withColumn("step", F.coalesce(F.col("m")["step"].cast("long"), F.lit(0).cast("long")))
    first = rows.groupBy("run", "_start").agg(F.min("_id").alias("_first"))
    rows = rows.join(first, ["run", "_start"]).withColumn("line", F.col("_start") + (F.col("_id") - F.col("_first")))
    stepped = carry_step(rows.select("run", "line", "step", "m"))
    return stepped.select("run", "line", "full_step", F.explode(F.map_filter("m", lambda k, v: k != "step")).alias("metric", "value"))
