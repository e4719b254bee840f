"""Writers: packed JSON lines, feature stores, metric reports, class masks, box features."""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from geoctx.functions import geo


def write_jsonl(df: DataFrame, path: str, mode: str = "errorifexists") -> None:
    """JSON lines in UTF-8; non-ASCII text stays as it is."""
    df.write.mode(mode).json(path)


def write_csv(df: DataFrame, path: str, mode: str = "errorifexists") -> None:
    df.write.mode(mode).option("header", True).option("encoding", "UTF-8").csv(path)


def write_named(df: DataFrame, path: str, name: str, value: str, order: Sequence[str] = ()) -> int:
    """One text file ``path``/``name`` for every name, with the values of its rows by ``order`` line by line; returns their number.

    A partitioned write makes a folder, a task file and a rename for every name, all of them put in place by the
    driver. Here tasks write the files where they stay, through the file system of ``path``, one open at a time, so a
    file may be longer than memory. A task that is run again writes its files anew.
    """
    files = max(int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")), df.sparkSession.sparkContext.defaultParallelism)
    rows = df.select(F.col(name).alias("_name"), F.col(value).alias("_value"), *order)
    dealt = rows.repartition(files, "_name").sortWithinPartitions("_name", *order).select("_name", "_value")

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, base = _file_system(path)
        made, at, out, n = set(), None, None, 0
        for batch in batches:
            names, values = (c.to_pylist() for c in batch.columns)
            first = 0
            while first < len(names):
                end = first
                while end < len(names) and names[end] == names[first]:
                    end += 1
                if names[first] != at:
                    if out:
                        out.close()
                    at, n = names[first], n + 1
                    target = f"{base}/{at}"
                    folder = target.rsplit("/", 1)[0]
                    if folder not in made:
                        store.create_dir(folder, recursive=True)
                        made.add(folder)
                    out = store.open_output_stream(target)
                out.write("".join(f"{v or ''}\n" for v in values[first:end]).encode())
                first = end
        if out:
            out.close()
        yield pa.RecordBatch.from_arrays([pa.array([n], pa.int64())], names=["n"])

    return dealt.mapInArrow(write, "n long").agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]


def _file_system(path: str) -> tuple[fs.FileSystem, str]:
    """The file system of a path or URI, and the path in it."""
    if path.startswith("file:"):
        path = "/" + path[len("file:"):].lstrip("/")
    return fs.FileSystem.from_uri(path.rstrip("/"))


def write_features(df: DataFrame, path: str, key: str = "image_id", mode: str = "errorifexists") -> None:
    """Feature store: one directory per split, rows clustered by sample key.

    Range partitioning on (split, key) bounds file sizes and gives row groups narrow key ranges.
    """
    df.repartitionByRange("split", key).sortWithinPartitions("split", key).write.mode(mode).partitionBy("split").parquet(path)


def read_feature(df: DataFrame, split: str, key: str, value) -> DataFrame:
    """One sample of a feature store: the split prunes directories, the key reaches the row groups."""
    return df.where((F.col("split") == split) & (F.col(key) == value))


def metric_report(report: DataFrame, matrix: DataFrame) -> DataFrame:
    """Class figures and confusion cells as one tidy table (section, row, col, metric, value)."""
    cells = F.array(*[
        F.struct(F.lit(m).alias("metric"), F.col(m).cast("double").alias("value")) for m in ("precision", "recall", "f1", "support")
    ])
    per_class = report.select(F.lit("class").alias("section"), F.col("cls").alias("row"), F.lit(None).cast("int").alias("col"),
                              F.explode(cells).alias("c")).select("section", "row", "col", "c.*")
    conf = matrix.select(F.lit("confusion").alias("section"), F.col("gt").alias("row"), F.col("pred").alias("col"),
                         F.lit("count").alias("metric"), F.col("n").cast("double").alias("value"))
    return per_class.unionByName(conf)


def class_mask(pixels: DataFrame, reduce_zero_label: bool = False) -> DataFrame:
    """Predicted classes as saved: moved up by one where labels were reduced when read."""
    return pixels.select("image_id", "row", "col", (F.col("pred") + (1 if reduce_zero_label else 0)).alias("value"))


def write_class_masks(pixels: DataFrame, path: str, reduce_zero_label: bool = False, mode: str = "errorifexists") -> None:
    """Masks clustered by image. Image ids may be many, so they are a sort key and not directories."""
    out = class_mask(pixels, reduce_zero_label)
    out.repartitionByRange("image_id", "row").sortWithinPartitions("image_id", "row", "col").write.mode(mode).parquet(path)


def box_features(boxes: DataFrame, classes: Sequence[str], affine) -> DataFrame:
    """Pixel boxes (x1, y1, x2, y2, class_id) as map rectangles with class names, geometry in GeoJSON."""
    a, b, c, d, e, f = affine

    def to_map(x, y):
        return F.col(x) * a + F.col(y) * b + c, F.col(x) * d + F.col(y) * e + f

    (gx1, gy1), (gx2, gy2) = to_map("x1", "y1"), to_map("x2", "y2")
    ring = geo.ring_of_rect(F.least(gx1, gx2), F.least(gy1, gy2), F.greatest(gx1, gx2), F.greatest(gy1, gy2))
    name = F.element_at(F.array(*[F.lit(n) for n in classes]), F.col("class_id") + 1)
    return boxes.withColumn("ring", ring).withColumn("geometry", geo.ring_to_geojson("ring")).withColumn("class_name", name)
