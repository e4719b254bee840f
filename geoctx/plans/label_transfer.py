"""Label transfer: footprints of one layer take the class of their best counterpart in another."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from geoctx.functions.clean import prefixed_id
from geoctx.operators.polygons import transfer_polygons
from geoctx.operators.transfer import transfer_rectangles


def transfer_labels(ours: DataFrame, theirs: DataFrame, city: str | None = None, cell: float = 60.0) -> DataFrame:
    """``build_id, matched_func, status, match_score, match_info``, every building once.

    Layers with a ``ring`` column go through the polygon path, layers with box columns through the
    rectangle path. ``city`` is put in front of the ids.
    """
    run = transfer_polygons if "ring" in ours.columns else transfer_rectangles
    out = run(ours, theirs, cell)
    return out.withColumn("build_id", prefixed_id(F.lit(city), "build_id")) if city else out
