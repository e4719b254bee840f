"""Context corpus: labelled buildings, their nearest points, bands and prompts, in one lazy plan."""

from __future__ import annotations

from pyspark.sql import DataFrame

from geoctx.operators import context
from geoctx.operators.spatial_join import nearest_k

RADIUS, MAX_POI, MIN_POI = 300.0, 100, 3


def context_prompts(
    centers: DataFrame, points: DataFrame, radius: float = RADIUS, k: int = MAX_POI,
    min_count: int = MIN_POI, words=None,
) -> DataFrame:
    """``build_id, n_poi, prompt`` for centres (build_id, x, y) and points (poi_id, x, y, type_en)."""
    pairs = nearest_k(
        centers.select("build_id", "x", "y"), points.select("poi_id", "x", "y", "type_en"), radius, k,
        lists=["type_en"])
    return context.prompts(context.with_bands(pairs), words=words, min_count=min_count)
