"""Bucket of a key among many bounds: few comparisons per row."""

import pytest
from pyspark.sql import functions as F

from geoctx.operators.ranking import _bounds_up_to


@pytest.mark.parametrize("n", [1, 2, 3, 4, 9, 10, 57])
def test_every_place_among_the_bounds(spark, n):
    bounds = [F.struct(F.lit(2 * i).alias("v")) for i in range(n)]
    df = spark.range(-1, 2 * n + 1, 1, 1).select(F.col("id").cast("int").alias("v"))
    got = df.select("v", _bounds_up_to(bounds, F.struct("v")).alias("b")).collect()
    assert [r.b for r in got] == [sum(2 * i <= r.v for i in range(n)) for r in got]
