"""Connected components of sparse foreground tables, tile by tile with a merge across seams.

Pixels are labelled inside bounded tiles (numpy in an Arrow group per tile). Labels that touch across
a tile seam form a small graph whose components are found by repeated joins; only seam labels, never
pixels, go through those rounds.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from geoctx.session import cut_lineage


def _label_tiles(tiles: np.ndarray, rows: np.ndarray, cols: np.ndarray, diagonal: bool) -> np.ndarray:
    """Index of the first pixel of each pixel's component; pixels are sorted by tile, row and column."""
    n = len(rows)
    if not n:
        return np.zeros(0, np.int64)
    joins = (tiles[1:] == tiles[:-1]) & (rows[1:] == rows[:-1]) & (cols[1:] == cols[:-1] + 1)
    run = np.concatenate([[0], np.cumsum(~joins)])  # runs of neighbours in a row
    first = np.concatenate([[0], np.flatnonzero(~joins) + 1])
    top, left = rows.min(), cols.min()
    height, width = int(rows.max() - top) + 3, int(cols.max() - left) + 3
    spot = (tiles * height + (rows - top)) * width + (cols - left) + 1  # in order, and a step off an edge meets nobody
    pairs = []
    for side in (-1, 0, 1) if diagonal else (0,):
        at = np.minimum(np.searchsorted(spot, spot + width + side), n - 1)
        met = spot[at] == spot + width + side
        pairs.append(np.stack([run[met], run[at[met]]]))
    a, b = np.unique(np.concatenate(pairs, axis=1), axis=1)
    label = np.arange(len(first))
    while True:  # the smallest run reachable, with jumps along labels
        low, new = np.minimum(label[a], label[b]), label.copy()
        np.minimum.at(new, a, low)
        np.minimum.at(new, b, low)
        np.minimum.at(new, label[a], low)
        np.minimum.at(new, label[b], low)
        new = new[new]
        if (new == label).all():
            return first[label[run]]
        label = new


#: Pixels labelled together at most on average: several small tiles, or one large one.
GROUP_PIXELS = 200_000


#: Rows of a join or an aggregate that one task holds, at about.
TASK_ROWS = 200_000


def dealt(df: DataFrame, rows: int, *columns: str) -> DataFrame:
    """``df`` of about ``rows`` rows in tasks of a fixed size by ``columns``; a few tasks' rows are left to the optimizer.

    The tables here are narrow and shrink much as files, so tasks cut by file size would grow with the input.
    """
    parts = -(-rows // TASK_ROWS)
    return df.repartition(parts, *columns) if parts > df.sparkSession.sparkContext.defaultParallelism else df


def pixel_numbers(pixels: DataFrame, width: int | None) -> tuple[int, int]:
    """Number of columns for ``row * width + col``, and the number of pixels. A width that is too small is refused."""
    widest, n = pixels.agg(F.max("col"), F.count(F.lit(1))).first()
    needed = (widest or 0) + 1
    if width is None:
        return max(1 << 24, 1 << (needed - 1).bit_length()), n
    if width < needed:
        raise ValueError(f"width {width} is too small for column {widest}")
    return width, n


def label_components(pixels: DataFrame, key: str = "image_id", tile: int = 512, diagonal: bool = False,
                     width: int | None = None) -> DataFrame:
    """Adds ``component`` to (key, row, col) foreground pixels; keys may be of any type.

    The number of a component is that of its first pixel in reading order, ``row * width + col``. ``width`` is
    2 ** 24, or more where the table has more columns.
    """
    width, n = pixel_numbers(pixels, width)
    kind = pixels.schema[key].dataType.simpleString()
    t = pixels.select(key, F.col("row").cast("int").alias("row"), F.col("col").cast("int").alias("col"))
    t = t.withColumn("_ty", F.floor(F.col("row") / tile)).withColumn("_tx", F.floor(F.col("col") / tile))
    groups = max(-(-n // GROUP_PIXELS), t.sparkSession.sparkContext.defaultParallelism)
    t = t.withColumn("_g", F.pmod(F.xxhash64(key, "_ty", "_tx"), F.lit(groups)))

    def label(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.assign(_t=pdf.groupby([key, "_ty", "_tx"], sort=False, dropna=False).ngroup())
        pdf = pdf.sort_values(["_t", "row", "col"], ignore_index=True)
        rows, cols = pdf["row"].to_numpy().astype("int64"), pdf["col"].to_numpy().astype("int64")
        roots = _label_tiles(pdf["_t"].to_numpy().astype("int64"), rows, cols, diagonal)
        return pdf.assign(local=(rows * width + cols)[roots])[[key, "row", "col", "local"]]

    schema = f"`{key}` {kind}, row int, col int, local long"
    local = cut_lineage(dealt(t, n, "_g").groupBy("_g").applyInPandas(label, schema))
    seams = _seam_pairs(local, key, tile, diagonal, n)
    merged = merge_labels(seams, key)
    return dealt(local, n, key, "local").join(dealt(merged, n, key, "local"), [key, "local"], "left").select(
        key, "row", "col", F.coalesce("root", "local").alias("component"))


def _seam_pairs(local: DataFrame, key: str, tile: int, diagonal: bool, n: int = 0) -> DataFrame:
    """Distinct pairs of labels that touch across a seam. Only pixels on tile borders take part; ``n`` pixels in all."""
    at_end = (F.col("row") % tile == tile - 1) | (F.col("col") % tile == tile - 1)
    at_start = (F.col("row") % tile == 0) | (F.col("col") % tile == 0)
    border = local.where(at_end | at_start)
    steps = [(0, 1), (1, 0)] + ([(1, 1), (1, -1)] if diagonal else [])
    o = F.array(*[F.struct(F.lit(i).alias("i"), F.lit(j).alias("j")) for i, j in steps])
    asks = border.withColumn("_o", F.explode(o)).select(
        key, F.col("local").alias("a"), (F.col("row") + F.col("_o.i")).alias("row"), (F.col("col") + F.col("_o.j")).alias("col"))
    at, asked = (key, "row", "col"), len(steps) * n
    met = dealt(asks, asked, *at).join(dealt(border.withColumnRenamed("local", "b"), asked, *at), [*at])
    return dealt(met.where(F.col("a") != F.col("b")).select(key, "a", "b"), n, key, "a", "b").distinct()


def merge_labels(pairs: DataFrame, key: str, rounds: int = 64) -> DataFrame:
    """Smallest label reachable from every label: (key, local, root).

    Each round hooks every label to the smallest root among its neighbours and then jumps over its
    root's root, so the number of rounds grows with the logarithm of a chain's length. A round joins
    tables of seam labels only; lineage is cut after each.
    """
    edges = cut_lineage(pairs.select(key, "a", "b").unionByName(
        pairs.select(key, F.col("b").alias("a"), F.col("a").alias("b"))).distinct())
    n = edges.count()
    state = cut_lineage(edges.select(key, F.col("a").alias("local")).distinct().withColumn("root", F.col("local")))
    for _ in range(rounds):
        hooked = (
            dealt(edges, n, key, "b").join(dealt(state.select(key, F.col("local").alias("b"), F.col("root").alias("rb")), n, key, "b"), [key, "b"])
            .join(state.select(key, F.col("local").alias("a"), F.col("root").alias("ra")), [key, "a"])
            .groupBy(key, F.col("ra").alias("local")).agg(F.min("rb").alias("low"))
        )
        # root of a root: the smallest neighbour of any of its members, if smaller
        roots = dealt(state.select(key, F.col("root").alias("local")), n, key, "local").distinct().join(hooked, [key, "local"], "left").select(
            key, F.col("local").alias("r"), F.least("local", F.coalesce("low", "local")).alias("next"))
        step = dealt(state, n, key, "root").join(roots.withColumnRenamed("r", "root"), [key, "root"]).select(key, "local", "root", "next")
        # jump once more through the new parent
        jump = step.select(key, F.col("local").alias("next"), F.col("next").alias("next2"))
        new = cut_lineage(step.join(jump, [key, "next"], "left").select(
            key, "local", F.col("root").alias("old"), F.coalesce("next2", "next").alias("root")))
        state = new.select(key, "local", "root")
        if new.where(F.col("old") != F.col("root")).isEmpty():
            return state
    raise RuntimeError("labels did not settle")


def component_stats(labelled: DataFrame, key: str = "image_id") -> DataFrame:
    """Area and centroid (mean row and column) per component."""
    return labelled.groupBy(key, "component").agg(
        F.count(F.lit(1)).alias("area"), F.avg("row").alias("row"), F.avg("col").alias("col"))


def require_single(stats: DataFrame, key: str = "image_id") -> DataFrame:
    """Fails the job for an image with more than one component."""
    counted = stats.groupBy(key).agg(F.count(F.lit(1)).alias("_n"))
    message = F.concat(F.lit("more than one component in image "), F.col(key).cast("string"))
    checked = counted.select(key, F.when(F.col("_n") == 1, 1).otherwise(F.raise_error(message).cast("int")).alias("_n"))
    return stats.join(checked.where(F.col("_n") == 1).select(key), key)
