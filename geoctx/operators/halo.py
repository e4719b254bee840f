"""Neighbourhoods of pixels by a halo exchange.

Every pixel goes once to its own tile, and a copy of it to each neighbouring tile whose border it is near, so the shuffle
carries about (1 + 2 * halo / tile) ** 2 times the input. Inside a tile any step that looks up to ``halo`` pixels around is
array code, and only the tile's own pixels are returned: nothing is counted twice and no second exchange is needed.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence
from functools import cached_property

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType

#: Pixels on a side of a tile: a window of a few planes fits easily in a task, and its border is one part in a hundred.
TILE = 256


class Window:
    """The pixels of one tile and its halo as planes; ``[0, 0]`` of a plane is pixel ``(top, left)``."""

    def __init__(self, table: pa.Table, tile: int, halo: int) -> None:
        self._table, self.halo = table, halo
        row, col = (table[c].to_numpy() for c in ("row", "col"))
        tile_row, tile_col = table["_tr"][0].as_py(), table["_tc"][0].as_py()
        # planes cover what there is, with a border of the halo's width on every side
        self.top, self.left = int(row.min()) - halo, int(col.min()) - halo
        self.shape = (int(row.max()) + halo + 1 - self.top, int(col.max()) + halo + 1 - self.left)
        self._at = (row - self.top, col - self.left)
        clip = lambda v, n: min(max(v, 0), n)
        self._own = tuple(
            slice(clip(t * tile - o, n), clip((t + 1) * tile - o, n))
            for t, o, n in ((tile_row, self.top, self.shape[0]), (tile_col, self.left, self.shape[1])))

    def plane(self, name: str, fill=0) -> np.ndarray:
        values = self._table[name].to_numpy()
        out = np.full(self.shape, fill, values.dtype)
        out[self._at] = values
        return out

    def one(self, name: str):
        """A value that all rows share."""
        return self._table[name][0].as_py()

    @cached_property
    def present(self) -> np.ndarray:
        out = np.zeros(self.shape, bool)
        out[self._at] = True
        return out

    def inside(self, height: int, width: int) -> np.ndarray:
        """Which places of a plane lie in a raster of this size."""
        r, c = np.arange(self.shape[0]) + self.top, np.arange(self.shape[1]) + self.left
        return ((r >= 0) & (r < height))[:, None] & ((c >= 0) & (c < width))[None, :]

    def own(self, mask: np.ndarray) -> tuple[np.ndarray, np.ndarray, tuple]:
        """Row, column and place in a plane of the tile's own pixels where ``mask`` holds."""
        r, c = np.nonzero(mask[self._own])
        at = (r + self._own[0].start, c + self._own[1].start)
        return at[0] + self.top, at[1] + self.left, at


def shifted(plane: np.ndarray, down: int, right: int, fill=0) -> np.ndarray:
    """The plane's value ``down`` rows below and ``right`` columns to the right of each place; ``fill`` beyond the plane."""
    out = np.full_like(plane, fill)
    h, w = plane.shape
    to = lambda d, n: slice(max(-d, 0), max(min(n - d, n), 0))
    of = lambda d, n: slice(max(d, 0), max(min(n + d, n), 0))
    if abs(down) < h and abs(right) < w:
        out[to(down, h), to(right, w)] = plane[of(down, h), of(right, w)]
    return out


def grown(mask: np.ndarray, reach: int) -> np.ndarray:
    """True within ``reach`` rows and columns of a true place."""
    out = mask.copy()
    for d in range(1, reach + 1):
        out |= shifted(mask, d, 0, False) | shifted(mask, -d, 0, False)
    across = out.copy()
    for d in range(1, reach + 1):
        across |= shifted(out, 0, d, False) | shifted(out, 0, -d, False)
    return across


def shrunk(mask: np.ndarray, reach: int) -> np.ndarray:
    """True where all places within ``reach`` are true; beyond the plane everything is."""
    return ~grown(~mask, reach)


def tiles_near(position: str, halo: int, tile: int) -> Column:
    """Numbers of the tiles that need a pixel at this position: its own, and neighbours it is near."""
    at = F.col(position)
    return F.array_distinct(F.array(*[F.floor((at + d) / tile).cast("long") for d in sorted({0, -halo, halo})]))


def neighbourhoods(
    pixels: DataFrame, keys: Sequence[str], values: dict[str, Column], halo: int, step: Callable[[Window], dict[str, np.ndarray]], schema: str, tile: int = TILE,
) -> DataFrame:
    """``step`` of every tile's window: its columns (``schema``) with ``keys`` in front.

    ``values`` are the planes by name. ``step`` sees pixels up to ``halo`` rows and columns around its tile, and
    returns what belongs to the tile's own pixels. Rows without a position are left out; of pixels given twice one
    counts; a key may be NULL; an empty table gives no rows. ``halo`` may not exceed ``tile``.
    """
    if not 0 <= halo <= tile:
        raise ValueError("the halo is at most as wide as a tile")
    keys = list(keys)
    rows = pixels.where(F.col("row").isNotNull() & F.col("col").isNotNull())
    rows = rows.select(*keys, F.col("row").cast("long").alias("row"), F.col("col").cast("long").alias("col"), *[c.alias(n) for n, c in values.items()])
    rows = rows.withColumn("_tr", F.explode(tiles_near("row", halo, tile))).withColumn("_tc", F.explode(tiles_near("col", halo, tile)))
    out = StructType([pixels.schema[k] for k in keys] + StructType.fromDDL(schema).fields)
    arrow = to_arrow_schema(out)

    def run(table: pa.Table) -> pa.Table:
        made = step(Window(table, tile, halo))
        n = len(next(iter(made.values())))
        same = {k: pa.chunked_array([table[k].combine_chunks().take(pa.array(np.zeros(n, np.int64)))]) for k in keys}
        return pa.table([same[f.name].cast(f.type) if f.name in same else pa.array(made[f.name], f.type) for f in arrow], schema=arrow)

    return rows.groupBy(*keys, "_tr", "_tc").applyInArrow(run, out)
