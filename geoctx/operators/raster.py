"""Raster operators on pixel tables: one row per pixel, keyed by image (or city), row and column.

Window membership is computed per pixel with integer arithmetic, so cutting a raster into tiles,
overlapping or not, is a projection (with an explode where windows overlap) and never a range join.
"""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from geoctx.functions.arrays import l2_unit
from geoctx.operators import halo, ranking

# --- fixed values ---
GREY_WEIGHTS = (0.299, 0.587, 0.114)
HU_WINDOW = (-125.0, 275.0)
ORGAN_IDS = {1: 7, 2: 4, 3: 3, 4: 2, 6: 5, 7: 8, 8: 1, 11: 6}
PALETTE = [(0, 0, 0), (255, 255, 255), (255, 0, 0), (255, 255, 0), (0, 255, 0), (0, 255, 255), (0, 0, 255)]
DISC_IDS = {0: 1, 128: 2, 255: 0}
IGNORE = 255
# --- end of fixed values ---


def _col(c) -> Column:
    if isinstance(c, str):
        return F.col(c)
    return c if isinstance(c, Column) else F.lit(c)


# ---- extents and mosaics -------------------------------------------------------

def total_extent(df: DataFrame, groups: Sequence[str], resolution: float) -> DataFrame:
    """Common extent of many boxes and the raster size that covers it."""
    out = df.groupBy(*groups).agg(
        F.min("minx").alias("minx"), F.min("miny").alias("miny"),
        F.max("maxx").alias("maxx"), F.max("maxy").alias("maxy"),
    )
    return out.withColumn("width", F.round((F.col("maxx") - F.col("minx")) / resolution).cast("long")).withColumn(
        "height", F.round((F.col("maxy") - F.col("miny")) / resolution).cast("long"))


def merge_max(tiles: DataFrame, groups: Sequence[str], value: str, row_offset, col_offset) -> DataFrame:
    """Overlapping tiles to one raster; offsets (in pixels) are rounded, the largest value wins."""
    row = (F.col("row") + F.round(_col(row_offset))).cast("long")
    col = (F.col("col") + F.round(_col(col_offset))).cast("long")
    return tiles.groupBy(*groups, row.alias("row"), col.alias("col")).agg(F.max(value).alias(value))


def average_scores(scores: DataFrame, keys: Sequence[str], score: str = "score") -> DataFrame:
    """Mean of the scores all windows give a pixel."""
    return scores.groupBy(*keys).agg(F.avg(score).alias(score))


# ---- plain tiles ------------------------------------------------------------------

def with_tiles(pixels: DataFrame, size: int, height, width) -> DataFrame:
    """Adds tile and in-tile coordinates; tiles that would cross the lower or right edge are dropped."""
    t = pixels.withColumn("ty", F.floor(F.col("row") / size)).withColumn("tx", F.floor(F.col("col") / size))
    whole = ((F.col("ty") + 1) * size <= _col(height)) & ((F.col("tx") + 1) * size <= _col(width))
    return t.where(whole).withColumn("in_row", F.col("row") % size).withColumn("in_col", F.col("col") % size)


def tile_quality(tiles: DataFrame, keys: Sequence[str], bands: Sequence[str], nodata: int) -> DataFrame:
    """Share of pixels per tile with any band at the nodata value, and count of pixels with all bands zero."""
    any_nodata = F.lit(False)
    all_zero = F.lit(True)
    for b in bands:
        any_nodata = any_nodata | (F.col(b) == nodata)
        all_zero = all_zero & (F.col(b) == 0)
    return tiles.groupBy(*keys).agg(
        F.avg(any_nodata.cast("double")).alias("nodata_ratio"), F.sum(all_zero.cast("long")).alias("black"))


def tile_counters(pixels: DataFrame, keys: Sequence[str], size: int, height, width, bands: Sequence[str],
                  nodata: int, max_ratio: float) -> DataFrame:
    """How many tiles are saved, cut by the edge, or dropped for missing data."""
    t = pixels.withColumn("ty", F.floor(F.col("row") / size)).withColumn("tx", F.floor(F.col("col") / size))
    q = tile_quality(t, [*keys, "ty", "tx"], bands, nodata)
    cut = ((F.col("ty") + 1) * size > _col(height)) | ((F.col("tx") + 1) * size > _col(width))
    status = F.when(cut, "skip_edge").when(F.col("nodata_ratio") > max_ratio, "skip_nodata").otherwise("save")
    return q.groupBy(status.alias("tile_status")).agg(F.count(F.lit(1)).alias("n"))


def number_tiles(tiles: DataFrame, order: Sequence[str] = ("ty", "tx")) -> DataFrame:
    """Running number of the kept tiles in reading order, from 0."""
    ranked = ranking.ordered_rank(tiles, list(order), "_r")
    return ranked.withColumn("tile_no", F.col("_r") - 1).drop("_r")


# ---- overlapping windows: lists of starts along one axis ------------------------------

def sliding_starts(extent, size: int, step: int) -> Column:
    """Starts at 0, step, 2 step, ... below the extent; the ones that would cross the end are shifted back."""
    n = F.greatest(_col(extent).cast("long"), F.lit(size))
    ks = F.sequence(F.lit(0).cast("long"), F.floor((n - 1) / step))
    return F.transform(ks, lambda k: F.least(k * step, n - size))


def covering_starts(extent, size: int, step: int) -> Column:
    """The fewest windows that cover the extent, the last one shifted back inside."""
    n = _col(extent).cast("long")
    count = F.floor(F.greatest(n - size + step - 1, F.lit(0)) / step) + 1
    return F.transform(
        F.sequence(F.lit(0).cast("long"), count - 1),
        lambda k: F.greatest(F.least(k * step + size, n) - size, F.lit(0)))


def clip_boxes(extent, size: int, step: int, legacy_stride: bool = False) -> Column:
    """(start, end) of clip boxes along one axis.

    Box count follows the stride. Boxes are placed by the stride, or, with ``legacy_stride``, by the box
    size, which repeats the last box.
    """
    n = _col(extent).cast("long")
    count = F.ceil((n - size) / step)
    place = size if legacy_stride else step
    ks = F.when(count < 0, F.array().cast("array<bigint>")).otherwise(
        F.sequence(F.lit(0).cast("long"), F.greatest(count, F.lit(0)).cast("long")))
    return F.transform(ks, lambda k: F.struct(
        F.greatest(F.least(k * place, n - size), F.lit(0)).alias("start"),
        F.least(k * place + size, n).alias("end")))


def inference_grid(extent, size: int, stride: int) -> Column:
    """Per window along one axis: offset, crop offset and crop size once half the overlap is cut away."""
    n = _col(extent).cast("long")
    half = (size - stride + 1) // 2
    ks = F.sequence(F.lit(0).cast("long"), F.floor((n - 1) / stride))

    def window(k):
        at_end = k * stride + size >= n
        offset = F.when(at_end, n - size).otherwise(k * stride)
        crop = F.when(offset == 0, 0).otherwise(half).cast("long")
        return F.struct(k.alias("k"), offset.alias("offset"), crop.alias("crop_off"),
                        F.when(at_end, F.lit(size).cast("long")).otherwise(size - crop).alias("crop_size"))

    return F.transform(ks, window)


def write_back(scores: DataFrame, keys: Sequence[str], score: str = "score") -> DataFrame:
    """Window scores to one raster from the windows' cores: (keys, row, col, score).

    ``scores`` has ``row, col`` in the whole raster and the windows ``gy, gx`` (of ``inference_grid``) that gave the
    score. A pixel outside its window's core is left out; where cores overlap, at a window shifted back inside, the
    last window in reading order stays. One map-side combined aggregate by pixel.
    """
    def inside(pos: str, window: str) -> Column:
        first = F.col(f"{window}.offset") + F.col(f"{window}.crop_off")
        return (F.col(pos) >= first) & (F.col(pos) < first + F.col(f"{window}.crop_size"))

    core = scores.where(inside("row", "gy") & inside("col", "gx"))
    return core.groupBy(*keys, "row", "col").agg(F.max_by(score, F.struct("gy.k", "gx.k")).alias(score))


def windows_of(pos, extent, size: int, step: int) -> Column:
    """Numbers of the ``sliding_starts`` windows that hold position ``pos``: at most size / step + the shifted ones."""
    p, n = _col(pos).cast("long"), F.greatest(_col(extent).cast("long"), F.lit(size))
    first = F.greatest(F.lit(0), F.floor((p - size) / step) + 1)
    last = F.when(p >= n - size, F.floor((n - 1) / step)).otherwise(F.floor(p / step))
    return F.filter(
        F.sequence(F.least(first, last), last),
        lambda k: (F.least(k * step, n - size) <= p) & (p < F.least(k * step, n - size) + size))


def covering_windows_of(pos, extent, size: int, step: int) -> Column:
    """Numbers of the ``covering_starts`` windows that hold position ``pos``."""
    p, n = _col(pos).cast("long"), _col(extent).cast("long")
    last_k = F.floor(F.greatest(n - size + step - 1, F.lit(0)) / step)
    first = F.greatest(F.lit(0), F.floor((p - size) / step) + 1)
    last = F.when(p >= n - size, last_k).otherwise(F.least(F.floor(p / step), last_k))

    def start(k):
        return F.greatest(F.least(k * step + size, n) - size, F.lit(0))

    return F.filter(F.sequence(F.least(first, last), last), lambda k: (start(k) <= p) & (p < start(k) + size))


def pad_small(pixels: DataFrame, sizes: DataFrame, size: int, fills: dict[str, int], key: str = "image_id") -> DataFrame:
    """Adds the missing rows and columns of images smaller than the window (sizes: key, height, width)."""
    small = sizes.where((F.col("height") < size) | (F.col("width") < size))
    h, w = F.greatest(F.col("height"), F.lit(size)), F.greatest(F.col("width"), F.lit(size))
    grid = (
        small.withColumn("row", F.explode(F.sequence(F.lit(0), (h - 1).cast("int"))))
        .withColumn("col", F.explode(F.sequence(F.lit(0), (w - 1).cast("int"))))
        .where((F.col("row") >= F.col("height")) | (F.col("col") >= F.col("width")))
    )
    pad = grid.select(key, "row", "col", *[F.lit(v).cast(pixels.schema[c].dataType).alias(c) for c, v in fills.items()])
    return pixels.select(key, "row", "col", *fills).unionByName(pad)


def centred_crop(df: DataFrame, row, col, size: int, height: int, width: int) -> DataFrame:
    """Window of ``size`` around a pixel, shifted back at the borders; rasters smaller than the window drop out."""
    def start(c, n):
        return F.least(F.greatest((_col(c) - size / 2).cast("long"), F.lit(0)), F.lit(n - size))

    out = df.withColumn("row_off", start(row, height)).withColumn("col_off", start(col, width))
    return out.where((F.col("row_off") >= 0) & (F.col("col_off") >= 0))


def balanced_crops(tiles: DataFrame, keys: Sequence[str], cls: str, max_share: float = 0.75, ignore: int = IGNORE) -> DataFrame:
    """Tiles with more than one class (ignored pixels aside) whose largest class stays below ``max_share``."""
    per = tiles.where(F.col(cls) != ignore).groupBy(*keys, cls).agg(F.count(F.lit(1)).alias("n"))
    stats = per.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("classes"), (F.max("n") / F.sum("n")).alias("top_share"))
    return stats.where((F.col("classes") > 1) & (F.col("top_share") < max_share))


# ---- neighbourhoods ---------------------------------------------------------------

_PLACE = "row long, col long"


def _sized(height, width) -> dict[str, Column]:
    return {"_h": _col(height).cast("long"), "_w": _col(width).cast("long")}


def _places(w: halo.Window, mask) -> dict:
    row, col, _ = w.own(mask)
    return {"row": row, "col": col}


def dilate(pixels: DataFrame, keys: Sequence[str], height, width, width_px: int = 3, tile: int = halo.TILE) -> DataFrame:
    """Foreground pixels (a sparse table) grown by a square of odd side ``width_px``, inside the raster."""
    r = width_px // 2

    def step(w: halo.Window) -> dict:
        return _places(w, halo.grown(w.present, r) & w.inside(w.one("_h"), w.one("_w")))

    return halo.neighbourhoods(pixels, keys, _sized(height, width), r, step, _PLACE, tile)


def erode(pixels: DataFrame, keys: Sequence[str], height, width, tile: int = halo.TILE) -> DataFrame:
    """Foreground pixels whose 3 x 3 block (as far as it lies in the raster) is all foreground."""

    def step(w: halo.Window) -> dict:
        inside = w.inside(w.one("_h"), w.one("_w"))
        return _places(w, halo.shrunk(w.present | ~inside, 1) & inside)

    return halo.neighbourhoods(pixels, keys, _sized(height, width), 1, step, _PLACE, tile)


def closing(pixels: DataFrame, keys: Sequence[str], height, width, tile: int = halo.TILE) -> DataFrame:
    """3 x 3 closing of a sparse foreground table: dilate, then erode, behind one exchange."""

    def step(w: halo.Window) -> dict:
        inside = w.inside(w.one("_h"), w.one("_w"))
        return _places(w, halo.shrunk(halo.grown(w.present & inside, 1) | ~inside, 1) & inside)

    return halo.neighbourhoods(pixels, keys, _sized(height, width), 2, step, _PLACE, tile)


def _edge_mask(labels, known):
    """Where a known label differs from a known neighbour above, to the right, below right or below left."""
    out = np.zeros(labels.shape, bool)
    for i, j in ((-1, 0), (0, 1), (1, 1), (1, -1)):
        out |= halo.shifted(known, i, j, False) & (halo.shifted(labels, i, j) != labels)
    return out & known


def edges(pixels: DataFrame, key: str, label: str, ignore: int = IGNORE, tile: int = halo.TILE) -> DataFrame:
    """Pixels that differ from a neighbour above, to the right, below right or below left, both not ignored."""

    def step(w: halo.Window) -> dict:
        return _places(w, _edge_mask(w.plane("_a"), w.present))

    known = pixels.where(F.col(label) != ignore)
    return halo.neighbourhoods(known, [key], {"_a": F.col(label)}, 1, step, _PLACE, tile)


def dilated_edges(pixels: DataFrame, key: str, label: str, height, width, width_px: int = 3, ignore: int = IGNORE, tile: int = halo.TILE) -> DataFrame:
    """The edges grown by a square of odd side ``width_px``, inside the raster, behind one exchange."""
    r = width_px // 2

    def step(w: halo.Window) -> dict:
        found = _edge_mask(w.plane("_a"), w.present)
        return _places(w, halo.grown(found, r) & w.inside(w.one("_h"), w.one("_w")))

    known = pixels.where(F.col(label) != ignore)
    return halo.neighbourhoods(known, [key], {"_a": F.col(label)} | _sized(height, width), r + 1, step, _PLACE, tile)


# ---- pixel values -----------------------------------------------------------------

def colour_classes(pixels: DataFrame, palette: DataFrame) -> DataFrame:
    """Colour to class id by (r, g, b); unknown colours are class 0."""
    return pixels.join(palette, ["r", "g", "b"], "left").withColumn("cls", F.coalesce("cls", F.lit(0)))


def reduce_zero_label(value) -> Column:
    v = _col(value)
    return F.when(v.isin(0, IGNORE), IGNORE).otherwise(v - 1).cast("int")


def remap(value, table: dict[int, int], default=None) -> Column:
    """Value through a small fixed table; values outside it keep their value or get the default."""
    v = _col(value)
    m = F.create_map(*[F.lit(x) for kv in table.items() for x in kv])
    return F.coalesce(m[v], v if default is None else F.lit(default)).cast("int")


def rescale_slice(value, window=HU_WINDOW) -> Column:
    """Clip to the window and stretch it to 0..255."""
    low, high = window
    return (F.least(F.greatest(_col(value), F.lit(low)), F.lit(high)) - low) / (high - low) * 255


def grey(r="r", g="g", b="b", weights=GREY_WEIGHTS) -> Column:
    wr, wg, wb = weights
    return _col(r) * wr + _col(g) * wg + _col(b) * wb


def rerange(pixels: DataFrame, key: str, value: str, low: float = 0.0, high: float = 255.0) -> DataFrame:
    """Min-max stretch per image. The limits come from an aggregate joined back, not from a whole-image window."""
    limits = pixels.groupBy(key).agg(F.min(value).alias("_lo"), F.max(value).alias("_hi"))
    scaled = (F.col(value) - F.col("_lo")) / F.nullif(F.col("_hi") - F.col("_lo"), F.lit(0.0)) * (high - low) + low
    return pixels.join(limits, key).withColumn(value, scaled).drop("_lo", "_hi")


def function_map(mask, cls) -> Column:
    return F.when(_col(mask) == 1, _col(cls) + 1).otherwise(0).cast("int")


def unpad_unflip(scores: DataFrame, pad, flip: Column, height: int, width: int) -> DataFrame:
    """Score pixels back to image coordinates: padding (left, right, top, bottom) cut, flip undone."""
    left, right, top, bottom = pad
    h, w = height - top - bottom, width - left - right
    r, c = F.col("row") - top, F.col("col") - left
    inside = scores.where((r >= 0) & (r < h) & (c >= 0) & (c < w))
    return inside.select(
        *[x for x in scores.columns if x not in ("row", "col")],
        F.when(flip == "vertical", h - 1 - r).otherwise(r).alias("row"),
        F.when(flip == "horizontal", w - 1 - c).otherwise(c).alias("col"))


def best_class(scores: DataFrame, keys: Sequence[str], cls: str = "cls", score: str = "score") -> DataFrame:
    """Class of the highest score per pixel, the lowest class on ties."""
    return scores.groupBy(*keys).agg(F.max_by(cls, F.struct(F.col(score), -F.col(cls))).alias("pred"))


# ---- masks and image features -----------------------------------------------------

def mask_bbox(pixels: DataFrame, key: str, mask: str, height: int, width: int) -> DataFrame:
    """Bounds of the foreground (inclusive); an empty mask gives the whole image."""
    on = F.col(mask) > 0

    def edge(fn, c):
        return fn(F.when(on, F.col(c)))

    t = pixels.groupBy(key).agg(
        edge(F.min, "col").alias("x1"), edge(F.min, "row").alias("y1"),
        edge(F.max, "col").alias("x2"), edge(F.max, "row").alias("y2"))
    whole = {"x1": 0, "y1": 0, "x2": width, "y2": height}
    return t.select(key, *[F.coalesce(c, F.lit(v)).alias(c) for c, v in whole.items()])


def square_box(bbox: DataFrame, height: int, width: int, expand: float = 0.3) -> DataFrame:
    """Square around the box, grown by ``expand`` per side and clamped (bounds half open)."""
    x1, y1, x2, y2 = (F.col(c) for c in ("x1", "y1", "x2", "y2"))
    w, h = x2 + 1 - x1, y2 + 1 - y1
    half = F.greatest(w, h) * (1.0 + 2.0 * expand) / 2.0
    cx, cy = (x1 + x2 + 1) / 2.0, (y1 + y2 + 1) / 2.0

    def low(c):
        return F.greatest(F.lit(0), F.bround(c - half).cast("int"))

    def high(c, n):
        return F.least(F.lit(n), F.bround(c + half).cast("int"))

    return bbox.select("*", low(cx).alias("left"), low(cy).alias("upper"),
                       high(cx, width).alias("right"), high(cy, height).alias("lower"))


def grown_box(bbox: DataFrame, height: int, width: int, expand: float = 0.15) -> DataFrame:
    """Box grown by a share of its sides (cut to whole pixels) and clamped."""
    ew = F.floor((F.col("x2") - F.col("x1")) * expand)
    eh = F.floor((F.col("y2") - F.col("y1")) * expand)
    return bbox.select(
        "*", F.greatest(F.lit(0), F.col("x1") - ew).alias("left"), F.greatest(F.lit(0), F.col("y1") - eh).alias("upper"),
        F.least(F.lit(width), F.col("x2") + ew).alias("right"), F.least(F.lit(height), F.col("y2") + eh).alias("lower"))


def colour_histogram(pixels: DataFrame, key: str, mask: str, channels: Sequence[str] = ("b", "g", "r"), bins: int = 16) -> DataFrame:
    """Share of masked pixels per channel and bin, all bins listed."""
    width = 256 // bins
    on = F.col(mask) > 0
    cells = [
        F.sum((on & (F.floor(F.col(c) / width) == i)).cast("long")).alias(f"_{c}_{i}") for c in channels for i in range(bins)
    ]
    t = pixels.groupBy(key).agg(F.sum(on.cast("long")).alias("_n"), *cells)
    values = F.array(*[F.col(f"_{c}_{i}") / (F.col("_n") + 1e-6) for c in channels for i in range(bins)])
    return t.select(key, values.alias("hist"))


GLCM_OFFSETS = [(0, 1), (1, 1), (1, 0), (1, -1)]  # 0, 45, 90, 135 degrees


def cooccurrence(pixels: DataFrame, key: str, level: str, tile: int = halo.TILE) -> DataFrame:
    """Symmetric pair counts per angle; level 0 is background and takes no part.

    Pairs are counted inside tiles, so what is aggregated is one row per tile, angle and pair of levels.
    """

    def step(w: halo.Window) -> dict:
        levels = w.plane("_l")
        parts = []
        for angle, (down, right) in enumerate(GLCM_OFFSETS):
            other = halo.shifted(levels, down, right)
            at = w.own((levels > 0) & (other > 0))[2]
            pairs, n = np.unique(np.stack([levels[at], other[at]], axis=1), axis=0, return_counts=True)
            parts.append((np.full(len(n), angle), pairs[:, 0], pairs[:, 1], n))
        return dict(zip(("angle", "i", "j", "n"), map(np.concatenate, zip(*parts))))

    on = pixels.where(F.col(level) > 0)
    counted = halo.neighbourhoods(on, [key], {"_l": F.col(level).cast("long")}, 1, step, "angle int, i int, j int, n long", tile)
    pairs = counted.groupBy(key, "angle", "i", "j").agg(F.sum("n").alias("n"))
    both = F.array(F.struct("i", "j"), F.struct(F.col("j").alias("i"), F.col("i").alias("j")))
    return pairs.select(key, "angle", "n", F.explode(both).alias("p")).groupBy(
        key, "angle", F.col("p.i").alias("i"), F.col("p.j").alias("j")).agg(F.sum("n").alias("n"))


def texture(glcm: DataFrame, key: str) -> DataFrame:
    """Contrast, homogeneity, energy and correlation per image and angle, from pair counts."""
    i, j, n = F.col("i").cast("double"), F.col("j").cast("double"), F.col("n").cast("double")
    d2 = (i - j) * (i - j)
    s = glcm.groupBy(key, "angle").agg(
        F.sum(n).alias("t"), F.sum(n * d2).alias("con"), F.sum(n / (1 + d2)).alias("hom"), F.sum(n * n).alias("sq"),
        F.sum(n * i).alias("si"), F.sum(n * j).alias("sj"), F.sum(n * i * i).alias("sii"),
        F.sum(n * j * j).alias("sjj"), F.sum(n * i * j).alias("sij"))
    t = F.col("t")
    vi = F.col("sii") / t - (F.col("si") / t) * (F.col("si") / t)
    vj = F.col("sjj") / t - (F.col("sj") / t) * (F.col("sj") / t)
    cov = F.col("sij") / t - (F.col("si") / t) * (F.col("sj") / t)
    flat = (vi <= 1e-9) | (vj <= 1e-9)
    corr = F.when(flat, 1.0).otherwise(F.try_divide(cov, F.sqrt(F.greatest(vi * vj, F.lit(0.0)))))
    return s.select(
        key, "angle", (F.col("con") / t).alias("contrast"), (F.col("hom") / t).alias("homogeneity"),
        (F.sqrt("sq") / t).alias("energy"), corr.alias("correlation"))


def grey_level(r="r", g="g", b="b", mask="mask") -> Column:
    """Grey value moved to 1..255, with 0 outside the mask."""
    v = F.round(F.round(grey(r, g, b)) * (254.0 / 255.0) + 1).cast("int")
    return F.when(_col(mask) == 0, 0).otherwise(v)


def gradient_histogram(pixels: DataFrame, key: str, value: str, height: int, width: int, cell: int = 8, bins: int = 9, tile: int = halo.TILE) -> DataFrame:
    """Orientation histogram per block of 2 x 2 cells, normalised twice with a clip at 0.2.

    Gradients are central differences (0 at the border); a pixel gives its magnitude to one bin. A missing pixel
    counts 0. A tile returns its cells' histograms, so no pixel is aggregated outside its tile.
    """
    tile = max(tile // cell, 1) * cell  # cells never reach over a tile's border

    def step(w: halo.Window) -> dict:
        v = w.plane("_v", 0.0)
        inside = w.inside(height, width)
        row, col = np.arange(w.shape[0])[:, None] + w.top, np.arange(w.shape[1])[None, :] + w.left
        gy = np.where((row == 0) | (row == height - 1), 0.0, halo.shifted(v, 1, 0) - halo.shifted(v, -1, 0))
        gx = np.where((col == 0) | (col == width - 1), 0.0, halo.shifted(v, 0, 1) - halo.shifted(v, 0, -1))
        r, c, at = w.own(inside)
        angle = np.mod(np.degrees(np.arctan2(gy[at], gx[at])), 180.0)
        which = np.minimum((angle // (180.0 / bins)).astype(np.int64), bins - 1)
        cells, place = np.unique(np.stack([r // cell, c // cell], axis=1), axis=0, return_inverse=True)
        sums = np.bincount(place.ravel() * bins + which, np.hypot(gy[at], gx[at]), len(cells) * bins) / (cell * cell)
        return {"cy": cells[:, 0], "cx": cells[:, 1], "h": sums.reshape(-1, bins).tolist()}

    hist = halo.neighbourhoods(pixels, [key], {"_v": F.col(value).cast("double")}, 1, step, "cy int, cx int, h array<double>", tile)
    corners = F.array(*[F.struct(F.lit(a).alias("a"), F.lit(b).alias("b")) for a in (0, 1) for b in (0, 1)])
    last_y, last_x = height // cell - 2, width // cell - 2
    blocks = (
        hist.withColumn("_c", F.explode(corners))
        .select(key, (F.col("cy") - F.col("_c.a")).alias("by"), (F.col("cx") - F.col("_c.b")).alias("bx"),
                F.struct(F.col("_c.a").alias("a"), F.col("_c.b").alias("b"), "h").alias("part"))
        .where(F.col("by").between(0, last_y) & F.col("bx").between(0, last_x))
        .groupBy(key, "by", "bx").agg(F.array_sort(F.collect_list("part")).alias("parts"))  # always 4 cells
    )

    flat = F.flatten(F.transform("parts", lambda q: q["h"]))
    clipped = F.transform(l2_unit(flat, 1e-10), lambda x: F.least(x, F.lit(0.2)))
    return blocks.select(key, "by", "bx", l2_unit(clipped, 1e-10).alias("hog"))
