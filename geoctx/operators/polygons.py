"""General polygons: overlap of pairs, validity, rasterising, outlines of pixel components and their nesting.

Only the geometry of one pair (or one ring) runs in Python, inside Arrow UDFs and after the grid join has
cut the pairs down; everything that grows with the data is joins and aggregates.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from geoctx.functions import geo
from geoctx.operators import halo, transfer
from geoctx.operators.components import GROUP_PIXELS, dealt, pixel_numbers
from geoctx.operators.overlay import pair_geometry
from geoctx.operators.ranking import ordered_rank
from geoctx.operators.spatial_join import bbox_join
from geoctx.session import cut_lineage

# ---- overlap of two simple polygons ---------------------------------------------


def _cuts(x, y):
    return np.column_stack([x[:-1], y[:-1], x[1:], y[1:]])


def _crossing_heights(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """y of every proper crossing between two edge lists."""
    ax, ay, bx, by = (a[:, i, None] for i in range(4))
    cx, cy, dx, dy = (b[None, :, i] for i in range(4))
    den = (bx - ax) * (dy - cy) - (by - ay) * (dx - cx)
    with np.errstate(divide="ignore", invalid="ignore"):
        t = ((cx - ax) * (dy - cy) - (cy - ay) * (dx - cx)) / den
        u = ((cx - ax) * (by - ay) - (cy - ay) * (bx - ax)) / den
        hit = (den != 0) & (t >= 0) & (t <= 1) & (u >= 0) & (u <= 1)
        return (ay + t * (by - ay))[hit]


def _spans(edges: np.ndarray, y: float, y0: float, y1: float):
    """Edges crossing height y, by x there, each with its x at the slab's two ends."""
    lo, hi = np.minimum(edges[:, 1], edges[:, 3]), np.maximum(edges[:, 1], edges[:, 3])
    e = edges[(lo <= y) & (y < hi)]
    slope = (e[:, 2] - e[:, 0]) / (e[:, 3] - e[:, 1])

    def at(h):
        return e[:, 0] + slope * (h - e[:, 1])

    order = np.argsort(at(y))
    return at(y0)[order], at(y1)[order]


def _overlap_area(ax, ay, bx, by) -> float:
    """Common area by slabs: between two cut heights no edges cross, so the parts are trapezoids."""
    a, b = _cuts(ax, ay), _cuts(bx, by)
    ys = np.unique(np.concatenate([ay, by, _crossing_heights(a, b)]))
    total = 0.0
    for y0, y1 in zip(ys[:-1], ys[1:]):
        mid = (y0 + y1) / 2
        a0, a1 = _spans(a, mid, y0, y1)
        b0, b1 = _spans(b, mid, y0, y1)
        for i in range(0, len(a0) - 1, 2):
            for j in range(0, len(b0) - 1, 2):
                low = max(a0[i], b0[j]), max(a1[i], b1[j])
                high = min(a0[i + 1], b0[j + 1]), min(a1[i + 1], b1[j + 1])
                total += max(0.0, (high[0] - low[0] + high[1] - low[1]) / 2) * (y1 - y0)
    return total


def _segments_touch(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """For all pairs of edges of two lists, whether they have a point in common."""

    def side(p, q, r):  # orientation of r against p -> q, for all pairs
        return np.sign((q[0] - p[0]) * (r[1] - p[1]) - (q[1] - p[1]) * (r[0] - p[0]))

    p, q = (a[:, 0, None], a[:, 1, None]), (a[:, 2, None], a[:, 3, None])
    r, s = (b[None, :, 0], b[None, :, 1]), (b[None, :, 2], b[None, :, 3])
    apart = (
        (np.maximum(p[0], q[0]) < np.minimum(r[0], s[0])) | (np.maximum(r[0], s[0]) < np.minimum(p[0], q[0]))
        | (np.maximum(p[1], q[1]) < np.minimum(r[1], s[1])) | (np.maximum(r[1], s[1]) < np.minimum(p[1], q[1])))
    return ~apart & (side(p, q, r) * side(p, q, s) <= 0) & (side(r, s, p) * side(r, s, q) <= 0)


def _touch(ax, ay, bx, by) -> bool:
    """Boundaries meet, or one polygon lies in the other."""
    a, b = _cuts(ax, ay), _cuts(bx, by)
    if _segments_touch(a, b).any():
        return True

    def holds(e, x, y):
        up = (e[:, 1] > y) != (e[:, 3] > y)
        with np.errstate(divide="ignore", invalid="ignore"):
            xs = e[:, 0] + (y - e[:, 1]) * (e[:, 2] - e[:, 0]) / (e[:, 3] - e[:, 1])
        return (up & (x < xs)).sum() % 2 == 1

    return holds(b, ax[0], ay[0]) or holds(a, bx[0], by[0])


@F.pandas_udf(T.BooleanType())
def _simple(x: pd.Series, y: pd.Series) -> pd.Series:
    """No two edges of the ring cross, and only neighbours touch."""

    def ok(xs, ys):
        e = _cuts(np.asarray(xs, dtype="float64"), np.asarray(ys, dtype="float64"))
        n = len(e)
        at = np.arange(n)
        for low in range(0, n, 256):  # a block of edges against all later ones
            i, j = at[low:low + 256, None], at[None, :]
            apart = (j >= i + 2) & ~((i == 0) & (j == n - 1))  # neighbours may touch
            if (apart & _segments_touch(e[low:low + 256], e)).any():
                return False
        return True

    return pd.Series([ok(a, b) for a, b in zip(x, y)])


def _xs(ring: str) -> Column:
    return F.transform(ring, lambda p: p["x"])


def _ys(ring: str) -> Column:
    return F.transform(ring, lambda p: p["y"])


def with_validity(df: DataFrame, ring: str = "ring", name: str = "valid") -> DataFrame:
    """Usable (closed, at least a triangle, area) and free of self-intersections."""
    flagged = df.withColumn("_u", F.coalesce(geo.ring_is_usable(ring), F.lit(False)))
    shape = F.when(F.col("_u"), F.col(ring))
    simple = _simple(F.coalesce(_xs(shape), F.array().cast("array<double>")), F.coalesce(_ys(shape), F.array().cast("array<double>")))
    return flagged.withColumn(name, F.col("_u") & simple).drop("_u")


def with_box(df: DataFrame, prefix: str, ring: str = "ring") -> DataFrame:
    bounds = geo.ring_bounds(ring)
    return df.select("*", *[c.alias(prefix + n) for n, c in bounds.items()])


def with_measures(df: DataFrame, ring: str) -> DataFrame:
    """Area and centroid of a polygon beside it, once per polygon and not once per pair."""
    area, (x, y) = geo.ring_area(ring), geo.ring_centroid(ring)
    return df.select("*", area.alias(f"{ring}_area"), *[F.when(area > 0, c).alias(f"{ring}_{n}") for n, c in (("x", x), ("y", y))])


def score_polygons(pairs: DataFrame, a: str = "a_ring", b: str = "b_ring") -> DataFrame:
    """Adds touch, overlap, IoU, centroid distance, area ratio and score to candidate pairs."""
    shaped = pairs.withColumn("_g", pair_geometry(F.array(a), F.array(b)))
    inter = F.col("_g.inter")
    if f"{a}_area" in pairs.columns:  # once per polygon (``with_measures``)
        (area_a, ax, ay), (area_b, bx, by) = ([F.col(f"{r}_{c}") for c in ("area", "x", "y")] for r in (a, b))
    else:
        area_a, area_b = geo.ring_area(a), geo.ring_area(b)
        (ax, ay), (bx, by) = geo.ring_centroid(a), geo.ring_centroid(b)
    out = (
        shaped.withColumn("touch", F.col("_g.touch"))
        .withColumn("overlap", geo.overlap_ratio(inter, area_a)).withColumn("iou", geo.iou(inter, area_a, area_b))
        .withColumn("cdist", F.sqrt((ax - bx) * (ax - bx) + (ay - by) * (ay - by)))
        .withColumn("aratio", geo.area_ratio(area_a, area_b)).drop("_g")
    )
    return transfer.with_score(out)


def transfer_polygons(ours: DataFrame, theirs: DataFrame, cell: float = 60.0) -> DataFrame:
    """Label transfer for polygon layers (build_id, ring) and (cand_id, func, ring): every building once.

    Status: Invalid_Geometry, No_Match (no box touches), No_Intersect_Precise (only boxes touch), else the
    decision on the scores.
    """
    flagged = with_validity(ours).select("build_id", "ring", "valid")
    a = with_box(flagged.where("valid").select("build_id", F.col("ring").alias("a_ring")), "a_", "a_ring")
    b = with_box(theirs.where(geo.ring_is_usable("ring")).select("cand_id", "func", F.col("ring").alias("b_ring")), "b_", "b_ring")
    met = bbox_join(with_measures(a, "a_ring"), with_measures(b, "b_ring"), cell)
    scored = cut_lineage(score_polygons(met).select(  # the sweep runs once
        "build_id", "cand_id", "func", "touch", "iou", "overlap", "cdist", "score"))
    near = scored.groupBy("build_id").agg(F.max("touch").alias("_touch"))
    decided = transfer.decide(scored.where("touch"), "build_id", "cand_id", "func")
    status = (
        F.when(~F.col("valid"), "Invalid_Geometry").when(F.col("_touch").isNull(), "No_Match")
        .when(~F.col("_touch"), "No_Intersect_Precise").otherwise(F.col("status")))
    return (
        flagged.select("build_id", "valid").join(near, "build_id", "left").join(decided, "build_id", "left")
        .withColumn("status", status).drop("valid", "_touch")
    )


def merge_layers(layers: list[DataFrame], key: str) -> DataFrame:
    """Layers concatenated, equal outlines kept once (lowest key), whatever their start point or direction."""
    both = layers[0]
    for layer in layers[1:]:
        both = both.unionByName(layer, allowMissingColumns=True)
    rest = [c for c in both.columns if c != "ring"]
    canon = both.withColumn("ring", geo.canonical_ring("ring"))
    return canon.groupBy("ring").agg(F.min_by(F.struct(*rest), key).alias("_v")).select("_v.*", "ring")


# ---- rasterising ---------------------------------------------------------------

def burn_spans(features: DataFrame, key: str, affine, height: int, width: int, ring: str | None = "ring", polygons: str | None = None) -> DataFrame:
    """(key, row, c0, c1): runs of pixels whose centres lie in a feature, as long as they can be.

    Every edge meets the rows whose centre height it spans; the crossings of a row, sorted, bound the inside by
    even-odd counting. What is shuffled grows with the outline, not with the area, and no ring is copied. With
    ``polygons`` (parts of rings) holes stay empty; parts must not overlap. Features of equal key are one.
    NULL and empty rings give no run.
    """
    a, _, c, _, e, f = affine
    if a <= 0 or e == 0:
        raise ValueError("columns must run eastwards, rows along y")
    rings = F.flatten(polygons) if polygons else F.array(ring)
    edges = F.flatten(F.transform(rings, lambda r: F.zip_with(
        F.slice(r, F.lit(1), F.greatest(F.size(r) - 1, F.lit(0))), F.slice(r, F.lit(2), F.greatest(F.size(r) - 1, F.lit(0))),
        lambda p, q: F.struct(p["x"].alias("x1"), p["y"].alias("y1"), q["x"].alias("x2"), q["y"].alias("y2")))))
    sides = features.select(key, F.explode(F.filter(edges, lambda s: s["y1"] != s["y2"])).alias("_s")).select(key, "_s.*")
    low, high = F.least("y1", "y2"), F.greatest("y1", "y2")
    ends = [(y - f) / e - 0.5 for y in (low, high)]
    r0, r1 = F.greatest(F.floor(F.least(*ends)), F.lit(0)), F.least(F.ceil(F.greatest(*ends)), F.lit(height - 1))
    rows = sides.where(r0 <= r1).select("*", F.explode(F.sequence(r0, r1)).alias("row"))
    y = (F.col("row") + 0.5) * e + f
    met = rows.where((low <= y) & (y < high)).select(
        key, "row", (F.col("x1") + (y - F.col("y1")) * (F.col("x2") - F.col("x1")) / (F.col("y2") - F.col("y1"))).alias("_x"))
    # centres at x0 <= x < x1 are inside
    first = F.transform(F.array_sort(F.collect_list("_x")), lambda x: F.ceil((x - c) / a - 0.5))
    runs = met.groupBy(key, "row").agg(first.alias("_b"))
    # equal ends cancel, so that runs side by side are one: of equal values the last of an odd number stays
    ends_left = F.filter("_b", lambda v, i: (F.coalesce(F.get("_b", i + 1), v + 1) != v) & ((i + 1 - F.array_position("_b", v)) % 2 == 0))
    runs = runs.withColumn("_b", ends_left)
    pairs = F.transform(F.sequence(F.lit(0), F.floor(F.size("_b") / 2) - 1), lambda i: F.struct(
        F.greatest(F.element_at("_b", (2 * i + 1).cast("int")), F.lit(0)).alias("c0"),
        F.least(F.element_at("_b", (2 * i + 2).cast("int")) - 1, F.lit(width - 1)).alias("c1")))
    return runs.where(F.size("_b") >= 2).select(key, "row", F.explode(pairs).alias("_r")).select(key, "row", "_r.c0", "_r.c1").where("c0 <= c1")


def burn(features: DataFrame, key: str, affine, height: int, width: int, ring: str | None = "ring", polygons: str | None = None) -> DataFrame:
    """(key, row, col) of the pixels whose centre lies in the feature: its runs, spelled out."""
    runs = burn_spans(features, key, affine, height, width, ring, polygons)
    return runs.select(key, "row", F.explode(F.sequence("c0", "c1")).alias("col"))


# ---- outlines of components -------------------------------------------------------

_SIDES = [  # direction, neighbour across, start and end corner; the pixel lies to the right of the edge
    (0, (-1, 0), (0, 0), (0, 1)),
    (1, (0, 1), (0, 1), (1, 1)),
    (2, (1, 0), (1, 1), (1, 0)),
    (3, (0, -1), (1, 0), (0, 0)),
]


#: Pixels on a side of a tile whose rings are followed in one task.
TILE = 512


def _doubled(succ: np.ndarray, longest: int):
    """Successors 1, 2, 4, ... steps ahead, until ``longest`` steps are covered; the last place stands for the end."""
    to = np.append(succ, len(succ))
    for _ in range(longest.bit_length()):
        yield to
        to = to[to]


def _trace_tiles(pixels: pa.Table, key: str, tile: int, width: int) -> dict[str, np.ndarray]:
    """Corners of the rings and parts of rings in the tiles of ``pixels``, and a row for each part, as ``outlines`` joins them.

    A pixel side between a component and anything else has the pixel to its right. The side that comes next follows from
    the two pixels ahead: right turn before straight before left, which keeps diagonal neighbours apart. ``_at`` is the
    row of ``pixels`` that a row stands for.
    """
    image = pc.dictionary_encode(pixels.combine_chunks()[key].chunk(0)).indices.to_numpy()
    component, ty, tx, row, col = (pixels[c].to_numpy() for c in ("component", "_ty", "_tx", "row", "col"))
    row, col = row.astype(np.int64), col.astype(np.int64)
    at = np.lexsort((col, row, component, tx, ty, image))
    owner = np.stack([image[at], ty[at], tx[at], component[at]])
    owner = np.append(0, np.cumsum((owner[:, 1:] != owner[:, :-1]).any(axis=0)))  # a component in a tile
    down, right, stride = (row - ty * tile + 1)[at], (col - tx * tile + 1)[at], tile + 4  # a step off an edge meets nobody
    spot = (owner * stride + down) * stride + right
    once = np.append(True, spot[1:] != spot[:-1])
    at, owner, down, right, spot = (v[once] for v in (at, owner, down, right, spot))
    row, col = row[at], col[at]
    own = np.flatnonzero((down >= 1) & (down <= tile) & (right >= 1) & (right <= tile))

    def beside(r: int, c: int) -> np.ndarray:
        """The pixel of the same component beside each own one, or -1."""
        wanted = spot[own] + r * stride + c
        found = np.minimum(np.searchsorted(spot, wanted), len(spot) - 1)
        return np.where(spot[found] == wanted, found, -1)

    sides = []
    for d, (r, c), *_ in _SIDES:
        ahead, across = _SIDES[(d + 1) % 4][1], beside(r, c)
        out = across < 0
        front, corner = beside(*ahead)[out], beside(ahead[0] + r, ahead[1] + c)[out]
        turn = np.where(front < 0, 1, np.where(corner < 0, 0, 3))
        pixel = own[out]
        sides.append(np.stack([pixel, np.full(len(pixel), d), np.choose(turn % 3 + (turn == 3) * 2, [front, pixel, corner]), (d + turn) % 4]))
    pixel, way, then, way2 = np.concatenate(sides, axis=1)
    start, end = (np.array([s[i] for s in _SIDES]) for i in (2, 3))
    number = lambda p, d: ((row[p] + start[d, 0]) * width + col[p] + start[d, 1]) * 4 + d
    ids, following, n = number(pixel, way), number(then, way2), len(pixel)
    place = np.full((4, len(spot)), n)
    place[way, pixel] = np.arange(n)
    succ = place[way2, then]  # n: the ring goes on in another tile
    longest = int(np.bincount(owner[pixel]).max(initial=0))
    low, ends = np.append(ids, np.iinfo(np.int64).max), np.append(succ, n)
    for to in _doubled(succ, longest):
        low, ends = np.minimum(low, low[to]), to[to]
    low, closed = low[:n], ends[:n] < n  # the smallest side number of a ring, or of the rest of a part
    first = np.ones(n + 1, bool)
    first[succ] = False
    left, last = np.append(np.ones(n, np.int64), 0), np.arange(n + 1)
    for to in _doubled(np.where(closed & (following == low), n, succ), longest):  # sides to the end, and the last of them
        left, last = left + left[to], np.where(to < n, last[to], last)
    head = np.full(n + 1, n)
    heads = np.flatnonzero(first[:n] & ~closed)
    head[last[heads]] = heads
    head = head[last[:n]]  # of the part of each side
    part = np.where(closed, -1, np.append(ids, -1)[head])
    least = np.flatnonzero(~closed)
    least = least[ids[least] == low[head[least]]]
    mid = np.zeros(n + 1, np.int64)
    mid[head[least]] = left[least]
    bend = np.flatnonzero(way != way2)
    take = np.append(bend, heads)
    part_row = np.arange(len(take)) >= len(bend)
    return {
        "_at": at[pixel[take]], "_part": part[take], "ring": low[take], "left": left[take],
        "next": np.where(part_row, following[last[take]], -1), "mid": np.where(part_row, mid[take], 0),
        "r": row[pixel[take]] + end[way[take], 0], "c": col[pixel[take]] + end[way[take], 1],
    }


def _joined_parts(parts: DataFrame, by: list[str], rounds: int) -> DataFrame:
    """(*by, _part, ring, off, n): parts of rings with their ring, its length, and where the part ends in it.

    Pointer doubling over parts: log2 of the parts of the longest ring rounds of equi-joins, with no ring ever in one task.
    """
    state = parts.select(*by, F.col("_part").alias("id"), F.col("next").alias("to"), "ring")
    for _ in range(rounds):  # ring number: the smallest side number on the cycle
        ahead = state.select(*by, F.col("id").alias("to"), F.col("to").alias("to2"), F.col("ring").alias("ring2"))
        new = cut_lineage(state.join(ahead, [*by, "to"]).select(
            *by, "id", F.col("to2").alias("to"), F.least("ring", "ring2").alias("ring"), (F.col("ring2") < F.col("ring")).alias("_ch")))
        state = new.drop("_ch")
        if new.where("_ch").isEmpty():
            break
    else:
        raise RuntimeError("rings did not close")
    rings = state.select(*by, F.col("id").alias("_part"), F.col("ring").alias("_ring"))
    known = parts.join(rings, [*by, "_part"])
    starts = known.where("ring = _ring").select(*by, "_ring", F.col("_part").alias("_first"), (F.col("left") - F.col("mid")).alias("_skip"))
    chain = cut_lineage(known.join(starts, [*by, "_ring"]))
    # sides from the start of a part to the end of the ring, which is where the part with the ring's first side starts
    state = chain.select(*by, F.col("_part").alias("id"), F.when(F.col("next") != F.col("_first"), F.col("next")).alias("to"), F.col("left").alias("rest"))
    for _ in range(rounds):
        ahead = state.select(*by, F.col("id").alias("to"), F.col("to").alias("to2"), F.col("rest").alias("rest2"))
        state = cut_lineage(state.join(ahead, [*by, "to"], "left").select(
            *by, "id", F.col("to2").alias("to"), (F.col("rest") + F.coalesce("rest2", F.lit(0))).alias("rest")))
        if state.where(F.col("to").isNotNull()).isEmpty():
            break
    else:
        raise RuntimeError("rings did not close")
    placed = chain.join(state.select(*by, F.col("id").alias("_part"), "rest"), [*by, "_part"])
    total = placed.where("_part = _first").select(*by, "_ring", F.col("rest").alias("n"))
    return placed.join(total, [*by, "_ring"]).select(
        *by, "_part", F.col("_ring").alias("ring"), (F.col("n") - F.col("rest") + F.col("left") - F.col("_skip")).alias("off"), "n")


def outlines(labelled: DataFrame, key: str = "image_id", width: int | None = None, rounds: int = 40, tile: int = TILE) -> DataFrame:
    """Corner vertices of every ring in order: (key, component, ring, pos, r, c).

    Pixels go to their tile, with copies of border pixels, and rings are followed there: those inside a tile are
    numbered and ordered at once. Only parts of rings that cross tiles, a row each, are joined over the seams.
    A ring's number is its smallest side number; ``pos`` counts the sides up to the ring's end, below 0.
    """
    by = [key, "component"]
    p = cut_lineage(labelled.select(*by, "row", "col").dropna())
    width, n = pixel_numbers(p, width)
    width += 1  # corners lie one column further out than pixels
    groups = max(-(-n // GROUP_PIXELS), p.sparkSession.sparkContext.defaultParallelism)
    near = p.withColumn("_ty", F.explode(halo.tiles_near("row", 1, tile))).withColumn("_tx", F.explode(halo.tiles_near("col", 1, tile)))
    near = near.withColumn("_g", F.pmod(F.xxhash64(key, "_ty", "_tx"), F.lit(groups)))
    long = [T.StructField(c, T.LongType()) for c in ("_part", "ring", "left", "next", "mid")]
    schema = T.StructType([*[p.schema[c] for c in by], *long, T.StructField("r", p.schema["row"].dataType), T.StructField("c", p.schema["col"].dataType)])
    arrow = to_arrow_schema(schema)

    def trace(pixels: pa.Table) -> pa.Table:
        made = _trace_tiles(pixels, key, tile, width)
        same = pixels.select(by).take(pa.array(made["_at"]))
        return pa.table([same[f.name].cast(f.type) if f.name in by else pa.array(made[f.name]).cast(f.type) for f in arrow], schema=arrow)

    made = cut_lineage(dealt(near, n, "_g").groupBy("_g").applyInArrow(trace, schema))
    corners, parts = made.where("next < 0"), made.where("next >= 0")
    done = corners.where("_part < 0").select(*by, "ring", (-F.col("left")).alias("pos"), "r", "c")
    if parts.isEmpty():
        return done
    ends = _joined_parts(parts.select(*by, "_part", "ring", "left", "next", "mid"), by, rounds)
    over = corners.where("_part >= 0").drop("ring").join(ends, [*by, "_part"])
    pos = F.pmod(F.col("off") - F.col("left"), F.col("n")) - F.col("n")
    return done.unionByName(over.select(*by, "ring", pos.alias("pos"), "r", "c"))


def rings_of(outline: DataFrame, key: str, affine) -> DataFrame:
    """Closed rings in map coordinates, one row per ring: the polygon itself, so as long as its outline."""
    a, _, c, _, e, f = affine
    point = F.struct("pos", (F.col("c") * a + c).cast("double").alias("x"), (F.col("r") * e + f).cast("double").alias("y"))
    g = outline.groupBy(key, "component", "ring").agg(F.array_sort(F.collect_list(point)).alias("_p"))
    pts = F.transform("_p", lambda p: F.struct(p["x"].alias("x"), p["y"].alias("y")))
    return g.select(key, "component", "ring", F.concat(pts, F.slice(pts, 1, 1)).alias("outline"))


def nested(rings: DataFrame, key: str, number: str = "build_id", cell: float = 64.0, north_up: bool = True) -> DataFrame:
    """(key, component, ring, polygon, build_id): each shell with the holes in it, numbered from 1 by key, component and ring.

    ``rings`` are those of ``rings_of``: shells and holes run in opposite directions, shells clockwise where y points
    north. ``polygon`` is the shell, then its holes by ring number. A hole goes to the smallest shell of its component
    around it; where a component has one shell, as with edge neighbours, that is known without looking. Only components
    of several shells (corner neighbours) meet in a join of boxes on a grid of ``cell`` map units, then by a point of
    the hole in the shell.
    """
    sign = 1.0 if north_up else -1.0
    area = geo.ring_signed_area("outline") * F.lit(-sign)  # shells above 0
    groups = cut_lineage(rings.select(key, "component", "ring", "outline", area.alias("_a")))
    shells = groups.where("_a > 0").select(key, "component", F.col("ring").alias("shell"), F.col("outline").alias("_s"), F.col("_a").alias("_area"))
    holes = groups.where("_a < 0").select(key, "component", F.col("ring").alias("_ring"), F.col("outline").alias("_h"))
    many = shells.groupBy(key, "component").agg(F.count(F.lit(1)).alias("_n"), F.min("shell").alias("_only"))
    placed = holes.join(many, [key, "component"])
    direct = placed.where("_n = 1").select(key, "component", "_ring", "_h", F.col("_only").alias("shell"))
    crowded = shells.join(many.where("_n > 1").select(key, "component"), [key, "component"])
    open_holes = placed.where("_n > 1").select(key, "component", "_ring", "_h")
    near = bbox_join(with_box(open_holes, "a_", "_h"), with_box(crowded, "b_", "_s"), cell, by=[key, "component"])
    # the hole lies to the left of its sides: the middle of the first, moved a millionth of its length
    p, q = F.col("_h")[0], F.col("_h")[1]
    dx, dy = q["x"] - p["x"], q["y"] - p["y"]
    near = near.withColumn("_px", (p["x"] + q["x"]) / 2 - dy * (sign * 1e-6)).withColumn("_py", (p["y"] + q["y"]) / 2 + dx * (sign * 1e-6))
    found = near.where(geo.ring_contains("_s", "_px", "_py")).groupBy(key, "component", "_ring").agg(
        F.min_by(F.struct("_h", "shell"), F.struct("_area", "shell")).alias("_v"))
    every = direct.unionByName(found.select(key, "component", "_ring", "_v._h", "_v.shell"))
    held = every.groupBy(key, "component", "shell").agg(F.array_sort(F.collect_list(F.struct("_ring", "_h"))).alias("_hs"))
    inner = F.coalesce(F.transform("_hs", lambda h: h["_h"]), F.slice(F.array("_s"), 1, 0))
    out = shells.join(held, [key, "component", "shell"], "left").select(
        key, "component", F.col("shell").alias("ring"), F.concat(F.array("_s"), inner).alias("polygon"))
    return ordered_rank(cut_lineage(out), [key, "component", "ring"], number)
