"""Overlay of features of several polygons with holes: common area and contact of all pairs of a batch at once.

A plane sweep in slabs. Between two neighbouring heights at which some edge begins, ends or meets one of the other feature,
edges do not cross, so sorted by x they cut the slab into trapezoids; even-odd counting along x tells which of them lie in
both features. Holes and parts need no case of their own, and no step loops over pairs or slabs in Python.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from geoctx.functions import geo
from geoctx.operators import transfer
from geoctx.operators.spatial_join import bbox_join
from geoctx.session import cut_lineage

#: Pairs of edges (and cells of edges and slabs) that are looked at together.
CELLS = 2_000_000


def _spans(counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For counts n: each index n times, and 0 .. n - 1 beside it."""
    owner = np.repeat(np.arange(len(counts)), counts)
    return owner, np.arange(len(owner)) - np.repeat(np.cumsum(counts) - counts, counts)


def _side(px, py, qx, qy, rx, ry):
    """On which side of p -> q the point r lies."""
    return np.sign((qx - px) * (ry - py) - (qy - py) * (rx - px))


def _meetings(a: np.ndarray, b: np.ndarray, pair_a: np.ndarray, pair_b: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Which pairs' edges touch, and the heights at which edges of a pair meet, with their pairs."""
    first = np.searchsorted(pair_b, np.arange(n))
    many = np.bincount(pair_b, minlength=n)
    touch, heights, owners = np.zeros(n, bool), [np.zeros(0)], [np.zeros(0, np.int64)]
    reach = many[pair_a]
    start = 0
    while start < len(a):  # as many edges of a as have about CELLS partners; a single one has at most a feature's edges
        end = max(int(np.searchsorted(np.cumsum(reach[start:]), CELLS, side="right")) + start, start + 1)
        i, k = _spans(reach[start:end])
        i += start
        p, q = a[i], b[first[pair_a[i]] + k]
        start = end
        near = (
            (np.maximum(p[:, 0], p[:, 2]) >= np.minimum(q[:, 0], q[:, 2])) & (np.maximum(q[:, 0], q[:, 2]) >= np.minimum(p[:, 0], p[:, 2]))
            & (np.maximum(p[:, 1], p[:, 3]) >= np.minimum(q[:, 1], q[:, 3])) & (np.maximum(q[:, 1], q[:, 3]) >= np.minimum(p[:, 1], p[:, 3])))
        p, q, own = p[near], q[near], pair_a[i[near]]
        hit = (_side(*p.T, q[:, 0], q[:, 1]) * _side(*p.T, q[:, 2], q[:, 3]) <= 0) & (_side(*q.T, p[:, 0], p[:, 1]) * _side(*q.T, p[:, 2], p[:, 3]) <= 0)
        p, q, own = p[hit], q[hit], own[hit]
        touch[own] = True
        den = (p[:, 2] - p[:, 0]) * (q[:, 3] - q[:, 1]) - (p[:, 3] - p[:, 1]) * (q[:, 2] - q[:, 0])
        some = den != 0
        p, q, den = p[some], q[some], den[some]
        t = ((q[:, 0] - p[:, 0]) * (q[:, 3] - q[:, 1]) - (q[:, 1] - p[:, 1]) * (q[:, 2] - q[:, 0])) / den
        heights.append(p[:, 1] + np.clip(t, 0, 1) * (p[:, 3] - p[:, 1]))
        owners.append(own[some])
    return touch, np.concatenate(heights), np.concatenate(owners)


def _common(a: np.ndarray, b: np.ndarray, pair_a: np.ndarray, pair_b: np.ndarray, n: int) -> list[np.ndarray]:
    """The box ``x1, y1, x2, y2`` that the boxes of both features of a pair share; turned about where they share none."""
    box = np.repeat([[-np.inf], [-np.inf], [np.inf], [np.inf]], n, axis=1)
    for edges, pair in ((a, pair_a), (b, pair_b)):
        own = np.full((4, n), np.nan)
        starts = np.flatnonzero(np.r_[True, pair[1:] != pair[:-1]][:len(pair)])
        if len(starts):
            for i, (ends, of) in enumerate(((np.fmin, 0), (np.fmin, 1), (np.fmax, 0), (np.fmax, 1))):
                own[i, pair[starts]] = ends.reduceat(ends(edges[:, of], edges[:, of + 2]), starts)
        box[:2], box[2:] = np.maximum(box[:2], np.where(np.isnan(own[:2]), np.inf, own[:2])), np.minimum(box[2:], np.where(np.isnan(own[2:]), -np.inf, own[2:]))
    return list(box)


def overlay(a: np.ndarray, b: np.ndarray, pair_a: np.ndarray, pair_b: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """``(touch, common area)`` of ``n`` pairs from their edges ``x1, y1, x2, y2``, sorted by pair.

    Edges meet inside the box that both features share, and all common area lies there: edges above, below and
    to the right of it are left out, those to the left still count for even and odd.
    """
    x1, y1, x2, y2 = _common(a, b, pair_a, pair_b, n)

    def within(e: np.ndarray, pair: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        apart = (np.maximum(e[:, 1], e[:, 3]) < y1[pair]) | (np.minimum(e[:, 1], e[:, 3]) > y2[pair]) | (np.minimum(e[:, 0], e[:, 2]) > x2[pair])
        return e[~apart], pair[~apart]

    def meeting(e: np.ndarray, pair: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        left = np.maximum(e[:, 0], e[:, 2]) < x1[pair]
        return e[~left], pair[~left]

    (a, pair_a), (b, pair_b) = within(a, pair_a), within(b, pair_b)
    (near_a, own_a), (near_b, own_b) = meeting(a, pair_a), meeting(b, pair_b)
    touch, met, owner = _meetings(near_a, near_b, own_a, own_b, n)
    edges, pair = np.concatenate([a, b]), np.concatenate([pair_a, pair_b])
    is_b = np.arange(len(edges)) >= len(a)
    up = edges[:, 1] < edges[:, 3]
    low, high = np.where(up, edges[:, 1], edges[:, 3]), np.where(up, edges[:, 3], edges[:, 1])
    low, high = np.maximum(low, y1[pair]), np.minimum(high, y2[pair])
    # the heights of each pair, once each
    y = np.concatenate([low, high, met])
    owner = np.concatenate([pair, pair, owner])
    order = np.lexsort((y, owner))
    y, owner = y[order], owner[order]
    new = np.r_[True, (y[1:] != y[:-1]) | (owner[1:] != owner[:-1])] if len(y) else np.zeros(0, bool)
    y, owner = y[new], owner[new]
    area = np.zeros(n)
    levels, rank = np.unique(y, return_inverse=True)
    code = owner * len(levels) + rank.ravel()
    place = lambda v: np.searchsorted(code, pair * len(levels) + np.searchsorted(levels, v))
    from_ = place(low)
    slabs = place(high) - from_  # level edges cross none
    by_pair = np.argsort(pair, kind="stable")
    slabs, from_, edges, pair, is_b = slabs[by_pair], from_[by_pair], edges[by_pair], pair[by_pair], is_b[by_pair]
    ends_of_pair, weight = np.searchsorted(pair, np.arange(n), side="right"), np.cumsum(slabs)
    start = first_pair = 0
    while first_pair < n:  # whole pairs, about CELLS cells of edge and slab at a time
        done = weight[start - 1] if start else 0
        last_edge = int(np.searchsorted(weight, done + CELLS, side="right"))
        last_pair = max(int(np.searchsorted(ends_of_pair, last_edge, side="right")), first_pair + 1)
        end = int(ends_of_pair[last_pair - 1])
        i, k = _spans(slabs[start:end])
        i += start
        start, first_pair = end, last_pair
        if not len(i):
            continue
        s = from_[i] + k
        e, y0, y1 = edges[i], y[s], y[s + 1]
        slope = (e[:, 2] - e[:, 0]) / (e[:, 3] - e[:, 1])
        x0, x1 = e[:, 0] + slope * (y0 - e[:, 1]), e[:, 0] + slope * (y1 - e[:, 1])
        order = np.lexsort((x0 + x1, s))
        s, x0, x1, mine, own = s[order], x0[order], x1[order], is_b[i][order], pair[i][order]
        height = (y1 - y0)[order]
        # even-odd counts of both features behind each edge of a slab
        head = np.flatnonzero(np.r_[True, s[1:] != s[:-1]])
        size = np.diff(np.r_[head, len(s)])
        count = lambda v: (c := np.cumsum(v)) - np.repeat(c[head] - v[head], size)
        both = (count((~mine).astype(np.int64)) % 2 == 1) & (count(mine.astype(np.int64)) % 2 == 1)
        both = np.flatnonzero(both[:-1] & (s[1:] == s[:-1]))
        part = ((x0[both + 1] - x0[both]) + (x1[both + 1] - x1[both])) / 2 * height[both]
        area += np.bincount(own[both], np.maximum(part, 0.0), n)
    return touch | (area > 0), area


def _inner(lists: pa.ListArray) -> tuple[np.ndarray, pa.Array]:
    """Number of elements of each list (NULL: none), and the elements of all."""
    flat = lists.flatten()
    sizes = pc.fill_null(pc.list_value_length(lists), 0)
    return sizes.to_numpy(zero_copy_only=False).astype(np.int64), flat


def _edges(features: pa.ListArray) -> tuple[np.ndarray, np.ndarray]:
    """Edges of all rings of each feature (an array of rings of points), and the feature of each; no loop over features."""
    rings_of, rings = _inner(features)
    points_of, points = _inner(rings)
    owner = np.repeat(np.arange(len(rings_of)), rings_of)
    xy = np.column_stack([pc.struct_field(points, c).to_numpy(zero_copy_only=False).astype("float64") for c in "xy"])
    ring = np.repeat(np.arange(len(points_of)), points_of)
    start = np.flatnonzero(ring[1:] == ring[:-1])  # all points but the last of each ring
    return np.hstack([xy[start], xy[start + 1]]), owner[ring[start]]


@F.arrow_udf(T.StructType([T.StructField("touch", T.BooleanType()), T.StructField("inter", T.DoubleType())]))
def pair_geometry(left: pa.Array, right: pa.Array) -> pa.Array:
    """Contact and common area of pairs of features, each an array of rings."""
    (a, pair_a), (b, pair_b) = _edges(left), _edges(right)
    touch, inter = overlay(a, b, pair_a, pair_b, len(left))
    return pa.StructArray.from_arrays([pa.array(touch), pa.array(inter)], names=["touch", "inter"])


def all_rings(polygons: str) -> Column:
    """Shells and holes of all parts in one array; even-odd counting tells them apart."""
    return F.flatten(polygons)


def usable(polygons: str) -> Column:
    """Some area, every ring a closed one of three corners at least."""
    rings = all_rings(polygons)
    return F.coalesce((geo.polygons_area(polygons) > 0) & F.forall(rings, lambda r: (F.size(r) >= 4) & (r[0] == r[F.size(r) - 1])), F.lit(False))


def bounds(polygons: str) -> dict[str, Column]:
    points = F.flatten(all_rings(polygons))
    return geo.ring_bounds(points)


def measures(polygons: str) -> Column:
    """``area, x, y``: the area of the shells less their holes, and the centroid; one pass over the edges."""
    p = F.col(polygons)
    x0, y0 = p[0][0][0]["x"], p[0][0][0]["y"]  # far from the origin plain sums lose digits
    zero = F.struct(F.lit(0.0).alias("m"), F.lit(0.0).alias("x"), F.lit(0.0).alias("y"))
    add = lambda s, v: F.struct((s["m"] + v["m"]).alias("m"), (s["x"] + v["x"]).alias("x"), (s["y"] + v["y"]).alias("y"))

    def edge(s: Column, v: Column) -> Column:
        cross = v["a"] * v["d"] - v["c"] * v["b"]
        return F.struct((s["m"] + cross).alias("m"), (s["x"] + (v["a"] + v["c"]) * cross).alias("x"), (s["y"] + (v["b"] + v["d"]) * cross).alias("y"))

    def of_ring(ring: Column, k: Column) -> Column:
        n = F.greatest(F.size(ring) - 1, F.lit(0))
        ends = F.zip_with(F.slice(ring, F.lit(1), n), F.slice(ring, F.lit(2), n), lambda u, v: F.struct(
            (u["x"] - x0).alias("a"), (u["y"] - y0).alias("b"), (v["x"] - x0).alias("c"), (v["y"] - y0).alias("d")))
        turn = F.when(k == 0, 1.0).otherwise(-1.0)  # whichever way the ring runs
        return F.aggregate(ends, zero, edge, lambda s: F.struct(
            (turn * F.signum(s["m"]) * s["m"] / 2).alias("m"), (turn * F.signum(s["m"]) * s["x"] / 6).alias("x"), (turn * F.signum(s["m"]) * s["y"] / 6).alias("y")))

    each = F.flatten(F.transform(p, lambda rings: F.transform(rings, of_ring)))
    return F.aggregate(each, zero, add, lambda s: F.struct(
        s["m"].alias("area"), (x0 + F.try_divide(s["x"], s["m"])).alias("x"), (y0 + F.try_divide(s["y"], s["m"])).alias("y")))


def with_measures(features: DataFrame, prefix: str = "") -> DataFrame:
    """Box and measures beside ``polygons``, once per feature and not once per pair."""
    named = features.withColumnRenamed("polygons", f"{prefix}polygons")
    return named.select("*", *[c.alias(prefix + n) for n, c in bounds(f"{prefix}polygons").items()], measures(f"{prefix}polygons").alias(f"{prefix}of"))


def score_features(pairs: DataFrame, a: str = "a_", b: str = "b_") -> DataFrame:
    """Adds touch, overlap, IoU, centroid distance, area ratio and score to pairs of features (``with_measures``)."""
    shaped = pairs.withColumn("_g", pair_geometry(all_rings(f"{a}polygons"), all_rings(f"{b}polygons")))
    inter, area_a, area_b = F.col("_g.inter"), F.col(f"{a}of.area"), F.col(f"{b}of.area")
    dx, dy = (F.col(f"{a}of.{c}") - F.col(f"{b}of.{c}") for c in "xy")
    out = (
        shaped.withColumn("touch", F.col("_g.touch"))
        .withColumn("overlap", geo.overlap_ratio(inter, area_a)).withColumn("iou", geo.iou(inter, area_a, area_b))
        .withColumn("cdist", F.sqrt(dx * dx + dy * dy))
        .withColumn("aratio", geo.area_ratio(area_a, area_b)).drop("_g"))
    return transfer.with_score(out)


def candidate_features(ours: DataFrame, theirs: DataFrame, cell: float = 60.0) -> DataFrame:
    """Scored pairs of usable features (build_id, polygons) and (cand_id, ..., polygons) whose boxes meet."""
    # measured once, not again for the sizes of boxes and for the join; the layer is a table before, or what makes its features goes into every expression on them
    a, b = (cut_lineage(with_measures(cut_lineage(df).where(usable("polygons")), s)) for df, s in ((ours.select("build_id", "polygons"), "a_"), (theirs, "b_")))
    return score_features(bbox_join(a, b, cell))


def transfer_features(ours: DataFrame, theirs: DataFrame, cell: float = 60.0) -> DataFrame:
    """Label transfer for layers of features with holes and parts, (build_id, polygons) and (cand_id, func, polygons).

    Every building once. Status: Invalid_Geometry, No_Match (no box touches), No_Intersect_Precise (only boxes touch),
    else the decision on the scores.
    """
    pairs = candidate_features(ours, theirs.select("cand_id", "func", "polygons"), cell)
    scored = cut_lineage(pairs.select("build_id", "cand_id", "func", "touch", "iou", "overlap", "cdist", "score"))  # the sweep runs once
    near = scored.groupBy("build_id").agg(F.max("touch").alias("_touch"))
    decided = transfer.decide(scored.where("touch"), "build_id", "cand_id", "func")
    status = (
        F.when(~F.col("_valid"), "Invalid_Geometry").when(F.col("_touch").isNull(), "No_Match")
        .when(~F.col("_touch"), "No_Intersect_Precise").otherwise(F.col("status")))
    flagged = ours.select("build_id", usable("polygons").alias("_valid"))
    return flagged.join(near, "build_id", "left").join(decided, "build_id", "left").withColumn("status", status).drop("_valid", "_touch")
