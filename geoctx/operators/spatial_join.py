"""Spatial joins as grid-bucketed equi-joins.

Catalyst would run a range condition as a nested loop. Both joins here first
map geometries to grid cells, so that the join is an ordinary shuffle (or
broadcast) equi-join on (cell x, cell y), skew included: adaptive execution
splits a crowded cell and the exact predicate runs inside the join stage.
"""

from __future__ import annotations

import math

from collections.abc import Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from geoctx.session import cut_lineage


def with_cell(df: DataFrame, cell: float, x: str = "x", y: str = "y") -> DataFrame:
    return df.withColumn("_cx", F.floor(F.col(x) / cell)).withColumn("_cy", F.floor(F.col(y) / cell))


def with_neighbour_cells(df: DataFrame, cell: float, reach: int = 1, x: str = "x", y: str = "y") -> DataFrame:
    """One row per cell of the (2 reach + 1)^2 block around the point."""
    return (
        with_cell(df, cell, x, y)
        .withColumn("_i", F.explode(_steps(reach))).withColumn("_j", F.explode(_steps(reach)))
        .withColumn("_cx", F.col("_cx") + F.col("_i"))
        .withColumn("_cy", F.col("_cy") + F.col("_j"))
        .drop("_i", "_j")
    )


def _steps(reach: int):
    return F.sequence(F.lit(-reach), F.lit(reach))


def _distance():
    dx, dy = F.col("x") - F.col("_px"), F.col("y") - F.col("_py")
    return F.sqrt(dx * dx + dy * dy)


@dataclass(frozen=True)
class Best:
    """What is left of the pairs of a left row: the ``n`` first of each range of distances, with ``_count``.

    A range ends at an edge, with the edge where ``closed``; the last one ends at the radius. Pairs are ordered by distance
    in the first ``near`` ranges (None: in all) and by the right column ``by`` in the others, then by ``tie``. NULLs come first.
    """

    edges: tuple[float, ...]
    n: int
    tie: str
    by: str | None = None
    near: int | None = None
    closed: bool = True


def radius_join(
    left: DataFrame, right: DataFrame, radius: float, best: Best | None = None, key: str | None = None, lists: Sequence[str] = (),
) -> DataFrame:
    """Every (left, right) pair of points at most ``radius`` apart, with ``dist``.

    Both sides have ``x`` and ``y``; the result keeps left's columns and right's
    other columns. A right point lies in one cell, so pairs are unique. The
    number of rows is the number of true pairs; use ``nearest_k`` when only the
    closest are wanted.

    With ``best`` all pairs are counted, but inside the tasks: rows that can be among the n first of a range
    leave them, and their ``_count`` adds up to the number of all pairs of the range.

    With ``key`` too, a key with any pair is one row: ``key`` and ``ranges``, for each range the number ``n`` of its pairs and
    its first as ``items`` (dist, *lists). The tasks that find them write the lists, so what is made of them needs no shuffle.
    """
    if best:
        return _best_in_radius(left, right.withColumnsRenamed({"x": "_px", "y": "_py"}), radius, best, key, lists)
    a = with_neighbour_cells(left, radius)
    b = with_cell(right, radius).withColumnsRenamed({"x": "_px", "y": "_py"})
    dist = _distance()
    return (
        # centres stand in nine cells each, more than their file tells: they do not pass through the driver
        a.hint("merge").join(b, ["_cx", "_cy"])
        .withColumn("dist", dist)
        .where(F.col("dist") <= radius)
        .drop("_cx", "_cy")
    )


#: Points of a tile that one task holds. A tile of more is cut into smaller ones; a cell of more is dealt to several
#: tasks, whose counts add up.
SLICE_POINTS = 1_000_000
#: Pairs of a task, at most about: the centres of a tile are dealt by it, but only to as many tasks as they fill.
PART_PAIRS, PART_CENTERS = 1_000_000_000, 100_000


def _sized_tiles(left: DataFrame, right: DataFrame, radius: float) -> tuple[DataFrame, DataFrame, int]:
    """Tiles for the cells of centres and for those of points, and how many rows these tables have at most.

    A tile is 4 x 4 cells, 2 x 2 or one: the largest with no more than SLICE_POINTS points in it and one cell around. Made
    from counts of cells.
    """
    cells = with_cell(left, radius).select("_cx", "_cy", F.lit(1).alias("n"), F.lit(0).alias("p")).unionByName(
        with_cell(right, radius, "_px", "_py").select("_cx", "_cy", F.lit(0).alias("n"), F.lit(1).alias("p")))
    cells = cut_lineage(cells.groupBy("_cx", "_cy").agg(F.sum("n").alias("n"), F.sum("p").alias("p")))
    at = ["_side", "_gx", "_gy"]
    sized = cells.withColumn("_side", F.explode(F.array(F.lit(1), F.lit(2), F.lit(4))))
    reach = lambda c: F.explode(F.sequence(F.floor((F.col(c) - 1) / F.col("_side")), F.floor((F.col(c) + 1) / F.col("_side"))))
    held = sized.where("p > 0").withColumn("_gx", reach("_cx")).withColumn("_gy", reach("_cy")).groupBy(*at).agg(F.sum("p").alias("p"))
    homes = sized.where("n > 0").drop("p").withColumns({g: F.floor(F.col(c) / F.col("_side")) for g, c in (("_gx", "_cx"), ("_gy", "_cy"))}).join(held, at)
    fits = F.max(F.when(F.col("p") <= SLICE_POINTS, F.struct(*at))).alias("fit")
    homes = homes.groupBy("_cx", "_cy").agg(F.first("n").alias("n"), F.coalesce(fits, F.min(F.struct(*at))).alias("t")).select("_cx", "_cy", "n", "t.*")
    homes = cut_lineage(homes)
    tiles = homes.groupBy(*at).agg(F.sum("n").alias("n")).join(held, at)
    slices = F.ceil(F.col("p") / SLICE_POINTS)
    parts = F.least(F.ceil(F.col("n") * F.least("p", F.lit(SLICE_POINTS)) / PART_PAIRS), F.ceil(F.col("n") / PART_CENTERS))
    tiles = cut_lineage(tiles.select(*at, F.monotonically_increasing_id().alias("_tile"), slices.cast("int").alias("_slices"), parts.cast("int").alias("_parts")))
    span = lambda g: F.explode(F.sequence(F.col(g) * F.col("_side") - 1, F.col(g) * F.col("_side") + F.col("_side")))
    around = tiles.withColumn("_cx", span("_gx")).withColumn("_cy", span("_gy")).groupBy("_cx", "_cy").agg(
        F.collect_list(F.struct("_tile", "_slices", "_parts")).alias("_t"))
    return homes.join(tiles, at).drop("n", *at), around, cells.count() * 9


def _best_in_radius(left: DataFrame, right: DataFrame, radius: float, best: Best, key: str | None, lists: Sequence[str]) -> DataFrame:
    """Tiles of cells meet the points of the tile and one cell around it; only centres and points are shuffled."""
    centers, points = left.where("x IS NOT NULL AND y IS NOT NULL"), right.where("_px IS NOT NULL AND _py IS NOT NULL")
    homes, around, most = _sized_tiles(centers, points, radius)
    few = lambda df: df.hint("broadcast" if most <= FEW_TILES else "merge")
    each = lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1))
    deal = lambda n, *c: F.pmod(F.xxhash64(*c), n).cast("int")
    cell = ["_cx", "_cy"]
    ours = with_cell(centers, radius).join(few(homes), cell).drop(*cell).withColumn("_part", deal("_parts", *left.columns)).withColumn("_slice", each("_slices"))
    theirs = with_cell(points, radius, "_px", "_py").join(few(around), cell).select(*right.columns, F.explode("_t").alias("_t")).select(*right.columns, "_t.*")
    theirs = theirs.withColumn("_slice", deal("_slices", *right.columns)).withColumn("_part", each("_parts"))
    dist, whole = T.StructField("dist", T.DoubleType()), T.LongType()

    def rows_of(columns):
        items = T.ArrayType(T.StructType([dist, *[T.StructField(c, right.schema[c].dataType) for c in columns]]))
        return T.StructType([left.schema[key], T.StructField("ranges", T.ArrayType(T.StructType().add("n", whole).add("items", items)))]), items

    if key is None:
        names = [*left.columns], [*right.columns]
        schema = T.StructType([*left.schema.fields, *right.schema.fields, dist, T.StructField("_count", whole)])
    else:
        names = [key], [*lists]
        schema, items = rows_of(lists)
    group = ["_tile", "_part", "_slice"]

    def found(a: DataFrame, b: DataFrame, names, schema) -> DataFrame:
        a, b = (df.drop("_parts", "_slices").groupBy(*group) for df in (a, b))
        return a.cogroup(b).applyInArrow(lambda a, b: _best_of_tile(a, b, names, radius, best, key is not None), schema)

    if key is None:
        return found(ours, theirs, names, schema)
    # keys that come again, and centres whose points are dealt to several tasks, have several rows to put together
    again = cut_lineage(centers.groupBy(F.col(key).alias("_key")).agg(F.count(F.lit(1)).alias("_n")).where("_n > 1").select("_key"))
    same, once, rest = F.col(key).eqNullSafe(F.col("_key")), ours.where("_slices = 1"), ours.where("_slices > 1")
    repeated = not again.isEmpty()
    if not repeated and homes.where("_slices > 1").isEmpty():
        return found(ours, theirs, names, schema)
    if repeated:
        rest = ours.join(again.hint("merge"), same, "left_semi").unionByName(rest.join(again.hint("merge"), same, "left_anti"))
        once = once.join(again.hint("merge"), same, "left_anti")
    # what the rows are sorted by goes along
    by = [*dict.fromkeys([*lists, *([best.by] if best.by else []), best.tie])]
    put = found(rest, theirs, ([key], by), rows_of(by)[0]).select(key, F.posexplode("ranges").alias("_i", "_r"))
    near = F.lit(True) if best.by is None or best.near is None else F.col("_i") < best.near
    order = F.struct(F.when(near, F.col("_v.dist")).alias("d"), (F.lit(None) if best.by is None else F.when(~near, F.col(f"_v.{best.by}"))).alias("b"), F.col(f"_v.{best.tie}").alias("t"))
    counts = put.groupBy(key, "_i").agg(F.sum("_r.n").alias("n"))
    firsts = put.select(key, "_i", F.explode("_r.items").alias("_v")).withColumn("_o", order).withColumn(
        "_k", F.row_number().over(Window.partitionBy(key, "_i").orderBy("_o"))).where(F.col("_k") <= best.n)
    firsts = firsts.groupBy(F.col(key).alias("_key"), F.col("_i").alias("_j")).agg(F.array_sort(F.collect_list(F.struct(
        "_k", F.struct("_v.dist", *[f"_v.{c}" for c in lists]).alias("_v")))).alias("_l"))
    items = F.coalesce(F.transform("_l", lambda v: v["_v"]), F.array().cast(items))
    ranges = counts.join(firsts, same & (F.col("_i") == F.col("_j")), "left").groupBy(key).agg(F.array_sort(F.collect_list(F.struct("_i", "n", items.alias("items")))).alias("_l"))
    return found(once, theirs, names, schema).unionByName(ranges.select(key, F.transform("_l", lambda v: F.struct(v["n"].alias("n"), v["items"].alias("items"))).alias("ranges")))


class _Grid:
    """Points in strips along x and bands along y, each about equally full: what surely lies in a disc is counted by cells."""

    def __init__(self, px: np.ndarray, py: np.ndarray):
        side = int(min(max(math.sqrt(len(px)), 1), 2048))  # strips and bands each, about a point in a cell
        strip, self.x0, self.x1 = self._cut(px, side)
        band, self.y0, self.y1 = self._cut(py, side)
        self.bands = len(self.y0)
        code = strip * self.bands + band
        self.order = np.argsort(code, kind="stable")
        self.px, self.py = px[self.order], py[self.order]
        self.start = np.append(0, np.cumsum(np.bincount(code, minlength=len(self.x0) * self.bands)))
        self.big = max(abs(v) for v in (self.x0[0], self.x1[-1], self.y0[0], self.y1[-1]))

    @staticmethod
    def _cut(v: np.ndarray, side: int):
        """(class of each value, least and greatest value of each class)."""
        ranked = np.sort(v)
        cuts = np.unique(ranked[np.arange(1, side) * len(v) // side])
        cuts = cuts[cuts > ranked[0]]
        first = np.append(0, np.searchsorted(ranked, cuts, "left"))
        return np.searchsorted(cuts, v, "right"), ranked[first], ranked[np.append(first[1:], len(v)) - 1]

    def spans(self, x, y, hole, outer):
        """Ranges (centre, from, to) of ``order`` with all points within ``outer`` of a centre but those surely within ``hole``; and how many these are."""
        n, slack = len(x), 1e-12 * (np.abs(x) + np.abs(y) + self.big)
        wide = outer * (1 + 1e-9) + slack
        c0, c1 = np.searchsorted(self.x1, x - wide, "left"), np.searchsorted(self.x0, x + wide, "right")
        own, k = _spans(np.maximum(c1 - c0, 0))
        s = c0[own] + k
        x, y, slack, wide, hole = x[own], y[own], slack[own], wide[own], hole[own] * (1 - 1e-9) - slack[own]
        left, right = x - self.x0[s], self.x1[s] - x
        out = np.sqrt(np.maximum(wide * wide - np.square(np.maximum(np.maximum(-left, -right), 0)), 0)) + slack
        room = np.where(hole > 0, hole * hole - np.square(np.maximum(left, right)), -1.0)
        sure = np.sqrt(np.maximum(room, 0)) - slack
        lo, hi = np.searchsorted(self.y1, y - out, "left"), np.searchsorted(self.y0, y + out, "right")
        hi = np.maximum(lo, hi)
        in0, in1 = np.searchsorted(self.y0, y - sure, "left"), np.searchsorted(self.y1, y + sure, "right")
        none = (room <= 0) | (sure <= 0) | (in1 <= in0)
        in0, in1 = np.where(none, hi, in0), np.where(none, hi, in1)
        lo, in0, in1, hi = (self.start[s * self.bands + v] for v in (lo, in0, in1, hi))
        held = np.bincount(own, in1 - in0, n).astype(np.int64)
        return np.repeat(own, 2), np.stack([lo, in1], 1).ravel(), np.stack([in0, hi], 1).ravel(), held

    def meet(self, x, y, hole, outer, cells: int = 250_000):
        """For some centres at a time: (first, end, how many points surely lie within the hole of each, and the other pairs
        within ``outer``, and a little more, as centre, place in ``order``, distance)."""
        step = max(1, cells // len(self.x0))
        for a in range(0, len(x), step):
            b = min(a + step, len(x))
            own, lo, hi, sure = self.spans(x[a:b], y[a:b], hole[a:b], outer[a:b])
            weight = np.cumsum(hi - lo)
            ends = np.searchsorted(own, np.arange(b - a), "right")
            total = np.append(0, weight)[ends]
            i = 0
            while i < b - a:
                done = total[i - 1] if i else 0
                j = max(int(np.searchsorted(total, done + cells, "right")), i + 1)
                rows = slice(ends[i - 1] if i else 0, ends[j - 1])
                at, k = _spans((hi - lo)[rows])
                point = lo[rows][at] + k
                centre = a + own[rows][at]
                dx, dy = x[centre] - self.px[point], y[centre] - self.py[point]
                yield a + i, a + j, sure[i:j], centre, point, np.sqrt(dx * dx + dy * dy)
                i = j


def _firsts(x, y, px, py, ties, radius: float, best: Best, window: int = 512, cells: int = 2_000_000):
    """The first pairs of each range as (centre, range, point, distance), in this order, and the number of all pairs (centre, range).

    Points come by ``best.by`` and tie; ``ties`` is their place by the tie alone.
    """
    tops = np.minimum([*best.edges, radius], radius)
    grid, last = _Grid(px, py), len(tops) - 1

    def under(dist, i):
        if i < 0:
            return np.zeros(len(dist), bool)
        return dist <= radius if i == last else (dist <= radius) & (dist <= best.edges[i] if best.closed else dist < best.edges[i])

    within = np.zeros((len(x), len(tops) + 1), np.int64)
    for i, top in enumerate(tops):
        every = np.full(len(x), top)
        for a, b, sure, centre, _, dist in grid.meet(x, y, every, every):
            within[a:b, i + 1] = sure + np.bincount(centre[under(dist, i)] - a, minlength=b - a)
    counts = np.diff(within, axis=1)
    none = np.zeros(0, np.int64)
    out = [(none, none, none, np.zeros(0))]

    def keep(i, centre, point, dist, want, order):
        """The first of each centre; ``order`` are keys, the weakest first."""
        at = np.lexsort([*order, centre])
        centre, point, dist = centre[at], point[at], dist[at]
        new = np.flatnonzero(np.r_[True, centre[1:] != centre[:-1]]) if len(centre) else none
        place = np.arange(len(centre)) - np.repeat(new, np.diff(np.append(new, len(centre))))
        top = place < want[centre]
        out.append((centre[top], np.full(int(top.sum()), i), point[top], dist[top]))

    for i, top in enumerate(tops):
        want = np.minimum(counts[:, i], best.n)
        todo = np.flatnonzero(want)
        hole = tops[i - 1] if i else -1.0
        if best.by is None or best.near is None or i < best.near:
            low = max(hole, 0.0) ** 2
            share = np.minimum(1.0, 4.0 * (best.n + 1) / np.maximum(counts[:, i], 1))
            while len(todo):  # rings around the hole that get wider until they hold enough
                reach = np.where(share[todo] < 1, np.sqrt(low + (top * top - low) * share[todo]), top)
                short = []
                for a, b, _, at, point, dist in grid.meet(x[todo], y[todo], np.full(len(todo), hole), reach):
                    here = under(dist, i) & ~under(dist, i - 1) & (dist <= reach[at])
                    held = np.bincount(at[here] - a, minlength=b - a)
                    enough = (held >= want[todo[a:b]]) | (share[todo[a:b]] >= 1)
                    short.append(todo[a:b][~enough])
                    here &= enough[at - a]
                    point = grid.order[point[here]]
                    keep(i, todo[at[here]], point, dist[here], want, (ties[point], dist[here]))
                todo = np.concatenate(short)
                share[todo] = np.minimum(1.0, share[todo] * 8)
            continue
        # in their order points are looked at until enough are found; few points of a range are all looked at instead
        most = 8.0 * best.n * len(px) / np.maximum(counts[:, i], 1)
        few = counts[todo, i].astype(float) ** 2 <= float(best.n) * len(px)
        rest, todo = [todo[few]], todo[~few]
        for some in np.array_split(todo, max(1, -(-len(todo) * window // cells))):
            got, start, wide = np.zeros(len(some), np.int64), 0, window
            hits = []
            live = np.arange(len(some))
            while len(live) and start < len(px):
                end = min(start + wide, len(px))
                dx, dy = x[some[live], None] - px[None, start:end], y[some[live], None] - py[None, start:end]
                dist = np.sqrt(dx * dx + dy * dy)
                row, col = np.nonzero(under(dist.ravel(), i).reshape(dist.shape) & ~under(dist.ravel(), i - 1).reshape(dist.shape))
                hits.append((live[row], start + col, dist[row, col]))
                got += np.bincount(live[row], minlength=len(some))
                start, wide = end, max(window, min(2 * wide, cells // max(len(live), 1)))
                live = live[(got[live] < want[some[live]]) & (start < most[some[live]])]
            enough = got >= want[some]
            rest.append(some[~enough])
            at, point, dist = (np.concatenate(v) for v in zip(*hits)) if hits else (none, none, np.zeros(0))
            at, point, dist = (v[enough[at]] for v in (at, point, dist))
            keep(i, some[at], point, dist, want, (point,))
        todo = np.sort(np.concatenate(rest))
        for a, b, _, at, point, dist in grid.meet(x[todo], y[todo], np.full(len(todo), hole), np.full(len(todo), top)):
            here = under(dist, i) & ~under(dist, i - 1)
            point = grid.order[point[here]]
            keep(i, todo[at[here]], point, dist[here], want, (point,))
    centre, ring, point, dist = (np.concatenate(v) for v in zip(*out))
    at = np.argsort(centre * len(tops) + ring, kind="stable")  # each centre and range was kept once, in its order
    return centre[at], ring[at], point[at], dist[at], counts


def _best_of_tile(a: pa.Table, b: pa.Table, names, radius: float, best: Best, lists: bool = False) -> pa.Table:
    """The rows of ``radius_join`` with ``best`` for the centres ``a`` and points ``b`` of one tile."""
    first = [(best.by, "ascending")] if best.by else []
    if a.num_rows and b.num_rows:
        b = b.take(pc.sort_indices(b, sort_keys=[*first, (best.tie, "ascending")], null_placement="at_start"))
    ties = np.empty(b.num_rows, np.int64)
    ties[pc.sort_indices(b, sort_keys=[(best.tie, "ascending")], null_placement="at_start").to_numpy()] = np.arange(b.num_rows)
    x, y, px, py = (_floats(t, c) for t, c in ((a, "x"), (a, "y"), (b, "_px"), (b, "_py")))
    live, there = np.flatnonzero(np.isfinite(x) & np.isfinite(y)), np.flatnonzero(np.isfinite(px) & np.isfinite(py))
    if len(live) and len(there):
        live = live[np.lexsort((y[live], np.floor(x[live] / radius * 8)))]  # neighbours look at the same points
        centre, ring, point, dist, counts = _firsts(x[live], y[live], px[there], py[there], ties[there], radius, best)
    else:
        centre, ring, point = (np.zeros(0, np.int64) for _ in range(3))
        dist, counts, live, there = np.zeros(0), np.zeros((0, len(best.edges) + 1), np.int64), live[:0], there[:0]
    right = b.select(names[1]).take(pa.array(there[point]))
    if lists:
        met = np.flatnonzero(counts.sum(axis=1))
        sizes = np.minimum(counts[met], best.n).ravel()
        items = pa.StructArray.from_arrays([pa.array(dist), *[_whole(c) for c in right.columns]], ["dist", *names[1]])
        items = pa.ListArray.from_arrays(pa.array(np.append(0, np.cumsum(sizes)), pa.int32()), items)
        ranges = pa.StructArray.from_arrays([pa.array(counts[met].ravel()), items], ["n", "items"])
        ranges = pa.ListArray.from_arrays(pa.array(np.arange(len(met) + 1) * counts.shape[1], pa.int32()), ranges)
        left = a.select(names[0]).take(pa.array(live[met]))
        return pa.table([*left.columns, ranges], names=[*names[0], "ranges"])
    new = np.r_[True, (centre[1:] != centre[:-1]) | (ring[1:] != ring[:-1])][:len(centre)]
    left = a.select(names[0]).take(pa.array(live[centre]))
    count = np.where(new, counts[centre, ring], 0)
    return pa.table([*left.columns, *right.columns, pa.array(dist), pa.array(count)], names=[*names[0], *names[1], "dist", "_count"])


#: Points in the nine cells around a centre, as a multiple of k, above which the search goes on in finer cells.
CROWD = 8
#: Fewer points than these are no crowd: one task finds the nearest of them as they are.
FEW = 2048
#: Points around a tile above which its centres meet them in a join of cells and not in one task.
TILE_POINTS = 500_000
#: Centres of a tile that are looked at together; a tile of more is dealt to several tasks.
TILE_CENTERS = 8192
#: Tiles at most that a join sends to every task.
FEW_TILES = 100_000
#: Halvings of the radius at most: of 300 m, cells of 5 mm. Points closer together than that are compared as they are.
FINEST = 16


def _held(centers: DataFrame, points: DataFrame, radius: float, k: int, levels: range) -> DataFrame:
    """Per occupied cell (hx, hy) of ``centers`` on the last of ``levels``: the last level ``_lv`` whose nine cells around it
    hold k points, and how many ``n`` they hold. No row where no level holds k.

    A pyramid of counts: cells of side radius / 2 ** level, each level added up from the finest, which is a map-side
    combined aggregate, so a crowded place is one row here.
    """
    depth = levels[-1]
    finest = with_cell(points, radius / (1 << depth)).groupBy("_cx", "_cy").agg(F.count(F.lit(1)).alias("n"))
    each = F.explode(F.array(*[F.lit(v) for v in levels])).alias("_lv")
    shrink = lambda c: F.floor(F.col(c) / F.pow(F.lit(2.0), F.lit(depth) - F.col("_lv")))
    pyramid = finest.select("_cx", "_cy", "n", each).groupBy("_lv", shrink("_cx").alias("_cx"), shrink("_cy").alias("_cy")).agg(F.sum("n").alias("n"))
    homes = with_cell(centers, radius / (1 << depth)).select("_cx", "_cy").distinct().select(F.col("_cx").alias("hx"), F.col("_cy").alias("hy"), "_cx", "_cy", each)
    asked = homes.select("hx", "hy", "_lv", F.explode(_steps(1)).alias("_i"), shrink("_cx").alias("_bx"), shrink("_cy").alias("_by"))
    asked = asked.select("hx", "hy", "_lv", (F.col("_bx") + F.col("_i")).alias("_cx"), F.explode(_steps(1)).alias("_j"), "_by")
    near = asked.withColumn("_cy", F.col("_by") + F.col("_j")).join(pyramid, ["_lv", "_cx", "_cy"])
    enough = near.groupBy("hx", "hy", "_lv").agg(F.sum("n").alias("n")).where(F.col("n") >= k)
    return enough.groupBy("hx", "hy").agg(F.max("_lv").alias("_lv"), F.max_by("n", "_lv").alias("n"))


def _refined(
    centers: DataFrame, points: DataFrame, counted: DataFrame, radius: float, k: int, depth: int
) -> list[tuple[int, DataFrame, DataFrame]]:
    """Rounds of (depth, ``_held`` as a written table, points that its levels may meet).

    The first round looks at all centres down to ``depth``. Where the nine finest cells still hold more than ``CROWD * k``
    points (and ``FEW``), the next round goes four levels down with the centres there and the points near them, until no place is
    crowded: the depth follows from the counts, and only crowded places pay for it. Tables of cells grow with the centres
    and look small as files, so their joins are kept from passing one through the driver.
    """
    rounds, low, depth, near, homes = [], 2, max(depth, 2), points, centers.select("x", "y")  # coarser levels bound nothing
    while True:
        held = cut_lineage(_held(homes, near if rounds else counted, radius, k, range(low, depth + 1)))
        rounds.append((depth, held, near))
        crowded = held.where((F.col("_lv") == depth) & (F.col("n") > max(CROWD * k, FEW))).select(F.col("hx").alias("_cx"), F.col("hy").alias("_cy"))
        if depth >= FINEST or crowded.isEmpty():
            return rounds
        # finer bounds are below 1.5 cells, so two cells around hold all points they reach
        around = crowded.withColumn("_i", F.explode(_steps(2))).withColumn("_j", F.explode(_steps(2)))
        around = around.select((F.col("_cx") + F.col("_i")).alias("_cx"), (F.col("_cy") + F.col("_j")).alias("_cy")).distinct()
        near = with_cell(near, radius / (1 << depth)).join(around.hint("merge"), ["_cx", "_cy"], "left_semi").drop("_cx", "_cy")
        homes = with_cell(homes, radius / (1 << depth)).join(crowded.hint("merge"), ["_cx", "_cy"], "left_semi").drop("_cx", "_cy")
        low, depth = depth + 1, min(depth + 4, FINEST)


def nearest_k(
    centers: DataFrame, points: DataFrame, radius: float, k: int,
    key: str = "build_id", tie: str = "poi_id", depth: int = 4, lists: Sequence[str] | None = None,
) -> DataFrame:
    """The k nearest points within ``radius`` of every centre, with ``dist`` and ``rk`` (1 = nearest).

    With ``lists``, names of the points' columns, a key with any point is one row: ``key`` and ``items``, its points by rank
    as (rk, dist, *lists). The tasks that find the points write the lists, so what is made of them needs no shuffle.

    Exact. Ranks tie-break on ``tie``. Two steps keep crowded places from producing all pairs:

    * of points at the very same spot only the k lowest ``tie`` values can ever be among the k nearest,
      so the others are left out before the join;
    * counts of cells give each centre a search radius sure to hold its k nearest, and a grid of about that size.
      Cells start at ``radius / 2 ** depth`` and get finer where they are crowded.

    The centres of a tile, 4 x 4 cells of that grid, meet the points of the tile and one cell around it in one task, so
    only centres and points are shuffled, and a centre leaves with its k rows. Centres with more than ``TILE_POINTS``
    points around their tile, and those whose key comes again, go through pairs by cells and a rank that Spark's partial
    window limit cuts to k before the shuffle on ``key``.
    """
    spot = Window.partitionBy("x", "y").orderBy(tie)
    kept = points.withColumn("_s", F.row_number().over(spot)).where(F.col("_s") <= k).drop("_s")
    sized, placed, grids = _searches(centers, kept, radius, k, depth, points)
    at = ["_lv", "_tx", "_ty"]
    homes = sized.where("x IS NOT NULL AND y IS NOT NULL").withColumns(_tile("x", "y", radius))
    around = points.select(F.col("x").alias("_px"), F.col("y").alias("_py"), F.explode(F.array(*[F.lit(v) for v in grids])).alias("_lv"))
    load = _around(around, radius).groupBy(*at).agg(F.count(F.lit(1)).alias("_p"))
    tiles = homes.groupBy(*at).agg(F.count(F.lit(1)).alias("_n")).join(load.hint("merge"), at)
    tiles = cut_lineage(tiles.select(*at, F.ceil(F.col("_n") / TILE_CENTERS).cast("int").alias("_parts"), (F.col("_p") > TILE_POINTS).alias("_full")))
    n, full = tiles.agg(F.count(F.lit(1)), F.coalesce(F.sum(F.col("_full").cast("long")), F.lit(0))).first()
    again = cut_lineage(centers.groupBy(F.col(key).alias("_key")).agg(F.count(F.lit(1)).alias("_n")).where("_n > 1").select("_key"))
    same = F.col(key).eqNullSafe(F.col("_key"))
    few = tiles.hint("broadcast" if n <= FEW_TILES else "merge")
    homes, repeated = homes.join(few, at), not again.isEmpty()
    ours = homes.where("NOT _full")
    if repeated:
        ours = ours.join(again.hint("merge"), same, "left_anti")
    ours = ours.withColumn("_part", F.pmod(F.xxhash64(key, "x", "y"), "_parts").cast("int")).drop("_parts", "_full")
    theirs = _around(placed, radius).join(few.where("NOT _full"), at).withColumn(
        "_part", F.explode(F.sequence(F.lit(0), F.col("_parts") - 1))).drop("_parts", "_full")
    rk, dist = T.StructField("rk", T.IntegerType()), T.StructField("dist", T.DoubleType())
    if lists is None:
        names = [*centers.columns], [c for c in placed.columns if c != "_lv"]
        schema = T.StructType([*centers.schema.fields, *[placed.schema[c] for c in names[1]], dist, rk])
    else:
        names = [key], [*lists]
        item = T.StructType([rk, dist, *[placed.schema[c] for c in lists]])
        schema = T.StructType([centers.schema[key], T.StructField("items", T.ArrayType(item))])
    found = ours.groupBy(*at, "_part").cogroup(theirs.groupBy(*at, "_part")).applyInArrow(
        lambda a, b: _nearest_of_tile(a, b, names, tie, radius, k, lists is not None), schema)
    if not full and not repeated:
        return found
    rest = homes.where("_full")
    if repeated:
        rest = homes.join(again.hint("merge"), same, "left_semi").unionByName(rest.join(again.hint("merge"), same, "left_anti"))
    pairs = _within(_meet(rest.drop("_tx", "_ty", "_parts", "_full"), placed, radius), radius)
    rank = Window.partitionBy(key).orderBy("dist", tie)
    ranked = pairs.withColumn("rk", F.row_number().over(rank)).where(F.col("rk") <= k)
    if lists is not None:
        ranked = ranked.groupBy(key).agg(F.array_sort(F.collect_list(F.struct("rk", "dist", *lists))).alias("items"))
    return found.unionByName(ranked)


def _size(radius: float):
    """Side of a cell of the grid ``_lv``."""
    return F.lit(float(radius)) / F.pow(F.lit(2.0), F.col("_lv"))


def _tile(x: str, y: str, radius: float, shift: int = 0) -> dict:
    """The tile of 4 x 4 cells of grid ``_lv`` that holds the cell ``shift`` cells beside that of the point."""
    return {t: F.floor((F.floor(F.col(c) / _size(radius)) + shift) / 4) for t, c in (("_tx", x), ("_ty", y))}


def _around(placed: DataFrame, radius: float) -> DataFrame:
    """Points (_px, _py) on a grid, once for each of the tiles (four at most) that they lie in or one cell beside."""
    low, high = (_tile("_px", "_py", radius, shift) for shift in (-1, 1))
    for t in low:
        placed = placed.withColumn(t, F.explode(F.sequence(low[t], high[t])))
    return placed


def _spans(sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For sizes n: each index n times, and 0 .. n - 1 beside it."""
    own = np.repeat(np.arange(len(sizes)), sizes)
    return own, np.arange(len(own)) - np.repeat(np.cumsum(sizes) - sizes, sizes)


class _Strips:
    """Points in strips along x, by y inside a strip: ranges of them for many boxes at once."""

    def __init__(self, px: np.ndarray, py: np.ndarray, width: float):
        self.x0, self.y0, self.tall = px.min(), py.min(), float(np.ptp(py))
        self.last = int(min(max(np.ptp(px) / width, 0), 4095)) if width > 0 else 0
        self.width = max(float(np.ptp(px)) / (self.last + 1), 1e-300)
        strip = self._strip(px)
        self.order = np.lexsort((py, strip))
        self.margin = 0.1 * self.tall + 0.4
        self.step = self.tall + 3 * self.margin  # strips lie apart in one sorted key
        self.key = (strip * self.step + (py - self.y0))[self.order]
        self.slack = 8e-16 * ((self.last + 2) * self.step + abs(self.x0) + abs(self.y0))  # what rounding can move a key or a side

    def _strip(self, x):
        return np.clip(np.floor((x - self.x0) / self.width), -1, self.last + 1).clip(0, self.last).astype(np.int64)

    def ranges(self, x, y, h, inner: bool):
        """(box, from, to) in ``order``: strips that meet the boxes of half side h; ``inner``: only those inside them."""
        low, high = (np.clip(v - self.y0, -self.margin, self.tall + self.margin) for v in (y - h, y + h))
        if inner:
            c0 = np.clip(np.floor((x - h - self.x0) / self.width) + 1, 0, self.last + 1).astype(np.int64)
            c1 = np.clip(np.floor((x + h - self.x0) / self.width) - 1, -1, self.last).astype(np.int64)
        else:
            c0, c1 = self._strip(x - h), self._strip(x + h)
        own, k = _spans(np.maximum(c1 - c0 + 1, 0))
        at = (c0[own] + k) * self.step
        return own, np.searchsorted(self.key, at + low[own], "left"), np.searchsorted(self.key, at + high[own], "right")


def _nearest(x, y, reach, px, py, k: int, cells: int = 2_000_000):
    """(centre, point, distance, rank) of the k nearest points within ``reach`` of each centre; points come in the order of ties."""
    none = np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0), np.zeros(0, np.int64)
    inside = np.flatnonzero(np.isfinite(px) & np.isfinite(py))
    if not len(inside) or not len(x):
        return none
    px, py = px[inside], py[inside]
    # about k points in a square of four strips
    strips = _Strips(px, py, math.sqrt(max(np.ptp(px) * np.ptp(py), 0.0) * k / len(px)) / 4)
    reach = np.asarray(reach, float).copy()
    half, live = reach.copy(), np.flatnonzero(np.isfinite(x) & np.isfinite(y))
    alive = live
    while len(live):  # a box around the centre with k points bounds the search; it is halved while it holds them
        h = half[live] / 2
        own, lo, hi = strips.ranges(x[live], y[live], h, True)
        held = np.bincount(own, hi - lo, len(live))
        enough = held >= k
        half[live[enough]] = h[enough]
        reach[live[enough]] = np.minimum(reach[live[enough]], math.sqrt(2.0) * (h[enough] * (1 + 1e-9) + strips.slack))
        live = live[held > 2 * k]
    out, first = [none], 0
    own, lo, hi = strips.ranges(x[alive], y[alive], reach[alive] * (1 + 1e-9) + strips.slack, False)
    size = hi - lo
    ends = np.searchsorted(own, np.arange(len(alive)), side="right")  # strips of each centre
    weight = np.append(0, np.cumsum(size))[ends]  # candidates of the centres up to each
    while first < len(alive):  # about so many candidates at a time
        done = weight[first - 1] if first else 0
        end = max(int(np.searchsorted(weight, done + cells, side="right")), first + 1)
        rows = slice(ends[first - 1] if first else 0, ends[end - 1])
        first = end
        i, at = _spans(size[rows])
        point = strips.order[lo[rows][i] + at]
        centre = alive[own[rows][i]]
        dx, dy = x[centre] - px[point], y[centre] - py[point]
        dist = np.sqrt(dx * dx + dy * dy)
        near = dist <= reach[centre]
        centre, point, dist = centre[near], point[near], dist[near]
        order = np.lexsort((point, dist, centre))
        centre, point, dist = centre[order], point[order], dist[order]
        starts = np.flatnonzero(np.r_[True, centre[1:] != centre[:-1]]) if len(centre) else none[0]
        rank = np.arange(len(centre)) - np.repeat(starts, np.diff(np.append(starts, len(centre)))) + 1
        top = rank <= k
        out.append((centre[top], inside[point[top]], dist[top], rank[top]))
    return tuple(np.concatenate(v) for v in zip(*out))


def _floats(table: pa.Table, name: str) -> np.ndarray:
    """A column as doubles, NULL as NaN."""
    return table.column(name).cast(pa.float64()).to_numpy()


def _whole(column: pa.ChunkedArray) -> pa.Array:
    return column.combine_chunks() if column.num_chunks != 1 else column.chunk(0)


def _nearest_of_tile(a: pa.Table, b: pa.Table, names, tie: str, radius: float, k: int, lists: bool = False) -> pa.Table:
    """The rows of ``nearest_k`` for the centres ``a`` and points ``b`` of one tile; ``names`` are the columns of both to keep."""
    if a.num_rows and b.num_rows:
        b = b.take(pc.sort_indices(b, sort_keys=[(tie, "ascending")], null_placement="at_start"))
    centre, point, dist, rank = _nearest(
        *(_floats(a, c) for c in "xy"), np.minimum(_floats(a, "_r"), radius), *(_floats(b, c) for c in ("_px", "_py")), k)
    right = b.select(names[1]).take(pa.array(point)).combine_chunks()
    if lists:  # pairs come by centre and rank
        starts = np.flatnonzero(rank == 1)
        columns = [pa.array(rank, pa.int32()), pa.array(dist), *[_whole(c) for c in right.columns]]
        items = pa.StructArray.from_arrays(columns, ["rk", "dist", *names[1]])
        ends = pa.array(np.append(starts, len(rank)), pa.int32())
        left = a.select(names[0]).take(pa.array(centre[starts]))
        return pa.table([*left.columns, pa.ListArray.from_arrays(ends, items)], names=[*names[0], "items"])
    left = a.select(names[0]).take(pa.array(centre))
    return pa.table([*left.columns, *right.columns, pa.array(dist), pa.array(rank, pa.int32())], names=[*names[0], *names[1], "dist", "rk"])


def _grid(level):
    """The level of the grid whose cells are no smaller than the search radius that ``level`` of the pyramid gives."""
    return F.greatest(level - 2, F.lit(0))


def _searches(
    centers: DataFrame, points: DataFrame, radius: float, k: int, depth: int, counted: DataFrame | None = None
) -> tuple[DataFrame, DataFrame, list[int]]:
    """Centres with their grid ``_lv`` and search radius ``_r``, points (_px, _py) on the grids in use, and these grids.

    What lies in the nine pyramid cells around a centre's own is within two cell diagonals: the search radius.
    Points stand on those grids only that some centre uses.
    """
    rounds = _refined(centers, points, points.select("x", "y") if counted is None else counted.select("x", "y"), radius, k, depth)
    sized, placed, used = centers.withColumn("_lv", F.lit(None).cast("int")), None, set()
    for at, held, near in rounds:
        found = held.select("hx", "hy", F.col("_lv").alias("_found"))
        homes = with_cell(sized, radius / (1 << at)).withColumnsRenamed({"_cx": "hx", "_cy": "hy"}).join(found.hint("merge"), ["hx", "hy"], "left")
        sized = homes.withColumn("_lv", F.coalesce("_found", "_lv")).drop("hx", "hy", "_found")
        grids = {r[0] for r in held.select(_grid(F.col("_lv"))).distinct().collect()} | ({0} if placed is None else set())
        if grids:
            there = near.withColumnsRenamed({"x": "_px", "y": "_py"}).withColumn("_lv", F.explode(F.array(*[F.lit(v) for v in sorted(grids)])))
            placed = there if placed is None else placed.unionByName(there)
            used |= grids
    bound = F.lit(2 * math.sqrt(2.0) * radius * (1 + 1e-6)) / F.pow(F.lit(2.0), F.col("_lv"))
    sized = sized.withColumn("_r", F.coalesce(bound, F.lit(float(radius)))).withColumn("_lv", F.coalesce(_grid(F.col("_lv")), F.lit(0)))
    return sized, placed, sorted(used)


def _meet(sized: DataFrame, placed: DataFrame, radius: float) -> DataFrame:
    """Centres next to the points of the nine cells of their grid around them."""
    size = _size(radius)
    a = (
        sized.withColumn("_i", F.explode(_steps(1))).withColumn("_j", F.explode(_steps(1)))
        .withColumn("_cx", F.floor(F.col("x") / size) + F.col("_i"))
        .withColumn("_cy", F.floor(F.col("y") / size) + F.col("_j"))
        .drop("_i", "_j")
    )
    b = placed.withColumn("_cx", F.floor(F.col("_px") / size)).withColumn("_cy", F.floor(F.col("_py") / size))
    return a.join(b, ["_lv", "_cx", "_cy"]).drop("_lv", "_cx", "_cy")


def _candidates(
    centers: DataFrame, points: DataFrame, radius: float, k: int, depth: int, counted: DataFrame | None = None
) -> DataFrame:
    """Centres next to the points of the nine grid cells around them, with the search radius ``_r`` of the centre."""
    sized, placed, _ = _searches(centers, points, radius, k, depth, counted)
    return _meet(sized, placed, radius)


def _within(met: DataFrame, radius: float) -> DataFrame:
    near = met.withColumn("dist", _distance())
    return near.where((F.col("dist") <= F.col("_r")) & (F.col("dist") <= radius)).drop("_r")


def _bounded_pairs(
    centers: DataFrame, points: DataFrame, radius: float, k: int, depth: int, counted: DataFrame | None = None
) -> DataFrame:
    return _within(_candidates(centers, points, radius, k, depth, counted), radius)


def _level(prefix: str, cell: float):
    """Level of a box: cells of size cell * 4 ** level are no shorter than its sides, so it covers four at most."""
    side = F.greatest(F.col(prefix + "maxx") - F.col(prefix + "minx"), F.col(prefix + "maxy") - F.col(prefix + "miny"))
    return F.when(side <= cell, 0).otherwise(F.ceil(F.log(side / cell) / F.log(F.lit(4.0)) - 1e-9)).cast("int")


def _levels(df: DataFrame, prefix: str, cell: float) -> list[int]:
    """Levels in use: one pass, and as many numbers as powers of four between a cell and the largest box."""
    return sorted(r[0] for r in df.select(_level(prefix, cell).alias("l")).where("l IS NOT NULL").distinct().collect())


def _cells(df: DataFrame, prefix: str, cell: float, others: list[int], own: str) -> DataFrame:
    """The cells of a box at its own level, and at every coarser level that boxes of the other side have."""
    at = F.filter(F.array_union(F.array(F.col(own)), F.array(*[F.lit(v) for v in others]).cast("array<int>")), lambda v: v >= F.col(own))
    sized = df.withColumn(own, _level(prefix, cell)).where(F.col(own).isNotNull())
    sized = sized.withColumn("_lv", F.explode(at)).withColumn("_size", F.lit(float(cell)) * F.pow(F.lit(4.0), F.col("_lv")))

    def span(lo, hi):
        return F.sequence(F.floor(F.col(prefix + lo) / F.col("_size")), F.floor(F.col(prefix + hi) / F.col("_size")))

    return sized.withColumn("_cx", F.explode(span("minx", "maxx"))).withColumn("_cy", F.explode(span("miny", "maxy")))


def bbox_join(left: DataFrame, right: DataFrame, cell: float, lp: str = "a_", rp: str = "b_", by: Sequence[str] = ()) -> DataFrame:
    """Pairs whose boxes touch. Boxes are the columns minx, miny, maxx, maxy behind a prefix.

    ``by`` are columns that must be equal too, for layers that lie over one another.

    A box is placed on the grid of its size, on four cells at most whether it is a hut or a province, and once more on
    each coarser grid that the other side uses; two boxes meet on the grid of the larger. A pair that meets in several
    cells is kept only in the cell of the lower corner of the common box, so no ``distinct`` is needed afterwards.
    Boxes with a NULL side meet nothing.
    """
    a = _cells(left, lp, cell, _levels(right, rp, cell), "_la")
    b = _cells(right, rp, cell, _levels(left, lp, cell), "_lb").drop("_size")
    touch = (
        (F.col(lp + "minx") <= F.col(rp + "maxx")) & (F.col(rp + "minx") <= F.col(lp + "maxx"))
        & (F.col(lp + "miny") <= F.col(rp + "maxy")) & (F.col(rp + "miny") <= F.col(lp + "maxy"))
    )
    corner = (
        (F.col("_cx") == F.floor(F.greatest(F.col(lp + "minx"), F.col(rp + "minx")) / F.col("_size")))
        & (F.col("_cy") == F.floor(F.greatest(F.col(lp + "miny"), F.col(rp + "miny")) / F.col("_size")))
    )
    met = a.join(b, [*by, "_lv", "_cx", "_cy"]).where((F.col("_lv") == F.greatest("_la", "_lb")) & touch & corner)
    return met.drop("_lv", "_cx", "_cy", "_size", "_la", "_lb")
