"""Coordinate, rectangle and ring expressions (all Catalyst expressions)."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

# --- fixed values: public constants of the formulas ---
EARTH_RADIUS = 6378137.0            # Web Mercator sphere, metres
KRASOVSKY_AXIS = 6378245.0          # GCJ-02 ellipsoid, metres
KRASOVSKY_ECC = 0.00669342162296594323
GEOHASH_ALPHABET = "0123456789bcdefghjkmnpqrstuvwxyz"
CHINA_BOX = (72.004, 137.8347, 0.8293, 55.8271)  # lon from/to, lat from/to
# --- end of fixed values ---


def _col(c) -> Column:
    return F.col(c) if isinstance(c, str) else c


# ---- projections -----------------------------------------------------------

def mercator_x(lon) -> Column:
    return F.lit(EARTH_RADIUS) * F.radians(_col(lon))


def mercator_y(lat) -> Column:
    return F.lit(EARTH_RADIUS) * F.log(F.tan(F.lit(math.pi / 4) + F.radians(_col(lat)) / 2))


def lon_of(x) -> Column:
    return F.degrees(_col(x) / EARTH_RADIUS)


def lat_of(y) -> Column:
    return F.degrees(F.lit(2.0) * F.atan(F.exp(_col(y) / EARTH_RADIUS)) - F.lit(math.pi / 2))


def gcj02_to_wgs84(lon, lat) -> tuple[Column, Column]:
    """Public GCJ-02 approximation, one step back; points outside China pass through."""
    lon, lat = _col(lon), _col(lat)
    x, y = lon - 105.0, lat - 35.0
    pi = math.pi

    def waves(u: Column, amplitudes) -> Column:
        total = F.lit(0.0)
        for amplitude, period in amplitudes:
            total = total + F.lit(amplitude) * F.sin(u * pi / period)
        return total * 2.0 / 3.0

    common = waves(x, [(20.0, 1 / 6), (20.0, 0.5)])
    root = F.sqrt(F.abs(x))
    dlat = (
        -100.0 + 2.0 * x + 3.0 * y + 0.2 * y * y + 0.1 * x * y + 0.2 * root
        + common + waves(y, [(20.0, 1.0), (40.0, 3.0)]) + waves(y, [(160.0, 12.0), (320.0, 30.0)])
    )
    dlon = (
        300.0 + x + 2.0 * y + 0.1 * x * x + 0.1 * x * y + 0.1 * root
        + common + waves(x, [(20.0, 1.0), (40.0, 3.0)]) + waves(x, [(150.0, 12.0), (300.0, 30.0)])
    )
    rad = F.radians(lat)
    magic = 1 - F.lit(KRASOVSKY_ECC) * F.sin(rad) * F.sin(rad)
    sqrt_magic = F.sqrt(magic)
    dlat = F.degrees(dlat * magic * sqrt_magic / (KRASOVSKY_AXIS * (1 - KRASOVSKY_ECC)))
    dlon = F.degrees(dlon * sqrt_magic / (KRASOVSKY_AXIS * F.cos(rad)))
    w, e, s, n = CHINA_BOX
    inside = lon.between(w, e) & lat.between(s, n)
    return F.when(inside, lon - dlon).otherwise(lon), F.when(inside, lat - dlat).otherwise(lat)


def geohash(lat, lon, precision: int = 9) -> Column:
    """Base-32 cell key: halvings of longitude and latitude, interleaved from longitude."""
    bits = 5 * precision
    lon_bits, lat_bits = (bits + 1) // 2, bits // 2
    lon_cell = F.least(F.floor((_col(lon) + 180.0) / 360.0 * 2.0**lon_bits), F.lit(2**lon_bits - 1))
    lat_cell = F.least(F.floor((_col(lat) + 90.0) / 180.0 * 2.0**lat_bits), F.lit(2**lat_bits - 1))
    chars = []
    for i in range(precision):
        code = F.lit(0)
        for p in range(5 * i, 5 * i + 5):
            cell, width = (lon_cell, lon_bits) if p % 2 == 0 else (lat_cell, lat_bits)
            bit = F.shiftright(cell, width - 1 - p // 2).bitwiseAND(F.lit(1))
            code = code * 2 + bit
        chars.append(F.substring(F.lit(GEOHASH_ALPHABET), (code + 1).cast("int"), F.lit(1)))
    return F.concat(*chars)


# ---- affine ---------------------------------------------------------------

def pixel_to_map(row, col, affine) -> tuple[Column, Column]:
    """Map coordinates of a pixel centre; ``affine`` = (a, b, c, d, e, f)."""
    a, b, c, d, e, f = affine
    px, py = _col(col) + 0.5, _col(row) + 0.5
    return a * px + b * py + c, d * px + e * py + f


def map_to_pixel(x, y, affine) -> tuple[Column, Column]:
    """(row, col) of the pixel that holds a map point (axis-aligned affine)."""
    a, _, c, _, e, f = affine
    return F.floor((_col(y) - f) / e), F.floor((_col(x) - c) / a)


# ---- rectangles ------------------------------------------------------------

def rect_area(prefix: str = "") -> Column:
    p = prefix
    return (F.col(p + "maxx") - F.col(p + "minx")) * (F.col(p + "maxy") - F.col(p + "miny"))


def rect_intersection(a: str, b: str) -> Column:
    """Common area of two prefixed rectangles."""
    w = F.least(F.col(a + "maxx"), F.col(b + "maxx")) - F.greatest(F.col(a + "minx"), F.col(b + "minx"))
    h = F.least(F.col(a + "maxy"), F.col(b + "maxy")) - F.greatest(F.col(a + "miny"), F.col(b + "miny"))
    return F.greatest(w, F.lit(0.0)) * F.greatest(h, F.lit(0.0))


def overlap_ratio(inter: Column, area_a: Column) -> Column:
    return F.when(area_a > 0, inter / area_a).otherwise(0.0)


def iou(inter: Column, area_a: Column, area_b: Column) -> Column:
    union = area_a + area_b - inter
    return F.when(union > 0, inter / union).otherwise(0.0)


def area_ratio(area_a: Column, area_b: Column) -> Column:
    big = F.greatest(area_a, area_b)
    return F.when(big > 0, F.least(area_a, area_b) / big).otherwise(0.0)


def distance_decay(dist: Column, alpha: float = 20.0) -> Column:
    return F.exp(-dist / F.lit(alpha))


def match_score(iou_: Column, overlap: Column, ratio: Column, decay: Column,
                weights=(0.65, 0.15, 0.10, 0.10)) -> Column:
    wi, wo, wa, wd = weights
    return wi * iou_ + wo * overlap + wa * ratio + wd * decay


# ---- rings: closed ARRAY<STRUCT<x, y>> --------------------------------------

def ring_of_rect(minx, miny, maxx, maxy) -> Column:
    minx, miny, maxx, maxy = map(_col, (minx, miny, maxx, maxy))
    corners = [(minx, miny), (maxx, miny), (maxx, maxy), (minx, maxy), (minx, miny)]
    return F.array(*[F.struct(x.cast("double").alias("x"), y.cast("double").alias("y")) for x, y in corners])


def _edges(ring: Column, fn) -> Column:
    n = F.size(ring) - 1
    return F.zip_with(F.slice(ring, F.lit(1), n), F.slice(ring, F.lit(2), n), fn)


def _sum(values: Column) -> Column:
    return F.aggregate(values, F.lit(0.0), lambda s, v: s + v)


def ring_signed_area(ring) -> Column:
    ring = _col(ring)
    return _sum(_edges(ring, lambda p, q: p["x"] * q["y"] - q["x"] * p["y"])) / 2.0


def ring_area(ring) -> Column:
    return F.abs(ring_signed_area(ring))


def ring_centroid(ring) -> tuple[Column, Column]:
    ring = _col(ring)
    # shift to the first vertex: far from the origin the plain form loses digits
    x0, y0 = ring[0]["x"], ring[0]["y"]
    local = F.transform(ring, lambda p: F.struct((p["x"] - x0).alias("x"), (p["y"] - y0).alias("y")))
    area = ring_signed_area(local)
    cx = _sum(_edges(local, lambda p, q: (p["x"] + q["x"]) * (p["x"] * q["y"] - q["x"] * p["y"])))
    cy = _sum(_edges(local, lambda p, q: (p["y"] + q["y"]) * (p["x"] * q["y"] - q["x"] * p["y"])))
    return x0 + cx / (6.0 * area), y0 + cy / (6.0 * area)


def ring_bounds(ring) -> dict[str, Column]:
    ring = _col(ring)
    xs, ys = F.transform(ring, lambda p: p["x"]), F.transform(ring, lambda p: p["y"])
    return {"minx": F.array_min(xs), "miny": F.array_min(ys), "maxx": F.array_max(xs), "maxy": F.array_max(ys)}


def canonical_ring(ring) -> Column:
    """Same ring, starting at its least vertex and running counter-clockwise."""
    ring = _col(ring)
    ccw = F.when(ring_signed_area(ring) < 0, F.reverse(ring)).otherwise(ring)
    open_ring = F.slice(ccw, F.lit(1), F.size(ccw) - 1)
    at = F.array_position(open_ring, F.array_min(open_ring)).cast("int")
    head = F.slice(open_ring, at, F.size(open_ring))
    tail = F.slice(open_ring, F.lit(1), at - 1)
    turned = F.concat(head, tail)
    return F.concat(turned, F.slice(turned, 1, 1))


def ring_is_usable(ring) -> Column:
    """At least a triangle, and not of zero area."""
    ring = _col(ring)
    return ring.isNotNull() & (F.size(ring) >= 4) & (ring_area(ring) > 0)


def ring_contains(ring, x, y) -> Column:
    """Even-odd test of a point against a closed ring."""
    x, y = _col(x), _col(y)
    hits = _edges(
        _col(ring),
        lambda p, q: F.when(
            ((p["y"] > y) != (q["y"] > y))
            & (x < (q["x"] - p["x"]) * (y - p["y"]) / (q["y"] - p["y"]) + p["x"]), 1
        ).otherwise(0),
    )
    return F.aggregate(hits, F.lit(0), lambda s, v: s + v) % 2 == 1


def ring_to_wkt(ring) -> Column:
    pts = F.transform(_col(ring), lambda p: F.concat_ws(" ", p["x"].cast("string"), p["y"].cast("string")))
    return F.concat(F.lit("POLYGON (("), F.array_join(pts, ", "), F.lit("))"))


def ring_from_wkt(wkt) -> Column:
    """Outer ring of a ``POLYGON ((x y, ...))`` text."""
    body = F.regexp_extract(_col(wkt), r"(?i)^\s*POLYGON\s*\(\(\s*([^)]*?)\s*\)", 1)
    pts = F.split(body, r"\s*,\s*")

    def point(t):
        xy = F.split(t, r"\s+")
        return F.struct(xy[0].cast("double").alias("x"), xy[1].cast("double").alias("y"))

    return F.when(F.length(body) > 0, F.transform(pts, point))


def polygons_from_wkt(wkt) -> Column:
    """Polygons of a ``POLYGON`` or ``MULTIPOLYGON`` text, each an array of rings: the shell, then its holes."""
    text = F.trim(_col(wkt))
    body = F.regexp_replace(text, r"(?i)^(MULTI)?POLYGON\s*", "")

    def point(t):
        xy = F.split(F.trim(t), r"\s+")
        return F.struct(xy[0].cast("double").alias("x"), xy[1].cast("double").alias("y"))

    def rings(polygon):
        bare = F.regexp_replace(polygon, r"^[\s(]+|[\s)]+$", "")
        return F.transform(F.split(bare, r"\)\s*,\s*\("), lambda r: F.transform(F.split(r, ","), point))

    listed = F.transform(F.split(body, r"\)\s*\)\s*,\s*\(\s*\("), rings)
    return F.when(text.rlike(r"(?i)^(MULTI)?POLYGON\s*\(\s*\("), listed)


def polygons_area(polygons) -> Column:
    """Area of shells less that of their holes."""
    each = F.transform(_col(polygons), lambda rings: F.aggregate(
        F.transform(rings, lambda r, i: F.when(i == 0, ring_area(r)).otherwise(-ring_area(r))), F.lit(0.0), lambda s, v: s + v))
    return F.aggregate(each, F.lit(0.0), lambda s, v: s + v)


def ring_to_geojson(ring) -> Column:
    pts = F.transform(_col(ring), lambda p: F.array(p["x"], p["y"]))
    return F.to_json(F.struct(F.lit("Polygon").alias("type"), F.array(pts).alias("coordinates")))


def distance_band(dist, edges=(100.0, 200.0), labels=("100", "200", "300")) -> Column:
    """Band by upper edge, edges inclusive; whatever is beyond the last edge gets the last label."""
    out = None
    for edge, label in zip(edges, labels):
        out = F.when(_col(dist) <= edge, label) if out is None else out.when(_col(dist) <= edge, label)
    return out.otherwise(labels[len(edges)])
