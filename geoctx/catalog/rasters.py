"""Pixel-table operators."""

from __future__ import annotations

from pyspark.sql import functions as F

from geoctx import fixtures as fx
from geoctx.catalog.base import Catalog
from geoctx.fixtures import with_sql
from geoctx.functions import geo
from geoctx.operators import components, polygons, raster
from geoctx.session import spread

CATALOG = Catalog()
add = CATALOG.add


def rounded(df, *cols, digits=6):
    for c in cols:
        df = df.withColumn(c, F.round(c, digits))
    return df


# One wide raster: the 8 x 8 images side by side, 16 in a row.
MOSAIC = """mosaic AS (SELECT image_id, (image_id//16)*8+row AS row, (image_id%16)*8+col AS col, r, g, b, mask FROM grey)"""


def _mosaic(spark, d):
    k = F.col("image_id")
    return fx.grey_levels(spark, d).withColumn("row", F.floor(k / 16) * 8 + F.col("row")).withColumn("col", k % 16 * 8 + F.col("col"))


# Image sizes from customers, for the window grids.
SIZES = """size AS (SELECT c_custkey AS image_id, (300 + (c_custkey*37)%900)::BIGINT AS height, (310 + (c_custkey*53)%1100)::BIGINT AS width FROM customer)"""


def _sizes(spark, d):
    k = F.col("c_custkey")
    return fx.table(spark, d, "customer").select(
        k.alias("image_id"), (300 + k * 37 % 900).alias("height"), (310 + k * 53 % 1100).alias("width"))


H, W = 8, 8


# ---- tiles -------------------------------------------------------------------

TILES = MOSAIC + """, dims AS (SELECT max(row)+1 AS h, max(col)+1 AS w FROM mosaic),
    tile AS (SELECT row//6 AS ty, col//6 AS tx, avg((r < 24 OR g < 24 OR b < 24)::INT) AS bad, count(*) FILTER (r=0 AND g=0 AND b=0) AS black,
        any_value((row//6+1)*6 > h OR (col//6+1)*6 > w) AS cut, count(*) AS px FROM mosaic, dims GROUP BY ALL)"""


def _dims(spark, d):
    row = fx.table(spark, d, "embeddings").agg(F.max("vec_id").alias("m")).first()
    return (row.m // 16 + 1) * 8, 128


def _flagged(spark, d):
    """Dark pixels count as missing in these tiles."""
    dark = (F.col("r") < 24) | (F.col("g") < 24) | (F.col("b") < 24)
    return _mosaic(spark, d).withColumn("nd", F.when(dark, 0).otherwise(1))


@add("t1_plain_tiles", with_sql("grey", """
    SELECT row//6 AS ty, col//6 AS tx, (row%6) AS in_row, (col%6) AS in_col, r, g, b FROM mosaic, dims
    WHERE (row//6+1)*6 <= h AND (col//6+1)*6 <= w""", TILES))
def t1(spark, d):
    h, w = _dims(spark, d)
    return raster.with_tiles(_mosaic(spark, d), 6, h, w).select("ty", "tx", "in_row", "in_col", "r", "g", "b")


@add("t1_tile_numbers", with_sql("grey", """
    SELECT ty, tx, row_number() OVER (ORDER BY ty, tx) - 1 AS tile_no FROM tile WHERE NOT cut AND bad <= 0.3""", TILES))
def t1n(spark, d):
    h, w = _dims(spark, d)
    q = raster.tile_quality(raster.with_tiles(_flagged(spark, d), 6, h, w), ["ty", "tx"], ["nd"], 0)
    return raster.number_tiles(q.where(F.col("nodata_ratio") <= 0.3).select("ty", "tx"))


@add("p14_nodata_tiles", with_sql("grey", "SELECT ty, tx, round(bad, 6) AS nodata_ratio FROM tile WHERE NOT cut AND bad <= 0.3", TILES))
def p14(spark, d):
    h, w = _dims(spark, d)
    q = raster.tile_quality(raster.with_tiles(_flagged(spark, d), 6, h, w), ["ty", "tx"], ["nd"], 0)
    return rounded(q.where(F.col("nodata_ratio") <= 0.3), "nodata_ratio").drop("black")


@add("p15_black_or_empty_crops", with_sql("grey", """
    SELECT image_id FROM (SELECT image_id, count(*) FILTER (r//32=0 AND g//32=0 AND b//32=0) AS black, sum(mask) AS m FROM grey GROUP BY image_id)
    WHERE black = 0 AND m > 0"""))
def p15(spark, d):
    g = fx.grey_levels(spark, d)
    for c in "rgb":
        g = g.withColumn(c, F.floor(F.col(c) / 32))
    black = g.where((F.col("r") == 0) & (F.col("g") == 0) & (F.col("b") == 0)).select("image_id")
    masks = g.groupBy("image_id").agg(F.sum("mask").alias("m")).where(F.col("m") > 0).select("image_id")
    return masks.join(black, "image_id", "left_anti")


@add("a29_tile_counters", with_sql("grey", """
    SELECT CASE WHEN cut THEN 'skip_edge' WHEN bad > 0.3 THEN 'skip_nodata' ELSE 'save' END AS tile_status, count(*) AS n FROM tile GROUP BY 1""", TILES))
def a29(spark, d):
    h, w = _dims(spark, d)
    return raster.tile_counters(_flagged(spark, d), [], 6, h, w, ["nd"], 0, 0.3)


@add("s14_windowed_scan", with_sql("grey", """
    SELECT row//6 AS ty, col//6 AS tx, count(*) AS n, sum(r)::BIGINT AS r, sum(g)::BIGINT AS g, sum(b)::BIGINT AS b FROM mosaic, dims
    WHERE (row//6+1)*6 <= h AND (col//6+1)*6 <= w GROUP BY ALL""", TILES))
def s14(spark, d):
    h, w = _dims(spark, d)
    return raster.with_tiles(_mosaic(spark, d), 6, h, w).groupBy("ty", "tx").agg(
        F.count(F.lit(1)).alias("n"), *[F.sum(c).alias(c) for c in "rgb"])


@add("s15_bands_last", with_sql("grey", "SELECT image_id, row, col, r AS band_1, g AS band_2, b AS band_3 FROM grey"))
def s15(spark, d):
    g = fx.grey_levels(spark, d)
    long = g.select("image_id", "row", "col", F.explode(F.array(*[
        F.struct(F.lit(i).alias("band"), F.col(c).alias("value")) for i, c in ((1, "r"), (2, "g"), (3, "b"))])).alias("b"))
    wide = long.select("image_id", "row", "col", "b.*").groupBy("image_id", "row", "col").pivot("band", [1, 2, 3]).agg(F.first("value"))
    return wide.withColumnsRenamed({"1": "band_1", "2": "band_2", "3": "band_3"})


# ---- window grids --------------------------------------------------------------

def _grid(spark, d, rows, cols, size):
    return _sizes(spark, d).withColumn("y", F.explode(rows)).withColumn("x", F.explode(cols)).select("image_id", "y", "x")


@add("t2_sliding_windows", f"""
    WITH {SIZES}, r AS (SELECT image_id, height AS n, unnest(range(0, greatest(height,512), 312)) AS s FROM size),
    c AS (SELECT image_id, width AS n, unnest(range(0, greatest(width,512), 312)) AS s FROM size)
    SELECT r.image_id, least(r.s, greatest(r.n,512)-512) AS y, least(c.s, greatest(c.n,512)-512) AS x FROM r JOIN c USING (image_id)""")
def t2(spark, d):
    return _grid(spark, d, raster.sliding_starts("height", 512, 312), raster.sliding_starts("width", 512, 312), 512)


@add("t2_window_pixels", with_sql("grey", """
    WITH wy AS (SELECT unnest(range(0, 8, 3)) AS k), w AS (SELECT a.k//3 AS ky, b.k//3 AS kx, least(a.k, 3) AS y, least(b.k, 3) AS x FROM wy a, wy b)
    SELECT image_id, ky, kx, count(*) AS n, sum(r)::BIGINT AS r FROM grey JOIN w ON row >= y AND row < y+5 AND col >= x AND col < x+5 GROUP BY ALL"""))
def t2p(spark, d):
    g = fx.grey_levels(spark, d)
    cut = g.withColumn("ky", F.explode(raster.windows_of("row", H, 5, 3))).withColumn("kx", F.explode(raster.windows_of("col", W, 5, 3)))
    return cut.groupBy("image_id", "ky", "kx").agg(F.count(F.lit(1)).alias("n"), F.sum("r").alias("r"))


@add("t2_padded_pixels", with_sql("grey", """
    SELECT image_id, row, col, r, 0 AS padded FROM grey UNION ALL
    SELECT e.vec_id, (i//10)::INTEGER, (i%10)::INTEGER, 255, 1 FROM embeddings e, (SELECT unnest(range(100)) AS i) WHERE i//10 >= 8 OR i%10 >= 8"""))
def t2pad(spark, d):
    sizes = fx.table(spark, d, "embeddings").select(F.col("vec_id").alias("image_id"), F.lit(8).alias("height"), F.lit(8).alias("width"))
    g = fx.grey_levels(spark, d).withColumn("padded", F.lit(0))
    return raster.pad_small(g, sizes, 10, {"r": 255, "padded": 1})


_CLIP = """
    WITH {sizes}, ax AS (SELECT image_id, height AS n, 'y' AS a FROM size UNION ALL SELECT image_id, width, 'x' FROM size),
    b AS (SELECT image_id, a, n, unnest(range(0, ceil((n-256)/192)::BIGINT + 1)) AS k FROM ax)
    SELECT image_id, a AS axis, k, CASE WHEN k*{p}+256 > n THEN n-256 ELSE k*{p} END AS start, least(k*{p}+256, n) AS "end" FROM b"""


def _clips(spark, d, legacy):
    s = _sizes(spark, d)
    parts = []
    for axis, n in (("y", "height"), ("x", "width")):
        boxes = raster.clip_boxes(n, 256, 192, legacy)
        parts.append(s.select("image_id", F.lit(axis).alias("axis"), F.posexplode(boxes).alias("k", "b")))
    both = parts[0].unionByName(parts[1])
    return both.select("image_id", "axis", F.col("k").cast("long").alias("k"), "b.start", "b.end")


@add("t3_clip_grid", _CLIP.format(sizes=SIZES, p=192))
def t3(spark, d):
    return _clips(spark, d, False)


@add("t3_clip_grid_legacy", _CLIP.format(sizes=SIZES, p=256))
def t3l(spark, d):
    return _clips(spark, d, True)


@add("t4_inference_grid", f"""
    WITH {SIZES}, r AS (SELECT image_id, height AS n, unnest(range(0, height, 192)) AS s FROM size),
    t AS (SELECT image_id, s//192 AS k, CASE WHEN s+256 >= n THEN n-256 ELSE s END AS off, s+256 >= n AS last FROM r)
    SELECT image_id, k, off AS "offset", CASE WHEN off = 0 THEN 0 ELSE 32 END::BIGINT AS crop_off,
        CASE WHEN last THEN 256 WHEN off = 0 THEN 256 ELSE 224 END::BIGINT AS crop_size FROM t""")
def t4(spark, d):
    g = _sizes(spark, d).select("image_id", F.explode(raster.inference_grid("height", 256, 192)).alias("g"))
    return g.select("image_id", "g.*")


@add("t4_write_back", with_sql("image", """
    SELECT image_id, row, col, round(arg_max(v + 0.01*a.k - 0.02*b.k, a.k*10 + b.k), 6) AS score FROM image JOIN core a ON row >= a.low AND row < a.high
    JOIN core b ON col >= b.low AND col < b.high GROUP BY ALL""", """
    core AS (SELECT k, off + crop AS low, least(off + 5, off + crop + CASE WHEN k*3+5 >= 8 THEN 5 ELSE 5 - crop END) AS high
      FROM (SELECT k, least(k*3, 3) AS off, CASE WHEN k = 0 THEN 0 ELSE 1 END AS crop FROM (SELECT unnest([0, 1, 2]) AS k)))"""))
def t4_write_back(spark, d):
    """Scores of 5 x 5 windows at stride 3, on both axes, merged from the windows' cores."""
    def held(pos):
        return F.filter(raster.inference_grid(F.lit(8), 5, 3), lambda g: (g["offset"] <= F.col(pos)) & (F.col(pos) < g["offset"] + 5))

    s = fx.images(spark, d).withColumn("gy", F.explode(held("row"))).withColumn("gx", F.explode(held("col")))
    s = s.withColumn("score", F.col("v") + 0.01 * F.col("gy.k") - 0.02 * F.col("gx.k"))
    return rounded(raster.write_back(s, ["image_id"]), "score")


@add("t5_covering_grid", f"""
    WITH {SIZES}, r AS (SELECT image_id, height AS n, unnest(range(0, greatest(height-512+341-1,0)//341+1)) AS k FROM size),
    c AS (SELECT image_id, width AS n, unnest(range(0, greatest(width-512+341-1,0)//341+1)) AS k FROM size)
    SELECT r.image_id, greatest(least(r.k*341+512, r.n)-512, 0) AS y, greatest(least(c.k*341+512, c.n)-512, 0) AS x FROM r JOIN c USING (image_id)""")
def t5(spark, d):
    return _grid(spark, d, raster.covering_starts("height", 512, 341), raster.covering_starts("width", 512, 341), 512)


@add("t6_centred_crop", with_sql("building", """
    SELECT build_id, least(greatest(trunc(floor(10000-(miny+maxy)/2) - 512)::BIGINT, 0), 10100-1024) AS row_off,
        least(greatest(trunc(floor((minx+maxx)/2) - 512)::BIGINT, 0), 10100-1024) AS col_off FROM building"""))
def t6(spark, d):
    cx, cy = (F.col("minx") + F.col("maxx")) / 2, (F.col("miny") + F.col("maxy")) / 2
    row, col = geo.map_to_pixel(cx, cy, (1.0, 0.0, 0.0, 0.0, -1.0, 10000.0))
    t = fx.buildings(spark, d).select("build_id", row.alias("row"), col.alias("col"))
    return raster.centred_crop(t, "row", "col", 1024, 10100, 10100).select("build_id", "row_off", "col_off")


# ---- merging -------------------------------------------------------------------

@add("a19_merge_max", with_sql("grey", """
    SELECT (image_id//16)*6+row AS row, (image_id%16)*6+col AS col, max(r) AS r FROM grey GROUP BY ALL"""))
def a19(spark, d):
    k = F.col("image_id")
    return raster.merge_max(fx.grey_levels(spark, d), [], "r", F.floor(k / 16) * 6 + 0.2, k % 16 * 6 - 0.2)


WINDOW_SCORES = """wy AS (SELECT unnest([0,1,2]) AS k), win AS (SELECT a.k AS ky, b.k AS kx, least(a.k*2, 3) AS y, least(b.k*2, 3) AS x FROM wy a, wy b)"""


@add("a20_average_window_scores", with_sql("image", """
    SELECT image_id, row, col, round(avg(v + 0.01*ky - 0.02*kx), 6) AS score FROM image JOIN win ON row >= y AND row < y+5 AND col >= x AND col < x+5
    GROUP BY ALL""", WINDOW_SCORES))
def a20(spark, d):
    im = fx.images(spark, d)
    s = im.withColumn("ky", F.explode(raster.covering_windows_of("row", H, 5, 2))).withColumn(
        "kx", F.explode(raster.covering_windows_of("col", W, 5, 2)))
    s = s.withColumn("score", F.col("v") + 0.01 * F.col("ky") - 0.02 * F.col("kx"))
    return rounded(raster.average_scores(s, ["image_id", "row", "col"]), "score")


# ---- neighbourhoods ----------------------------------------------------------------

GROWN = """nb AS (SELECT unnest([-1,0,1]) AS o), fg AS (SELECT image_id, row, col FROM image WHERE v > 0.08),
    dil AS (SELECT DISTINCT image_id, row+a.o AS row, col+b.o AS col FROM fg, nb a, nb b WHERE row+a.o BETWEEN 0 AND 7 AND col+b.o BETWEEN 0 AND 7)"""


def _foreground(spark, d):
    return fx.images(spark, d).where(F.col("v") > 0.08).select("image_id", "row", "col")


@add("t7_closing", with_sql("image", """
    SELECT i.image_id, i.row, i.col FROM image i JOIN dil d ON d.image_id = i.image_id AND d.row BETWEEN i.row-1 AND i.row+1 AND d.col BETWEEN i.col-1 AND i.col+1
    GROUP BY ALL HAVING count(*) = (least(i.row+1,7)-greatest(i.row-1,0)+1)*(least(i.col+1,7)-greatest(i.col-1,0)+1)""", GROWN))
def t7(spark, d):
    return raster.closing(_foreground(spark, d), ["image_id"], H, W)


EDGES = """e AS (SELECT DISTINCT a.image_id, a.row, a.col FROM seg a JOIN seg b ON a.image_id = b.image_id
    AND ((b.row = a.row-1 AND b.col = a.col) OR (b.row = a.row AND b.col = a.col+1) OR (b.row = a.row+1 AND b.col = a.col+1) OR (b.row = a.row+1 AND b.col = a.col-1))
    WHERE a.gt <> b.gt AND a.gt <> 255 AND b.gt <> 255)"""


@add("j13_edges", with_sql("seg", "SELECT image_id, row, col FROM e", EDGES))
def j13(spark, d):
    return raster.edges(fx.seg_pixels(spark, d), "image_id", "gt")


@add("t15_dilated_edges", with_sql("seg", """
    SELECT DISTINCT image_id, row+a.o AS row, col+b.o AS col FROM e, (SELECT unnest([-1,0,1]) AS o) a, (SELECT unnest([-1,0,1]) AS o) b
    WHERE row+a.o BETWEEN 0 AND 7 AND col+b.o BETWEEN 0 AND 7""", EDGES))
def t15(spark, d):
    return raster.dilated_edges(fx.seg_pixels(spark, d), "image_id", "gt", H, W, 3)


# ---- components and outlines ---------------------------------------------------------

def comp_sql(diagonal: bool) -> str:
    near = "abs(a.row-b.row) <= 1 AND abs(a.col-b.col) <= 1" if diagonal else "abs(a.row-b.row) + abs(a.col-b.col) = 1"
    return f"""fg AS (SELECT image_id, row, col, row*16777216::BIGINT+col AS id FROM image WHERE v > 0.08),
    RECURSIVE reach AS (SELECT image_id, id, id AS other FROM fg UNION
        SELECT r.image_id, r.id, b.id FROM reach r JOIN fg a ON a.image_id=r.image_id AND a.id=r.other JOIN fg b ON b.image_id=a.image_id AND {near}),
    comp AS (SELECT fg.image_id, fg.row, fg.col, c.component FROM fg JOIN (SELECT image_id, id, min(other) AS component FROM reach GROUP BY ALL) c
        ON c.image_id=fg.image_id AND c.id=fg.id)"""


def _components(spark, d, diagonal):
    return components.label_components(_foreground(spark, d), "image_id", tile=4, diagonal=diagonal)


@add("t8_components_4", with_sql("image", "SELECT image_id, row, col, component FROM comp", comp_sql(False)))
def t8(spark, d):
    return _components(spark, d, False)


@add("t8_components_8", with_sql("image", "SELECT image_id, row, col, component FROM comp", comp_sql(True)))
def t8d(spark, d):
    return _components(spark, d, True)


@add("a24_component_stats", with_sql("image", """
    SELECT image_id, component, count(*) AS area, round(avg(row),6) AS row, round(avg(col),6) AS col FROM comp GROUP BY ALL""", comp_sql(True)))
def a24(spark, d):
    return rounded(components.component_stats(_components(spark, d, True)), "row", "col")


@add("t9_outlines", with_sql("image", """
    SELECT p.image_id, p.component, p.area, q.corners FROM (SELECT image_id, component, count(*)::DOUBLE AS area FROM comp GROUP BY ALL) p
    JOIN (SELECT image_id, component, (sum(CASE WHEN n IN (1,3) THEN 1 WHEN n=2 AND diag THEN 2 ELSE 0 END))::BIGINT AS corners FROM (
        SELECT image_id, component, vr, vc, count(*) AS n, min(kind) = max(kind) AS diag FROM (
          SELECT image_id, component, row+i AS vr, col+j AS vc, (i+j)%2 AS kind FROM comp, (SELECT unnest([0,1]) AS i) , (SELECT unnest([0,1]) AS j)) GROUP BY ALL) GROUP BY ALL) q
    USING (image_id, component)""", comp_sql(False)))
def t9(spark, d):
    """Signed area of all rings (holes negative) and number of corners per component."""
    rings = polygons.rings_of(polygons.outlines(_components(spark, d, False)), "image_id", (1.0, 0.0, 0.0, 0.0, -1.0, 8.0))
    return rings.groupBy("image_id", "component").agg(
        F.sum(-geo.ring_signed_area("outline")).alias("area"), F.sum(F.size("outline") - 1).alias("corners"))


@add("t9_polygons", with_sql("image", """
    SELECT image_id, component, row_number() OVER (ORDER BY image_id, component) AS build_id, area, holes, vertices FROM (
      SELECT image_id, component, (1 - sum(CASE WHEN n = 1 THEN 1 WHEN n = 3 THEN -1 WHEN n = 2 AND diag THEN 2 ELSE 0 END) / 4)::INTEGER AS holes,
        string_agg(vc || ' ' || (8 - vr), ',' ORDER BY vr, vc) FILTER (n IN (1,3) OR n = 2 AND diag) AS vertices FROM (
          SELECT image_id, component, vr, vc, count(*) AS n, min(kind) = max(kind) AS diag FROM (
            SELECT image_id, component, row+i AS vr, col+j AS vc, (i+j)%2 AS kind FROM comp, (SELECT unnest([0,1]) AS i), (SELECT unnest([0,1]) AS j)) GROUP BY ALL) GROUP BY ALL)
    JOIN (SELECT image_id, component, count(*)::DOUBLE AS area FROM comp GROUP BY ALL) USING (image_id, component)""", comp_sql(False)))
def t9_polygons(spark, d):
    """A numbered polygon per component: area without its holes, their number, and the different vertices by row and column."""
    rings = polygons.rings_of(polygons.outlines(_components(spark, d, False)), "image_id", (1.0, 0.0, 0.0, 0.0, -1.0, 8.0))
    found = polygons.nested(rings, "image_id")
    area = F.aggregate(F.transform("polygon", lambda r: -geo.ring_signed_area(r)), F.lit(0.0), lambda s, v: s + v)
    points = F.array_sort(F.array_distinct(F.transform(F.flatten("polygon"), lambda p: F.struct((8 - p["y"]).cast("long").alias("r"), p["x"].cast("long").alias("c")))))
    names = F.transform(points, lambda p: F.concat_ws(" ", p["c"], 8 - p["r"]))
    return found.select("image_id", "component", "build_id", area.alias("area"), (F.size("polygon") - 1).alias("holes"), F.array_join(names, ",").alias("vertices"))


AFFINE = (4.0, 0.0, 0.0, 0.0, -4.0, 10040.0)


@add("t10_rasterise", with_sql("building", """
    SELECT build_id, r AS row, c AS col FROM (SELECT *, unnest(range(floor((10040-maxy)/4)::BIGINT, floor((10040-miny)/4)::BIGINT+1)) AS r FROM building) b,
        LATERAL (SELECT unnest(range(floor(b.minx/4)::BIGINT, floor(b.maxx/4)::BIGINT+1)) AS c)
    WHERE (c+0.5)*4 >= minx AND (c+0.5)*4 < maxx AND 10040-(r+0.5)*4 >= miny AND 10040-(r+0.5)*4 < maxy AND r < 2510 AND c < 2510"""))
def t10(spark, d):
    b = spread(fx.buildings(spark, d), "build_id").withColumn("ring", geo.ring_of_rect("minx", "miny", "maxx", "maxy"))
    return polygons.burn(b, "build_id", AFFINE, 2510, 2510)


@add("t10_rasterise_holes", with_sql("building", """
    SELECT build_id, r AS row, min(c) AS c0, max(c) AS c1 FROM (
      SELECT build_id, r, c, c - row_number() OVER (PARTITION BY build_id, r ORDER BY c) AS run FROM (
        SELECT *, (c+0.5)*4 AS x, 10040-(r+0.5)*4 AS y FROM (SELECT *, unnest(range(floor((10040-maxy)/4)::BIGINT, floor((10040-miny)/4)::BIGINT+1)) AS r FROM building) b,
          LATERAL (SELECT unnest(range(floor(b.minx/4)::BIGINT, floor((2*b.maxx-b.minx+3)/4)::BIGINT+1)) AS c))
      WHERE r < 2510 AND c < 2510 AND y >= miny AND y < maxy AND (
        (x >= minx AND x < maxx AND NOT (x >= minx+4 AND x < maxx-4 AND y >= miny+4 AND y < maxy-4)) OR (x >= maxx+3 AND x < 2*maxx-minx+3)))
    GROUP BY build_id, r, run"""))
def t10_holes(spark, d):
    """Footprints with a courtyard and a second part to the east, as runs of pixels."""
    b = fx.buildings(spark, d)
    m = {c: F.col(c) for c in ("minx", "miny", "maxx", "maxy")}
    shell = geo.ring_of_rect(*m.values())
    yard = F.reverse(geo.ring_of_rect(m["minx"] + 4, m["miny"] + 4, m["maxx"] - 4, m["maxy"] - 4))
    east = geo.ring_of_rect(m["maxx"] + 3, m["miny"], 2 * m["maxx"] - m["minx"] + 3, m["maxy"])
    features = b.select("build_id", F.array(F.array(shell, yard), F.array(east)).alias("p"))
    return polygons.burn_spans(features, "build_id", AFFINE, 2510, 2510, None, "p")


# ---- values --------------------------------------------------------------------

@add("t11_palette", with_sql("grey", """
    SELECT image_id, row, col, CASE r//128*4+g//128*2+b//128 WHEN 0 THEN 0 WHEN 7 THEN 1 WHEN 4 THEN 2 WHEN 6 THEN 3 WHEN 2 THEN 4 WHEN 3 THEN 5
        WHEN 1 THEN 6 ELSE 0 END AS cls FROM grey"""))
def t11(spark, d):
    g = fx.grey_levels(spark, d)
    for c in "rgb":
        g = g.withColumn(c, (F.floor(F.col(c) / 128) * 255).cast("int"))
    palette = spark.createDataFrame([(*c, i) for i, c in enumerate(raster.PALETTE)], "r int, g int, b int, cls int")
    return raster.colour_classes(g, palette).select("image_id", "row", "col", "cls")


@add("t12_reduce_zero_label", with_sql("grey", """
    SELECT image_id, row, col, CASE z WHEN 3 THEN 103 ELSE z END AS cls FROM (SELECT *, CASE r%6 WHEN 0 THEN 255 ELSE r%6-1 END AS z FROM grey)"""))
def t12(spark, d):
    z = raster.reduce_zero_label(F.col("r") % 6)
    return fx.grey_levels(spark, d).select("image_id", "row", "col", raster.remap(z, {3: 103}).alias("cls"))


@add("t13_value_remaps", with_sql("grey", """
    SELECT image_id, row, col, (r//128)::BIGINT AS halved, CASE g%12 WHEN 8 THEN 1 WHEN 4 THEN 2 WHEN 3 THEN 3 WHEN 2 THEN 4 WHEN 6 THEN 5 WHEN 11 THEN 6
        WHEN 1 THEN 7 WHEN 7 THEN 8 ELSE 0 END AS organ, CASE b%3 WHEN 0 THEN 1 WHEN 1 THEN 2 ELSE 0 END AS disc FROM grey"""))
def t13(spark, d):
    organs = raster.remap(F.col("g") % 12, raster.ORGAN_IDS, 0)
    disc = raster.remap(F.element_at(F.array(F.lit(0), F.lit(128), F.lit(255)), F.col("b") % 3 + 1), raster.DISC_IDS)
    return fx.grey_levels(spark, d).select("image_id", "row", "col", F.floor(F.col("r") / 128).alias("halved"),
                                           organs.alias("organ"), disc.alias("disc"))


@add("t14_volume_slices", with_sql("image", """
    SELECT image_id, (i//16)::BIGINT AS slice, (i%16)::INTEGER AS pos, round((least(greatest(v*2000,-125),275)+125)/400*255, 4) AS value FROM image"""))
def t14(spark, d):
    t = fx.images(spark, d).select("image_id", F.floor(F.col("i") / 16).alias("slice"), (F.col("i") % 16).alias("pos"),
                                   raster.rescale_slice(F.col("v") * 2000).alias("value"))
    return rounded(t, "value", digits=4)


@add("t16_grey_rerange", with_sql("grey", """
    SELECT image_id, row, col, round((y-min(y) OVER w)/nullif(max(y) OVER w-min(y) OVER w,0)*255, 4) AS value
    FROM (SELECT *, r*0.299::DOUBLE+g*0.587::DOUBLE+b*0.114::DOUBLE AS y FROM grey) WINDOW w AS (PARTITION BY image_id)"""))
def t16(spark, d):
    g = fx.grey_levels(spark, d).select("image_id", "row", "col", raster.grey().alias("value"))
    return rounded(raster.rerange(g, "image_id", "value"), "value", digits=4)


@add("t17_balanced_crops", with_sql("seg", """
    WITH wy AS (SELECT unnest([0,1,2]) AS k), w AS (SELECT a.k AS ky, b.k AS kx, least(a.k*3,3) AS y, least(b.k*3,3) AS x FROM wy a, wy b),
    t AS (SELECT image_id, ky, kx, gt, count(*) AS n FROM seg JOIN w ON row >= y AND row < y+5 AND col >= x AND col < x+5 WHERE gt <> 255 GROUP BY ALL)
    SELECT image_id, ky::BIGINT AS ky, kx::BIGINT AS kx, count(*) AS classes, round(max(n)/sum(n), 6) AS top_share FROM t GROUP BY image_id, ky, kx HAVING count(*) > 1 AND max(n)/sum(n) < 0.75"""))
def t17(spark, d):
    s = fx.seg_pixels(spark, d).withColumn("ky", F.explode(raster.windows_of("row", H, 5, 3))).withColumn(
        "kx", F.explode(raster.windows_of("col", W, 5, 3)))
    return rounded(raster.balanced_crops(s, ["image_id", "ky", "kx"], "gt"), "top_share")


BBOX = """bb AS (SELECT image_id, coalesce(min(col) FILTER (v > 0.15), 0) AS x1, coalesce(min(row) FILTER (v > 0.15), 0) AS y1,
    coalesce(max(col) FILTER (v > 0.15), 8) AS x2, coalesce(max(row) FILTER (v > 0.15), 8) AS y2 FROM image GROUP BY image_id)"""


def _bbox(spark, d):
    im = fx.images(spark, d).withColumn("m", (F.col("v") > 0.15).cast("int"))
    return raster.mask_bbox(im, "image_id", "m", H, W)


@add("a23_mask_bbox", with_sql("image", "SELECT image_id, x1, y1, x2, y2 FROM bb", BBOX))
def a23(spark, d):
    return _bbox(spark, d)


@add("t18_square_box", with_sql("image", """
    SELECT image_id, greatest(0, round_even(cx-half, 0)::INTEGER) AS "left", greatest(0, round_even(cy-half, 0)::INTEGER) AS upper,
        least(8, round_even(cx+half, 0)::INTEGER) AS "right", least(8, round_even(cy+half, 0)::INTEGER) AS lower
    FROM (SELECT image_id, (x1+x2+1)/2 AS cx, (y1+y2+1)/2 AS cy, greatest(x2+1-x1, y2+1-y1)*1.6::DOUBLE/2 AS half FROM bb)""", BBOX))
def t18(spark, d):
    return raster.square_box(_bbox(spark, d), H, W).select("image_id", "left", "upper", "right", "lower")


@add("t18_grown_box", with_sql("image", """
    SELECT image_id, greatest(0, x1-floor((x2-x1)*0.15::DOUBLE)::BIGINT) AS "left", greatest(0, y1-floor((y2-y1)*0.15::DOUBLE)::BIGINT) AS upper,
        least(8, x2+floor((x2-x1)*0.15::DOUBLE)::BIGINT) AS "right", least(8, y2+floor((y2-y1)*0.15::DOUBLE)::BIGINT) AS lower FROM bb""", BBOX))
def t18g(spark, d):
    return raster.grown_box(_bbox(spark, d), H, W).select("image_id", "left", "upper", "right", "lower")


@add("t19_function_map", with_sql("seg score", """
    WITH top AS (SELECT sample_id, list_position(logits, list_max(logits)) AS one_based FROM score)
    SELECT image_id, row, col, (CASE WHEN pred = 1 THEN one_based ELSE 0 END)::INTEGER AS value FROM seg JOIN top ON image_id = sample_id"""))
def t19(spark, d):
    cls = fx.scores(spark, d).select(F.col("sample_id").alias("image_id"), (F.array_position("logits", F.array_max("logits")) - 1).alias("cls"))
    px = fx.seg_pixels(spark, d).select("image_id", "row", "col", "pred")
    return px.join(cls, "image_id").select("image_id", "row", "col", raster.function_map("pred", "cls").alias("value"))


@add("t20_undo_padding_and_flip", with_sql("image", """
    SELECT image_id, CASE image_id%3 WHEN 1 THEN 5-(row-1) ELSE row-1 END AS row, CASE image_id%3 WHEN 2 THEN 4-(col-2) ELSE col-2 END AS col,
        CASE WHEN v >= 0.02 THEN 0 ELSE 1 END AS pred FROM image WHERE row-1 BETWEEN 0 AND 5 AND col-2 BETWEEN 0 AND 4"""))
def t20(spark, d):
    """Two scores per pixel, v and 0.04 - v; images are padded (2, 1, 1, 1) and flipped by id."""
    k = F.col("image_id") % 3
    flip = F.when(k == 1, "vertical").when(k == 2, "horizontal").otherwise("none")
    im = fx.images(spark, d).withColumn("s", F.explode(F.array(
        F.struct(F.lit(0).alias("cls"), F.col("v").alias("score")), F.struct(F.lit(1).alias("cls"), (0.04 - F.col("v")).alias("score")))))
    scores = im.select("image_id", "row", "col", "s.cls", "s.score")
    back = raster.unpad_unflip(scores, (2, 1, 1, 1), flip, H, W)
    return raster.best_class(back, ["image_id", "row", "col"])


# ---- features -------------------------------------------------------------------

@add("a21_colour_histogram", with_sql("grey", """
    WITH c AS (SELECT image_id, 'b' AS ch, b AS v FROM grey WHERE mask=1 UNION ALL SELECT image_id, 'g', g FROM grey WHERE mask=1 UNION ALL SELECT image_id, 'r', r FROM grey WHERE mask=1),
    n AS (SELECT image_id, sum(mask) AS total FROM grey GROUP BY image_id), k AS (SELECT unnest(range(48)) AS i)
    SELECT n.image_id, k.i::INTEGER AS pos, round(count(v)/(any_value(total)+1e-6), 6) AS share FROM n CROSS JOIN k
    LEFT JOIN c ON c.image_id = n.image_id AND ch = ['b','g','r'][k.i//16+1] AND v//16 = k.i%16 GROUP BY n.image_id, k.i"""))
def a21(spark, d):
    h = raster.colour_histogram(fx.grey_levels(spark, d), "image_id", "mask")
    return rounded(h.select("image_id", F.posexplode("hist").alias("pos", "share")), "share")


@add("a22_texture", with_sql("grey", """
    WITH lv AS (SELECT image_id, row, col, round(round(r*0.299::DOUBLE+g*0.587::DOUBLE+b*0.114::DOUBLE)*(254.0::DOUBLE/255.0::DOUBLE)+1)::INTEGER AS i FROM grey WHERE mask=1),
    off AS (SELECT 0 AS angle, 0 AS dr, 1 AS dc UNION ALL SELECT 1,1,1 UNION ALL SELECT 2,1,0 UNION ALL SELECT 3,1,-1),
    pr AS (SELECT a.image_id, angle, a.i AS i, b.i AS j FROM lv a, off, lv b WHERE b.image_id=a.image_id AND b.row=a.row+dr AND b.col=a.col+dc),
    sy AS (SELECT image_id, angle, i, j FROM pr UNION ALL SELECT image_id, angle, j, i FROM pr),
    c AS (SELECT image_id, angle, i, j, count(*) / sum(count(*)) OVER (PARTITION BY image_id, angle) AS p FROM sy GROUP BY image_id, angle, i, j),
    mu AS (SELECT image_id, angle, sum(p*i) AS mi FROM c GROUP BY ALL)
    SELECT image_id, angle, round(sum(p*(i-j)*(i-j)),4) AS contrast, round(sum(p/(1+(i-j)*(i-j))),6) AS homogeneity, round(sqrt(sum(p*p)),6) AS energy,
        round(CASE WHEN sum(p*(i-mi)*(i-mi)) <= 1e-9 THEN 1 ELSE sum(p*(i-mi)*(j-mi))/sum(p*(i-mi)*(i-mi)) END, 5) AS correlation FROM c JOIN mu USING (image_id, angle) GROUP BY image_id, angle"""))
def a22(spark, d):
    lv = fx.grey_levels(spark, d).select("image_id", "row", "col", raster.grey_level().alias("level"))
    t = raster.texture(raster.cooccurrence(lv, "image_id", "level"), "image_id")
    return rounded(rounded(rounded(t, "homogeneity", "energy"), "contrast", digits=4), "correlation", digits=5)


@add("t21_gradient_histogram", with_sql("grey", """
    WITH y AS (SELECT image_id, row, col, r*0.299::DOUBLE+g*0.587::DOUBLE+b*0.114::DOUBLE AS v FROM grey),
    gr AS (SELECT a.image_id, a.row, a.col, coalesce(d.v - u.v, 0) AS gy, coalesce(e.v - w.v, 0) AS gx FROM y a
        LEFT JOIN y u ON u.image_id=a.image_id AND u.row=a.row-1 AND u.col=a.col LEFT JOIN y d ON d.image_id=a.image_id AND d.row=a.row+1 AND d.col=a.col
        LEFT JOIN y w ON w.image_id=a.image_id AND w.row=a.row AND w.col=a.col-1 LEFT JOIN y e ON e.image_id=a.image_id AND e.row=a.row AND e.col=a.col+1),
    an AS (SELECT *, degrees(atan2(gy, gx)) AS dg, sqrt(gy*gy+gx*gx) AS m FROM gr),
    hi AS (SELECT image_id, row//2 AS cy, col//2 AS cx, least(floor((CASE WHEN dg < 0 THEN dg+180 WHEN dg >= 180 THEN dg-180 ELSE dg END)/20), 8)::INTEGER AS bin, sum(m)/4 AS h FROM an GROUP BY ALL),
    k AS (SELECT image_id, i//108 AS "by", (i//36)%3 AS bx, i%36 AS pos FROM (SELECT DISTINCT image_id FROM grey), (SELECT unnest(range(324))::INTEGER AS i)),
    f AS (SELECT k.*, coalesce(h, 0) AS h FROM k LEFT JOIN hi ON hi.image_id=k.image_id AND cy = k."by" + (pos//18) AND cx = bx + (pos//9)%2 AND bin = pos%9),
    c AS (SELECT *, least(h/sqrt(sum(h*h) OVER (PARTITION BY image_id, "by", bx)+1e-10), 0.2) AS q FROM f)
    SELECT image_id, "by", bx, pos, round(q/sqrt(sum(q*q) OVER (PARTITION BY image_id, "by", bx)+1e-10), 5) AS x FROM c"""))
def t21(spark, d):
    g = fx.grey_levels(spark, d).select("image_id", "row", "col", raster.grey().alias("v"))
    h = raster.gradient_histogram(g, "image_id", "v", H, W, cell=2)
    return h.select("image_id", "by", "bx", F.posexplode("hog").alias("pos", "x")).withColumn("x", F.round("x", 5))


@add("s21_class_mask_export", with_sql("seg", "SELECT image_id, row, col, pred + 1 AS value FROM seg"))
def s21(spark, d):
    """Masks written, clustered by image, and read back."""
    from geoctx.session import scratch_path
    from geoctx.sources.sinks import write_class_masks

    path = scratch_path(spark, "s21")
    write_class_masks(fx.seg_pixels(spark, d), path, reduce_zero_label=True)
    return spark.read.parquet(path)


@add("s22_box_export", with_sql("image", """
    SELECT image_id, '{"type":"Polygon","coordinates":[[' || array_to_string(list_transform([[x1,8-y2],[x2,8-y2],[x2,8-y1],[x1,8-y1],[x1,8-y2]],
        lambda p: '[' || p[1] || '.0,' || p[2] || '.0]'), ',') || ']]}' AS geometry, CASE WHEN image_id%2=0 THEN 'res' ELSE 'pub' END AS class_name FROM bb""", BBOX))
def s22(spark, d):
    from geoctx.sources.sinks import box_features

    boxes = _bbox(spark, d).withColumn("class_id", (F.col("image_id") % 2).cast("int"))
    return box_features(boxes, ["res", "pub"], (1.0, 0.0, 0.0, 0.0, -1.0, 8.0)).select("image_id", "geometry", "class_name")
