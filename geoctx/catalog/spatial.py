"""Spatial joins, coordinate expressions, label transfer, context prompts."""

from __future__ import annotations

from pyspark.sql import functions as F

from geoctx import fixtures as fx
from geoctx.catalog.base import Catalog
from geoctx.fixtures import with_sql
from geoctx.functions import geo, text
from geoctx.operators import context, lookup, overlay, polygons, ranking, transfer
from geoctx.operators.spatial_join import Best, bbox_join, nearest_k, radius_join
from geoctx.plans.context_corpus import context_prompts

CATALOG = Catalog()
add = CATALOG.add


def six(c):
    return F.round(c, 6)


# ---- SQL shared by the checks ------------------------------------------------

NEAR = """near AS (SELECT build_id, poi_id, type_en, p.x AS px, p.y AS py,
    sqrt((b.x-p.x)*(b.x-p.x)+(b.y-p.y)*(b.y-p.y)) AS dist
    FROM center b JOIN poi p ON p.x BETWEEN b.x-300 AND b.x+300 AND p.y BETWEEN b.y-300 AND b.y+300
    WHERE (b.x-p.x)*(b.x-p.x)+(b.y-p.y)*(b.y-p.y) <= 90000)"""


def top_sql(k: int) -> str:
    return f"""{NEAR}, top AS (SELECT *, CASE WHEN dist <= 100 THEN '100' WHEN dist <= 200 THEN '200' ELSE '300' END AS band
    FROM (SELECT *, row_number() OVER (PARTITION BY build_id ORDER BY dist, poi_id) AS rk FROM near) WHERE rk <= {k})"""


def _words_sql(words) -> str:
    def ladder(i):
        arms = "".join(f" WHEN n <= {w[0]} THEN '{w[i]}'" for w in words if w[0] is not None)
        return f"CASE{arms} ELSE '{words[-1][i]}' END"

    return f"CASE WHEN band = '100' THEN {ladder(1)} ELSE {ladder(2)} END"


def prompt_sql(words, k: int = 100) -> str:
    return f"""{top_sql(k)},
    tc AS (SELECT build_id, band, type_en, count(*) AS cnt, min(rk) AS fr FROM top GROUP BY ALL),
    bp AS (SELECT build_id, band, sum(cnt)::BIGINT AS n, max(cnt) AS mx,
        (list(type_en ORDER BY cnt DESC, fr))[1:5] AS l FROM tc GROUP BY ALL),
    enum AS (SELECT *, l[2:] AS r, CASE band WHEN '100' THEN 'immediate surroundings' WHEN '200' THEN 'nearby area'
        ELSE 'outer area' END AS lab, {_words_sql(words)} AS dens,
        CASE len(l) WHEN 1 THEN l[1] WHEN 2 THEN l[1]||' and '||l[2]
          ELSE array_to_string(l[1:len(l)-1], ', ')||', and '||l[len(l)] END AS all_types FROM bp),
    clause AS (SELECT build_id, band, n, 'the '||lab||' '||dens||' '||CASE
        WHEN n <= 3 THEN all_types
        WHEN mx/n >= 0.6 THEN 'primarily '||l[1]||CASE len(r) WHEN 0 THEN '' WHEN 1 THEN ' alongside some '||r[1]
            WHEN 2 THEN ' alongside some '||r[1]||' and '||r[2]
            ELSE ' alongside some '||array_to_string(r[1:len(r)-1], ', ')||', and '||r[len(r)] END
        WHEN mx/n >= 0.3 THEN 'a mix of '||all_types ELSE 'a diverse range of '||all_types END AS t FROM enum),
    prompt AS (SELECT build_id, sum(n)::BIGINT AS n_poi, 'Urban building context: '
        || coalesce(max(t) FILTER (band='100'), 'the immediate surroundings is empty') || '; '
        || coalesce(max(t) FILTER (band='200'), 'the nearby area is empty') || '; '
        || coalesce(max(t) FILTER (band='300'), 'the outer area is empty') || '.' AS prompt
        FROM clause GROUP BY build_id HAVING sum(n) >= 3)"""


PAIRS = """pair AS (SELECT build_id, cand_id, func, iou, overlap, cdist, aratio, round(.65*iou+.15*overlap+.1*aratio+.1*exp(-cdist/20), 6) AS score FROM (
    SELECT build_id, cand_id, func, inter/aa AS overlap, CASE WHEN aa+ab-inter > 0 THEN inter/(aa+ab-inter) ELSE 0 END AS iou,
      sqrt(pow((a0+a2)/2-(b0+b2)/2,2)+pow((a1+a3)/2-(b1+b3)/2,2)) AS cdist, least(aa,ab)/greatest(aa,ab) AS aratio FROM (
    SELECT a.build_id, b.cand_id, b.func, a.minx a0, a.miny a1, a.maxx a2, a.maxy a3, b.minx b0, b.miny b1, b.maxx b2, b.maxy b3,
      greatest(least(a.maxx,b.maxx)-greatest(a.minx,b.minx),0)*greatest(least(a.maxy,b.maxy)-greatest(a.miny,b.miny),0) AS inter,
      (a.maxx-a.minx)*(a.maxy-a.miny) AS aa, (b.maxx-b.minx)*(b.maxy-b.miny) AS ab
    FROM building a JOIN candidate b ON a.minx<=b.maxx AND b.minx<=a.maxx AND a.miny<=b.maxy AND b.miny<=a.maxy)))"""


def _top(spark, d, k):
    pairs = nearest_k(fx.centers(spark, d).select("build_id", "x", "y"), fx.pois(spark, d), 300.0, k)
    return context.with_bands(pairs.select("build_id", "poi_id", "rk", "dist", "type_en"))


def _lists(spark, d, k):
    """The rows of ``_top`` as a list per building."""
    lists = nearest_k(fx.centers(spark, d).select("build_id", "x", "y"), fx.pois(spark, d), 300.0, k, lists=["type_en"])
    return context.with_bands(lists)


def _counts(spark, d):
    """How many points lie around a building, with those behind the k nearest."""
    points = fx.pois(spark, d).select("poi_id", "x", "y")
    near = radius_join(fx.centers(spark, d).select("build_id", "x", "y"), points, 300.0, Best((), 1, "poi_id"))
    return near.groupBy("build_id").agg(F.sum("_count").alias("n_poi"))


def _scored(spark, d):
    cols = ("minx", "miny", "maxx", "maxy")
    a = fx.buildings(spark, d).select("build_id", *[F.col(c).alias("a_" + c) for c in cols])
    b = fx.candidates(spark, d).select("cand_id", "func", *[F.col(c).alias("b_" + c) for c in cols])
    return transfer.score_rectangles(bbox_join(a, b, 60.0))


# ---- joins -------------------------------------------------------------------

@add("j3_overlap_join", with_sql("candidate", "SELECT build_id, cand_id, func, score FROM pair", PAIRS))
def j3(spark, d):
    return _scored(spark, d).select("build_id", "cand_id", "func", "score")


@add("j4_radius_join", with_sql("center poi", "SELECT build_id, poi_id, round(dist, 6) AS dist FROM near", NEAR))
def j4(spark, d):
    pairs = radius_join(fx.centers(spark, d).select("build_id", "x", "y"), fx.pois(spark, d).select("poi_id", "x", "y"), 300.0)
    return pairs.select("build_id", "poi_id", six("dist").alias("dist"))


@add("j5_tile_extent_join", with_sql("building poi", """
    SELECT t.tx, t.ty, build_id FROM (SELECT DISTINCT floor(x/512)::BIGINT AS tx, floor(y/512)::BIGINT AS ty FROM poi) t
    JOIN building b ON b.minx <= (tx+1)*512 AND b.maxx >= tx*512 AND b.miny <= (ty+1)*512 AND b.maxy >= ty*512"""))
def j5(spark, d):
    size = 512.0
    tiles = fx.pois(spark, d).select(
        F.floor(F.col("x") / size).alias("tx"), F.floor(F.col("y") / size).alias("ty")).distinct().select(
        "tx", "ty", (F.col("tx") * size).alias("a_minx"), (F.col("ty") * size).alias("a_miny"),
        ((F.col("tx") + 1) * size).alias("a_maxx"), ((F.col("ty") + 1) * size).alias("a_maxy"))
    b = fx.buildings(spark, d).select("build_id", *[F.col(c).alias("b_" + c) for c in ("minx", "miny", "maxx", "maxy")])
    return bbox_join(tiles, b, size).select("tx", "ty", "build_id")


# ---- coordinate expressions ----------------------------------------------------

@add("g1_g6_pair_scores", with_sql("candidate", """
    SELECT build_id, cand_id, round(overlap,6) AS overlap, round(iou,6) AS iou, round(cdist,6) AS cdist,
        round(aratio,6) AS aratio, round(exp(-cdist/20),6) AS decay, score FROM pair""", PAIRS))
def g1_g6(spark, d):
    return _scored(spark, d).select(
        "build_id", "cand_id", *[six(c).alias(c) for c in ("overlap", "iou", "cdist", "aratio")],
        six(geo.distance_decay(F.col("cdist"))).alias("decay"), "score")


_LON, _LAT = "(118 + x/100000)", "(31 + y/100000)"


def _lonlat(spark, d):
    return fx.pois(spark, d).select("poi_id", (F.lit(118) + F.col("x") / 100000).alias("lon"),
                                    (F.lit(31) + F.col("y") / 100000).alias("lat"))


@add("g7_reproject", with_sql("poi", f"""
    SELECT poi_id, round(mx, 4) AS mx, round(my, 4) AS my, round(degrees(mx/6378137.0), 8) AS lon,
        round(degrees(2*atan(exp(my/6378137.0)) - pi()/2), 8) AS lat FROM (
    SELECT poi_id, 6378137.0*radians({_LON}) AS mx, 6378137.0*ln(tan(pi()/4 + radians({_LAT})/2)) AS my FROM poi)"""))
def g7(spark, d):
    m = _lonlat(spark, d).select("poi_id", geo.mercator_x("lon").alias("mx"), geo.mercator_y("lat").alias("my"))
    return m.select("poi_id", F.round("mx", 4).alias("mx"), F.round("my", 4).alias("my"),
                    F.round(geo.lon_of("mx"), 8).alias("lon"), F.round(geo.lat_of("my"), 8).alias("lat"))


@add("g8_gcj02_to_wgs84", with_sql("poi", f"""
    SELECT poi_id, round(lon - degrees(dlo*sm/(6378245.0*cos(radians(lat)))), 7) AS lng_wgs,
        round(lat - degrees(dla*magic*sm/(6378245.0*(1-0.00669342162296594323))), 7) AS lat_wgs FROM (
    SELECT *, sqrt(magic) AS sm FROM (SELECT *, 1-0.00669342162296594323*pow(sin(radians(lat)),2) AS magic,
      -100+2*u+3*v+.2*v*v+.1*u*v+.2*sqrt(abs(u)) + (20*sin(6*u*pi())+20*sin(2*u*pi()))*2/3
        + (20*sin(v*pi())+40*sin(v/3*pi()))*2/3 + (160*sin(v/12*pi())+320*sin(v*pi()/30))*2/3 AS dla,
      300+u+2*v+.1*u*u+.1*u*v+.1*sqrt(abs(u)) + (20*sin(6*u*pi())+20*sin(2*u*pi()))*2/3
        + (20*sin(u*pi())+40*sin(u/3*pi()))*2/3 + (150*sin(u/12*pi())+300*sin(u/30*pi()))*2/3 AS dlo
    FROM (SELECT poi_id, {_LON} AS lon, {_LAT} AS lat, {_LON}-105 AS u, {_LAT}-35 AS v FROM poi)))"""))
def g8(spark, d):
    lng, lat = geo.gcj02_to_wgs84("lon", "lat")
    return _lonlat(spark, d).select("poi_id", F.round(lng, 7).alias("lng_wgs"), F.round(lat, 7).alias("lat_wgs"))


@add("g9_geohash", with_sql("poi", f"""
    SELECT poi_id, array_to_string(list_transform(range(9), lambda i: substr('0123456789bcdefghjkmnpqrstuvwxyz',
        1 + list_sum(list_transform(range(5), lambda j: (CASE WHEN (5*i+j)%2 = 0
            THEN (lo // (1::BIGINT << (22 - (5*i+j)//2)::INTEGER)) % 2 ELSE (la // (1::BIGINT << (21 - (5*i+j)//2)::INTEGER)) % 2 END)
            * (1::BIGINT << (4-j)::INTEGER)))::INTEGER, 1)), '') AS geohash
    FROM (SELECT poi_id, floor(({_LON}+180)/360*8388608)::BIGINT AS lo, floor(({_LAT}+90)/180*4194304)::BIGINT AS la FROM poi)"""))
def g9(spark, d):
    return _lonlat(spark, d).select("poi_id", geo.geohash("lat", "lon").alias("geohash"))


AFFINE = (0.5, 0.0, 1000.0, 0.0, -0.5, 9000.0)


@add("g10_g11_pixel_map", with_sql("image", """
    SELECT image_id, i, round(0.5::DOUBLE*(col+0.5::DOUBLE)+1000, 6) AS mx, round(-0.5::DOUBLE*(row+0.5::DOUBLE)+9000, 6) AS my,
        row::BIGINT AS row_back, col::BIGINT AS col_back FROM image"""))
def g10(spark, d):
    mx, my = geo.pixel_to_map("row", "col", AFFINE)
    back = fx.images(spark, d).select("image_id", "i", mx.alias("mx"), my.alias("my"))
    row, col = geo.map_to_pixel("mx", "my", AFFINE)
    return back.select("image_id", F.col("i").cast("long").alias("i"), six("mx").alias("mx"), six("my").alias("my"),
                       row.alias("row_back"), col.alias("col_back"))


def _ring(spark, d):
    return fx.buildings(spark, d).withColumn("ring", geo.ring_of_rect("minx", "miny", "maxx", "maxy"))


# Right triangles with equal legs along the axes: two of them overlap in a third, so that areas have a closed form.
TRIANGLES = """tri AS (SELECT build_id, cand_id, func, leg >= 0 AS touch, inter/aa AS overlap, inter/(aa+ab-inter) AS iou, cdist, least(aa,ab)/greatest(aa,ab) AS aratio,
      round(.65*inter/(aa+ab-inter)+.15*inter/aa+.1*least(aa,ab)/greatest(aa,ab)+.1*exp(-cdist/20), 6) AS score FROM (
    SELECT *, CASE WHEN leg > 0 THEN leg*leg/2 ELSE 0 END AS inter FROM (
      SELECT a.build_id, b.cand_id, b.func, (a.maxx-a.minx)*(a.maxx-a.minx)/2 AS aa, (b.maxx-b.minx)*(b.maxx-b.minx)/2 AS ab,
        least(a.maxx+a.miny, b.maxx+b.miny) - greatest(a.minx, b.minx) - greatest(a.miny, b.miny) AS leg,
        sqrt(pow(a.minx-b.minx+(a.maxx-a.minx-b.maxx+b.minx)/3, 2)+pow(a.miny-b.miny+(a.maxx-a.minx-b.maxx+b.minx)/3, 2)) AS cdist
      FROM building a JOIN candidate b ON a.minx<=b.maxx AND b.minx<=a.maxx AND a.miny<=b.miny+b.maxx-b.minx AND b.miny<=a.miny+a.maxx-a.minx
      WHERE a.build_id % 10 <> 3)))"""


def _triangle():
    x, y, leg = F.col("minx").cast("double"), F.col("miny").cast("double"), (F.col("maxx") - F.col("minx")).cast("double")
    point = lambda a, b: F.struct(a.alias("x"), b.alias("y"))
    return F.array(point(x, y), point(x + leg, y), point(x, y + leg), point(x, y))


def _triangles(spark, d):
    """Both layers as triangles; every id ending in 3 is flattened to a line."""
    flat = geo.ring_of_rect("minx", "miny", "maxx", "miny")
    ours = fx.buildings(spark, d).select("build_id", F.when(F.col("build_id") % 10 == 3, flat).otherwise(_triangle()).alias("ring"))
    theirs = fx.candidates(spark, d).select("cand_id", "func", _triangle().alias("ring"))
    return ours.repartition("build_id"), theirs.repartition("cand_id")  # made once, as a stored layer would be


@add("g1_g2_polygon_scores", with_sql("candidate", """
    SELECT build_id, cand_id, touch, round(overlap, 6) AS overlap, round(iou, 6) AS iou, round(cdist, 6) AS cdist, round(aratio, 6) AS aratio, score FROM tri""", TRIANGLES))
def g1_polygons(spark, d):
    ours, theirs = _triangles(spark, d)
    a = polygons.with_box(polygons.with_validity(ours).where("valid").select("build_id", F.col("ring").alias("a_ring")), "a_", "a_ring")
    b = polygons.with_box(theirs.select("cand_id", F.col("ring").alias("b_ring")), "b_", "b_ring")
    scored = polygons.score_polygons(bbox_join(polygons.with_measures(a, "a_ring"), polygons.with_measures(b, "b_ring"), 60.0))
    return scored.select("build_id", "cand_id", "touch", *[six(c).alias(c) for c in ("overlap", "iou", "cdist", "aratio")], "score")


@add("w3_polygon_transfer", with_sql("candidate", """
    SELECT b.build_id, CASE WHEN b.build_id % 10 = 3 THEN 'Invalid_Geometry' WHEN t.touch IS NULL THEN 'No_Match' WHEN NOT t.touch THEN 'No_Intersect_Precise'
        ELSE status END AS status, round(s1, 3) AS match_score, CASE WHEN status = 'Auto_Match' THEN func END AS matched_func
    FROM building b LEFT JOIN (SELECT build_id, bool_or(touch) AS touch FROM tri GROUP BY build_id) t USING (build_id) LEFT JOIN dec USING (build_id)""", f"""{TRIANGLES},
    ranked AS (SELECT *, row_number() OVER w AS rk, lead(score) OVER w AS s2 FROM tri WHERE touch WINDOW w AS (PARTITION BY build_id ORDER BY score DESC, cand_id)),
    dec AS (SELECT build_id, func, score AS s1, CASE WHEN score <= 0.6 THEN 'Low_Score_Check' WHEN s2 IS NOT NULL AND round(score - s2, 6) < 0.05
        THEN 'Conflict_Ambiguous' ELSE 'Auto_Match' END AS status FROM ranked WHERE rk = 1)"""))
def w3_polygons(spark, d):
    return polygons.transfer_polygons(*_triangles(spark, d)).select("build_id", "status", "match_score", "matched_func")


# Features of the boxes with holes and parts; as disjoint rectangles their areas have a closed form.
_PIECES = """CASE {id} % 3 WHEN 0 THEN [[0,0,3,1],[0,2,3,3],[0,1,1,2],[2,1,3,2]] WHEN 1 THEN [[0,0,3,1],[0,1,1,3]] ELSE [[0,0,1,3],[2,0,3,2]] END"""
FEATURES = f"""bp AS (SELECT build_id, build_id % 10 = 3 AS bad, minx, miny, maxx, maxy, unnest({_PIECES.format(id="build_id")}) AS p FROM building),
    ap AS (SELECT build_id, bad, minx+(maxx-minx)*p[1]/4 AS x1, miny+(maxy-miny)*p[2]/4 AS y1, minx+(maxx-minx)*p[3]/4 AS x2, miny+(maxy-miny)*p[4]/4 AS y2 FROM bp),
    cq AS (SELECT cand_id, func, minx, miny, maxx, maxy, unnest({_PIECES.format(id="cand_id // 3")}) AS p FROM candidate),
    cp AS (SELECT cand_id, func, minx+(maxx-minx)*p[1]/4 AS x1, miny+(maxy-miny)*p[2]/4 AS y1, minx+(maxx-minx)*p[3]/4 AS x2, miny+(maxy-miny)*p[4]/4 AS y2 FROM cq),
    size_a AS (SELECT build_id, any_value(bad) AS bad, sum((x2-x1)*(y2-y1)) AS area, sum((x2-x1)*(y2-y1)*(x1+x2)/2)/sum((x2-x1)*(y2-y1)) AS cx, sum((x2-x1)*(y2-y1)*(y1+y2)/2)/sum((x2-x1)*(y2-y1)) AS cy,
      min(x1) AS minx, min(y1) AS miny, max(x2) AS maxx, max(y2) AS maxy FROM ap GROUP BY build_id),
    size_b AS (SELECT cand_id, any_value(func) AS func, sum((x2-x1)*(y2-y1)) AS area, sum((x2-x1)*(y2-y1)*(x1+x2)/2)/sum((x2-x1)*(y2-y1)) AS cx, sum((x2-x1)*(y2-y1)*(y1+y2)/2)/sum((x2-x1)*(y2-y1)) AS cy,
      min(x1) AS minx, min(y1) AS miny, max(x2) AS maxx, max(y2) AS maxy FROM cp GROUP BY cand_id),
    met AS (SELECT a.build_id, b.cand_id, b.func, a.area AS aa, b.area AS ab, sqrt((a.cx-b.cx)*(a.cx-b.cx)+(a.cy-b.cy)*(a.cy-b.cy)) AS cdist FROM size_a a JOIN size_b b
      ON a.minx <= b.maxx AND b.minx <= a.maxx AND a.miny <= b.maxy AND b.miny <= a.maxy WHERE NOT a.bad),
    com AS (SELECT m.build_id, m.cand_id, bool_or(a.x1 <= b.x2 AND b.x1 <= a.x2 AND a.y1 <= b.y2 AND b.y1 <= a.y2) AS touch,
      sum(greatest(least(a.x2,b.x2)-greatest(a.x1,b.x1),0)*greatest(least(a.y2,b.y2)-greatest(a.y1,b.y1),0)) AS inter
      FROM met m JOIN ap a USING (build_id) JOIN cp b USING (cand_id) GROUP BY ALL),
    fe AS (SELECT m.build_id, m.cand_id, m.func, touch, inter/aa AS overlap, inter/(aa+ab-inter) AS iou, cdist, least(aa,ab)/greatest(aa,ab) AS aratio,
      round(0.65*inter/(aa+ab-inter)+0.15*inter/aa+0.1*least(aa,ab)/greatest(aa,ab)+0.1*exp(-cdist/20), 6) AS score FROM met m JOIN com USING (build_id, cand_id))"""


def _pieces(number):
    """A frame (a box less its middle), an L and two separate bars, in quarters of the box."""
    x = lambda k: F.col("minx") + (F.col("maxx") - F.col("minx")) * k / 4
    y = lambda k: F.col("miny") + (F.col("maxy") - F.col("miny")) * k / 4
    ring = lambda *at: F.array(*[F.struct(x(i).cast("double").alias("x"), y(j).cast("double").alias("y")) for i, j in at])
    frame = F.array(F.array(ring((0, 0), (3, 0), (3, 3), (0, 3), (0, 0)), ring((1, 1), (1, 2), (2, 2), (2, 1), (1, 1))))
    corner = F.array(F.array(ring((0, 0), (3, 0), (3, 1), (1, 1), (1, 3), (0, 3), (0, 0))))
    bars = F.array(F.array(ring((0, 0), (1, 0), (1, 3), (0, 3), (0, 0))), F.array(ring((2, 0), (3, 0), (3, 2), (2, 2), (2, 0))))
    return F.when(number % 3 == 0, frame).when(number % 3 == 1, corner).otherwise(bars)


def _features(spark, d):
    """Both layers as features with holes and parts; every id ending in 3 is flattened to a line."""
    flat = F.array(F.array(geo.ring_of_rect("minx", "miny", "maxx", "miny")))
    ours = fx.buildings(spark, d).select("build_id", F.when(F.col("build_id") % 10 == 3, flat).otherwise(_pieces(F.col("build_id"))).alias("polygons"))
    theirs = fx.candidates(spark, d).select("cand_id", "func", _pieces(F.floor(F.col("cand_id") / 3)).alias("polygons"))
    # as a stored layer would: the features are made once and not inside every expression on them
    return ours.repartition("build_id"), theirs.repartition("cand_id")


@add("g1_g2_feature_scores", with_sql("candidate", """
    SELECT build_id, cand_id, touch, round(overlap, 6) AS overlap, round(iou, 6) AS iou, round(cdist, 6) AS cdist, round(aratio, 6) AS aratio, score FROM fe""", FEATURES))
def g1_features(spark, d):
    scored = overlay.candidate_features(*_features(spark, d))
    return scored.select("build_id", "cand_id", "touch", *[six(c).alias(c) for c in ("overlap", "iou", "cdist", "aratio")], "score")


@add("w3_feature_transfer", with_sql("candidate", """
    SELECT b.build_id, CASE WHEN b.build_id % 10 = 3 THEN 'Invalid_Geometry' WHEN t.touch IS NULL THEN 'No_Match' WHEN NOT t.touch THEN 'No_Intersect_Precise'
        ELSE status END AS status, round(s1, 3) AS match_score, CASE WHEN status = 'Auto_Match' THEN func END AS matched_func
    FROM building b LEFT JOIN (SELECT build_id, bool_or(touch) AS touch FROM fe GROUP BY build_id) t USING (build_id) LEFT JOIN dec USING (build_id)""", f"""{FEATURES},
    ranked AS (SELECT *, row_number() OVER w AS rk, lead(score) OVER w AS s2 FROM fe WHERE touch WINDOW w AS (PARTITION BY build_id ORDER BY score DESC, cand_id)),
    dec AS (SELECT build_id, func, score AS s1, CASE WHEN score <= 0.6 THEN 'Low_Score_Check' WHEN s2 IS NOT NULL AND round(score - s2, 6) < 0.05
        THEN 'Conflict_Ambiguous' ELSE 'Auto_Match' END AS status FROM ranked WHERE rk = 1)"""))
def w3_features(spark, d):
    return overlay.transfer_features(*_features(spark, d)).select("build_id", "status", "match_score", "matched_func")


@add("p13_self_crossing", with_sql("building", "SELECT build_id FROM building WHERE build_id % 10 NOT IN (1, 3, 7)"))
def p13_crossing(spark, d):
    """Besides flat and missing rings, every id ending in 1 is a ring whose edges cross."""
    point = lambda a, b: F.struct(F.expr(a).cast("double").alias("x"), F.expr(b).cast("double").alias("y"))
    crossed = F.array(*[point(a, b) for a, b in (("minx", "miny"), ("maxx", "maxy"), ("maxx", "miny"), ("minx", "maxy + 5"), ("minx", "miny"))])
    end = F.col("build_id") % 10
    ring = F.when(end == 1, crossed).when(end == 3, geo.ring_of_rect("minx", "miny", "maxx", "miny")).when(end != 7, F.col("ring"))
    return polygons.with_validity(_ring(spark, d).withColumn("ring", ring)).where("valid").select("build_id")


@add("a8_merge_layers", with_sql("candidate", """
    SELECT min(id) AS id, minx, miny, maxx, maxy FROM (SELECT build_id AS id, minx, miny, maxx, maxy FROM building
      UNION ALL SELECT 1000000000 + cand_id, minx, miny, maxx, maxy FROM candidate) GROUP BY minx, miny, maxx, maxy"""))
def a8(spark, d):
    """Both layers, the second with its outlines the other way round and from another corner; equal outlines once."""
    ring = geo.ring_of_rect("minx", "miny", "maxx", "maxy")
    turned = F.reverse(F.concat(F.slice(ring, 2, 4), F.slice(ring, 2, 1)))
    ours = fx.buildings(spark, d).select(F.col("build_id").alias("id"), ring.alias("ring"))
    theirs = fx.candidates(spark, d).select((F.col("cand_id") + 1000000000).alias("id"), turned.alias("ring"))
    merged = polygons.merge_layers([ours, theirs], "id")
    return merged.select("id", *[c.alias(n) for n, c in geo.ring_bounds("ring").items()])


@add("g12_ring_measures", with_sql("building", """
    SELECT build_id, minx, miny, maxx, maxy, (maxx-minx)*(maxy-miny) AS area, round((minx+maxx)/2, 6) AS cx,
        round((miny+maxy)/2, 6) AS cy FROM building"""))
def g12(spark, d):
    cx, cy = geo.ring_centroid("ring")
    return _ring(spark, d).select(
        "build_id", *[c.alias(n) for n, c in geo.ring_bounds("ring").items()],
        geo.ring_area("ring").alias("area"), six(cx).alias("cx"), six(cy).alias("cy"))


@add("g13_canonical_ring", with_sql("building", """
    SELECT build_id, printf('%.0f %.0f, %.0f %.0f, %.0f %.0f, %.0f %.0f, %.0f %.0f', minx, miny, maxx, miny, maxx, maxy, minx, maxy, minx, miny) AS ring
    FROM building"""))
def g13(spark, d):
    """Rings start at a corner chosen by id and run clockwise for odd ids; the canonical form undoes both."""
    open_ring = F.slice("ring", 1, 4)
    start = (F.col("build_id") % 4 + 1).cast("int")
    turned = F.concat(F.slice(open_ring, start, F.lit(4)), F.slice(open_ring, F.lit(1), start - 1))
    closed = F.concat(turned, F.slice(turned, 1, 1))
    mixed = F.when(F.col("build_id") % 2 == 1, F.reverse(closed)).otherwise(closed)
    canonical = geo.canonical_ring("mixed")
    pts = F.transform(canonical, lambda p: F.concat_ws(" ", p["x"].cast("long").cast("string"), p["y"].cast("long").cast("string")))
    return _ring(spark, d).withColumn("mixed", mixed).select("build_id", F.array_join(pts, ", ").alias("ring"))


@add("p13_drop_invalid_geometry", with_sql("building", """
    SELECT build_id FROM building WHERE build_id % 10 <> 3 AND build_id % 10 <> 7"""))
def p13(spark, d):
    """Footprints with a share of broken ones: every id ending in 3 is flattened, every id ending in 7 has no ring."""
    flat = geo.ring_of_rect("minx", "miny", "maxx", "miny")
    broken = F.when(F.col("build_id") % 10 == 3, flat).when(F.col("build_id") % 10 != 7, F.col("ring"))
    return _ring(spark, d).withColumn("ring", broken).where(geo.ring_is_usable("ring")).select("build_id")


@add("g14_distance_band", with_sql("center poi", "SELECT build_id, band, count(*) AS n FROM top GROUP BY ALL", top_sql(1 << 40)))
def g14(spark, d):
    points = fx.pois(spark, d).select("poi_id", "x", "y")
    pairs = radius_join(fx.centers(spark, d).select("build_id", "x", "y"), points, 300.0, Best((100.0, 200.0), 1, "poi_id"))
    return context.with_bands(pairs).groupBy("build_id", "band").agg(F.sum("_count").alias("n"))


@add("g15_total_extent", with_sql("building", """
    SELECT city_no, min(minx) AS minx, min(miny) AS miny, max(maxx) AS maxx, max(maxy) AS maxy,
        round((max(maxx)-min(minx))/0.6)::BIGINT AS width, round((max(maxy)-min(miny))/0.6)::BIGINT AS height
    FROM building GROUP BY city_no"""))
def g15(spark, d):
    from geoctx.operators.raster import total_extent

    return total_extent(fx.buildings(spark, d), ["city_no"], 0.6)


# ---- nearest k, bands, lists, prompts -------------------------------------------

@add("w1_nearest_k", with_sql("center poi", """
    SELECT build_id, poi_id, rk, round(dist,6) AS dist FROM top""", top_sql(31)))
def w1(spark, d):
    return _top(spark, d, 31).select("build_id", "poi_id", F.col("rk").cast("long").alias("rk"), six("dist").alias("dist"))


_CROWD = "(SELECT poi_id, type_en, x % 10 * 1000 AS x, y % 10 * 1000 AS y FROM poi)"


@add("w1_nearest_k_crowded", with_sql("center poi", "SELECT build_id, poi_id, rk, round(dist,6) AS dist FROM top", top_sql(31).replace("JOIN poi p", f"JOIN {_CROWD} p")))
def w1_crowded(spark, d):
    """The same with all points in a hundred places."""
    places = fx.pois(spark, d).withColumn("x", F.col("x") % 10 * 1000).withColumn("y", F.col("y") % 10 * 1000)
    top = nearest_k(fx.centers(spark, d).select("build_id", "x", "y"), places, 300.0, 31)
    return top.select("build_id", "poi_id", F.col("rk").cast("long").alias("rk"), six("dist").alias("dist"))


@add("w4_banded_nearest_k", with_sql("center poi", """
    SELECT build_id, band, count(*) AS n, min(rk) AS first_rk FROM top GROUP BY ALL""", top_sql(31)))
def w4(spark, d):
    return _top(spark, d, 31).groupBy("build_id", "band").agg(
        F.count(F.lit(1)).alias("n"), F.min("rk").cast("long").alias("first_rk"))


@add("w2_tier_sample", with_sql("center poi", """
    SELECT build_id, poi_id, tier FROM pick WHERE n <= 20 OR rn <= CASE tier WHEN 'A' THEN 10 WHEN 'B' THEN 15 - least(na, 10)
        WHEN 'C' THEN 20 - least(na, 10) - least(nb, 15 - least(na, 10)) ELSE 0 END""", f"""{NEAR},
    tiered AS (SELECT *, CASE WHEN dist < 100 THEN 'A' WHEN dist < 200 THEN 'B' WHEN dist < 300 THEN 'C' ELSE '-' END AS tier,
        ((poi_id % 2147483647 + 2147483647) % 2147483647 * 2654435761 + 42*40503) % 2147483647 AS k FROM near),
    pick AS (SELECT *, count(*) OVER (PARTITION BY build_id) AS n,
        count(*) FILTER (tier='A') OVER (PARTITION BY build_id) AS na, count(*) FILTER (tier='B') OVER (PARTITION BY build_id) AS nb,
        row_number() OVER (PARTITION BY build_id, tier ORDER BY CASE WHEN tier='A' THEN dist ELSE k END, poi_id) AS rn FROM tiered)"""))
def w2(spark, d):
    key = ranking.portable_key(F.col("poi_id"))
    points = fx.pois(spark, d).select("poi_id", "x", "y", key.cast("double").alias("_hash"))
    pairs = radius_join(fx.centers(spark, d).select("build_id", "x", "y"), points, 300.0, context.tier_best("_hash"), "build_id", ["poi_id"])
    return context.tier_sample(pairs, key).select("build_id", "poi_id", "tier")


@add("w3_match_decision", with_sql("candidate", """
    SELECT b.build_id, CASE WHEN status = 'Auto_Match' THEN func END AS matched_func, coalesce(status, 'No_Match') AS status,
        round(s1, 3) AS match_score, CASE status WHEN 'Auto_Match' THEN det WHEN 'Low_Score_Check' THEN printf('TopScore:%.2f (', s1) || det || ')'
        WHEN 'Conflict_Ambiguous' THEN printf('Ambiguous: Top1(%.2f) vs Top2(%.2f)', s1, s2) END AS match_info
    FROM building b LEFT JOIN dec USING (build_id)""", f"""{PAIRS},
    ranked AS (SELECT *, row_number() OVER w AS rk, lead(score) OVER w AS s2 FROM pair WINDOW w AS (PARTITION BY build_id ORDER BY score DESC, cand_id)),
    dec AS (SELECT build_id, func, score AS s1, s2, printf('IoU:%.2f,Ov:%.2f,Dist:%.1fm', iou, overlap, cdist) AS det,
        CASE WHEN score <= 0.6 THEN 'Low_Score_Check' WHEN s2 IS NOT NULL AND round(score - s2, 6) < 0.05 THEN 'Conflict_Ambiguous'
        ELSE 'Auto_Match' END AS status FROM ranked WHERE rk = 1)"""))
def w3(spark, d):
    return transfer.transfer_rectangles(fx.buildings(spark, d), fx.candidates(spark, d))


@add("a6_packed_lists", with_sql("center poi", """
    SELECT build_id, count(*) AS n_poi, string_agg(type_en, '?' ORDER BY rk) AS poi_text,
        string_agg(band, '?' ORDER BY rk) AS poi_distance FROM top GROUP BY build_id""", top_sql(100)))
def a6(spark, d):
    out = context.packed_lists(_lists(spark, d, 100))
    return out.withColumn("n_poi", F.col("n_poi").cast("long"))


@add("p10_minimum_points", with_sql("center poi", """
    SELECT build_id, count(*) AS n FROM near GROUP BY build_id HAVING count(*) >= 40""", NEAR))
def p10(spark, d):
    packed = context.packed_lists(_lists(spark, d, 100), min_count=40, counts=_counts(spark, d))
    return packed.select("build_id", F.col("n_poi").cast("long").alias("n"))


@add("f4_unpack_lists", with_sql("center poi", "SELECT build_id, rk AS pos, type_en AS type, band FROM top", top_sql(20)))
def f4(spark, d):
    packed = context.packed_lists(_lists(spark, d, 20))
    zipped = text.unpack_aligned(type="poi_text", band="poi_distance")
    return packed.select("build_id", F.posexplode(zipped).alias("pos", "i")).select(
        "build_id", (F.col("pos") + 1).cast("long").alias("pos"), "i.type", "i.band")


@add("a5_packed_count", with_sql("center poi", "SELECT build_id, count(*)::INTEGER AS poi_num FROM top GROUP BY build_id", top_sql(31)))
def a5(spark, d):
    return context.packed_lists(_lists(spark, d, 31)).select("build_id", text.packed_count("poi_text").alias("poi_num"))


@add("a9_common_types", with_sql("center poi", """
    SELECT build_id, band, n, array_to_string(l, '|') AS types FROM bp""", prompt_sql(text.DENSITY_WORDS_PLAIN)))
def a9(spark, d):
    return context.band_profile(_lists(spark, d, 100)).select("build_id", "band", "n", F.array_join("types", "|").alias("types"))


@add("a10_dominance", with_sql("center poi", """
    SELECT build_id, band, n, round(mx/n, 6) AS share, CASE WHEN n<=3 THEN 0 WHEN n<=20 THEN 1 WHEN n<=40 THEN 2 WHEN n<=80 THEN 3 ELSE 4 END AS density
    FROM bp""", prompt_sql(text.DENSITY_WORDS_PLAIN)))
def a10(spark, d):
    n = F.col("n")
    density = F.when(n <= 3, 0).when(n <= 20, 1).when(n <= 40, 2).when(n <= 80, 3).otherwise(4)
    return context.band_profile(_lists(spark, d, 100)).select(
        "build_id", "band", "n", six(F.col("top_count") / n).alias("share"), density.alias("density"))


def _prompts(spark, d, words=text.DENSITY_WORDS_VIVID):
    return context_prompts(fx.centers(spark, d), fx.pois(spark, d), words=words)


_PROMPTS = with_sql("center poi", "SELECT build_id, n_poi, prompt FROM prompt", prompt_sql(text.DENSITY_WORDS_VIVID))


@add("f3_context_prompt", _PROMPTS)
def f3(spark, d):
    return _prompts(spark, d)


@add("f2_context_prompt_plain", with_sql("center poi", "SELECT build_id, n_poi, prompt FROM prompt", prompt_sql(text.DENSITY_WORDS_PLAIN)))
def f2(spark, d):
    return _prompts(spark, d, text.DENSITY_WORDS_PLAIN)


@add("p16_long_prompts", with_sql("center poi", r"""
    SELECT DISTINCT build_id || '.tif' AS file_name FROM prompt
    WHERE len(regexp_extract_all(lower(prompt), '[a-z]+|[0-9]+|[^a-z0-9\s]')) >= 62""", prompt_sql(text.DENSITY_WORDS_VIVID)))
def p16(spark, d):
    return (
        _prompts(spark, d).where(text.model_token_count("prompt") >= 62)
        .select(F.concat(F.col("build_id").cast("string"), F.lit(".tif")).alias("file_name")).distinct()
    )


@add("p17_prompt_bands", with_sql("center poi", """
    SELECT build_id, trim(s[1]) AS near, trim(s[2]) AS middle, trim(s[3]) AS far FROM (
    SELECT build_id, string_split(replace(prompt, 'Urban building context: ', ''), ';') AS s FROM prompt)""",
    prompt_sql(text.DENSITY_WORDS_VIVID)))
def p17(spark, d):
    b = text.prompt_bands("prompt")
    return _prompts(spark, d).select("build_id", b[0].alias("near"), b[1].alias("middle"), b[2].alias("far"))


# ---- versions of the sample table -------------------------------------------------

_VERSIONS = f"""{NEAR}, ranked AS (SELECT *, row_number() OVER (PARTITION BY build_id ORDER BY dist, poi_id) AS rk FROM near),
    v AS (SELECT build_id, string_agg(type_en, '?' ORDER BY rk) FILTER (rk <= 20) AS a, string_agg(type_en, '?' ORDER BY rk) FILTER (rk <= 31) AS b
        FROM ranked GROUP BY build_id)"""


def _version(spark, d, k):
    return context.packed_lists(_lists(spark, d, k)).select("build_id", "poi_text", "n_poi")


@add("j6_version_diff", with_sql("center poi", "SELECT build_id, a AS poi_text_a, b AS poi_text_b FROM v WHERE a <> b", _VERSIONS))
def j6(spark, d):
    return lookup.differing(_version(spark, d, 20), _version(spark, d, 31), "build_id", ["poi_text"])


@add("j7_verified_copy", with_sql("center poi", """
    SELECT CASE WHEN a = b THEN 'matched' ELSE 'mismatch' END AS copy_status, count(*) AS n,
        count(*) FILTER (a = b) AS copied FROM v GROUP BY 1""", _VERSIONS))
def j7(spark, d):
    source = _version(spark, d, 31).withColumnRenamed("n_poi", "poi_location")
    out = lookup.verified_copy(_version(spark, d, 20), source, "build_id", ["poi_text"], "poi_location")
    return out.groupBy("copy_status").agg(F.count(F.lit(1)).alias("n"), F.count("poi_location").alias("copied"))
