"""Stand-in inputs derived from the given tables, in Spark and as SQL text.

Integer arithmetic only, so both engines derive equal values. ``SQL`` holds one
common table expression per stand-in; ``with_sql`` puts the needed ones in front
of a query.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from geoctx.session import spread

CITIES = ["SH", "NJ", "HZ", "SZ", "NB"]


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def city_name(no):
    return F.element_at(F.array(*[F.lit(c) for c in CITIES]), (no + 1).cast("int"))


def buildings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Axis-aligned footprints on a 10 km world: id, city, extent, class 1..7."""
    k = F.col("c_custkey")
    minx, miny = (k * 7919) % 9973, (k * 5209) % 9967
    return table(spark, sf_dir, "customer").select(
        k.alias("build_id"),
        (F.col("c_nationkey") % 5).cast("int").alias("city_no"),
        minx.cast("double").alias("minx"),
        miny.cast("double").alias("miny"),
        (minx + 12 + k % 37).cast("double").alias("maxx"),
        (miny + 12 + (k * 13) % 41).cast("double").alias("maxy"),
        (k % 7 + 1).cast("int").alias("cls"),
    )


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spread(table(spark, sf_dir, "documents").select("doc_id", "text"), "doc_id")


def centers(spark: SparkSession, sf_dir: str) -> DataFrame:
    return buildings(spark, sf_dir).select(
        "build_id", "city_no", "cls",
        ((F.col("minx") + F.col("maxx")) / 2).alias("x"),
        ((F.col("miny") + F.col("maxy")) / 2).alias("y"),
    )


def candidates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A second footprint layer: shifted copies, some missing, some doubled."""
    b = buildings(spark, sf_dir)
    k = F.col("build_id")

    def shifted(dx, cand_id, func):
        dy = k % 5 - 2
        return [
            cand_id.alias("cand_id"),
            *[(F.col(c) + d).alias(c) for c, d in (("minx", dx), ("miny", dy), ("maxx", dx), ("maxy", dy))],
            func.cast("int").alias("func"),
        ]

    first = b.where(k % 11 != 0).select(*shifted(k % 9 - 4, k * 3, F.col("cls")))
    second = b.where(k % 17 == 0).select(*shifted(k % 9 - 3, k * 3 + 1, F.col("cls") % 7 + 1))
    return first.unionByName(second)


def pois(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("o_orderkey")
    return spread(table(spark, sf_dir, "orders").select("o_orderkey", "o_orderpriority"), "o_orderkey").select(
        k.alias("poi_id"),
        ((k * 6151) % 9949).cast("double").alias("x"),
        ((k * 4219) % 9941).cast("double").alias("y"),
        F.col("o_orderpriority").alias("type_en"),
    )


def images(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Embeddings as 8 x 8 images, one row per pixel, value = the component."""
    return (
        spread(table(spark, sf_dir, "embeddings"), "vec_id")
        .select(F.col("vec_id").alias("image_id"), "label", F.posexplode("embedding").alias("i", "v"))
        .select(
            "image_id", "label",
            F.floor(F.col("i") / 8).cast("int").alias("row"),
            (F.col("i") % 8).cast("int").alias("col"),
            F.col("i"), F.col("v").cast("double").alias("v"),
        )
    )


def seg_pixels(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ground truth and prediction per pixel; 255 marks ignored pixels."""
    return images(spark, sf_dir).select(
        "image_id", "label", "row", "col", "v",
        F.when((F.col("image_id") + F.col("i")) % 29 == 0, 255).otherwise((F.col("v") > 0).cast("int")).alias("gt"),
        (F.col("v") > 0.05).cast("int").alias("pred"),
    )


def grey_levels(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A three-band uint8 image per embedding, by integer arithmetic on the pixel index and sign."""
    pos = (F.col("v") > 0).cast("long")
    base = (F.col("image_id") * 31 + F.col("i") * 7 + pos * 53)
    return images(spark, sf_dir).select(
        "image_id", "row", "col",
        (F.col("v") > 0).cast("int").alias("mask"),
        (base % 256).cast("int").alias("r"),
        ((base * 3 + 11) % 256).cast("int").alias("g"),
        ((base * 5 + 29) % 256).cast("int").alias("b"),
    )


def class_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Label pairs on lineitem: gt from the return flag, pred sometimes off."""
    code = F.when(F.col("l_returnflag") == "A", 0).when(F.col("l_returnflag") == "N", 1).otherwise(2)
    return table(spark, sf_dir, "lineitem").select(
        code.cast("int").alias("gt"),
        ((code + (F.col("l_linenumber") % 2) * (F.col("l_partkey") % 3)) % 3).cast("int").alias("pred"),
    )


def scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ten class logits and the true class per vector."""
    return table(spark, sf_dir, "embeddings").select(
        F.col("vec_id").alias("sample_id"),
        F.col("label").alias("gt"),
        F.transform(F.slice("embedding", 1, 10), lambda e: e.cast("double")).alias("logits"),
    )


def train_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events as log lines: run = user, line order = (ts, event_id), every fifth step is zero."""
    return table(spark, sf_dir, "events").select(
        F.col("user_id").alias("run"), "ts", "event_id", F.col("value").alias("metric"),
        F.when(F.col("event_id") % 5 == 0, 0).otherwise(F.col("event_id")).cast("long").alias("step"),
    )


def samples(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sample index: city, zero-based class, file name and a POI count in 3..50."""
    b = buildings(spark, sf_dir)
    city = city_name(F.col("city_no"))
    return b.select(
        F.col("build_id").alias("image_id"),
        F.concat(city, F.lit("_"), F.col("build_id").cast("string"), F.lit(".tif")).alias("file_name"),
        city.alias("city"),
        (F.col("cls") - 1).cast("int").alias("fun_cls"),
        (3 + (F.col("build_id") * 17) % 48).cast("int").alias("poi_num"),
    )


_CITY_CASE = "CASE city_no WHEN 0 THEN 'SH' WHEN 1 THEN 'NJ' WHEN 2 THEN 'HZ' WHEN 3 THEN 'SZ' ELSE 'NB' END"

SQL: dict[str, str] = {
    "building": """SELECT c_custkey AS build_id, c_nationkey % 5 AS city_no,
        ((c_custkey*7919)%9973)::DOUBLE AS minx, ((c_custkey*5209)%9967)::DOUBLE AS miny,
        ((c_custkey*7919)%9973 + 12 + c_custkey%37)::DOUBLE AS maxx,
        ((c_custkey*5209)%9967 + 12 + (c_custkey*13)%41)::DOUBLE AS maxy,
        (c_custkey%7 + 1)::INTEGER AS cls FROM customer""",
    "center": "SELECT build_id, city_no, cls, (minx+maxx)/2 AS x, (miny+maxy)/2 AS y FROM building",
    "candidate": """SELECT build_id*3 AS cand_id, minx+build_id%9-4 AS minx, miny+build_id%5-2 AS miny,
        maxx+build_id%9-4 AS maxx, maxy+build_id%5-2 AS maxy, cls AS func FROM building WHERE build_id%11<>0
        UNION ALL SELECT build_id*3+1, minx+build_id%9-3, miny+build_id%5-2, maxx+build_id%9-3, maxy+build_id%5-2,
        cls%7+1 FROM building WHERE build_id%17=0""",
    "poi": """SELECT o_orderkey AS poi_id, ((o_orderkey*6151)%9949)::DOUBLE AS x,
        ((o_orderkey*4219)%9941)::DOUBLE AS y, o_orderpriority AS type_en FROM orders""",
    "image": """SELECT vec_id AS image_id, label, (i//8)::INTEGER AS row, (i%8)::INTEGER AS col, i,
        embedding[i+1]::DOUBLE AS v FROM embeddings, (SELECT unnest(range(64)) AS i)""",
    "seg": """SELECT image_id, label, row, col, v, CASE WHEN (image_id+i)%29=0 THEN 255 WHEN v>0 THEN 1 ELSE 0 END AS gt,
        CASE WHEN v>0.05 THEN 1 ELSE 0 END AS pred FROM image""",
    "grey": """SELECT image_id, row, col, CASE WHEN v>0 THEN 1 ELSE 0 END AS mask, base%256 AS r, (base*3+11)%256 AS g,
        (base*5+29)%256 AS b FROM (SELECT *, image_id*31 + i*7 + (CASE WHEN v>0 THEN 53 ELSE 0 END) AS base FROM image)""",
    "pairs": """SELECT code AS gt, (code + (l_linenumber%2)*(l_partkey%3))%3 AS pred FROM (SELECT *,
        CASE l_returnflag WHEN 'A' THEN 0 WHEN 'N' THEN 1 ELSE 2 END AS code FROM lineitem)""",
    "score": "SELECT vec_id AS sample_id, label AS gt, list_transform(embedding[1:10], lambda e: e::DOUBLE) AS logits FROM embeddings",
    "train_log": """SELECT user_id AS run, ts, event_id, value AS metric,
        CASE WHEN event_id%5=0 THEN 0 ELSE event_id END AS step FROM events""",
    "sample": f"""SELECT build_id AS image_id, {_CITY_CASE}||'_'||build_id||'.tif' AS file_name, {_CITY_CASE} AS city,
        cls-1 AS fun_cls, (3+(build_id*17)%48)::INTEGER AS poi_num FROM building""",
}
_NEEDS = {"center": ["building"], "candidate": ["building"], "seg": ["image"], "grey": ["image"], "sample": ["building"]}


def with_sql(names: str, query: str, extra: str = "") -> str:
    """``WITH <stand-ins named, and what they need> [, extra] query``."""
    ordered: list[str] = []
    for name in names.split():
        for dep in [*_NEEDS.get(name, []), name]:
            if dep not in ordered:
                ordered.append(dep)
    parts = [f"{n} AS ({SQL[n]})" for n in ordered]
    if extra:
        parts.append(extra)
    query = query.strip()
    if query.startswith("WITH "):
        parts.append(query[len("WITH "):])
        query = ""
    recursive = "RECURSIVE " if "RECURSIVE " in extra else ""
    head = ",\n".join(parts).replace("RECURSIVE ", "")
    return f"WITH {recursive}{head}\n{query}"
