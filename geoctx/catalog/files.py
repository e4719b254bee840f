"""Scans and sinks: each query writes a table derived from the inputs to a scratch path and reads it back."""

from __future__ import annotations

from pyspark.sql import functions as F
from pyspark.sql import types as T

from geoctx import fixtures as fx
from geoctx.catalog.base import Catalog
from geoctx.fixtures import with_sql
from geoctx.functions import geo
from geoctx.operators import metrics, ranking
from geoctx.session import cut_lineage, scratch_path
from geoctx.sources import jsonl, listing, logs, sinks, tabular, vector

CATALOG = Catalog()
add = CATALOG.add


def _records(spark, d):
    """Packed sample records; the prompt holds the city twice, with spaces around it."""
    return fx.samples(spark, d).select(
        F.lit("train").alias("split"), F.col("image_id").cast("string").alias("image_id"), "file_name", "fun_cls",
        (F.col("poi_num") / 64).alias("fun_score"),
        F.concat(F.lit("  "), "city", F.lit(" / "), "city", F.lit(" ")).alias("poi_prompt"))


@add("s1_lenient_scan", with_sql("sample", """
    SELECT 'good' AS kind, count(*) AS n, sum(fun_cls)::BIGINT AS total FROM sample WHERE fun_cls <> 4 UNION ALL
    SELECT 'bad', count(*), NULL FROM sample WHERE fun_cls = 4"""))
def s1(spark, d):
    path = scratch_path(spark, "s1")
    record = F.to_json(F.struct("*"))
    lines = _records(spark, d).select(
        F.when(F.col("fun_cls") == 4, F.substring(record, 1, 40)).otherwise(F.concat(record, F.lit("\n  "))).alias("value"))
    lines.write.text(path)
    good, bad = jsonl.read_lenient(spark, path)
    return good.agg(F.lit("good").alias("kind"), F.count(F.lit(1)).alias("n"), F.sum("fun_cls").alias("total")).unionByName(
        bad.agg(F.lit("bad").alias("kind"), F.count(F.lit(1)).alias("n"), F.lit(None).cast("long").alias("total")))


@add("s2_strict_scan", with_sql("sample", "SELECT image_id::VARCHAR AS image_id, file_name, fun_cls, poi_num/64 AS fun_score FROM sample"))
def s2(spark, d):
    path = scratch_path(spark, "s2")
    sinks.write_jsonl(_records(spark, d), path)
    rows = jsonl.read_strict(spark, path, required=["image_id", "fun_cls", "poi_prompt"])
    return rows.select("image_id", "file_name", "fun_cls", "fun_score")


@add("s3_projected_scan", with_sql("sample", "SELECT image_id::VARCHAR AS image_id, city || ' / ' || city AS poi_prompt FROM sample"))
def s3(spark, d):
    path = scratch_path(spark, "s3")
    sinks.write_jsonl(_records(spark, d), path)
    return jsonl.read_fields(spark, path, ["image_id", "poi_prompt"])


@add("s4_dataset_scan", with_sql("sample", "SELECT fun_cls, count(*) AS n FROM sample GROUP BY fun_cls"))
def s4(spark, d):
    path = scratch_path(spark, "s4")
    sinks.write_jsonl(_records(spark, d), path)
    return jsonl.read_dataset(spark, path).groupBy(F.col("fun_cls").cast("int").alias("fun_cls")).agg(F.count(F.lit(1)).alias("n"))


@add("s5_csv_round_trip", with_sql("sample", "SELECT image_id, file_name, city, fun_cls, poi_num FROM sample"))
def s5(spark, d):
    path = scratch_path(spark, "s5")
    index = fx.samples(spark, d).select("image_id", "file_name", "city", "fun_cls", "poi_num")
    sinks.write_csv(index, path)
    return tabular.read_csv(spark, path, index.schema)


@add("s6_category_dimension", "SELECT DISTINCT p_type || ';' || p_brand AS type_2lvl, lower(p_type) AS name FROM part")
def s6(spark, d):
    path = scratch_path(spark, "s6")
    sinks.write_csv(fx.table(spark, d, "part").select(
        F.col("p_type").alias("Big_Category"), F.col("p_brand").alias("Mid_Category"), F.lower("p_type").alias("new_en")), path)
    return tabular.read_dimension(spark, path, ["Big_Category", "Mid_Category"], "new_en")


@add("s7_vector_round_trip", with_sql("building", "SELECT build_id, minx, miny, maxx, maxy, (maxx-minx)*(maxy-miny) AS area FROM building"))
def s7(spark, d):
    path = scratch_path(spark, "s7")
    ring = geo.ring_of_rect("minx", "miny", "maxx", "maxy")
    vector.write_features(fx.buildings(spark, d).select("build_id", ring.alias("ring")), path)
    back = vector.read_features(spark, path)
    return back.select("build_id", *[c.alias(n) for n, c in geo.ring_bounds("ring").items()], geo.ring_area("ring").alias("area"))


@add("s7_holes_and_parts", with_sql("building", """
    SELECT build_id, CASE build_id % 3 WHEN 2 THEN 2 ELSE 1 END AS parts, CASE build_id % 3 WHEN 1 THEN 1 ELSE 0 END AS holes,
        build_id % 3 = 0 AS plain, (maxx-minx)*(maxy-miny) + CASE build_id % 3 WHEN 1 THEN -24.0 WHEN 2 THEN 12.0 ELSE 0 END AS area FROM building"""))
def s7_parts(spark, d):
    """Outlines as a plain polygon, with a hole of 6 x 4, and with a second part of 3 x 4."""
    path = scratch_path(spark, "s7h")
    box = lambda a, b, c, e: F.regexp_extract(geo.ring_to_wkt(geo.ring_of_rect(F.expr(a), F.expr(b), F.expr(c), F.expr(e))), r"\((\(.*\))\)", 1)
    shell = box("minx", "miny", "maxx", "maxy")
    hole, part = box("minx + 2", "miny + 3", "minx + 8", "miny + 7"), box("maxx + 1", "miny", "maxx + 4", "miny + 4")
    wkt = F.when(F.col("build_id") % 3 == 1, F.concat(F.lit("POLYGON ("), shell, F.lit(", "), hole, F.lit(")"))).when(
        F.col("build_id") % 3 == 2, F.concat(F.lit("MULTIPOLYGON (("), shell, F.lit("), ("), part, F.lit("))"))).otherwise(F.concat(F.lit("POLYGON ("), shell, F.lit(")")))
    fx.buildings(spark, d).select("build_id", wkt.alias("wkt")).write.parquet(path)
    back = vector.read_features(spark, path)
    return back.select("build_id", F.size("polygons").alias("parts"), (F.aggregate("polygons", F.lit(0), lambda s, g: s + F.size(g)) - F.size("polygons")).alias("holes"),
                       F.col("ring").isNotNull().alias("plain"), geo.polygons_area("polygons").alias("area"))


@add("s8_box_scan", with_sql("poi", "SELECT poi_id, x, y FROM poi WHERE x BETWEEN 1000 AND 2500 AND y BETWEEN 4000 AND 6000"))
def s8(spark, d):
    path = scratch_path(spark, "s8")
    tabular.write_clustered(fx.pois(spark, d).select("poi_id", "x", "y"), path, 500.0)
    return tabular.read_box(spark, path, (1000.0, 4000.0, 2500.0, 6000.0))


@add("s9_layer_union", with_sql("candidate", """
    SELECT build_id AS id, cls AS "Matched_Func", NULL::VARCHAR AS note FROM building UNION ALL SELECT cand_id, func, 'candidate' FROM candidate"""))
def s9(spark, d):
    a, b = scratch_path(spark, "s9a"), scratch_path(spark, "s9b")
    fx.buildings(spark, d).select(F.col("build_id").alias("id"), F.col("cls").alias("Matched_Fu")).write.parquet(a)
    fx.candidates(spark, d).select(F.col("cand_id").alias("id"), F.col("func").alias("Matched_Func"), F.lit("candidate").alias("note")).write.parquet(b)
    return tabular.read_layers(spark, [a, b])


@add("s10_pair_listing", """
    SELECT s_suppkey, s_suppkey % 7 <> 3 AS has_mask, row_number() OVER (ORDER BY 's' || s_suppkey || '_') AS pos FROM supplier""")
def s10(spark, d):
    """A folder of images and one of masks, some missing; pairs by stem in the order of the image paths."""
    path = scratch_path(spark, "s10")
    stem = F.coalesce(F.concat(F.lit("s"), F.col("s_suppkey").cast("string"), F.lit("_")), F.lit("__HIVE_DEFAULT_PARTITION__"))
    files = fx.table(spark, d, "supplier").select(stem.alias("stem"), F.explode(F.when(F.col("s_suppkey") % 7 != 3, F.array(
        F.lit("img"), F.lit("ann"))).otherwise(F.array(F.lit("img")))).alias("kind"), F.lit("pixels").alias("value"))
    sinks.write_named(files.withColumn("name", F.concat("kind", F.lit("/stem="), "stem", F.lit(".txt"))), path, "name", "value")
    pairs = listing.pair_listing(spark, f"{path}/img", f"{path}/ann", ".txt", ".txt")
    named = pairs.select("img_path", F.regexp_extract("stem", r"stem=s(\d+)_$", 1).cast("long").alias("s_suppkey"), F.col("seg_map_path").isNotNull().alias("has_mask"))
    named = cut_lineage(named)  # the folders are scanned once, and not in each pass of the rank
    ranked = ranking.ordered_rank(named, ["img_path"], "pos")
    return ranked.select("s_suppkey", "has_mask", "pos")


@add("s11_name_list", with_sql("sample", """
    SELECT replace(file_name, '.tif', '') AS name, 'img/' || replace(file_name, '.tif', '') || '.jpg' AS img_path,
        'ann/' || replace(file_name, '.tif', '') || '.png' AS seg_map_path FROM sample"""))
def s11(spark, d):
    path = scratch_path(spark, "s11")
    fx.samples(spark, d).select(F.concat(F.regexp_replace("file_name", r"\.tif$", ""), F.lit("\n")).alias("value")).write.text(path)
    return listing.read_name_list(spark, path, "img", "ann")


@add("s12_pair_list", with_sql("sample", "SELECT 'rgb/' || image_id AS image, 'ann/' || image_id AS label FROM sample"))
def s12(spark, d):
    path = scratch_path(spark, "s12")
    k = F.col("image_id").cast("string")
    fx.samples(spark, d).select(F.concat(F.lit("rgb/"), k, F.lit("\t  ann/"), k).alias("value")).write.text(path)
    return listing.read_pair_list(spark, path)


@add("s13_nested_annotations", """
    SELECT 'img/' || p_partkey || '.png' AS img_path, 'ann/' || p_partkey || '.png' AS seg_map_path FROM part""")
def s13(spark, d):
    """Annotation files of a brand and a range of 10,000 keys, so that none grows with the table; a leading "./" is dropped on reading."""
    path = scratch_path(spark, "s13")
    k = F.col("p_partkey").cast("string")
    pair = F.struct(F.concat(F.lit("./img/"), k, F.lit(".png")).alias("image"), F.concat(F.lit("./ann/"), k, F.lit(".png")).alias("label"))
    files = fx.table(spark, d, "part").groupBy("p_brand", F.floor(F.col("p_partkey") / 10_000)).agg(F.collect_list(pair).alias("training"))
    files.select(F.to_json(F.struct("training")).alias("value")).write.option("maxRecordsPerFile", 1).text(path)
    return listing.read_nested_annotations(spark, path)


@add("s16_read_log", with_sql("train_log", """
    SELECT run, full_step, count(*) AS n, round(sum(metric), 4) AS total FROM (
      SELECT *, coalesce(last_value(CASE WHEN step <> 0 THEN step END IGNORE NULLS) OVER
        (PARTITION BY run ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING), 0) AS full_step FROM train_log) GROUP BY ALL"""))
def s16_file(spark, d):
    """Log files, one per run, written and read back with their own line numbers."""
    path = scratch_path(spark, "s16")
    lines = fx.train_log(spark, d).withColumn("value", F.to_json(F.struct("step", "metric")))
    name = F.concat(F.lit("run="), F.coalesce(F.col("run").cast("string"), F.lit("__HIVE_DEFAULT_PARTITION__")), F.lit(".txt"))
    sinks.write_named(lines.withColumn("name", name), path, "name", "value", ["ts", "event_id"])
    rows = logs.read_log(spark, path).where("metric = 'metric'")
    run = F.regexp_extract("run", r"run=(\d+)\.txt$", 1).cast("long")
    return rows.groupBy(run.alias("run"), "full_step").agg(F.count(F.lit(1)).alias("n"), F.round(F.sum(F.col("value").cast("double")), 4).alias("total"))


@add("s17_unicode_lines", "SELECT doc_id, text FROM documents")
def s17(spark, d):
    path = scratch_path(spark, "s17")
    sinks.write_jsonl(fx.table(spark, d, "documents").select("doc_id", "text"), path)
    schema = T.StructType([T.StructField("doc_id", T.LongType()), T.StructField("text", T.StringType())])
    return jsonl.read_strict(spark, path, schema, ["doc_id"])


@add("s18_feature_store", """
    SELECT vec_id, CASE WHEN label < 6 THEN 'train' WHEN label < 8 THEN 'val' ELSE 'test' END AS split,
        unnest(range(64))::INTEGER AS pos, round(unnest(embedding)::DOUBLE, 6) AS x FROM embeddings""")
def s18(spark, d):
    path = scratch_path(spark, "s18")
    split = F.when(F.col("label") < 6, "train").when(F.col("label") < 8, "val").otherwise("test")
    e = fx.table(spark, d, "embeddings").select("vec_id", split.alias("split"), "embedding")
    sinks.write_features(e, path, "vec_id")
    rows = spark.read.parquet(path).select("vec_id", "split", F.posexplode("embedding").alias("pos", "x"))
    return rows.withColumn("x", F.round(F.col("x").cast("double"), 6))


@add("s19_fused_dataset", """
    SELECT CASE WHEN label < 6 THEN 'train' WHEN label < 8 THEN 'val' ELSE 'test' END AS split, label, count(*) AS n FROM embeddings GROUP BY ALL""")
def s19(spark, d):
    path = scratch_path(spark, "s19")
    split = F.when(F.col("label") < 6, "train").when(F.col("label") < 8, "val").otherwise("test")
    e = fx.table(spark, d, "embeddings").select("vec_id", "label", split.alias("split"), F.col("embedding").alias("features"))
    sinks.write_features(e, path, "vec_id")
    return spark.read.parquet(path).groupBy("split", "label").agg(F.count(F.lit(1)).alias("n"))


@add("s20_metric_report", with_sql("pairs", """
    WITH c AS (SELECT gt, pred, count(*) AS n FROM pairs GROUP BY ALL), k AS (SELECT unnest([0,1,2]) AS c),
    r AS (SELECT c, sum(n) FILTER (gt=c AND pred=c) AS tp, sum(n) FILTER (gt=c) AS s, sum(n) FILTER (pred=c) AS p FROM c, k GROUP BY c),
    f AS (SELECT c, tp/(p+1e-10) AS pr, tp/(s+1e-10) AS re, s FROM r)
    SELECT 'class' AS section, c AS row, NULL::INTEGER AS col, 'precision' AS metric, round(pr,6) AS value FROM f
    UNION ALL SELECT 'class', c, NULL, 'recall', round(re,6) FROM f UNION ALL SELECT 'class', c, NULL, 'f1', round(2*pr*re/(pr+re+1e-10),6) FROM f
    UNION ALL SELECT 'class', c, NULL, 'support', s::DOUBLE FROM f
    UNION ALL SELECT 'confusion', g.c, p.c, 'count', coalesce(n,0)::DOUBLE FROM k g CROSS JOIN k p LEFT JOIN c ON c.gt = g.c AND c.pred = p.c"""))
def s20(spark, d):
    path = scratch_path(spark, "s20")
    m = metrics.confusion_matrix(fx.class_pairs(spark, d), 3)
    sinks.metric_report(metrics.class_report(m), m).coalesce(1).write.parquet(path)
    return spark.read.parquet(path).withColumn("value", F.round("value", 6))
