"""Record joins, strata, splits."""

from __future__ import annotations

from pyspark.sql import functions as F

from geoctx import fixtures as fx
from geoctx.catalog.base import Catalog
from geoctx.fixtures import with_sql
from geoctx.functions import clean
from geoctx.operators import lookup, ranking, sampling

CATALOG = Catalog()
add = CATALOG.add


def six(c):
    return F.round(c, 6)


# ---- joins -------------------------------------------------------------------

@add("j1_required_label", """
    WITH lab AS (SELECT o_orderkey AS k, 0 AS version, o_orderpriority AS label, o_totalprice AS score FROM orders
        UNION ALL SELECT o_orderkey, 1, 'revised', o_totalprice + 1 FROM orders WHERE o_orderstatus = 'P'),
    last AS (SELECT k, arg_max(label, version) AS label, arg_max(score, version) AS score FROM lab GROUP BY k)
    SELECT label, count(*) AS n, round(min(score), 2) AS lo, round(max(score), 2) AS hi
    FROM lineitem JOIN last ON l_orderkey = k GROUP BY label""")
def j1(spark, d):
    o = fx.table(spark, d, "orders")
    first = o.select(F.col("o_orderkey").alias("key"), F.lit(0).alias("version"),
                     F.col("o_orderpriority").alias("label"), F.col("o_totalprice").alias("score"))
    revised = o.where(F.col("o_orderstatus") == "P").select(
        F.col("o_orderkey").alias("key"), F.lit(1).alias("version"), F.lit("revised").alias("label"),
        (F.col("o_totalprice") + 1).alias("score"))
    labels = lookup.last_per_key(first.unionByName(revised), "key", ["version"], ["label", "score"])
    samples = fx.table(spark, d, "lineitem").select(F.col("l_orderkey").alias("key"))
    out = lookup.lookup_required(samples, labels, "key", ["label", "score"])
    return out.groupBy("label").agg(F.count(F.lit(1)).alias("n"), F.round(F.min("score"), 2).alias("lo"),
                                    F.round(F.max("score"), 2).alias("hi"))


@add("j2_category_map", """
    WITH dim AS (SELECT DISTINCT p_type || ';' || p_brand AS k, lower(p_type) || ' ' || lower(p_brand) AS en FROM part WHERE p_type <> 'PROMO')
    SELECT p_partkey, en AS type_en FROM part LEFT JOIN dim ON k = p_type || ';' || p_brand""")
def j2(spark, d):
    part = fx.table(spark, d, "part")
    dim = part.where(F.col("p_type") != "PROMO").select(
        F.concat_ws(";", "p_type", "p_brand").alias("type_2lvl"),
        F.concat_ws(" ", F.lower("p_type"), F.lower("p_brand")).alias("en")).distinct()
    pois = part.select("p_partkey", clean.two_levels(F.concat_ws(";", "p_type", "p_brand", "p_name")).alias("type_2lvl"))
    return lookup.map_category(pois, dim, "type_2lvl", "en", "type_en").select("p_partkey", "type_en")


@add("j8_assemble_modalities", """
    WITH e AS (SELECT vec_id, label, unnest(range(64)) AS i, round(unnest(embedding)::DOUBLE, 6) AS x FROM embeddings)
    SELECT vec_id, label, (i % 16)::INTEGER AS pos, max(x) FILTER (i // 16 = 0) AS rgb, max(x) FILTER (i // 16 = 1) AS texture,
        max(x) FILTER (i // 16 = 2) AS hog, max(x) FILTER (i // 16 = 3) AS text FROM e GROUP BY ALL""")
def j8(spark, d):
    e = fx.table(spark, d, "embeddings")
    parts = {
        name: e.select("vec_id", F.slice("embedding", 16 * i + 1, 16).alias(name))
        for i, name in enumerate(["rgb", "texture", "hog", "text"])
    }
    out = lookup.assemble(e.select("vec_id", "label"), parts, "vec_id")

    rows = out.select("vec_id", "label", F.posexplode(F.arrays_zip(*parts)).alias("pos", "v"))
    return rows.select("vec_id", "label", "pos", *[six(F.col(f"v.{name}").cast("double")).alias(name) for name in parts])


_SPLIT = "CASE image_id % 5 WHEN 0 THEN 'val' WHEN 1 THEN 'test' ELSE 'train' END"


def _index(spark, d):
    k = F.col("image_id") % 5
    return fx.samples(spark, d).select(
        "file_name", F.when(k == 0, "val").when(k == 1, "test").otherwise("train").alias("split"))


@add("j9_stamp_split", with_sql("sample", f"SELECT file_name, image_id, fun_cls, {_SPLIT} AS split FROM sample"))
def j9(spark, d):
    return fx.samples(spark, d).select("file_name", "image_id", "fun_cls").join(_index(spark, d), "file_name")


@add("j10_referenced_files", with_sql("sample", f"""
    SELECT file_name FROM sample WHERE fun_cls < 4"""))
def j10(spark, d):
    files = fx.samples(spark, d).select("file_name")
    return files.join(fx.samples(spark, d).where(F.col("fun_cls") < 4).select("file_name"), "file_name", "left_semi")


@add("j11_copy_plan", with_sql("sample", """
    SELECT file_name, CASE WHEN image_id % 5 = 0 THEN 'already_there' WHEN image_id % 7 = 0 THEN 'missing_at_source' ELSE 'copy' END AS status
    FROM sample"""))
def j11(spark, d):
    s = fx.samples(spark, d)
    return lookup.copy_plan(s, s.where(F.col("image_id") % 7 != 0), s.where(F.col("image_id") % 5 == 0), "file_name")


@add("j14_label_id_map", """
    WITH dim AS (SELECT 0 AS train_id, 7 AS label_id UNION ALL SELECT 1, 8 UNION ALL SELECT 2, 11)
    SELECT l_orderkey, l_linenumber, l_partkey, label_id FROM (SELECT *, CASE l_returnflag WHEN 'A' THEN 0 WHEN 'N' THEN 1 ELSE 2 END AS t FROM lineitem)
    JOIN dim ON t = train_id""")
def j14(spark, d):
    code = F.when(F.col("l_returnflag") == "A", 0).when(F.col("l_returnflag") == "N", 1).otherwise(2)
    li = fx.table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", code.alias("train_id"))
    dim = spark.createDataFrame([(0, 7), (1, 8), (2, 11)], "train_id int, label_id int")
    return lookup.map_category(li, dim, "train_id", "label_id", "label_id").drop("train_id")


# ---- statistics by class and stratum ----------------------------------------------

@add("a1_class_histogram", with_sql("sample", "SELECT fun_cls, count(*) AS n FROM sample GROUP BY fun_cls"))
def a1(spark, d):
    return sampling.class_counts(fx.samples(spark, d))


@add("a2_class_weights", with_sql("sample", """
    SELECT fun_cls, n, round(r / sum(r) OVER () * count(*) OVER (), 6) AS weight
    FROM (SELECT fun_cls, n, 1/sqrt(n / sum(n) OVER ()) AS r FROM (SELECT fun_cls, count(*) AS n FROM sample GROUP BY fun_cls))"""))
def a2(spark, d):
    return sampling.class_weights(fx.samples(spark, d)).withColumn("weight", six("weight"))


@add("a3_split_distribution", with_sql("sample", f"""
    WITH s AS (SELECT *, {_SPLIT} AS split FROM sample), c AS (SELECT split, city, count(*) AS n_city FROM s GROUP BY ALL),
    t AS (SELECT split, avg(poi_num) AS mean, median(poi_num) AS median, max(poi_num) AS mx FROM s GROUP BY split)
    SELECT split, city, n_city, (sum(n_city) OVER (PARTITION BY split))::BIGINT AS n_split,
        round(sum(n_city) OVER (PARTITION BY split) / sum(n_city) OVER (), 6) AS global_ratio,
        round(n_city / sum(n_city) OVER (PARTITION BY split), 6) AS city_share, round(mean, 6) AS mean, median, mx AS max
    FROM c JOIN t USING (split)"""))
def a3(spark, d):
    s = fx.samples(spark, d).join(_index(spark, d), "file_name")
    out = sampling.split_distribution(s)
    for c in ("global_ratio", "city_share", "mean"):
        out = out.withColumn(c, six(c))
    return out


def _combo(spark, d):
    bin8 = F.floor(F.col("poi_num") / 6).cast("int")
    return fx.samples(spark, d).withColumn("poi_bin", bin8)


@add("a4_drop_rare_strata", with_sql("sample", """
    SELECT image_id FROM (SELECT image_id, count(*) OVER (PARTITION BY city, fun_cls, poi_num) AS n FROM sample) WHERE n >= 3"""))
def a4(spark, d):
    return sampling.drop_rare(fx.samples(spark, d), ["city", "fun_cls", "poi_num"]).select("image_id")


@add("a7_first_by_coordinates", """
    SELECT x, y, min(id) AS id, arg_min(kind, id) AS kind FROM (
        SELECT l_suppkey AS x, l_linenumber AS y, l_orderkey * 100000 + l_partkey AS id, l_returnflag AS kind FROM lineitem) GROUP BY x, y""")
def a7(spark, d):
    li = fx.table(spark, d, "lineitem").select(
        F.col("l_suppkey").alias("x"), F.col("l_linenumber").alias("y"),
        (F.col("l_orderkey") * 100000 + F.col("l_partkey")).alias("id"), F.col("l_returnflag").alias("kind"))
    return lookup.first_per_key(li, ["x", "y"], ["id"], ["id", "kind"])


# ---- bins, one-hot, sampling, splits ----------------------------------------------

@add("m5_label_encode", "SELECT p_partkey, (dense_rank() OVER (ORDER BY p_type, p_brand) - 1)::BIGINT AS code FROM part")
def m5(spark, d):
    part = fx.table(spark, d, "part")
    classes = part.select("p_type", "p_brand").distinct()
    codes = ranking.ordered_rank(classes, ["p_type", "p_brand"], "r", 8).select(
        "p_type", "p_brand", (F.col("r") - 1).alias("code"))
    return part.join(codes, ["p_type", "p_brand"]).select("p_partkey", "code")


@add("m7_quantile_bins", with_sql("sample", """
    WITH e AS (SELECT list_sort(list_distinct(quantile_cont(poi_num, [0.0, 0.125, 0.25, 0.375, 0.5, 0.625, 0.75, 0.875, 1.0]))) AS q FROM sample)
    SELECT image_id, len(list_filter(q[2:len(q)-1], lambda t: t <= poi_num))::INTEGER AS poi_bin FROM sample, e"""))
def m7(spark, d):
    s = fx.samples(spark, d)
    return s.select("image_id", sampling.bin_of("poi_num", sampling.quantile_edges(s, "poi_num")).alias("poi_bin"))


_LLOYD = """
    vals AS (SELECT list(poi_num ORDER BY poi_num) AS vs, list(n ORDER BY poi_num) AS fs FROM (SELECT poi_num::DOUBLE AS poi_num, count(*)::DOUBLE AS n FROM sample GROUP BY 1)),
    RECURSIVE lloyd AS (
      SELECT 0 AS i, list_transform(range(10), lambda j: vs[1] + (vs[len(vs)] - vs[1]) / 10 * (j + 0.5::DOUBLE)) AS c, NULL::DOUBLE[] AS was FROM vals
      UNION ALL
      SELECT i + 1, list_sort(list_transform(range(10), lambda b: coalesce(
          list_sum(list_transform(list_filter(range(1, len(vs) + 1), lambda p: bins[p] = b), lambda p: vs[p] * fs[p]))
          / list_sum(list_transform(list_filter(range(1, len(vs) + 1), lambda p: bins[p] = b), lambda p: fs[p])), c[b + 1]))), c
      FROM (SELECT i, c, vs, fs, list_transform(vs, lambda v: len(list_filter(range(1, 10), lambda j: (c[j] + c[j + 1]) / 2 <= v))) AS bins
            FROM lloyd, vals WHERE was IS NULL OR c <> was)),
    settled AS (SELECT c FROM lloyd ORDER BY i DESC LIMIT 1)"""


@add("m8_kmeans_bins", with_sql("sample", """
    SELECT image_id, poi_num, len(list_filter(range(1, 10), lambda j: (c[j] + c[j + 1]) / 2 <= poi_num))::INTEGER AS poi_bin FROM sample, settled""", _LLOYD))
def m8(spark, d):
    s = fx.samples(spark, d)
    return s.select("image_id", "poi_num", sampling.bin_of("poi_num", sampling.kmeans_edges(s, "poi_num")).alias("poi_bin"))


@add("m9_one_hot", with_sql("sample", "SELECT image_id, " + ", ".join(
    [f"(city = '{c}')::INTEGER AS city_{c}" for c in fx.CITIES] + [f"(fun_cls = {i})::INTEGER AS fun_cls_{i}" for i in range(7)]
) + " FROM sample"))
def m9(spark, d):
    s = fx.samples(spark, d).select("image_id", "city", "fun_cls")
    return sampling.one_hot(s, {"city": fx.CITIES, "fun_cls": range(7)}).drop("city", "fun_cls")


_KEY = "((image_id % 2147483647 + 2147483647) % 2147483647 * 2654435761 + 42*40503) % 2147483647"


@add("m10_capped_sample", with_sql("sample", f"""
    WITH z AS (SELECT fun_cls, city, poi_num, count(*) AS n, CASE fun_cls WHEN 0 THEN 100 WHEN 5 THEN 60 WHEN 6 THEN 60 END AS cap FROM sample GROUP BY ALL),
    t AS (SELECT *, sum(n) OVER (PARTITION BY fun_cls) AS total FROM z),
    cut AS (SELECT *, round(cap*n/sum(n) OVER (PARTITION BY fun_cls), 9) AS e FROM t WHERE total > cap AND n >= 2),
    q1 AS (SELECT *, floor(e) AS q, round(e-floor(e), 9) AS f FROM cut),
    q2 AS (SELECT *, row_number() OVER (PARTITION BY fun_cls ORDER BY f DESC, city, poi_num) AS r,
        cap - sum(q) OVER (PARTITION BY fun_cls) AS rest FROM q1),
    quota AS (SELECT fun_cls, city, poi_num, q + (CASE WHEN r <= rest THEN 1 ELSE 0 END) AS quota FROM q2),
    rk AS (SELECT *, row_number() OVER (PARTITION BY fun_cls, city, poi_num ORDER BY {_KEY}, image_id) AS rn FROM sample)
    SELECT rk.image_id FROM rk JOIN t USING (fun_cls, city, poi_num) LEFT JOIN quota USING (fun_cls, city, poi_num)
    WHERE cap IS NULL OR total <= cap OR rn <= coalesce(quota, 0)"""))
def m10(spark, d):
    key = ranking.portable_key(F.col("image_id"))
    return sampling.capped_sample(fx.samples(spark, d), key, "image_id", caps={0: 100, 5: 60, 6: 60}).select("image_id")


@add("m11_stratified_split", with_sql("sample", f"""
    SELECT image_id, CASE WHEN rn <= round(n*0.6) THEN 'train' WHEN rn <= round(n*0.8) THEN 'val' ELSE 'test' END AS split FROM (
    SELECT image_id, row_number() OVER (PARTITION BY city, fun_cls, poi_num // 6 ORDER BY {_KEY}, image_id) AS rn,
        count(*) OVER (PARTITION BY city, fun_cls, poi_num // 6) AS n FROM sample)"""))
def m11(spark, d):
    key = ranking.portable_key(F.col("image_id"))
    return sampling.stratified_split(_combo(spark, d), key, "image_id", ["city", "fun_cls", "poi_bin"]).select("image_id", "split")


@add("m12_stratified_folds", with_sql("sample", f"""
    SELECT image_id, ((row_number() OVER (PARTITION BY fun_cls ORDER BY {_KEY}, image_id) - 1) % 5)::INTEGER AS fold FROM sample"""))
def m12(spark, d):
    key = ranking.portable_key(F.col("image_id"))
    return sampling.stratified_folds(fx.samples(spark, d), key, "image_id", "fun_cls").select("image_id", "fold")


@add("m14_per_class_sample", with_sql("sample", f"""
    SELECT image_id, fun_cls FROM (SELECT *, row_number() OVER (PARTITION BY fun_cls ORDER BY {_KEY}, image_id) AS rn FROM sample) WHERE rn <= 50"""))
def m14(spark, d):
    key = ranking.portable_key(F.col("image_id"))
    return sampling.per_class_sample(fx.samples(spark, d), key, "image_id", "fun_cls", 50).select("image_id", "fun_cls")


@add("m15_listed_split", """
    SELECT o_orderkey, CASE WHEN o_custkey IN (SELECT c_custkey FROM customer WHERE c_mktsegment = 'BUILDING') THEN 'train' ELSE 'val' END AS split FROM orders""")
def m15(spark, d):
    lists = fx.table(spark, d, "customer").where(F.col("c_mktsegment") == "BUILDING").select(
        F.col("c_custkey").alias("o_custkey"), F.lit("train").alias("split"))
    orders = fx.table(spark, d, "orders").select("o_orderkey", "o_custkey")
    return sampling.assign_listed_split(orders, lists, "o_custkey").select("o_orderkey", "split")


@add("w10_shuffle", with_sql("sample", f"SELECT image_id, row_number() OVER (ORDER BY {_KEY}, image_id) AS pos FROM sample"))
def w10(spark, d):
    key = ranking.portable_key(F.col("image_id"))
    return ranking.random_rank(fx.samples(spark, d).select("image_id"), [], key, "image_id", "pos")
