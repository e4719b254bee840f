"""Projections, filters, set operations, orderings and text functions."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from geoctx import fixtures as fx
from geoctx.catalog.base import Catalog
from geoctx.fixtures import with_sql
from geoctx.functions import clean, text
from geoctx.operators import lookup, ranking

CATALOG = Catalog()
add = CATALOG.add


# ---- projections and filters -------------------------------------------------

@add("p1_filter_city", with_sql("sample", "SELECT image_id, city, fun_cls FROM sample WHERE city = 'NJ'"))
def p1(spark, d):
    return fx.samples(spark, d).where(F.col("city") == "NJ").select("image_id", "city", "fun_cls")


@add("p2_prefix_id", with_sql("sample", "SELECT city || '_' || image_id AS build_key, poi_num FROM sample"))
def p2(spark, d):
    return fx.samples(spark, d).select(clean.prefixed_id("city", "image_id").alias("build_key"), "poi_num")


@add("p3_name_parts", with_sql("sample", r"""
    SELECT name, regexp_replace(name, '\.[^.]*$', '') AS stem,
        CASE WHEN instr(name, '_') > 0 THEN split_part(name, '_', 1) ELSE 'Unknown' END AS city,
        CASE WHEN instr(name, '_') > 0 THEN split_part(regexp_replace(name, '\.[^.]*$', ''), '_', 2) END AS id_part
    FROM (SELECT file_name AS name FROM sample UNION ALL SELECT s_name || '.tif' FROM supplier)"""))
def p3(spark, d):
    names = fx.samples(spark, d).select(F.col("file_name").alias("name")).unionByName(
        fx.table(spark, d, "supplier").select(F.concat("s_name", F.lit(".tif")).alias("name"))
    )
    return names.select("name", clean.stem("name").alias("stem"), clean.city_of("name").alias("city"),
                        clean.id_of("name").alias("id_part"))


@add("p4_id_from_file_name", with_sql("sample", "SELECT replace(file_name, '.tif', '') AS image_id, fun_cls FROM sample"))
def p4(spark, d):
    return fx.samples(spark, d).withColumn("image_id", clean.stem("file_name")).select("image_id", "fun_cls")


@add("p5_zero_based_class", with_sql("building", """
    SELECT build_id, cls || '.0' AS raw, cls - 1 AS fun_cls FROM building"""))
def p5(spark, d):
    b = fx.buildings(spark, d).select("build_id", F.concat(F.col("cls").cast("string"), F.lit(".0")).alias("raw"))
    return b.withColumn("fun_cls", clean.zero_based_class("raw"))


@add("p6_seven_to_three", with_sql("sample", """
    SELECT image_id, fun_cls, CASE WHEN fun_cls = 0 THEN 0 WHEN fun_cls <= 2 THEN 1 ELSE 2 END AS cls3 FROM sample"""))
def p6(spark, d):
    return fx.samples(spark, d).select("image_id", "fun_cls", clean.seven_to_three("fun_cls").alias("cls3"))


_RAW_TYPE = "p_type || ';' || p_brand || ';' || p_name"


def raw_types(spark, d):
    return fx.table(spark, d, "part").select(
        "p_partkey", F.concat_ws(";", "p_type", "p_brand", "p_name").alias("type")
    )


@add("p7_two_levels", f"""
    SELECT p_partkey, p_type || ';' || p_brand AS type_2lvl FROM part""")
def p7(spark, d):
    return raw_types(spark, d).select("p_partkey", clean.two_levels("type").alias("type_2lvl"))


@add("p8_match_flag", """
    WITH dim AS (SELECT DISTINCT p_type || ';' || p_brand AS k FROM part WHERE p_size > 45)
    SELECT p_partkey, CASE WHEN k IS NULL THEN 'not found' ELSE 'ok' END AS info
    FROM part LEFT JOIN dim ON p_type || ';' || p_brand = k""")
def p8(spark, d):
    part = fx.table(spark, d, "part")
    dim = part.where(F.col("p_size") > 45).select(
        F.concat_ws(";", "p_type", "p_brand").alias("type_2lvl"), F.lit(1).alias("code")).distinct()
    pois = raw_types(spark, d).withColumn("type_2lvl", clean.two_levels("type"))
    return lookup.map_category(pois, dim, "type_2lvl", "code", "hit").select(
        "p_partkey", clean.match_flag("hit").alias("info"))


@add("p9_points_in_extent", with_sql("poi", """
    SELECT poi_id, x, y FROM poi WHERE x BETWEEN 2000 AND 7000 AND y BETWEEN 1500 AND 8000"""))
def p9(spark, d):
    return clean.inside(fx.pois(spark, d), (2000.0, 1500.0, 7000.0, 8000.0)).select("poi_id", "x", "y")


@add("p11_aligned_lists", r"""
    WITH r AS (SELECT conv_id, turn, replace(text, '?', '') AS text FROM conversations),
    t AS (SELECT conv_id, turn, string_split(text, ' ') AS a, string_split(replace(text, '.', ' '), ' ') AS b FROM r)
    SELECT conv_id, turn, len(a)::INTEGER AS n_text, len(b)::INTEGER AS n_loc, len(a) = len(b) AS aligned FROM t""")
def p11(spark, d):
    spaced = F.replace("text", F.lit("."), F.lit(" "))
    turns = fx.table(spark, d, "conversations").withColumn("text", F.replace("text", F.lit("?"), F.lit("")))
    t = turns.select(
        "conv_id", "turn",
        text.pack(F.split("text", " ")).alias("poi_text"), text.pack(F.split(spaced, " ")).alias("poi_location"))
    a, b = text.packed_count("poi_text"), text.packed_count("poi_location")
    return t.select("conv_id", "turn", a.alias("n_text"), b.alias("n_loc"), (a == b).alias("aligned"))


@add("p11_violations", r"""
    SELECT conv_id, turn, len(a)::INTEGER AS n_text, len(b)::INTEGER AS n_location FROM (
        SELECT conv_id, turn, text, string_split(translate(text, '.,', '??'), '?') AS a, string_split(replace(text, '.', '?'), '?') AS b FROM conversations)
    WHERE text <> '' AND len(a) <> len(b)""")
def p11_violations(spark, d):
    """Packed lists of unequal length as a table: clauses between stops and commas, against sentences between stops."""
    turns = fx.table(spark, d, "conversations").select(
        "conv_id", "turn", F.translate("text", ".,", "??").alias("poi_text"), F.replace("text", F.lit("."), F.lit("?")).alias("poi_location"))
    return lookup.list_violations(turns, {"text": "poi_text", "location": "poi_location"}).select("conv_id", "turn", "n_text", "n_location")


@add("p12_plain_type", f"""
    SELECT p_partkey, CASE WHEN p_size = 13 THEN '' ELSE replace({_RAW_TYPE}, ';', ' ') END AS type_text FROM part""")
def p12(spark, d):
    t = fx.table(spark, d, "part").select(
        "p_partkey", F.when(F.col("p_size") != 13, F.concat_ws(";", "p_type", "p_brand", "p_name")).alias("type"))
    return t.select("p_partkey", clean.plain_type("type").alias("type_text"))


@add("p20_category_of_name", """
    WITH n AS (SELECT p_partkey, CASE WHEN p_size % 10 = 0 THEN '' ELSE lower(p_type) || '_' END || p_size || '.png' AS name FROM part),
    dim AS (SELECT t, row_number() OVER (ORDER BY t) - 1 AS id FROM (SELECT DISTINCT lower(p_type) AS t FROM part WHERE p_type <> 'PROMO'))
    SELECT p_partkey, name, coalesce(id, -1)::INTEGER AS category
    FROM n LEFT JOIN dim ON t = split_part(name, '_', 1) AND instr(name, '_') > 0""")
def p20(spark, d):
    part = fx.table(spark, d, "part")
    name = F.concat(F.when(F.col("p_size") % 10 == 0, "").otherwise(F.concat(F.lower("p_type"), F.lit("_"))),
                    F.col("p_size").cast("string"), F.lit(".png"))
    kinds = part.where(F.col("p_type") != "PROMO").select(F.lower("p_type").alias("kind")).distinct()
    dim = ranking.ordered_rank(kinds, ["kind"], "id", buckets=4).select("kind", (F.col("id") - 1).alias("id"))
    return (
        part.select("p_partkey", name.alias("name")).withColumn("kind", clean.category_of_name("name"))
        .join(dim, "kind", "left")
        .select("p_partkey", "name", F.coalesce("id", F.lit(-1)).cast("int").alias("category"))
    )


# ---- set operations --------------------------------------------------------

@add("u1_concat_lines", r"""
    WITH l AS (SELECT 'documents' AS src, unnest(string_split(text, chr(10))) AS line FROM documents
      UNION ALL SELECT 'conversations', unnest(string_split(text, chr(10))) FROM conversations)
    SELECT src, count(*) AS lines, sum(length(trim(line)))::BIGINT AS chars FROM l WHERE trim(line) <> '' GROUP BY src""")
def u1(spark, d):
    def lines(name):
        return fx.table(spark, d, name).select(F.lit(name).alias("src"), F.explode(F.split("text", "\n")).alias("line"))

    both = lines("documents").unionByName(lines("conversations")).withColumn("line", F.trim("line"))
    return both.where(F.col("line") != "").groupBy("src").agg(
        F.count(F.lit(1)).alias("lines"), F.sum(F.length("line")).alias("chars"))


@add("u2_concat_layers", with_sql("candidate", """
    SELECT 'ours' AS layer, build_id AS id, minx, miny, maxx, maxy FROM building
    UNION ALL SELECT 'theirs', cand_id, minx, miny, maxx, maxy FROM candidate"""))
def u2(spark, d):
    cols = ["minx", "miny", "maxx", "maxy"]
    a = fx.buildings(spark, d).select(F.lit("ours").alias("layer"), F.col("build_id").alias("id"), *cols)
    b = fx.candidates(spark, d).select(F.lit("theirs").alias("layer"), F.col("cand_id").alias("id"), *cols)
    return a.unionByName(b, allowMissingColumns=True)


@add("u3_list_difference", """
    SELECT o_custkey AS name FROM orders UNION SELECT c_custkey FROM customer EXCEPT SELECT l_suppkey FROM lineitem""")
def u3(spark, d):
    train = fx.table(spark, d, "orders").select(F.col("o_custkey").alias("name"))
    aug = fx.table(spark, d, "customer").select(F.col("c_custkey").alias("name"))
    val = fx.table(spark, d, "lineitem").select(F.col("l_suppkey").alias("name"))
    return train.unionByName(aug).distinct().subtract(val)


@add("u4_distinct_in_order", """
    SELECT event_type, user_id, min(event_id) AS first_at FROM events GROUP BY ALL""")
def u4(spark, d):
    return fx.table(spark, d, "events").groupBy("event_type", "user_id").agg(F.min("event_id").alias("first_at"))


@add("u5_class_subset", """
    SELECT DISTINCT l_returnflag AS name FROM lineitem WHERE l_returnflag NOT IN (SELECT o_orderstatus FROM orders)
    UNION SELECT DISTINCT l_linestatus FROM lineitem WHERE l_linestatus NOT IN (SELECT o_orderstatus FROM orders)""")
def u5(spark, d):
    li = fx.table(spark, d, "lineitem")
    custom = li.select(F.explode(F.array("l_returnflag", "l_linestatus")).alias("name"))
    known = fx.table(spark, d, "orders").select(F.col("o_orderstatus").alias("name"))
    return lookup.assert_subset(custom, known, "name")


# ---- orderings -------------------------------------------------------------

@add("o1_sorted_listing", with_sql("sample", "SELECT file_name FROM sample ORDER BY file_name"))
def o1(spark, d):
    return fx.samples(spark, d).select("file_name").orderBy("file_name")


@add("o2_first_n_by_name", with_sql("sample", """
    SELECT file_name, CASE WHEN row_number() OVER (ORDER BY file_name) <= 900 THEN 'training' ELSE 'validation' END AS part
    FROM sample"""))
def o2(spark, d):
    ranked = ranking.ordered_rank(fx.samples(spark, d).select("file_name"), ["file_name"], "pos")
    return ranked.select("file_name", F.when(F.col("pos") <= 900, "training").otherwise("validation").alias("part"))


@add("o3_top_terms", r"""
    WITH w AS (SELECT unnest(regexp_extract_all(lower(text), '[a-z]+')) AS term FROM documents)
    SELECT term, count(*) AS n FROM w WHERE length(term) BETWEEN 2 AND 15 GROUP BY term ORDER BY n DESC, term LIMIT 500""")
def o3(spark, d):
    words = fx.documents(spark, d).select(F.explode(text.word_tokens("text")).alias("term"))
    return words.groupBy("term").agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), "term").limit(500)


# ---- text, arrays, JSON ------------------------------------------------------

@add("f1_enumerate_words", """
    WITH g AS (SELECT user_id, list(DISTINCT event_type ORDER BY event_type) AS l FROM events GROUP BY user_id)
    SELECT user_id, CASE len(l) WHEN 1 THEN l[1] WHEN 2 THEN l[1] || ' and ' || l[2]
        ELSE array_to_string(l[1:len(l)-1], ', ') || ', and ' || l[len(l)] END AS words FROM g""")
def f1(spark, d):
    kinds = fx.table(spark, d, "events").groupBy("user_id").agg(
        F.array_sort(F.collect_set("event_type")).alias("kinds"))
    return kinds.select("user_id", text.enumerate_words("kinds").alias("words"))


@add("f5_word_tokens", r"""
    WITH w AS (SELECT doc_id, list_filter(regexp_extract_all(lower(text), '[a-z]+'), lambda t: length(t) BETWEEN 2 AND 15) AS t FROM documents)
    SELECT doc_id, len(t)::INTEGER AS n_tokens, array_to_string(t, ' ') AS tokens FROM w""")
def f5(spark, d):
    return fx.documents(spark, d).select("doc_id", text.word_tokens("text").alias("t")).select(
        "doc_id", F.size("t").alias("n_tokens"), F.array_join("t", " ").alias("tokens"))


_UNESCAPE = "replace(replace(replace(replace(replace({}, '&lt;', '<'), '&gt;', '>'), '&quot;', '\"'), '&#39;', ''''), '&amp;', '&')"


@add("f7_clean_text", rf"""
    SELECT page_id, lower(trim(regexp_replace({_UNESCAPE.format(_UNESCAPE.format('html'))}, '[ \t\n\r\f\x0B]+', ' ', 'g'))) AS clean
    FROM pages""")
def f7(spark, d):
    return fx.table(spark, d, "pages").select("page_id", text.clean_text("html").alias("clean"))


@add("f8_rewrite_names", """
    SELECT o_orderkey, 'leftImg/' || o_orderstatus || '_' || o_orderkey AS stem,
        'depth/' || o_orderkey || '.png' AS depth_name FROM orders""")
def f8(spark, d):
    key = F.col("o_orderkey").cast("string")
    t = fx.table(spark, d, "orders").select(
        "o_orderkey",
        F.concat(F.lit("leftImg/"), "o_orderstatus", F.lit("_"), key, F.lit("_gtFine_polygons.json")).alias("a"),
        F.concat(F.lit("depth/rgb/"), key, F.lit(".png")).alias("b"))
    return t.select("o_orderkey", text.strip_suffix("a", "_gtFine_polygons.json").alias("stem"),
                    F.replace("b", F.lit("/rgb"), F.lit("")).alias("depth_name"))


@add("f9_json_round_trip", """
    SELECT event_id, regexp_extract(props, '"k": *(-?[0-9]+)', 1)::INTEGER AS k,
        '{"event_type":"' || event_type || '","k":' || regexp_extract(props, '"k": *(-?[0-9]+)', 1) || '}' AS record
    FROM events""")
def f9(spark, d):
    schema = T.StructType([T.StructField("k", T.IntegerType())])
    t = fx.table(spark, d, "events").select("event_id", "event_type", F.from_json("props", schema).alias("p"))
    return t.select("event_id", F.col("p.k").alias("k"),
                    F.to_json(F.struct("event_type", F.col("p.k").alias("k"))).alias("record"))


@add("f10_label_map", """
    WITH o AS (SELECT p_type AS name, row_number() OVER (ORDER BY p_type) - 1 AS old_id FROM (SELECT DISTINCT p_type FROM part)),
    n AS (SELECT p_type AS name, row_number() OVER (ORDER BY p_type DESC) - 1 AS new_id
          FROM (SELECT DISTINCT p_type FROM part WHERE p_type NOT LIKE 'S%'))
    SELECT old_id, coalesce(new_id, 255)::INTEGER AS new_id FROM o LEFT JOIN n USING (name)""")
def f10(spark, d):
    kinds = fx.table(spark, d, "part").select(F.col("p_type").alias("name")).distinct()
    old = ranking.ordered_rank(kinds, ["name"], "r", 4).select("name", (F.col("r") - 1).alias("class_id"))
    w = Window.orderBy(F.desc("name"))  # a class list: a handful of rows
    new = kinds.where(~F.col("name").startswith("S")).select(
        "name", (F.row_number().over(w) - 1).alias("class_id"))
    return lookup.label_map(old, new)
