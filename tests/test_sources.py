"""Scans, sinks, listings, logs, named steps, lineage cutting."""

import json

import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as T

from geoctx import session
from geoctx.operators import lookup, scoring
from geoctx.functions import clean
from geoctx.schemas import SAMPLE_MIN
from geoctx.sources import jsonl, listing, logs, sinks, tabular, vector

SCHEMA = T.StructType([T.StructField("image_id", T.StringType()), T.StructField("fun_cls", T.IntegerType())])


def write(path, text, encoding="utf-8"):
    path.write_text(text, encoding=encoding)
    return str(path)


def test_lenient_scan(spark, tmp_path):
    p = write(tmp_path / "a.jsonl", '{"image_id": "京1", "fun_cls": 2}\n\n   \n{"image_id": "b", "fun_cls"\n{"image_id": "c"}\nnot json\n')
    good, bad = jsonl.read_lenient(spark, p, SCHEMA)
    assert sorted((r.image_id, r.fun_cls) for r in good.collect()) == [("c", None), ("京1", 2)]
    assert sorted(r.line for r in bad.collect()) == ["not json", '{"image_id": "b", "fun_cls"']


@pytest.mark.parametrize("text, message", [
    ('{"image_id": "a", "fun_cls": 1}\nbroken\n', "."),
    ('{"image_id": "a", "poi_prompt": "x"}\n', "required"),
    ("", "no records"),
])
def test_strict_scan_fails(spark, tmp_path, text, message):
    p = write(tmp_path / "a.jsonl", text)
    with pytest.raises(Exception, match=message):
        jsonl.read_strict(spark, p, SAMPLE_MIN, ["image_id", "poi_prompt", "fun_cls"]).collect()


def test_projected_scan_reads_only_its_fields(spark, tmp_path):
    p = write(tmp_path / "a.jsonl", '{"image_id": "a", "poi_prompt": "  x y ", "fun_cls": 1}\n{"image_id": "b"}\n')
    df = jsonl.read_fields(spark, p, ["image_id", "poi_prompt"])
    assert sorted(map(tuple, df.collect())) == [("a", "x y"), ("b", "")]
    assert "fun_cls" not in df._jdf.queryExecution().executedPlan().toString()


def test_csv_with_byte_order_mark(spark, tmp_path):
    p = write(tmp_path / "a.csv", "cityname,n\n南京,1\n", "utf-8-sig")
    df = tabular.read_csv(spark, p, T.StructType([T.StructField("cityname", T.StringType()), T.StructField("n", T.IntegerType())]))
    assert [tuple(r) for r in df.collect()] == [("南京", 1)]


def test_unicode_lines(spark, tmp_path):
    out = str(tmp_path / "o")
    sinks.write_jsonl(spark.createDataFrame([("南京 é",)], "t string"), out)
    text = "".join(f.read_text("utf-8") for f in (tmp_path / "o").glob("part-*"))
    assert "南京 é" in text and "\\u" not in text


def test_cut_names_and_missing_columns(spark, tmp_path):
    a, b = str(tmp_path / "a"), str(tmp_path / "b")
    spark.createDataFrame([(1, 0.5)], "id int, Match_Scor double").write.parquet(a)
    spark.createDataFrame([(2, 0.7, "x")], "id int, Match_Score double, note string").write.parquet(b)
    got = sorted(map(tuple, tabular.read_layers(spark, [a, b]).select("id", "Match_Score", "note").collect()))
    assert got == [(1, 0.5, None), (2, 0.7, "x")]
    assert tabular.layer_schema(spark, b).fieldNames() == ["id", "Match_Score", "note"]


def test_box_scan_is_pushed_down(spark, tmp_path):
    p = str(tmp_path / "p")
    tabular.write_clustered(spark.createDataFrame([(float(i), float(i)) for i in range(50)], "x double, y double"), p, 10.0)
    df = tabular.read_box(spark, p, (5.0, 5.0, 9.0, 30.0))
    assert df.count() == 5
    assert "GreaterThanOrEqual(x,5.0)" in df._jdf.queryExecution().executedPlan().toString()


def test_vector_projection(spark, tmp_path):
    p = str(tmp_path / "v")
    spark.createDataFrame([(1, "POLYGON ((0 0, 1 0, 1 1, 0 0))")], "id int, wkt string").write.parquet(p)
    ring = vector.read_features(spark, p, crs=4326).first().ring
    assert ring[1].x == pytest.approx(111319.4908) and ring[2].y == pytest.approx(111325.1429)
    with pytest.raises(ValueError):
        vector.read_features(spark, p, crs=32650)


def test_feature_store_reads_one_sample(spark, tmp_path):
    p = str(tmp_path / "f")
    sinks.write_features(spark.createDataFrame([("train", f"i{i}", [float(i)]) for i in range(9)], "split string, image_id string, v array<double>"), p)
    one = sinks.read_feature(spark.read.parquet(p), "train", "image_id", "i3")
    assert one.first().v == [3.0]
    plan = one._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [isnotnull(split" in plan and "EqualTo(image_id,i3)" in plan


def test_listing_pairs_by_stem(spark, tmp_path):
    for d, names in (("img", ["b.png", "a.png", "sub/c.png", "x.txt"]), ("img2", ["a.png", "b.png", "sub/c.png"]), ("ann", ["a_seg.png", "sub/c_seg.png"])):
        for n in names:
            f = tmp_path / d / n
            f.parent.mkdir(parents=True, exist_ok=True)
            f.write_bytes(b"x")
    img, img2, ann = (str(tmp_path / d) for d in ("img", "img2", "ann"))
    got = listing.pair_listing(spark, img, ann, ".png", "_seg.png").collect()
    assert [(r.stem, r.seg_map_path is not None) for r in got] == [("a", True), ("b", False), ("sub/c", True)]
    both = listing.pair_listing(spark, img, ann, ".png", "_seg.png", img2).collect()
    assert all(r.img_path2.endswith(r.stem + ".png") for r in both) and len(both) == 3


def test_named_files(spark, tmp_path):
    """A file per name, its lines in order, and no folder, task file or rename per name."""
    rows = [(f"a/{i % 7}.txt", i, f"é{i}") for i in range(30_000)] + [("b/x.txt", 0, None)]
    df = spark.createDataFrame(rows, "name string, i int, value string").repartition(5)
    assert sinks.write_named(df, f"file:{tmp_path}/out", "name", "value", ["i"]) == 8
    assert sorted(p.relative_to(tmp_path / "out").as_posix() for p in (tmp_path / "out").rglob("*.txt")) == [f"a/{k}.txt" for k in range(7)] + ["b/x.txt"]
    assert (tmp_path / "out/a/3.txt").read_text(encoding="utf-8").splitlines() == [f"é{i}" for i in range(30_000) if i % 7 == 3]
    assert (tmp_path / "out/b/x.txt").read_text() == "\n"
    assert sinks.write_named(df.limit(0), str(tmp_path / "none"), "name", "value") == 0


@pytest.mark.parametrize("name", ["s10_pair_listing", "s16_read_log"])
def test_no_folder_per_file(spark, tmp_path, monkeypatch, name):
    from geoctx.catalog import files

    monkeypatch.setattr(files, "scratch_path", lambda *_: str(tmp_path / "w"))
    found = files.CATALOG.queries[name](spark, "/root/testdata/sf0.001").collect()
    assert found and not [p for p in tmp_path.glob("w/*/*") if p.is_dir()]
    assert not [p for p in tmp_path.glob("w/*=*") if p.is_dir()]


def test_name_and_pair_lists(spark, tmp_path):
    p = write(tmp_path / "l.txt", "a\n\n b \n")
    assert [r.img_path for r in listing.read_name_list(spark, p, "i", "m").collect()] == ["i/a.jpg", "i/b.jpg"]
    p = write(tmp_path / "q.txt", "x.jpg   y.png\nu.jpg\tv.png\n")
    assert [tuple(r) for r in listing.read_pair_list(spark, p).collect()] == [("x.jpg", "y.png"), ("u.jpg", "v.png")]


def test_nested_annotations(spark, tmp_path):
    doc = {"training": [{"image": "./a.nii", "label": "./l/a.nii"}, {"image": "b.nii", "label": "lb.nii"}],
           "test": ["./t1.nii", "t2.nii"], "labels": {"0": "background", "1": "cancer"}}
    p = write(tmp_path / "d.json", json.dumps(doc, indent=2))
    assert [tuple(r) for r in listing.read_nested_annotations(spark, p).collect()] == [("a.nii", "l/a.nii"), ("b.nii", "lb.nii")]
    assert [tuple(r) for r in listing.read_nested_annotations(spark, p, False).collect()] == [("t1.nii", None), ("t2.nii", None)]
    assert sorted(map(tuple, listing.annotation_labels(spark, p).collect())) == [(0, "background"), (1, "cancer")]


def test_log_scan(spark, tmp_path):
    lines = ['{"loss": 1.5, "step": 10}', '{"lr": 0.1}', '{"loss": 1.0, "step": 20, "lr": 0.2}', '{"mIoU": 50.0, "step": 0}']
    write(tmp_path / "a.json", "\n".join(lines) + "\n")
    write(tmp_path / "b.json", '{"loss": 3.0}\n{"loss": 2.0, "step": 5}\n')
    got = [(r.run.rsplit("/", 1)[1], r.full_step, r.metric, float(r.value)) for r in logs.read_log(spark, str(tmp_path)).collect()]
    assert sorted(got) == sorted([
        ("a.json", 10, "loss", 1.5), ("a.json", 10, "lr", 0.1), ("a.json", 20, "loss", 1.0), ("a.json", 20, "lr", 0.2),
        ("a.json", 20, "mIoU", 50.0), ("b.json", 0, "loss", 3.0), ("b.json", 5, "loss", 2.0)])


def test_log_scan_over_several_splits(spark, tmp_path):
    text = "".join(json.dumps({"loss": float(i), **({"step": i} if i % 10 == 0 and i else {})}) + "\n" for i in range(400))
    p = write(tmp_path / "a.json", text)
    old = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "1024")
    try:
        df = logs.read_log(spark, p)
        got = {float(r.value): r.full_step for r in df.collect()}
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", old)
    assert got == {float(i): i // 10 * 10 for i in range(400)}


# ---- joins that must fail or report -------------------------------------------------

def test_missing_label_fails(spark):
    df = spark.createDataFrame([("a",), ("b",)], "k string")
    labels = spark.createDataFrame([("a", 1)], "k string, label int")
    assert lookup.lookup_required(df.where("k = 'a'"), labels, "k", ["label"]).first().label == 1
    with pytest.raises(Exception, match="no label for k b"):
        lookup.lookup_required(df, labels, "k", ["label"]).collect()


def test_last_label_wins(spark):
    df = spark.createDataFrame([("a", 1, 5), ("a", 2, 7), ("b", 1, 9)], "k string, at int, label int")
    assert sorted(map(tuple, lookup.last_per_key(df, "k", ["at"], ["label"]).collect())) == [("a", 7), ("b", 9)]


def test_verified_copy(spark):
    t = spark.createDataFrame([("a", "x"), ("b", "y"), ("c", "z")], "k string, text string")
    s = spark.createDataFrame([("a", "x", "L1"), ("b", "other", "L2")], "k string, text string, loc string")
    got = {r.k: (r.copy_status, r.loc) for r in lookup.verified_copy(t, s, "k", ["text"], "loc").collect()}
    assert got == {"a": ("matched", "L1"), "b": ("mismatch", None), "c": ("missing", None)}


def test_class_collapse(spark):
    df = spark.createDataFrame([(c,) for c in (0, 1, 2, 3, 6)], "c int")
    assert [r[0] for r in df.select(clean.seven_to_three("c")).collect()] == [0, 1, 1, 2, 2]


# ---- steps and lineage ------------------------------------------------------------

def test_named_steps(spark):
    steps = scoring.Steps()

    @steps.register("add")
    def add(df, n):
        return df.withColumn("v", F.col("v") + n)

    @steps.register("keep")
    def keep(df, low):
        return df.where(F.col("v") >= low)

    run = steps.compose([{"type": "add", "n": 2}, {"type": "keep", "low": 4}])
    assert [r.v for r in run(spark.createDataFrame([(1,), (2,), (3,)], "v long")).collect()] == [4, 5]
    with pytest.raises(KeyError):
        steps.compose([{"type": "nope"}])
    with pytest.raises(KeyError):
        steps.register("add")(add)


def test_lineage_is_cut(spark):
    df = session.cut_lineage(spark.range(10).withColumn("v", F.col("id") * 2))
    assert "Range" not in df._jdf.queryExecution().optimizedPlan().toString()
    assert df.count() == 10


def test_scratch_tables_go_where_the_session_says(spark, tmp_path):
    spark.conf.set("spark.sql.shuffle.partitions", spark.conf.get("spark.sql.shuffle.partitions"))
    a, b = session.scratch_path(spark, "x"), session.scratch_path(spark, "x")
    assert a != b

    class Conf:
        def get(self, name, default=None):
            return str(tmp_path) if name == "spark.checkpoint.dir" else default

    class Context:
        master = "yarn"

    class Cluster:
        conf, sparkContext = Conf(), Context()

    assert session.scratch_path(Cluster(), "x").startswith(str(tmp_path))
    Conf.get = lambda self, name, default=None: default
    with pytest.raises(ValueError, match="spark.checkpoint.dir"):
        session.scratch_path(Cluster(), "x")


def test_spread_only_touches_scans_with_few_tasks(spark, tmp_path):
    few, many = str(tmp_path / "few"), str(tmp_path / "many")
    spark.range(100).coalesce(1).write.parquet(few)
    spark.range(100).repartition(40).write.parquet(many)
    cores = spark.sparkContext.defaultParallelism
    assert session.spread(spark.read.parquet(few), "id").rdd.getNumPartitions() == cores
    old = spark.conf.get("spark.sql.files.openCostInBytes")
    spark.conf.set("spark.sql.files.openCostInBytes", str(128 << 20))
    try:
        df = spark.read.parquet(many)
        assert session.spread(df, "id") is df
    finally:
        spark.conf.set("spark.sql.files.openCostInBytes", old)


def test_nested_annotation_files_hold_a_bounded_number_of_pairs(spark, monkeypatch):
    from geoctx.catalog import files

    parts = spark.range(25_000).selectExpr("id AS p_partkey", "'Brand#1' AS p_brand")
    monkeypatch.setattr(files.fx, "table", lambda *_: parts)
    pairs = files.s13(spark, None)
    assert pairs.count() == pairs.distinct().count() == 25_000
    assert len(pairs.inputFiles()) >= 3
