"""Text and vector features, scoring."""

from __future__ import annotations

from pyspark.sql import functions as F

from geoctx import fixtures as fx
from geoctx.catalog.base import Catalog
from geoctx.operators import features, fold_models, metrics, ranking, sampling, scoring
from geoctx.session import cut_lineage

CATALOG = Catalog()
add = CATALOG.add

# --- fixed values: a short stop list both engines share ---
STOP_WORDS = "a an and are as at be by for from has have in is it of on or that the this to was were with".split()
# --- end of fixed values ---
_STOPS = ", ".join(f"'{w}'" for w in STOP_WORDS)

TERMS = f"""kept AS (SELECT doc_id, list_filter(regexp_extract_all(lower(text), '[a-z]+'), lambda t: length(t) >= 2 AND t NOT IN ({_STOPS})) AS w FROM documents),
    term AS (SELECT doc_id, unnest(w) AS term FROM kept UNION ALL
        SELECT doc_id, unnest(list_transform(range(1, len(w)), lambda i: w[i] || ' ' || w[i+1])) FROM kept),
    tf AS (SELECT doc_id, term, count(*) AS tf FROM term GROUP BY ALL),
    vocab AS (SELECT term, sum(tf)::BIGINT AS total, count(*) AS df, ln((1 + (SELECT count(*) FROM documents)) / (1 + count(*))) + 1 AS idf
        FROM tf GROUP BY term ORDER BY total DESC, term LIMIT 5000)"""


def _docs(spark, d):
    return fx.documents(spark, d)


@add("m1_tfidf_vocabulary", f"WITH {TERMS} SELECT term, total, df, round(idf, 6) AS idf FROM vocab")
def m1v(spark, d):
    return features.fit_tfidf(_docs(spark, d), "doc_id", "text", STOP_WORDS).withColumn("idf", F.round("idf", 6))


@add("m1_tfidf", f"""
    WITH {TERMS}, w AS (SELECT doc_id, term, tf*idf AS w FROM tf JOIN vocab USING (term))
    SELECT doc_id, term, round(w / sqrt(sum(w*w) OVER (PARTITION BY doc_id)), 6) AS weight FROM w""")
def m1(spark, d):
    docs = _docs(spark, d)
    vocabulary = features.fit_tfidf(docs, "doc_id", "text", STOP_WORDS)
    return features.tfidf_weights(docs, vocabulary, "doc_id", "text", STOP_WORDS).withColumn("weight", F.round("weight", 6))


@add("m1_tfidf_train_split", f"""
    WITH {TERMS.replace("FROM tf GROUP BY term", "FROM tf JOIN labels USING (doc_id) GROUP BY term").replace("(SELECT count(*) FROM documents)", "(SELECT count(*) FROM documents JOIN labels USING (doc_id))")},
    w AS (SELECT doc_id, term, tf*idf AS w FROM tf JOIN vocab USING (term))
    SELECT doc_id, term, round(w / sqrt(sum(w*w) OVER (PARTITION BY doc_id)), 6) AS weight FROM w""")
def m1_train(spark, d):
    """Vocabulary and document frequencies from the training documents (those with labels), weights for all."""
    docs = _docs(spark, d)
    train = docs.join(fx.table(spark, d, "labels").select("doc_id"), "doc_id")
    vocabulary = features.fit_tfidf(train, "doc_id", "text", STOP_WORDS)
    return features.tfidf_weights(docs, vocabulary, "doc_id", "text", STOP_WORDS).withColumn("weight", F.round("weight", 6))


VOCAB = """voc AS (SELECT token, (length(token)*31 + ascii(token)) % (SELECT count(*) FROM embeddings) AS vec_id FROM (
    SELECT DISTINCT unnest(regexp_extract_all(lower(text), '[a-z]+')) AS token FROM benchmark) WHERE length(token) BETWEEN 2 AND 15),
    tok AS (SELECT doc_id, unnest(range(len(t))) AS pos, unnest(t) AS token FROM (
        SELECT doc_id, list_filter(regexp_extract_all(lower(text), '[a-z]+'), lambda t: length(t) BETWEEN 2 AND 15) AS t FROM documents)),
    known AS (SELECT doc_id, pos, token, vec_id FROM tok JOIN voc USING (token))"""


def _vocab(spark, d):
    """Words of the benchmark texts, each given one of the embedding vectors."""
    from geoctx.functions import text

    words = fx.table(spark, d, "benchmark").select(F.explode(text.word_tokens("text")).alias("token")).distinct()
    n = fx.table(spark, d, "embeddings").agg(F.count(F.lit(1)).alias("n"))
    return words.join(n).select("token", ((F.length("token") * 31 + F.ascii("token")) % F.col("n")).cast("long").alias("vec_id"))


@add("j12_token_vectors", f"""
    WITH {VOCAB} SELECT token, vec_id, n, unnest(range(64))::INTEGER AS pos, round(unnest(embedding)::DOUBLE, 6) AS x
    FROM (SELECT token, vec_id, count(*) AS n FROM known GROUP BY ALL) JOIN embeddings USING (vec_id)""")
def j12(spark, d):
    known = features.known_tokens(_docs(spark, d), _vocab(spark, d), "doc_id", "text")
    counts = known.groupBy("token", "vec_id").agg(F.count(F.lit(1)).alias("n"))
    return counts.join(fx.table(spark, d, "embeddings"), "vec_id").select(
        "token", "vec_id", "n", F.posexplode("embedding").alias("pos", "x")).withColumn("x", F.round(F.col("x").cast("double"), 6))


@add("a25_mean_vectors", f"""
    WITH {VOCAB}, e AS (SELECT vec_id, unnest(range(64)) AS pos, unnest(embedding)::DOUBLE AS x FROM embeddings),
    m AS (SELECT doc_id, e.pos AS pos, avg(x) AS v FROM known JOIN e USING (vec_id) GROUP BY ALL)
    SELECT doc_id, pos::INTEGER AS pos, round(coalesce(v, 0), 5) AS v FROM (SELECT doc_id, unnest(range(64)) AS pos FROM documents) LEFT JOIN m USING (doc_id, pos)""")
def a25(spark, d):
    v = features.mean_vectors(_docs(spark, d), _vocab(spark, d), fx.table(spark, d, "embeddings"), "doc_id", "text", 64)
    return v.select("doc_id", F.posexplode("vector").alias("pos", "v")).withColumn("v", F.round("v", 5))


@add("f6_token_sequences", f"""
    WITH {VOCAB}, r AS (SELECT doc_id, vec_id, row_number() OVER (PARTITION BY doc_id ORDER BY pos) AS r FROM known),
    s AS (SELECT doc_id, count(*)::INTEGER AS n, string_agg(vec_id::VARCHAR, ' ' ORDER BY r) AS ids FROM r WHERE r <= 64 GROUP BY doc_id)
    SELECT doc_id, coalesce(n, 0) AS length, trim(coalesce(ids, '') || repeat(' -1', 64 - coalesce(n, 0))) AS ids FROM documents LEFT JOIN s USING (doc_id)""")
def f6(spark, d):
    s = features.token_sequences(_docs(spark, d), _vocab(spark, d), "doc_id", "text")
    return s.select("doc_id", "length", F.array_join(F.transform("ids", lambda i: i.cast("string")), " ").alias("ids"))


# ---- dense features ------------------------------------------------------------

def _emb(spark, d):
    return fx.table(spark, d, "embeddings")


@add("m2_standardise", """
    WITH x AS (SELECT vec_id, unnest(range(64)) AS pos, unnest(embedding)::DOUBLE AS v FROM embeddings),
    fit AS (SELECT pos, avg(v) AS m, stddev_pop(v) AS s FROM x JOIN embeddings USING (vec_id) WHERE label < 6 GROUP BY pos),
    z AS (SELECT vec_id, pos, (v - m) / s AS z FROM x JOIN fit USING (pos))
    SELECT vec_id, pos::INTEGER AS pos, round(z / sqrt(sum(z*z) OVER (PARTITION BY vec_id)), 5) AS x FROM z""")
def m2(spark, d):
    e = features.as_vector(_emb(spark, d).select("vec_id", "label", "embedding"), "embedding")
    out = features.standardise(e, features.fit_scaler(e.where("label < 6"), "embedding"), "embedding")  # labels 0-5: the training split
    return out.select("vec_id", F.posexplode("embedding").alias("pos", "x")).withColumn("x", F.round("x", 5))


_SCALED = """x AS (SELECT vec_id, label, unnest(range(64)) AS pos, unnest(embedding)::DOUBLE AS v FROM embeddings),
    fit AS (SELECT pos, avg(v) AS m, stddev_samp(v) AS s FROM x WHERE label < 6 GROUP BY pos),
    z AS (SELECT vec_id, label, pos, (v - m) / s AS z FROM x JOIN fit USING (pos))"""


def _pca(spark, d):
    """Columns scaled by the training rows (labels 0-5), and the components of those rows: 256 or as many as there are columns."""
    e = features.as_vector(_emb(spark, d).select("vec_id", "label", "embedding"), "embedding")
    scaled = features.scaled(e, features.fit_scaler(e.where("label < 6"), "embedding"), "embedding")
    return scaled, features.fit_pca(scaled.where("label < 6"), "embedding", min(256, 64))


@add("m3_pca", f"""
    WITH {_SCALED}, a AS (SELECT pos, z AS a FROM z WHERE vec_id = (SELECT min(vec_id) FROM embeddings))
    SELECT vec_id, round(sum(z*z), 5) AS length2, round(sum(z*a), 5) AS dot FROM z JOIN a USING (pos) GROUP BY vec_id""")
def m3(spark, d):
    """All components: what a rotation must leave alone, the squared length of each projected row and its product with the first row."""
    scaled, model = _pca(spark, d)
    p = features.project(scaled, model, "embedding", unit=False).select("vec_id", "embedding")
    first = p.orderBy("vec_id").limit(1).collect()  # one row
    a = F.array(*[F.lit(float(v)) for v in first[0].embedding]) if first else F.col("embedding")
    total = lambda c: F.aggregate(c, F.lit(0.0), lambda s, v: s + v)
    return p.select("vec_id", F.round(total(F.transform("embedding", lambda v: v * v)), 5).alias("length2"),
                    F.round(total(F.zip_with("embedding", a, lambda u, v: u * v)), 5).alias("dot"))


@add("m3_pca_spectrum", f"""
    WITH {_SCALED}, t AS (SELECT * FROM z WHERE label < 6), n AS (SELECT count(DISTINCT vec_id) - 1 AS n FROM t),
    c AS (SELECT a.pos AS i, b.pos AS j, sum(a.z*b.z) / any_value(n.n) AS c FROM t a JOIN t b USING (vec_id) CROSS JOIN n GROUP BY ALL),
    c2 AS (SELECT a.i, b.j, sum(a.c*b.c) AS c FROM c a JOIN c b ON a.j = b.i GROUP BY ALL), tr AS (SELECT sum(c) AS t FROM c WHERE i = j)
    SELECT 1 AS power, 1.0::DOUBLE AS share UNION ALL SELECT 2, round((SELECT sum(c*c) FROM c) / t / t, 8) FROM tr
    UNION ALL SELECT 3, round((SELECT sum(c.c*c2.c) FROM c JOIN c2 ON c.i = c2.j AND c.j = c2.i) / t / t / t, 8) FROM tr""")
def m3_spectrum(spark, d):
    """Sums of powers of the explained shares: the traces of the covariance and its powers, over powers of its trace."""
    shares = [float(v) for v in _pca(spark, d)[1].explainedVariance]  # a number per column
    rows = [(k, round(sum(v ** k for v in shares), 8)) for k in (1, 2, 3)]
    return spark.createDataFrame(rows, "power int, share double")


@add("m4_truncated_svd")
def m4(spark, d):
    """5,000 terms to 256 columns; a singular vector has no sign, so sizes are shown."""
    docs = _docs(spark, d)
    vocabulary = features.fit_tfidf(docs, "doc_id", "text", STOP_WORDS, 5000)
    rows = cut_lineage(features.sparse_rows(features.tfidf_weights(docs, vocabulary, "doc_id", "text", STOP_WORDS), vocabulary, "doc_id"))
    v, _ = features.fit_svd(rows, vocabulary.count(), 256)
    return features.project_svd(rows, v).select("doc_id", F.posexplode("features").alias("pos", "x")).withColumn(
        "x", F.round(F.abs("x"), 4))


@add("m6_fusion", """
    SELECT vec_id, 64 AS size, round(list_sum(list_transform(range(1,65), lambda i: i*embedding[i]::DOUBLE)), 5) AS weighted FROM embeddings""")
def m6(spark, d):
    e = _emb(spark, d)
    for i, name in enumerate(["rgb", "texture", "hog", "text"]):
        e = e.withColumn(name, F.slice("embedding", 16 * i + 1, 16))
    fused = features.fuse(e.drop("embedding"), ["rgb", "texture", "hog", "text"])
    weighted = F.aggregate(F.transform("features", lambda v, i: v.cast("double") * (i + 1)), F.lit(0.0), lambda s, v: s + v)
    return fused.select("vec_id", F.size("features").alias("size"), F.round(weighted, 5).alias("weighted"))


@add("x2_named_steps", """
    WITH x AS (SELECT vec_id, label, unnest(range(64)) AS pos, unnest(embedding)::DOUBLE AS v FROM embeddings WHERE label < 8),
    f AS (SELECT vec_id, label, CASE WHEN label % 2 = 1 THEN 63 - pos ELSE pos END AS pos, v FROM x),
    c AS (SELECT vec_id, pos, least(greatest((v - 0.05) / 0.5, -1.0), 1.0) AS v FROM f)
    SELECT vec_id, pos::INTEGER AS pos, round(v, 5) AS x FROM c""")
def x2(spark, d):
    """Steps by name from a configuration: keep classes, turn samples of odd classes round, normalise, clip."""
    steps = scoring.Steps()
    steps.register("keep_classes")(lambda df, below: df.where(F.col("label") < below))
    steps.register("flip")(lambda df, odd: df.withColumn("x", F.when(F.col("label") % 2 == odd, F.reverse("x")).otherwise(F.col("x"))))
    steps.register("normalise")(lambda df, mean, std: df.withColumn("x", F.transform("x", lambda v: (v - mean) / std)))
    steps.register("clip")(lambda df, low, high: df.withColumn("x", F.transform("x", lambda v: F.least(F.greatest(v, F.lit(low)), F.lit(high)))))
    run = steps.compose([
        {"type": "keep_classes", "below": 8}, {"type": "flip", "odd": 1},
        {"type": "normalise", "mean": 0.05, "std": 0.5}, {"type": "clip", "low": -1.0, "high": 1.0}])
    samples = _emb(spark, d).select("vec_id", "label", F.transform("embedding", lambda v: v.cast("double")).alias("x"))
    return run(samples).select("vec_id", F.posexplode("x").alias("pos", "x")).withColumn("x", F.round("x", 5))


@add("x3_metric_plug_in", """
    WITH p AS (SELECT s.pred, s.gt, s.n FROM (SELECT gt, pred, count(*) AS n FROM (
        SELECT quality AS gt, toxic AS pred FROM labels UNION ALL SELECT toxic, quality FROM labels) GROUP BY ALL) s),
    k AS (SELECT unnest([0, 1]) AS c),
    r AS (SELECT c, coalesce(sum(n) FILTER (gt=c AND pred=c), 0) AS tp, coalesce(sum(n) FILTER (gt=c), 0) AS support, coalesce(sum(n) FILTER (pred=c), 0) AS predicted FROM p, k GROUP BY c),
    f AS (SELECT *, tp/(predicted+1e-10) AS precision, tp/(support+1e-10) AS recall FROM r),
    g AS (SELECT *, 2*precision*recall/(precision+recall+1e-10) AS f1 FROM f)
    SELECT round(avg(f1)*100, 5) AS macro_f1, round(avg(precision)*100, 5) AS macro_precision, round(avg(recall)*100, 5) AS macro_recall,
        round(sum(f1*support)/sum(support)*100, 5) AS weighted_f1, round(sum(tp)/sum(support)*100, 5) AS overall_acc FROM g""")
def x3(spark, d):
    """A registered metric over two batches: partials of each, merged, then the final figures."""
    labels = fx.table(spark, d, "labels")
    batches = [labels.select(F.col("quality").alias("gt"), F.col("toxic").alias("pred")), labels.select(F.col("toxic").alias("gt"), F.col("quality").alias("pred"))]
    out = scoring.evaluate("classification", batches)
    return out.select(*[F.round(c, 5).alias(c) for c in out.columns])


# ---- models -------------------------------------------------------------------

@add("m16_batch_scoring", """
    WITH x AS (SELECT vec_id, label, unnest(range(64)) AS pos, unnest(embedding)::DOUBLE AS v FROM embeddings),
    c AS (SELECT label AS cls, pos, avg(v) AS m FROM x GROUP BY ALL),
    s AS (SELECT vec_id, label, cls, sum(v*m) - 0.5*sum(m*m) AS s FROM x JOIN c USING (pos) GROUP BY ALL),
    p AS (SELECT label AS gt, arg_max(cls, s) AS pred FROM s GROUP BY vec_id, label)
    SELECT gt, pred, count(*) AS n FROM p GROUP BY ALL""")
def m16(spark, d):
    e = _emb(spark, d)
    w, b = scoring.class_centroids(e, "embedding", "label")
    scored = scoring.score_batches(
        e.select("vec_id", "label", "embedding"), scoring.linear_model(w, b, "vec_id", "embedding", ["label"]),
        "vec_id long, label int, scores array<double>, pred int")
    return metrics.pair_counts(scored, "label", "pred")


GRID_SHRINK, GRID_RIDGE = [0.0, 0.25, 0.5, 0.75, 1.0], [0.001, 0.01, 0.1, 0.5, 2.0]


@add("m13_grid_search", f"""
    WITH f AS (SELECT vec_id, label, embedding, (row_number() OVER (PARTITION BY label ORDER BY
        ((vec_id % 2147483647 + 2147483647) % 2147483647 * 2654435761 + 42*40503) % 2147483647, vec_id) - 1) % 5 AS fold FROM embeddings),
    x AS (SELECT vec_id, label, fold, unnest(range(64)) AS pos, unnest(embedding)::DOUBLE AS v FROM f),
    st AS (SELECT fold, label, pos, count(*) AS n, sum(v) AS s, sum(v*v) AS q FROM x GROUP BY ALL),
    tr AS (SELECT o.fold, label, pos, sum(n) AS n, sum(s) AS s, sum(q) AS q FROM st JOIN (SELECT unnest(range(5)) AS fold) o ON o.fold <> st.fold GROUP BY ALL),
    mv AS (SELECT fold, label, pos, s/n AS m, greatest(q/n - (s/n)*(s/n), 0) AS var FROM tr),
    pool AS (SELECT fold, pos, avg(var) AS pv FROM mv GROUP BY ALL), whole AS (SELECT fold, avg(pv) AS av FROM pool GROUP BY fold),
    g AS (SELECT unnest({GRID_SHRINK}::DOUBLE[]) AS shrink), r AS (SELECT unnest({GRID_RIDGE}::DOUBLE[]) AS ridge),
    md AS (SELECT fold, label AS cls, pos, m, shrink, ridge, (1-shrink)*var + shrink*pv + ridge*av AS var
        FROM mv JOIN pool USING (fold, pos) JOIN whole USING (fold) CROSS JOIN g CROSS JOIN r),
    sc AS (SELECT vec_id, label AS gt, fold, shrink, ridge, cls, -0.5*sum(ln(var) + (v-m)*(v-m)/var) AS s FROM x JOIN md USING (fold, pos) GROUP BY ALL),
    p AS (SELECT fold, shrink, ridge, gt, arg_max(cls, s) AS pred FROM sc GROUP BY vec_id, gt, fold, shrink, ridge),
    side AS (SELECT fold, shrink, ridge, gt AS c, (gt = pred)::INTEGER AS hit FROM p UNION ALL SELECT fold, shrink, ridge, pred, 0 FROM p),
    f1 AS (SELECT fold, shrink, ridge, c, 2*sum(hit)/count(*) AS f1 FROM side GROUP BY ALL),
    m AS (SELECT fold, shrink, ridge, sum(f1) / (SELECT count(DISTINCT label) FROM embeddings) AS f FROM f1 GROUP BY ALL)
    SELECT shrink, ridge, round(avg(f), 6) AS macro_f1 FROM m GROUP BY ALL""")
def m13(spark, d):
    """25 settings, 5 folds: class Gaussians fitted on the training rows of each fold, weights and variances from them alone."""
    e = _emb(spark, d).select("vec_id", "label", "embedding")
    folds = sampling.stratified_folds(e, ranking.portable_key(F.col("vec_id")), "vec_id", "label", 5)
    grid = [(s, r) for s in GRID_SHRINK for r in GRID_RIDGE]
    table, *_ = fold_models.grid_search(folds, grid, "embedding", "label", "fold", 5)
    return table.withColumn("macro_f1", F.round("macro_f1", 6))
