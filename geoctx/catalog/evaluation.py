"""Metrics, losses and training-log operators."""

from __future__ import annotations

from pyspark.sql import functions as F

from geoctx import fixtures as fx
from geoctx.catalog.base import Catalog
from geoctx.fixtures import with_sql
from geoctx.operators import losses, metrics, ordered, ranking, runs

CATALOG = Catalog()
add = CATALOG.add


def rounded(df, *cols, digits=6):
    for c in cols:
        df = df.withColumn(c, F.round(c, digits))
    return df


# ---- classification ---------------------------------------------------------

CONF = """conf AS (SELECT g.gt, p.pred, coalesce(n, 0) AS n FROM (SELECT unnest([0,1,2]) AS gt) g CROSS JOIN (SELECT unnest([0,1,2]) AS pred) p
    LEFT JOIN (SELECT gt, pred, count(*) AS n FROM pairs GROUP BY ALL) c ON c.gt = g.gt AND c.pred = p.pred)"""
REPORT = CONF + """, rep AS (SELECT cls, tp, support, predicted, tp/(predicted+1e-10) AS precision, tp/(support+1e-10) AS recall,
    2*(tp/(predicted+1e-10))*(tp/(support+1e-10))/(tp/(predicted+1e-10)+tp/(support+1e-10)+1e-10) AS f1 FROM (
    SELECT c AS cls, (sum(n) FILTER (gt=c AND pred=c))::BIGINT AS tp, (sum(n) FILTER (gt=c))::BIGINT AS support,
      (sum(n) FILTER (pred=c))::BIGINT AS predicted FROM conf, (SELECT unnest([0,1,2]) AS c) GROUP BY c))"""


def _matrix(spark, d):
    return metrics.confusion_matrix(fx.class_pairs(spark, d), 3)


@add("a11_confusion_matrix", with_sql("pairs", "SELECT gt, pred, n FROM conf", CONF))
def a11(spark, d):
    return _matrix(spark, d)


@add("a12_class_report", with_sql("pairs", """
    SELECT cls, tp, support, predicted, round(precision,6) AS precision, round(recall,6) AS recall, round(f1,6) AS f1 FROM rep""", REPORT))
def a12(spark, d):
    return rounded(metrics.class_report(_matrix(spark, d)), "precision", "recall", "f1")


@add("a12_summary", with_sql("pairs", """
    SELECT round(avg(f1)*100,6) AS macro_f1, round(avg(precision)*100,6) AS macro_precision, round(avg(recall)*100,6) AS macro_recall,
        round(sum(f1*support)/sum(support)*100,6) AS weighted_f1, round(sum(tp)/sum(support)*100,6) AS overall_acc FROM rep""", REPORT))
def a12s(spark, d):
    out = metrics.summary(metrics.class_report(_matrix(spark, d)))
    return rounded(out, *out.columns)


@add("a12_label_report", """
    SELECT c AS cls, count(*) FILTER (quality=c AND toxic=c) AS tp, count(*) FILTER (quality=c) AS support,
        count(*) FILTER (toxic=c) AS predicted FROM labels, (SELECT unnest([0,1]) AS c) GROUP BY c""")
def a12l(spark, d):
    m = metrics.confusion_matrix(fx.table(spark, d, "labels"), 2, "quality", "toxic")
    return metrics.class_report(m, eps=0.0).select("cls", "tp", "support", "predicted")


@add("a13_normalised_confusion", with_sql("pairs", """
    SELECT gt, pred, round(100.0::DOUBLE*n/sum(n) OVER (PARTITION BY gt), 6) AS percent FROM conf""", CONF))
def a13(spark, d):
    return rounded(metrics.normalised_confusion(_matrix(spark, d)), "percent").drop("n")


@add("p19_weak_classes", with_sql("pairs", "SELECT cls, round(f1,6) AS f1 FROM rep WHERE f1 < 0.8", REPORT))
def p19(spark, d):
    return rounded(metrics.weak_classes(metrics.class_report(_matrix(spark, d)), 0.8), "f1")


SOFT = """sm AS (SELECT sample_id, gt, logits, list_transform(logits, lambda e: exp(e - list_max(logits))) AS ex FROM score),
    prob AS (SELECT sample_id, gt, logits, list_transform(ex, lambda e: e / list_sum(ex)) AS probs FROM sm)"""


def _probs(spark, d):
    return fx.scores(spark, d).withColumn("probs", losses.softmax("logits"))


@add("a27_topk_accuracy", with_sql("score", """
    SELECT round((count(*) FILTER (r < 1)+e)*100/(count(*)+e), 6) AS top1, round((count(*) FILTER (r < 3)+e)*100/(count(*)+e), 6) AS top3,
        round((count(*) FILTER (r < 5)+e)*100/(count(*)+e), 6) AS top5 FROM (SELECT 1.1920928955078125e-07 AS e,
      len(list_filter(range(1,11), lambda i: logits[i] > logits[gt+1] OR (logits[i] = logits[gt+1] AND i < gt+1))) AS r FROM score WHERE gt <> 9) GROUP BY e"""))
def a27(spark, d):
    out = metrics.topk_accuracy(fx.scores(spark, d), (1, 3, 5), "logits", ignore=9)
    return rounded(out, *out.columns)


@add("a26_weighted_mean_loss", """
    SELECT user_id, round(sum(value*(event_id%7+1))/sum(event_id%7+1), 6) AS mean FROM events GROUP BY user_id""")
def a26(spark, d):
    t = fx.table(spark, d, "events").withColumn("n", F.col("event_id") % 7 + 1)
    return rounded(metrics.weighted_mean(t, ["user_id"], "value", "n"), "mean")


# ---- segmentation -----------------------------------------------------------

AREAS = """area AS (SELECT image_id, count(*) FILTER (gt=1 AND pred=1) AS inter, count(*) FILTER (gt=1 OR (pred=1 AND gt<>255)) AS uni,
    count(*) FILTER (pred=1 AND gt<>255) AS pred_area, count(*) FILTER (gt=1) AS gt_area, any_value(label) AS label FROM seg GROUP BY image_id)"""


def _areas(spark, d):
    return metrics.foreground_areas(fx.seg_pixels(spark, d), ["image_id"])


@add("a14_foreground_metrics", with_sql("seg", """
    SELECT round(sum(inter)/(sum(uni)+1e-10)*100,6) AS iou, round(2*sum(inter)/(sum(pred_area)+sum(gt_area)+1e-10)*100,6) AS dice,
        round(sum(inter)/(sum(pred_area)+1e-10)*100,6) AS precision, round(sum(inter)/(sum(gt_area)+1e-10)*100,6) AS recall FROM area""", AREAS))
def a14(spark, d):
    out = metrics.foreground_metrics(metrics.foreground_areas(fx.seg_pixels(spark, d)))
    return rounded(out, *out.columns)


@add("a15_sample_iou", with_sql("seg", """
    SELECT image_id, inter, uni, pred_area, gt_area, round(inter/(uni+1e-10),6) AS iou FROM area""", AREAS))
def a15(spark, d):
    return rounded(metrics.sample_iou(_areas(spark, d)), "iou")


@add("p18_high_iou_report", with_sql("seg score", """
    WITH hi AS (SELECT s.gt, (SELECT min(i) FROM range(0,10) t(i) WHERE s.logits[i+1] = list_max(s.logits)) AS pred
        FROM area a JOIN score s ON a.image_id = s.sample_id WHERE inter/(uni+1e-10) > 0.8)
    SELECT count(*) AS n, round(count(*) FILTER (gt = pred)/count(*)*100, 6) AS overall_acc FROM hi""", AREAS))
def p18(spark, d):
    high = metrics.sample_iou(_areas(spark, d)).where(F.col("iou") > metrics.HIGH_IOU)
    pred = (F.array_position("logits", F.array_max("logits")) - 1).cast("int")
    picked = fx.scores(spark, d).select("sample_id", "gt", pred.alias("pred")).join(
        high.select(F.col("image_id").alias("sample_id")), "sample_id")
    report = metrics.class_report(metrics.confusion_matrix(picked, 10))
    return report.agg(F.sum("support").alias("n"), F.round(F.sum("tp") / F.sum("support") * 100, 6).alias("overall_acc"))


CLASS_AREAS = """ca AS (SELECT c AS cls, count(*) FILTER (gt=c AND pred=c) AS inter, count(*) FILTER (pred=c) AS pred_area,
    count(*) FILTER (gt=c) AS label_area, count(*) FILTER (gt=c OR pred=c) AS union_area FROM seg, (SELECT unnest([0,1,2,3]) AS c) WHERE gt <> 255 GROUP BY c),
    cm AS (SELECT cls, inter, label_area, inter/nullif(union_area,0) AS iou, inter/nullif(label_area,0) AS acc, 2*inter/nullif(pred_area+label_area,0) AS dice,
      inter/nullif(pred_area,0) AS precision, inter/nullif(label_area,0) AS recall,
      5*(inter/nullif(pred_area,0))*(inter/nullif(label_area,0))/nullif(4*(inter/nullif(pred_area,0))+inter/nullif(label_area,0),0) AS fscore FROM ca)"""


@add("a16_class_areas", with_sql("seg", """
    SELECT cls, inter, pred_area, label_area, union_area FROM ca WHERE union_area > 0""", CLASS_AREAS))
def a16(spark, d):
    return metrics.class_areas(fx.seg_pixels(spark, d), 4)


@add("a17_class_metrics", with_sql("seg", """
    SELECT cls, inter, label_area, round(iou,6) AS iou, round(acc,6) AS acc, round(dice,6) AS dice, round(fscore,6) AS fscore,
        round(precision,6) AS precision, round(recall,6) AS recall FROM cm""", CLASS_AREAS))
def a17(spark, d):
    out = metrics.class_metrics(metrics.class_areas(fx.seg_pixels(spark, d), 4), 4, beta=2.0)
    return rounded(out, "iou", "acc", "dice", "fscore", "precision", "recall")


@add("a17_mean_metrics", with_sql("seg", """
    SELECT round(sum(inter)/sum(label_area)*100,2) AS "aAcc", round(avg(iou)*100,2) AS "mIoU", round(avg(acc)*100,2) AS "mAcc",
        round(avg(dice)*100,2) AS "mDice", round(avg(fscore)*100,2) AS "mFscore", round(avg(precision)*100,2) AS "mPrecision",
        round(avg(recall)*100,2) AS "mRecall" FROM cm""", CLASS_AREAS))
def a17m(spark, d):
    return metrics.mean_metrics(metrics.class_metrics(metrics.class_areas(fx.seg_pixels(spark, d), 4), 4, beta=2.0))


@add("a30_instance_masks", with_sql("seg", """
    SELECT s.image_id, c.gt AS cls, s.row, s.col, (s.gt = c.gt)::INTEGER AS mask
    FROM seg s JOIN (SELECT DISTINCT image_id, gt FROM seg WHERE gt <> 255) c ON s.image_id = c.image_id"""))
def a30(spark, d):
    return metrics.instance_masks(fx.seg_pixels(spark, d))


@add("a30_mask_runs", with_sql("seg", """
    SELECT image_id, cls, row, min(col) AS start, max(col) AS stop FROM (
      SELECT image_id, gt AS cls, row, col, col - row_number() OVER (PARTITION BY image_id, row, gt ORDER BY col) AS run FROM seg WHERE gt <> 255)
    GROUP BY image_id, cls, row, run"""))
def a30_runs(spark, d):
    return runs.instance_runs(fx.seg_pixels(spark, d))


@add("a30_run_areas", with_sql("seg", """
    SELECT image_id, cls, count(*) FILTER (gt=cls AND pred=cls) AS inter, count(*) FILTER (gt=cls OR pred=cls) AS union_area,
        count(*) FILTER (pred=cls) AS pred_area, count(*) FILTER (gt=cls) AS label_area
    FROM seg, (SELECT unnest([0,1]) AS cls) WHERE gt <> 255 GROUP BY image_id, cls HAVING count(*) FILTER (gt=cls OR pred=cls) > 0"""))
def a30_areas(spark, d):
    return runs.class_areas(fx.seg_pixels(spark, d))


# ---- depth --------------------------------------------------------------------

DEPTH = """dep AS (SELECT l_suppkey AS image_id, l_quantity AS g, l_quantity*(1+l_discount) AS p FROM lineitem WHERE l_quantity > 1 AND l_quantity < 50),
    dm AS (SELECT image_id, avg((greatest(g/p,p/g)<1.25)::INT) AS d1, avg((greatest(g/p,p/g)<1.25*1.25)::INT) AS d2, avg((greatest(g/p,p/g)<1.25*1.25*1.25)::INT) AS d3,
      avg(abs(p-g)/g) AS abs_rel, avg((p-g)*(p-g)/g) AS sq_rel, sqrt(avg((p-g)*(p-g))) AS rmse, sqrt(avg(pow(ln(p)-ln(g),2))) AS rmse_log,
      avg(abs(log10(p)-log10(g))) AS log10, sqrt(greatest(avg(pow(ln(p)-ln(g),2))-0.5*pow(avg(ln(p)-ln(g)),2),0)) AS silog FROM dep GROUP BY image_id)"""
_DM = ", ".join(f"round({{f}}{n}{{e}},4) AS {n}" for n in metrics.DEPTH_NAMES)


def _depth(spark, d):
    t = fx.table(spark, d, "lineitem").select(
        F.col("l_suppkey").alias("image_id"), F.col("l_quantity").alias("gt"),
        (F.col("l_quantity") * (1 + F.col("l_discount"))).alias("pred"))
    return metrics.depth_metrics(t, low=1.0, high=50.0)


@add("a18_depth_per_image", f"WITH {DEPTH} SELECT image_id, {_DM.format(f='', e='')} FROM dm")
def a18(spark, d):
    return rounded(_depth(spark, d), *metrics.DEPTH_NAMES, digits=4)


@add("a18_depth_mean", f"WITH {DEPTH} SELECT {_DM.format(f='avg(', e=')')} FROM dm")
def a18m(spark, d):
    return rounded(metrics.mean_depth_metrics(_depth(spark, d)), *metrics.DEPTH_NAMES, digits=4)


# ---- losses --------------------------------------------------------------------

WEIGHTS = [1.0, 0.5, 2.0, 1.0, 1.5, 1.0, 0.7, 1.0, 1.2, 1.0]


@add("a28_cross_entropy", with_sql("score", f"""
    SELECT round(sum(-ln(probs[gt+1])*w[gt+1])/sum(w[gt+1]), 6) AS loss FROM prob, (SELECT {WEIGHTS}::DOUBLE[] AS w)""", SOFT))
def a28_ce(spark, d):
    return rounded(losses.cross_entropy(_probs(spark, d), class_weight=WEIGHTS), "loss")


@add("a28_cross_entropy_by_class", with_sql("score", """
    SELECT gt, round(avg(-ln(probs[gt+1])), 6) AS loss FROM prob WHERE gt <> 3 GROUP BY gt UNION ALL SELECT 3, NULL""", SOFT))
def a28_cec(spark, d):
    out = losses.cross_entropy(_probs(spark, d), ["gt"], ignore=3, avg_non_ignore=True)
    return rounded(out, "loss")


PT = """pt AS (SELECT image_id, c AS cls, CASE WHEN c=1 THEN q ELSE 1-q END AS p, CASE WHEN gt=c THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END AS t,
    CASE WHEN gt=255 THEN 0.0::DOUBLE ELSE 1.0::DOUBLE END AS valid FROM (SELECT *, 1/(1+exp(-4*v)) AS q FROM seg), (SELECT unnest([0,1]) AS c))"""


def _pt(spark, d):
    q = 1 / (1 + F.exp(-4 * F.col("v")))
    t = fx.seg_pixels(spark, d).withColumn("q", q).withColumn("cls", F.explode(F.array(F.lit(0), F.lit(1))))
    return t.select("image_id", "cls", F.when(F.col("cls") == 1, F.col("q")).otherwise(1 - F.col("q")).alias("p"),
                    (F.col("gt") == F.col("cls")).cast("double").alias("t"), (F.col("gt") != 255).cast("double").alias("valid"))


@add("a28_dice_loss", with_sql("seg", """
    SELECT image_id, round(1 - 2*sum(p*t)/(sum(p*p)+0.001+sum(t*t)+0.001), 6) AS loss FROM pt GROUP BY image_id""", PT))
def a28_dice(spark, d):
    return rounded(losses.dice_loss(_pt(spark, d), "image_id"), "loss")


@add("a28_tversky_loss", with_sql("seg", """
    SELECT round(avg(l), 6) AS loss FROM (SELECT cls, avg(l) AS l FROM (SELECT image_id, cls, 1 - (sum(p*t*valid)+1)/(sum(p*t*valid)
        + 0.3*sum(p*(1-t)*valid) + 0.7*sum((1-p)*t*valid) + 1) AS l FROM pt GROUP BY ALL) GROUP BY cls)""", PT))
def a28_tversky(spark, d):
    return rounded(losses.tversky_loss(_pt(spark, d), "image_id", "cls", valid="valid"), "loss")


@add("a28_softened_kl", """
    WITH r AS (SELECT vec_id, list_transform(embedding[1:10], lambda e: exp(e::DOUBLE/2)) AS a, list_transform(embedding[11:20], lambda e: exp(e::DOUBLE/2)) AS b FROM embeddings)
    SELECT vec_id, round(list_sum(list_transform(range(1,11), lambda i: (b[i]/list_sum(b))*(ln(b[i]/list_sum(b)) - a[i]/list_sum(a))*4))/10, 6) AS loss FROM r""")
def a28_kl(spark, d):
    def part(lo):
        return F.transform(F.slice("embedding", lo, 10), lambda e: e.cast("double"))

    t = fx.table(spark, d, "embeddings").select("vec_id", part(1).alias("a"), part(11).alias("b"))
    return rounded(losses.softened_kl(t, ["vec_id"], "a", "b", temperature=2.0), "loss")


@add("a28_silog_loss", f"""
    WITH {DEPTH} SELECT image_id, round(sqrt(greatest(avg(pow(ln(g)-ln(p),2)) - 0.5*pow(avg(ln(g)-ln(p)),2), 0)), 4) AS loss FROM dep GROUP BY image_id""")
def a28_silog(spark, d):
    t = fx.table(spark, d, "lineitem").where((F.col("l_quantity") > 1) & (F.col("l_quantity") < 50)).select(
        F.col("l_suppkey").alias("image_id"), F.col("l_quantity").alias("gt"),
        (F.col("l_quantity") * (1 + F.col("l_discount"))).alias("pred"))
    return rounded(losses.silog_loss(t, "image_id"), "loss", digits=4)


@add("w8_lovasz_softmax", with_sql("score", """
    SELECT round(avg(loss), 6) AS loss FROM (SELECT cls, sum(err * (j - coalesce(pj, 0))) AS loss FROM (
      SELECT *, lag(j) OVER (PARTITION BY cls ORDER BY err DESC, sample_id) AS pj FROM (
        SELECT *, 1 - (total - cf) / (total + cn - cf) AS j FROM (
          SELECT *, sum(fg) OVER (PARTITION BY cls) AS total, sum(fg) OVER w AS cf, count(*) OVER w AS cn
          FROM (SELECT sample_id, c AS cls, CASE WHEN gt=c THEN 1 ELSE 0 END AS fg, abs((CASE WHEN gt=c THEN 1 ELSE 0 END) - probs[c+1]) AS err
            FROM prob, (SELECT unnest(range(10)) AS c))
          WINDOW w AS (PARTITION BY cls ORDER BY err DESC, sample_id ROWS UNBOUNDED PRECEDING)) WHERE total > 0)) GROUP BY cls)""", SOFT))
def w8(spark, d):
    return rounded(losses.lovasz_softmax(_probs(spark, d)), "loss")


def _true_prob(spark, d):
    return _probs(spark, d).select("sample_id", losses.at("probs", "gt").alias("p"))


@add("w9_hard_examples", with_sql("score", """
    SELECT sample_id, round(p, 6) AS p FROM (SELECT sample_id, probs[gt+1] AS p FROM prob)
    WHERE p < greatest(0.1, (SELECT list_sort(list(probs[gt+1]))[101] FROM prob))""", SOFT))
def w9(spark, d):
    return rounded(losses.hard_examples(_true_prob(spark, d), "p", 100, 0.1), "p")


@add("w9_top_losses", with_sql("score", """
    SELECT sample_id, round(-ln(probs[gt+1]), 6) AS loss FROM prob ORDER BY -ln(probs[gt+1]) DESC, sample_id LIMIT 50""", SOFT))
def w9n(spark, d):
    t = _true_prob(spark, d).select("sample_id", (-F.log("p")).alias("loss"))
    return rounded(losses.hardest(t, "loss", "sample_id", 50), "loss")


# ---- training logs --------------------------------------------------------------

LOG = """log AS (SELECT *, row_number() OVER (PARTITION BY run ORDER BY ts, event_id) AS epoch FROM train_log)"""


def _log(spark, d):
    """Line numbers per run, ranked in day buckets so that a long run is not one task."""
    day = F.date_diff("ts", F.lit("1970-01-01").cast("date"))
    return ranking.bucket_rank(fx.train_log(spark, d), ["run"], day, [F.col("ts"), F.col("event_id")], "epoch")


@add("w7_carry_step", with_sql("train_log", """
    SELECT run, epoch, step, coalesce(last_value(CASE WHEN step <> 0 THEN step END IGNORE NULLS) OVER
        (PARTITION BY run ORDER BY epoch ROWS UNBOUNDED PRECEDING), 0) AS full_step FROM log""", LOG))
def w7(spark, d):
    return ordered.carry_step(_log(spark, d), line="epoch", block=16).select("run", "epoch", "step", "full_step")


@add("s16_log_by_step", with_sql("train_log", """
    SELECT run, full_step, count(*) AS n, round(sum(metric), 4) AS total FROM (
      SELECT *, coalesce(last_value(CASE WHEN step <> 0 THEN step END IGNORE NULLS) OVER
        (PARTITION BY run ORDER BY epoch ROWS UNBOUNDED PRECEDING), 0) AS full_step FROM log) GROUP BY ALL""", LOG))
def s16(spark, d):
    t = ordered.carry_step(_log(spark, d), line="epoch", block=16)
    return t.groupBy("run", "full_step").agg(F.count(F.lit(1)).alias("n"), F.round(F.sum("metric"), 4).alias("total"))


@add("w6_best_epoch", with_sql("train_log", """
    SELECT run, epoch AS best_epoch, metric AS best_metric FROM (
      SELECT *, row_number() OVER (PARTITION BY run ORDER BY metric DESC, epoch) AS r FROM log) WHERE r = 1""", LOG))
def w6(spark, d):
    return ordered.best_epoch(_log(spark, d))


@add("w5_early_stopping", with_sql("train_log", """
    SELECT run, best_epoch, best_metric, epoch AS last_epoch FROM (
      SELECT *, row_number() OVER (PARTITION BY run ORDER BY epoch DESC) AS r FROM replay) WHERE r = 1""", LOG + """,
    RECURSIVE replay AS (SELECT run, 0::BIGINT AS epoch, 0::BIGINT AS best_epoch, -1.0::DOUBLE AS best_metric, 0 AS bad FROM (SELECT DISTINCT run FROM log)
      UNION ALL SELECT l.run, l.epoch, CASE WHEN l.metric > r.best_metric + 0.05 THEN l.epoch ELSE r.best_epoch END,
        CASE WHEN l.metric > r.best_metric + 0.05 THEN l.metric ELSE r.best_metric END,
        CASE WHEN l.metric > r.best_metric + 0.05 THEN 0 ELSE r.bad + 1 END
      FROM replay r JOIN log l ON l.run = r.run AND l.epoch = r.epoch + 1 WHERE r.bad < 12)"""))
def w5(spark, d):
    return ordered.early_stopping(_log(spark, d), patience=12, min_delta=0.05)
