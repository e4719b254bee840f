"""Label transfer between two footprint layers: scored pairs, then a decision per building."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from geoctx.functions import geo
from geoctx.operators.spatial_join import bbox_join

# --- fixed values: thresholds of the decision ---
ACCEPT = 0.60
AMBIGUITY = 0.05
# --- end of fixed values ---


def score_rectangles(pairs: DataFrame, a: str = "a_", b: str = "b_") -> DataFrame:
    """Overlap, IoU, centroid distance, area ratio and weighted score of box pairs."""
    inter = geo.rect_intersection(a, b)
    area_a, area_b = geo.rect_area(a), geo.rect_area(b)

    def mid(p, lo, hi):
        return (F.col(p + lo) + F.col(p + hi)) / 2

    dx = mid(a, "minx", "maxx") - mid(b, "minx", "maxx")
    dy = mid(a, "miny", "maxy") - mid(b, "miny", "maxy")
    dist = F.sqrt(dx * dx + dy * dy)
    out = (
        pairs.withColumn("_i", inter)
        .withColumn("overlap", geo.overlap_ratio(F.col("_i"), area_a))
        .withColumn("iou", geo.iou(F.col("_i"), area_a, area_b))
        .withColumn("cdist", dist)
        .withColumn("aratio", geo.area_ratio(area_a, area_b))
        .drop("_i")
    )
    return with_score(out)


def _fixed(c, digits: int):
    """Fixed-point text, rounded half to even on the exact value (format_string rounds half up)."""
    return F.replace(F.format_number(c, digits), F.lit(","), F.lit(""))


def with_score(pairs: DataFrame) -> DataFrame:
    """Adds ``score``, rounded so that thresholds do not hang on the last bit."""
    raw = geo.match_score(F.col("iou"), F.col("overlap"), F.col("aratio"), geo.distance_decay(F.col("cdist")))
    return pairs.withColumn("score", F.round(raw, 6))


def decide(scored: DataFrame, key: str, cand: str, func: str) -> DataFrame:
    """Best candidate per building, with status and explanation.

    Only the two best are needed: the rank is cut to two before the shuffle (partial window limit), so
    a building with very many candidates does not reach one task whole.
    """
    rank = F.row_number().over(Window.partitionBy(key).orderBy(F.desc("score"), F.asc(cand)))
    top2 = scored.withColumn("_rk", rank).where(F.col("_rk") <= 2)
    fields = F.struct("score", F.col(func).alias("func"), "iou", "overlap", "cdist")
    best = top2.groupBy(key).agg(
        F.max(F.when(F.col("_rk") == 1, fields)).alias("t1"),
        F.max(F.when(F.col("_rk") == 2, F.col("score"))).alias("s2"),
    )
    s1 = F.col("t1.score")
    gap = F.round(s1 - F.col("s2"), 6)
    status = (
        F.when(s1 <= ACCEPT, "Low_Score_Check")
        .when(F.col("s2").isNotNull() & (gap < AMBIGUITY), "Conflict_Ambiguous")
        .otherwise("Auto_Match")
    )
    details = F.concat(
        F.lit("IoU:"), _fixed(F.col("t1.iou"), 2), F.lit(",Ov:"), _fixed(F.col("t1.overlap"), 2),
        F.lit(",Dist:"), _fixed(F.col("t1.cdist"), 1), F.lit("m"),
    )
    info = (
        F.when(F.col("status") == "Low_Score_Check",
               F.concat(F.lit("TopScore:"), _fixed(s1, 2), F.lit(" ("), details, F.lit(")")))
        .when(F.col("status") == "Conflict_Ambiguous",
              F.concat(F.lit("Ambiguous: Top1("), _fixed(s1, 2), F.lit(") vs Top2("), _fixed(F.col("s2"), 2), F.lit(")")))
        .otherwise(details)
    )
    return best.withColumn("status", status).select(
        key,
        F.when(F.col("status") == "Auto_Match", F.col("t1.func")).alias("matched_func"),
        "status",
        F.round(s1, 3).alias("match_score"),
        info.alias("match_info"),
    )


def transfer_rectangles(ours: DataFrame, theirs: DataFrame, cell: float = 60.0) -> DataFrame:
    """Every building once; the ones without a candidate are ``No_Match``."""
    a = ours.select("build_id", *[F.col(c).alias("a_" + c) for c in ("minx", "miny", "maxx", "maxy")])
    b = theirs.select("cand_id", "func", *[F.col(c).alias("b_" + c) for c in ("minx", "miny", "maxx", "maxy")])
    decided = decide(score_rectangles(bbox_join(a, b, cell)), "build_id", "cand_id", "func")
    return (
        ours.select("build_id").join(decided, "build_id", "left")
        .withColumn("status", F.coalesce("status", F.lit("No_Match")))
    )
