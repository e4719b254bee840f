"""Evaluation losses over scored tables, hard-example mining, and the Lovasz extension."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from geoctx.functions.arrays import let, total
from geoctx.operators import ranking
from geoctx.session import cut_lineage


def softmax(logits, temperature: float = 1.0) -> Column:
    x = F.col(logits) if isinstance(logits, str) else logits
    shifted = let(
        F.struct(x.alias("x"), F.array_max(x).alias("top")),
        lambda s: F.transform(s["x"], lambda v: F.exp((v - s["top"]) / temperature)))
    return let(shifted, lambda p: let(
        F.struct(p.alias("p"), total(p).alias("t")), lambda s: F.transform(s["p"], lambda v: v / s["t"])))


def at(array, index) -> Column:
    a = F.col(array) if isinstance(array, str) else array
    i = F.col(index) if isinstance(index, str) else index
    return F.element_at(a, (i + 1).cast("int"))


def cross_entropy(df: DataFrame, groups: Sequence[str] = (), probs: str = "probs", gt: str = "gt",
                  class_weight: Sequence[float] | None = None, ignore: int | None = None,
                  avg_non_ignore: bool = False) -> DataFrame:
    """Mean weighted log loss.

    Ignored rows cost nothing; they still count in the divisor unless ``avg_non_ignore`` is set.
    """
    skipped = F.col(gt) == ignore if ignore is not None else F.lit(False)
    weight = F.lit(1.0)
    if class_weight is not None:
        weight = at(F.array(*[F.lit(float(w)) for w in class_weight]), gt)
    loss = F.when(skipped, 0.0).otherwise(-F.log(at(probs, gt)) * weight)
    divisor = F.when(skipped, 0.0).otherwise(weight) if avg_non_ignore else F.when(skipped, 1.0).otherwise(weight)
    return df.groupBy(*groups).agg(F.try_divide(F.sum(loss), F.sum(divisor)).alias("loss"))


def dice_loss(df: DataFrame, group: str, p: str = "p", t: str = "t", eps: float = 1e-3, naive: bool = False) -> DataFrame:
    """One loss per sample over all its (class, pixel) rows."""
    pc, tc = F.col(p), F.col(t)
    a = F.sum(pc * tc)
    if naive:
        d = (2 * a + eps) / (F.sum(pc) + F.sum(tc) + eps)
    else:
        d = 2 * a / (F.sum(pc * pc) + eps + F.sum(tc * tc) + eps)
    return df.groupBy(group).agg((1 - d).alias("loss"))


def tversky_loss(df: DataFrame, sample: str, cls: str, p: str = "p", t: str = "t", valid: str | None = None,
                 alpha: float = 0.3, beta: float = 0.7, smooth: float = 1.0) -> DataFrame:
    """Mean over samples per class, then the mean over classes (one row)."""
    pc, tc = F.col(p), F.col(t)
    v = F.col(valid) if valid else F.lit(1.0)
    tp, fp, fn = F.sum(pc * tc * v), F.sum(pc * (1 - tc) * v), F.sum((1 - pc) * tc * v)
    per = df.groupBy(sample, cls).agg((1 - (tp + smooth) / (tp + alpha * fp + beta * fn + smooth)).alias("l"))
    return per.groupBy(cls).agg(F.avg("l").alias("l")).agg(F.avg("l").alias("loss"))


def softened_kl(df: DataFrame, keys: Sequence[str], logits: str, target: str, temperature: float = 1.0,
                reduction: str = "mean") -> DataFrame:
    """Per row: target (log target - input), both softmaxed at ``temperature``, times its square."""
    t = df.select(*keys, softmax(logits, temperature).alias("_p"), softmax(target, temperature).alias("_t"))
    terms = F.zip_with("_p", "_t", lambda p, q: q * (F.log(q) - p) * temperature**2)
    loss = total(terms)
    return t.select(*keys, (loss / F.size(terms) if reduction == "mean" else loss).alias("loss"))


def silog_loss(df: DataFrame, group: str, pred: str = "pred", target: str = "gt", eps: float = 1e-4) -> DataFrame:
    """Scale-invariant log loss per sample."""
    d = F.log(F.greatest(F.col(target), F.lit(eps))) - F.log(F.greatest(F.col(pred), F.lit(eps)))
    ok = (F.col(target) > eps) & ~F.isnan(d)
    n = F.greatest(F.sum(ok.cast("double")), F.lit(eps))
    sq = F.sum(F.when(ok, d * d).otherwise(0.0)) / n
    mean = F.sum(F.when(ok, d).otherwise(0.0)) / n
    return df.groupBy(group).agg(F.sqrt(F.greatest(sq - 0.5 * mean * mean, F.lit(0.0))).alias("loss"))


def lovasz_softmax(df: DataFrame, groups: Sequence[str] = (), probs: str = "probs", gt: str = "gt",
                   only_present: bool = True) -> DataFrame:
    """Lovasz extension of the Jaccard loss per group, averaged over classes.

    Rows with equal error are one step of the extension, so the table shrinks to distinct errors per
    class first; the cumulative intersection and union are running sums over those in sampled error ranges.
    """
    groups = list(groups)
    rows = df.select(*groups, F.col(gt).alias("_gt"), F.posexplode(probs).alias("cls", "p"))
    fg = (F.col("_gt") == F.col("cls")).cast("long")
    steps = rows.select(*groups, "cls", fg.alias("fg"), F.abs(fg - F.col("p")).alias("err"))
    steps = cut_lineage(steps.groupBy(*groups, "cls", "err").agg(F.count(F.lit(1)).alias("n"), F.sum("fg").alias("fg")))
    # ranges by sampled quantiles: a confident model has nearly all of its errors close to zero
    bounds = F.array(*[F.lit(b) for b in ranking.sampled_bounds(steps, "err")]).cast("array<double>")
    bucket = F.size(F.filter(bounds, lambda b: b > F.col("err")))
    run = ranking.running_sums(steps, [*groups, "cls"], bucket, [F.desc("err")], {"cn": "n", "cf": "fg"})
    totals = steps.groupBy(*groups, "cls").agg(F.sum("fg").alias("all_fg"))
    if only_present:
        totals = totals.where(F.col("all_fg") > 0)
    run = run.join(totals, [*groups, "cls"])

    def jaccard(n, f):
        return F.when(n == 0, 0.0).otherwise(1.0 - (F.col("all_fg") - f) / (F.col("all_fg") + n - f))

    gain = jaccard(F.col("cn"), F.col("cf")) - jaccard(F.col("cn") - F.col("n"), F.col("cf") - F.col("fg"))
    per_class = run.groupBy(*groups, "cls").agg(F.sum(F.col("err") * gain).alias("loss"))
    return per_class.groupBy(*groups).agg(F.avg("loss").alias("loss"))


def hard_threshold(df: DataFrame, prob: str, min_kept: int, thresh: float) -> float:
    """Largest of ``thresh`` and the ``min_kept``-th smallest probability (0-based, clipped to the last)."""
    kth = ranking.kth_smallest(df, prob, min_kept)
    return thresh if kth is None else max(kth, thresh)


def hard_examples(df: DataFrame, prob: str, min_kept: int, thresh: float = 0.7) -> DataFrame:
    """Rows with a true-class probability below the threshold."""
    return df.where(F.col(prob) < F.lit(hard_threshold(df, prob, min_kept, thresh)))


def hardest(df: DataFrame, loss: str, tie: str, n: int) -> DataFrame:
    """The ``n`` rows of highest loss (a bounded top-n)."""
    return df.orderBy(F.desc(loss), tie).limit(n)
