"""Operators over training logs: ordered state without one task per run.

Lines of a run are cut into blocks of consecutive positions. A block is summarised by an aggregate,
the summaries are scanned (a small table), and the lines of each block are scanned on their own.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from geoctx.session import cut_lineage


def carry_step(log: DataFrame, run: str = "run", line: str = "line", step: str = "step", block: int = 65536) -> DataFrame:
    """Adds ``full_step``: the line's step, or the last non-zero step before it in the run (0 at first)."""
    t = log.withColumn("_b", F.floor(F.col(line) / block))
    known = F.when(F.col(step) != 0, F.col(step))
    ends = t.where(F.coalesce(F.col(step), F.lit(0)) != 0).groupBy(run, "_b").agg(F.max_by(step, line).alias("_end"))
    blocks = t.select(run, "_b").distinct().join(ends, [run, "_b"], "left")
    before = Window.partitionBy(run).orderBy("_b").rowsBetween(Window.unboundedPreceding, -1)
    blocks = blocks.select(run, "_b", F.last("_end", ignorenulls=True).over(before).alias("_in"))
    inside = Window.partitionBy(run, "_b").orderBy(line).rowsBetween(Window.unboundedPreceding, 0)
    out = t.withColumn("_own", F.last(known, ignorenulls=True).over(inside)).join(blocks, [run, "_b"])
    return out.withColumn("full_step", F.coalesce("_own", "_in", F.lit(0))).drop("_b", "_own", "_in")


def best_epoch(log: DataFrame, run: str = "run", epoch: str = "epoch", metric: str = "metric") -> DataFrame:
    """Epoch of the highest metric per run; the earliest on ties."""
    best = F.max_by(F.struct(F.col(epoch), F.col(metric)), F.struct(F.col(metric), -F.col(epoch)))
    return log.groupBy(run).agg(best.alias("_b")).select(
        run, F.col("_b")[epoch].alias("best_epoch"), F.col("_b")[metric].alias("best_metric"))


def records(log: DataFrame, run: str = "run", epoch: str = "epoch", metric: str = "metric", block: int = 65536) -> DataFrame:
    """Epochs whose metric is above everything before them in the run."""
    t = log.select(run, epoch, metric).withColumn("_b", F.floor(F.col(epoch) / block))
    tops = t.groupBy(run, "_b").agg(F.max(metric).alias("_top"))
    before = Window.partitionBy(run).orderBy("_b").rowsBetween(Window.unboundedPreceding, -1)
    tops = tops.select(run, "_b", F.max("_top").over(before).alias("_in"))
    inside = Window.partitionBy(run, "_b").orderBy(epoch).rowsBetween(Window.unboundedPreceding, -1)
    t = t.withColumn("_own", F.max(metric).over(inside)).join(tops, [run, "_b"])
    return t.where(F.coalesce(F.greatest("_own", "_in") < F.col(metric), F.lit(True))).select(run, epoch, metric)


def early_stopping(log: DataFrame, patience: int, min_delta: float = 0.0, start: float = -1.0,
                   run: str = "run", epoch: str = "epoch", metric: str = "metric", block: int = 65536) -> DataFrame:
    """Replay of early stopping: an epoch improves if metric > best + min_delta (best starts at ``start``);
    ``patience`` epochs in a row without improvement stop the run.

    An improving epoch is above every earlier one, so only the run's records are folded, and those of ``block`` epochs at
    a time: the state of all runs (one row each) goes from block to block, so that no row holds more than a block.
    Epochs count 1, 2, 3, ... Returns the best epoch and metric when the run stops and the last epoch run.
    """
    found = records(log, run, epoch, metric, block).withColumn("_b", F.floor(F.col(epoch) / block))
    blocks = cut_lineage(found.groupBy(run, "_b").agg(
        F.array_sort(F.collect_list(F.struct(F.col(epoch).alias("e"), F.col(metric).alias("m")))).alias("_r")))
    first = F.struct(F.lit(0).cast("long").alias("e"), F.lit(float(start)).alias("m"), F.lit(False).alias("done"))

    def step(s: Column, r: Column) -> Column:
        late = s["done"] | (r["e"].cast("long") - s["e"] > patience)
        better = ~late & (r["m"] > s["m"] + min_delta)
        return F.struct(
            F.when(better, r["e"].cast("long")).otherwise(s["e"]).alias("e"),
            F.when(better, r["m"]).otherwise(s["m"]).alias("m"), late.alias("done"))

    state = log.where(F.col(run).isNotNull()).groupBy(run).agg(F.max(epoch).alias("_last")).withColumn("_s", first)
    for i, (b,) in enumerate(sorted(blocks.select("_b").distinct().collect())):
        state = state.join(blocks.where(F.col("_b") == b).select(run, "_r"), run, "left")
        folded = F.when(F.col("_r").isNull(), F.col("_s")).otherwise(F.aggregate("_r", F.col("_s"), step))
        state = state.withColumn("_s", folded).drop("_r")
        if i % 8 == 7:
            state = cut_lineage(state)
    return state.select(
        run, F.col("_s.e").alias("best_epoch"), F.col("_s.m").alias("best_metric"),
        F.least(F.col("_s.e") + patience, F.col("_last").cast("long")).alias("last_epoch"))
