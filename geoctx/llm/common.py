"""Helpers of the corpus operators: text normalisation, blocks of rows, a bounded sieve, components."""

from __future__ import annotations

import contextlib
import ctypes
import functools
import gc
import inspect
import uuid
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from geoctx.session import cut_lineage, scratch_path

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: bytes.translate table that lower-cases A-Z and leaves all other bytes alone.
LOWER_BYTES = bytes(b + 32 if 65 <= b <= 90 else b for b in range(256))
#: Text bytes after which a block is closed: large enough to share words, small enough for one task's memory.
BLOCK_BYTES = 24 << 20


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def lower_az(text: Column) -> Column:
    """A-Z in lower case, every other character unchanged."""
    return F.translate(text, UPPER, LOWER)


def doc_bucket(doc_id: Column) -> Column:
    """crc32 of the id as text, modulo 5; NULL ids count as the empty string."""
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")) % 5


def id_text(docs: DataFrame) -> DataFrame:
    """``doc_id`` as long and ``text`` as UTF-8 bytes, NULL text as empty; other columns are left out."""
    return docs.select(docs["doc_id"].cast("long").alias("doc_id"), F.coalesce(docs["text"], F.lit("")).cast("binary").alias("text"))


def in_blocks(rows: DataFrame, size: Column | None, build: Callable[[list], dict], schema: str, limit: int = BLOCK_BYTES) -> DataFrame:
    """One row per block of neighbouring rows of a scan task, as ``build(list of row tuples)`` makes it.

    A block closes at ``limit`` bytes of the column named ``text`` (a longer text is a block of its own), so
    its memory is bounded at any input size. ``block`` numbers are unique and mean something only within one
    evaluation: write the result before using it twice (``stored``).
    """
    arrow = pa_schema(rows.sparkSession, f"block long, {schema}")
    at = rows.columns.index("text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        task, n, held, weight = TaskContext.get().partitionId(), 0, [], 0

        def close() -> pa.RecordBatch:
            made = {"block": (task << 24) + n} | build(held)
            return pa.RecordBatch.from_pylist([made], schema=arrow)

        for batch in batches:
            for row in zip(*(c.to_pylist() for c in batch.columns)):
                if held and weight + len(row[at]) > limit:
                    yield close()
                    n, held, weight = n + 1, [], 0
                held.append(row)
                weight += len(row[at])
        if held:
            yield close()

    return rows.mapInArrow(lean(run), f"block long, {schema}")


#: Tables that a worker keeps from row to row, emptied at the end of a task.
KEPT: list[dict] = []


def give_back() -> None:
    """Hands memory of finished work back to the system. Python workers live on through many tasks, and what one of them
    once needed would else stay with it while another stage runs beside the JVM."""
    for table in KEPT:
        table.clear()
    gc.collect()
    pa.default_memory_pool().release_unused()
    with contextlib.suppress(OSError, AttributeError):  # other C libraries have no such call
        ctypes.CDLL(None).malloc_trim(0)


def lean(step: Callable) -> Callable:
    """``step``, a function of an iterator that yields or one of groups that returns, with ``give_back`` behind its last row."""
    if inspect.isgeneratorfunction(step):

        @functools.wraps(step)
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            try:
                yield from step(batches)
            finally:
                give_back()

        return run

    if len(inspect.signature(step).parameters) == 2:  # two groups

        def both(left: pa.Table, right: pa.Table) -> pa.Table:
            try:
                return step(left, right)
            finally:
                give_back()

        return both

    def one(group: pa.Table) -> pa.Table:
        try:
            return step(group)
        finally:
            give_back()

    return one


def pa_schema(spark: SparkSession, ddl: str) -> pa.Schema:
    """The Arrow schema of a DDL string."""
    from pyspark.sql.pandas.types import to_arrow_schema
    from pyspark.sql.types import StructType

    return to_arrow_schema(StructType.fromDDL(ddl))


def stored(blocks: DataFrame, key: str = "block") -> DataFrame:
    """A table bucketed by ``key`` in the shared folder: later joins on ``key`` leave it in place."""
    spark = blocks.sparkSession
    name = f"blocks_{uuid.uuid4().hex}"
    parts = max(int(spark.conf.get("spark.sql.shuffle.partitions")), 1)
    (blocks.write.format("parquet").option("path", scratch_path(spark, "blocks")).bucketBy(parts, key).saveAsTable(name))
    return spark.table(name)


def _sieved(df: DataFrame, key: str, keys: DataFrame, bits: int) -> DataFrame:
    """``df`` with ``__gc_may``: false only where ``key`` is surely not among ``keys[key]``.

    Sends a table of at most ``2 ** (bits - 6)`` rows to every task (65,536 rows of 16 bytes by default,
    whatever the data).
    """
    spot = lambda c: F.pmod(F.xxhash64(c), F.lit(1 << bits))
    words = (keys.select(spot(keys[key].cast("long")).alias("at"))
             .groupBy(F.shiftright("at", 6).alias("__gc_word")).agg(F.bit_or(F.expr("shiftleft(1L, cast(at & 63 as int))")).alias("__gc_mask")))
    marked = df.withColumn("__gc_at", spot(df[key].cast("long"))).withColumn("__gc_word", F.shiftright("__gc_at", 6))
    may = F.coalesce(F.expr("(shiftrightunsigned(__gc_mask, cast(__gc_at & 63 as int)) & 1) = 1"), F.lit(False))
    return marked.join(F.broadcast(words), "__gc_word", "left").withColumn("__gc_may", may).select(*df.columns, "__gc_may")


def sieve(df: DataFrame, key: str, keys: DataFrame, bits: int = 22) -> DataFrame:
    """Rows of ``df`` whose whole number ``key`` may be among ``keys[key]``: all true ones, and few others while keys
    are few, so that a following join shuffles little else. NULL is a value like others."""
    return _sieved(df, key, keys, bits).where("__gc_may").drop("__gc_may")


def without(docs: DataFrame, gone: DataFrame, same: Callable[[DataFrame, DataFrame], Column], bits: int = 22) -> DataFrame:
    """``docs`` without the rows that ``same(docs, gone)`` some row of ``gone (doc_id, ...)``.

    Texts of rows whose doc_id is surely not among them are not shuffled.
    """
    marked = _sieved(docs, "doc_id", gone, bits)
    doubtful = marked.where("__gc_may").drop("__gc_may")
    named = gone.select(*[F.col(c).alias(f"__gc_{c}") for c in gone.columns])
    return marked.where("NOT __gc_may").drop("__gc_may").unionByName(doubtful.join(named, same(doubtful, named), "left_anti"))


def components(edges: DataFrame) -> DataFrame:
    """``(node, label)``: the smallest node each node of ``edges (a, b)`` is connected to.

    Smallest labels spread over edges and along label pointers until nothing changes; every round is joins and
    aggregates on a written table. A hub's edges are split by adaptive skew joins.
    """
    both = edges.select(F.col("a").alias("src"), F.col("b").alias("dst")).unionByName(edges.select(F.col("b").alias("src"), F.col("a").alias("dst")))
    both = cut_lineage(both.where("src <> dst").distinct())
    labels = cut_lineage(both.groupBy(F.col("src").alias("node")).agg(F.least(F.min("dst"), F.col("node")).alias("label")))
    while True:
        news = both.join(labels.withColumnRenamed("node", "src"), "src").groupBy(F.col("dst").alias("node")).agg(F.min("label").alias("near"))
        step = labels.join(news, "node", "left").select("node", F.least("label", "near").alias("next"), F.col("label").alias("old"))
        heads = labels.select(F.col("node").alias("next"), F.col("label").alias("head"))
        step = cut_lineage(step.join(heads, "next", "left").select("node", F.least("next", "head").alias("label"), "old"))
        if step.where("label <> old").isEmpty():
            return step.select("node", "label")
        labels = step.select("node", "label")
