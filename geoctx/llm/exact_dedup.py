"""Exact duplicates through a Golomb-coded fingerprint exchange.

1. Each block of documents keeps a 64-bit fingerprint and the SHA-256 of each normalised text.
2. Blocks send their sorted distinct fingerprints, Rice-coded, to the owners of fingerprint ranges and get
   back how often each occurs over all blocks (``exchange``): the duplicate bitmap of the block.
3. Only texts of suspects (fingerprint seen twice) are shuffled and grouped by their bytes. Equal texts meet
   already on the map side, so a group of copies may hold most rows.
"""

from __future__ import annotations

import hashlib

import numpy as np
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from geoctx.catalog.base import Catalog
from geoctx.llm.common import LOWER_BYTES, documents, id_text, in_blocks, lower_az, sieve, without
from geoctx.llm.exchange import exchange, unpack
from geoctx.session import cut_lineage

CATALOG = Catalog()


def _summary(rows: list) -> dict:
    texts = [text.translate(LOWER_BYTES) for _, text in rows]
    return {
        "doc_id": [doc for doc, _ in rows],
        "fp": np.array([xxhash.xxh3_64_intdigest(t) for t in texts], dtype=np.uint64).view(np.int64).tolist(),
        "sha": [hashlib.sha256(t).hexdigest() for t in texts],
    }


#: Bits of a fingerprint that are exchanged; equal ones only make suspects, which are compared by their bytes.
BITS = 62


def _keys(fps: np.ndarray) -> np.ndarray:
    return fps.astype(np.int64).view(np.uint64) >> np.uint64(64 - BITS)


def _request(block: dict) -> tuple[np.ndarray, np.ndarray]:
    """Sorted distinct fingerprints of a block with their number in the block."""
    return np.unique(_keys(block["fp"].values.to_numpy(zero_copy_only=False)), return_counts=True)


def _marked(blocks: DataFrame, replies: DataFrame) -> DataFrame:
    """One row per document with its suspect flag, from the replies to its block."""
    import pyarrow as pa

    def run(batches):
        for batch in batches:
            for docs, fp, sha, replies in zip(*(batch[c].to_pylist() for c in ("doc_id", "fp", "sha", "replies"))):
                fps = np.array(fp, dtype=np.int64)
                _, place = np.unique(_keys(fps), return_inverse=True)
                yield pa.RecordBatch.from_arrays([pa.array(docs, pa.int64()), pa.array(fps), pa.array(sha, pa.string()), pa.array(unpack(replies)[place] > 1)], names=["doc_id", "fp", "sha", "suspect"])

    return blocks.join(replies, "block").select("doc_id", "fp", "sha", "replies").mapInArrow(run, "doc_id long, fp long, sha string, suspect boolean")


def exact_duplicates(docs: DataFrame) -> DataFrame:
    """``doc_id, keep_id, group_size, kept, text_sha256``, one row per row of ``docs (doc_id, text, ...)``.

    Texts are equal when identical after lower-casing A-Z; NULL counts as empty. The row with the largest
    doc_id of a group stays. Of rows that repeat both doc_id and text, one stays. A NULL doc_id is below every
    other; a group of NULL ids only keeps one of them, with ``keep_id`` NULL. Empty input gives no rows; other
    columns of ``docs`` are not looked at.
    """
    blocks = cut_lineage(in_blocks(id_text(docs), None, _summary, "doc_id array<long>, fp array<long>, sha array<string>"))
    total = blocks.agg(F.sum(F.size("fp"))).first()[0] or 0
    rows = cut_lineage(_marked(blocks, exchange(blocks.select("block", "fp"), _request, total, BITS)))
    alone = rows.where("not suspect").select("doc_id", F.col("doc_id").alias("keep_id"), F.lit(1).cast("long").alias("group_size"), F.lit(True).alias("kept"), F.col("sha").alias("text_sha256"))

    suspects = rows.where("suspect").groupBy("doc_id", "sha").agg(F.count("*").alias("repeats"))
    wanted = suspects.select("doc_id").distinct()
    texts = docs.select(docs["doc_id"].cast("long").alias("doc_id"), F.coalesce(docs["text"], F.lit("")).alias("text"))
    # an inner join on distinct ids: a semi join would be pushed below the sieve and shuffle every text
    texts = sieve(texts, "doc_id", wanted).join(wanted.withColumnRenamed("doc_id", "id"), F.col("doc_id").eqNullSafe(F.col("id")))
    groups = texts.groupBy(lower_az(F.col("text")).alias("text")).agg(F.max("doc_id").alias("keep_id"), F.count("*").alias("group_size"))
    groups = groups.select(F.sha2("text", 256).alias("sha"), "keep_id", "group_size")
    repeated = suspects.join(groups, "sha").select("doc_id", "keep_id", "group_size", F.col("sha").alias("text_sha256"), F.explode(F.sequence(F.lit(1), F.col("repeats").cast("int"))).alias("copy"))
    kept = F.col("doc_id").eqNullSafe(F.col("keep_id")) & (F.col("copy") == 1)
    return alone.unionByName(repeated.select("doc_id", "keep_id", "group_size", kept.alias("kept"), "text_sha256"))


def drop_exact_duplicates(docs: DataFrame) -> DataFrame:
    """``docs`` with all its columns and one row of each group of equal texts: the one with the largest doc_id."""
    found = cut_lineage(exact_duplicates(docs).select("doc_id", "text_sha256", "kept"))

    def same(d: DataFrame, gone: DataFrame) -> Column:
        return d["doc_id"].cast("long").eqNullSafe(gone["__gc_doc_id"]) & (F.sha2(lower_az(F.coalesce(d["text"], F.lit(""))), 256) == gone["__gc_text_sha256"])

    by_row = found.groupBy("doc_id", "text_sha256").agg(F.max("kept").alias("kept"), F.count("*").alias("n"))
    left = without(docs, by_row.where("NOT kept").select("doc_id", "text_sha256"), same)
    again = cut_lineage(by_row.where("kept AND n > 1").select("doc_id", "text_sha256"))
    if again.isEmpty():
        return left
    # rows that repeat both id and text: apart from the others, one of each
    single = without(left, again, same)
    named = again.select(F.col("doc_id").alias("__gc_doc_id"), F.col("text_sha256").alias("__gc_text_sha256"))
    repeated = left.join(named, same(left, named)).dropDuplicates(["__gc_doc_id", "__gc_text_sha256"])
    return single.unionByName(repeated.select(*docs.columns))


@CATALOG.add("op8_exact_dedup", """
WITH t AS (SELECT doc_id, translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS low FROM documents),
g AS (SELECT low, max(doc_id) AS keep_id, count(*) AS group_size FROM t GROUP BY low)
SELECT doc_id, keep_id, group_size, doc_id = keep_id AS kept, sha256(low) AS text_sha256 FROM t JOIN g USING (low)""")
def op8(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_duplicates(documents(spark, sf_dir))
