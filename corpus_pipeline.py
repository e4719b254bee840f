"""The corpus pipeline: documents to token ids in five stages, each written as Parquet and read again."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from geoctx.llm.common import documents
from geoctx.llm.decontaminate import decontaminate
from geoctx.llm.exact_dedup import drop_exact_duplicates
from geoctx.llm.ngram_jaccard import drop_near_duplicates
from geoctx.llm.pieces import encode_decode
from geoctx.llm.quality import keep_good
from geoctx.session import cut_lineage


def keep_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality classifier does not reject.

    NULL and empty texts are scored like others; without labels every document scores an even 0.5 and stays.
    """
    return keep_good(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))


def drop_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of equal texts (A-Z in either case): the largest doc_id. NULL text is empty."""
    return drop_exact_duplicates(docs)


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document, the smallest doc_id, of each group linked by five-word shingles at a similarity of 0.8 or more.

    Texts without words link with nothing and stay, as do rows with a NULL doc_id.
    """
    return drop_near_duplicates(docs, width=5, percent=80)


def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents of which less than one word in twenty lies in a 13-word window of the benchmark."""
    return decontaminate(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """``doc_id, n_tokens, ids, decoded`` of every document; a NULL text is empty."""
    pieces = encode_decode(docs, public_tokenizers.path("piece_bpe_32k.model"))
    return pieces.select("doc_id", F.size("ids").cast("long").alias("n_tokens"), "ids", "decoded")


STAGES = [("quality", keep_quality), ("exact_dedup", drop_copies), ("ngram_jaccard", drop_near_copies), ("decontaminate", drop_contaminated), ("sentencepiece", encode)]

#: Trained trees and subword merges are beyond SQL; tests compare each stage with plain code instead.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages on the table documents; what lies between them is kept in the session's shared folder."""
    docs = documents(spark, sf_dir)
    for _, stage in STAGES[:-1]:
        docs = cut_lineage(stage(spark, docs, sf_dir))
    return STAGES[-1][1](spark, docs, sf_dir)
