"""Token counts: pieces are counted once per distinct pre-token and summed over per-document frequencies."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import public_tokenizers
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from geoctx.catalog.base import Catalog
from geoctx.llm.common import documents, id_text, in_blocks, stored
from geoctx.llm.exchange import pack, unpack
from geoctx.llm.units import Numbering, back_to_blocks, distinct_units, joined_units
from geoctx.llm.word_bpe import word_bpe

CATALOG = Catalog()


def _frequencies(rows: list, path: str) -> dict:
    """Distinct pre-tokens of a block, and per document how often each occurs (sorted, as differences)."""
    bpe, words, units = word_bpe(path), Numbering(), Numbering()
    spelled = [np.fromiter(map(words.__getitem__, text.split()), np.int64) for _, text in rows]
    parts = [[units[u] for u in bpe.units(w)] for w in words]
    sizes = np.fromiter(map(len, parts), np.int64, len(parts))
    flat, starts = np.array([u for p in parts for u in p], dtype=np.int64), np.cumsum(sizes) - sizes
    per_doc, gaps, freqs = [], [], []
    for w in spelled:
        w, times = np.unique(w, return_counts=True)
        n = sizes[w]
        spots = np.repeat(starts[w] - (np.cumsum(n) - n), n) + np.arange(n.sum())
        found, place = np.unique(flat[spots], return_inverse=True)
        per_doc.append(len(found))
        gaps.append(np.diff(found, prepend=0))
        freqs.append(np.bincount(place, np.repeat(times, n), len(found)))
    return {
        "doc_id": [doc for doc, _ in rows], "n_bytes": [len(text) for _, text in rows], "vocab": list(units), "per_doc": pack(np.array(per_doc)),
        "gaps": pack(np.concatenate(gaps)), "freqs": pack(np.concatenate(freqs)),
    }


def token_counts(docs: DataFrame, path: str, limit: int = 2048) -> DataFrame:
    """``doc_id, n_bytes, n_tokens, over_limit`` for every row of ``docs (doc_id, text, ...)``.

    Tokens are those of the tokenizers file at ``path`` without added ones; special strings in a text are the
    special tokens, as is the library's default. NULL text counts as empty (no bytes, no tokens), NULL and
    repeated doc_ids keep a row each, empty input gives no rows, other columns are not looked at.
    """
    spec = "doc_id array<long>, n_bytes array<long>, vocab array<string>, per_doc binary, gaps binary, freqs binary"
    blocks = stored(in_blocks(id_text(docs), None, lambda rows: _frequencies(rows, path), spec))

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = word_bpe(path)
        for batch in batches:
            yield pa.RecordBatch.from_arrays([batch["unit"], pa.array([len(bpe.unit_ids(u)) for u in batch["unit"].to_pylist()], pa.int32())], names=["unit", "pieces"])

    def total(block: dict, found: pa.Table) -> pa.Table:
        pieces = np.zeros(len(block["vocab"]), dtype=np.int64)
        pieces[found["pos"].to_numpy()] = found["pieces"].to_numpy()
        per_doc, gaps, freqs = (unpack(block[c].as_py()).astype(np.int64) for c in ("per_doc", "gaps", "freqs"))
        ends = np.cumsum(per_doc)
        run = np.cumsum(gaps)
        before = np.concatenate([[0], run])[ends - per_doc]  # each document's numbers start anew
        unit = run - np.repeat(before, per_doc)
        sums = np.concatenate([[0], np.cumsum(pieces[unit] * freqs)])
        return pa.table({"doc_id": block["doc_id"].values, "n_bytes": block["n_bytes"].values, "n_tokens": sums[ends] - sums[ends - per_doc]})

    pieces = distinct_units(blocks).mapInArrow(count, "unit string, pieces int")
    counts = back_to_blocks(blocks, joined_units(blocks, pieces), total, "doc_id long, n_bytes long, n_tokens long")
    return counts.withColumn("over_limit", F.col("n_tokens") > limit)


@CATALOG.add("op1_token_counts")
def op1(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_counts(documents(spark, sf_dir), public_tokenizers.path("word_bpe_49k.json"))
