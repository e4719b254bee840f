"""Token ids in binary shard files with a minimal perfect hash index of document keys.

A shard file holds the ids of consecutive documents (ascending doc_id), nothing between them, and in front of
them an index that leads from a key to its place in constant time. Layout, little-endian:

    magic "GCTOKID2" | width, docs, keys, nulls, ids, part, number, levels, bits, first key, last key (int64 each)
    doc keys int64[docs] | offsets int64[docs + 1] | level sizes int64[levels] | level bits uint8[bits / 8]
    ranks int64[bits / 512 + 1] | fingerprints uint32[keys] | first document uint32[keys] | ids uint16 or uint32[ids]

The index is a cascade of bit arrays: a key is placed at the first level where no other key shares its bit, and
its slot is the rank of that bit. A slot keeps a fingerprint of its key, so that foreign keys are refused.
Files are written and read by Spark's own file sources, so any store that Spark reaches will do.
"""

from __future__ import annotations

import struct
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import public_tokenizers
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from geoctx.catalog.base import Catalog
from geoctx.llm.common import documents, id_text
from geoctx.llm.word_bpe import word_bpe
from geoctx.session import cut_lineage, scratch_path

CATALOG = Catalog()
MAGIC = b"GCTOKID2"
HEADER = "<8s11q"
#: Bytes of ids after which a shard is closed; a longer document has a shard of its own.
SHARD_BYTES = 32 << 20
#: Manifest rows (one per shard) that keyed access looks through in memory.
MANIFEST_ROWS = 2_000_000


def _mix(keys: np.ndarray, seed: int) -> np.ndarray:
    """A 64-bit hash of 64-bit keys (a public finaliser of multiplications and shifts)."""
    x = keys.astype(np.uint64) + np.uint64((0x9E3779B97F4A7C15 * (seed + 1)) & (2**64 - 1))
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


@dataclass(frozen=True)
class PerfectHash:
    """Distinct keys to 0..n-1; a foreign key gets some number or -1."""

    sizes: np.ndarray
    bits: np.ndarray  # uint8, packed, all levels behind each other
    ranks: np.ndarray  # ones before every 512th bit

    @classmethod
    def build(cls, keys: np.ndarray) -> PerfectHash:
        sizes, levels, left = [], [], keys.astype(np.int64).view(np.uint64)
        while len(left):
            size = max(-(-len(left) * 3 // 2 // 512) * 512, 512)
            at = (_mix(left, len(sizes)) % np.uint64(size)).astype(np.int64)
            taken = np.bincount(at, minlength=size)
            levels.append(taken == 1)
            sizes.append(size)
            left = left[taken[at] > 1]
        flat = np.concatenate(levels) if levels else np.zeros(0, bool)
        ranks = np.concatenate([[0], np.cumsum(flat.reshape(-1, 512).sum(axis=1))])
        return cls(np.array(sizes, np.int64), np.packbits(flat, bitorder="little"), ranks.astype(np.int64))

    def slots(self, keys: np.ndarray) -> np.ndarray:
        keys = keys.astype(np.int64).view(np.uint64)
        out, open_, start = np.full(len(keys), -1, np.int64), np.arange(len(keys)), 0
        for level, size in enumerate(self.sizes.tolist()):
            at = start + (_mix(keys[open_], level) % np.uint64(size)).astype(np.int64)
            set_ = (self.bits[at >> 3] >> (at & 7).astype(np.uint8)) & 1 == 1
            hit, where = open_[set_], at[set_]
            words = self.bits.view(np.uint64)
            word, ones = where >> 6, self.ranks[where >> 9].copy()
            for k in range(8):  # whole words of the 512 bits before, then the part of the own word
                near = (where >> 9 << 3) + k
                ones += np.where(near < word, np.bitwise_count(words[np.minimum(near, len(words) - 1)]), 0).astype(np.int64)
            low = (np.uint64(1) << (where & 63).astype(np.uint64)) - np.uint64(1)
            out[hit] = ones + np.bitwise_count(words[word] & low).astype(np.int64)
            open_, start = open_[~set_], start + size
        return out


def _fingerprints(keys: np.ndarray) -> np.ndarray:
    return (_mix(keys.astype(np.int64).view(np.uint64), 1 << 20) >> np.uint64(32)).astype(np.uint32)


def shard_bytes(keys: list[int | None], ids: list[bytes], part: int, number: int) -> bytes:
    """One shard: documents in the order given (NULL keys first), their ids as little-endian uint32 bytes."""
    nulls = sum(k is None for k in keys)
    docs = np.array([0 if k is None else k for k in keys], np.int64)
    offsets = np.concatenate([[0], np.cumsum([len(i) // 4 for i in ids])]).astype(np.int64)
    flat = np.frombuffer(b"".join(ids), "<u4")
    width = 2 if len(flat) == 0 or flat.max() < 1 << 16 else 4
    distinct, first = np.unique(docs[nulls:], return_index=True)
    index = PerfectHash.build(distinct)
    slots = index.slots(distinct)
    prints, firsts = np.zeros(len(distinct), np.uint32), np.zeros(len(distinct), np.uint32)
    prints[slots], firsts[slots] = _fingerprints(distinct), first + nulls
    bits = len(index.bits) * 8
    ends = (int(distinct[0]), int(distinct[-1])) if len(distinct) else (0, -1)
    head = struct.pack(HEADER, MAGIC, width, len(docs), len(distinct), nulls, len(flat), part, number, len(index.sizes), bits, *ends)
    arrays = (docs, offsets, index.sizes, index.bits, index.ranks, prints, firsts, flat.astype("<u2" if width == 2 else "<u4"))
    return head + b"".join(np.ascontiguousarray(a).tobytes() for a in arrays)


class Shard:
    """A shard's content; arrays are views of the bytes."""

    def __init__(self, data: bytes) -> None:
        magic, width, docs, keys, self.nulls, n, self.part, self.number, levels, bits, self.first, self.last = struct.unpack_from(HEADER, data)
        if magic != MAGIC:
            raise ValueError("not a token shard")
        at = struct.calcsize(HEADER)

        def take(kind: str, count: int) -> np.ndarray:
            nonlocal at
            out = np.frombuffer(data, kind, count, at)
            at += out.nbytes
            return out

        self.keys, self.offsets = take("<i8", docs), take("<i8", docs + 1)
        sizes, packed, ranks = take("<i8", levels), take("u1", bits // 8), take("<i8", bits // 512 + 1)
        self.index = PerfectHash(sizes, packed, ranks)
        self.prints, self.firsts = take("<u4", keys), take("<u4", keys)
        self.ids = take("<u2" if width == 2 else "<u4", n)

    def find(self, keys: np.ndarray) -> np.ndarray:
        """The first document of each key, or -1 where the fingerprint refuses it."""
        if not len(self.prints):
            return np.full(len(keys), -1, np.int64)
        slots = self.index.slots(keys)
        fits = (slots >= 0) & (self.prints[slots] == _fingerprints(keys))
        first = np.where(fits, self.firsts[slots].astype(np.int64), -1)
        return np.where(fits & (self.keys[first] == keys), first, -1)  # a fingerprint may fit by chance

    def documents(self, key: int) -> list[np.ndarray]:
        """The ids of all documents of a key."""
        at, out = int(self.find(np.array([key], np.int64))[0]), []
        while 0 <= at < len(self.keys) and self.keys[at] == key:
            out.append(self.ids[self.offsets[at]:self.offsets[at + 1]])
            at += 1
        return out


def write_tokens(docs: DataFrame, path: str, tokenizer: str, end_id: int = 2, shard: int = SHARD_BYTES) -> None:
    """Encodes every text of ``docs (doc_id, text, ...)``, appends ``end_id``, and writes shards in ascending doc_id order.

    NULL text counts as empty: such a document is its end id. A NULL doc_id comes first, and is not a key;
    documents that repeat an id stand side by side. An empty table writes no shard. Other columns are left out.
    """
    end = end_id.to_bytes(4, "little")
    rows = id_text(docs).withColumn("tie", F.xxhash64("text"))
    rows = rows.repartitionByRange(F.col("doc_id").asc_nulls_first(), F.col("tie")).sortWithinPartitions(F.col("doc_id").asc_nulls_first(), "tie").select("doc_id", "text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe, part, number, keys, ids, size = word_bpe(tokenizer), TaskContext.get().partitionId(), 0, [], [], 0
        for batch in batches:
            for key, text in zip(batch["doc_id"].to_pylist(), batch["text"].to_pylist()):
                own = bpe.text_ids(text) + end
                if keys and size + len(own) > shard:
                    yield pa.RecordBatch.from_pydict({"value": pa.array([shard_bytes(keys, ids, part, number)], pa.binary())})
                    number, keys, ids, size = number + 1, [], [], 0
                keys.append(key), ids.append(own)
                size += len(own)
        if keys:
            yield pa.RecordBatch.from_pydict({"value": pa.array([shard_bytes(keys, ids, part, number)], pa.binary())})

    # a text file of one unchanged value: the shard's bytes, with a line end behind them
    blobs = rows.mapInArrow(run, "value binary").select(F.col("value").cast("string").alias("value"))
    blobs.write.option("maxRecordsPerFile", 1).text(f"{path}/shards")
    manifest(docs.sparkSession, path).write.parquet(f"{path}/manifest")


def _files(spark: SparkSession, path: str) -> DataFrame:
    # empty tasks leave empty files
    return spark.read.format("binaryFile").load(f"{path}/shards").where("length > 0")


def manifest(spark: SparkSession, path: str) -> DataFrame:
    """``path, docs, keys, ids, first, last, start`` of every shard: ``first`` and ``last`` are its keys at the ends (NULL
    where it has none), ``start`` counts the ids of all shards before it."""
    names = ("docs", "keys", "nulls", "ids", "part", "number", "first", "last")

    def head(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for name, data in zip(batch["path"].to_pylist(), batch["head"].to_pylist()):
                _, _, docs, found, nulls, n, part, number, _, _, first, last = struct.unpack_from(HEADER, data)
                rows.append({"path": name} | dict(zip(names, (docs, found, nulls, n, part, number, first if found else None, last if found else None))))
            yield pa.RecordBatch.from_pylist(rows, schema=pa.schema([("path", pa.string()), *[(c, pa.int64()) for c in names]]))

    heads = _files(spark, path).select("path", F.substring("content", 1, struct.calcsize(HEADER)).alias("head"))
    shards = heads.mapInArrow(head, ", ".join(["path string", *[f"{c} long" for c in names]]))
    # one row per shard of 32 MB: a running sum over them is small at any input size
    before = Window.orderBy("part", "number").rowsBetween(Window.unboundedPreceding, -1)
    return shards.withColumn("start", F.coalesce(F.sum("ids").over(before), F.lit(0)))


def _with_files(spark: SparkSession, path: str) -> DataFrame:
    shards = spark.read.parquet(f"{path}/manifest").select(F.col("path").alias("_path"), "start")
    return _files(spark, path).join(shards, F.col("path") == F.col("_path")).select("path", "content", "start")


def read_tokens(spark: SparkSession, path: str, digests: bool = False) -> DataFrame:
    """``doc_id, start, ids array<int>`` of every document; with ``digests`` ``doc_id, start, n_tokens, ids_crc32``.

    Each document is found through the index by its key, and its place checked against its neighbours.
    """
    kinds = pa.schema([("doc_id", pa.int64()), ("start", pa.int64()), *([("n_tokens", pa.int64()), ("ids_crc32", pa.int64())] if digests else [("ids", pa.list_(pa.int32()))])])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for data, start in zip(batch["content"], batch["start"].to_pylist()):
                s = Shard(data.as_buffer().to_pybytes())
                keys = s.keys[s.nulls:]
                first = s.find(keys)
                at = first + np.arange(len(keys)) - np.searchsorted(keys, keys)  # repeats of a key follow its first
                if (first < 0).any() or (at != np.arange(s.nulls, len(s.keys))).any():
                    raise ValueError("index and payload of a shard do not agree")
                at = np.concatenate([np.arange(s.nulls), at])
                names = [None] * s.nulls + keys.tolist()
                for low in range(0, len(at), 4096):
                    some = at[low:low + 4096]
                    parts = [s.ids[s.offsets[i]:s.offsets[i + 1]] for i in some.tolist()]
                    out = [pa.array(names[low:low + 4096], pa.int64()), pa.array(start + s.offsets[some])]
                    if digests:
                        out += [pa.array([len(p) for p in parts], pa.int64()), pa.array([zlib.crc32(p.astype("<u4").tobytes()) for p in parts], pa.int64())]
                    else:
                        out.append(pa.array([p.astype(np.int32) for p in parts], pa.list_(pa.int32())))
                    yield pa.RecordBatch.from_arrays(out, schema=kinds)

    schema = "doc_id long, start long, n_tokens long, ids_crc32 long" if digests else "doc_id long, start long, ids array<int>"
    return _with_files(spark, path).select("content", "start").mapInArrow(run, schema)


def lookup_tokens(spark: SparkSession, path: str, keys: DataFrame) -> DataFrame:
    """``doc_id, ids array<int>`` for the keys (``doc_id``) that the files hold; NULL and unknown keys give no row.

    The manifest tells the shards whose range holds a key; only those are opened, and in them the index gives the place of
    a key. Needs the manifest's ends (24 bytes a shard and its path) on the driver and in each task.
    """
    spans = spark.read.parquet(f"{path}/manifest").where("keys > 0").select("path", "first", "last")
    if spans.count() > MANIFEST_ROWS:
        raise ValueError(f"more than {MANIFEST_ROWS} shards: write larger ones")
    spans = sorted(spans.collect(), key=lambda r: (r.first, r.last))
    first, last, names = np.array([r.first for r in spans], np.int64), np.array([r.last for r in spans], np.int64), [r.path for r in spans]

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            wanted = batch["doc_id"].drop_null().to_numpy()
            low, high = np.searchsorted(last, wanted, "left"), np.searchsorted(first, wanted, "right")
            n = np.maximum(high - low, 0)  # repeats of a key may reach over a shard's end
            at = np.repeat(low - np.concatenate([[0], np.cumsum(n)[:-1]]).astype(np.int64), n) + np.arange(n.sum()) if len(n) else np.zeros(0, np.int64)
            yield pa.RecordBatch.from_arrays([pa.array([names[i] for i in at.tolist()], pa.string()), pa.array(np.repeat(wanted, n), pa.int64())], names=["path", "doc_id"])

    placed = keys.select(F.col("doc_id").cast("long").alias("doc_id")).where("doc_id IS NOT NULL").distinct().mapInArrow(place, "path string, doc_id long")
    # a shard holds a bounded number of keys, so its list is bounded too; as many rows as shards at most
    asked = cut_lineage(placed.groupBy(F.col("path").alias("_path")).agg(F.collect_set("doc_id").alias("keys")))
    opened = [r[0] for r in asked.select("_path").collect()]
    if not opened:
        return spark.createDataFrame([], "doc_id long, ids array<int>")

    def fetch(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for data, wanted in zip(batch["content"], batch["keys"].to_pylist()):
                s = Shard(data.as_buffer().to_pybytes())
                rows = [{"doc_id": k, "ids": i.astype(np.int32)} for k in wanted for i in s.documents(k)]
                yield pa.RecordBatch.from_pylist(rows, schema=pa.schema([("doc_id", pa.int64()), ("ids", pa.list_(pa.int32()))]))

    files = spark.read.format("binaryFile").load(opened)
    return files.join(asked, F.col("path") == F.col("_path")).select("content", "keys").mapInArrow(fetch, "doc_id long, ids array<int>")


@CATALOG.add("op3_token_files")
def op3(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = scratch_path(spark, "tokens")
    write_tokens(documents(spark, sf_dir), path, public_tokenizers.path("word_bpe_49k.json"))
    return read_tokens(spark, path, digests=True)
