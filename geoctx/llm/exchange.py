"""Golomb-coded exchange of sorted hashes between blocks and owners of hash ranges.

Each block sends, to the owner of each range of the hash space, its sorted distinct hashes as Rice-coded
differences (Golomb coding with a power of two), with a weight each. The owner adds up the weights of equal
hashes over all blocks and replies in the order of the request, so that no hash travels back.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame

from geoctx.llm.common import lean, pa_schema

#: Hashes one owner handles at a time.
PER_OWNER = 1_500_000


def rice_encode(values: np.ndarray) -> bytes:
    """Sorted unsigned values: count, shift, unary quotients and low bits of the differences, as one byte string."""
    n = len(values)
    if not n:
        return b""
    gaps = np.diff(values.astype(np.uint64), prepend=np.uint64(0))
    mean = int(values[-1]) // n
    k = max(mean.bit_length() - 1, 0)
    quotient = (gaps >> np.uint64(k)).astype(np.int64)
    ends = np.cumsum(quotient + 1) - 1
    unary = np.zeros(int(ends[-1]) + 1, dtype=np.uint8)
    unary[ends] = 1
    ones = np.packbits(unary).tobytes()
    low = np.packbits(np.stack([((gaps >> np.uint64(i)) & np.uint64(1)).astype(np.uint8) for i in range(k)]), axis=1).tobytes() if k else b""
    return np.array([n, k, len(ones)], dtype="<i8").tobytes() + ones + low


def rice_decode(data: bytes) -> np.ndarray:
    """The values that ``rice_encode`` coded."""
    if not data:
        return np.zeros(0, dtype=np.uint64)
    n, k, size = np.frombuffer(data, "<i8", 3)
    ends = np.flatnonzero(np.unpackbits(np.frombuffer(data, np.uint8, size, 24)))[:n]
    gaps = (np.diff(ends, prepend=-1) - 1).astype(np.uint64) << np.uint64(k)
    if k:
        planes = np.unpackbits(np.frombuffer(data, np.uint8, offset=24 + size).reshape(k, -1), axis=1)[:, :n]
        for i in range(k):
            gaps |= planes[i].astype(np.uint64) << np.uint64(i)
    return np.cumsum(gaps, dtype=np.uint64)


def pack(values: np.ndarray) -> bytes:
    """Counts as compressed bytes, each byte plane by itself: four planes, or eight where one reaches 2 ** 32."""
    values = np.asarray(values)
    wide = len(values) > 0 and int(values.max()) >> 32 > 0
    planes = np.ascontiguousarray(values, dtype="<u8" if wide else "<u4").view(np.uint8).reshape(-1, 8 if wide else 4).T
    return (b"\x08" if wide else b"\x04") + zstandard.compress(np.ascontiguousarray(planes).tobytes(), 1)


def unpack(data: bytes) -> np.ndarray:
    width = data[0]
    planes = np.frombuffer(zstandard.decompress(data[1:]), np.uint8).reshape(width, -1)
    return np.ascontiguousarray(planes.T).view(f"<u{width}").reshape(-1)


def summed(place: np.ndarray, weights: np.ndarray, n: int) -> np.ndarray:
    """The exact sum of whole non-negative weights at each of ``n`` places, up to 2 ** 63."""
    out, weights = np.zeros(n, np.int64), weights.astype(np.int64)
    for shift in range(0, max(int(weights.max(initial=0)).bit_length(), 1), 20):  # parts whose sums floats hold exactly
        out += np.bincount(place, (weights >> shift) & 0xFFFFF, n).astype(np.int64) << shift
    return out


def exchange(blocks: DataFrame, keys_of: Callable[[dict], tuple[np.ndarray, np.ndarray]], total: int, bits: int) -> DataFrame:
    """``(block, replies binary)``: for each block's hashes in order, the summed weight over all blocks, packed.

    ``keys_of(row as a dict of Arrow scalars)`` gives a block's sorted distinct hashes below ``2 ** bits`` as
    uint64 and their weights; ``total`` is about the number of hashes of all blocks, and sets how many owners
    share them. A hash that occurs everywhere reaches its owner once per block.
    """
    owners = 1 << min(max(int(np.ceil(np.log2(max(total, 1) / PER_OWNER))), 0), bits)
    width = np.uint64(bits - owners.bit_length() + 1)
    sent_schema = pa_schema(blocks.sparkSession, "owner int, block long, code binary, weight binary")

    def send(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                row = {c: batch[c][i] for c in batch.schema.names}
                keys, weights = keys_of(row)
                cuts = [*np.searchsorted(keys >> width, np.arange(owners, dtype=np.uint64)).tolist(), len(keys)]
                for owner, (a, b) in enumerate(zip(cuts, cuts[1:])):
                    if a < b:
                        code = rice_encode(keys[a:b] - (np.uint64(owner) << width))
                        yield pa.RecordBatch.from_pylist([{"owner": owner, "block": row["block"].as_py(), "code": code, "weight": pack(weights[a:b])}], schema=sent_schema)

    reply_schema = pa_schema(blocks.sparkSession, "block long, owner int, reply binary")

    def answer(group: pa.Table) -> pa.Table:
        codes = [rice_decode(c) for c in group["code"].to_pylist()]
        weights = np.concatenate([unpack(w) for w in group["weight"].to_pylist()])
        found, place = np.unique(np.concatenate(codes), return_inverse=True)
        sums = summed(place, weights, len(found))[place]
        cuts = np.cumsum([0, *map(len, codes)])
        return pa.Table.from_pylist([{"block": b, "owner": o, "reply": pack(sums[x:y])} for b, o, x, y in zip(group["block"].to_pylist(), group["owner"].to_pylist(), cuts, cuts[1:])], schema=reply_schema)

    all_schema = pa_schema(blocks.sparkSession, "block long, replies binary")

    def gather(group: pa.Table) -> pa.Table:
        order = np.argsort(group["owner"].to_numpy())
        parts = group["reply"].to_pylist()
        return pa.Table.from_pylist([{"block": group["block"][0].as_py(), "replies": pack(np.concatenate([unpack(parts[i]) for i in order]))}], schema=all_schema)

    sent = blocks.mapInArrow(lean(send), "owner int, block long, code binary, weight binary")
    replies = sent.groupBy("owner").applyInArrow(lean(answer), "block long, owner int, reply binary")
    return replies.groupBy("block").applyInArrow(lean(gather), "block long, replies binary")
