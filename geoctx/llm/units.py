"""Blocks of documents as numbers of their distinct units, and the join that brings what is known of a unit back."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from itertools import groupby

import numpy as np
import pyarrow as pa
import xxhash
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from geoctx.llm.common import lean
from geoctx.llm.exchange import pack, summed, unpack


class Numbering(dict):
    """Numbers keys in the order in which they are first asked for."""

    def __missing__(self, key):
        self[key] = n = len(self)
        return n


def distinct_units(blocks: DataFrame) -> DataFrame:
    """``(unit)``, each once, of all blocks' ``vocab array<string>``."""
    return blocks.select(F.explode("vocab").alias("unit")).distinct()


def back_to_blocks(blocks: DataFrame, found: DataFrame, build: Callable[[dict, pa.Table], pa.Table], schema: str) -> DataFrame:
    """``build(block as a dict, Arrow table of found)`` for each block; ``found`` has ``home, pos`` and more.

    What one task holds is one block. ``blocks`` is a table bucketed by block and stays where it is.
    """

    def run(left: pa.Table, right: pa.Table) -> pa.Table:
        return build({c: left[c][0] for c in left.column_names}, right)

    return blocks.groupBy("block").cogroup(found.groupBy("home")).applyInArrow(lean(run), schema)


def joined_units(blocks: DataFrame, known: DataFrame) -> DataFrame:
    """``(home, pos, columns of known)``: ``known``, with one row per ``unit``, joined to every block's units."""
    spots = blocks.select(F.col("block").alias("home"), F.posexplode("vocab").alias("pos", "unit"))
    return spots.join(known, "unit").drop("unit")


#: Units one owner handles at a time.
PER_OWNER = 400_000


def pack_strings(words: list[bytes]) -> bytes:
    """Byte strings as compressed lengths and compressed content; neighbours that are alike pack well."""
    lengths = pack(np.array([len(w) for w in words], np.int64))
    return len(lengths).to_bytes(8, "little") + lengths + zstandard.compress(b"".join(words), 3)


def unpack_strings(data: bytes) -> list[bytes]:
    head = 8 + int.from_bytes(data[:8], "little")
    ends = np.cumsum(unpack(data[8:head]), dtype=np.int64).tolist()
    body = zstandard.decompress(data[head:])
    return [body[a:b] for a, b in zip([0, *ends], ends)]


def _dealt(words: list[bytes], owners: int) -> tuple[list[int], list[int]]:
    """The positions of a block's words by owner, then word, and the owner of each word."""
    owner = [xxhash.xxh3_64_intdigest(w) % owners for w in words]
    return sorted(range(len(words)), key=lambda i: (owner[i], words[i])), owner


def once_per_unit(blocks: DataFrame, column: str, total: int, make: Callable[[list[str]], list[str]], build: Callable[[dict, list[bytes]], pa.Table], schema: str) -> DataFrame:
    """``build(block as a dict, what make gives for each of its units)`` for each block of ``blocks (block, column, ...)``.

    ``column`` holds the block's distinct units (``pack_strings``). Blocks send them, sorted and packed, to the owners
    of hash classes; an owner makes a table of its distinct units, calls ``make`` once for each, and replies in the
    order of the request. A unit reaches its owner once per block, and ``total`` (about all blocks' units) sets how
    many owners there are, so that none holds much. ``blocks`` is bucketed by block and stays where it is.
    """
    owners = max(-(-total // PER_OWNER), 1)
    sent_schema = pa.schema([("owner", pa.int32()), ("home", pa.int64()), ("data", pa.binary())])

    def send(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for home, data in zip(batch["block"].to_pylist(), batch[column]):
                words = unpack_strings(data.as_py())
                order, owner = _dealt(words, owners)
                for o, own in groupby(order, key=owner.__getitem__):
                    yield pa.RecordBatch.from_pylist([{"owner": o, "home": home, "data": pack_strings([words[i] for i in own])}], schema=sent_schema)

    def answer(group: pa.Table) -> pa.Table:
        number = Numbering()  # the distinct units of this owner; requests are kept as numbers only
        asked = [np.fromiter(map(number.__getitem__, unpack_strings(d.as_py())), np.int32) for d in group["data"]]
        table, made = list(number), []
        for low in range(0, len(table), 10_000):
            made += [m.encode() for m in make([w.decode() for w in table[low:low + 10_000]])]
        replies = (pack_strings([made[i] for i in own.tolist()]) for own in asked)
        return pa.Table.from_arrays([group["owner"], group["home"], pa.array(replies, pa.binary())], schema=sent_schema)

    def finish(left: pa.Table, right: pa.Table) -> pa.Table:
        row = {c: left[c][0] for c in left.column_names}
        words = unpack_strings(row[column].as_py())
        replies = [r for o in np.argsort(right["owner"].to_numpy()).tolist() for r in unpack_strings(right["data"][o].as_py())]
        made: list[bytes] = [b""] * len(words)
        for i, reply in zip(_dealt(words, owners)[0], replies):
            made[i] = reply
        return build(row, made)

    ddl = "owner int, home long, data binary"
    replies = blocks.select("block", column).mapInArrow(lean(send), ddl).groupBy("owner").applyInArrow(lean(answer), ddl)
    return blocks.groupBy("block").cogroup(replies.groupBy("home")).applyInArrow(lean(finish), schema)


def hashed(words: list[bytes]) -> np.ndarray:
    return np.fromiter(map(xxhash.xxh3_64_intdigest, words), np.uint64, len(words))


def summed_units(blocks: DataFrame, total: int) -> DataFrame:
    """``(block, counts binary, firsts binary)``: for each block's units, the sum of their weights over all blocks.

    ``blocks (block, units, weights)`` hold distinct units in the order of their hashes (``pack_strings``), and a weight
    each (``pack``). Owners of hash ranges compare the units themselves, so equal hashes do no harm. ``firsts`` (bits)
    marks each unit in exactly one of the blocks that have it, so that sums over marked units count every unit once.
    """
    owners = 1 << max(-(-total // PER_OWNER) - 1, 0).bit_length()
    width = np.uint64(64 - owners.bit_length() + 1)
    ddl = "owner int, block long, data binary, weights binary"
    sent_schema = pa.schema([("owner", pa.int32()), ("block", pa.int64()), ("data", pa.binary()), ("weights", pa.binary())])

    def send(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                words, weights = unpack_strings(batch["units"][i].as_py()), unpack(batch["weights"][i].as_py())
                where = hashed(words) >> width if owners > 1 else np.zeros(len(words), np.uint64)
                cuts = [*np.searchsorted(where, np.arange(owners, dtype=np.uint64)).tolist(), len(words)]
                for owner, (a, b) in enumerate(zip(cuts, cuts[1:])):
                    if a < b:
                        yield pa.RecordBatch.from_pylist([{"owner": owner, "block": batch["block"][i].as_py(), "data": pack_strings(words[a:b]), "weights": pack(weights[a:b])}], schema=sent_schema)

    def answer(group: pa.Table) -> pa.Table:
        number = Numbering()
        place, cuts = [], [0]
        for data in group["data"]:
            place.append(np.fromiter(map(number.__getitem__, unpack_strings(data.as_py())), np.int64))
            cuts.append(cuts[-1] + len(place[-1]))
        place = np.concatenate(place)
        sums = summed(place, np.concatenate([unpack(w.as_py()) for w in group["weights"]]), len(number))[place]
        firsts = np.zeros(len(place), np.uint8)
        firsts[np.unique(place, return_index=True)[1]] = 1
        rows = [{"owner": o, "block": b, "data": pack(firsts[x:y]), "weights": pack(sums[x:y])} for o, b, x, y in zip(group["owner"].to_pylist(), group["block"].to_pylist(), cuts, cuts[1:])]
        return pa.Table.from_pylist(rows, schema=sent_schema)

    def gather(group: pa.Table) -> pa.Table:
        order = np.argsort(group["owner"].to_numpy()).tolist()
        column = lambda c: pack(np.concatenate([unpack(group[c][i].as_py()) for i in order]))
        return pa.table({"block": group["block"].slice(0, 1), "counts": pa.array([column("weights")], pa.binary()), "firsts": pa.array([column("data")], pa.binary())})

    replies = blocks.select("block", "units", "weights").mapInArrow(lean(send), ddl).groupBy("owner").applyInArrow(lean(answer), ddl)
    return replies.groupBy("block").applyInArrow(lean(gather), "block long, counts binary, firsts binary")
