"""Exact similarity join of word n-gram sets, and its connected components.

Candidates. Shingles are put in one order for the whole corpus, rarest first, ties by hash. Two sets can link only if
they share a shingle among the first n - ceil(threshold * n) + 1 of each: so no link is lost, and passages that many
documents share bring nobody together. In how many documents a shingle occurs is found by a Golomb-coded exchange of
shingle hashes between blocks of documents; a shingle of one document alone makes no candidate and stays at home.
The place of a shingle in a set's order bounds what may be shared from there on, and so the sizes of sets that can link
through it: who finds no partner of such a size under a shingle leaves it. Pages of one site that have much in common, yet
not enough, never form a family.

Verification. Every set is compared with the smallest member of each such shingle it shares, by bitmaps first: a bit
of A that B lacks stands for at least one shingle outside the intersection, which bounds the overlap from above.
What the bound lets through is decided by an exact intersection of sorted arrays. Then the rest: members of families
(sets connected by shared shingles of their beginnings) that are still in different components are laid out in
size-banded tiles, and tile is compared with tile in the same way. Pairs inside one component are not looked at again.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from geoctx.catalog.base import Catalog
from geoctx.llm.common import BLOCK_BYTES, KEPT, LOWER_BYTES, components, documents, id_text, in_blocks, lean, pa_schema, stored, without
from geoctx.llm.exchange import exchange, unpack
from geoctx.llm.units import pack_strings, unpack_strings
from geoctx.session import cut_lineage

CATALOG = Catalog()
#: Bits of a shingle's hash by which documents are counted. A chance match puts a shingle later in the order, no more.
BITS = 52
#: Bits of a set's bitmap.
MAP_BITS = 2048
#: Sets in a tile, and sets of one component in a size band from which the component has tiles of its own.
TILE, OWN = 128, 64
#: Shingles in a tile, for long texts.
TILE_SHINGLES = 4 << 20
#: Size ranges, per doubling, in which the partners of a shingle are summed up.
STEPS = 12
_ODD = [np.uint64(c) for c in (0x9E3779B97F4A7C15, 0xBF58476D1CE4E5B9, 0x94D049BB133111EB, 0xD6E8FEB86659FD93, 0xA0761D6478BD642F, 0xE7037ED1A0B428DB, 0x8EBC6AF09C88C6E3, 0x589965CC75374CC3)]


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(31))) * _ODD[1]
    x = (x ^ (x >> np.uint64(29))) * _ODD[2]
    return x ^ (x >> np.uint64(32))


class _Hashes(dict):
    """Words to 64-bit hashes; forgets all when full."""

    def __missing__(self, word: bytes) -> int:
        if len(self) >= 200_000:
            self.clear()
        self[word] = h = xxhash.xxh3_64_intdigest(word)
        return h


_WORDS = _Hashes()
KEPT.append(_WORDS)


def shingles(text: bytes, width: int) -> np.ndarray:
    """Sorted distinct 64-bit hashes of the ``width``-word shingles; fewer words are one shingle, none are none."""
    words = text.translate(LOWER_BYTES).split()
    if not words:
        return np.zeros(0, np.uint64)
    h = np.fromiter(map(_WORDS.__getitem__, words), np.uint64, len(words))
    size = min(width, len(words))
    total = np.full(len(words) - size + 1, np.uint64(size))
    for i in range(size):
        total = _mix(total * _ODD[i % 8] + h[i:i + len(total)])
    return np.unique(total)


def linked(common: int, a: int, b: int, percent: int) -> bool:
    """Whether 100 * intersection >= percent * union."""
    return 100 * common >= percent * (a + b - common)


def beginning(hashes: np.ndarray, seen: np.ndarray, percent: int) -> tuple[np.ndarray, np.ndarray]:
    """The shingles by which a set may meet others: of its first ones, rarest first, those that others have too.

    A partner shares at least ceil(percent / 100 * n) shingles, so it has one of the first n - that + 1, and the first
    shared one lies in the beginning of both. With each shingle goes the largest size of a partner with which this can
    be the first shared one: at place p at most n - p are shared, and (100 + percent) * shared >= percent * (both sizes).
    """
    n = len(hashes)
    first = np.lexsort((hashes, seen))[:n + (-n * percent // 100) + 1]
    places = np.flatnonzero(seen[first] > 1)
    return hashes[first[places]], (n - places) * (100 + percent) // percent - n


def bitmap(hashes: np.ndarray) -> bytes:
    bits = np.zeros(MAP_BITS, np.uint8)
    bits[(_mix(hashes + _ODD[7]) % np.uint64(MAP_BITS)).astype(np.int64)] = 1
    return np.packbits(bits).tobytes()


def _set_key(hashes: np.ndarray) -> tuple[int, int]:
    """A set's number and a second hash that tells two sets with one number apart."""
    d = xxhash.xxh3_128_intdigest(hashes.tobytes())
    return ((d >> 64) & (2**64 - 1)) - 2**63, (d & (2**64 - 1)) - 2**63


def _block(rows: list) -> dict:
    texts = [text.translate(LOWER_BYTES) for _, text in rows]
    return {"doc_id": [doc for doc, _ in rows], "n_words": sum(len(t.split()) for t in texts), "texts": pack_strings(texts)}


def _numbered(row: dict, width: int) -> tuple[list[np.ndarray], list[tuple[int, int] | None], np.ndarray, np.ndarray]:
    """A block's sets and their numbers, its distinct shingle hashes, and in how many different sets each occurs."""
    sets = [shingles(t, width) for t in unpack_strings(row["texts"].as_py())]
    numbers = [_set_key(s) if len(s) and doc is not None else None for s, doc in zip(sets, row["doc_id"].values.to_pylist())]
    one_each = [s for s, _ in {k: (s, k) for s, k in zip(sets, numbers) if k}.values()]
    flat = np.concatenate([np.zeros(0, np.uint64), *one_each])
    flat >>= np.uint64(64 - BITS)
    flat.sort()
    starts = np.flatnonzero(np.concatenate([[True], flat[1:] != flat[:-1]])) if len(flat) else np.zeros(0, np.int64)
    return sets, numbers, flat[starts], np.diff(starts, append=len(flat))


def _with_beginnings(blocks: DataFrame, replies: DataFrame, width: int, percent: int) -> DataFrame:
    """One row per document: its set's number and size; for one document of a set and block with company, the rest."""
    schema = "doc_id long, n long, key long, check long, sigs array<long>, most array<long>, map binary, hashes binary"
    arrow = pa_schema(blocks.sparkSession, schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                row = {c: batch[c][i] for c in batch.schema.names}
                sets, numbers, hashes, _ = _numbered(row, width)
                seen, met, out = unpack(row["replies"].as_py()) if len(hashes) else np.zeros(0, np.uint32), set(), []
                for doc, own, number in zip(row["doc_id"].values.to_pylist(), sets, numbers):
                    line = {"doc_id": doc, "n": len(own), "key": number and number[0], "check": number and number[1], "sigs": [], "most": [], "map": None, "hashes": None}
                    if number and number not in met:
                        met.add(number)
                        sigs, most = beginning(own, seen[np.searchsorted(hashes, own >> np.uint64(64 - BITS))], percent)
                        if len(sigs):
                            line |= {"sigs": sigs.view(np.int64).tolist(), "most": most.tolist(), "map": bitmap(own), "hashes": own.tobytes()}
                    out.append(line)
                    if len(out) == 2000:
                        yield pa.RecordBatch.from_pylist(out, schema=arrow)
                        out = []
                yield pa.RecordBatch.from_pylist(out, schema=arrow)

    # a block without any words asks for nothing and gets no reply
    return blocks.select("block", "doc_id", "texts").join(replies, "block", "left").drop("block").mapInArrow(lean(run), schema)


def _may_link(n_a, n_b, map_a: np.ndarray, map_b: np.ndarray, percent: int) -> np.ndarray:
    """The upper bound from bit counts; broadcasts over rows of maps."""
    only_a = np.bitwise_count(map_a & ~map_b).sum(axis=-1, dtype=np.int64)
    only_b = np.bitwise_count(map_b & ~map_a).sum(axis=-1, dtype=np.int64)
    most = np.minimum(n_a - only_a, n_b - only_b)
    return 100 * most >= percent * (n_a + n_b - most)


def _maps(values: list[bytes]) -> np.ndarray:
    return np.frombuffer(b"".join(values), np.uint64).reshape(len(values), -1)


def _verify(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """The linked ones of ``pairs (a, b)``."""
    side = lambda s: sets.select(F.col("key").alias(s), F.col("n").alias(f"n_{s}"), F.col("map").alias(f"map_{s}"), F.col("hashes").alias(f"set_{s}"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            n_a, n_b = batch["n_a"].to_numpy(), batch["n_b"].to_numpy()
            near = _may_link(n_a, n_b, _maps(batch["map_a"].to_pylist()), _maps(batch["map_b"].to_pylist()), percent)
            good = []
            for i in np.flatnonzero(near).tolist():
                a, b = (np.frombuffer(batch[c][i].as_py(), np.uint64) for c in ("set_a", "set_b"))
                if linked(len(np.intersect1d(a, b, assume_unique=True)), len(a), len(b), percent):
                    good.append(i)
            at = pa.array(good, pa.int64())
            yield pa.RecordBatch.from_arrays([batch["a"].take(at), batch["b"].take(at)], names=["a", "b"])

    return pairs.join(side("a"), "a").join(side("b"), "b").mapInArrow(lean(run), "a long, b long")


def _tile_links(members: DataFrame, percent: int) -> DataFrame:
    """Links between ``members (family, key, comp, n, map, hashes)`` of a family that lie in different components."""
    ratio = math.log(100 / percent)
    band = F.floor(F.log(F.col("n")) / ratio)
    members = members.withColumn("band", band)
    sizes = members.groupBy("family", "band", "comp").count()
    large = sizes.where(F.col("count") >= OWN).select("family", "band", "comp", F.col("comp").alias("own"))
    placed = members.join(large, ["family", "band", "comp"], "left")
    cells = placed.groupBy("family", "band", "own").agg(F.ceil(F.greatest(F.count("*") / TILE, F.sum("n") / TILE_SHINGLES)).cast("int").alias("tiles"))
    placed = placed.join(cells.withColumnRenamed("own", "_own").withColumnRenamed("family", "_f").withColumnRenamed("band", "_b"), F.expr("family = _f AND band = _b AND own <=> _own"))
    cell = F.concat_ws(":", "family", "band", F.coalesce(F.col("own").cast("string"), F.lit("-")))
    tile = placed.select(cell.alias("cell"), F.pmod(F.xxhash64("key"), F.col("tiles").cast("long")).cast("int").alias("tile"), "key", "comp", "n", "map", "hashes")
    tiles = cut_lineage(tile.groupBy("cell", "tile").agg(F.collect_list(F.struct("key", "comp", "n", "map", "hashes")).alias("sets")))

    cells = cut_lineage(cells.withColumn("cell", cell))
    left, right = (cells.select("family", *[F.col(c).alias(f"{c}_{s}") for c in ("cell", "band", "own", "tiles")]) for s in "ab")
    met = left.withColumn("band_b", F.explode(F.array("band_a", F.col("band_a") + 1))).join(right, ["family", "band_b"])
    met = met.where("(own_a IS NULL OR NOT own_a <=> own_b) AND (band_a < band_b OR cell_a <= cell_b)")
    units = met.select("cell_a", "cell_b", F.explode(F.sequence(F.lit(0), F.col("tiles_a") - 1)).alias("tile_a"), "tiles_b")
    units = units.select("cell_a", "tile_a", "cell_b", F.explode(F.sequence(F.lit(0), F.col("tiles_b") - 1)).alias("tile_b")).where("cell_a <> cell_b OR tile_a <= tile_b")
    side = lambda s: tiles.select(F.col("cell").alias(f"cell_{s}"), F.col("tile").alias(f"tile_{s}"), F.col("sets").alias(f"sets_{s}"))
    work = units.join(side("a"), ["cell_a", "tile_a"]).join(side("b"), ["cell_b", "tile_b"]).select("sets_a", "sets_b")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                a, b = batch["sets_a"][i].values, batch["sets_b"][i].values
                links = _compare(a.to_pylist(), b.to_pylist(), percent)
                yield pa.RecordBatch.from_arrays([pa.array([x for x, _ in links], pa.int64()), pa.array([y for _, y in links], pa.int64())], names=["a", "b"])

    return work.mapInArrow(lean(run), "a long, b long")


def _compare(a: list[dict], b: list[dict], percent: int) -> list[tuple[int, int]]:
    """Links between two tiles that join different components; one link per pair of components is enough."""
    parent: dict[int, int] = {}

    def root(x: int) -> int:
        while parent.setdefault(x, x) != x:
            parent[x] = x = parent[parent[x]]
        return x

    maps, n = _maps([s["map"] for s in b]), np.array([s["n"] for s in b], np.int64)
    sets: list[np.ndarray | None] = [None] * len(b)
    out = []
    for s in a:
        own = None
        near = _may_link(s["n"], n, np.frombuffer(s["map"], np.uint64), maps, percent)
        for j in np.flatnonzero(near).tolist():
            t = b[j]
            if root(s["comp"]) == root(t["comp"]):
                continue
            own = np.frombuffer(s["hashes"], np.uint64) if own is None else own
            sets[j] = np.frombuffer(t["hashes"], np.uint64) if sets[j] is None else sets[j]
            if linked(len(np.intersect1d(own, sets[j], assume_unique=True)), s["n"], t["n"], percent):
                parent[root(s["comp"])] = root(t["comp"])
                out.append((s["key"], t["key"]))
    return out


def _with_partners(shared: DataFrame) -> DataFrame:
    """Rows of ``shared (sig, key, n, most)`` for whom some size range of the same shingle may hold a partner.

    Two sets of sizes a and b can link by this shingle only if a <= most of b and b <= most of a. A range of sizes is
    summed up by its least size and its greatest ``most``; a shingle has ``STEPS`` ranges per doubling of sizes at most,
    however many sets share it.
    """
    step = F.floor(F.log2("n") * STEPS)
    ranges = shared.groupBy("sig", step.alias("step")).agg(F.min("n").alias("n"), F.max("most").alias("most"), F.min("key").alias("a"), F.max("key").alias("z"))
    others = ranges.groupBy("sig").agg(F.collect_list(F.struct("n", "most")).alias("ranges"), F.min("a").alias("a"), F.max("z").alias("z")).where("a <> z").select("sig", "ranges")
    return shared.join(others, "sig").where("exists(ranges, r -> r.n <= most AND n <= r.most)").drop("ranges")


def _told_apart(rows: DataFrame) -> tuple[DataFrame, DataFrame]:
    """``rows (key, check, doc_id, ...)`` with a number of its own for each set, and one row per number.

    ``key`` and ``check`` are two hashes of the set. Different sets that share a key (one expected among some 10^10
    sets) get new keys from both hashes, until none share; only sets equal in 128 bits are taken for one another.
    """
    for turn in range(8):
        reps = cut_lineage(rows.where("key IS NOT NULL").groupBy("key").agg(F.min("doc_id").alias("first"), F.min("check").alias("low"), F.max("check").alias("high")))
        shared = reps.where("low <> high").select(F.col("key").alias("__gc_key"))
        if shared.isEmpty():
            return rows, reps
        joined = rows.join(shared, F.col("key") == F.col("__gc_key"), "left")
        new = F.when(F.col("__gc_key").isNotNull(), F.xxhash64("key", "check", F.lit(turn))).otherwise(F.col("key"))
        rows = cut_lineage(joined.withColumn("key", new).drop("__gc_key"))
    raise RuntimeError("shingle sets still share numbers")


def near_duplicates(docs: DataFrame, width: int = 5, percent: int = 80) -> DataFrame:
    """``doc_id, n_shingles, component_id`` for every row of ``docs (doc_id, text, ...)``.

    Words are runs of anything but ASCII white space after lower-casing A-Z; a document's set are its distinct
    ``width``-word shingles (64-bit hashes), with fewer words the whole sequence. Two documents link when
    100 * intersection >= percent * union; ``component_id`` is the smallest doc_id reachable by links. NULL and
    empty texts link with nothing and are their own component. Rows with a NULL doc_id have no component. Rows that
    repeat an id have one component if their texts link, else the smallest of what they reach each. An empty table gives no rows.
    """
    blocks = stored(in_blocks(id_text(docs), None, _block, "doc_id array<long>, n_words long, texts binary", BLOCK_BYTES // 3))  # a block's sets take several times its text
    total = blocks.agg(F.sum("n_words")).first()[0] or 0
    replies = exchange(blocks.select("block", "doc_id", "texts"), lambda row: _numbered(row, width)[2:], total, BITS)
    rows = cut_lineage(_with_beginnings(blocks, replies, width, percent))
    rows, reps = _told_apart(rows)
    shared = rows.select(F.explode(F.arrays_zip("sigs", "most")).alias("s"), "key", "n").select("s.sigs", "key", "n", "s.most").withColumnRenamed("sigs", "sig")
    shared = cut_lineage(_with_partners(cut_lineage(shared)).select("sig", "key"))

    hubs = shared.groupBy("sig").agg(F.min("key").alias("a"), F.max("key").alias("top")).where("a <> top").select("sig", "a")
    pairs = cut_lineage(shared.join(hubs, "sig").where("key <> a").select("a", F.col("key").alias("b")).distinct())
    families = components(pairs)
    found = rows.where("hashes IS NOT NULL").select("key", "n", "map", "hashes").join(families.select(F.col("node").alias("key")), "key")
    sets = stored(found.groupBy("key").agg(F.first("n").alias("n"), F.first("map").alias("map"), F.first("hashes").alias("hashes")), "key")
    # first each set with one hub; then the pairs that this has not connected
    tree = cut_lineage(_verify(pairs.groupBy("b").agg(F.min("a").alias("a")), sets, percent))
    parts = components(tree)
    label = lambda s: parts.select(F.col("node").alias(s), F.col("label").alias(f"label_{s}"))
    apart = pairs.join(label("a"), "a", "left").join(label("b"), "b", "left").where("coalesce(label_a, a) <> coalesce(label_b, b)").select("a", "b")
    links = cut_lineage(tree.unionByName(_verify(cut_lineage(apart), sets, percent)))
    parts = components(links)
    members = families.select(F.col("node").alias("key"), F.col("label").alias("family")).join(parts.withColumnRenamed("node", "key"), "key", "left")
    members = cut_lineage(members.select("key", "family", F.coalesce("label", "key").alias("comp")))
    split = members.groupBy("family").agg(F.min("comp").alias("low"), F.max("comp").alias("high")).where("low <> high").select("family")
    more = cut_lineage(_tile_links(members.join(split, "family").join(sets, "key"), percent))
    labels = components(links.unionByName(more))

    named = reps.select("key", "first").join(labels.withColumnRenamed("node", "key"), "key", "left").select("key", "first", F.coalesce("label", "key").alias("label"))
    least = named.groupBy("label").agg(F.min("first").alias("component_id"))
    named = named.join(least, "label").select("key", "component_id")
    joined = rows.select("doc_id", F.col("n").alias("n_shingles"), "key").join(named, "key", "left")
    return joined.select("doc_id", "n_shingles", F.coalesce("component_id", "doc_id").alias("component_id"))


def drop_near_duplicates(docs: DataFrame, width: int = 5, percent: int = 80) -> DataFrame:
    """``docs`` with all its columns and, of each component, the row with the smallest doc_id.

    Rows with a NULL doc_id stay; of rows that repeat the smallest id of a component one stays.
    """
    found = cut_lineage(near_duplicates(docs, width, percent))
    same = lambda d, gone: d["doc_id"].cast("long") == gone["__gc_doc_id"]
    kept = without(docs, found.where("doc_id <> component_id").select("doc_id").distinct(), same)
    again = cut_lineage(found.where("doc_id = component_id").groupBy("doc_id").count().where("count > 1").select("doc_id"))
    if again.isEmpty():
        return kept
    repeated = kept.join(again.withColumnRenamed("doc_id", "__gc_doc_id"), kept["doc_id"].cast("long") == F.col("__gc_doc_id")).dropDuplicates(["__gc_doc_id"])
    return without(kept, again, same).unionByName(repeated.select(*docs.columns))


@CATALOG.add("op2_ngram_jaccard")
def op2(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(documents(spark, sf_dir), width=4, percent=85)
