"""Language-model scores by deleted interpolation of word n-grams.

Blocks of documents number their words. Word counts come back from the owners of the words, n-gram counts through a
Golomb-coded exchange of n-gram hashes, both in the order in which a block asked. Both grow with the corpus,
and no task holds more than one block or one range of hashes. Mixture weights, one set for each bucket of context
frequency, are learned by expectation-maximisation on deleted counts: every training token is held out from the counts
it is judged by.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field, replace

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from geoctx.catalog.base import Catalog
from geoctx.llm.common import BLOCK_BYTES, LOWER_BYTES, doc_bucket, documents, in_blocks, lean, pa_schema, stored
from geoctx.llm.exchange import exchange, pack, unpack
from geoctx.llm.units import Numbering, hashed, pack_strings, summed_units, unpack_strings
from geoctx.session import cut_lineage

CATALOG = Catalog()
#: Bits of an n-gram's hash: of n different n-grams about n ** 2 / 2 ** 63 pairs are taken for one another (a tenth of a pair at 10 ** 9).
BITS = 62
#: Context-frequency buckets: 0 for an unseen context, then one per power of two; the last is open.
BUCKETS = 24
#: Steps per power of two, and steps in all, at which probabilities are told apart while weights are learned.
STEPS, RANGE = 4, 160
_A, _B, _C = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB)
START = np.uint64(0x5851F42D4C957F2D)


def _words(rows: list) -> dict:
    """A block's words, numbered by frequency; a document is its words and one end (the empty word).

    The words themselves are kept in the order of their hashes, ``place`` tells where each number is among them.
    """
    number = Numbering()
    texts = [np.fromiter(map(number.__getitem__, [*text.translate(LOWER_BYTES).split(), b""]), np.int32) for _, _, text in rows]
    flat = np.concatenate(texts)
    order = np.argsort(-np.bincount(flat, minlength=len(number)), kind="stable")
    rank = np.empty(len(order), np.int32)
    rank[order] = np.arange(len(order))
    words, lengths = list(number), np.array([len(t) for t in texts])
    by_hash = np.argsort(hashed(words), kind="stable")
    place = np.empty(len(words), np.int64)
    place[rank[by_hash]] = np.arange(len(words))
    train = np.repeat([not held for _, held, _ in rows], lengths)
    weights = np.bincount(flat[train], minlength=len(words))
    return {
        "doc_id": [d for d, _, _ in rows], "held": [h for _, h, _ in rows], "n_units": len(words), "n_train": int(train.sum()),
        "units": pack_strings([words[i] for i in by_hash.tolist()]), "weights": pack(weights[by_hash]), "place": pack(place), "per_doc": pack(lengths), "seq": pack(rank[flat]),
    }


_BLOCK = "doc_id array<long>, held array<boolean>, n_units long, n_train long, units binary, weights binary, place binary, per_doc binary, seq binary"


class _Tokens:
    """A block's tokens, and the numbers of its distinct n-grams of one order."""

    def __init__(self, row: dict) -> None:
        self.row = row
        self.seq, self.lengths = unpack(row["seq"].as_py()), unpack(row["per_doc"].as_py()).astype(np.int64)
        self.first = np.cumsum(self.lengths) - self.lengths
        self.train = np.repeat(~row["held"].values.to_numpy(zero_copy_only=False).astype(bool), self.lengths)
        self.place = unpack(row["place"].as_py())

    def counts(self) -> np.ndarray:
        """The training count of each token's word."""
        return unpack(self.row["counts"].as_py())[self.place][self.seq].astype(np.float64)

    def hashes(self) -> np.ndarray:
        return hashed(unpack_strings(self.row["units"].as_py()))[self.place][self.seq]

    def before(self, values: np.ndarray, start) -> np.ndarray:
        """The value at the token before, ``start`` at a document's first."""
        out = np.empty_like(values)
        out[1:] = values[:-1]
        out[self.first] = start
        return out

    def ngrams(self, order: int) -> tuple[np.ndarray, np.ndarray]:
        """Sorted distinct hashes, and each token's place among them."""
        key = back = self.hashes()
        for _ in range(order - 1):
            back = self.before(back, START)
            key = (key * _A + back) * _B
            key ^= key >> np.uint64(29)
        key = (key * _C) >> np.uint64(64 - BITS)
        return np.unique(key, return_inverse=True)


@dataclass(frozen=True)
class Model:
    """Interpolated n-gram model: ``weights[order - 2][bucket]`` mixes the order with what lies below it."""

    order: int
    tokens: int
    types: int
    weights: list[np.ndarray] = field(default_factory=list)
    floor: float = 0.0  # share of the even distribution under the words

    def mix(self, counts: list[np.ndarray], contexts: list[np.ndarray]) -> np.ndarray:
        """Probability of each token: ``counts`` for orders 1.., ``contexts`` for orders 2..."""
        even = 1 / (self.types + 1)
        p = (1 - self.floor) * counts[0] / max(self.tokens, 1) + self.floor * even
        for weights, c, ctx in zip(self.weights, counts[1:], contexts):
            share = np.where(ctx > 0, weights[bucket(ctx)], 0.0)
            p = share * c / np.maximum(ctx, 1) + (1 - share) * p
        return p


def bucket(contexts: np.ndarray) -> np.ndarray:
    return np.minimum(np.ceil(np.log2(contexts + 1.0)).astype(np.int64), BUCKETS - 1)


def _step(p: np.ndarray) -> np.ndarray:
    """Probabilities as steps of a logarithmic scale; 0 for none."""
    with np.errstate(divide="ignore"):
        return np.where(p > 0, np.clip(np.round(-STEPS * np.log2(np.maximum(p, 1e-300))), 0, RANGE - 2) + 1, 0).astype(np.int64)


def _value(step: np.ndarray) -> np.ndarray:
    return np.where(step > 0, 2.0 ** (-(step - 1) / STEPS), 0.0)


def learn_share(n: np.ndarray, upper: np.ndarray, lower: np.ndarray, rounds: int = 60) -> float:
    """Weight of ``upper`` against ``lower`` by expectation-maximisation over held-out counts ``n``."""
    share = 0.5
    for _ in range(rounds):
        a, b = share * upper, (1 - share) * lower
        share = float(((n * a / np.maximum(a + b, 1e-300)).sum() + 0.5) / (n.sum() + 1))
    return share


class LanguageModel:
    """Counts of a corpus, joined to its blocks, and the model learned from them."""

    def __init__(self, docs: DataFrame, order: int = 2) -> None:
        """``docs (doc_id, text, held boolean)``: rows with ``held`` teach nothing."""
        self.spark, self.order = docs.sparkSession, order
        rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "held", F.coalesce("text", F.lit("")).cast("binary").alias("text"))
        self.blocks = stored(in_blocks(rows, None, _words, _BLOCK, BLOCK_BYTES // 2))
        units, self.tokens = self.blocks.agg(F.coalesce(F.sum("n_units"), F.lit(0)), F.coalesce(F.sum("n_train"), F.lit(0))).first()
        self.known = stored(summed_units(self.blocks, units))
        once = self.known.select("counts", "firsts").mapInArrow(_times, "c long, times long").groupBy("c").agg(F.sum("times").alias("times"))
        times = cut_lineage(once)
        self.types = times.agg(F.coalesce(F.sum("times"), F.lit(0))).first()[0]
        self.model = Model(order, self.tokens, self.types, [], 1.0 if not self.tokens else self._floor(times))
        for m in range(2, order + 1):
            if not self.tokens:
                self.model = replace(self.model, weights=[np.zeros(BUCKETS) for _ in range(order - 1)])
            # an n-gram needs a word; most are new, so there are a few times as many as words in the blocks
            replies = exchange(self.blocks.select("block", "held", "units", "place", "per_doc", "seq"), _request(m), 6 * units, BITS)
            self.known = stored(self._with_counts(m, replies))
            if self.tokens:
                self.model = replace(self.model, weights=[*self.model.weights, self._shares(m)])

    def _floor(self, times: DataFrame) -> float:
        """The share of the even distribution: every training token is judged by the counts without itself.

        A word that occurs c times is c tokens with a count of c - 1 left, so no pass over the texts is needed.
        """
        p = (F.col("c") - 1) / F.lit(float(max(self.tokens - 1, 1)))
        step = F.when(p > 0, F.greatest(F.least(F.bround(-STEPS * F.log2(p)), F.lit(RANGE - 2.0)), F.lit(0.0)) + 1).otherwise(0).cast("long")
        # at most RANGE rows
        rows = times.groupBy(step.alias("step")).agg(F.sum(F.col("c") * F.col("times")).alias("n")).orderBy("step").collect()
        n, up = np.array([r.n for r in rows], float), _value(np.array([r.step for r in rows]))
        return 1 - learn_share(n, up, np.full(len(n), 1 / (self.types + 1)))

    def _joined(self, *columns: str) -> DataFrame:
        return self.blocks.select("block", *columns).join(self.known, "block")

    def _with_counts(self, m: int, replies: DataFrame) -> DataFrame:
        """What is known of each block, with the count of each token's n-gram of order ``m`` and the cells to learn from.

        Cells of (bucket, upper, lower) probability come from deleted counts of training tokens.
        """
        below = self.model
        # what was learned from before is not needed again
        held = [c for c in self.known.columns if c not in ("code", "n", "firsts")]
        schema = ", ".join(["block long", *[f"{c} binary" for c in held if c != "block"], f"tokens_{m} binary", "code array<long>", "n array<long>"])
        arrow = pa_schema(self.spark, schema)

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                for i in range(batch.num_rows):
                    row = {c: batch[c][i] for c in batch.schema.names}
                    t = _Tokens(row)
                    counts, contexts = _counts(t, m - 1)
                    own = unpack(row["replies"].as_py())[t.ngrams(m)[1]]
                    contexts.append(t.before(counts[-1], _starts(t, counts[0])))
                    counts.append(own.astype(np.float64))
                    kept = t.train
                    counts = [np.maximum(c[kept] - 1, 0) for c in counts]  # the token itself is held out
                    contexts = [np.maximum(c[kept] - 1, 0) for c in contexts]
                    lower = Model(m - 1, max(below.tokens - 1, 1), below.types, below.weights, below.floor)
                    ctx = contexts[-1]
                    up, down = np.where(ctx > 0, counts[-1] / np.maximum(ctx, 1), 0.0), lower.mix(counts[:-1], contexts[:-1])
                    code, n = np.unique((bucket(ctx) * RANGE + _step(up)) * RANGE + _step(down), return_counts=True)
                    yield pa.RecordBatch.from_pylist([{c: row[c].as_py() for c in held} | {f"tokens_{m}": pack(own), "code": code, "n": n}], schema=arrow)

        columns = ("held", "units", "place", "per_doc", "seq")
        return self._joined(*columns).join(replies, "block").mapInArrow(lean(run), schema)

    def _shares(self, m: int) -> np.ndarray:
        """Weights of order ``m`` against what lies below it, one for each bucket of context frequency."""
        cells = self.known.select(F.explode(F.arrays_zip("code", "n")).alias("c")).groupBy("c.code").agg(F.sum("c.n").alias("n"))
        # at most BUCKETS x RANGE x RANGE rows, whatever the corpus
        code, n = (np.array(v) for v in zip(*[(r.code, r.n) for r in cells.orderBy("code").collect()]))
        b, up, down, n = code // RANGE // RANGE, _value(code // RANGE % RANGE), _value(code % RANGE), n.astype(float)
        shares = np.zeros(BUCKETS)
        for k in range(BUCKETS):
            at = b == k
            shares[k] = learn_share(n[at], up[at], down[at]) if k and at.any() else (shares[k - 1] if k > 1 else 0.0)
        return shares

    def scores(self) -> DataFrame:
        """``doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score`` for every row."""
        model, order = self.model, self.order
        schema = "doc_id long, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double"
        arrow = pa_schema(self.spark, schema)

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                for i in range(batch.num_rows):
                    row = {c: batch[c][i] for c in batch.schema.names}
                    t = _Tokens(row)
                    counts, contexts = _counts(t, order)
                    total = lambda v: np.add.reduceat(v, t.first)  # noqa: B023,E731
                    base = np.log10((counts[0] + 0.5) / (model.tokens + 0.5 * (model.types + 1)))
                    docs = len(t.lengths)
                    yield pa.RecordBatch.from_arrays([
                        row["doc_id"].values, row["held"].values, pa.array(t.lengths), pa.array(total((counts[0] > 0).astype(np.int64))),
                        pa.array(np.full(docs, model.tokens, np.int64)), pa.array(total(base)), pa.array(total(np.log10(model.mix(counts, contexts)))),
                    ], schema=arrow)

        learned = [c for c in self.known.columns if c in ("block", "counts") or c.startswith("tokens_")]
        blocks = self.blocks.select("block", "doc_id", "held", "place", "per_doc", "seq")
        return blocks.join(self.known.select(*learned), "block").mapInArrow(lean(run), schema)


def _times(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """How many words, each in one of its blocks, have which training count."""
    for batch in batches:
        for counts, firsts in zip(batch["counts"], batch["firsts"]):
            c = unpack(counts.as_py())[unpack(firsts.as_py()) > 0].astype(np.int64)
            values, times = np.unique(c[c > 0], return_counts=True)
            yield pa.RecordBatch.from_arrays([pa.array(values), pa.array(times)], names=["c", "times"])


def _request(order: int):
    def keys_of(row: dict) -> tuple[np.ndarray, np.ndarray]:
        t = _Tokens(row)
        keys, place = t.ngrams(order)
        return keys, np.bincount(place, t.train, len(keys)).astype(np.int64)

    return keys_of


def _starts(t: _Tokens, words: np.ndarray) -> float:
    """How many documents begin: as many as end."""
    return float(words[t.first[0] + t.lengths[0] - 1])


def _counts(t: _Tokens, order: int) -> tuple[list[np.ndarray], list[np.ndarray]]:
    """Training counts of each token's n-grams of orders 1.. and of their contexts for orders 2..., as stored with the block."""
    counts, contexts = [t.counts()], []
    for m in range(2, order + 1):
        contexts.append(t.before(counts[-1], _starts(t, counts[0])))
        counts.append(unpack(t.row[f"tokens_{m}"].as_py()).astype(np.float64))
    return counts, contexts


def language_scores(docs: DataFrame, order: int = 2) -> DataFrame:
    """Scores of every row of ``docs (doc_id, text, ...)`` by a model learned from rows whose crc32(doc_id) mod 5 is not 1.

    Words are runs of anything but ASCII white space after lower-casing A-Z; each document has one end token more,
    so a NULL or empty text is one token. ``score`` is the log10 probability of the text, ``base_score`` that of
    single words with 0.5 added to every count. NULL ids count as the empty string for the fold and keep their
    rows, repeated rows count and score each, an empty table gives no rows, other columns are not looked at.
    """
    held = docs.select(docs["doc_id"].cast("long").alias("doc_id"), docs["text"].alias("text"), (doc_bucket(docs["doc_id"]) == 1).alias("held"))
    return LanguageModel(held, order).scores()


@CATALOG.add("op9_language_model")
def op9(spark: SparkSession, sf_dir: str) -> DataFrame:
    return language_scores(documents(spark, sf_dir))
