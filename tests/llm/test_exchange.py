"""Exchanges between blocks and owners: exact sums of any size, in the order of the request."""

import random
from collections import Counter

import numpy as np
import pytest

from geoctx.llm import exchange as ex
from geoctx.llm import units


@pytest.mark.parametrize("values", [[], [0], [1, 2**32 - 1], [2**32], [5, 2**40 + 3, 2**62, 0]])
def test_packed_counts(values):
    assert ex.unpack(ex.pack(np.array(values, np.int64))).tolist() == values


def test_sums_are_exact():
    weights = np.array([2**53, 1, 2**53, 1, 2**61, 3_000_000_000, 3_000_000_000], np.int64)
    assert ex.summed(np.array([0, 0, 0, 0, 1, 2, 2]), weights, 4).tolist() == [2**54 + 2, 2**61, 6_000_000_000, 0]


def test_large_weights_through_a_job(spark, monkeypatch):
    monkeypatch.setattr(ex, "PER_OWNER", 4)
    rng, bits = random.Random(1), 62
    keys = [sorted(rng.sample([rng.randrange(1 << bits) for _ in range(9)] + [7, 1 << 61], 6)) for _ in range(5)]
    weights = [[rng.choice((1, 3_000_000_000, 2**45)) for _ in k] for k in keys]
    blocks = spark.createDataFrame([(i, k, w) for i, (k, w) in enumerate(zip(keys, weights))], "block long, k array<long>, w array<long>").repartition(3)
    ask = lambda row: (np.array(row["k"].as_py(), np.uint64), np.array(row["w"].as_py(), np.int64))
    total = Counter()
    for k, w in zip(keys, weights):
        total.update(dict(zip(k, w)))
    got = {r.block: ex.unpack(bytes(r.replies)).tolist() for r in ex.exchange(blocks, ask, 30, bits).collect()}
    assert got == {i: [total[x] for x in k] for i, k in enumerate(keys)}


@pytest.mark.parametrize("per_owner", [400_000, 3])
def test_units_summed_over_blocks(spark, monkeypatch, per_owner):
    monkeypatch.setattr(units, "PER_OWNER", per_owner)
    rng = random.Random(2)
    words = [b"", b"a", "é".encode(), b"\x00", *(f"w{i}".encode() for i in range(20))]
    rows, total = [], Counter()
    for block in range(6):
        own = rng.sample(words, rng.randrange(1, len(words)))
        own = [own[i] for i in np.argsort(units.hashed(own), kind="stable")]
        weights = [rng.choice((0, 1, 2**33)) for _ in own]
        total.update(dict(zip(own, weights)))
        rows.append((block, own, weights))
    blocks = spark.createDataFrame([(b, units.pack_strings(o), ex.pack(np.array(w))) for b, o, w in rows], "block long, units binary, weights binary").repartition(3)
    got = {r.block: (ex.unpack(bytes(r.counts)).tolist(), ex.unpack(bytes(r.firsts)).tolist()) for r in units.summed_units(blocks, 60).collect()}
    assert {b: c for b, (c, _) in got.items()} == {b: [total[x] for x in o] for b, o, _ in rows}
    marked = Counter(x for b, o, _ in rows for x, f in zip(o, got[b][1]) if f)
    assert marked == {x: 1 for _, o, _ in rows for x in o}
