"""Shard files against the library, keyed access against all rows, and the index by itself."""

import zlib

import numpy as np
import public_tokenizers as P
import pytest
from test_tokens import ODD, _tokenizer

from geoctx.llm.token_files import PerfectHash, Shard, lookup_tokens, read_tokens, shard_bytes, write_tokens

WORD = P.path("word_bpe_49k.json")


def _want(rows):
    lib, start, out = _tokenizer(), 0, []
    for d, t in rows:
        ids = lib.encode(t or "", add_special_tokens=False).ids + [2]
        out.append((d, start, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes())))
        start += len(ids)
    return out


@pytest.mark.parametrize("sf", ["0.001", "0.01"])
def test_whole_table(spark, sf):
    import __spark_entry__ as entry

    sf_dir = f"/root/testdata/sf{sf}"
    rows = sorted(tuple(r) for r in spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text").collect())
    got = entry.queries()["op3_token_files"](spark, sf_dir)
    assert [d for d, _ in got.dtypes] == ["doc_id", "start", "n_tokens", "ids_crc32"]
    assert sorted(map(tuple, got.collect())) == _want(rows)


def test_odd_texts_many_shards_and_lookup(spark, tmp_path):
    rows = [(i * 7 - 40, t, b"x", 1) for i, t in enumerate(ODD)] + [(None, "null id", b"y", 2), (2, "same id", b"z", 3), (2, "same id", b"z", 3)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, content binary, start int").repartition(3)
    write_tokens(docs, str(tmp_path / "a"), WORD, shard=400)
    got = read_tokens(spark, str(tmp_path / "a")).orderBy("start").collect()
    assert [r.doc_id for r in got] == sorted([r[0] for r in rows], key=lambda k: (k is not None, k or 0))
    lib, by_key = _tokenizer(), {}
    for r in got:
        by_key.setdefault(r.doc_id, []).append(list(r.ids))
    for d, t, *_ in rows:
        assert lib.encode(t or "", add_special_tokens=False).ids + [2] in by_key[d]
    assert all(a.start + len(a.ids) == b.start for a, b in zip(got, got[1:]))
    keys = spark.createDataFrame([(k,) for k in [-40, 2, 2, 9, 10**9, None, *range(50, 70)]], "doc_id long")
    found = lookup_tokens(spark, str(tmp_path / "a"), keys).collect()
    asked = {-40, 2, 9, *range(50, 70)}
    assert sorted((r.doc_id, list(r.ids)) for r in found) == sorted((k, i) for k, many in by_key.items() if k in asked for i in many)
    held = spark.read.parquet(str(tmp_path / "a" / "manifest")).orderBy("part", "number").collect()
    assert len(held) > 3 and all((r.first is None) == (r.keys == 0) for r in held)
    spans = [(r.first, r.last) for r in held if r.keys]
    assert all(a <= b for a, b in spans) and all(x[1] <= y[0] for x, y in zip(spans, spans[1:]))
    none = lookup_tokens(spark, str(tmp_path / "a"), spark.createDataFrame([(10**9,), (None,)], "doc_id long"))
    assert none.columns == ["doc_id", "ids"] and none.collect() == []


def test_lookup_opens_only_the_shards_asked_for(spark, tmp_path):
    write_tokens(spark.range(400).selectExpr("id AS doc_id", "repeat('some words ', 30) AS text"), str(tmp_path / "b"), WORD, shard=2000)
    spans = spark.read.parquet(str(tmp_path / "b" / "manifest")).select("path", "first", "last").collect()
    asked = [r for r in spans if r.first <= 150 <= r.last or r.first <= 7 <= r.last]
    found = lookup_tokens(spark, str(tmp_path / "b"), spark.createDataFrame([(7,), (150,)], "doc_id long"))
    assert len(spans) > 20 and sorted(found.inputFiles()) and sorted(r.doc_id for r in found.collect()) == [7, 150]
    opened = {f.rsplit("/", 1)[1] for f in found.inputFiles() if "/shards/" in f}
    assert opened == {r.path.rsplit("/", 1)[1] for r in asked}


def test_empty_table(spark, tmp_path):
    docs = spark.createDataFrame([], "doc_id long, text string")
    write_tokens(docs, str(tmp_path / "e"), WORD)
    assert read_tokens(spark, str(tmp_path / "e")).collect() == []


@pytest.mark.parametrize("n", [0, 1, 2, 63, 1000, 30_000])
def test_index_is_minimal_and_perfect(n):
    keys = np.unique(np.random.default_rng(n).integers(-(2**62), 2**62, n))
    index = PerfectHash.build(keys)
    assert sorted(index.slots(keys).tolist()) == list(range(len(keys)))
    s = Shard(shard_bytes(keys.tolist(), [int(k % 97).to_bytes(4, "little") for k in keys], 0, 0))
    assert all(s.documents(int(k))[0].tolist() == [int(k % 97)] for k in keys[:50])
    foreign = np.setdiff1d(np.random.default_rng(1).integers(-(2**62), 2**62, 1000), keys)
    assert (s.find(foreign) == -1).all()


def test_wide_ids_keep_four_bytes():
    s = Shard(shard_bytes([5], [np.array([70_000, 2], "<u4").tobytes()], 0, 0))
    assert s.ids.dtype.itemsize == 4 and s.documents(5)[0].tolist() == [70_000, 2]
