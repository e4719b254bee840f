"""Language identification: held-out accuracy, sizes against plain compression, odd tables."""

import zlib

import pytest
import zstandard

from geoctx.llm.language_id import LEVEL, PIECE, UNDECIDED, Coder, identify, learn, letters


def test_held_out_languages(spark):
    import __spark_entry__ as entry

    sf_dir = "/root/testdata/sf0.1"
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    rows = entry.queries()["op13_language_id"](spark, sf_dir).join(docs.select("doc_id", "lang", "text"), "doc_id").collect()
    assert len(rows) == docs.count()
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 5 == 0) and 0 <= r.score <= 1 for r in rows)
    assert {r.lang_pred for r in rows} <= {r.lang for r in rows} | {UNDECIDED}
    held = [r for r in rows if r.held_out]
    assert sum(r.lang_pred == r.lang for r in held) > 0.98 * len(held)
    sure = [r for r in held if r.sure]
    assert len(sure) > 0.9 * len(held) and sum(r.lang_pred == r.lang for r in sure) > 0.99 * len(sure)


def test_sizes_are_those_of_plain_compression():
    dictionaries = {"a": b" the cat and the dog went home " * 40, "b": b" le chat et le chien sont la " * 40}
    coder = Coder(dictionaries)
    text = "The dog and the cat, and le chien! " * 400
    data, want = letters(text), []
    settings = zstandard.ZstdCompressionParameters.from_level(LEVEL, write_content_size=False, write_checksum=False, write_dict_id=False)
    for lang in sorted(dictionaries):
        plain = zstandard.ZstdCompressor(dict_data=zstandard.ZstdCompressionDict(dictionaries[lang], dict_type=zstandard.DICT_TYPE_RAWCONTENT), compression_params=settings)
        pieces = [data[i:i + PIECE] for i in range(0, len(data), PIECE)]
        want.append(sum(len(plain.compress(p)) for p in pieces))
        for p in pieces:  # nothing of the text is lost
            back = zstandard.ZstdDecompressor(dict_data=zstandard.ZstdCompressionDict(dictionaries[lang], dict_type=zstandard.DICT_TYPE_RAWCONTENT))
            assert back.decompress(plain.compress(p), max_output_size=PIECE) == p
    got = coder.sizes(data)
    assert all(abs(g - w) <= 8 * len(pieces) for g, w in zip(got, want))  # prepared tables may match a little otherwise
    assert coder.best("the cat and the dog")[0] == "a" and coder.best("le chien et le chat")[0] == "b"


@pytest.mark.parametrize("text", [None, "", " \n", "12 345 !?", "_"])
def test_nothing_to_judge(text):
    assert Coder({"a": b"some words here"}).best(text) == (UNDECIDED, 0.0, 0.0)


def test_narrow_margins_are_rejected(spark):
    same = b" words that both languages share " * 30
    docs = spark.createDataFrame([(1, "words that both share"), (2, "none of it: zyx wvu")], "doc_id long, text string")
    assert [r.lang_sure for r in identify(docs, {"a": same, "b": same}).collect()] == [False, False]
    assert {r.lang_best for r in identify(docs, {"a": same, "b": same}).collect()} == {"a"}


def test_odd_tables(spark):
    words = {"x": "alpha beta gamma delta ", "y": "uno dos tres cuatro ", "z": "één twee drie vier "}
    rows = [(i, None if i % 11 == 0 else w * (1 + i % 9), None if i % 13 == 0 else lang, "best") for i in range(300) for lang, w in words.items()]
    rows += [(None, "alpha beta", "x", "b")] * 3 + [(5, "uno dos " * 200_000, "y", "c"), (6, "12", "y", None), (7, "dos " * 40, None, None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, lang_best string").repartition(4)
    learned = learn(docs, docs_each=20)
    assert sorted(learned) == ["x", "y", "z"] and learn(docs.repartition(2), docs_each=20) == learned
    got = identify(docs, learned)
    assert got.columns == ["doc_id", "text", "lang", "lang_best", "lang_share", "lang_margin", "lang_sure"]
    out = got.collect()
    assert len(out) == len(rows)
    assert all(r.lang_best == UNDECIDED if r.text in (None, "12") else r.lang is None or r.lang_best == r.lang for r in out)
    empty = docs.where("doc_id > 9999")
    assert learn(empty) == {} and identify(empty, learned).collect() == []
    assert {r.lang_best for r in identify(docs, {}).collect()} == {UNDECIDED}
    one = identify(docs.where("text IS NOT NULL AND doc_id = 1"), {"x": learned["x"]}).collect()
    assert {(r.lang_best, r.lang_share) for r in one} == {("x", 1.0)}
    short = identify(docs.limit(5), {"x": b"ab", "y": b""}).collect()
    assert len(short) == 5


def test_total_size_of_dictionaries(spark):
    docs = spark.createDataFrame([(i, f"word{i} " * 300, f"l{i % 50}") for i in range(400)], "doc_id long, text string, lang string")
    assert max(map(len, learn(docs, total=50_000).values())) <= 1_000
