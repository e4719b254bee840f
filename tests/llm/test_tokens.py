"""Token counts and piece ids against the libraries, on whole tables and on odd texts."""

import hashlib

import numpy as np
import public_tokenizers as P
import pytest

from geoctx.llm.pieces import encode_decode, processor
from geoctx.llm.token_counts import token_counts
from geoctx.llm.word_bpe import word_bpe

ODD = [
    None, "", " ", "  two  blanks ", "tab\tand\nnewline\r\n", "don't we'll I'M 'S", "naïve café ÉCOLE", "école", "ΣΑΣ ΟΔΟΣ", "İstanbul", "数据 处理 123", "a b c​d",
    "x<|endoftext|>y <|startoftext|> <|ENDOFTEXT|>", "▁lead▁▁two ▁", "😀👍🏽 ok", "½²³ x2y", "\x1c\x1d a\x85b", "word " * 30_000, "z" * 20_000, "▁", "_ __ a_b", "ǅ ﬁ ſ K",
]


@pytest.fixture(scope="module")
def odd(spark):
    rows = [(i, t, "extra", 1) for i, t in enumerate(ODD)] + [(None, "null id", "x", 2), (3, "repeated id", "x", 3), (3, "repeated id", "x", 3)]
    return spark.createDataFrame(rows, "doc_id long, text string, vocab string, block int")


def _tokenizer():
    from tokenizers import Tokenizer

    return Tokenizer.from_file(P.path("word_bpe_49k.json"))


def _pieces():
    import sentencepiece

    return sentencepiece.SentencePieceProcessor(model_file=P.path("piece_bpe_32k.model"))


def _counts(rows):
    lib = _tokenizer()
    n = [len(e.ids) for e in lib.encode_batch([t or "" for _, t in rows], add_special_tokens=False)]
    return sorted(((d if d is not None else -1, len((t or "").encode()), k, k > 2048) for (d, t), k in zip(rows, n)))


def _digests(rows):
    sp = _pieces()
    out = []
    for d, t in rows:
        ids = sp.encode(t or "")
        out.append((d if d is not None else -1, len(ids), hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest(), hashlib.sha256(sp.decode(ids).encode()).hexdigest()))
    return sorted(out)


def _sorted(df):
    return sorted(tuple(-1 if i == 0 and v is None else v for i, v in enumerate(r)) for r in df.collect())


def test_counts_of_odd_texts(odd):
    rows = [(r.doc_id, r.text) for r in odd.collect()]
    assert _sorted(token_counts(odd, P.path("word_bpe_49k.json"))) == _counts(rows)


def test_pieces_of_odd_texts(odd):
    rows = [(r.doc_id, r.text) for r in odd.collect()]
    assert _sorted(encode_decode(odd, P.path("piece_bpe_32k.model"), digests=True)) == _digests(rows)
    plain = encode_decode(odd, P.path("piece_bpe_32k.model")).where("doc_id = 5").first()
    assert plain.ids == _pieces().encode(ODD[5]) and plain.decoded == ODD[5]


@pytest.mark.parametrize("sf", ["0.001", "0.01"])
def test_whole_tables(spark, sf):
    import __spark_entry__ as entry

    sf_dir = f"/root/testdata/sf{sf}"
    rows = [tuple(r) for r in spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text").collect()]
    assert _sorted(entry.queries()["op1_token_counts"](spark, sf_dir)) == _counts(rows)
    assert _sorted(entry.queries()["op10_sentencepiece"](spark, sf_dir)) == _digests(rows)


def test_empty_table(odd):
    none = odd.where("doc_id < -1")
    assert token_counts(none, P.path("word_bpe_49k.json")).collect() == []
    assert encode_decode(none, P.path("piece_bpe_32k.model")).collect() == []


def test_letters_of_the_fast_range_agree_with_the_library():
    bpe, lib = word_bpe(P.path("word_bpe_49k.json")), _tokenizer()
    for c in map(chr, range(0x21, 0x250)):
        word = f"a{c}1{c}{c}b'{c}"
        for w in word.split():
            assert np.frombuffer(bpe.text_ids(w.encode()), "<u4").tolist() == lib.encode(w, add_special_tokens=False).ids, repr(w)


def test_chunks_join_back_and_segment_alike():
    import random

    sp, rnd = processor(P.path("piece_bpe_32k.model")), random.Random(5)
    assert sp.chunks("") == [] and "".join(sp.chunks(" a  b\n.c ")) == "  a  b\n.c "
    for _ in range(3000):
        text = "".join(rnd.choice(["a", "the", "ion", " ", "  ", "\n", ".", ",", ".com", "://", "(", "'s", "--", "é", "数", "😀", "0", "12", "_", "▁", "\t", "</s>", "<0x0A>", "N", "!!"]) for _ in range(rnd.randint(1, 14)))
        ids = [i for c in sp.segment(sp.chunks(text)) for i in c]
        assert ids == sp.lib.encode(text), repr(text)
