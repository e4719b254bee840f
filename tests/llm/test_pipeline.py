"""The pipeline stage by stage against plain code, and its stages on odd tables."""

import pytest
from test_jaccard import brute
from test_tokens import _pieces

import corpus_pipeline as cp
from geoctx.llm.decontaminate import contamination, decontaminate
from geoctx.llm.exact_dedup import drop_exact_duplicates, exact_duplicates

SF = "/root/testdata/sf0.01"
DOCS = "doc_id long, text string, lang string, source string, n_chars long"


def lower(t):
    return (t or "").translate(str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"))


def words(t):
    import re

    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", lower(t))


def plain_hits(text, items, n=13):
    w = words(text)
    hit, found = set(), set()
    for name, item in items:
        b = words(item)
        size = min(n, len(b))
        wins = {tuple(b[i:i + size]) for i in range(len(b) - size + 1)} if b else set()
        for i in range(len(w) - size + 1) if size else ():
            if tuple(w[i:i + size]) in wins:
                hit |= set(range(i, i + size))
                found.add(name)
    return len(w), len(hit), sorted(found)


def test_stages_on_the_table(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    labels = {r.doc_id: r.quality for r in spark.read.parquet(f"{SF}/labels.parquet").collect()}
    kept = cp.keep_quality(spark, docs, SF)
    assert kept.columns == docs.columns
    rows = {r.doc_id: r.text for r in kept.collect()}
    good = [d for d, q in labels.items() if q == 1]
    assert sum(d in rows for d in good) >= 0.98 * len(good)
    bad = [d for d, q in labels.items() if q == 0]
    assert sum(d in rows for d in bad) <= 0.2 * len(bad)

    one = cp.drop_copies(spark, kept, SF)
    last = {}
    for d, t in rows.items():
        last[lower(t)] = max(d, last.get(lower(t), d))
    assert one.columns == docs.columns and sorted(r.doc_id for r in one.collect()) == sorted(last.values())

    near = cp.drop_near_copies(spark, one, SF)
    want = brute([(d, rows[d]) for d in last.values()], 5, 80)
    alone = sorted(d for d, (_, c) in want.items() if c == d)
    assert near.columns == docs.columns and sorted(r.doc_id for r in near.collect()) == alone

    items = [(str(r.item_id), r.text) for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()]
    clean = cp.drop_contaminated(spark, near, SF)
    left = [d for d in alone if not (lambda n, h, _: h > 0 and 20 * h >= n)(*plain_hits(rows[d], items))]
    assert clean.columns == docs.columns and sorted(r.doc_id for r in clean.collect()) == left

    out = {r.doc_id: r for r in cp.encode(spark, clean, SF).collect()}
    sp = _pieces()
    assert sorted(out) == left
    for d, r in out.items():
        assert list(r.ids) == sp.encode(rows[d]) and r.n_tokens == len(r.ids) and r.decoded == sp.decode(sp.encode(rows[d]))
    assert sorted(r.doc_id for r in cp.run(spark, SF).select("doc_id").collect()) == left


@pytest.fixture(scope="module")
def odd(spark):
    rows = [(1, "Same Text", "a", "s", 1), (1, "Same Text", "a", "s", 1), (2, "same text", None, None, None), (None, "SAME TEXT", "b", "s", 2), (None, None, "b", "s", 2), (3, "", "c", "s", 0), (4, None, "c", "s", 0), (5, "x" * 200_000, "c", "s", 0), (1, "other", "z", "s", 1)]
    return spark.createDataFrame([(*r, "e", 7) for r in rows], DOCS + ", _id string, kept int")


def test_exact_duplicates_of_odd_rows(odd):
    got = sorted(((r.doc_id is None, r.doc_id or 0), r.keep_id, r.group_size, r.kept) for r in exact_duplicates(odd).collect())
    assert got == sorted([((False, 1), 2, 4, False), ((False, 1), 2, 4, False), ((False, 2), 2, 4, True), ((True, 0), 2, 4, False), ((True, 0), 4, 3, False), ((False, 3), 4, 3, False), ((False, 4), 4, 3, True), ((False, 5), 5, 1, True), ((False, 1), 1, 1, True)])
    left = drop_exact_duplicates(odd)
    assert left.columns == odd.columns and sorted(r.doc_id for r in left.collect()) == [1, 2, 4, 5]
    again = odd.where("doc_id = 1 and text = 'Same Text'")
    assert [r.kept for r in exact_duplicates(again).orderBy("kept").collect()] == [False, True] and drop_exact_duplicates(again).count() == 1
    assert exact_duplicates(odd.where("n_chars > 99")).collect() == [] and drop_exact_duplicates(odd.where("n_chars > 99")).collect() == []


def test_stages_keep_going_on_odd_and_empty_tables(spark, odd):
    for _, stage in cp.STAGES[:-1]:
        for docs in (odd, odd.where("n_chars > 99")):
            assert stage(spark, docs, "/root/testdata/sf0.001").columns == odd.columns
            stage(spark, docs, "/root/testdata/sf0.001").collect()


def test_hits_of_short_items_repeats_and_nulls(spark):
    items = [("a", "one two"), ("b", "Alpha, beta! gamma-delta epsilon"), ("c", " ".join(f"w{i}" for i in range(30))), (None, "uno dos tres"), ("d", None), ("e", "..."), ("a", "one two")]
    bench = spark.createDataFrame(items, "item_id string, text string")
    texts = ["x one two y", "alpha beta gamma delta epsilon", "alpha beta gamma delta", " ".join(f"W{i}" for i in range(3, 25)), "pad " * 5000 + " ".join(f"w{i}" for i in range(13)) + " pad" * 3, None, "", "uno, dos; TRES", "one one two two one two", "é w0 w1"]
    docs = spark.createDataFrame([(i, t, 0) for i, t in enumerate(texts)] + [(None, texts[0], 0), (0, texts[0], 0)], "doc_id long, text string, spans int")
    got = sorted(((r.doc_id if r.doc_id is not None else -1), r.n_words, r.n_hit, list(r.items), r.contaminated) for r in contamination(docs, bench).collect())
    want = []
    for d, t in [*enumerate(texts), (-1, texts[0]), (0, texts[0])]:
        n, h, names = plain_hits(t, [(x or "", y) for x, y in items])
        want.append((d, n, h, names, h > 0 and 20 * h >= n))
    assert got == sorted(want)
    spans = {r.doc_id: r.text for r in decontaminate(docs, bench, remove="spans").collect()}
    assert spans[0] == "x y" and spans[5] is None and spans[9] == "é w0 w1" and spans[7] == "" and len(words(spans[4])) == 5003
    assert contamination(docs, bench.where("item_id = 'zz'")).where("n_hit > 0").count() == 0
