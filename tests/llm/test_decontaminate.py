"""Decontamination with a benchmark too large to be sent to every task: the same rows, and right ones."""

import pytest
from test_pipeline import SF, plain_hits

from geoctx.llm import decontaminate as dc

SCHEMA = "doc_id long, text string, g string, len int"  # names that the operator uses itself


def rows(found):
    return sorted(((r.doc_id, r.n_words, r.n_hit, sorted(r.items), r.contaminated) for r in found.collect()), key=repr)


@pytest.mark.parametrize("limit", [0, 500_000])
def test_both_ways_equal_plain_code(spark, monkeypatch, limit):
    monkeypatch.setattr(dc, "BROADCAST_ROWS", limit)
    long_item = " ".join(f"w{i % 40}" for i in range(60))
    items = [("a", "One two three four five six seven eight nine ten eleven twelve thirteen fourteen"), ("b", "short item"), ("c", "x"),
             ("d", long_item), ("e", "short item"), ("f", ""), ("g", None), (None, "lone words here")]
    texts = [items[0][1], "Say: SHORT, item! " + "pad " * 100, "x " * 30, long_item + " " + long_item, "y " * 5000 + long_item, "", None,
             "one two three four five six seven eight nine ten eleven twelve", "lone words here", "nothing of it", "x"]
    data = [(i, t, "k", 1) for i, t in enumerate(texts)] + [(3, texts[3], "k", 2), (None, "short item", "k", 3), (9, "x", "k", 4)]
    docs, bench = spark.createDataFrame(data, SCHEMA).repartition(5), spark.createDataFrame(items, "item_id string, text string")
    want = []
    for i, t, *_ in data:
        n, hit, found = plain_hits(t, [(a or "", b or "") for a, b in items])
        want.append((i, n, hit, found, hit > 0 and 20 * hit >= n))
    found = dc.contamination(docs, bench)
    assert rows(found) == sorted(want, key=repr)
    left = dc.decontaminate(docs, bench)
    assert left.columns == docs.columns
    assert sorted((r.doc_id is None, r.doc_id or 0, r.len) for r in left.collect()) == sorted(
        (d[0] is None, d[0] or 0, d[3]) for d, w in zip(data, want) if not w[4])
    assert rows(dc.contamination(docs, bench.limit(0))) == sorted(((w[0], w[1], 0, [], False) for w in want), key=repr)
    assert dc.contamination(docs.limit(0), bench).count() == 0


def test_both_ways_agree_on_the_table(spark, monkeypatch):
    docs, bench = spark.read.parquet(f"{SF}/documents.parquet"), spark.read.parquet(f"{SF}/benchmark.parquet")
    sent = rows(dc.contamination(docs, bench))
    taken, plain = [], dc._rejoin
    monkeypatch.setattr(dc, "BROADCAST_ROWS", 0)
    monkeypatch.setattr(dc, "_rejoin", lambda *a: taken.append(1) or plain(*a))
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        assert rows(dc.contamination(docs, bench)) == sent and taken
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
