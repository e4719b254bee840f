"""Similarity components against all pairs of plain Python sets."""

import random
import re

import numpy as np
import pytest

from geoctx.llm.ngram_jaccard import beginning, drop_near_duplicates, near_duplicates, shingles


def plain_set(text, width):
    words = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    return {tuple(words[i:i + width]) for i in range(max(1, len(words) - width + 1))} if words else set()


def brute(rows, width, percent):
    """doc_id -> (set size, component) by comparing all pairs through an inverted index."""
    sets = {d: plain_set(t, width) for d, t in rows if d is not None}
    parent = {d: d for d in sets}

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    index, seen = {}, set()
    for d, s in sets.items():
        for g in s:
            index.setdefault(g, []).append(d)
    from collections import Counter

    for d, s in sets.items():
        common = Counter(e for g in s for e in index[g] if e < d)
        for e, c in common.items():
            if 100 * c >= percent * (len(s) + len(sets[e]) - c):
                a, b = sorted((root(d), root(e)))
                parent[b] = a
    return {d: (len(s), root(d)) for d, s in sets.items()}


@pytest.mark.parametrize("sf", ["0.001", "0.01"])
def test_whole_table(spark, sf):
    import __spark_entry__ as entry

    sf_dir = f"/root/testdata/sf{sf}"
    rows = [tuple(r) for r in spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text").collect()]
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in entry.queries()["op2_ngram_jaccard"](spark, sf_dir).collect()}
    assert got == brute(rows, 4, 85)


def edited(rnd, words, edits):
    words = list(words)
    for _ in range(edits):
        words[rnd.randrange(len(words))] = f"n{rnd.randrange(10**6)}"
    return " ".join(words)


@pytest.mark.parametrize("width,percent", [(4, 85), (5, 80)])
def test_families_near_the_limit(spark, width, percent):
    """Groups whose members link in chains, in all sizes, and one group that is a third of all rows."""
    rnd = random.Random(width)
    texts = []
    for size, many in ((3, 6), (5, 8), (8, 12), (12, 20), (20, 30), (40, 60), (90, 90), (150, 330), (400, 40)):
        base = [f"w{rnd.randrange(4000)}" for _ in range(size)]
        texts += [edited(rnd, base, rnd.randint(0, max(1, size // 40))) for _ in range(many)]
        texts += [" ".join(base + [f"t{i}" for i in range(k)]) for k in range(0, size // 5, max(1, size // 50))]
    texts += [" ".join(f"u{rnd.randrange(10**6)}" for _ in range(rnd.randint(1, 80))) for _ in range(300)]
    texts += [texts[3]] * 5 + [None, "", "  \n", "A b C", "a B c", "\x1c x\x85y"]
    rnd.shuffle(texts)
    docs = spark.createDataFrame([(i, t, 1, b"k") for i, t in enumerate(texts)] + [(None, texts[0], 2, b"k")], "doc_id long, text string, n int, key binary")
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in near_duplicates(docs, width, percent).collect()}
    assert got.pop(None)[1] is None
    want = brute(list(enumerate(texts)), width, percent)
    assert got == want
    kept = drop_near_duplicates(docs.where("doc_id IS NOT NULL"), width, percent)
    assert kept.columns == docs.columns and sorted(r.doc_id for r in kept.collect()) == sorted(d for d, (_, c) in want.items() if c == d)


def test_linked_sets_meet_in_their_beginnings():
    rnd = np.random.default_rng(2)
    for percent in (80, 85):
        for _ in range(1500):
            n = int(rnd.integers(1, 300))
            common = rnd.integers(0, 2**63, n).astype(np.uint64)
            spare = n * (100 - percent) // percent  # so many may be added in all
            cut = int(rnd.integers(0, spare + 1))
            a = np.unique(np.concatenate([common, rnd.integers(0, 2**63, cut).astype(np.uint64)]))
            b = np.unique(np.concatenate([common, rnd.integers(0, 2**63, spare - cut).astype(np.uint64)]))
            seen = {int(h): 2 + int(rnd.integers(0, 5)) for h in common}  # how often elsewhere, too
            count = lambda s: np.array([seen.get(int(h), 1) for h in s])  # noqa: B023,E731
            if 100 * n >= percent * (len(a) + len(b) - n):
                (first_a, most_a), (first_b, most_b) = beginning(a, count(a), percent), beginning(b, count(b), percent)
                met, at_a, at_b = np.intersect1d(first_a, first_b, return_indices=True)
                assert met.size and ((most_a[at_a] >= len(b)) & (most_b[at_b] >= len(a))).any()


@pytest.mark.parametrize("percent", [80, 85])
def test_pages_that_share_much_but_too_little_form_no_family(spark, monkeypatch, percent):
    """One site: 90 words shared, some words of their own each, so that shared shingles stand in all beginnings. Nobody
    stays but those of a second site whose pages do link."""
    from geoctx.llm import ngram_jaccard

    rnd, kept = random.Random(percent), []
    whole = ngram_jaccard._with_partners
    monkeypatch.setattr(ngram_jaccard, "_with_partners", lambda shared: kept.append((shared, whole(shared))) or kept[-1][1])
    page = " ".join(f"s{i}" for i in range(90))
    least = {80: 13, 85: 9}[percent]
    own = lambda n: "".join(f" o{rnd.randrange(10**9)}" for _ in range(n))
    texts = [page + own(least + i % 6) for i in range(300)] + [page.replace("s", "t") + own(2 + i % 3) for i in range(12)]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in near_duplicates(docs, 4, percent).collect()}
    assert got == brute(list(enumerate(texts)), 4, percent)
    (before, after), = kept
    assert before.select("key").distinct().count() == 312 and after.select("key").distinct().count() == 12


def test_partners_by_size_and_place(spark):
    from geoctx.llm.ngram_jaccard import _with_partners

    rows = [(1, 10, 100, 99), (1, 11, 100, 99),  # each too late in its order
            (2, 20, 100, 120), (2, 21, 110, 101), (2, 22, 130, 119),  # the third would need 20 to reach 130
            (3, 30, 50, 60), (3, 30, 50, 60)]  # one set in two blocks
    got = _with_partners(spark.createDataFrame(rows, "sig long, key long, n long, most long"))
    assert sorted(map(tuple, got.select("sig", "key").collect())) == [(2, 20), (2, 21)]


def test_short_texts_and_empty_table(spark):
    assert len(shingles(b"", 4)) == 0 and len(shingles(b"one", 4)) == 1 and len(shingles(b"a b c d e", 4)) == 2
    docs = spark.createDataFrame([], "doc_id long, text string")
    assert near_duplicates(docs, 4, 85).collect() == []


def test_sets_that_share_a_number_are_told_apart(spark):
    from geoctx.llm.ngram_jaccard import _told_apart

    data = [(1, 77, 5, "a"), (2, 77, 6, "b"), (3, 77, 5, "a"), (4, 78, 5, "c"), (5, None, None, None), (6, 77, 7, "d")]
    rows, reps = _told_apart(spark.createDataFrame(data, "doc_id long, key long, check long, sigs string"))
    got = {r.doc_id: r for r in rows.collect()}
    assert len(got) == 6 and all(got[d].sigs == s for d, _, _, s in data)
    assert got[1].key == got[3].key and got[4].key == 78 and got[5].key is None
    assert len({got[d].key for d in (1, 2, 4, 6)}) == 4
    firsts = {r.key: r.first for r in reps.collect()}
    assert firsts == {got[d].key: d for d in (1, 2, 4, 6)}
