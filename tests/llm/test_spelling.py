"""Spelling variants: the index against all pairs, counts and groups against plain code, crowded halves, odd tables."""

import random
import re
import zlib

import pytest

from geoctx.llm.spelling import Index, near_summary, near_words, roots, spelling_variants, word_counts


def is_near(u, v):
    if len(u) > len(v):
        u, v = v, u
    if len(u) == len(v):
        return sum(a != b for a, b in zip(u, v)) == 1
    return len(v) - len(u) == 1 and any(v[:i] + v[i + 1:] == u for i in range(len(v)))


@pytest.mark.parametrize("letters", ["a", "ab", "abcé", "abcdefghijklmnopqrstuvwxyzßÿ"])
def test_index_finds_all_near_words(letters):
    rng = random.Random(len(letters))
    for size in (0, 1, 2, 30, 250):
        words = {"".join(rng.choice(letters) for _ in range(rng.randint(1, 9))) for _ in range(size)}
        for w in sorted(words)[::3]:  # and some that surely have near ones
            i = rng.randrange(len(w))
            words |= {w[:i] + rng.choice(letters) + w[i:], w[:i] + rng.choice(letters) + w[i + 1:], w[:i] + w[i + 1:]} - {""}
        words = sorted(words)
        a, b = near_words(words)
        assert sorted(zip(a.tolist(), b.tolist())) == [(i, j) for i, u in enumerate(words) for j, v in enumerate(words) if is_near(u, v)]


def test_both_ranks_stay_in_step():
    words = sorted({"banana", "bandana", "ananas", "nabana"})
    index = Index(words)
    text = "\0" + "\0".join(words) + "\0"
    code = {chr(c): i for i, c in enumerate(index.letters)}
    rng = random.Random(3)
    for _ in range(200):
        pattern, place = "", [0, 0, index.forwards.n]
        for _ in range(6):
            c, left = rng.choice("abn\0" if "\0" not in pattern else "abn"), rng.random() < 0.5
            if left and pattern.startswith("\0") or not left and pattern.endswith("\0"):
                continue
            pattern = c + pattern if left else pattern + c
            at, other = (place[0], place[1]) if left else (place[1], place[0])
            at, other, size = (int(v) for v in index.grown(code[c], *map(__import__("numpy").int64, (at, other, place[2])), left))
            place = [at, other, size] if left else [other, at, size]
            assert size == sum(text.startswith(pattern, i) for i in range(len(text)))
            if not size:
                break


def plain(rows, least_length=6, least_count=5, ratio=5):
    counts = {}
    for doc, text in rows:
        for run in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            run = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in run)
            h = zlib.crc32(f"{'' if doc is None else doc}:{run}".encode())
            word = run if h % 199 else run[:h % len(run)] + run[h % len(run) + 1:]
            counts[word] = counts.get(word, 0) + 1
    words = {w: n for w, n in counts.items() if len(w) >= least_length and n >= least_count}
    near = {w: [v for v in words if is_near(w, v)] for w in words}
    form = {}
    for w, n in words.items():
        best = min(near[w], key=lambda v: (-words[v], v), default=None)
        form[w] = best if best and words[best] >= ratio * n else None
    out = {}
    for w, n in words.items():
        root = w
        while form[root]:
            root = form[root]
        out[w] = (form[w], root, n, len(near[w]), words[form[w]] if form[w] else None)
    return out


def odd_rows():
    rng = random.Random(11)
    base = ["".join(rng.choice("aeiourst") for _ in range(rng.randint(6, 9))) for _ in range(30)] + ["äußerung", "ÉLÉMENTS", "Überzeug", "prefixaa", "prefixab", "prefixac"]
    rows = []
    for doc in range(400):
        words = []
        for _ in range(rng.randrange(40)):
            w = rng.choice(base) if rng.random() < 0.7 else rng.choice(base[:6])
            if rng.random() < 0.2:
                i = rng.randrange(len(w))
                w = w[:i] + rng.choice(["", "x", w[i] + "y"]) + w[i + 1:]
            words.append(rng.choice((w, w.upper(), w + ",", w + "1", "short")))
        rows.append((doc, " ".join(words)))
    return rows + [(None, "nulldoc nulldoc nulldoc nulldoc nulldoc nulldog"), (3, None), (4, ""), (5, "again again2 Repeated"), (5, "again again2 Repeated"), (6, "q" * 50_000 + " " + "ab" * 30_000)] + [(7, "w" * 300)] * 5 + [(8, "w" * 299)] * 30


def got(df):
    rows = df.collect()
    assert len(rows) == len({r.word for r in rows})
    return {r.word: (r.form, r.root, r.n, r.n_near, r.form_n) for r in rows}


@pytest.mark.parametrize("limit", [1_000_000, 400])
def test_odd_documents(spark, limit):
    rows = odd_rows()
    docs = spark.createDataFrame([(d, t, 1, "w") for d, t in rows], "doc_id long, text string, n int, word string").repartition(4)
    want = plain(rows)
    assert len(want) > 60 and sum(v[0] is not None for v in want.values()) > 10
    assert got(spelling_variants(docs, limit=limit)) == want


def test_one_half_shared_by_all(spark):
    rng = random.Random(4)
    words = sorted({"common" + "".join(rng.choice("abc") for _ in range(rng.randint(3, 7))) for _ in range(500)})
    table = spark.createDataFrame([(w, rng.randint(5, 400)) for w in words], "word string, n long")
    n = {r.word: r.n for r in table.collect()}
    want = {w: near for w in words if (near := [v for v in words if is_near(w, v)])}
    for limit in (1_000_000, 4_000):
        found = {r.word: (r.n_near, r.form, r.form_n) for r in near_summary(table, limit=limit).collect()}
        assert found == {w: (len(near), best := min(near, key=lambda v: (-n[v], v)), n[best]) for w, near in want.items()}


def test_long_chains_and_empty_tables(spark):
    forms = spark.createDataFrame([(f"w{i:02d}", f"w{i + 1:02d}") for i in range(20)], "word string, form string")
    assert {r.word: r.root for r in roots(forms).collect()} == {f"w{i:02d}": "w20" for i in range(20)}
    empty = spark.createDataFrame([], "doc_id long, text string")
    assert spelling_variants(empty).collect() == [] and word_counts(empty).collect() == []
    few = spark.createDataFrame([(1, "just one " * 3), (2, None)], "doc_id long, text string")
    assert spelling_variants(few).collect() == []
