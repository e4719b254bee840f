"""Scores against plain counting with the learned weights, and against the base on held-out texts."""

import math
import re
import zlib
from collections import Counter

import numpy as np
import pytest

from geoctx.llm.language_model import LanguageModel, Model, bucket, language_scores, learn_share
from pyspark.sql import functions as F


def tokens(text):
    return [*re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or "")), None]


def fold(d):
    return zlib.crc32(("" if d is None else str(d)).encode()) % 5


def brute(rows, model: Model):
    one, two, before = Counter(), Counter(), Counter()
    for d, t in rows:
        if fold(d) != 1:
            w = tokens(t)
            one.update(w), two.update(zip(["<", *w], w)), before.update(["<", *w[:-1]])
    n, v, out = sum(one.values()), len(one), []
    assert (n, v) == (model.tokens, model.types)
    for d, t in rows:
        w = tokens(t)
        base = sum(math.log10((one[x] + 0.5) / (n + 0.5 * (v + 1))) for x in w)
        score = 0.0
        for a, x in zip(["<", *w], w):
            p = (1 - model.floor) * one[x] / max(n, 1) + model.floor / (v + 1)
            if before[a]:
                share = model.weights[0][int(bucket(np.array([before[a]]))[0])]
                p = share * two[a, x] / before[a] + (1 - share) * p
            score += math.log10(p)
        out.append((d, fold(d) == 1, len(w), sum(one[x] > 0 for x in w), n, base, score))
    return out


def same(got, want):
    key = lambda r: (r[0] is not None, r[0] or 0, r[2], r[5])
    got, want = sorted(map(tuple, got), key=key), sorted(want, key=key)
    assert len(got) == len(want)
    for a, b in zip(got, want):
        assert a[:5] == b[:5] and a[5] == pytest.approx(b[5], rel=1e-9, abs=1e-9) and a[6] == pytest.approx(b[6], rel=1e-9, abs=1e-9)


def held(docs):
    from geoctx.llm.common import doc_bucket

    return docs.select("doc_id", "text", (doc_bucket(F.col("doc_id")) == 1).alias("held"))


def test_whole_table_matches_plain_counting_and_beats_the_base(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    rows = [tuple(r) for r in docs.select("doc_id", "text").collect()]
    lm = LanguageModel(held(docs))
    got = lm.scores().collect()
    same(got, brute(rows, lm.model))
    out = [r for r in got if r.held_out]
    assert sum(r.score for r in out) > sum(r.base_score for r in out) and all(r.score < 0 for r in got)


def test_odd_texts(spark):
    rows = [(i, t) for i, t in enumerate([None, "", "a b a b a B", "a a a", "x\x1cy é É", "the end", "the end", "the " * 30_000, "rare words here", "a b c"] * 3)] + [(None, "null id a b"), (2, "a b"), (2, "a b")]
    docs = spark.createDataFrame([(d, t, 1, True) for d, t in rows], "doc_id long, text string, n int, held boolean")
    lm = LanguageModel(held(docs))
    same(lm.scores().collect(), brute(rows, lm.model))
    assert len(language_scores(docs, order=3).collect()) == len(rows)
    assert language_scores(docs.where("doc_id > 1000")).collect() == []


def test_nothing_to_learn_from(spark):
    ids = [i for i in range(60) if fold(i) == 1]
    got = language_scores(spark.createDataFrame([(i, "a b") for i in ids], "doc_id long, text string")).collect()
    assert len(got) == len(ids) and all(r.train_tokens == 0 and r.n_known == 0 and r.base_score == 0 and r.score == 0 for r in got)


def test_learned_share_maximises_likelihood():
    rng = np.random.default_rng(0)
    up, down, n = rng.random(500), rng.random(500) * 0.3, rng.integers(1, 50, 500)
    best = learn_share(n, up, down)
    like = lambda s: (n * np.log(s * up + (1 - s) * down)).sum()
    assert like(best) >= max(like(s) for s in np.linspace(0.01, 0.99, 99)) - 1.0
