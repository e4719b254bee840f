"""Personal data against plain Python patterns, planted spans, and odd tables."""

import hashlib
import re
import subprocess
import sys
from pathlib import Path

import pytest

from geoctx.llm.personal_data import KINDS, STRICT, candidates, personal_data, reliabilities


def luhn(d):
    s = 0
    for i, c in enumerate(reversed(d)):
        x = int(c) * (1 + i % 2)
        s += x - 9 * (x > 9)
    return s % 10 == 0


def base(text):
    out = []
    for rank, kind in enumerate(KINDS):
        for m in re.finditer(STRICT[kind], text):
            d = re.sub("[^0-9]", "", m[0])
            ok = {"email": True, "ip": all(int(x) <= 255 for x in m[0].split(".")) if kind == "ip" else True, "card": 14 <= len(d) <= 19 and luhn(d), "phone": 10 <= len(d) <= 15}[kind]
            if ok:
                out.append((m.start(), rank, m.end(), kind))
    return [f"{k}:{a}:{b}" for a, _, b, k in sorted(out)]


ODD = [
    None, "", "plain words only", "😀 a.b@mail.example.com, x@y.org é 10.0.0.1. 999.1.1.1 000255.1.2.3", "+1 (555) 123-4567 and +49 30 12345678901234567", "4111 1111 1111 1111 4111-1111-1111-1112",
    "@@a@b a@b.c@d.e", "1.2.3.4.5.6.7.8 " * 400, "+1 2" * 10, "\x00 a@b.cd \n\t +33 1 23 45 67 89", "x" * 50_000 + " q@r.st", "4 " * 3_000,
]


def test_base_spans_of_odd_texts(spark):
    rows = [(i, t, "kind", 1) for i, t in enumerate(ODD)] + [(None, "n@ull.id", "x", 2), (3, "other@text.org", "x", 3), (5, ODD[5], "x", 1)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, kind string, fp int")
    got = sorted((-1 if r.doc_id is None else r.doc_id, r.base, r.n_email, r.n_ip, r.n_card, r.n_phone) for r in personal_data(docs).collect())
    want = []
    for d, t, *_ in rows:
        b = base(t or "")
        want.append((-1 if d is None else d, ",".join(b), *[sum(x.startswith(k + ":") for x in b) for k in KINDS]))
    assert got == sorted(want)
    assert personal_data(docs.where("doc_id < -5")).collect() == []


@pytest.mark.parametrize("sf", ["0.001", "0.01"])
def test_whole_table(spark, sf):
    import __spark_entry__ as entry

    sf_dir = f"/root/testdata/sf{sf}"
    texts = {r.doc_id: r.text or "" for r in spark.read.parquet(f"{sf_dir}/documents.parquet").collect()}
    rows = entry.queries()["op7_personal_data"](spark, sf_dir).collect()
    assert len(rows) == len(texts)
    for r in rows:
        want = base(texts[r.doc_id])
        assert r.base_sha256 == hashlib.sha256(",".join(want).encode()).hexdigest()
        assert set(want) <= set(filter(None, r.spans.split(",")))


def test_method_adds_written_around_spans(spark):
    clean = [(i, f"Version 1.2 of part {i}, page 12-34, order 55.66, at home (at) noon.") for i in range(60)]
    planted = [(100 + i, f"Contact phone: 555-010-{1000 + i}, mail joe{i} (at) mail (dot) example (dot) com or joe{i}@mail.example.com today, call +1 (555) 010-{1000 + i}.") for i in range(60)]
    docs = spark.createDataFrame(clean + planted, "doc_id long, text string")
    rows = {r.doc_id: r for r in personal_data(docs).collect()}
    assert all(rows[d].spans == "" for d, _ in clean)
    for d, t in planted:
        extra = set(rows[d].spans.split(",")) - set(rows[d].base.split(","))
        at = t.index("555-010")
        assert f"phone:{at}:{at + 12}" in extra and any(x.startswith("email:") for x in extra)


def test_reliabilities_separate_good_from_bad_labelers():
    import random

    rnd, counts = random.Random(3), {}
    for _ in range(4000):
        y = rnd.random() < 0.3
        v = tuple(-1 if rnd.random() < 0.2 else int(y if rnd.random() < a else not y) for a in (0.95, 0.9, 0.85, 0.6))
        counts[v] = counts.get(v, 0) + 1
    post = reliabilities(sorted(counts.items()))
    assert post[1, 1, 1, 1] > 0.97 and post[0, 0, 0, 0] < 0.03 and post[1, 1, 0, 0] > 0.5
    assert reliabilities([]) == {}


def test_cards_and_phones_without_four_digits_in_a_row(spark):
    rows = [(1, "pay with 371 449 635 398 431 now"), (2, "card 4-1-1-1-1-1-1-1-1-1-1-1-1-1-1-1 twice: 41 11 11 11 11 11 11 11"), (3, "only 123 456 789 here"), (4, "phone: 001 650 253 000 01, ask")]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = {r.doc_id: (r.base, r.n_card) for r in personal_data(docs).collect()}
    assert got == {d: (",".join(base(t)), len(base(t))) for d, t in rows} and [got[d][1] for d, _ in rows] == [1, 2, 0, 0]
    wide = candidates(docs).where("NOT strict AND kind = 'phone'").collect()
    assert [(r.doc_id, r.match) for r in wide] == [(4, "001 650 253 000 01")]


LONG = """
import sys
sys.path.insert(0, sys.argv[1])
from geoctx.llm.personal_data import personal_data
from geoctx.session import get_session
texts = ["4" * 100_000, "3." + "4" * 100_000 + " mail a@b.cd", "12 34 " * 20_000 + "x (at) y.com", "x@a" + ".b" * 50_000, "x (at) a" + " (dot) b" * 20_000]
spark = get_session("long", "local[2]", 2)
rows = personal_data(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).collect()
print("GOT", sorted((r.doc_id, r.n_card, r.base) for r in rows))
"""


def test_long_runs_in_a_new_jvm():
    done = subprocess.run([sys.executable, "-c", LONG, str(Path(__file__).resolve().parents[2])], capture_output=True, text=True, timeout=240)
    want = [(0, 0, ""), (1, 0, "email:100008:100014"), (2, 0, ""), (3, 0, "email:0:100003"), (4, 0, "")]
    assert f"GOT {want}" in done.stdout, done.stderr[-2000:]
