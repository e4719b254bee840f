"""License scans against plain search, a longest common subsequence, and odd texts."""

import random
import re

from geoctx.llm.licenses import TEMPLATES, align, license_scan, license_words, scan, _templates

LINES = {
    "Released under the MIT License.": "MIT", "This work is licensed under the GNU General Public License, version 3.": "GPL-3.0",
    "Licensed under CC BY-NC 4.0.": "CC-BY-NC-4.0", "Licensed under the Apache License, Version 2.0.": "Apache-2.0",
}


def lcs(a, b):
    row = [0] * (len(b) + 1)
    for x in a:
        last = 0
        for j, y in enumerate(b, 1):
            last, row[j] = row[j], last + 1 if x == y else max(row[j], row[j - 1])
    return row[-1]


def test_alignment_is_a_common_subsequence():
    rnd = random.Random(1)
    for _ in range(300):
        b = [rnd.choice(b"abcdefghijklmnopq".decode()).encode() for _ in range(rnd.randint(0, 14))]
        a = [w for w in b if rnd.random() < 0.85]
        for _ in range(rnd.randint(0, 4)):
            a.insert(rnd.randint(0, len(a)), rnd.choice([b"x", b"a", b"z"]))
        pairs = align(a, b)
        assert all(a[i] == b[j] for i, j in pairs)
        assert all(p[0] < q[0] and p[1] < q[1] for p, q in zip(pairs, pairs[1:]))
        assert len(pairs) <= lcs(a, b)
        if len(set(b)) == len(b) == len(pairs):
            assert lcs(a, b) == len(b)


def test_changed_long_notice_is_found_by_coverage():
    known = _templates(TEMPLATES)
    text = next(t for n, t in TEMPLATES if n == "MIT" and len(t) > 100)
    words = text.split()
    changed = " ".join(w for i, w in enumerate(words) if i % 17)
    got = scan(("before " * 50 + changed + " after" * 40).encode(), known)
    assert [g[0] for g in got] == ["MIT"] and 0.9 <= got[0][1] < 1 and got[0][2] >= 50
    assert scan(" ".join(words[: len(words) // 2]).encode(), known) == []
    assert scan(b"Licensed under the Mozilla License, Version 2.0", known) == []
    twice = scan(b"x Released under the MIT License. y z Released under the MIT License. Licensed under CC BY-NC 4.0", known)
    assert [g[0] for g in twice] == ["MIT", "MIT", "CC-BY-NC-4.0"]


def test_notice_with_as_many_changed_words_as_coverage_allows():
    known, tried = _templates(TEMPLATES), 0
    for t in known:
        once = [i for i, w in enumerate(t.words) if t.words.count(w) == 1]
        spare = len(t.words) - -(-len(t.words) * 9 // 10)
        if spare:
            changed = [b"other%d" % i if i in once[1::len(once) // spare][:spare] else w for i, w in enumerate(t.words)]
            assert sum(x != y for x, y in zip(changed, t.words)) == spare
            got = scan(b"before " * 50 + b" ".join(changed) + b" after" * 40, known)
            assert [(g[0], g[4]) for g in got] == [(t.name, len(t.words) - spare)], t
            tried += 1
    assert tried > 5


def test_notices_back_to_back_are_all_found():
    known = _templates(TEMPLATES)
    for name, text in TEMPLATES:
        n = len(license_words(text.encode()))
        for copies in (2, 3, 7, 50):
            assert [g[:4] for g in scan(f"{text} ".encode() * copies, known)] == [(name, 1.0, i * n, i * n + n) for i in range(copies)]
    mixed = ["Released under the MIT License.", "Licensed under the MIT License.", "Licensed under CC BY 4.0.", "Licensed under CC BY-SA 4.0."]
    rnd = random.Random(2)
    for _ in range(200):
        names = [rnd.choice(mixed) for _ in range(rnd.randint(2, 9))]
        assert [g[0] for g in scan(" ".join(names).encode(), known)] == [dict((x, y) for y, x in TEMPLATES)[x] for x in names]


def test_whole_table_finds_exactly_the_planted_lines(spark):
    import __spark_entry__ as entry

    sf_dir = "/root/testdata/sf0.01"
    rows = {r.doc_id: r for r in entry.queries()["op5_license_scan"](spark, sf_dir).collect()}
    texts = {r.doc_id: r.text for r in spark.read.parquet(f"{sf_dir}/documents.parquet").collect()}
    assert rows.keys() == texts.keys()
    keys = {b" ".join(license_words(line.encode())): name for line, name in LINES.items()}
    for d, t in texts.items():
        flat = b" " + b" ".join(license_words(t.encode())) + b" "
        assert set(rows[d].licenses) == {name for k, name in keys.items() if b" " + k + b" " in flat}, d
        assert rows[d].n_words == len(re.findall("[0-9a-z\x80-\U0010ffff]+", re.sub("[A-Z]", lambda m: m[0].lower(), t)))


def test_odd_tables(spark):
    rows = [(1, None, "x"), (2, "", "x"), (None, "Licensed under CC BY 4.0", "x"), (3, "Licensed under CC BY 4.0", "x"), (3, "Licensed under CC BY 4.0", "x"), (4, "the " * 50_000 + "Released under the MIT License", "x"), (5, "license " * 20_000, "x")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, best string")
    got = sorted((r.doc_id or 0, r.best, r.n_matches) for r in license_scan(docs).collect())
    assert got == [(0, "CC-BY-4.0", 1), (1, None, 0), (2, None, 0), (3, "CC-BY-4.0", 1), (3, "CC-BY-4.0", 1), (4, "MIT", 1), (5, None, 0)]
    assert license_scan(docs.where("doc_id > 99")).collect() == []
