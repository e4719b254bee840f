"""License scans by patience alignment of texts with license templates."""

from __future__ import annotations

import re
from bisect import bisect_left
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from geoctx.catalog.base import Catalog
from geoctx.llm.common import LOWER_BYTES, documents, id_text, pa_schema

CATALOG = Catalog()
#: Share of a template's words that must align, in order.
COVERAGE = 0.9

# Public license notices and license texts, by SPDX name.
TEMPLATES = (
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0."),
    ("Apache-2.0", """Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance with the License. You may obtain a
copy of the License at http://www.apache.org/licenses/LICENSE-2.0 Unless required by applicable law or agreed to in writing, software distributed under the License is
distributed on an "AS IS" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License for the specific language governing permissions
and limitations under the License."""),
    ("MIT", "Released under the MIT License."),
    ("MIT", "Licensed under the MIT License."),
    ("MIT", """Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the "Software"), to deal
in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the
Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions: The above copyright notice and this permission notice
shall be included in all copies or substantial portions of the Software."""),
    ("GPL-3.0", "This work is licensed under the GNU General Public License, version 3."),
    ("GPL-3.0", """This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free
Software Foundation, either version 3 of the License, or (at your option) any later version."""),
    ("GPL-2.0", "This work is licensed under the GNU General Public License, version 2."),
    ("BSD-3-Clause", """Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met:
Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer."""),
    ("ISC", """Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright
notice and this permission notice appear in all copies."""),
    ("MPL-2.0", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0."),
    ("CC-BY-NC-4.0", "Licensed under CC BY-NC 4.0."),
    ("CC-BY-4.0", "Licensed under CC BY 4.0."),
    ("CC-BY-SA-4.0", "Licensed under CC BY-SA 4.0."),
    ("CC0-1.0", "To the extent possible under law, the author has dedicated all copyright and related rights to this work to the public domain under CC0 1.0."),
    ("Unlicense", "This is free and unencumbered software released into the public domain."),
)
_WORD = re.compile(rb"[0-9a-z\x80-\xff]+")


def license_words(text: bytes) -> list[bytes]:
    """Runs of a-z, 0-9 and bytes outside ASCII, after lower-casing A-Z."""
    return _WORD.findall(text.translate(LOWER_BYTES))


def _increasing(values: list[int]) -> list[int]:
    """Positions of a longest increasing subsequence (patience piles with links back)."""
    tops: list[int] = []
    piles: list[int] = []
    back: list[int] = []
    for i, v in enumerate(values):
        p = bisect_left(tops, v)
        back.append(piles[p - 1] if p else -1)
        tops[p:p + 1], piles[p:p + 1] = [v], [i]
    out, i = [], piles[-1] if piles else -1
    while i >= 0:
        out.append(i)
        i = back[i]
    return out[::-1]


def align(a: list[bytes], b: list[bytes]) -> list[tuple[int, int]]:
    """Matched positions of ``a`` and ``b`` in rising order.

    Words that occur once on both sides are anchors; the longest run of anchors in the same order on both sides
    stays, and the gaps between them are aligned in the same way. A gap without anchors keeps its equal ends.
    """
    out: list[tuple[int, int]] = []
    todo = [(0, len(a), 0, len(b))]
    while todo:
        a0, a1, b0, b1 = todo.pop()
        while a0 < a1 and b0 < b1 and a[a0] == b[b0]:
            out.append((a0, b0))
            a0, b0 = a0 + 1, b0 + 1
        while a0 < a1 and b0 < b1 and a[a1 - 1] == b[b1 - 1]:
            a1, b1 = a1 - 1, b1 - 1
            out.append((a1, b1))
        if a0 == a1 or b0 == b1:
            continue
        in_a, in_b = Counter(a[a0:a1]), Counter(b[b0:b1])
        place = {w: i for i, w in enumerate(b[b0:b1], b0) if in_b[w] == 1}
        anchors = [(i, place[w]) for i, w in enumerate(a[a0:a1], a0) if in_a[w] == 1 and w in place]
        if not anchors:
            continue
        kept = [anchors[k] for k in _increasing([j for _, j in anchors])]
        out += kept
        for (p, q), (r, s) in zip([(a0 - 1, b0 - 1), *kept], [*kept, (a1, b1)]):
            if p + 1 < r and q + 1 < s:
                todo.append((p + 1, r, q + 1, s))
    return sorted(out)


@dataclass(frozen=True)
class Template:
    name: str
    words: tuple[bytes, ...]
    distinct: frozenset[bytes]


@lru_cache(maxsize=8)
def _templates(listed: tuple[tuple[str, str], ...]) -> list[Template]:
    out = [Template(name, tuple(w), frozenset(w)) for name, text in listed if (w := license_words(text.encode()))]
    return sorted(out, key=lambda t: (-len(t.words), t.name))


def scan(text: bytes, templates: list[Template], coverage: float = COVERAGE) -> list[tuple[str, float, int, int, int]]:
    """``(name, coverage, first word, word behind the last, matched words)`` of every template's places in a text.

    A place is tried around each occurrence of the template word that is rarest in the text, in a window of one
    and a half template lengths behind the last place found, then in one of just its length, so that repeated notices
    are all found. Of overlapping places of different
    templates the one with more matched words stays, then the larger coverage, then the earlier one.
    """
    return scan_words(license_words(text), templates, coverage)


def scan_words(words: list[bytes], templates: list[Template], coverage: float) -> list[tuple[str, float, int, int, int]]:
    present = set(words)
    found = []
    for t in templates:
        least = coverage * len(t.words)
        spare = len(t.words) - int(-(-least // 1))
        if len(t.distinct - present) > spare:  # each of them leaves a word at least without its pair
            continue
        counts = Counter(w for w in words if w in t.distinct)
        # enough different words to be sure that one of them stands in every place that can pass
        own, keys, left = Counter(t.words), [], spare + 1
        for w in sorted(t.distinct, key=lambda w: (counts[w], t.words.index(w))):
            keys.append(w)
            left -= own[w]
            if left <= 0:
                break
        slack, starts = len(t.words) // 4 + 2, set()
        where: dict[bytes, list[int]] = {}
        for i, w in enumerate(words):
            if w in keys:
                where.setdefault(w, []).append(i)
        done = -1
        for w in keys:
            offsets = [i for i, x in enumerate(t.words) if x == w]
            starts.update(i - o for i in where.get(w, []) for o in offsets)
        for start in sorted(starts):
            if start < done:
                continue
            # a neighbour of the same words can hide the anchors of the wide window; the exact one has equal ends
            for wide in (slack, 0):
                low, high = max(start - wide, done, 0), min(start + len(t.words) + wide, len(words))
                pairs = align(words[low:high], list(t.words))
                if pairs and len(pairs) >= least:
                    first, last = low + pairs[0][0], low + pairs[-1][0] + 1
                    found.append((t.name, len(pairs) / len(t.words), first, last, len(pairs)))
                    done = last
                    break
    out: list[tuple[str, float, int, int, int]] = []
    for f in sorted(found, key=lambda f: (-f[4], -f[1], f[2], f[0])):
        if all(f[3] <= o[2] or o[3] <= f[2] for o in out):
            out.append(f)
    return sorted(out, key=lambda f: (f[2], f[0]))


def license_scan(docs: DataFrame, templates: tuple[tuple[str, str], ...] = TEMPLATES, coverage: float = COVERAGE) -> DataFrame:
    """``doc_id, n_words, n_matches, licenses, best, coverage, matches`` for every row of ``docs (doc_id, text, ...)``.

    ``matches`` lists the places (license, coverage, word range) in the order of the text, ``licenses`` the distinct
    names sorted, ``best`` the place with most matched words (ties: first). NULL and empty texts match nothing
    (``best`` NULL, coverage 0). NULL and repeated doc_ids keep a row each; an empty table gives no rows; other
    columns are not looked at. Templates are a parameter of bounded size and go to every task.
    """
    schema = "doc_id long, n_words long, n_matches long, licenses array<string>, best string, coverage double, matches array<struct<license:string,coverage:double,start:int,stop:int>>"
    arrow = pa_schema(docs.sparkSession, schema)
    listed = tuple(templates)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = _templates(listed)
        for batch in batches:
            rows = []
            for doc, text in zip(batch["doc_id"].to_pylist(), batch["text"].to_pylist()):
                words = license_words(text)
                found = scan_words(words, known, coverage)
                best = max(found, key=lambda f: (f[4], -f[2]), default=None)
                rows.append({
                    "doc_id": doc, "n_words": len(words), "n_matches": len(found), "licenses": sorted({f[0] for f in found}),
                    "best": best[0] if best else None, "coverage": best[1] if best else 0.0,
                    "matches": [{"license": f[0], "coverage": f[1], "start": f[2], "stop": f[3]} for f in found],
                })
            yield pa.RecordBatch.from_pylist(rows, schema=arrow)

    return id_text(docs).mapInArrow(run, schema)


@CATALOG.add("op5_license_scan")
def op5(spark: SparkSession, sf_dir: str) -> DataFrame:
    return license_scan(documents(spark, sf_dir))
