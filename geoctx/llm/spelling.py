"""Spelling variant grouping: near words found by bidirectional FM-index search schemes."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from geoctx.catalog.base import Catalog
from geoctx.llm.common import documents, lower_az, pa_schema
from geoctx.session import cut_lineage

CATALOG = Catalog()

#: Fewest code points of a word, fewest occurrences, and how much more often a form has to occur than its variant.
LEAST_LENGTH, LEAST_COUNT, RATIO = 6, 5, 5
#: Code points of the vocabulary that one index is built over, and above which the words of one half are dealt to several.
INDEX_CHARS = 1_000_000
#: Intervals of up to this many suffixes are looked through; wider ones are tried with every symbol.
NARROW = 8


def suffix_order(text: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """The positions of ``text`` ordered by what follows up to the next delimiter, then by position.

    ``ends`` marks delimiters (symbol 0). Ranks of pieces of doubling length are joined until all suffixes differ or
    reach a delimiter. Words are sorted, so order by position is order by what lies behind the delimiter.
    """
    n = len(text)
    left = np.flatnonzero(ends)
    reach = left[np.searchsorted(left, np.arange(n))] - np.arange(n)  # to the next delimiter
    # eight symbols at once as the first key; nothing counts behind a delimiter
    key, wide = np.zeros(n, np.uint64), np.concatenate([text, np.zeros(8, np.uint8)])
    for k in range(8):
        key = (key << np.uint64(8)) | np.where(reach >= k, wide[k:n + k], 0).astype(np.uint64)
    step = 8
    while True:
        order = np.argsort(key)
        sorted_key = key[order]
        rank = np.empty(n, np.int64)
        rank[order] = np.cumsum(np.r_[False, sorted_key[1:] != sorted_key[:-1]])
        if step > reach.max() or int(rank.max()) == n - 1:
            return np.argsort(rank, kind="stable")
        behind = np.where(reach >= step, rank[np.minimum(np.arange(n) + step, n - 1)] + 1, 0)
        key = (rank * (n + 1) + behind).astype(np.uint64)
        step *= 2


def _points(words: list[str]) -> np.ndarray:
    """Code points of the words with a zero before, between and after them."""
    return np.frombuffer("\0".join(["", *words, ""]).encode("utf-32-le"), "<u4") if words else np.zeros(1, "<u4")


class Half:
    """One direction: suffix ranks of the delimited words, and counts of smaller symbols before any rank."""

    def __init__(self, text: np.ndarray, symbols: int) -> None:
        """``text``: a delimiter, then each word with a delimiter behind it, words in order."""
        order = suffix_order(text, text == 0)
        self.n, self.symbols = len(text), symbols
        self.before = text[order - 1]  # the symbol in front of each suffix
        counts = np.bincount(text, minlength=symbols)
        self.first = np.concatenate([[0], np.cumsum(counts)])  # rank of the first suffix that begins with a symbol
        blocks = self.n // 64 + 1
        padded = np.full(blocks * 64, 255, np.uint8)
        padded[:self.n] = self.before
        #: per symbol c: which of each 64 ranks have a symbol below c in front, and how many before each 64
        self.bits = np.zeros((symbols + 1, blocks), np.uint64)
        self.sums = np.zeros((symbols + 1, blocks), np.int32)
        for c in range(1, symbols + 1):
            below = np.packbits(padded < c, bitorder="little").view("<u8")
            self.bits[c] = below
            self.sums[c, 1:] = np.cumsum(np.bitwise_count(below))[:-1]

    def smaller(self, c: np.ndarray | int, rank: np.ndarray) -> np.ndarray:
        """How many of the ranks before ``rank`` have a symbol below ``c`` in front."""
        block = rank >> 6
        part = self.bits[c, block] & ((np.uint64(1) << (rank & 63).astype(np.uint64)) - np.uint64(1))
        return self.sums[c, block] + np.bitwise_count(part)


class Index:
    """Both directions over a vocabulary. A pattern is a triple: its first rank forwards and backwards, and its number of places.

    Patterns grow by a symbol on either side; both ranks are kept in step, so a search may begin in the middle of a
    word and turn around at its end.
    """

    def __init__(self, words: list[str]) -> None:
        """``words`` are sorted by code point and distinct."""
        points = _points(words)
        self.letters = np.unique(points)  # the first is the delimiter
        if len(self.letters) > 250:
            raise ValueError("more symbols than a byte holds")
        self.symbols = len(self.letters)
        self.text = np.searchsorted(self.letters, points).astype(np.uint8)
        self.forwards = Half(self.text, self.symbols)
        backs = [w[::-1] for w in words]
        turned = sorted(range(len(words)), key=backs.__getitem__)
        self.backwards = Half(np.searchsorted(self.letters, _points([backs[i] for i in turned])).astype(np.uint8), self.symbols)
        self.turned = np.array(turned, np.int64)
        self.lengths = np.array([len(w) for w in words], np.int64)
        self.starts = np.cumsum(self.lengths + 1) - self.lengths

    def rows(self, numbers: np.ndarray) -> np.ndarray:
        """The symbols of words of one length, a row each."""
        return self.text[self.starts[numbers][:, None] + np.arange(self.lengths[numbers[0]])]

    def grown(self, c: np.ndarray | int, at: np.ndarray, other: np.ndarray, size: np.ndarray, left: bool) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Patterns with ``c`` in front (``left``) or behind: ``at`` are the ranks of the side that grows."""
        half = self.forwards if left else self.backwards
        a, b = half.smaller(c, at), half.smaller(c, at + size)
        next_a, next_b = half.smaller(c + 1, at), half.smaller(c + 1, at + size)
        return half.first[c] + next_a - a, other + b - a, (next_b - next_a) - (b - a)

    def near(self, words: np.ndarray, numbers: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Pairs (row of ``words``, number of a word at exactly one edit), each once; ``words`` are rows of equal length.

        Either the left half stands exactly at the beginning of a near word or the right half at its end. Each half is
        matched from the middle outwards to its delimiter; then the search turns and crosses the other half with one
        error, after which it goes on exactly to the other delimiter. ``numbers`` are the rows' own numbers.
        """
        length = words.shape[1]
        found = [self._across(words, length // 2, left) for left in (True, False)]
        rows, hits = (np.concatenate(f) for f in zip(*found))
        keep = hits != numbers[rows]
        pairs = np.unique(rows[keep] * (len(self.turned) + 1) + hits[keep])
        return pairs // (len(self.turned) + 1), pairs % (len(self.turned) + 1)

    def _across(self, words: np.ndarray, middle: int, left: bool) -> tuple[np.ndarray, np.ndarray]:
        """Matches the half on side ``left`` (of the middle) exactly and the other with one error."""
        n, length = words.shape
        rows = np.arange(n)
        at, other, size = (np.full(n, v, np.int64) for v in (0, 0, self.forwards.n))
        exact = range(middle - 1, -1, -1) if left else range(middle, length)
        for j in exact:
            at, other, size = self.grown(words[:, j].astype(np.int64), at, other, size, left)
        at, other, size = self.grown(np.zeros(n, np.int64), at, other, size, left)
        at, other = other, at  # from here the other side grows
        rest = range(middle, length) if left else range(middle - 1, -1, -1)
        order = list(rest)
        half = self.backwards if left else self.forwards
        out_rows, out_hits = [], []

        def finish(rows: np.ndarray, at: np.ndarray, other: np.ndarray, size: np.ndarray, k: int) -> None:
            """Goes on exactly from the k-th symbol to the delimiter."""
            for j in order[k:]:
                if not len(rows):
                    return
                at, other, size = self.grown(words[rows, j].astype(np.int64), at, other, size, not left)
                some = size > 0
                rows, at, other, size = rows[some], at[some], other[some], size[some]
            at, other, size = self.grown(np.zeros(len(rows), np.int64), at, other, size, not left)
            some = size > 0
            rank = at[some] - 1  # ranks of delimiters follow the order of the words; rank 0 is the last delimiter
            out_rows.append(rows[some])
            out_hits.append(self.turned[rank] if left else rank)

        for k in range(len(order) + 1):
            # where only the word itself is left, nothing near can follow
            some = size > 1
            rows, at, other, size = rows[some], at[some], other[some], size[some]
            if not len(rows):
                break
            own = words[rows, order[k]].astype(np.int64) if k < len(order) else np.zeros(len(rows), np.int64)
            parts = list(self._errors(half, own, at, other, size, left))
            if parts:
                spot, *place = (np.concatenate(p) for p in zip(*parts))
                finish(rows[spot], *place, k)  # one symbol more
                if k < len(order):
                    finish(rows[spot], *place, k + 1)  # another symbol
            if k < len(order):
                # one symbol less; of a run of equal symbols the last
                after = words[rows, order[k + 1]] if k + 1 < len(order) else np.zeros(len(rows), np.uint8)
                last = (after != own) & (length > 1)  # no word is empty
                finish(rows[last], at[last], other[last], size[last], k + 1)
                at, other, size = self.grown(own, at, other, size, not left)
        return np.concatenate([*out_rows, np.zeros(0, np.int64)]), np.concatenate([*out_hits, np.zeros(0, np.int64)])

    def _errors(self, half: Half, own: np.ndarray, at: np.ndarray, other: np.ndarray, size: np.ndarray, left: bool) -> Iterator[tuple]:
        """Places of the patterns grown by each symbol that is not ``own``, with the rows they come from."""
        wide = np.flatnonzero(size > NARROW)
        if len(wide):
            for c in range(1, self.symbols):
                some = wide[own[wide] != c]
                a, b, s = self.grown(c, at[some], other[some], size[some], not left)
                yes = s > 0
                if yes.any():
                    yield some[yes], a[yes], b[yes], s[yes]
        small = np.flatnonzero(size <= NARROW)
        if len(small):
            spread = np.repeat(small, size[small])
            ranks = at[spread] + np.arange(len(spread)) - np.repeat(np.cumsum(size[small]) - size[small], size[small])
            keys = np.unique(spread * 256 + half.before[ranks])
            spot, c = keys // 256, keys % 256
            other_symbol = (c != 0) & (c != own[spot])
            spot, c = spot[other_symbol], c[other_symbol]
            if len(spot):
                yield (spot, *self.grown(c, at[spot], other[spot], size[spot], not left))


def near_words(words: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Pairs of numbers of ``words`` (sorted, distinct) at exactly one inserted, deleted or replaced code point, in both directions."""
    index = Index(words)
    a, b = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
    for length in np.unique(index.lengths):
        numbers = np.flatnonzero(index.lengths == length)
        step = max(4_000_000 // int(length), 1)
        for low in range(0, len(numbers), step):
            some = numbers[low:low + step]
            rows, hits = index.near(index.rows(some), some)
            a.append(some[rows])
            b.append(hits)
    return np.concatenate(a), np.concatenate(b)


def word_counts(docs: DataFrame, least_length: int = LEAST_LENGTH, least_count: int = LEAST_COUNT) -> DataFrame:
    """``(word, n)``: runs of letters after the fixed damage, of ``least_length`` code points and ``least_count`` occurrences or more.

    A run loses one code point where 199 divides the crc32 of ``doc_id:run``. NULL texts have no runs; a NULL doc_id
    reads as the empty string.
    """
    runs = F.regexp_extract_all(lower_az(docs["text"]), F.lit(f"[a-zÀ-ÿ]{{{least_length},}}+"), F.lit(0))
    doc = F.coalesce(docs["doc_id"].cast("string"), F.lit(""))
    run = docs.select(doc.alias("doc"), F.explode(runs).alias("run"))
    h = F.crc32(F.concat("doc", F.lit(":"), "run").cast("binary"))
    cut = F.pmod(h, F.length("run").cast("long")).cast("int")
    word = F.when(h % 199 == 0, F.concat(F.substring(F.col("run"), F.lit(1), cut), F.substring(F.col("run"), cut + 2, F.length("run")))).otherwise(F.col("run"))
    return run.select(word.alias("word")).where(F.length("word") >= least_length).groupBy("word").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") >= least_count)


def _halves(words: DataFrame, least_length: int, limit: int) -> DataFrame:
    """``cell, word, n, asks, held, short``: every word in the cells where its near words are.

    Two near words of lengths a <= b share the first or the last a // 2 code points. So a word goes to the halves that
    it has as the shorter one (a its own length) and as the longer one (a one less). Halves that many words share are
    dealt to several cells: each word is held by one slice of cells and asks in all of them.
    """
    short = F.explode(F.array(F.length("word"), F.length("word") - 1)).alias("short")
    keyed = words.select("word", "n", short).where(F.col("short") >= least_length)
    half = F.floor(F.col("short") / 2).cast("int")
    sides = F.explode(F.array(F.concat(F.lit("<"), F.substring(F.col("word"), F.lit(1), half)), F.concat(F.lit(">"), F.substring(F.col("word"), -half, half))))
    keyed = keyed.select("word", "n", "short", sides.alias("half"))
    sizes = keyed.groupBy("half", "short").agg(F.sum(F.length("word") + 1).alias("chars"))
    total = sizes.agg(F.sum("chars")).first()[0] or 0
    cells = max(-(-total // limit), 1)
    crowded = sizes.where(F.col("chars") > limit).select("half", "short", F.ceil(F.col("chars") / limit).cast("int").alias("slices"))
    keyed = keyed.join(crowded, ["half", "short"], "left")
    even = keyed.where("slices IS NULL").select(F.concat(F.lit("h"), F.pmod(F.xxhash64("half", "short"), F.lit(cells)).cast("string")).alias("cell"), "word", "n", F.lit(True).alias("asks"), F.lit(True).alias("held"), "short", "half")
    mine = F.pmod(F.xxhash64("word"), F.col("slices")).cast("int")
    dealt = keyed.where("slices IS NOT NULL").withColumn("mine", mine).withColumn("slice", F.explode(F.sequence(F.lit(0), F.col("slices") - 1)))
    # cell (held slice, asking slice): a word is held in its row of cells and asks in its column
    cell = lambda i, j: F.concat_ws(":", F.lit("s"), "short", "half", i, j)
    holds = dealt.select(cell(F.col("mine"), F.col("slice")).alias("cell"), "word", "n", (F.col("mine") == F.col("slice")).alias("asks"), F.lit(True).alias("held"), "short", "half")
    asks = dealt.where("mine <> slice").select(cell(F.col("slice"), F.col("mine")).alias("cell"), "word", "n", F.lit(True).alias("asks"), F.lit(False).alias("held"), "short", "half")
    return even.unionByName(holds).unionByName(asks)


def near_summary(words: DataFrame, least_length: int = LEAST_LENGTH, limit: int = INDEX_CHARS) -> DataFrame:
    """``word, n_near, form, form_n``: how many words are near, and the most frequent of them (ties: smallest in code-point order)."""
    ddl = "word string, n_near long, form string, form_n long"
    schema = pa_schema(words.sparkSession, ddl)

    def search(group: pa.Table) -> pa.Table:
        rows = list(zip(*(group[c].to_pylist() for c in ("word", "n", "asks", "held", "short", "half"))))
        names = sorted({r[0] for r in rows})
        number = {w: i for i, w in enumerate(names)}
        n = np.zeros(len(names), np.int64)
        asks, held = (np.zeros((len(names), 4), bool) for _ in range(2))
        # roles of a word by the side of its half and by whether it is the shorter or the longer one
        for word, count, a, h, short, half in rows:
            i, role = number[word], 2 * (half[0] == ">") + (len(word) != short)
            n[i], asks[i, role], held[i, role] = count, asks[i, role] or a, held[i, role] or h
        a, b = near_words(names)
        length = np.array([len(w) for w in names])
        keep = np.zeros(len(a), bool)
        for x in range(len(a)):
            u, v = names[a[x]], names[b[x]]
            size = min(length[a[x]], length[b[x]])
            half = size // 2
            # each pair counts in one place: at its left half if it shares that, else at its right half
            side = 0 if u[:half] == v[:half] else 2
            keep[x] = asks[a[x], side + (length[a[x]] != size)] and held[b[x], side + (length[b[x]] != size)]
        a, b = a[keep], b[keep]
        best = np.lexsort((b, -n[b], a))
        a, b = a[best], b[best]
        starts = np.flatnonzero(np.r_[True, a[1:] != a[:-1]]) if len(a) else np.zeros(0, np.int64)
        sizes = np.diff(np.r_[starts, len(a)])
        return pa.Table.from_pydict({
            "word": [names[i] for i in a[starts]], "n_near": sizes, "form": [names[i] for i in b[starts]], "form_n": n[b[starts]],
        }, schema=schema)

    found = _halves(words, least_length, limit).groupBy("cell").applyInArrow(search, ddl)
    best = F.struct((-F.col("form_n")).alias("less"), "form")
    return found.groupBy("word").agg(F.sum("n_near").alias("n_near"), F.min(best).alias("best")).select("word", "n_near", F.col("best.form").alias("form"), (-F.col("best.less")).alias("form_n"))


def roots(forms: DataFrame) -> DataFrame:
    """``(word, root)`` of ``forms (word, form)``: the last form that is reached, by pointer doubling over written tables.

    Forms grow by a factor of five, so a chain has fewer than thirty links and few rounds are needed.
    """
    here = cut_lineage(forms.select("word", F.col("form").alias("root")))
    while True:
        onward = here.select(F.col("word").alias("root"), F.col("root").alias("next"))
        step = cut_lineage(here.join(onward, "root", "left").select("word", F.coalesce("next", "root").alias("root"), F.col("next").isNotNull().alias("moved")))
        if step.where("moved").isEmpty():
            return step.select("word", "root")
        here = step.select("word", "root")


def spelling_variants(docs: DataFrame, least_length: int = LEAST_LENGTH, least_count: int = LEAST_COUNT, ratio: int = RATIO, limit: int = INDEX_CHARS) -> DataFrame:
    """``word, form, root, n, n_near, form_n`` for every frequent word of ``docs (doc_id, text, ...)``.

    Two words are near at exactly one inserted, deleted or replaced code point. A word's form is its most frequent
    near word (ties: the smallest) if that is ``ratio`` times as frequent or more, else NULL; its root is the end of
    the chain of forms. NULL and empty texts have no words, repeated rows count again, no words give no rows; other
    columns are not looked at.
    """
    words = cut_lineage(word_counts(docs, least_length, least_count))
    near = cut_lineage(words.join(near_summary(words, least_length, limit), "word", "left"))
    has = F.coalesce(F.col("form_n") >= F.col("n") * ratio, F.lit(False))
    forms = near.select("word", "n", F.coalesce("n_near", F.lit(0).cast("long")).alias("n_near"), F.when(has, F.col("form")).alias("form"), F.when(has, F.col("form_n")).alias("form_n"))
    ends = roots(forms.where("form IS NOT NULL"))
    return forms.join(ends, "word", "left").select("word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")


_CRC_TABLE = "list_transform(range(256), lambda i: list_reduce(list_prepend(i, range(8)), lambda c, k: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END))"
_BYTES = "flatten(list_transform(string_split(coalesce(doc_id::VARCHAR, '') || ':' || run, ''), lambda x: CASE WHEN unicode(x) < 128 THEN [unicode(x)::BIGINT] ELSE [192 + (unicode(x)::BIGINT >> 6), 128 + (unicode(x)::BIGINT & 63)] END))"
_ORACLE = f"""
WITH RECURSIVE crc AS (SELECT {_CRC_TABLE} AS tab),
runs AS (SELECT doc_id, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[a-zÀ-ÿ]+')) AS run FROM documents),
each AS (SELECT doc_id, run, count(*) AS times FROM runs WHERE length(run) >= 6 GROUP BY doc_id, run),
hashed AS (SELECT run, times, xor(list_reduce(list_prepend(4294967295, {_BYTES}), lambda c, b: xor(c >> 8, tab[xor(c & 255, b) + 1])), 4294967295) AS h FROM each, crc),
hurt AS (SELECT CASE WHEN h % 199 = 0 THEN left(run, (h % length(run))::INT) || substr(run, (h % length(run))::INT + 2) ELSE run END AS word, times FROM hashed),
words AS (SELECT word, sum(times)::BIGINT AS n FROM hurt WHERE length(word) >= 6 GROUP BY word HAVING sum(times) >= 5),
cuts AS (SELECT word, i, left(word, i::INT - 1) || substr(word, i::INT + 1) AS rest FROM (SELECT word, unnest(range(1, length(word) + 1)) AS i FROM words)),
pairs AS (SELECT a.word, b.word AS near FROM cuts a JOIN cuts b ON a.rest = b.rest AND a.i = b.i AND a.word <> b.word
  UNION SELECT c.word, w.word FROM cuts c JOIN words w ON c.rest = w.word UNION SELECT w.word, c.word FROM cuts c JOIN words w ON c.rest = w.word),
best AS (SELECT p.word, count(*) AS n_near, arg_min(p.near, (-w.n, p.near)) AS form, max(w.n) AS form_n FROM pairs p JOIN words w ON w.word = p.near GROUP BY p.word),
forms AS (SELECT w.word, w.n, coalesce(b.n_near, 0) AS n_near, CASE WHEN b.form_n >= 5 * w.n THEN b.form END AS form, CASE WHEN b.form_n >= 5 * w.n THEN b.form_n END AS form_n
  FROM words w LEFT JOIN best b ON b.word = w.word),
chain AS (SELECT word, word AS here, form AS onward FROM forms
  UNION ALL SELECT c.word, f.word, f.form FROM chain c JOIN forms f ON f.word = c.onward)
SELECT f.word, f.form, c.here AS root, f.n, f.n_near, f.form_n FROM forms f JOIN chain c ON c.word = f.word AND c.onward IS NULL"""


@CATALOG.add("op11_spelling", _ORACLE)
def op11(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spelling_variants(documents(spark, sf_dir))
