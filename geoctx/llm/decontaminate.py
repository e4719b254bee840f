"""Benchmark decontamination by exact word windows, in DataFrame functions only."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from geoctx.catalog.base import Catalog
from geoctx.llm.common import documents, lower_az, sieve, without
from geoctx.session import cut_lineage

CATALOG = Catalog()
WORD = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"
#: Rows of benchmark windows (and of their grams) sent to every task at most; beyond it the joins shuffle.
BROADCAST_ROWS = 500_000


def words_of(text: Column) -> Column:
    """Words after lower-casing A-Z: runs of a-z, 0-9 and anything outside ASCII; NULL has none."""
    return F.regexp_extract_all(lower_az(F.coalesce(text, F.lit(""))), F.lit(WORD), F.lit(0))


def _bounded(df: DataFrame, rows: int) -> DataFrame:
    return F.broadcast(df) if rows <= BROADCAST_ROWS else df


def benchmark_windows(benchmark: DataFrame, n: int = 13) -> DataFrame:
    """``(len, key, items)``: each distinct window of ``n`` words (a shorter item is one window) and its items.

    ``key`` is the words joined by blanks, which words never contain. Items without words have no window; a
    NULL item_id is the empty string.
    """
    items = benchmark.select(F.coalesce(benchmark["item_id"].cast("string"), F.lit("")).alias("item"), words_of(benchmark["text"]).alias("words")).where("size(words) > 0")
    at = items.select("item", "words", F.least(F.size("words"), F.lit(n)).alias("len"), F.explode(F.sequence(F.lit(0), F.greatest(F.size("words") - n, F.lit(0)))).alias("q"))
    return at.select("len", F.array_join(F.slice("words", F.col("q") + 1, F.col("len")), " ").alias("key"), "item").groupBy("len", "key").agg(F.collect_set("item").alias("items"))


def _gram(length: int) -> int:
    return min(4, length)


GRAM = "least(len, 4)"


def find_hits(docs: DataFrame, benchmark: DataFrame, n: int = 13) -> DataFrame:
    """``doc_id, fp, spans array<struct<q,len>>, items array<string>`` of documents with a benchmark window.

    Every occurrence of a window of L words holds one position divisible by L - 3 at which four words of it
    start (fewer for shorter windows). So only the four-word grams at those positions are looked up in the hash
    set of the benchmark's grams, one position in ten for 13 words; where one is found, all windows around it are
    compared word by word. Nothing is missed. ``fp`` is the hash of the text: rows equal in id and text share a row.
    """
    windows = cut_lineage(benchmark_windows(benchmark, n))
    lengths = sorted(r.len for r in windows.select("len").distinct().collect())  # at most n numbers
    spots = F.explode(F.sequence(F.lit(0), F.col("len") - F.expr(GRAM)))
    parts = windows.select("len", F.split("key", " ").alias("w"), spots.alias("o"))
    gram = lambda w, p, size: F.xxhash64(F.array_join(F.slice(w, p + 1, size), " "))
    grams = cut_lineage(parts.select("len", gram(F.col("w"), F.col("o"), F.expr(GRAM)).alias("g")).distinct())
    n_windows, n_grams = windows.count(), grams.count()

    base = docs.select(docs["doc_id"].cast("long").alias("doc_id"), F.coalesce(docs["text"], F.lit("")).alias("text"))
    base = base.select("doc_id", F.xxhash64("text").alias("fp"), words_of(F.col("text")).alias("words"))
    none = F.array().cast("array<struct<len:int,p:int>>")

    def probe(length: int) -> Column:
        size = _gram(length)
        steps = F.sequence(F.lit(0), F.size("words") - size, F.lit(length - size + 1))
        return F.when(F.size("words") >= length, F.transform(steps, lambda p: F.struct(F.lit(length).alias("len"), p.alias("p")))).otherwise(none)

    starts = [probe(length) for length in lengths] or [none]
    probes = base.select("doc_id", "fp", "words", F.explode(F.flatten(F.array(*starts))).alias("at")).select("doc_id", "fp", "words", "at.len", "at.p")
    probes = probes.withColumn("g", gram(F.col("words"), F.col("p"), F.expr(GRAM)))
    if n_grams <= BROADCAST_ROWS:
        near = probes.join(F.broadcast(grams), ["len", "g"])
    else:  # the words stay at home: only ids, positions and hashes are shuffled, then the found documents' words
        found = probes.drop("words").join(grams, ["len", "g"])
        near = _rejoin(base, found)
    first, last = F.expr(f"greatest(p - (len - {GRAM}), 0)"), F.expr("least(p, size(words) - len)")
    tried = near.where(first <= last).select("doc_id", "fp", "len", "words", F.explode(F.sequence(first, last)).alias("q"))
    keyed = tried.select("doc_id", "fp", "len", "q", F.array_join(F.slice("words", F.col("q") + 1, F.col("len")), " ").alias("key"))
    hits = keyed.join(_bounded(windows, n_windows), ["len", "key"])
    return hits.groupBy("doc_id", "fp").agg(F.collect_set(F.struct("q", "len")).alias("spans"), F.array_sort(F.array_distinct(F.flatten(F.collect_set("items")))).alias("items"))


def _rejoin(base: DataFrame, found: DataFrame) -> DataFrame:
    """The words of found documents, for a benchmark too large to be sent to every task."""
    found = cut_lineage(found)
    ids = found.select(F.col("doc_id").alias("_id"), F.col("fp").alias("_fp")).distinct()
    texts = sieve(base, "fp", ids.select(F.col("_fp").alias("fp"))).join(ids, F.expr("fp = _fp AND doc_id <=> _id")).select("_id", "_fp", "words")
    return found.join(texts, F.expr("fp = _fp AND doc_id <=> _id")).select("doc_id", "fp", "words", "len", "p")


def contamination(docs: DataFrame, benchmark: DataFrame, n: int = 13) -> DataFrame:
    """``doc_id, fp, n_words, n_hit, n_items, items, spans, contaminated`` for every row of ``docs (doc_id, text, ...)``.

    A document is contaminated when it has a hit and at least one word in twenty is hit. NULL or empty texts
    have no words and are clean; with an empty benchmark every document is. Rows that repeat an id and text
    get the same answer each; NULL ids keep their rows; other columns are not looked at.
    """
    text = F.coalesce(docs["text"], F.lit(""))
    every = docs.select(docs["doc_id"].cast("long").alias("doc_id"), F.xxhash64(text).alias("fp"), F.regexp_count(lower_az(text), F.lit(WORD)).cast("long").alias("n_words"))
    hits = find_hits(docs, benchmark, n).select(F.col("doc_id").alias("_id"), F.col("fp").alias("_fp"), "spans", "items")
    hits = hits.withColumn("n_hit", F.size(F.array_distinct(F.flatten(F.transform("spans", lambda s: F.sequence(s["q"], s["q"] + s["len"] - 1))))).cast("long"))
    joined = every.join(hits, F.expr("fp = _fp AND doc_id <=> _id"), "left")
    n_hit, items = F.coalesce("n_hit", F.lit(0)), F.coalesce("items", F.array().cast("array<string>"))
    return joined.select(
        "doc_id", "fp", "n_words", n_hit.alias("n_hit"), F.size(items).cast("long").alias("n_items"), items.alias("items"), "spans",
        ((n_hit > 0) & (20 * n_hit >= F.col("n_words"))).alias("contaminated"),
    )


def decontaminate(docs: DataFrame, benchmark: DataFrame, n: int = 13, remove: str = "documents") -> DataFrame:
    """``docs`` with all its columns, without contaminated documents, or (``remove="spans"``) without the hit words.

    Removing spans works on every hit, also in documents below the limit: a hit word goes together with the
    characters between it and the word before. Texts without hits are returned as they are.
    """
    if remove not in ("documents", "spans"):
        raise ValueError(f"remove: {remove}")
    found = cut_lineage(contamination(docs, benchmark, n).where("n_hit > 0").select("doc_id", "fp", "spans", "contaminated").dropDuplicates(["doc_id", "fp"]))

    def same(d: DataFrame, other: DataFrame) -> Column:
        return (F.xxhash64(F.coalesce(d["text"], F.lit(""))) == other["__gc_fp"]) & d["doc_id"].cast("long").eqNullSafe(other["__gc_doc_id"])

    if remove == "documents":
        return without(docs, found.where("contaminated").select("doc_id", "fp"), same)
    hits = found.select(*[F.col(c).alias(f"__gc_{c}") for c in ("doc_id", "fp", "spans")])
    joined = docs.join(hits, same(docs, hits), "left")
    # each word with what stands before it; the rest of the text behind the last word
    lead = r"[\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]"
    parts = F.regexp_extract_all(F.col("text"), F.lit(f"{lead}*[^\\x00-\\x2F\\x3A-\\x40\\x5B-\\x60\\x7B-\\x7F]+"), F.lit(0))
    tail = F.regexp_extract(F.col("text"), f"({lead}*)$", 1)
    hit = F.array_distinct(F.flatten(F.transform("__gc_spans", lambda s: F.sequence(s["q"], s["q"] + s["len"] - 1))))
    left = F.filter(F.transform(parts, lambda w, i: F.when(~F.array_contains(F.col("__gc_hit"), i), w)), lambda w: w.isNotNull())
    cleaned = joined.withColumn("__gc_hit", hit).withColumn("__gc_clean", F.when(F.col("__gc_spans").isNull(), F.col("text")).otherwise(F.concat(F.array_join(left, ""), tail)))
    return cleaned.select(*[F.col("__gc_clean").alias("text") if c == "text" else F.col(c) for c in docs.columns])


_LOW = "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
_SPLIT = f"regexp_extract_all({_LOW}, '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+')"


@CATALOG.add("op4_decontaminate", f"""
WITH w AS (SELECT doc_id, {_SPLIT} AS ws FROM documents),
b AS (SELECT CAST(item_id AS VARCHAR) AS item, {_SPLIT} AS bs FROM benchmark),
bw AS (SELECT DISTINCT item, least(13, len(bs)) AS l, array_to_string(bs[q + 1 : q + least(13, len(bs))], ' ') AS k
       FROM (SELECT item, bs, unnest(range(0, greatest(len(bs) - 13, 0) + 1)) AS q FROM b WHERE len(bs) > 0)),
dw AS (SELECT doc_id, q, l, array_to_string(ws[q + 1 : q + l], ' ') AS k
       FROM (SELECT doc_id, ws, l, unnest(range(0, len(ws) - l + 1)) AS q FROM w JOIN (SELECT DISTINCT l FROM bw) ON len(ws) >= l)),
h AS (SELECT doc_id, q, dw.l, item FROM dw JOIN bw USING (l, k)),
hit AS (SELECT doc_id, count(DISTINCT p) AS n_hit FROM (SELECT doc_id, unnest(range(q, q + l)) AS p FROM h) GROUP BY doc_id),
it AS (SELECT doc_id, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS items FROM (SELECT DISTINCT doc_id, item FROM h) GROUP BY doc_id)
SELECT doc_id, len(ws) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items, sha256(coalesce(items, '')) AS items_sha256,
       coalesce(n_hit, 0) > 0 AND 20 * coalesce(n_hit, 0) >= len(ws) AS contaminated
FROM w LEFT JOIN hit USING (doc_id) LEFT JOIN it USING (doc_id)""")
def op4(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = contamination(documents(spark, sf_dir), spark.read.parquet(f"{sf_dir}/benchmark.parquet"))
    return found.select("doc_id", "n_words", "n_hit", "n_items", F.sha2(F.array_join("items", ","), 256).alias("items_sha256"), "contaminated")
