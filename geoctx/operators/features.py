"""Text and vector features: TF-IDF, word vectors, scaling, PCA, SVD, fusion."""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import StorageLevel
from pyspark.ml.feature import PCA, StandardScaler, StopWordsRemover
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.stat import Summarizer
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from geoctx.functions import text
from geoctx.functions.arrays import explode_once, l2_unit
from geoctx.session import cut_lineage


def default_stop_words() -> list[str]:
    """Spark's own English list (needs a running session)."""
    return StopWordsRemover.loadDefaultStopWords("english")


# ---- TF-IDF --------------------------------------------------------------------

def with_terms(docs: DataFrame, key: str, content: str, stop_words: Sequence[str]) -> DataFrame:
    """(key, terms): words of two letters and more, stop words out, then single words and neighbouring pairs."""
    words = text.word_tokens(content, 2, None)
    if stop_words:
        words = F.filter(words, lambda w: ~w.isin(*stop_words))
    # kept words are a column of their own, so that the pair step does not tokenise again
    kept = docs.select(key, words.alias("_w"))
    n = F.size("_w")
    pairs = F.zip_with(
        F.slice("_w", F.lit(1), F.greatest(n - 1, F.lit(0))), F.slice("_w", F.lit(2), F.greatest(n - 1, F.lit(0))),
        lambda a, b: F.concat_ws(" ", a, b))
    return kept.select(key, F.concat("_w", pairs).alias("terms"))


#: Bytes of text whose terms are counted together; a longer text is counted by itself.
SLICE_BYTES = 16 << 20


def _text_slices(texts: pa.Array) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Bytes of neighbouring texts, at most about ``SLICE_BYTES``, and where each text begins and ends in them."""
    texts = pc.fill_null(texts, "").cast(pa.large_string())
    _, ends, data = texts.buffers()
    ends = np.frombuffer(ends, np.int64)[texts.offset:texts.offset + len(texts) + 1]
    data, start = np.frombuffer(data or b"", np.uint8), 0
    while start < len(texts):
        stop = max(start + 1, int(np.searchsorted(ends, ends[start] + SLICE_BYTES, side="right")) - 1)
        stop = min(stop, start + 65536)
        yield data[ends[start]:ends[stop]], ends[start:stop + 1] - ends[start]
        start = stop


def _count_terms(raw: np.ndarray, ends: np.ndarray, stop_words: pa.Array) -> tuple[pa.Array, np.ndarray, np.ndarray]:
    """Terms of lower-case texts as ``with_terms`` makes them, once each, with their occurrences and their texts.

    Words and pairs of words are numbers here; number and text are sorted as one number, so that equal terms lie together.
    """
    letter = (raw - np.uint8(97)) < 26
    cuts = ends[1:-1]  # a word ends with its text
    cuts = cuts[(cuts > 0) & (cuts < len(raw))]
    begins, stops = letter.copy(), letter.copy()
    begins[1:] &= ~letter[:-1]
    stops[:-1] &= ~letter[1:]
    begins[cuts], stops[cuts - 1] = letter[cuts], letter[cuts - 1]
    at = np.flatnonzero(begins)
    size = np.flatnonzero(stops) + 1 - at
    spelled = pa.LargeStringArray.from_buffers(len(at), pa.py_buffer(np.append(0, np.cumsum(size))), pa.py_buffer(raw[letter]))
    coded = spelled.dictionary_encode()
    words, word = coded.dictionary, coded.indices.to_numpy().astype(np.int64)
    good = pc.and_(pc.greater_equal(pc.binary_length(words), 2), pc.invert(pc.is_in(words, value_set=stop_words))).to_numpy(zero_copy_only=False)
    kept = good[word]
    word, doc = word[kept], np.searchsorted(ends, at[kept], side="right") - 1
    next_to = doc[1:] == doc[:-1]
    docs, n = len(ends) - 1, len(words)
    # at most n * (n + 1) * docs: 16 MB hold 2 ** 23 words and 2 ** 16 texts, a longer text is alone
    found = np.sort(np.append(word, ((word[:-1] + 1) * n + word[1:])[next_to]) * docs + np.append(doc, doc[1:][next_to]))
    if not len(found):
        return words[:0], np.zeros(0, np.int64), np.zeros(0, np.int64)
    term = found // docs
    starts = np.flatnonzero(np.append(True, term[1:] != term[:-1]))
    tf = np.diff(np.append(starts, len(term)))
    df = np.add.reduceat(np.append(True, found[1:] != found[:-1]).astype(np.int64), starts)
    term = term[starts]
    single, pair = term[term < n], term[term >= n]
    pairs = pc.binary_join_element_wise(words.take(pa.array(pair // n - 1)), words.take(pa.array(pair % n)), pa.scalar(" ", pa.large_string()))
    return pa.concat_arrays([words.take(pa.array(single)), pairs]), tf, df


def _term_counts(docs: DataFrame, content: str, stop_words: Sequence[str]) -> DataFrame:
    """(term, tf, df): occurrences of a term and the documents that have it, added up for slices of an Arrow batch."""
    stops = pa.array(list(stop_words), pa.large_string())

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for raw, ends in _text_slices(batch.column(0)):
                term, tf, df = _count_terms(raw, ends, stops)
                yield pa.RecordBatch.from_arrays([term.cast(pa.string()), pa.array(tf), pa.array(df)], names=["term", "tf", "df"])

    return docs.select(F.lower(content).alias("_t")).mapInArrow(count, "term string, tf long, df long")


def fit_tfidf(docs: DataFrame, key: str, content: str, stop_words: Sequence[str], max_features: int = 5000) -> DataFrame:
    """Vocabulary (term, total, df, idf): the terms of the highest corpus count, ties by term.

    A top-k over term counts, so at most ``max_features`` rows. idf = ln((1 + n) / (1 + df)) + 1.
    """
    # a document is one row; what leaves an Arrow batch is a row per distinct term of 16 MB of text
    counts = _term_counts(docs, content, stop_words).groupBy("term").agg(F.sum("tf").alias("total"), F.sum("df").alias("df"))
    n = docs.agg(F.count(F.lit(1)).alias("n_docs"))
    top = counts.orderBy(F.desc("total"), "term").limit(max_features)
    fitted = top.join(n).withColumn("idf", F.log((1 + F.col("n_docs")) / (1 + F.col("df"))) + 1).drop("n_docs")
    return cut_lineage(fitted)  # a fitted model: computed once, whatever it is applied to


def tfidf_weights(docs: DataFrame, vocabulary: DataFrame, key: str, content: str, stop_words: Sequence[str]) -> DataFrame:
    """(key, term, weight), each document scaled to length 1.

    Terms outside the vocabulary leave before the counts are shuffled; documents without any known
    term have no rows.
    """
    terms = with_terms(docs, key, content, stop_words).select(key, explode_once("terms").alias("term"))
    known = terms.join(vocabulary.select("term", "idf"), "term")
    w = known.groupBy(key, "term").agg((F.count(F.lit(1)) * F.first("idf")).alias("w"))
    vectors = w.groupBy(key).agg(F.collect_list(F.struct("term", "w")).alias("v"), F.sum(F.col("w") * F.col("w")).alias("s"))
    return vectors.select(key, "s", F.explode("v").alias("e")).select(
        key, F.col("e.term").alias("term"), (F.col("e.w") / F.sqrt("s")).alias("weight"))


def sparse_rows(weights: DataFrame, vocabulary: DataFrame, key: str) -> DataFrame:
    """(key, idx, val): one sparse row per document; the term index is the rank by term.

    The vocabulary is a top-k, so the ranking below holds at most its k rows.
    """
    index = vocabulary.select("term", (F.row_number().over(Window.orderBy("term")) - 1).alias("i"))
    rows = weights.join(index, "term").groupBy(key).agg(F.array_sort(F.collect_list(F.struct("i", "weight"))).alias("v"))
    return rows.select(key, F.transform("v", lambda e: e["i"]).alias("idx"), F.transform("v", lambda e: e["weight"]).alias("val"))


# ---- word vectors ---------------------------------------------------------------

def known_tokens(docs: DataFrame, vocabulary: DataFrame, key: str, content: str) -> DataFrame:
    """(key, pos, token, vec_id) of the tokens in the vocabulary; the rest drop out."""
    tokens = docs.select(key, F.posexplode(text.word_tokens(content)).alias("pos", "token"))
    return tokens.join(vocabulary.select("token", "vec_id"), "token")


def mean_vectors(docs: DataFrame, vocabulary: DataFrame, vectors: DataFrame, key: str, content: str, size: int) -> DataFrame:
    """Mean word vector per document, zeros without a known token.

    Tokens are counted per (document, vector) first; vectors are then averaged with those counts as
    weights by a vector aggregate, so dimensions are never exploded.
    """
    counts = known_tokens(docs, vocabulary, key, content).groupBy(key, "vec_id").agg(
        F.count(F.lit(1)).cast("double").alias("n"))
    vecs = vectors.select("vec_id", array_to_vector(F.transform("embedding", lambda e: e.cast("double"))).alias("v"))
    means = counts.join(vecs, "vec_id").groupBy(key).agg(
        Summarizer.mean(F.col("v"), F.col("n")).alias("m"))
    zeros = F.array_repeat(F.lit(0.0), size)
    return docs.select(key).join(means.select(key, vector_to_array("m").alias("m")), key, "left").select(
        key, F.coalesce("m", zeros).alias("vector"))


def token_sequences(docs: DataFrame, vocabulary: DataFrame, key: str, content: str, length: int = 64, pad: int = -1) -> DataFrame:
    """First ``length`` known tokens per document as vector ids, padded, with the true length.

    The rank is cut to ``length`` before the shuffle, so a long document sends ``length`` rows.
    """
    w = Window.partitionBy(key).orderBy("pos")
    first = known_tokens(docs, vocabulary, key, content).withColumn("_r", F.row_number().over(w)).where(F.col("_r") <= length)
    seq = first.groupBy(key).agg(F.array_sort(F.collect_list(F.struct("_r", "vec_id"))).alias("_s"))
    ids = F.coalesce(F.transform("_s", lambda s: s["vec_id"]), F.array().cast("array<bigint>"))
    out = docs.select(key).join(seq, key, "left").select(key, ids.alias("ids"))
    return out.select(
        key, F.size("ids").alias("length"),
        F.concat("ids", F.array_repeat(F.lit(pad).cast("long"), F.lit(length) - F.size("ids"))).alias("ids"))


# ---- dense features ------------------------------------------------------------

def as_vector(df: DataFrame, column: str) -> DataFrame:
    return df.withColumn(column, array_to_vector(F.transform(column, lambda e: e.cast("double"))))


def fit_scaler(train: DataFrame, column: str):
    """Mean and deviation per dimension, from the training rows only."""
    return StandardScaler(withMean=True, withStd=True, inputCol=column, outputCol="_scaled").fit(train)


def standardise(df: DataFrame, scaler, column: str) -> DataFrame:
    """Scaled and brought to length 1 (the sample or population deviation makes no difference then)."""
    scaled = scaler.transform(df)
    return scaled.withColumn(column, l2_unit(vector_to_array("_scaled"))).drop("_scaled")


def scaled(df: DataFrame, scaler, column: str) -> DataFrame:
    """Scaled by the fitted mean and deviation, as a vector column of the same name."""
    return scaler.transform(df).drop(column).withColumnRenamed("_scaled", column)


def fit_pca(train: DataFrame, column: str, k: int):
    """Principal components; ``explainedVariance`` of the model gives the shares kept."""
    return PCA(k=k, inputCol=column, outputCol="_pca").fit(train)


def project(df: DataFrame, model, column: str, unit: bool = True) -> DataFrame:
    """Rows on the components, to length 1 unless ``unit`` is off."""
    out = vector_to_array("_pca")
    return model.transform(df).withColumn(column, l2_unit(out) if unit else out).drop("_pca")


#: Numbers of a features x columns matrix that a task and the driver may hold (400 MB).
MATRIX_CELLS = 50_000_000


def _slices(idx: list, cells: int = 65536, rows: int = 512):
    """Ranges of rows with about ``cells`` entries and at most ``rows`` rows, so that a block of them stays small."""
    ends = np.cumsum([len(i) for i in idx])
    start = 0
    while start < len(idx):
        base = ends[start - 1] if start else 0
        stop = min(max(start + 1, int(np.searchsorted(ends, base + cells, side="right"))), start + rows)
        yield start, stop
        start = stop


def _block(idx: list, val: list) -> tuple[np.ndarray, np.ndarray]:
    """Sparse rows as a dense block over the features they use, and these features: its products are matrix products."""
    used, at = np.unique(np.concatenate(idx).astype("int64"), return_inverse=True)
    row = np.repeat(np.arange(len(idx)), [len(i) for i in idx])
    cells = np.bincount(row * len(used) + at.ravel(), np.concatenate(val).astype("float64"), len(idx) * len(used))
    return cells.astype("float64").reshape(len(idx), len(used)), used


def _gram_times(rows: DataFrame, q: np.ndarray) -> np.ndarray:
    """X^T (X q) in one pass: each task sums its rows per feature, features are then added up by key.

    Only features x columns numbers come back, whatever the number of rows.
    """
    shared = rows.sparkSession.sparkContext.broadcast(q)

    def partial(batches):
        m = shared.value
        acc = np.zeros_like(m)
        for pdf in batches:
            idx, val = list(pdf["idx"]), list(pdf["val"])
            for a, b in _slices(idx):
                x, used = _block(idx[a:b], val[a:b])
                acc[used] += x.T @ (x @ m[used])
        used = np.flatnonzero(acc.any(axis=1))
        for at in range(0, len(used), 1024):
            yield pd.DataFrame({"i": used[at:at + 1024].astype("int32"), "z": list(acc[used[at:at + 1024]])})

    parts = rows.select("idx", "val").mapInPandas(partial, "i int, z array<double>")
    summed = parts.groupBy("i").agg(Summarizer.sum(array_to_vector("z")).alias("z")).select("i", vector_to_array("z").alias("z"))
    out = np.zeros_like(q)
    got = summed.toPandas()
    if len(got):
        out[got["i"].to_numpy()] = np.stack(got["z"].to_list())
    shared.unpersist()
    return out


def fit_svd(rows: DataFrame, size: int, k: int, oversample: int = 10, passes: int = 5, seed: int = 42):
    """Right singular vectors (size x k) and singular values of sparse rows, uncentred.

    Randomised subspace iteration (Halko et al. 2011): a fixed number of passes over the rows. Features are a
    vocabulary of bounded size: a matrix above ``MATRIX_CELLS`` numbers is refused before any pass.
    """
    if size * (k + oversample) > MATRIX_CELLS:
        raise ValueError(f"{size} features x {k + oversample} columns exceed {MATRIX_CELLS} numbers")
    kept = rows.select("idx", "val").persist(StorageLevel.MEMORY_AND_DISK)
    try:
        q = np.linalg.qr(np.random.default_rng(seed).normal(size=(size, min(size, k + oversample))))[0]
        for _ in range(passes):
            q = np.linalg.qr(_gram_times(kept, q))[0]
        small = q.T @ _gram_times(kept, q)
    finally:
        kept.unpersist()
    values, vectors = np.linalg.eigh((small + small.T) / 2)
    order = np.argsort(values)[::-1][:k]
    return q @ vectors[:, order], np.sqrt(np.maximum(values[order], 0.0))


def project_svd(rows: DataFrame, v: np.ndarray, name: str = "features") -> DataFrame:
    """Sparse rows times the right singular vectors, to length 1. ``v`` is features x k."""
    shared = rows.sparkSession.sparkContext.broadcast(np.asarray(v))

    @F.pandas_udf("array<double>")
    def times(idx: pd.Series, val: pd.Series) -> pd.Series:
        m = shared.value
        i, v = list(idx), list(val)
        blocks = (_block(i[a:b], v[a:b]) for a, b in _slices(i))
        return pd.Series([row for x, used in blocks for row in x @ m[used]], dtype=object)

    return rows.withColumn(name, l2_unit(times("idx", "val"))).drop("idx", "val")


def fuse(df: DataFrame, columns: Sequence[str], name: str = "features") -> DataFrame:
    """Modalities side by side in one array."""
    return df.withColumn(name, F.concat(*columns))
