"""Language identification by compression: the language whose dictionary makes a text smallest."""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pandas as pd
import zstandard
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from geoctx.catalog.base import Catalog
from geoctx.llm.common import doc_bucket, documents

CATALOG = Catalog()

#: Documents of each language that its dictionary is made of, and characters taken from each at a place set by its hash.
FIT_DOCS, FIT_CHARS = 200, 2_000
#: Documents that teach anything, of all languages together: with very many languages each learns from fewer.
FIT_ROWS = 200_000
#: Bytes of all dictionaries together: with very many languages each gets a smaller one.
FIT_BYTES = 48 << 20
#: Bytes that are encoded at a time. A short piece leans on the dictionary and not on the text before it.
PIECE = 4_096
#: A text whose best and second sizes differ by less than this share of the best is rejected.
MARGIN = 0.01
#: Lazy matching; deeper search costs more and told held-out texts apart no better.
LEVEL = 9
UNDECIDED = "und"

_OTHER = re.compile(r"[\W\d_]+")


def letters(text: str) -> bytes:
    """The words of a text in lower case, one blank around each; what is no letter tells languages apart badly."""
    words = _OTHER.sub(" ", text.lower())
    return f" {words.strip()} ".encode("utf-8", "replace") if any(map(str.isalpha, words)) else b""


def learn(docs: DataFrame, docs_each: int = FIT_DOCS, chars_each: int = FIT_CHARS, total: int = FIT_BYTES) -> dict[str, bytes]:
    """Raw-content dictionaries by language, from ``docs (doc_id, text, lang)`` whose crc32(doc_id as text) mod 5 is not 0.

    A language's dictionary is cut from at most ``docs_each`` different documents, those with the smallest hashes, so
    it is the same at every run; ``chars_each`` characters of each, from a place set by the hash. NULL texts and
    languages, and texts without letters, teach nothing. What reaches the driver is bounded by languages times both
    numbers; the dictionaries are cut evenly to ``total`` bytes.
    """
    used = docs.select(docs["lang"].cast("string").alias("lang"), docs["text"].alias("text"), F.xxhash64(docs["doc_id"].cast("string"), docs["text"]).alias("at"), docs["doc_id"].alias("doc_id"))
    used = used.where(F.col("lang").isNotNull() & F.col("text").rlike(r"\p{L}") & (doc_bucket(F.col("doc_id")) != 0)).select("lang", "text", "at")
    keys = used.select("lang", "at").distinct()
    langs = used.agg(F.count_distinct("lang")).first()[0]
    docs_each = max(min(docs_each, FIT_ROWS // max(langs, 1)), 1)
    # the smallest hashes of each share of a language first, so that what one task orders is bounded at any size
    for share in (F.pmod("at", F.lit(256)), F.lit(0)):
        place = F.row_number().over(Window.partitionBy("lang", "share").orderBy("at"))
        keys = keys.withColumn("share", share).withColumn("place", place).where(F.col("place") <= docs_each).select("lang", "at")
    chosen = F.broadcast(keys)  # FIT_ROWS rows at most, or one for each language
    start = F.pmod("at", F.greatest(F.length("text") - chars_each, F.lit(0)) + 1) + 1
    cut = F.substring(F.col("text"), start.cast("int"), F.lit(chars_each))
    rows = used.join(chosen, ["lang", "at"]).groupBy("lang", "at").agg(F.min(cut).alias("cut")).orderBy("lang", "at").collect()
    texts: dict[str, list[bytes]] = {}
    for row in rows:
        texts.setdefault(row.lang, []).append(letters(row.cut))
    each = total // max(len(texts), 1)
    return {lang: b"".join(parts)[-each:] for lang, parts in texts.items()}


class Coder:
    """Encoded sizes of texts under each of the languages' dictionaries."""

    def __init__(self, dictionaries: dict[str, bytes]) -> None:
        self.langs = sorted(dictionaries)
        settings = zstandard.ZstdCompressionParameters.from_level(LEVEL, write_content_size=False, write_checksum=False, write_dict_id=False)
        self.coders = []
        for lang in self.langs:
            content = dictionaries[lang]
            if len(content) < 8:  # the library takes no shorter dictionary
                self.coders.append(zstandard.ZstdCompressor(compression_params=settings))
                continue
            raw = zstandard.ZstdCompressionDict(content, dict_type=zstandard.DICT_TYPE_RAWCONTENT)
            raw.precompute_compress(compression_params=settings)
            self.coders.append(zstandard.ZstdCompressor(dict_data=raw, compression_params=settings))

    def sizes(self, data: bytes) -> list[int]:
        """Bytes of all pieces of ``data`` together, for each language."""
        pieces = [data[i:i + PIECE] for i in range(0, len(data), PIECE)]
        return [sum(len(coder.compress(p)) for p in pieces) for coder in self.coders]

    def best(self, text: str | None) -> tuple[str, float, float]:
        """The language of the smallest size (ties: the first by name), its share against the others, and the margin.

        The share is a soft maximum over bits saved per hundred bytes of text, 1 where there is one language only. The
        margin is how much larger the second smallest size is, as a share of the smallest.
        """
        data = letters(text or "")
        if not data or not self.langs:
            return UNDECIDED, 0.0, 0.0
        sizes = np.array(self.sizes(data), dtype=float)
        first = int(sizes.argmin())
        # what is saved counts per byte, or a long text would always score 1
        share = 1 / np.exp2(-(sizes - sizes[first]) * 800 / max(len(data), 100) / 8).sum()
        second = np.partition(sizes, 1)[1] if len(sizes) > 1 else 2 * sizes[first]
        return self.langs[first], float(share), float(second / sizes[first] - 1)


def identify(docs: DataFrame, dictionaries: dict[str, bytes], margin: float = MARGIN) -> DataFrame:
    """All columns of ``docs`` with ``lang_best``, ``lang_share``, ``lang_margin`` and ``lang_sure``.

    ``lang_best`` is the language of the smallest code, ``und`` where the text is NULL or has no letter (share and
    margin 0); ``lang_sure`` is false where the margin is below ``margin``: such a text is rejected. Whole texts are
    encoded, in pieces. Only ``text`` enters. Columns of these names in ``docs`` are replaced. Repeated rows are
    judged alike, an empty table stays empty; without any learned language every text is ``und``.
    """

    @F.pandas_udf("best string, share double, margin double")
    def judge(texts: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        coder = Coder(dictionaries)  # once per task
        for batch in texts:
            yield pd.DataFrame([coder.best(t) for t in batch], columns=["best", "share", "margin"])

    found = docs.withColumn("_lang", judge(docs["text"]))
    return found.withColumns({
        "lang_best": F.col("_lang.best"), "lang_share": F.col("_lang.share"), "lang_margin": F.col("_lang.margin"), "lang_sure": F.col("_lang.margin") >= margin,
    }).drop("_lang")


@CATALOG.add("op13_language_id")
def op13(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir)
    found = identify(docs.select("doc_id", "text"), learn(docs))
    return found.select("doc_id", (doc_bucket(F.col("doc_id")) == 0).alias("held_out"), F.col("lang_best").alias("lang_pred"), F.col("lang_share").alias("score"), F.col("lang_sure").alias("sure"))
