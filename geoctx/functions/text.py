"""String, list and JSON expressions."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

# --- fixed values: wording of the context prompts and of list packing ---
PACK = "?"
PROMPT_PREFIX = "Urban building context: "
BAND_LABELS = {"100": "immediate surroundings", "200": "nearby area", "300": "outer area"}
# upper bound of the count (None: no bound), words for a plural label, words for a singular label
DENSITY_WORDS_PLAIN = [
    (3, "have few", "has few"),
    (20, "have some", "has some"),
    (40, "have many", "has many"),
    (80, "is dense with", "is dense with"),
    (None, "is packed with", "is packed with"),
]
DENSITY_WORDS_VIVID = [
    (3, "are sparsely featured with", "is sparsely featured with"),
    (20, "are dotted with", "is dotted with"),
    (40, "are filled with", "is filled with"),
    (80, "are crowded with", "is crowded with"),
    (None, "are packed with", "is packed with"),
]
MAIN_SHARE, MIX_SHARE = 0.6, 0.3
HTML_ENTITIES = {"&lt;": "<", "&gt;": ">", "&quot;": '"', "&#39;": "'", "&amp;": "&"}
# --- end of fixed values ---


def _col(c) -> Column:
    return F.col(c) if isinstance(c, str) else c


def enumerate_words(items) -> Column:
    """"a", "a and b", "a, b, and c"."""
    items = _col(items)
    n = F.size(items)
    return (
        F.when(n == 0, "")
        .when(n <= 2, F.array_join(items, " and "))
        .otherwise(F.concat(
            F.array_join(F.slice(items, F.lit(1), n - 1), ", "), F.lit(", and "), F.element_at(items, -1)
        ))
    )


def band_sentence(label: str, n, types, top_count, words) -> Column:
    """One clause of the prompt from the band's count, its commonest types and the top type's count."""
    n, types, top_count = _col(n), _col(types), _col(top_count)
    plural = "surroundings" in label
    density = F
    for bound, many, one in words:
        word = F.lit(many if plural else one)
        density = density.when(n <= bound, word) if bound is not None else density.otherwise(word)
    rest = F.slice(types, F.lit(2), F.size(types))
    share = top_count / n
    composition = (
        F.when(n <= words[0][0], enumerate_words(types))
        .when(share >= MAIN_SHARE, F.concat(
            F.lit("primarily "), types[0],
            F.when(F.size(rest) > 0, F.concat(F.lit(" alongside some "), enumerate_words(rest))).otherwise(""),
        ))
        .when(share >= MIX_SHARE, F.concat(F.lit("a mix of "), enumerate_words(types)))
        .otherwise(F.concat(F.lit("a diverse range of "), enumerate_words(types)))
    )
    sentence = F.concat(F.lit(f"the {label} "), density, F.lit(" "), composition)
    return F.when(F.coalesce(n, F.lit(0)) == 0, F.lit(f"the {label} is empty")).otherwise(sentence)


def prompt_bands(prompt) -> Column:
    """The three clauses of a prompt, prefix and padding removed."""
    body = F.replace(_col(prompt), F.lit(PROMPT_PREFIX), F.lit(""))
    return F.transform(F.split(body, ";"), lambda t: F.trim(t))


def pack(values) -> Column:
    return F.array_join(_col(values), PACK)


def unpack(packed) -> Column:
    """Packed text to array; empty or missing text is an empty array."""
    packed = F.coalesce(_col(packed), F.lit(""))
    return F.when(packed == "", F.array().cast("array<string>")).otherwise(F.split(packed, r"\?"))


def unpack_aligned(**packed) -> Column:
    """Several packed columns as one array of structs, position by position."""
    arrays = [unpack(c).alias(name) for name, c in packed.items()]
    return F.arrays_zip(*arrays)


def packed_count(packed) -> Column:
    return F.size(unpack(packed))


def word_tokens(text, low: int = 2, high: int | None = 15) -> Column:
    """Lower-case ASCII words of ``low``..``high`` letters, in order; no upper bound with ``high`` None.

    Character classes are written out, since ``\\w`` differs between engines; letters outside
    a-z separate words.
    """
    words = F.regexp_extract_all(F.lower(_col(text)), F.lit("[a-z]+"), F.lit(0))
    if high is None:
        return F.filter(words, lambda w: F.length(w) >= low)
    return F.filter(words, lambda w: F.length(w).between(low, high))


def model_token_count(text) -> Column:
    """Tokens of a prompt: words, numbers and single punctuation marks."""
    return F.size(F.regexp_extract_all(F.lower(_col(text)), F.lit("[a-z]+|[0-9]+|[^a-z0-9\\s]"), F.lit(0)))


def clean_text(text, lower: bool = True) -> Column:
    """Unescape (twice, as nested escapes occur), collapse white space, trim, lower."""
    out = _col(text)
    for _ in range(2):
        for entity, char in HTML_ENTITIES.items():
            out = F.replace(out, F.lit(entity), F.lit(char))
    out = F.trim(F.regexp_replace(out, "[ \\t\\n\\r\\f\\x0B]+", " "))
    return F.lower(out) if lower else out


def strip_suffix(name, suffix: str) -> Column:
    return F.regexp_replace(_col(name), re.escape(suffix) + "$", "")
