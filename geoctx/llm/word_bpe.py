"""Words, pre-tokens and pieces of a word-end BPE file of the tokenizers library that drops white space."""

from __future__ import annotations

import json
import re
from functools import lru_cache

import regex

#: Words kept with their pieces by one Python worker; the memory is bounded, the results don't depend on it.
CACHE = 400_000
_SIMPLE = re.compile("[^\x00-ſ]")  # outside: the library normalises; inside, NFC changes nothing
# What the classes of the split pattern hold in that range.
_CLASSES = {r"\p{L}": "a-zA-ZªµºÀ-ÖØ-öø-ſ", r"\p{N}": "0-9²³¹¼½¾", r"\s": "\t\n\x0b\x0c\r \x85\xa0"}


def _byte_letters() -> dict[int, str]:
    """The printable stand-in of every byte: printable Latin-1 for itself, the others from U+0100 on in order."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in set(plain)]
    return {b: chr(b) for b in plain} | {b: chr(256 + i) for i, b in enumerate(rest)}


class WordBpe:
    """Pieces of white-space separated words. No pre-token reaches over white space, so words are independent."""

    def __init__(self, path: str) -> None:
        from tokenizers import Tokenizer

        self.lib = Tokenizer.from_file(path)
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        steps = [n["type"] for n in (spec["normalizer"] or {}).get("normalizers", [])]
        split = ((spec["pre_tokenizer"] or {}).get("pretokenizers") or [{}])[0]
        if steps != ["NFC", "Replace", "Lowercase"] or not (split.get("type") == "Split" and split.get("behavior") == "Removed" and split.get("invert")):
            raise ValueError(f"{path}: not a lower-casing BPE that drops white space")
        self.pattern = regex.compile(split["pattern"]["Regex"])
        plain = split["pattern"]["Regex"]
        for name, chars in _CLASSES.items():
            plain = plain.replace(name, chars)
        self.plain = None if "\\p" in plain else re.compile(plain)
        special = [t["content"] for t in spec["added_tokens"]]
        self.special = {s: self.lib.token_to_id(s) for s in special}
        self.cut = re.compile("(" + "|".join(map(re.escape, special)) + ")") if special else None
        self.letters = _byte_letters()
        self.word_ids = _WordIds(self)
        self.word_units: dict[bytes, tuple[str, ...]] = {}

    def units(self, word: bytes) -> tuple[str, ...]:
        """The pre-tokens of a word in normal form; a special string of the file is a unit of its own."""
        found = self.word_units.get(word)
        if found is None:
            found = self._units(word.decode("utf-8", "replace"))
            if len(self.word_units) >= CACHE:
                self.word_units.clear()
            self.word_units[word] = found
        return found

    def _units(self, word: str) -> tuple[str, ...]:
        if word.isascii() and word.isalpha():
            return (word.lower(),)
        parts = self.cut.split(word) if self.cut else [word]
        out: list[str] = []
        for part in parts:
            if part in self.special:
                out.append(part)
            elif part and not _SIMPLE.search(part):
                out += self.pattern.findall(part.lower())
            elif part:
                normal = self.lib.normalizer.normalize_str(part)
                out += [normal[a:b] for _, (a, b) in self.lib.pre_tokenizer.pre_tokenize_str(normal)]
        return tuple(out)

    def unit_ids(self, unit: str) -> list[int]:
        """The ids of one pre-token as the library's model merges it."""
        if unit in self.special:
            return [self.special[unit]]
        return [t.id for t in self.lib.model.tokenize("".join(map(self.letters.__getitem__, unit.encode())))]

    def text_ids(self, text: bytes) -> bytes:
        """The ids of a text, little-endian unsigned 32 bits."""
        spelled = text.decode("utf-8", "replace")
        if self.plain and not _SIMPLE.search(spelled) and not (self.cut and self.cut.search(spelled)):
            return b"".join(map(self.word_ids.units.__getitem__, self.plain.findall(spelled.lower())))
        return b"".join(map(self.word_ids.__getitem__, text.split()))


class _UnitIds(dict):
    """Pre-tokens to the bytes of their ids, computed when first asked for."""

    def __init__(self, bpe: WordBpe) -> None:
        super().__init__()
        self.bpe = bpe

    def __missing__(self, unit: str) -> bytes:
        if len(self) >= CACHE:
            self.clear()
        self[unit] = found = b"".join(i.to_bytes(4, "little") for i in self.bpe.unit_ids(unit))
        return found


class _WordIds(dict):
    """Words to the bytes of their ids, computed when first asked for."""

    def __init__(self, bpe: WordBpe) -> None:
        super().__init__()
        self.bpe, self.units = bpe, _UnitIds(bpe)

    def __missing__(self, word: bytes) -> bytes:
        if len(self) >= CACHE:
            self.clear()
        self[word] = found = b"".join(map(self.units.__getitem__, self.bpe._units(word.decode("utf-8", "replace"))))
        return found


@lru_cache(maxsize=2)
def word_bpe(path: str) -> WordBpe:
    return WordBpe(path)
