"""SentencePiece encoding and decoding through a table of distinct chunks, cut where no piece can reach over."""

from __future__ import annotations

import hashlib
import re
from array import array
from functools import lru_cache

import numpy as np
import public_tokenizers
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from geoctx.catalog.base import Catalog
from geoctx.llm.common import BLOCK_BYTES, documents, id_text, in_blocks, stored
from geoctx.llm.exchange import pack, unpack
from geoctx.llm.units import Numbering, once_per_unit, pack_strings, unpack_strings

CATALOG = Catalog()
MARK = "▁"
#: Characters before which a word may be cut, if the vocabulary allows it.
PUNCTUATION = "\n\t.,;:!?|*&#%$()[]{}\"'/\\<>=+-_@~^`"


class Processor:
    """The library's processor and a cut of texts into chunks that no piece can reach over.

    A merge over a cut would make a piece that holds the two characters around it side by side. So a cut is safe
    where no piece does: before every run of markers, and before those of ``PUNCTUATION`` that follow other
    characters in no piece.
    """

    def __init__(self, path: str) -> None:
        import sentencepiece

        self.lib = sentencepiece.SentencePieceProcessor(model_file=path)
        usual = [i for i in range(self.lib.get_piece_size()) if not (self.lib.is_byte(i) or self.lib.is_control(i) or self.lib.is_unknown(i))]
        pairs = {pair for piece in map(self.lib.id_to_piece, usual) for pair in zip(piece, piece[1:])}
        if any(b == MARK != a for a, b in pairs):
            raise ValueError(f"{path}: a piece reaches over a marker")
        if self.lib.id_to_piece(self.lib.encode("a")[0])[0] != MARK or any("\n" in pair for pair in pairs):
            raise ValueError(f"{path}: no marker before the first word, or pieces with line ends")
        cuts = set(PUNCTUATION)
        while bad := {b for a, b in pairs if b in cuts and a not in cuts and a != MARK}:
            cuts -= bad
        own = "".join(map(re.escape, sorted(cuts)))
        self.pattern = re.compile(f" +[{own}]*[^ {own}]*|[{own}]+[^ {own}]*|[^ {own}]+")
        self.mark = self.lib.piece_to_id(MARK)

    def chunks(self, text: str) -> list[str]:
        """The chunks of a text; joined they are a blank and the text. A marker in a text is read as a blank."""
        return self.pattern.findall(" " + text.replace(MARK, " ")) if text else []

    def segment(self, chunks: list[str]) -> list[list[int]]:
        """The ids of each chunk as they are inside a text."""
        # the library puts a marker in front: it replaces a chunk's first blank, or is cut off behind a line end
        ids = self.lib.encode([c[1:] if c[0] == " " else "\n" + c for c in chunks], num_threads=1)
        return [([self.mark] if c == " " else i) if c[0] == " " else i[2:] for c, i in zip(chunks, ids)]

    def spell(self, chunk: str, ids: list[int]) -> str:
        return (" " if chunk[0] == " " else "") + self.lib.decode(ids)


@lru_cache(maxsize=2)
def processor(path: str) -> Processor:
    return Processor(path)


def _sequences(rows: list, path: str) -> dict:
    units, sp = Numbering(), processor(path)
    sequences = [np.fromiter(map(units.__getitem__, sp.chunks(text.decode("utf-8", "replace"))), np.int32) for _, text in rows]
    flat = np.concatenate(sequences)
    seen, vocab = np.bincount(flat, minlength=len(units)).tolist(), [u.encode() for u in units]
    order = sorted(range(len(vocab)), key=lambda i: (-seen[i], vocab[i]))  # frequent chunks get small numbers, which pack well
    number = np.empty(len(order), np.int32)
    number[order] = np.arange(len(order))
    return {
        "doc_id": [doc for doc, _ in rows], "n_units": len(vocab), "units": pack_strings([vocab[i] for i in order]),
        "per_doc": pack(np.array([len(s) for s in sequences])), "seq": pack(number[flat]),
    }


def encode_decode(docs: DataFrame, path: str, digests: bool = False) -> DataFrame:
    """``doc_id, ids array<int>, decoded`` for every row of ``docs (doc_id, text, ...)``; with ``digests``
    ``doc_id, n_tokens, ids_sha256, decoded_sha256`` of the same.

    Ids are those of the sentencepiece library without begin, end or sampling; ``decoded`` is its decode(ids).
    NULL text counts as empty (no ids, empty text), NULL and repeated doc_ids keep a row each, empty input
    gives no rows, other columns are not looked at.
    """
    processor(path)
    blocks = stored(in_blocks(id_text(docs), None, lambda rows: _sequences(rows, path), "doc_id array<long>, n_units long, units binary, per_doc binary, seq binary", BLOCK_BYTES * 2 // 3 if digests else BLOCK_BYTES // 3))  # whole ids and texts take more than digests
    total = blocks.agg(F.sum("n_units")).first()[0] or 0

    def segment(chunks: list[str]) -> list[str]:
        """The ids joined by commas; where they are not spelled as the chunk is, a blank and the spelling follow."""
        sp = processor(path)
        ids = sp.segment(chunks)
        return [",".join(map(str, i)) + ("" if (t := sp.spell(c, i)) == c else f" {t}") for c, i in zip(chunks, ids)]

    def join(block: dict, made: list[bytes]) -> pa.Table:
        words = [w.decode() for w in unpack_strings(block["units"].as_py())]
        ids: list[str] = [""] * len(words)
        n = np.zeros(len(words), dtype=np.int64)
        for i, reply in enumerate(made):
            text, changed, spelled = reply.decode().partition(" ")
            ids[i] = text
            n[i] = text.count(",") + 1
            if changed:
                words[i] = spelled
        seq, out = unpack(block["seq"].as_py()), []
        end = 0
        for size in unpack(block["per_doc"].as_py()).tolist():
            at, end = end, end + size
            own = seq[at:end].tolist()
            joined = ",".join(map(ids.__getitem__, own)) if digests else ""
            out.append((int(n[seq[at:end]].sum()), joined, "".join(map(words.__getitem__, own))[1:]))
        if digests:
            return pa.table({
                "doc_id": block["doc_id"].values, "n_tokens": pa.array([n for n, _, _ in out], pa.int64()),
                "ids_sha256": pa.array([hashlib.sha256(i.encode()).hexdigest() for _, i, _ in out], pa.string()),
                "decoded_sha256": pa.array([hashlib.sha256(t.encode()).hexdigest() for _, _, t in out], pa.string()),
            })
        flat, sizes = array("i"), n  # every unit has an id at least
        for text in ids:
            flat.extend(map(int, text.split(",")))
        flat = np.frombuffer(flat, np.int32) if len(flat) else np.zeros(0, np.int32)
        n_units = sizes[seq]
        starts = (np.cumsum(sizes) - sizes)[seq] - (np.cumsum(n_units) - n_units)
        values = flat[np.repeat(starts, n_units) + np.arange(n_units.sum())]
        offsets = np.concatenate([[0], np.cumsum([n for n, _, _ in out])]).astype(np.int32)
        return pa.table({
            "doc_id": block["doc_id"].values, "ids": pa.ListArray.from_arrays(pa.array(offsets), pa.array(values)),
            "decoded": pa.array([t for _, _, t in out], pa.string()),
        })

    schema = "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string" if digests else "doc_id long, ids array<int>, decoded string"
    return once_per_unit(blocks, "units", total, segment, join, schema)


@CATALOG.add("op10_sentencepiece")
def op10(spark: SparkSession, sf_dir: str) -> DataFrame:
    return encode_decode(documents(spark, sf_dir), public_tokenizers.path("piece_bpe_32k.model"), digests=True)
