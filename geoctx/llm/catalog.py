"""All queries of the corpus operators and their SQL."""

from __future__ import annotations

from importlib import import_module

_MODULES = ["token_counts", "ngram_jaccard", "token_files", "decontaminate", "licenses", "quality", "personal_data", "exact_dedup", "language_model", "pieces", "spelling", "conversations", "language_id"]


def all_queries():
    return {name: q for m in _MODULES for name, q in import_module(f"geoctx.llm.{m}").CATALOG.queries.items()}


def all_oracles():
    return {name: s for m in _MODULES for name, s in import_module(f"geoctx.llm.{m}").CATALOG.oracles.items()}
