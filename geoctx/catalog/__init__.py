"""All registered queries and their SQL."""

from __future__ import annotations

from importlib import import_module

_GROUPS = ["records", "spatial", "lookups", "evaluation", "rasters", "features", "files"]


def _catalogs():
    return [import_module(f"geoctx.catalog.{g}").CATALOG for g in _GROUPS]


def all_queries():
    out = {}
    for c in _catalogs():
        clash = out.keys() & c.queries.keys()
        if clash:
            raise ValueError(f"registered twice: {clash}")
        out.update(c.queries)
    return out


def all_oracles():
    out = {}
    for c in _catalogs():
        out.update(c.oracles)
    return out
