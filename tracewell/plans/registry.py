"""All queries and their SQL by name."""

from __future__ import annotations

from importlib import import_module

from .tables import Tables

MODULES = ["bank", "notes", "references", "household", "ledger", "exchange", "calls", "billing", "places", "segments", "files", "streams"]


def _modules():
    return [import_module(f".{m}", __package__) for m in MODULES]


def queries() -> dict:
    out = {}
    for m in _modules():
        for name, f in m.QUERIES.items():
            out[name] = lambda spark, sf_dir, f=f: f(Tables(spark, sf_dir))
    return out


def oracle_sql() -> dict[str, str]:
    return {k: v for m in _modules() for k, v in m.SQL.items()}
