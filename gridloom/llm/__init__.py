"""Operators on large text corpora. Nothing else in the package imports this one."""

from __future__ import annotations

from importlib import import_module

MODULES = ("token_ids", "token_counts", "packing", "media", "fingerprints", "language", "toxicity", "simhash", "lm_score", "sentencepieces")


def queries() -> dict:
    return {k: f for m in MODULES for k, f in import_module(f"{__name__}.{m}").QUERIES.items()}


def oracle_sql() -> dict:
    return {k: f for m in MODULES for k, f in getattr(import_module(f"{__name__}.{m}"), "ORACLES", {}).items()}
