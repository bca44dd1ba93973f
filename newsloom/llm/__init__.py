"""Operators of a training-data pipeline. Nothing else in the library imports this subpackage."""

from __future__ import annotations

from importlib import import_module

_MODULES = ("langid", "secrets", "substrings", "vectors", "pii", "lines", "mixing", "decontaminate", "scoring", "jaccard", "layout", "slices", "resample")


def queries() -> dict:
    return {k: v for m in _MODULES for k, v in import_module(f"{__name__}.{m}").QUERIES.items()}


def oracle_sql() -> dict:
    return {k: v for m in _MODULES for k, v in getattr(import_module(f"{__name__}.{m}"), "ORACLE", {}).items()}
