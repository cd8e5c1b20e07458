"""All registered queries of the library and their SQL equivalents."""

from __future__ import annotations

from importlib import import_module

#: Modules with a ``QUERIES`` and an ``ORACLE`` mapping.
MODULES: tuple[str, ...] = ("queries.evaluation", "queries.relational", "queries.phenotype", "queries.textmine", "queries.vectors", "queries.studies")


def queries() -> dict:
    out: dict = {}
    for name in MODULES:
        out |= import_module(f"medlake.{name}").QUERIES
    return out


def oracle_sql() -> dict:
    out: dict = {}
    for name in MODULES:
        out |= import_module(f"medlake.{name}").ORACLE
    return out
