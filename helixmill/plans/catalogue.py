"""All queries of the core."""

from __future__ import annotations

from . import files, general, sequences

_MODULES = (general, sequences, files)


def queries() -> dict:
    return {name: f for module in _MODULES for name, f in module.queries().items()}


def oracle_sql() -> dict[str, str]:
    return {name: sql for module in _MODULES for name, sql in module.oracle_sql().items()}
