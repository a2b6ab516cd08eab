"""Registered queries: one per operator, over tables derived from a data folder."""

from __future__ import annotations

import importlib
import pkgutil


def load() -> tuple[dict, dict]:
    """Import every ``q_*`` module and return ``(queries, sql)``."""
    from tidemark.catalog import registry

    for module in sorted(m.name for m in pkgutil.iter_modules(__path__) if m.name.startswith("q_")):
        importlib.import_module(f"{__name__}.{module}")
    return registry.QUERIES, registry.ORACLE
