"""Named queries of the engine and, where SQL can state them, their oracles."""

from __future__ import annotations

import importlib
import pkgutil


def _modules():
    for m in sorted(x.name for x in pkgutil.iter_modules(__path__)):
        yield importlib.import_module(f"{__name__}.{m}")


def queries() -> dict:
    """name -> function of (spark, sf_dir)."""
    return {k: f for m in _modules() for k, (f, _) in m.QUERIES.items()}


def oracle_sql() -> dict[str, str]:
    return {k: sql for m in _modules() for k, (_, sql) in m.QUERIES.items() if sql}
