"""Table adapters, the rule library and the registered queries."""

from __future__ import annotations

import importlib
import pkgutil


def load_queries():
    """Import every query module once and return (queries, twins)."""
    from alertweft.plans import queries, registry

    for module in sorted(m.name for m in pkgutil.iter_modules(queries.__path__)):
        importlib.import_module(f"{queries.__name__}.{module}")
    return registry.QUERIES, registry.TWINS
