"""Registered queries over the given tables, grouped by operator family."""

from __future__ import annotations

import importlib
import pkgutil


def all_queries():
    """Import every plan module once and return the registry."""
    from memlake.plans import registry

    for mod in pkgutil.iter_modules(__path__):
        importlib.import_module(f"{__name__}.{mod.name}")
    return dict(registry.QUERIES)
