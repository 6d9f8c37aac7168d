"""Bindings of the operators to the test tables, and the query catalogue."""

from __future__ import annotations

import importlib
import pkgutil


def load_catalog():
    """Import every ``*_queries`` module once, so that it registers its queries."""
    from quayside.plans import catalog

    for info in pkgutil.iter_modules(__path__):
        if info.name.endswith("_queries"):
            importlib.import_module(f"{__name__}.{info.name}")
    return catalog
