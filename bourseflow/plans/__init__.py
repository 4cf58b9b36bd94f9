"""Queries wired from operators and market tables."""
from __future__ import annotations

import importlib
import pkgutil


def all_queries() -> dict:
    """Import every module of this package so that its queries register themselves."""
    for m in pkgutil.iter_modules(__path__):
        importlib.import_module(f"{__name__}.{m.name}")
    from bourseflow.plans.catalog import QUERIES
    return dict(QUERIES)
