"""DuckDB statements that check the registered queries."""
from __future__ import annotations

import importlib
import pkgutil


def all_sql() -> dict[str, str]:
    out: dict[str, str] = {}
    for m in pkgutil.iter_modules(__path__):
        out.update(getattr(importlib.import_module(f"{__name__}.{m.name}"), "SQL", {}))
    return out
