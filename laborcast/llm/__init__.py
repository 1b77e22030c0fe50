"""Operators of a training-data pipeline. ``load`` registers their queries."""
from __future__ import annotations

import importlib
import pkgutil


def load() -> None:
    """Import every module of this package that registers queries."""
    for mod in sorted(m.name for m in pkgutil.iter_modules(__path__)):
        if mod.startswith("queries_"):
            importlib.import_module(f"{__name__}.{mod}")
