"""The query catalogue of the core library."""

from __future__ import annotations

import importlib
import pkgutil

from .registry import Registry


def catalogue() -> Registry:
    """All queries of the modules in this package that hold a registry named ``reg``."""
    found = Registry()
    for m in sorted(x.name for x in pkgutil.iter_modules(__path__)):
        reg = getattr(importlib.import_module(f"{__name__}.{m}"), "reg", None)
        if reg is not None:
            found.merge(reg)
    return found
