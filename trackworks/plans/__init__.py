"""Query catalogue: importing a module of this package registers its queries."""

from __future__ import annotations

import importlib
import pkgutil

from trackworks.registry import Registry, registry


def load_all() -> Registry:
    for m in pkgutil.iter_modules(__path__):
        importlib.import_module(f"{__name__}.{m.name}")
    return registry
