"""Registered queries: the operators applied to the driver's tables."""

from __future__ import annotations

import importlib

MODULES = ("network", "communities", "evolution", "text", "vectors", "themes", "bench", "models", "published", "more", "bundles", "readside", "generation", "streams")


def load() -> None:
    for name in MODULES:
        importlib.import_module(f"{__name__}.{name}")
