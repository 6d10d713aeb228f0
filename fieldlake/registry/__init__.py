"""Queries over the driver's tables; ``load`` imports every query module."""

from __future__ import annotations

import importlib
import pkgutil


def load():
    for module in pkgutil.iter_modules(__path__):
        if module.name.startswith("q_"):
            importlib.import_module(f"{__name__}.{module.name}")
    return importlib.import_module(f"{__name__}.core")
