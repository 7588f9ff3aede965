"""All registered queries with their SQL counterparts."""

import importlib
import pkgutil

from lossweave.registry.base import ORACLE, QUERIES

for _module in pkgutil.iter_modules(__path__):
    importlib.import_module(f"{__name__}.{_module.name}")

__all__ = ["ORACLE", "QUERIES"]
