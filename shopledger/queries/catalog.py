"""All registered queries."""

from __future__ import annotations

import importlib
import pkgutil

import shopledger.queries as package
from shopledger.queries.registry import QUERIES, Query


def all_queries() -> dict[str, Query]:
    """Load every ``q_*`` module and return its queries by name."""
    for info in pkgutil.iter_modules(package.__path__):
        if info.name.startswith("q_"):
            importlib.import_module(f"{package.__name__}.{info.name}")
    return dict(QUERIES)
