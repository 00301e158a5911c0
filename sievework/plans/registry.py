"""The registry that plan modules fill with the @query decorator."""

from __future__ import annotations

import importlib
from collections.abc import Callable

#: Modules that hold named queries; each registers its own on import.
MODULES: tuple[str, ...] = ("banding", "curation", "evaluation", "mixing", "coaching", "reports", "candidates", "divergence", "files", "logs", "scale", "exports")

_QUERIES: dict[str, Callable] = {}
_ORACLES: dict[str, str] = {}


def query(oracle: str | None = None, name: str | None = None) -> Callable:
    """Registers a query under its function's name, with its DuckDB oracle if it has one."""

    def keep(fn: Callable) -> Callable:
        key = name or fn.__name__
        if key in _QUERIES and _QUERIES[key] is not fn:
            raise ValueError(f"two queries are named {key}")
        _QUERIES[key] = fn
        if oracle is not None:
            _ORACLES[key] = oracle
        return fn

    return keep


def load() -> tuple[dict[str, Callable], dict[str, str]]:
    for module in MODULES:
        importlib.import_module(f"sievework.plans.{module}")
    return _QUERIES, _ORACLES
