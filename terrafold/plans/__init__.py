"""Registered queries, grouped by operator family."""

from __future__ import annotations

from importlib import import_module


def _module(name: str):
    return lambda: import_module(f"{__name__}.{name}")


MODULES = [_module(n) for n in ("metrics", "scalars", "relational", "spatial", "graphs", "population", "runs", "reports")]
