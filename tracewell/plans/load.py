"""Import every query module once and hand out the registry."""

from __future__ import annotations

from importlib import import_module

from tracewell.plans import registry

MODULES = ("records", "metrics", "retrieval", "context", "responses", "oneclass", "sources")


def _load() -> None:
    for name in MODULES:
        import_module(f"tracewell.plans.{name}_queries")


def queries():
    _load()
    return dict(registry.QUERIES)


def oracles():
    _load()
    return dict(registry.ORACLES)
