"""Named queries over the test tables, each with equivalent SQL where SQL can express it."""

from __future__ import annotations

from importlib import import_module

from catalog import registry

_MODULES = ("metrics", "histograms", "traces", "logs", "discovery", "reports", "jobs", "stored")


def load() -> tuple[dict[str, registry.Query], dict[str, str]]:
    for m in _MODULES:
        import_module(f"catalog.{m}")
    return registry.QUERIES, registry.SQL
