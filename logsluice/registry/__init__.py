"""Queries over the driver tables, each with its DuckDB counterpart."""

from __future__ import annotations

from importlib import import_module

MODULES = ("filtering", "searching", "listing", "shaping", "textlogs", "triage", "failing", "streams")


def load():
    """All queries and all SQL texts, by name."""
    from logsluice.registry import base

    for name in MODULES:
        import_module(f"logsluice.registry.{name}")
    return base.QUERIES, base.ORACLES
