"""Queries over the driver's tables, grouped by the part of the library they show."""

from __future__ import annotations

from importlib import import_module

MODULES = ("profiles", "detection", "tags", "geometry", "search", "reports", "versions", "comments", "network", "lines", "whole")


def load() -> None:
    """Import all query modules, which registers their queries."""
    for name in MODULES:
        import_module(f"{__name__}.{name}")
