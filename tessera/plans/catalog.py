"""Loads the modules that register queries."""

from __future__ import annotations

import importlib

MODULES = ("tables", "columns", "statistics", "learning", "advanced")


def load() -> None:
    for name in MODULES:
        importlib.import_module(f"tessera.plans.{name}")
