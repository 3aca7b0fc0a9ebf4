"""Registered queries, one module per area."""

from __future__ import annotations

import importlib

MODULES = ["search", "traffic", "textual", "ingest_state", "graphs", "replacing", "whole", "ingest", "quality", "streams"]


def load_all() -> None:
    """Import every module that registers queries (once)."""
    for module in MODULES:
        importlib.import_module(f"loreframe.plans.{module}")
