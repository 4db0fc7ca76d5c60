"""Registered queries over the driver tables."""

from __future__ import annotations

import importlib
from types import SimpleNamespace

MODULES = ("windows_q", "clean_q", "joins_q", "aggregates_q", "streams_q", "learning_q", "plans_q", "nullkeys_q", "context_q", "tables_q")


def load() -> SimpleNamespace:
    for m in MODULES:
        importlib.import_module(f"tramline.catalog.{m}")
    from tramline.catalog import base

    return SimpleNamespace(queries=base.QUERIES, sql=base.SQL)
