"""Registry of the corpus queries and of their SQL."""

from __future__ import annotations

import importlib
from collections.abc import Callable

MODULES = ("encoding", "spans", "split", "bitext", "unify", "pack", "leak", "truncation")


def _all(attribute: str) -> dict:
    found: dict = {}
    for name in MODULES:
        found |= getattr(importlib.import_module(f"textloom.llm.{name}"), attribute, {})
    return found


def queries() -> dict[str, Callable]:
    return _all("QUERIES")


def oracle_sql() -> dict[str, str]:
    return _all("SQL")
