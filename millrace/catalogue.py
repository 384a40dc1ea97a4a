"""Queries and SQL of the core operators."""

from __future__ import annotations

from importlib import import_module

MODULES = ("exports", "chat", "quality", "vectors", "images", "misc")


def _modules():
    return [import_module(f"millrace.queries.{m}") for m in MODULES]


def queries() -> dict:
    found: dict = {}
    for m in _modules():
        found |= m.QUERIES
    return found


def oracle_sql() -> dict[str, str]:
    found: dict[str, str] = {}
    for m in _modules():
        found |= m.SQL
    return found
