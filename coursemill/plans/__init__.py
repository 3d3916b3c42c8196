"""Queries over the given tables, by area."""

from __future__ import annotations

from importlib import import_module

AREAS = ("course", "answers", "scores", "media")


def registered() -> tuple[dict, dict]:
    """All queries and their SQL."""
    queries, sql = {}, {}
    for area in AREAS:
        module = import_module(f"coursemill.plans.{area}")
        queries |= module.Q
        sql |= module.SQL
    return queries, sql
