"""The whole analysis of a table, and the registered queries with their SQL."""

from __future__ import annotations

from importlib import import_module

AREAS = (
    "profile_queries", "statistics_queries", "report_queries", "text_queries",
)


def _load():
    for area in AREAS:
        import_module(f"tabscope.plans.{area}")
    return import_module("tabscope.plans.registry")


def all_queries() -> dict:
    return dict(_load().QUERIES)


def all_sql() -> dict:
    return dict(_load().SQL)
