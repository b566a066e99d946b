"""Named queries: a plan builder over the canonical tables, and its SQL check where one exists."""

from __future__ import annotations

from collections.abc import Callable
from importlib import import_module

from pyspark.sql import DataFrame, SparkSession

from tradewright.plans.oracle import with_views
from tradewright.sources.canonical import Tables

AREAS = ("dashboard", "ingestion", "margins", "supply", "receivables", "panels", "evaluation", "forecasts", "recommendation", "documents",
         "actions")

_queries: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
_checks: dict[str, str] = {}


def register(name: str, build: Callable[[Tables], DataFrame], sql: str | None = None,
             views: dict[str, str] | None = None) -> None:
    if name in _queries:
        raise ValueError(f"query {name} registered twice")
    _queries[name] = lambda spark, folder: build(Tables(spark, folder))
    if sql is not None:
        _checks[name] = with_views(sql, views)


def load() -> tuple[dict, dict]:
    for area in AREAS:
        import_module(f"tradewright.plans.{area}")
    return dict(_queries), dict(_checks)
