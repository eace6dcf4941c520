"""Named queries and the SQL that checks each of them."""

from __future__ import annotations

import importlib
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from stocktake.plans.bindings import SQL, Model

MODULES = ("catalogue", "completion", "matching", "arranging", "auditing", "scalars", "discs", "importing")
_QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
_SQL: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    """Register a function of a Model. ``sql`` may use the model's tables by name."""

    def wrap(f: Callable[[Model], DataFrame]):
        _QUERIES[name] = lambda spark, sf_dir: f(Model(spark, sf_dir))
        if sql:
            head, rest = ("RECURSIVE", sql.strip()[9:]) if sql.strip().startswith("RECURSIVE") else ("", sql)
            _SQL[name] = f"WITH {head} {SQL}{',' if rest.strip().startswith('+') else ''} {rest.strip().removeprefix('+')}"
        return f

    return wrap


def _load() -> None:
    for module in MODULES:
        importlib.import_module(f"stocktake.plans.{module}")


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    _load()
    return dict(_QUERIES)


def oracle_sql() -> dict[str, str]:
    _load()
    return dict(_SQL)
