"""The list of registered queries."""

from __future__ import annotations

from collections.abc import Callable
from typing import NamedTuple

from pyspark.sql import DataFrame, SparkSession

from .views import view, with_views


class Tables:
    """Loads driver tables and derived views by name: ``t("orders")``."""

    def __init__(self, spark: SparkSession, sf_dir: str) -> None:
        self.spark, self.sf_dir = spark, sf_dir.rstrip("/")

    def __call__(self, name: str) -> DataFrame:
        return view(self.spark, self.sf_dir, name)

    def wide(self, name: str) -> DataFrame:
        """The same for CPU-heavy row work: few-file tables are spread over all slots first."""
        return view(self.spark, self.sf_dir, name, wide=True)


class Case(NamedTuple):
    build: Callable[[Tables], DataFrame]
    sql: str | None


CASES: dict[str, Case] = {}


def case(name: str, sql: str | None = None, views: tuple[str, ...] | str = ()):
    """Register a query, with the SQL that must give the same rows (None: rows only)."""
    wanted = (views,) if isinstance(views, str) else views

    def add(fn: Callable[[Tables], DataFrame]):
        if name in CASES:
            raise ValueError(f"query {name} registered twice")
        CASES[name] = Case(fn, with_views(sql, *wanted) if sql else None)
        return fn

    return add
