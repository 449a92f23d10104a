"""All queries and their SQL. Optional subpackages add theirs where they are installed."""

from __future__ import annotations

import importlib
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

MODULES = ["sylvaq.plans.trees", "sylvaq.plans.trees_sql", "sylvaq.plans.records", "sylvaq.plans.records_sql"]


def _collect(name: str) -> dict:
    found: dict = {}
    for module in MODULES:
        m = importlib.import_module(module)
        found |= getattr(m, name)() if hasattr(m, name) else {}
    return found


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return _collect("queries")


def oracle_sql() -> dict[str, str]:
    return _collect("oracle_sql")
