"""The queries of the engine by name, with the SQL that must give the same rows."""

from __future__ import annotations

import importlib
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

Query = Callable[[SparkSession, str], DataFrame]

#: Modules that hold QUERIES (name -> query) and ORACLES (name -> DuckDB SQL).
MODULES: tuple[str, ...] = ("gate", "curation", "triage", "code", "reports")


def _gather(attribute: str) -> dict:
    found: dict = {}
    for name in MODULES:
        found.update(getattr(importlib.import_module(f"tamis.plans.{name}"), attribute))
    return found


def queries() -> dict[str, Query]:
    return _gather("QUERIES")


def oracle_sql() -> dict[str, str]:
    return _gather("ORACLES")
