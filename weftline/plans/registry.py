"""The named queries of the engine and their SQL restatements.

Each module below holds functions marked with ``query``; the registry is the
union of what they register.
"""

from __future__ import annotations

import importlib
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

MODULES: tuple[str, ...] = ("cleaning", "relational", "protocol", "knowledge", "generation", "records", "generated")


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    found: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
    for name in MODULES:
        found |= importlib.import_module(f"weftline.plans.{name}").QUERIES
    return found


def oracle_sql() -> dict[str, str]:
    found: dict[str, str] = {}
    for name in MODULES:
        found |= importlib.import_module(f"weftline.plans.{name}").ORACLE
    return found
