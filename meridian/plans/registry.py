"""All registered queries and their SQL."""

from __future__ import annotations

from collections.abc import Callable
from importlib import import_module

from pyspark.sql import DataFrame, SparkSession

MODULES = ("behaviour", "candidates", "joining", "ranking", "measures", "contents", "catalogue", "runs", "streams", "loading")


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    found: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
    for name in MODULES:
        found |= import_module(f"{__package__}.{name}").QUERIES
    return found


def oracle() -> dict[str, str]:
    found: dict[str, str] = {}
    for name in MODULES:
        found |= import_module(f"{__package__}.{name}").ORACLE
    return found
