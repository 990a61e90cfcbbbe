"""Registered queries: every operator on the given tables, beside the SQL that checks it."""

from __future__ import annotations

import importlib
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from gridrisk.catalog.registry import CHECKS, QUERIES

SECTIONS = (
    "sources",
    "scalars",
    "spatial",
    "joins",
    "aggregates",
    "windows",
    "ranking",
    "statistics",
    "models",
    "maps",
)


def load() -> tuple[dict[str, Callable[[SparkSession, str], DataFrame]], dict[str, str]]:
    for name in SECTIONS:
        importlib.import_module(f"gridrisk.catalog.{name}")
    return QUERIES, CHECKS
