"""The two dictionaries the driver reads, filled by the `query` decorator."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from gridrisk.catalog.standins import Tables
from gridrisk.session import ship_package

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
CHECKS: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    """Register a function of `Tables` under `name`, with its DuckDB twin where SQL has one."""

    def register(build: Callable[[Tables], DataFrame]):
        if name in QUERIES:
            raise ValueError(f"{name} is registered twice")

        def run(spark: SparkSession, sf_dir: str) -> DataFrame:
            return build(Tables(ship_package(spark), sf_dir))

        QUERIES[name] = run
        if sql is not None:
            CHECKS[name] = sql
        return build

    return register
