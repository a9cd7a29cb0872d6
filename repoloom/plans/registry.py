"""Named queries with their oracle SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from repoloom.plans.bindings import tables

RUNS: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    """Register ``fn(spark, sf_dir)`` to run on the tables below ``sf_dir``."""

    def add(fn: Callable[[SparkSession, str], DataFrame]):
        def run(spark: SparkSession, sf_dir: str) -> DataFrame:
            tables(spark, sf_dir)
            return fn(spark, sf_dir)

        if name in RUNS:
            raise ValueError(f"query {name!r} is registered twice")
        RUNS[name] = run
        if sql is not None:
            ORACLES[name] = sql
        return fn

    return add
