"""Registered queries: what to run on the given tables, and its SQL twin."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession


@dataclass(frozen=True)
class Query:
    name: str
    run: Callable[[SparkSession, str], DataFrame]
    covers: tuple[str, ...]
    sql: str | None


REGISTRY: dict[str, Query] = {}


def query(covers: str, sql: str | None = None):
    """Register the decorated function under its own name.

    ``covers`` lists the inventory ids the query exercises. ``sql`` computes the
    same rows with the same column names; queries without one are checked by
    row count here and by value in the tests.
    """

    def register(run: Callable[[SparkSession, str], DataFrame]):
        REGISTRY[run.__name__] = Query(run.__name__, run, tuple(covers.split()), sql)
        return run

    return register


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")
