"""The registered queries: one or more per operator, with their SQL twins.

Every query reads whole tables. Nulls, text shapes and copies that the given
tables lack are derived from them by expressions that the SQL repeats.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


class Tables:
    """The given tables by name: ``t.orders``."""

    def __init__(self, spark: SparkSession, folder: str):
        self.spark, self.folder = spark, folder

    def __getattr__(self, name: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.folder}/{name}.parquet")

    def derive(self, table: str, exprs: list[str]) -> DataFrame:
        return getattr(self, table).selectExpr(*exprs)


def query(name: str, sql: str | None = None):
    """Register a function of the tables, and its SQL twin if there is one."""

    def register(function: Callable[[Tables], DataFrame]):
        QUERIES[name] = lambda spark, folder: function(Tables(spark, folder))
        if sql:
            ORACLES[name] = sql
        return function

    return register


def select(exprs: list[str], table: str) -> str:
    return f"SELECT {', '.join(exprs)} FROM {table}"


def load() -> None:
    from . import columns, fitted, reports, rows, sources, steps  # noqa: F401
