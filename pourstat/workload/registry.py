"""Registered queries: a Spark callable and, where SQL can say it, a SQL check."""

from __future__ import annotations

from collections.abc import Callable
from typing import NamedTuple

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pourstat.session import tune
from pourstat.workload import standins as W


class Query(NamedTuple):
    run: Callable[[SparkSession, str], DataFrame]
    sql: str | None


REGISTRY: dict[str, Query] = {}


class Tables:
    """Access to base and stand-in tables of one scale folder."""

    def __init__(self, spark: SparkSession, sf_dir: str):
        self.spark, self.sf_dir = spark, sf_dir

    def __getitem__(self, name: str) -> DataFrame:
        if name in W.VIEWS:
            return W.view(self.spark, self.sf_dir, name)
        return W.base_table(self.spark, self.sf_dir, name)

    def extract_tables(self) -> dict[str, DataFrame]:
        return W.extract_tables(self.spark, self.sf_dir)


def query(name: str, sql: str | None = None):
    """Register ``fn(tables) -> DataFrame`` under a name."""

    def add(fn: Callable[[Tables], DataFrame]) -> Callable[[Tables], DataFrame]:
        def run(spark: SparkSession, sf_dir: str) -> DataFrame:
            return fn(Tables(tune(spark), sf_dir))

        if name in REGISTRY:
            raise ValueError(f"query {name} is registered twice")
        REGISTRY[name] = Query(run, sql)
        return fn

    return add


def rounded(df: DataFrame, digits: int = 6) -> DataFrame:
    """Doubles to a fixed number of digits, so summation order does not show."""
    return df.select(
        *[F.round(F.col(f"`{c}`"), digits).alias(c) if t == "double" else F.col(f"`{c}`") for c, t in df.dtypes]
    )


def R(expr: str, name: str | None = None, digits: int = 6) -> str:
    """The same rounding in a SQL check."""
    return f"round(CAST({expr} AS DOUBLE), {digits}) AS {name or expr}"


def RS(*names: str) -> str:
    return ", ".join(R(n) for n in names)
