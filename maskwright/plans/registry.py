"""Queries and their SQL twins, filled by the modules of this package."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from maskwright.sources.tables import read_table

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}


class Tables:
    """The tables of one folder as attributes: ``t.events``."""

    def __init__(self, spark: SparkSession, sf_dir: str):
        self.spark, self._dir = spark, sf_dir

    def __getattr__(self, name: str) -> DataFrame:
        return read_table(self.spark, self._dir, name)


def query(sql: str | None = None, name: str | None = None):
    """Register a function of Tables under its name, with its SQL if SQL can say it."""

    def add(f: Callable[[Tables], DataFrame]):
        key = name or f.__name__
        if key in QUERIES:
            raise ValueError(f"two queries are named {key}")
        QUERIES[key] = lambda spark, sf_dir: f(Tables(spark, sf_dir))
        if sql:
            ORACLES[key] = sql
        return f

    return add


def select(exprs: dict[str, str], table: str, where: str = "") -> str:
    """The SQL twin of ``derive``: one list of expressions that both engines read alike."""
    return "select " + ", ".join(f"{e} as {n}" for n, e in exprs.items()) + f" from {table}" + (f" where {where}" if where else "")


def derive(df: DataFrame, exprs: dict[str, str]) -> DataFrame:
    return df.selectExpr(*(f"{e} as {n}" for n, e in exprs.items()))
