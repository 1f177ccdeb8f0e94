"""Queries by name; the SQL that gives the same rows, where SQL can."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from .adapters import by_concept, duck, load

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE_SQL: dict[str, str] = {}


class Inputs:
    """The inputs of a query, loaded by name when they are asked for."""

    def __init__(self, spark: SparkSession, sf_dir: str):
        self.spark, self.sf_dir = spark, sf_dir

    def __getattr__(self, name: str) -> DataFrame:
        return load(self.spark, self.sf_dir, name)

    def by_concept(self, mentions: DataFrame) -> DataFrame:
        return by_concept(self.spark, self.sf_dir, mentions)


def query(name: str, sql: str | None = None) -> Callable:
    """Registers make(inputs) -> DataFrame under a name, with its oracle."""

    def register(make: Callable[[Inputs], DataFrame]) -> Callable[[Inputs], DataFrame]:
        QUERIES[name] = lambda spark, sf_dir: make(Inputs(spark, sf_dir))
        if sql:
            ORACLE_SQL[name] = duck(sql)
        return make

    return register
