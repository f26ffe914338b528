"""The registered queries: name, operators they show, Spark plan, and the SQL that checks it."""

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession


@dataclass(frozen=True)
class Query:
    name: str
    operators: tuple[str, ...]
    run: Callable[[SparkSession, str], DataFrame]
    sql: str | None


REGISTRY: dict[str, Query] = {}


def query(operators: str, sql: str | None = None):
    """Register a function `(spark, folder) -> DataFrame` under its own name."""

    def register(function):
        REGISTRY[function.__name__] = Query(function.__name__, tuple(operators.split()), function, sql)
        return function

    return register
