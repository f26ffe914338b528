"""Projections whose results are computed once.

The optimizer pushes a filter below the projection it names a column of, and infers such
filters itself for every exploded array; the expression behind the column then runs once
more per filter, and a chain of costly columns runs many times over. Nothing is pushed
through a generator, so costly columns leave one here.
"""

import functools
from collections.abc import Callable

from pyspark import SparkContext
from pyspark.sql import Column, DataFrame, functions as F


def built_once(make: Callable) -> Callable:
    """For functions that make columns from names: every column is built once per JVM.

    A column is not bound to a table, and building a large one takes a call into the JVM for
    each part, which adds up to seconds where rules are as long as those for markup.
    """
    kept = functools.cache(lambda jvm, *args: make(*args))
    return functools.wraps(make)(lambda *args: kept(id(SparkContext._jvm), *args))


def evaluated_once(df: DataFrame, *columns: Column) -> DataFrame:
    """Select columns that later filters and explodes take as they are."""
    return df.select(F.inline(F.array(F.struct(*columns))))


def with_settled(df: DataFrame, name: str, column: Column) -> DataFrame:
    """Add or replace one costly column."""
    others = [c for c in df.columns if c != name]
    return df.select(*others, F.inline(F.array(F.struct(column.alias(name)))))
