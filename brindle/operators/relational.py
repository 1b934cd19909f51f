"""Filter, projection, aggregation, distinct, sort and limit."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from brindle.errors import ConfigError


def where(df: DataFrame, predicate: str | Column) -> DataFrame:
    """Rows for which the predicate is true; null counts as false."""
    return df.filter(predicate)


def project(df: DataFrame, targets: dict[str, str | Column]) -> DataFrame:
    """A column for each target name, by expression."""
    return df.select(*[(F.expr(e) if isinstance(e, str) else e).alias(name) for name, e in targets.items()])


def aggregate(df: DataFrame, keys: list[str], aggregates: dict[str, str | Column]) -> DataFrame:
    """One row for each group, or one row in all without keys."""
    if not aggregates:
        raise ConfigError("no aggregate given")
    return df.groupBy(*keys).agg(*[(F.expr(e) if isinstance(e, str) else e).alias(name) for name, e in aggregates.items()])


def distinct(df: DataFrame, columns: list[str] | None = None) -> DataFrame:
    """Each different row once."""
    return (df if columns is None else df.select(*columns)).distinct()


def limit(df: DataFrame, n: int, order: list[Column] | None = None) -> DataFrame:
    """The first n rows; with an order this is a top-n, which sorts only n rows a partition."""
    if n < 0:
        raise ConfigError("a limit can't be negative")
    return (df if order is None else df.orderBy(*order)).limit(n)
