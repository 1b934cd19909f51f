"""In-memory tables and what is done with results."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import DataFrame, Row, SparkSession
from pyspark.sql import types as T
from pyspark.testing import assertDataFrameEqual


def rows(spark: SparkSession, data: Iterable[tuple], schema: str | T.StructType) -> DataFrame:
    """A table of the given rows."""
    return spark.createDataFrame(list(data), schema)


def batches(spark: SparkSession, data: Iterable[Iterable[tuple]], schema: str | T.StructType) -> DataFrame:
    """The rows of several batches, in one table; none at all gives an empty table."""
    return rows(spark, [row for batch in data for row in batch], schema)


def collect(df: DataFrame) -> list[Row]:
    """All rows of a result that the caller knows to be small."""
    return df.collect()


def pretty(df: DataFrame, limit: int | None = 1000) -> str:
    """The first rows of a result as a boxed text table, with a line that says so if there are more.

    None shows all rows, which the caller then knows to be few. An empty result has its header.
    """
    return df._show_string(df.count() if limit is None else limit, False, False)


def assert_same_rows(df: DataFrame, expected: DataFrame) -> None:
    """Fails unless both tables have the same rows, in any order."""
    assertDataFrameEqual(df, expected, checkRowOrder=False)
