"""Scans of stored tables, by sequence, key and row id."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from brindle.errors import ConfigError, ValueError_


def seq_scan(df: DataFrame, columns: list[str] | None = None, predicate: Column | None = None) -> DataFrame:
    """Rows that the predicate accepts, with the columns asked for; both reach the Parquet reader."""
    if predicate is not None:
        df = df.filter(predicate)
    return df if columns is None else df.select(*columns)


def read_seq(spark: SparkSession, path: str, columns: list[str] | None = None, predicate: Column | None = None) -> DataFrame:
    """``seq_scan`` of a Parquet path."""
    return seq_scan(spark.read.parquet(path), columns, predicate)


def index_scan(df: DataFrame, key: str, value: object) -> DataFrame:
    """Rows with one key. On files sorted by the key, row-group statistics skip the others."""
    return df.filter(F.col(key) == F.lit(value))


def range_scan(df: DataFrame, key: str, lower: object = None, upper: object = None, *, include_lower: bool = True, include_upper: bool = False, reverse: bool = False) -> DataFrame:
    """Rows between two bounds in key order; None leaves a side open."""
    if key not in df.columns:
        raise ValueError_(f"no column {key}")
    k = F.col(key)
    if lower is not None:
        df = df.filter(k >= lower if include_lower else k > lower)
    if upper is not None:
        df = df.filter(k <= upper if include_upper else k < upper)
    return df.orderBy(k.desc() if reverse else k.asc())


def get_tuples(df: DataFrame, rids: DataFrame, key: str = "rid") -> DataFrame:
    """Rows whose id is in ``rids``, each once however often it is asked for."""
    if len(rids.columns) != 1:
        raise ConfigError("rids has to have one column")
    wanted = rids.toDF("_wanted")
    return df.join(wanted, df[key] == wanted["_wanted"], "left_semi")
