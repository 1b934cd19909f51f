"""A key-value table kept as a log of writes."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def upsert(base: DataFrame, writes: DataFrame, key: str = "key", seq: str = "seq") -> DataFrame:
    """The latest write of each key. Among writes with the same ``seq`` the greatest row wins."""
    rest = [c for c in base.columns if c not in (key, seq)]
    both = base.unionByName(writes)
    last = F.max(F.struct(F.col(seq), *[F.col(c) for c in rest])).alias("_last")
    return both.groupBy(key).agg(last).select(key, *[F.col("_last")[c].alias(c) for c in (*rest, seq)]).select(*base.columns)


def delete(base: DataFrame, keys: DataFrame, key: str = "key") -> DataFrame:
    """Without the given keys; a key that isn't there changes nothing."""
    gone = keys.select(F.col(key).alias("_gone"))
    return base.join(gone, base[key] == gone["_gone"], "left_anti")


def get(base: DataFrame, value: object, key: str = "key") -> DataFrame:
    """The row of a key, if it is there."""
    return base.filter(F.col(key) == F.lit(value))
