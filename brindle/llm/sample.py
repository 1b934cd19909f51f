"""Bounded, seeded samples of labelled rows for training."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from brindle.llm.components import small
from brindle.session import materialize


def fold(doc_id: Column, parts: int) -> Column:
    """The remainder of an id's crc32, which tells training from held-out rows."""
    return F.pmod(F.crc32(doc_id.cast("string").cast("binary")), F.lit(parts))


def per_class(rows: DataFrame, label: str, most: int, in_all: int, seed: int) -> DataFrame:
    """About ``most`` rows of each class and ``in_all`` of all classes, chosen by a hash of doc_id; all rows of a class that has fewer.

    Classes are counted first, in a written table with a row each, so plans don't grow with their number.
    """
    counts = materialize(rows.groupBy(F.col(label).alias("_class")).agg(F.count("*").alias("_n")), "classes")
    each = min(most, max(1, in_all // max(1, counts.count())))
    chance = F.lit(float(each)) / F.col("_n")
    out = rows.join(small(counts), F.col(label) == F.col("_class"))
    return out.filter(F.pmod(F.xxhash64(F.lit(seed), "doc_id"), F.lit(1 << 30)) / F.lit(1 << 30) < chance).select(*rows.columns)
