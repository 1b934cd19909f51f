"""Tables made from a specification or a formula."""

from __future__ import annotations

import json

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from brindle.errors import ParseError
from brindle.functions.types import type_of

#: Rows after which a serial column starts again, unless asked otherwise.
SERIAL_BATCH = 128


def serial(row: Column, batch: int | None = SERIAL_BATCH) -> Column:
    """Counts from 0, again in each batch; None counts through the whole table."""
    return row if batch is None else F.pmod(row, F.lit(batch))


def uniform(row: Column, low: int, high: int, seed: int = 12345) -> Column:
    """A number of [low, high) from integer arithmetic on the row, alike in any layout."""
    if high <= low:
        raise ParseError(f"empty range [{low}, {high})")
    if high - low > 1 << 31:
        raise ParseError(f"a range of more than {1 << 31}: [{low}, {high})")
    return _mixed(row, seed) % F.lit(high - low) + F.lit(low)


def _mixed(row: Column, seed: int) -> Column:
    """31 bits of a row's number, which may be any."""
    turn = F.lit(1 << 31)
    return F.pmod(F.pmod(row, turn) * F.lit(1103515245) + F.lit(seed), turn)


def generate(spark: SparkSession, spec: dict | str, batch: int | None = SERIAL_BATCH) -> DataFrame:
    """The table of a specification (a dictionary or its JSON)."""
    if isinstance(spec, str):
        try:
            spec = json.loads(spec)
        except ValueError as e:
            raise ParseError(str(e)) from e
    columns = []
    for n, col in enumerate(spec["cols"]):
        row = F.col("id")
        if col["dist"] == "Serial":
            made = serial(row, batch)
        elif col["dist"] == "Uniform":
            made = uniform(row, col["min"], col["max"], 12345 + n)
        else:
            raise ParseError(f"unknown distribution {col['dist']}")
        columns.append(made.cast(type_of(col["type_id"])).alias(col["name"]))
    return spark.range(spec["size"]).select(*columns)


def populate(ids: DataFrame, key: str, rows: int | None = None) -> DataFrame:
    """Cells by a formula of row and column: 10 * row + column.

    With ``rows``, the number of rows there are, this is the random mode: col_b takes its row from the
    first third, so that values repeat, and col_c from all numbers of 32 bits. Whole numbers wrap round at 32 bits.
    """
    row = F.col(key).cast("bigint")
    b = row if rows is None else uniform(row, 0, max(rows // 3, 1), 1)
    c = row if rows is None else _mixed(row, 2) * 2 + F.pmod(_mixed(row, 3), F.lit(2))

    def cell(r: Column, column: int) -> Column:
        turn = F.lit(1 << 32)
        value = F.pmod(r * 10 + column, turn)
        return F.when(value >= 1 << 31, value - turn).otherwise(value).cast("int")

    return ids.select(cell(row, 0).alias("col_a"), cell(b, 1).alias("col_b"), cell(c, 2).cast("double").alias("col_c"))
