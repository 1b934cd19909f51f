"""Type names of table specifications, and checks of join keys."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import types as T

from brindle.errors import ConfigError, ValueError_

#: Type names that specifications and the catalog use.
TYPE_NAMES = {
    "TINYINT": T.ByteType(),
    "SMALLINT": T.ShortType(),
    "INTEGER": T.IntegerType(),
    "BIGINT": T.LongType(),
    "DOUBLE": T.DoubleType(),
    "FLOAT": T.FloatType(),
    "BOOL": T.BooleanType(),
    "VARCHAR": T.StringType(),
    "TIMESTAMP": T.TimestampNTZType(),
}


def type_of(name: str) -> T.DataType:
    """The Spark type of a specification's type name."""
    try:
        return TYPE_NAMES[name.upper()]
    except KeyError:
        raise ValueError_(f"unknown type {name}") from None


def _family(kind: T.DataType) -> str:
    if isinstance(kind, T.NumericType):
        return "number"
    if isinstance(kind, (T.StringType, T.VarcharType, T.CharType)):
        return "string"
    if isinstance(kind, (T.ArrayType, T.StructType)):
        return kind.simpleString()
    return type(kind).__name__


def check_keys(left: DataFrame, right: DataFrame, on: list[tuple[str, str]]) -> None:
    """Key pairs have to exist, be orderable and belong to one family; numbers may widen."""
    if not on:
        raise ConfigError("an equi-join needs at least one key pair")
    for a, b in on:
        for name, df in ((a, left), (b, right)):
            if name not in df.columns:
                raise ValueError_(f"no column {name} among {df.columns}")
            if isinstance(df.schema[name].dataType, T.MapType):
                raise ValueError_(f"a map can't be a join key: {name}")
        x, y = left.schema[a].dataType, right.schema[b].dataType
        if _family(x) != _family(y):
            raise ValueError_(f"keys {a} {x.simpleString()} and {b} {y.simpleString()} are of different families")
