"""Create, look up and drop tables by name."""

from __future__ import annotations

from pyspark.sql import SparkSession
from pyspark.sql import types as T

from brindle.errors import ValueError_
from brindle.functions.types import type_of


class Catalog:
    """The session's catalog with specification types and clear errors."""

    def __init__(self, spark: SparkSession):
        self.spark = spark

    def create_table(self, name: str, columns: list[tuple[str, str]]) -> T.StructType:
        """An empty Parquet table; a name that is taken is an error."""
        if self.spark.catalog.tableExists(name):
            raise ValueError_(f"table {name} exists")
        schema = T.StructType([T.StructField(c, type_of(kind)) for c, kind in columns])
        self.spark.createDataFrame([], schema).write.format("parquet").saveAsTable(name)
        return schema

    def get_table(self, name: str) -> T.StructType:
        """The columns of a table; an unknown name is an error."""
        if not self.spark.catalog.tableExists(name):
            raise ValueError_(f"not found table {name}")
        return self.spark.table(name).schema

    def drop_table(self, name: str) -> None:
        """Removes a table; an unknown name is an error."""
        self.get_table(name)
        self.spark.sql(f"DROP TABLE {name}")
