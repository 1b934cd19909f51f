"""Insert, update and delete as rewrites of a table.

Plain Parquet tables can't be changed in place. Each function returns the new content; ``Table``
writes it to a folder of its own and renames that to the next version, so that no reader sees a
half-written version and nothing is read from the files being written.
"""

from __future__ import annotations

import uuid

from py4j.protocol import Py4JJavaError
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from brindle.errors import SerializationError, ValueError_


def _expr(e: str | Column) -> Column:
    return F.expr(e) if isinstance(e, str) else e


def insert(table: DataFrame, more: DataFrame) -> DataFrame:
    """With the rows of ``more``, by column name."""
    if set(table.columns) != set(more.columns):
        raise ValueError_(f"columns differ: {table.columns} and {more.columns}")
    return table.unionByName(more)


def update(table: DataFrame, changes: dict[str, str | Column], predicate: str | Column) -> DataFrame:
    """With new values where the predicate is true; where it is null or false a row stays as it is."""
    hit = F.coalesce(_expr(predicate), F.lit(False))
    unknown = set(changes) - set(table.columns)
    if unknown:
        raise ValueError_(f"no column {sorted(unknown)}")
    return table.select(*[F.when(hit, _expr(changes[c])).otherwise(F.col(c)).cast(table.schema[c].dataType).alias(c) if c in changes else F.col(c) for c in table.columns])


def delete(table: DataFrame, predicate: str | Column) -> DataFrame:
    """Without the rows for which the predicate is true; null keeps a row."""
    return table.filter(~F.coalesce(_expr(predicate), F.lit(False)))


class Table:
    """Versions of a table under one folder; the highest complete one is current."""

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path.rstrip("/")

    def _fs(self):
        folder = self.spark._jvm.org.apache.hadoop.fs.Path(self.path)
        return folder, folder.getFileSystem(self.spark._jsc.hadoopConfiguration())

    def versions(self) -> list[int]:
        """Versions whose writing ended."""
        folder, fs = self._fs()
        if not fs.exists(folder):
            return []
        done = lambda s: fs.exists(self.spark._jvm.org.apache.hadoop.fs.Path(s.getPath(), "_SUCCESS"))
        return sorted(int(s.getPath().getName()[1:]) for s in fs.listStatus(folder) if s.getPath().getName().startswith("v") and done(s))

    def read(self, version: int | None = None) -> DataFrame:
        """The current or a given version."""
        found = self.versions()
        if not found or version is not None and version not in found:
            raise ValueError_(f"no version {'' if version is None else version} in {self.path}")
        return self.spark.read.parquet(f"{self.path}/v{found[-1] if version is None else version}")

    def write(self, content: DataFrame) -> int:
        """Writes the next version and returns its number.

        The number is taken before anything is written. If another writer has taken it meanwhile, this
        one fails and leaves nothing, as its content may come from a version that isn't current any more.
        """
        found = self.versions()
        version = found[-1] + 1 if found else 0
        made = f"{self.path}/.{uuid.uuid4().hex}"
        content.write.parquet(made)
        jvm = self.spark._jvm
        made, place = (jvm.org.apache.hadoop.fs.Path(x) for x in (made, f"{self.path}/v{version}"))
        files = jvm.org.apache.hadoop.fs.FileContext.getFileContext(self._fs()[1].makeQualified(made).toUri(), self.spark._jsc.hadoopConfiguration())
        keep = self.spark.sparkContext._gateway.new_array(jvm.org.apache.hadoop.fs.Options.Rename, 0)
        try:
            files.rename(made, place, keep)
        except Py4JJavaError as e:
            files.delete(made, True)
            if files.util().exists(place):
                raise SerializationError(f"another writer made version {version} of {self.path}") from e
            raise
        return version
