"""Session settings, input tables and intermediate tables in shared storage."""

from __future__ import annotations

import os
import re
import uuid
from collections.abc import Callable, Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession

from brindle.errors import ConfigError

#: Settings that the engine's plans rely on. Sizes are left to the cluster.
SETTINGS = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
}


def local_session(cores: int | str = "*", partitions: int = 8, memory: str = "8g") -> SparkSession:
    """A session on this machine, for tests and the benchmark."""
    builder = SparkSession.builder.master(f"local[{cores}]").appName("brindle")
    for key, value in SETTINGS.items():
        builder = builder.config(key, value)
    builder = (
        builder.config("spark.sql.shuffle.partitions", str(partitions))
        .config("spark.driver.memory", memory)
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
    )
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return spark


#: Rows of a batch that goes to Python. Spark's own default lets a batch of long texts take tens of MB
#: outside of the heap, several times in each task.
BATCH_ROWS = 1000


def bound_batches(spark: SparkSession) -> None:
    """Batches for Python of at most ``BATCH_ROWS`` rows, where the session has Spark's default.

    Plans read the setting when they run, so it stays set; a session that has a value of its own keeps it.
    """
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if spark.conf.get(key) == "10000":
        spark.conf.set(key, str(BATCH_ROWS))


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """The Parquet table ``name`` of a data folder; any path that Spark can read."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_folder(spark: SparkSession) -> str:
    """The folder that the driver and all executors share, for intermediate tables.

    It is what ``spark.checkpoint.dir`` names. Where that is unset on one machine, as in tests, a
    folder under the warehouse is taken; on a cluster that is an error, as a machine's own disk would be.
    """
    folder = spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not folder:
        if not re.match(r"local(\[|$)", spark.sparkContext.master):
            raise ConfigError("spark.checkpoint.dir has to name a folder that all machines share")
        folder = os.path.join(spark.conf.get("spark.sql.warehouse.dir").rstrip("/"), "_brindle")
    return qualified(spark, f"{folder.rstrip('/')}/{spark.sparkContext.applicationId}")


def qualified(spark: SparkSession, folder: str) -> str:
    """The folder as a URI with its scheme, by the cluster's default file system if it names none."""
    path = spark._jvm.org.apache.hadoop.fs.Path(folder)
    uri = path.getFileSystem(spark._jsc.hadoopConfiguration()).makeQualified(path).toUri().toString()
    return uri if "://" in uri else uri.replace(":", "://", 1)


#: Written tables that are not released, in order.
_WRITTEN: list[DataFrame] = []


def materialize(df: DataFrame, name: str = "table", compression: str = "snappy") -> DataFrame:
    """Writes ``df`` to the shared folder and returns the written table.

    This cuts the lineage with files that survive the loss of any executor, and gives the
    optimizer true sizes. ``release`` deletes the files.
    """
    spark = df.sparkSession
    path = f"{shared_folder(spark)}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path, compression=compression)
    out = spark.read.schema(df.schema).parquet(path)
    out._brindle_path = path
    _WRITTEN.append(out)
    return out


def release(*frames: DataFrame) -> None:
    """Deletes the files of materialized tables that nothing reads any more."""
    for df in frames:
        path = getattr(df, "_brindle_path", None)
        if path:
            jvm = df.sparkSession._jvm
            hadoop = jvm.org.apache.hadoop.fs.Path(path)
            hadoop.getFileSystem(df.sparkSession._jsc.hadoopConfiguration()).delete(hadoop, True)
            _WRITTEN[:] = [x for x in _WRITTEN if x is not df]


@contextmanager
def scratch() -> Iterator[Callable[[DataFrame], DataFrame]]:
    """Releases what was materialized within the block, but for the tables passed to what it yields."""
    before, kept = list(_WRITTEN), []

    def keep(df: DataFrame) -> DataFrame:
        kept.append(df)
        return df

    try:
        yield keep
    finally:
        release(*[x for x in list(_WRITTEN) if not any(x is y for y in (*before, *kept))])
