"""Session settings shared by tests, the benchmark and stand-alone use, and tables between the steps of a query."""

from __future__ import annotations

import atexit
import os
import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession

_RUN = f"cuespark-{uuid.uuid4().hex[:12]}"
_scopes: list[list[str]] = []


def build_session(app: str = "cuespark", master: str | None = None, shuffle_partitions: int | None = None) -> SparkSession:
    builder = SparkSession.builder.appName(app)
    if master:
        builder = builder.master(master).config("spark.driver.memory", os.environ.get("CUESPARK_DRIVER_MEMORY", "8g"))
    if shuffle_partitions:
        builder = builder.config("spark.sql.shuffle.partitions", str(shuffle_partitions))
    spark = (
        builder.config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.adaptive.skewJoin.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def shared_folder(spark: SparkSession) -> str:
    """This process's folder below ``spark.checkpoint.dir``, which a cluster must name and all its executors share.  Only
    a session with a local master may go without; it then works in the temporary folder of its one machine."""
    named = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not named:
        master = spark.sparkContext.master
        if master != "local" and not master.startswith("local["):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        named = f"file://{tempfile.gettempdir()}"
    return f"{named.rstrip('/')}/{_RUN}"


def new_folder(spark: SparkSession, name: str) -> str:
    """A fresh folder for one run, removed at the end of the ``scratch`` block it was made in, or else of the process."""
    path = f"{shared_folder(spark)}/{name}-{uuid.uuid4().hex}"
    if _scopes:
        _scopes[-1].append(path)
    else:
        atexit.register(remove_folder, spark, path)
    return path


@contextmanager
def scratch(spark: SparkSession) -> Iterator[None]:
    """Frees the tables staged within the block at its end; what is to last must have been written elsewhere by then."""
    _scopes.append([])
    try:
        yield
    finally:
        for path in _scopes.pop():
            remove_folder(spark, path)


def remove_folder(spark: SparkSession, path: str) -> None:
    if spark.sparkContext._jsc is not None:
        target = spark._jvm.org.apache.hadoop.fs.Path(path)
        target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(target, True)


def subfolders(spark: SparkSession, path: str) -> list[str]:
    """Names of the folders right below a folder, none if it does not exist."""
    target = spark._jvm.org.apache.hadoop.fs.Path(path)
    files = target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    return [f.getPath().getName() for f in files.listStatus(target) if f.isDirectory()] if files.exists(target) else []


def stage(df: DataFrame) -> DataFrame:
    """Writes an intermediate table as Parquet to the shared folder and reads it back, so that what follows reads only the
    columns it needs, several readers do the work once, and lost executors resume from files."""
    path = new_folder(df.sparkSession, "stage")
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)
