"""The folder that driver and executors share, and tables written to it once."""

from __future__ import annotations

import contextlib
import tempfile
import uuid
from collections.abc import Iterator

from pyspark.sql import DataFrame, SparkSession

#: Whether Spark deletes the shuffle files of an execution when it ends, or when the driver happens to collect its garbage.
CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def shared_dir(spark: SparkSession) -> str:
    """``spark.checkpoint.dir``; a temporary folder only where the session names none and runs on this machine alone."""
    found = spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        held = spark.sparkContext._jsc.sc().getCheckpointDir()
        found = held.get() if held.isDefined() else None
    if not found:
        if not spark.sparkContext.master.partition("[")[0] == "local":
            raise RuntimeError("set spark.checkpoint.dir to a folder that driver and executors share")
        found = tempfile.mkdtemp(prefix="docspark-")
        spark.sparkContext.setCheckpointDir(found)
    return found


@contextlib.contextmanager
def swept(spark: SparkSession) -> Iterator[None]:
    """Tables that are written meanwhile leave no shuffle files behind."""
    held = spark.conf.get(CLEANUP, "false")
    spark.conf.set(CLEANUP, "true")
    try:
        yield
    finally:
        spark.conf.set(CLEANUP, held)


def written(df: DataFrame, name: str) -> tuple[str, DataFrame]:
    """``df`` written once to the shared folder: where, and read back."""
    path = f"{shared_dir(df.sparkSession).rstrip('/')}/{name}-{uuid.uuid4().hex}"
    with swept(df.sparkSession):
        df.write.option("compression", "zstd").parquet(path)
    return path, df.sparkSession.read.schema(df.schema).parquet(path)


def settle(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` once to the shared folder and read it back, so nothing computes it again."""
    return written(df, name)[1]


def emptied(spark: SparkSession, path: str, schema) -> None:
    """Leave no row in the table at ``path``."""
    spark.createDataFrame([], schema).coalesce(1).write.mode("overwrite").parquet(path)


@contextlib.contextmanager
def settled(df: DataFrame, name: str) -> Iterator[DataFrame]:
    """The same table for as long as it is needed: its files go at the end."""
    path, rows = written(df, name)
    try:
        yield rows
    finally:
        emptied(df.sparkSession, path, df.schema)
