"""Incremental ingest, and the live state of jobs."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from docspark.operators import jobs


def ingest_once(spark: SparkSession, source: str, schema: str, checkpoint: str, work: Callable[[DataFrame, int], None], file_format: str = "parquet", files_per_batch: int = 1000) -> None:
    """Hand every file that is new under ``source`` to ``work``, once, in micro-batches; then stop."""
    rows = spark.readStream.format(file_format).schema(schema).option("maxFilesPerTrigger", files_per_batch).load(source)
    query = rows.writeStream.foreachBatch(work).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    query.awaitTermination()


def live_states(events: DataFrame, work: Callable[[DataFrame, int], None], checkpoint: str):
    """A streaming query that keeps the state of each job up to date; state is one row a job."""
    return jobs.states(events).writeStream.outputMode("update").foreachBatch(work).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
