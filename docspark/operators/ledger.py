"""The ledger of jobs as a table that is added to: events in batches, and snapshots of the states that they make.

A snapshot keeps, for each job, the latest write of every column with its number, so snapshots and events merge in
any order, however often: late and repeated events change nothing that came after them.  It also names the
files that it covers; what is read later is the snapshot and the files that it does not name.
"""

from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession, functions as F

from docspark.operators import jobs

EVENTS = "job_id string, seq long, ts timestamp, kind string, translated_blocks int, total_blocks int, output_path string, error_message string"


def record(events: DataFrame, path: str, batch: str) -> None:
    """Write the events of one batch; the same batch written again replaces itself."""
    kinds = dict(f.split(" ") for f in EVENTS.split(", "))
    rows = events.select(*[(F.col(c) if c in events.columns else F.lit(None)).cast(k).alias(c) for c, k in kinds.items()])
    rows.write.mode("overwrite").parquet(f"{path}/events/batch={batch}")


def _found(spark: SparkSession, path: str, schema: str | None = None) -> DataFrame | None:
    try:
        return (spark.read.schema(schema) if schema else spark.read).parquet(path)
    except AnalysisException as e:
        if e.getCondition() == "PATH_NOT_FOUND":
            return None
        raise


def events(spark: SparkSession, path: str) -> DataFrame:
    """All events that were ever recorded."""
    held = _found(spark, f"{path}/events", EVENTS)
    return spark.createDataFrame([], EVENTS) if held is None else held.select(*[f.split(" ")[0] for f in EVENTS.split(", ")])


def _snapshot(spark: SparkSession, path: str) -> tuple[int, DataFrame | None]:
    """Number and rows of the last whole snapshot: one that has as many rows as it says."""
    held = _found(spark, f"{path}/snapshots")
    if held is None:
        return 0, None
    whole = held.groupBy("version").agg(F.count("*").alias("n"), F.max("n_rows").alias("said")).filter("n = said").agg(F.max("version")).first()[0]
    return (0, None) if whole is None else (whole, held.filter(F.col("version") == whole))


def _parts(spark: SparkSession, path: str) -> tuple[int, DataFrame, list[str]]:
    """Number of the last snapshot, partial states of all jobs, and the event files that are among them."""
    version, held = _snapshot(spark, path)
    covered = [] if held is None else [r.file for r in held.filter("file is not null").select("file").collect()]
    recorded = _found(spark, f"{path}/events", EVENTS)
    # names of files only, as Spark lists them to read them
    fresh = [] if recorded is None else sorted(set(recorded.inputFiles()) - set(covered))
    parts = jobs.partial(spark.read.schema(EVENTS).parquet(*fresh) if fresh else spark.createDataFrame([], EVENTS))
    if held is not None:
        parts = jobs.merged(parts.unionByName(held.filter("file is null").select(*parts.columns)))
    return version, parts, covered + fresh


def states(spark: SparkSession, path: str) -> DataFrame:
    """The state of each job that was created: the last snapshot and the events since."""
    return jobs.finished(_parts(spark, path)[1])


def compact(spark: SparkSession, path: str) -> int:
    """Write a new snapshot and return its number; event files that it covers are not read again and may be deleted.

    One compaction runs at a time; events may be recorded meanwhile.
    """
    version, parts, files = _parts(spark, path)
    names = spark.createDataFrame([(f,) for f in files], "file string")
    rows = parts.withColumn("file", F.lit(None).cast("string")).unionByName(names, allowMissingColumns=True).persist()
    rows.withColumn("n_rows", F.lit(rows.count())).write.mode("overwrite").parquet(f"{path}/snapshots/version={version + 1}")
    rows.unpersist()
    return version + 1
