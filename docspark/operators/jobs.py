"""The ledger of jobs: events are appended, states are derived."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

STATUS = {"created": "pending", "processing": "processing", "completed": "completed", "failed": "failed"}


def append(events: DataFrame, path: str) -> None:
    events.write.mode("append").parquet(path)


def job_id(path: Column, length: Column, changed: Column) -> Column:
    """Deterministic, so a file that is seen twice is one job."""
    return F.sha2(F.concat_ws("|", path, length.cast("string"), changed.cast("string")), 256)


def partial(events: DataFrame) -> DataFrame:
    """What the events say of each job: the first and last time, and the latest write of each column with its number."""
    made, seq = F.col("kind") == "created", F.col("seq")
    status = F.expr("case kind when 'created' then 'pending' when 'processing' then 'processing' when 'completed' then 'completed' when 'failed' then 'failed' end")
    last = lambda when, *values: F.max(F.when(when, F.struct(seq, *values)))
    return events.groupBy("job_id").agg(
        F.min(F.when(made, F.col("ts"))).alias("created_at"), F.max("ts").alias("updated_at"), last(status.isNotNull(), status.alias("status")).alias("status"),
        last(F.col("kind") == "progress", "translated_blocks", "total_blocks").alias("progress"), last(F.col("kind") == "completed", "output_path").alias("output"), last(F.col("kind") == "failed", "error_message").alias("failure"),
    )


def merged(partials: DataFrame) -> DataFrame:
    """Partial states of the same jobs put together; in any order, and any of them twice."""
    return partials.groupBy("job_id").agg(F.min("created_at").alias("created_at"), *[F.max(c).alias(c) for c in ("updated_at", "status", "progress", "output", "failure")])


def finished(partials: DataFrame) -> DataFrame:
    """The states of the jobs that were created."""
    return partials.filter("created_at is not null").select("job_id", "created_at", "updated_at", "status.status", "progress.translated_blocks", "progress.total_blocks", "output.output_path", "failure.error_message")


def states(events: DataFrame) -> DataFrame:
    """A row per job that was created: each column takes its own latest write."""
    return finished(partial(events))


def view(state_rows: DataFrame) -> DataFrame:
    """What is shown of a job: an error only if it failed, percent and stage of progress."""
    t, n, status = F.col("translated_blocks"), F.col("total_blocks"), F.col("status")
    percent = F.when(status == "completed", 100).when(n.isNull() | (n == 0), 0).otherwise(F.least(F.lit(99), F.floor(F.coalesce(t, F.lit(0)) / n * 100).cast("int")))
    stage = F.when((status == "processing") & (n > 0), F.when(t < n, "translating").otherwise("rebuilding")).otherwise("reading")
    return state_rows.select("job_id", "status", "translated_blocks", "total_blocks", F.when(status == "failed", F.col("error_message")).alias("error"), percent.cast("int").alias("percent"), stage.alias("stage"))


def trail(answered: DataFrame) -> DataFrame:
    """``(doc_id, step, translated_blocks, total_blocks)``: from 0 on, after each chunk, up to the first that failed."""
    w = Window.partitionBy("doc_id").orderBy("chunk_seq").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    rows = answered.select("doc_id", "chunk_seq", "n_blocks", F.sum("n_blocks").over(w).alias("translated_blocks"), F.max(F.col("error").isNotNull().cast("int")).over(w).alias("stopped"), F.sum("n_blocks").over(Window.partitionBy("doc_id")).alias("total_blocks"))
    after = rows.filter("stopped = 0").select("doc_id", (F.col("chunk_seq") + 1).alias("step"), "translated_blocks", "total_blocks")
    start = rows.filter("chunk_seq = 0").select("doc_id", F.lit(0).alias("step"), F.lit(0).cast("long").alias("translated_blocks"), "total_blocks")
    return start.unionByName(after)
