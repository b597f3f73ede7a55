"""From files to translated files: every new file is a job, worked on in micro-batches that may be run again.

A batch writes four things, each into a place of its own that it replaces if it runs again: rejected files with their
reasons, outputs, the events of its jobs, and (in the store of answers) what translators were told.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, functions as F

from docspark.operators import files, jobs, ledger
from docspark.plans import translate
from docspark.plans.scratch import settle
from docspark.sources import txt

#: The columns of Spark's source of binary files.
FILES = "path string, modificationTime timestamp, length long, content binary"


def _outcomes(accepted: DataFrame, factory: Callable, store: str, **how) -> DataFrame:
    """``(doc_id, output, status, error_message)`` of accepted text files and books; output in bytes."""
    texts = accepted.filter("format = 'txt'").select("doc_id", txt.decoded(F.col("content")).alias("d")).select("doc_id", "d.text", "d.error")
    texts = settle(texts, "decoded")
    budget = {k: how[k] for k in ("max_tokens", "context_chars") if k in how}
    answered = translate.answers(translate.requests(texts.filter("error is null"), how.get("glossary"), **budget), factory, store, how.get("translator", ""))
    unread = texts.filter("error is not null").select("doc_id", F.lit(None).cast("string").alias("output"), F.lit("failed").alias("status"), F.col("error").alias("error_message"))
    of_texts = translate.translated(texts.filter("error is null"), answered).unionByName(unread).withColumn("output", F.col("output").cast("binary"))
    books = accepted.filter("format = 'epub'").select("doc_id", "content")
    return of_texts.unionByName(translate.translated_epubs(books, factory, store=store, **how))


def process(batch: DataFrame, number: int, base: str, factory: Callable, max_size: int = files.MAX_SIZE, **how) -> None:
    """Work on the files of one batch, rows of ``FILES``."""
    spark = batch.sparkSession
    rows = batch.withColumn("job_id", jobs.job_id(F.col("path"), F.col("length"), F.unix_micros("modificationTime"))).dropDuplicates(["job_id"])
    # numbers are given once, in a table, so that every use of a row sees the same
    rows = settle(rows.withColumn("doc_id", F.monotonically_increasing_id()).withColumn("name", F.substring_index("path", "/", -1)), "files")
    checked = files.checked(rows, max_size).withColumn("reason", F.coalesce("reason", F.when(F.col("format") == "pdf", "layout")))
    refused = checked.filter("reason is not null").select("job_id", "path", "length", "reason", "modificationTime")
    refused.write.mode("overwrite").parquet(f"{base}/quarantine/batch={number}")
    accepted = checked.filter("reason is null")
    outcomes = settle(_outcomes(accepted, factory, f"{base}/answers", **how), "outcomes")
    told = accepted.select("doc_id", "job_id", "format", "modificationTime", F.col("name").alias("original_filename")).join(outcomes, "doc_id")
    named = files.output_names(told, spark).withColumn("output_path", F.concat_ws("/", F.lit(f"{base}/outputs"), "job_id", "output_name"))
    named.filter("status = 'completed'").select("job_id", "output_path", "download_name", "media_type", "output").write.mode("overwrite").parquet(f"{base}/outputs/batch={number}")
    # the last event of a job comes after the others by its number; times are those of the files, the same whenever a batch runs
    begun = [("created", 1), ("processing", 2)]
    steps = F.explode(F.array(*[F.struct(F.lit(k).alias("kind"), F.lit(n).cast("long").alias("seq")) for k, n in begun]))
    events = accepted.select("job_id", F.col("modificationTime").alias("ts"), steps.alias("e")).select("job_id", "ts", "e.*")
    ended = named.select("job_id", F.col("modificationTime").alias("ts"), F.col("status").alias("kind"), F.lit(3).cast("long").alias("seq"), F.when(F.col("status") == "completed", F.col("output_path")).alias("output_path"), "error_message")
    ledger.record(events.unionByName(ended, allowMissingColumns=True), f"{base}/ledger", str(number))


def run(source: DataFrame, base: str, factory: Callable, **how):
    """Work on every file that is new in the stream ``source`` (rows of ``FILES``), then stop; batches count in ``base/checkpoint``."""
    work = lambda batch, number: process(batch, number, base, factory, **how)
    query = source.writeStream.foreachBatch(work).option("checkpointLocation", f"{base}/checkpoint").trigger(availableNow=True).start()
    query.awaitTermination()
    return query


def folder(spark: SparkSession, path: str, files_per_batch: int = 1000) -> DataFrame:
    """The files of a folder as a stream; Spark's sources of files leave out empty ones, which ``table`` does not."""
    return spark.readStream.format("binaryFile").schema(FILES).option("maxFilesPerTrigger", files_per_batch).load(path)


def table(spark: SparkSession, path: str, parts_per_batch: int = 1000) -> DataFrame:
    """The same of files that are rows of a Parquet table."""
    return spark.readStream.schema(FILES).option("maxFilesPerTrigger", parts_per_batch).parquet(path)
