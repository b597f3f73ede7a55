"""Live states of jobs whose state is let go some time after they end."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame, functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from docspark.operators import jobs

#: What is held of a job: times in microseconds, then the latest write of each column behind its number.
_HELD = "created long, updated long, status_seq long, status string, progress_seq long, translated_blocks int, total_blocks int, output_seq long, output_path string, failure_seq long, error_message string"
_NAMES = [f.split(" ")[0] for f in _HELD.split(", ")]


def _later(held: dict, seq: int, number: str, **values) -> None:
    if held[number] is None or seq >= held[number]:
        held.update(values, **{number: seq})


def _with(held: dict, event) -> None:
    """``held`` with one event more: the rules of ``jobs.partial``, one event at a time."""
    bare = lambda v: None if pd.isna(v) else v
    at, seq, kind = event.ts.value // 1000, int(event.seq), event.kind
    held["updated"] = at if held["updated"] is None else max(at, held["updated"])
    if kind == "created":
        held["created"] = at if held["created"] is None else min(at, held["created"])
    if kind in jobs.STATUS:
        _later(held, seq, "status_seq", status=jobs.STATUS[kind])
    if kind == "progress":
        number = lambda v: None if pd.isna(v) else int(v)
        _later(held, seq, "progress_seq", translated_blocks=number(event.translated_blocks), total_blocks=number(event.total_blocks))
    elif kind == "completed":
        _later(held, seq, "output_seq", output_path=bare(event.output_path))
    elif kind == "failed":
        _later(held, seq, "failure_seq", error_message=bare(event.error_message))


def expiring_states(events: DataFrame, work: Callable[[DataFrame, int], None], checkpoint: str, keep_ms: int = 3_600_000):
    """A streaming query that hands partial states (as ``jobs.partial`` makes them) of jobs with new events to ``work``.

    A job that has ended is held for ``keep_ms`` more, so what is held are the jobs at work.  An event that comes later still
    makes a partial state of its own; whoever keeps the table puts partial states together by ``jobs.merged``, so nothing is lost.
    """

    def update(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            state.remove()
            return
        held = dict(zip(_NAMES, state.get)) if state.exists else dict.fromkeys(_NAMES)
        for batch in batches:
            for event in batch.itertuples(index=False):
                _with(held, event)
        state.update(tuple(held.values()))
        if held["status"] in ("completed", "failed"):
            state.setTimeoutDuration(keep_ms)
        yield pd.DataFrame([(*key, *held.values())], columns=["job_id", *_NAMES], dtype=object)

    kind = dict(events.dtypes)["job_id"]
    found = events.groupBy("job_id").applyInPandasWithState(update, f"job_id {kind}, {_HELD}", _HELD, "update", GroupStateTimeout.ProcessingTimeTimeout)
    part = lambda number, *values: F.when(F.col(number).isNotNull(), F.struct(F.col(number).alias("seq"), *values))
    partial = found.select(
        "job_id", F.timestamp_micros("created").alias("created_at"), F.timestamp_micros("updated").alias("updated_at"), part("status_seq", "status").alias("status"),
        part("progress_seq", "translated_blocks", "total_blocks").alias("progress"), part("output_seq", "output_path").alias("output"), part("failure_seq", "error_message").alias("failure"),
    )
    # a state that may time out would ask for one empty batch after another, and the query would never stop
    conf, name = events.sparkSession.conf, "spark.sql.streaming.noDataMicroBatches.enabled"
    before = conf.get(name)
    conf.set(name, "false")
    try:
        return partial.writeStream.outputMode("update").foreachBatch(work).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    finally:
        conf.set(name, before)
