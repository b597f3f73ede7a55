"""Running a translator over requests, and handing answers back to blocks."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, functions as F

from docspark.functions.text import answer_parts, strip


def translate(requests: DataFrame, factory: Callable, key: list[str], terms: str | None = None) -> DataFrame:
    """``key`` and ``text, input_tokens, output_tokens, error`` of each request.

    ``factory()`` opens a translator once a task; it has ``translate(text, context)``,
    which returns a text and two token counts, and ``close()``.  Where ``terms`` names a
    column of ``(term, translation)`` structs, the translator is called with a third
    argument, their dictionary, or None where a request has none; requests whose context
    tells the terms already need it not.  Texts come back without white space around
    them.  An exception becomes the row's ``error``.
    """
    kept = requests.select(*key, "request_text", "request_context", *([F.col(terms).alias("__terms")] if terms else []))
    kinds = dict(kept.dtypes)
    schema = ", ".join([f"{k} {kinds[k]}" for k in key] + ["text string", "input_tokens int", "output_tokens int", "error string"])

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        client = factory()
        try:
            for batch in batches:
                rows = []
                told = [({t["term"]: t["translation"] for t in x} if x is not None and len(x) else None,) for x in batch["__terms"]] if terms else [()] * len(batch)
                for text, context, more in zip(batch["request_text"], batch["request_context"], told):
                    try:
                        answer, n_in, n_out = client.translate(text, context, *more)
                        rows.append((answer.strip(), n_in, n_out, None))
                    except Exception as e:  # an answer that fails is data: it fails its document
                        rows.append((None, None, None, str(e) or type(e).__name__))
                out = pd.DataFrame(rows, columns=["text", "input_tokens", "output_tokens", "error"], index=batch.index)
                out["input_tokens"], out["output_tokens"] = out["input_tokens"].astype("Int32"), out["output_tokens"].astype("Int32")
                yield pd.concat([batch[key], out], axis=1)
        finally:
            client.close()

    return kept.mapInPandas(run, schema)


def parts_fit(n_blocks: Column, answer: Column) -> Column:
    return (n_blocks == 1) | (F.size(answer_parts(answer)) == n_blocks)


def placed(n_blocks: Column, answer: Column) -> Column:
    """The translated text of each block of a chunk.

    An answer of as many parts as blocks goes to them by place; any other goes to the
    first block whole and leaves the rest blank.
    """
    parts = answer_parts(answer)
    whole = F.concat(F.array(strip(answer)), F.array_repeat(F.lit(""), n_blocks - 1))
    return F.when(n_blocks == 1, F.array(answer)).when(F.size(parts) == n_blocks, parts).otherwise(whole)


def apply_answers(answered: DataFrame, answer: str = "answer") -> DataFrame:
    """A row per block: the ``doc_id`` and ``chapter_index`` of its chunk, what ``blocks`` tells of it, and ``translated_text``."""
    rows = answered.withColumn("translated_text", placed(F.col("n_blocks"), F.col(answer)))
    rows = rows.select("doc_id", "chapter_index", F.explode(F.arrays_zip("blocks", "translated_text")).alias("b"))
    return rows.select("doc_id", "chapter_index", "b.blocks.*", "b.translated_text")


def failed(answered: DataFrame) -> DataFrame:
    """Documents with a failing chunk, and the error of the first."""
    wrong = answered.filter("error is not null")
    return wrong.groupBy("doc_id").agg(F.min_by("error", "chunk_seq").alias("error_message"), F.min("chunk_seq").alias("failed_seq"))


def usage(answered: DataFrame) -> DataFrame:
    return answered.groupBy("doc_id").agg(F.sum("input_tokens").alias("input_tokens"), F.sum("output_tokens").alias("output_tokens"))
