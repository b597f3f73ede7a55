"""End to end: a corpus of texts or books to requests, answers and rebuilt documents."""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, Window, functions as F

from docspark.operators import chunking, glossary as terms, rebuild, translation
from docspark.plans.scratch import emptied, settle, settled, shared_dir, swept, written
from docspark.sources import epub, html, txt

KEY = ["doc_id", "chapter_index", "chunk_index"]


def block_requests(blocks: DataFrame, glossary: DataFrame | None = None, max_tokens: int = chunking.MAX_TOKENS, context_chars: int = chunking.CONTEXT_CHARS) -> DataFrame:
    """Every request of a corpus: contexts come from source texts, so none waits for another's answer."""
    made = chunking.chunks(chunking.pack(blocks, max_tokens), max_tokens, context_chars)
    return chunking.requests(terms.with_terms(made, glossary, KEY) if glossary is not None else made)


def chapter_requests(chapters: DataFrame, glossary: DataFrame | None = None, max_tokens: int = chunking.MAX_TOKENS, context_chars: int = chunking.CONTEXT_CHARS) -> DataFrame:
    """The same of chapters that come as rows with their blocks.  A text is in a request once: blocks keep their order and id."""
    made = chunking.chunk_rows(chapters, max_tokens, context_chars)
    rows = chunking.requests(terms.with_terms(made, glossary, KEY) if glossary is not None else made)
    return rows.drop("chunk_text").withColumn("blocks", F.transform("blocks", lambda b: F.struct(b["block_order"], b["block_id"])))


def requests(docs: DataFrame, glossary: DataFrame | None = None, max_tokens: int = chunking.MAX_TOKENS, context_chars: int = chunking.CONTEXT_CHARS) -> DataFrame:
    return chapter_requests(txt.chapters(docs), glossary, max_tokens, context_chars)


#: What a store of answers holds: by digest of the request, of which run, and what came of it.
ANSWERS = "digest string, run string, text string, input_tokens int, output_tokens int, error string"
#: Requests that one task asks; what it was told is kept as soon as it ends.
TASK_REQUESTS = 500


def answers(request_rows: DataFrame, factory: Callable, store: str | None = None, translator: str = "") -> DataFrame:
    """Requests with their answers, without what was asked.  A translator costs: equal requests are asked once, and none that ``store`` answers.

    ``store`` is a folder that keeps answers between runs, by digest of ``translator`` (its name and version) and request.
    Each task's answers are added to it when that task ends, whatever becomes of the others; so a run that is broken off and
    repeated asks again only what its unfinished tasks had asked.  Errors are kept too, but asked again by the next run.

    Texts of requests lie on disk until they are answered, answers of a run without a store until they are with their requests.
    """
    return _answers(request_rows, factory, store, translator)[1]


def _answers(request_rows: DataFrame, factory: Callable, store: str | None, translator: str) -> tuple[str, DataFrame]:
    """The answers, and the folder they are in."""
    spark, fresh = request_rows.sparkSession, store is None
    store, run = store or f"{shared_dir(spark).rstrip('/')}/answers-{uuid.uuid4().hex}", uuid.uuid4().hex
    digest = F.sha2(F.to_json(F.struct(F.lit(translator).alias("translator"), "request_text", "request_context")), 256)
    with settled(request_rows.drop("chunk_text", "context", "terms").withColumn("digest", digest), "requests") as rows:
        spark.createDataFrame([], ANSWERS).coalesce(1).write.mode("append").parquet(store)
        held = spark.read.schema(ANSWERS).parquet(store)
        known = held.filter("error is null").select("digest").distinct()
        # texts are brought together once: equal requests meet in the task that asks
        tasks = -(-rows.select("digest").distinct().join(known, "digest", "left_anti").count() // TASK_REQUESTS)
        if tasks:
            asked = rows.select("digest", "request_text", "request_context", F.xxhash64("digest").alias("place")).join(known, "digest", "left_anti")
            told = translation.translate(asked.repartition(tasks, "place").dropDuplicates(["place", "digest"]), factory, ["digest"]).withColumn("run", F.lit(run))
            with swept(spark):
                # this way of committing makes the files of a task final with the task, not with the job
                told.select(*held.columns).write.mode("append").option("compression", "zstd").option("mapreduce.fileoutputcommitter.algorithm.version", "2").parquet(store)
        rows = settle(rows.drop("request_text", "request_context"), "asked")
    # tasks that ran twice, and runs at the same time, may answer twice: one answer counts, the first by file and row
    fit = spark.read.schema(ANSWERS).parquet(store).select("*", "_metadata.file_path", "_metadata.row_index").filter(F.col("error").isNull() | (F.col("run") == run))
    if not fresh:
        fit = fit.join(rows.select("digest"), "digest", "left_semi")
    order = Window.partitionBy("digest").orderBy(F.col("error").isNotNull(), "file_path", "row_index")
    given = fit.withColumn("first", F.row_number().over(order) == 1).filter("first").select("digest", F.col("text").alias("answer"), "input_tokens", "output_tokens", "error")
    path, answered = written(rows.join(given, "digest").drop("digest"), "answered")
    if fresh:
        emptied(spark, store, ANSWERS)
    return path, answered


def _told(rows: DataFrame, bad: DataFrame) -> DataFrame:
    """``(doc_id, output, status, error_message)``: a document that failed has no output."""
    wrong = F.col("error_message").isNotNull()
    return rows.join(bad, "doc_id", "left").select("doc_id", F.when(~wrong, F.col("output")).alias("output"), F.when(wrong, "failed").otherwise("completed").alias("status"), "error_message")


def translated(docs: DataFrame, answered: DataFrame) -> DataFrame:
    """``(doc_id, output, status, error_message)`` of every document; one failing chunk fails its document whole."""
    bad = translation.failed(answered).select("doc_id", "error_message")
    texts = F.array_join(translation.placed(F.col("n_blocks"), F.col("answer")), "\n\n").alias("translated_text")
    pieces = answered.select("doc_id", "chapter_index", F.col("chunk_index").alias("block_order"), F.lit(None).cast("string").alias("text"), texts)
    return _told(rebuild.text(docs, pieces), bad)


def translated_epubs(files: DataFrame, factory: Callable, glossary: DataFrame | None = None, max_tokens: int = chunking.MAX_TOKENS, context_chars: int = chunking.CONTEXT_CHARS, store: str | None = None, translator: str = "") -> DataFrame:
    """``(doc_id, output, status, error_message)`` of ``(doc_id, content)`` archives; answers as in ``answers``.

    An archive that cannot be read, a chunk that fails or a chapter that cannot be
    rendered fails its book whole and no other; nothing partial is given out.
    """
    opened = settle(epub.entries(files), "epub-entries")
    chapter_rows = epub.chapters(opened)
    told, answered = _answers(chapter_requests(html.chapters(chapter_rows), glossary, max_tokens, context_chars), factory, store, translator)
    parts = F.array_sort(F.collect_list(F.struct("chunk_index", translation.placed(F.col("n_blocks"), F.col("answer")).alias("texts"))))
    texts = answered.filter("error is null").groupBy("doc_id", "chapter_index").agg(parts.alias("parts"))
    rendered = settle(epub.render_texts(chapter_rows, texts.select("doc_id", "chapter_index", F.flatten("parts.texts").alias("texts"))), "epub-rendered")
    missing = epub.missing_entries(opened, rendered)
    # of several errors the first kind counts: reading, translating, rendering
    kinds = [
        epub.failed(opened),
        translation.failed(answered).select("doc_id", "error_message"),
        rendered.filter("error is not null").groupBy("doc_id").agg(F.min_by("error", "name").alias("error_message")),
        missing.select("doc_id", F.concat(F.lit("missing entries: "), F.array_join("missing", ", ")).alias("error_message")),
    ]
    every = kinds[0].withColumn("kind", F.lit(0))
    for n, more in enumerate(kinds[1:], 1):
        every = every.unionByName(more.withColumn("kind", F.lit(n)))
    bad = settle(every.groupBy("doc_id").agg(F.min_by("error_message", "kind").alias("error_message")), "epub-failed")
    emptied(opened.sparkSession, told, answered.schema)  # what was answered is in the chapters now
    packed = epub.pack(epub.merge_entries(opened.join(bad, "doc_id", "left_anti"), rendered))
    # every archive has an entry or an error
    return _told(opened.select("doc_id").distinct().join(packed, "doc_id", "left"), bad)
