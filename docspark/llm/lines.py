"""Operator 8: line deduplication by content-defined chunks of lines.

A rolling hash over the hashes of two lines in a row closes a chunk of these lines wherever it is
not greater than at both neighbours: a place that depends on the lines beside it only, so equal
passages are cut alike wherever they stand in a document.  Of any two neighbouring hashes the lesser
one closes a chunk, so three lines that occur again hold a chunk that occurs again, whatever
stands around them.  A chunk that occurs again anywhere is removed, but for its first occurrence (least
``doc_id``, then text, then position), after its bytes were compared with those of the first;
from there the repeat is followed by one line to either side, bytes compared, which takes it to
its edges.

At scale: hashes of chunks are counted before texts move; only documents with a chunk
whose hash occurs again are opened for the comparison; every join is keyed by a hash or
a document, and the row side of a frequent chunk may be split by Spark, the other side
being one row per hash.

Defined results: a null or empty text is one empty line and stays empty; a chunk
that repeats within its document is removed there too; rows are told apart by
``doc_id`` and text, so of rows that share an id, or have none, each loses only its own
lines; rows equal in both are one document and keep the same lines; a null ``doc_id``
sorts last; further columns are not read.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from docspark.llm.common import settle, text_bytes

#: Lines of a chunk, and those to either side of it that may go with it.
CHUNK, BESIDE = 2, 1
KEY = ["doc_id", "digest"]


def _let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body(value)`` with ``value`` computed once, however often the body, or a lambda in it, uses it."""
    return F.transform(F.array(value), body)[0]


def _lines() -> Column:
    return F.split(F.coalesce("text", F.lit("")), "\n", -1)


def _keyed(docs: DataFrame) -> DataFrame:
    return docs.select("doc_id", F.xxhash64(text_bytes("text"), F.octet_length(text_bytes("text"))).alias("digest"), "text")


def _part(lines: Column, first: Column, end: Column) -> Column:
    return F.slice(lines, first + 1, end - first)


def chunks(docs: DataFrame) -> DataFrame:
    """``(doc_id, digest, first, hash)`` of every chunk that is not blank: lines ``first`` to ``first + CHUNK``."""

    def closed(rolled: Column) -> Column:
        # a missing neighbour is none that could be greater; the only hash of two lines closes a chunk
        less = lambda i, k: F.coalesce(F.get(rolled, i) <= F.get(rolled, k), F.size(rolled) == 1)
        at = F.filter(F.sequence(F.lit(0), F.size(rolled) - 1), lambda i: less(i, i - 1) | less(i, i + 1))
        return F.when(F.size(rolled) > 0, F.transform(at, lambda i: F.struct(i.alias("first"), F.get(rolled, i).alias("hash"))))

    def rolled(lines: Column) -> Column:
        # a blank line has no hash, so that chunks of blank lines are told apart
        hashes = F.transform(lines, lambda x: F.when(x.rlike(r"[^\x20\x09-\x0D]"), F.xxhash64(x, F.octet_length(x))))
        pair = lambda h: F.transform(F.sequence(F.lit(0), F.size(h) - CHUNK), lambda i: F.xxhash64(*[F.coalesce(F.get(h, i + k), F.lit(0)) for k in range(CHUNK)]))
        blank = lambda h, i: F.coalesce(*[F.get(h, i + k) for k in range(CHUNK)]).isNull()
        made = lambda h: F.filter(_let(pair(h), closed), lambda c: ~blank(h, c["first"]))
        return F.when(F.size(lines) >= CHUNK, _let(hashes, made))

    rows = _keyed(docs).select(*KEY, F.explode(_let(_lines(), rolled)).alias("c"))
    return rows.select(*KEY, "c.first", "c.hash")


def _same(x: Column, y: Column) -> Column:
    """How many lines of two arrays agree from the start on."""
    n = F.least(F.size(x), F.size(y))
    differ = F.filter(F.sequence(F.lit(0), n), lambda i: (i == n) | (F.get(x, i) != F.get(y, i)))
    return F.get(differ, F.lit(0))


def repeated(docs: DataFrame) -> DataFrame:
    """``(doc_id, digest, gone)``: of each document that loses any the numbers of its removed lines, in order."""
    rows = settle(chunks(docs).distinct(), "chunk-hashes")
    at = F.struct(F.col("doc_id").isNull().alias("unknown"), *KEY, "first")
    held = settle(rows.groupBy("hash").agg(F.count("*").alias("n"), F.min(at).alias("of")).filter("n > 1"), "chunk-firsts")
    again = rows.join(held.hint("merge"), "hash").select(*KEY, F.struct("hash", "first", (F.col("of") == at).alias("is_first")).alias("c"))
    marks = settle(again.groupBy(*KEY).agg(F.collect_list("c").alias("chunks")).withColumnsRenamed({"doc_id": "__id", "digest": "__digest"}), "chunk-marks")
    # rows equal in id and text are one document: one of them is opened
    texts = _keyed(docs).join(marks.hint("merge"), F.col("doc_id").eqNullSafe(F.col("__id")) & (F.col("digest") == F.col("__digest"))).select(*KEY, "chunks", "text")
    def cut(lines: Column) -> Column:
        end = lambda c: c["first"] + CHUNK
        return F.transform("chunks", lambda c: F.struct(
            c["hash"].alias("hash"), c["is_first"].alias("is_first"), c["first"].alias("first"), _part(lines, c["first"], end(c)).alias("own"),
            F.reverse(_part(lines, F.greatest(F.lit(0), c["first"] - BESIDE), c["first"])).alias("before"), _part(lines, end(c), end(c) + BESIDE).alias("after"),
        ))

    # chunks are cut out before they become rows, so that no row holds a whole text
    opened = texts.select(*KEY, F.explode(_let(_lines(), cut)).alias("c")).select(*KEY, "c.*")
    opened = settle(opened, "chunks")
    one = settle(opened.filter("is_first").groupBy("hash").agg(F.min(F.struct("own", "before", "after")).alias("kept")), "first-chunks")
    same = opened.filter("not is_first").join(one, "hash").filter(F.col("own") == F.col("kept.own"))
    low, high = F.col("first") - _same(F.col("before"), F.col("kept.before")), F.col("first") + CHUNK + _same(F.col("after"), F.col("kept.after"))
    return same.select(*KEY, F.sequence(low, high - 1).alias("gone")).groupBy(*KEY).agg(F.array_sort(F.array_distinct(F.flatten(F.collect_list("gone")))).alias("gone"))


def deduplicated(docs: DataFrame) -> DataFrame:
    """``(doc_id, n_lines, removed_lines, removed, text)``: ``removed`` lists the removed lines as ``first:end``, end exclusive."""
    gone = settle(repeated(docs), "gone-lines").withColumnsRenamed({"doc_id": "__id", "digest": "__digest"})
    rows = _keyed(docs).join(gone.hint("merge"), F.col("doc_id").eqNullSafe(F.col("__id")) & (F.col("digest") == F.col("__digest")), "left")
    rows = rows.select("doc_id", _lines().alias("lines"), F.coalesce("gone", F.expr("cast(array() as array<int>)")).alias("gone"))
    n = F.size("gone")
    at = F.when(n > 0, F.sequence(F.lit(0), n - 1)).otherwise(F.expr("cast(array() as array<int>)"))
    opens = F.filter(at, lambda k: (k == 0) | (F.get("gone", k) - F.get("gone", k - 1) > 1))
    closes = F.filter(at, lambda k: (k == n - 1) | (F.get("gone", k + 1) - F.get("gone", k) > 1))
    spans = F.transform(F.arrays_zip(opens.alias("o"), closes.alias("c")), lambda s: F.concat_ws(":", F.get("gone", s["o"]).cast("string"), (F.get("gone", s["c"]) + 1).cast("string")))
    left = F.array_except(F.sequence(F.lit(0), F.size("lines") - 1), F.col("gone"))
    kept = F.when(n == 0, F.col("lines")).otherwise(F.transform(left, lambda i: F.get("lines", i)))
    return rows.select("doc_id", F.size("lines").cast("long").alias("n_lines"), n.cast("long").alias("removed_lines"), F.array_join(spans, ",").alias("removed"), F.array_join(kept, "\n").alias("text"))


def op8_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    return deduplicated(spark.read.parquet(f"{sf_dir}/documents.parquet"))
