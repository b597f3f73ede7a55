"""The corpus pipeline: five stages, each calling one training-data operator.

Every stage is a function of ``(spark, docs, sf_dir)``; its result is written as
Parquet and read again as the next one's ``docs``.  All but the last return the
columns of ``documents``, whatever else these are called and hold.

Defined results of the stages
  * ``language_id``: a null or empty text, and one without a letter, goes; so does every
    document where nothing is labelled with a language.  Repeated rows stay.
  * ``exact_dedup``: one row stays of each text, white space aside: that of the least
    ``doc_id``, null last; rows equal in id and text are one row.
  * ``near_dedup``: one row stays of each group; of rows equal in id and text all or none.
  * ``mixing``: a row for each pass that takes words of a document; null is a source of its
    own; texts without words are never taken.
  * ``encoding``: ids and text of every row.
An empty table passes through every stage as an empty one; very long texts are read whole.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession, functions as F

from docspark.llm import bpe, exact, language, mixing, near
from docspark.llm.common import settle


def language_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose language is known stay; those without a letter, for which it is ``und``, go."""
    rest = F.struct(F.lit(0).alias("__none"), *[F.col(f"`{c}`") for c in docs.columns if c != "text"])
    named = language.identify(docs.select(rest.alias("rest"), "text"), keep=("rest", "text"), sample=language.training_sample(docs))
    return named.filter("lang_pred <> 'und'").select(*[F.col("text") if c == "text" else F.col(f"rest.`{c}`") for c in docs.columns])


def _rows_of(docs: DataFrame, key, kept: DataFrame) -> DataFrame:
    """``(key, row)`` of the rows whose ``doc_id`` and key are among ``kept``, a table ``(doc_id, key)``."""
    held = kept.select(F.col("doc_id").alias("kept_id"), F.col("key").alias("kept_key"))
    rows = docs.select(key.alias("key"), F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"))
    return rows.join(held, F.col("row.doc_id").eqNullSafe(F.col("kept_id")) & (F.col("key") == F.col("kept_key")), "left_semi")


def exact_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of equal texts the document with the smallest id stays."""
    kept = exact.duplicates(docs).filter("kept").select("doc_id", F.unhex("text_sha256").alias("key"), "copies")
    kept = settle(kept, "exact_kept")
    key = F.unhex(F.sha2(exact.normalised(F.col("text")), 256))
    # only rows that repeat both id and text must still be told apart
    once = _rows_of(docs, key, kept.filter("copies = 1"))
    more = _rows_of(docs, key, kept.filter("copies > 1")).groupBy("key").agg(F.first("row").alias("row"))
    return once.unionByName(more).select("row.*")


def near_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near copies (five-word shingles, similarity 0.8 or more, by SimHash, then by bands) the document with the smallest id stays."""
    # a table has a known size: Spark broadcasts the ids only below its threshold, and texts are shuffled only beyond it
    kept = settle(near.kept(docs).select("doc_id", F.col("node").alias("key")), "near_kept")
    return _rows_of(docs, near.text_node(), kept).select("row.*")


def mixing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The mix of the sources: the taken words of each document, a row for each pass over it."""
    return mixing.assembled(docs)


def encoding_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids (packed, little-endian) and the text decoded from them."""
    coded = bpe.encode(docs, public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN, keep=("doc_id", "lang", "source"))
    return coded.select("doc_id", "lang", "source", "ids", (F.octet_length("ids") / 4).cast("long").alias("n_tokens"), F.col("decoded").cast("string").alias("decoded"))


STAGES = [
    ("language_id", language_stage),
    ("exact_dedup", exact_stage),
    ("near_dedup", near_stage),
    ("mixing", mixing_stage),
    ("encoding", encoding_stage),
]

#: Language identification and the mix are not SQL; tests hold stages and run() to plain versions.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = settle(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
