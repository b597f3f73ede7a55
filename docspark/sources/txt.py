"""Plain-text sources: decoding bytes and cutting texts into blocks."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, functions as F
from pyspark.sql.types import StringType

from docspark.functions.text import paragraphs


#: A text in which more of the characters are controls fits no encoding.
MOST_CONTROLS = 0.2
NO_ENCODING = "no encoding fits"
# The bytes that ISO 8859-15 reads as letters and ISO 8859-1 as signs.
_LETTERS_OF_15 = b"\xa6\xa8\xb4\xb8\xbc\xbd\xbe"


def decode_other(raw: bytes) -> str | None:
    """Bytes that are no UTF-8, as cp1252, ISO 8859-15 or ISO 8859-1; None if none fits.

    cp1252 where all bytes have a meaning in it; else ISO 8859-15 where a byte that is a
    letter only there stands beside a letter, ISO 8859-1 otherwise.
    """
    try:
        text = raw.decode("cp1252")
    except UnicodeDecodeError:
        latin = raw.decode("iso8859_15")
        inside = any(raw[i] in _LETTERS_OF_15 and (latin[i - 1 : i].isalpha() or latin[i + 1 : i + 2].isalpha()) for i in range(len(raw)))
        text = latin if inside else raw.decode("iso8859_1")
    controls = sum(c < " " and c not in "\t\n\r\f\v" or "\x7f" <= c < "\xa0" for c in text)
    return None if controls > MOST_CONTROLS * len(text) else text


@F.pandas_udf(StringType())
def _decode_other(contents: Iterator[pd.Series]) -> Iterator[pd.Series]:
    for batch in contents:
        yield batch.map(lambda raw: None if raw is None else decode_other(raw))


def decoded(content: Column) -> Column:
    """``struct(text, error)``: UTF-8 without its mark; only other rows reach the helper."""
    plain = F.call_function("is_valid_utf8", content.cast("string"))
    text = F.when(plain, content.cast("string")).otherwise(_decode_other(F.when(~plain, content)))
    error = F.when(content.isNotNull() & text.isNull(), NO_ENCODING)
    return F.struct(F.regexp_replace(text, "^﻿", "").alias("text"), error.alias("error"))


def decode(content: Column) -> Column:
    return decoded(content)["text"]


def read_files(spark, path: str, glob: str = "*.txt") -> DataFrame:
    """``(path, length, text, error)`` of the files under a folder; a file that no encoding fits has an error and no text."""
    files = spark.read.format("binaryFile").option("pathGlobFilter", glob).load(path)
    return files.select("path", "length", decoded(F.col("content")).alias("d")).select("path", "length", "d.text", "d.error")


def chapters(docs: DataFrame) -> DataFrame:
    """``(doc_id, chapter_index, blocks)`` of ``(doc_id, text)``: one chapter, its paragraphs in one array."""
    block = lambda t, n: F.struct(n.alias("block_order"), F.concat(F.lit("p-"), n.cast("string")).alias("block_id"), t.alias("text"))
    return docs.select("doc_id", F.lit(0).alias("chapter_index"), F.transform(paragraphs(F.coalesce("text", F.lit(""))), block).alias("blocks"))


def blocks(docs: DataFrame) -> DataFrame:
    """Blocks of ``(doc_id, text)``: one chapter, paragraphs between blank lines, numbered without gaps."""
    rows = docs.select("doc_id", F.posexplode(paragraphs(F.coalesce("text", F.lit("")))).alias("block_order", "text"))
    return rows.select("doc_id", F.lit(0).alias("chapter_index"), "block_order", F.concat(F.lit("p-"), F.col("block_order").cast("string")).alias("block_id"), F.lit("paragraph").alias("type"), "text")
