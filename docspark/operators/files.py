"""Checks of incoming files, their names, and the table of formats."""

from __future__ import annotations

import unicodedata

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, functions as F
from pyspark.sql.types import StringType

MAX_SIZE = 50 * 1024 * 1024
MAX_NAME = 200


def max_size(setting: str | None) -> int:
    """The limit that a setting gives in bytes; the default where there is none or it is no whole number."""
    try:
        return MAX_SIZE if setting is None else int(setting)
    except ValueError:
        return MAX_SIZE


def formats(spark: SparkSession) -> DataFrame:
    """The dimension of formats: three rows."""
    return spark.sql("select * from values ('txt','text/plain','.txt'), ('epub','application/epub+zip','.epub'), ('pdf','application/pdf','.html') as t(format, media_type, output_ext)")


def extension(name: Column) -> Column:
    return F.regexp_extract(F.lower(name), r"\.([^.]+)$", 1)


def content_kind(content: Column) -> Column:
    """By the first 4096 bytes; null if none of the known kinds."""
    head = F.substring(content, 1, 4096)
    text = F.hex(head)
    epub = F.hex(F.encode(F.lit("mimetypeapplication/epub+zip"), "utf-8"))
    return (
        F.when(F.octet_length(content) == 0, "empty")
        .when(F.startswith(text, F.lit("255044462D")), "pdf")
        .when(F.startswith(text, F.lit("504B0304")), F.when(F.substring(text, 61, 56) == epub, "epub").otherwise("zip"))
        .when(~text.rlike("^(..)*00"), "txt")
    )


def checked(files: DataFrame, max_size: int = MAX_SIZE) -> DataFrame:
    """``files`` (name, length, content) with ``format`` and the ``reason`` of a rejection, null if accepted."""
    allowed = F.create_map(*[x for k, v in {"txt": ["txt"], "epub": ["epub", "zip"], "pdf": ["pdf"]}.items() for x in (F.lit(k), F.array(*map(F.lit, v)))])
    kind, ext = content_kind(F.col("content")), extension(F.col("name"))
    reason = (
        F.when(~ext.isin("txt", "epub", "pdf"), "extension")
        .when(F.col("length") > max_size, "size")
        .when((kind.isNull()) | ((kind != "empty") & ~F.array_contains(allowed[ext], kind)), "content")
    )
    return files.withColumn("format", F.when(ext.isin("txt", "epub", "pdf"), ext)).withColumn("reason", reason)


@F.pandas_udf(StringType())
def _ascii(names: pd.Series) -> pd.Series:
    return names.map(lambda n: None if n is None else unicodedata.normalize("NFKD", n).encode("ascii", "ignore").decode())


def safe_name(name: Column) -> Column:
    """Base name in ASCII, other characters as ``_``, at most MAX_NAME characters with the extension."""
    base = _ascii(F.substring_index(name, "/", -1))
    ext = F.lower(F.regexp_extract(base, r"(?<=.)(\.[^.]*)$", 1))
    stem = F.substring(base, F.lit(1), F.length(base) - F.length(ext))
    ext = F.regexp_replace(ext, r"[^A-Za-z0-9._-]+", "")
    clean = F.regexp_replace(F.regexp_replace(stem, r"[^A-Za-z0-9._-]+", "_"), r"^[._]+|[._]+$", "")
    clean = F.when(clean == "", "archivo").otherwise(clean)
    return F.concat(F.substring(clean, F.lit(1), F.lit(MAX_NAME) - F.length(ext)), ext)


def output_names(jobs: DataFrame, spark: SparkSession) -> DataFrame:
    """Where a job writes, and the name and media type of the download."""
    met = jobs.join(F.broadcast(formats(spark)), "format")
    return met.withColumn("output_name", F.concat(F.lit("output"), "output_ext")).withColumn("download_name", F.concat(F.lit("translated_"), "original_filename"))
