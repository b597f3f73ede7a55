"""Operator 7: exact deduplication by deterministic block naming.

Texts are cut into blocks of a fixed number of bytes.  The distinct blocks are
sorted and each gets an integer name; then adjacent names are paired, the
distinct pairs are sorted and named in turn, until every document has one name.
A name stands for exactly one byte string, so equal names are equal texts: no
hash decides anything.

At scale
  * Names come from a sort within hash buckets (``bucket << 40 | rank``), whose
    number follows the number of blocks, so no task sorts everything and names do
    not depend on how Spark split the work.
  * Equal blocks meet only after being gathered per ``(block, salt)``, so a block
    that a third of all rows share is spread over ``salts`` tasks and arrives in
    the naming sort as ``salts`` rows; salts follow rows, so ids that repeat or are
    missing do not bring rows together.
  * Only DataFrame operations run here; each level is settled in a table in the
    shared folder, and levels after the first move integers alone.

Defined results: a null text counts as empty and equals every other empty text; rows with the
same ``doc_id`` and equal text are counted and returned one by one, the first of
them standing for the group; a null ``doc_id`` sorts after all others; further
columns of the input are not touched.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window, functions as F

from docspark.llm.common import SPACE, settle

#: Bytes of a block. Most documents are a single block; a long one takes log2(blocks) levels.
BLOCK_BYTES = 4096
#: Blocks or pairs that one naming bucket holds, about.
BUCKET_ROWS = 4096


def normalised(text: Column) -> Column:
    return F.regexp_replace(F.coalesce(text, F.lit("")), SPACE, " ")


def _named(distinct: DataFrame, key: Column, buckets: int) -> DataFrame:
    """``distinct`` rows with ``name``: their rank in the sort of their bucket, made unique by the bucket."""
    bucket = F.pmod(F.xxhash64(key), F.lit(buckets))
    rank = F.dense_rank().over(Window.partitionBy("__bucket").orderBy(key))
    return distinct.withColumn("__bucket", bucket).withColumn("name", F.shiftleft(F.col("__bucket"), 40) + rank).drop("__bucket")


def first_names(docs: DataFrame, block_bytes: int, salts: int, buckets: int) -> DataFrame:
    """``(doc_id, sha, copies, names)``: the block names of each document in order."""
    text = F.col("text").cast("binary")
    n = F.greatest(F.lit(1), F.ceil(F.octet_length("text") / F.lit(block_bytes)).cast("int"))
    cut = F.transform(F.sequence(F.lit(0), n - 1), lambda i: F.substring(text, i * block_bytes + 1, F.lit(block_bytes)))
    rows = (
        docs.select("doc_id", normalised(F.col("text")).alias("text"), F.monotonically_increasing_id().alias("row"))
        .select("doc_id", F.unhex(F.sha2(F.col("text"), 256)).alias("sha"), F.pmod(F.xxhash64("row"), F.lit(salts)).alias("salt"), F.posexplode(cut).alias("pos", "block"))
    )
    gathered = rows.groupBy("block", "salt").agg(F.collect_list(F.struct("doc_id", "sha", "pos")).alias("at"))
    named = _named(gathered, F.col("block"), buckets).select("name", F.explode("at").alias("at"))
    # rows equal in id and text are counted before anything is gathered by them
    counted = named.groupBy("at.doc_id", "at.sha", "at.pos", "name").agg(F.count("*").cast("int").alias("n"))
    return (
        counted.groupBy("doc_id", "sha")
        .agg(F.array_sort(F.collect_list(F.struct("pos", "name", "n"))).alias("all"))
        .select("doc_id", "sha", F.col("all")[0]["n"].alias("copies"), F.transform("all", lambda x: x["name"]).alias("names"))
    )


def next_names(open_docs: DataFrame, buckets: int) -> DataFrame:
    """One level: adjacent names are paired, distinct pairs are named, documents carry the new names."""
    half = F.sequence(F.lit(0), ((F.size("names") - 1) / 2).cast("int"))
    pairs = F.transform(half, lambda i: F.struct(F.get("names", i * 2).alias("left"), F.coalesce(F.get("names", i * 2 + 1), F.lit(0)).alias("right")))
    rows = open_docs.select("doc_id", "sha", "copies", F.posexplode(pairs).alias("pos", "pair")).select("doc_id", "sha", "copies", "pos", "pair.left", "pair.right")
    names = _named(rows.select("left", "right").distinct(), F.struct("left", "right"), buckets)
    return (
        rows.join(names, ["left", "right"])
        .groupBy("doc_id", "sha", "copies")
        .agg(F.array_sort(F.collect_list(F.struct("pos", "name"))).alias("all"))
        .select("doc_id", "sha", "copies", F.transform("all", lambda x: x["name"]).alias("names"))
    )


def identities(docs: DataFrame, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """``(doc_id, sha, copies, level, name)``: ``(level, name)`` is the identity of the normalised text."""
    size = docs.agg(F.count("*").alias("rows"), F.sum(F.ceil(F.octet_length("text") / block_bytes)).alias("blocks")).first()
    rows = max(size.rows, size.blocks or 0)
    buckets = max(1, rows // BUCKET_ROWS)
    open_docs = settle(first_names(docs, block_bytes, max(8, rows // 512), buckets), "names")
    done, level = [], 0
    longest = open_docs.agg(F.max(F.size("names"))).first()[0] or 0
    while True:
        done.append(open_docs.filter(F.size("names") == 1).select("doc_id", "sha", "copies", F.lit(level).alias("level"), F.col("names")[0].alias("name")))
        if longest <= 1:
            break
        open_docs = settle(next_names(open_docs.filter(F.size("names") > 1), buckets), "names")
        longest, level = (longest + 1) // 2, level + 1
    out = done[0]
    for more in done[1:]:
        out = out.unionByName(more)
    return out


def duplicates(docs: DataFrame, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """``(doc_id, keep_id, group_size, kept, text_sha256, copies)`` for every row of ``docs``.

    ``copies`` counts the rows that are equal to it in id and text, itself included.
    """
    named = settle(identities(docs.select("doc_id", "text"), block_bytes), "identities")
    # a struct orders null ids last and ties by digest, so exactly one row of a group is first
    first = F.min(F.struct(F.col("doc_id").isNull().alias("unknown"), "doc_id")).alias("first")
    groups = settle(named.groupBy("level", "name").agg(first, F.sum("copies").alias("group_size")), "groups")
    return (
        named.join(groups, ["level", "name"])
        .withColumn("copy", F.explode(F.sequence(F.lit(1), F.col("copies"))))
        .select(
            "doc_id",
            F.col("first.doc_id").alias("keep_id"),
            "group_size",
            (F.col("doc_id").eqNullSafe(F.col("first.doc_id")) & (F.col("copy") == 1)).alias("kept"),
            F.lower(F.hex("sha")).alias("text_sha256"),
            "copies",
        )
    )


def op7_exact(spark: SparkSession, sf_dir: str) -> DataFrame:
    return duplicates(spark.read.parquet(f"{sf_dir}/documents.parquet")).drop("copies")


ORACLE = r"""
WITH t AS (
  SELECT doc_id, regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]+', ' ', 'g') AS norm FROM documents
)
SELECT doc_id, min(doc_id) OVER (PARTITION BY norm) AS keep_id, count(*) OVER (PARTITION BY norm) AS group_size,
       doc_id = min(doc_id) OVER (PARTITION BY norm) AS kept, sha256(norm) AS text_sha256
FROM t
"""
