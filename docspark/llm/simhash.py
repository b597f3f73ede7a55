"""Operator 4: SimHash near-deduplication with deletion-variant signatures.

A 64-bit fingerprint is cut into two segments.  Of two fingerprints that differ
in at most ``BITS = 3`` bits, one segment differs in at most one bit; so each
fingerprint is indexed under both whole segments and under every segment with one
bit taken out.  Rows that meet under an equal key are verified by the number of
differing bits; links are closed to components.

At scale
  * Fingerprints come from one narrow pass over the texts (vectorised bit counts).
  * Copies collapse to one row per distinct fingerprint before any index is built.
  * A deleted bit splits its bucket: rows whose bit was 0 join rows whose bit was
    1, so each linked pair is made under one key per segment and pairs inside an
    equal half never arise there.
  * A bucket with more than ``CROWD`` rows, which a large family of near copies
    makes, is not paired as it stands: its rows are indexed once more under the
    variants of the other segment, cut in two, and only rows that agree there
    too are compared.  The bound is exact (of three bits over two halves, one half
    has at most one), so no link is lost.

Defined results: texts without words, null ones too, have fingerprint zero and
are linked like any other; repeated rows give repeated rows; a null ``doc_id`` is
kept, and stands for a component only if nothing else does; further columns are
not read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession, functions as F, types as T

from docspark.llm.common import settle, text_bytes
from docspark.llm.components import components

SHINGLE = 3
BITS = 3
CROWD = 64
#: Fingerprints that one task indexes, about.
INDEX_ROWS = 16_384


def fingerprint(text: bytes, shingle: int) -> int:
    """Signed 64-bit SimHash of one text; ``bytes.lower`` and ``bytes.split`` keep to ASCII."""
    from xxhash import xxh64_intdigest

    words = text.lower().split()
    if not words:
        return 0
    if len(words) <= shingle:
        grams = [b" ".join(words)]
    else:
        grams = map(b" ".join, zip(*[words[k:] for k in range(shingle)]))
    hashes = np.array([xxh64_intdigest(g, 42) for g in grams], dtype=np.uint64)
    counts = np.zeros(64, dtype=np.int64)
    for at in range(0, len(hashes), 1 << 16):  # bounded working memory for very long texts
        counts += np.unpackbits(hashes[at : at + (1 << 16)].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    bits = np.packbits(counts * 2 > len(hashes), bitorder="little")
    return int(bits.view(np.int64)[0])


def fingerprints(docs: DataFrame, shingle: int = SHINGLE) -> DataFrame:
    """``(doc_id, fp)`` of every row."""
    schema = T.StructType([docs.schema["doc_id"], T.StructField("fp", T.LongType())])

    def run(batches: Iterator) -> Iterator:
        import pyarrow as pa

        for batch in batches:
            # one text at a time leaves its buffer: a batch is never held a second time as Python objects
            fps = [fingerprint(t.as_py(), shingle) for t in batch.column("text")]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(fps, pa.int64())], names=["doc_id", "fp"])

    return docs.select("doc_id", text_bytes("text").alias("text")).mapInArrow(run, schema)


def _segment(fp: str, number: int) -> Column:
    return F.expr(f"shiftrightunsigned({fp}, {32 * number}) & 4294967295L")


def _variants(value: Column, width: int) -> Column:
    """Structs ``(bit, rest, side)``: the whole value (bit -1), and the value without each of its bits."""
    whole = F.struct(F.lit(-1).alias("bit"), value.alias("rest"), F.lit(0).alias("side"))
    less = F.transform(
        F.sequence(F.lit(0), F.lit(width - 1)),
        lambda i: F.struct(i.alias("bit"), value.bitwiseAND(F.bitwise_not(F.call_function("shiftleft", F.lit(1).cast("bigint"), i))).alias("rest"), F.call_function("shiftright", value, i).bitwiseAND(F.lit(1)).cast("int").alias("side")),
    )
    return F.concat(F.array(whole), less)


def _numbered(name: str, number: int, variants: Column) -> Column:
    return F.transform(variants, lambda v: F.struct(F.lit(number).alias(name), v["bit"].alias("bit"), v["rest"].alias("rest"), v["side"].alias("side")))


def index(distinct: DataFrame) -> DataFrame:
    """``(fp, seg, bit, rest, side)``: the signatures of each distinct fingerprint."""
    rows = [_numbered("seg", s, _variants(_segment("fp", s), 32)) for s in (0, 1)]
    return distinct.select("fp", F.explode(F.concat(*rows)).alias("k")).select("fp", "k.*")


def _pairs(rows: DataFrame, keys: list[str], side: str, bit: str, bits: int) -> DataFrame:
    """Verified pairs of rows that agree on ``keys``; at a deleted bit only rows of different sides meet."""
    left = rows.filter(f"{bit} = -1 or {side} = 0").select(*keys, F.col("fp").alias("a"))
    right = rows.filter(f"{bit} = -1 or {side} = 1").select(*keys, F.col("fp").alias("b"))
    meets = (F.col(bit) != -1) | (F.col("a") < F.col("b"))
    near = F.bit_count(F.col("a").bitwiseXOR(F.col("b"))) <= bits
    return left.join(right, keys).filter(meets & near).select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"))


def links(distinct: DataFrame, bits: int = BITS, crowd: int = CROWD) -> DataFrame:
    """All pairs ``(a, b)`` of distinct fingerprints that differ in at most ``bits`` bits."""
    keys = ["seg", "bit", "rest"]
    # a fingerprint is 8 bytes but has 66 signatures: rows are dealt by their number, not by their bytes
    rows = index(distinct.repartition(max(1, distinct.count() // INDEX_ROWS), "fp"))
    # a bucket is of use only if two fingerprints meet in it
    held = rows.groupBy(*keys).agg(F.count("*").alias("n"), F.min("side").alias("lo"), F.max("side").alias("hi")).filter("n > 1 and (bit = -1 or lo <> hi)").drop("lo", "hi")
    held = settle(held, "held")
    met = settle(rows.join(held, keys), "buckets")
    plain = _pairs(met.filter(F.col("n") <= crowd), keys, "side", "bit", bits)
    other = F.when(F.col("seg") == 0, _segment("fp", 1)).otherwise(_segment("fp", 0))
    halves = F.concat(*[_numbered("half", h, _variants(F.shiftrightunsigned(other, 16 * h).bitwiseAND(F.lit(65535)), 16)) for h in (0, 1)])
    finer = met.filter(F.col("n") > crowd).select(*keys, "side", "fp", F.explode(halves).alias("k"))
    finer = finer.select(*keys, "side", "fp", F.col("k.half"), F.col("k.bit").alias("bit2"), F.col("k.rest").alias("rest2"), F.col("k.side").alias("side2"))
    return plain.unionByName(_crowded_pairs(finer, keys, bits)).distinct()


def _crowded_pairs(finer: DataFrame, keys: list[str], bits: int) -> DataFrame:
    both = [*keys, "half", "bit2", "rest2"]
    left = finer.filter("bit2 = -1 or side2 = 0").select(*both, F.col("fp").alias("a"), F.col("side").alias("left"))
    right = finer.filter("bit2 = -1 or side2 = 1").select(*both, F.col("fp").alias("b"), F.col("side").alias("right"))
    meets = (F.col("a") != F.col("b")) & (((F.col("bit") == -1)) | (F.col("left") != F.col("right")))
    once = (F.col("bit2") != -1) | (F.col("a") < F.col("b"))
    near = F.bit_count(F.col("a").bitwiseXOR(F.col("b"))) <= bits
    return left.join(right, both).filter(meets & once & near).select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"))


def near_duplicates(docs: DataFrame, shingle: int = SHINGLE, bits: int = BITS) -> DataFrame:
    """``(doc_id, fingerprint, component_id)`` of every row of ``docs``."""
    prints = settle(fingerprints(docs.select("doc_id", "text"), shingle), "fingerprints")
    least = settle(prints.groupBy("fp").agg(F.min("doc_id").alias("first")), "distinct")
    roots = components(links(least.select("fp"), bits)).withColumnsRenamed({"node": "fp"})
    # the component's smallest document, found per root and handed back to its fingerprints
    rooted = least.join(roots, "fp", "left").withColumn("root", F.coalesce("root", "fp"))
    named = rooted.groupBy("root").agg(F.min("first").alias("component_id"))
    of = rooted.join(named, "root").select("fp", "component_id")
    return prints.join(of, "fp").select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def op4_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(spark.read.parquet(f"{sf_dir}/documents.parquet"))
