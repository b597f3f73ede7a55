"""Operator 13: target-distribution importance resampling over hashed n-grams.

Each document is scanned once, its words separated by single spaces; the running CRC-32
is stored at every word's start and end.  The CRC of any n-gram then comes from
two of these: that of its end, from which the prefix before it, shifted by the n-gram's
bytes, is cancelled over GF(2).  A shift by ``n`` bytes is linear in the 32 bits, so
it is four table look-ups, for all n-grams of a batch at once.

Buckets of the n-grams of the source and of the target are counted; a bucket's gain is the
scaled logarithm of the ratio of its smoothed shares, a document's weight the sum
of its gains, and Gumbel noise from a digest of its id turns the highest scores into a
draw without replacement in proportion to the weights.

At scale
  * Two scans of the texts, both narrow.  The first sends at most ``BUCKETS`` counts
    from each task; the second sends four numbers a document.
  * The gains are ``BUCKETS`` numbers, whatever the size of the corpus: they are the only
    thing that is broadcast.
  * Ranks come from a range sort and the row counts of its ranges, so no task
    sees all documents; equal scores are spread by ``doc_id``.

Defined results: a null or empty text, and one without words, has no features and weight
0, and is not drawn (it has fewer than ``LEAST_WORDS`` words); repeated rows are documents
of their own, of the same score; a null ``doc_id`` counts as an empty string in the digest
and comes last among equals; an empty table gives no rows, an empty target makes all gains
come from smoothing alone; further columns are not read.
"""

from __future__ import annotations

import zlib
from array import array
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession, functions as F, types as T

from docspark.llm.common import settle, table

ORDER = 1
BUCKETS = 10_000
SEED = "2024"
LEAST_WORDS = 20
PERCENT = 10

#: Lower-cases A-Z, keeps a-z, digits and every byte of other characters, and makes a space of the rest.
LETTERS = bytes(b + 32 if 65 <= b <= 90 else b if b >= 128 or 97 <= b <= 122 or 48 <= b <= 57 else 32 for b in range(256))
#: N-grams of up to so many bytes shift by one table, longer ones by a table for each bit of their length.
SHORT = 64


def _operator(bytes_: int) -> np.ndarray:
    """The 4 x 256 table of the linear map that turns a CRC of A into its share in that of AB, B of ``bytes_`` bytes."""
    zeros = b"\0" * bytes_
    # the map without the CRC's constant: what a state changes in the CRC of the same bytes
    images = [zlib.crc32(zeros, 1 << bit) ^ zlib.crc32(zeros, 0) for bit in range(32)]
    out = np.zeros((4, 256), dtype=np.uint32)
    for part in range(4):
        for bit in range(8):
            out[part, np.arange(256) >> bit & 1 == 1] ^= np.uint32(images[8 * part + bit])
    return out


class Shifts:
    """Shifts of many CRCs, each by its own number of bytes."""

    def __init__(self):
        self.short = np.stack([_operator(n) for n in range(SHORT)])
        self.powers = [self.short[1 << k] for k in range(SHORT.bit_length() - 1)]

    def apply(self, tables: np.ndarray, crc: np.ndarray, which: np.ndarray | None = None) -> np.ndarray:
        parts = [crc >> np.uint32(8 * k) & np.uint32(255) for k in range(4)]
        picked = [tables[k][p] if which is None else tables[which, k, p] for k, p in enumerate(parts)]
        return picked[0] ^ picked[1] ^ picked[2] ^ picked[3]

    def _power(self, k: int) -> np.ndarray:
        while len(self.powers) <= k:
            last = self.powers[-1]
            self.powers.append(np.stack([self.apply(last, row) for row in last]))
        return self.powers[k]

    def __call__(self, crc: np.ndarray, length: np.ndarray) -> np.ndarray:
        far = length >= SHORT
        if not far.any():
            return self.apply(self.short, crc, length)
        out = crc.copy()
        out[~far] = self.apply(self.short, crc[~far], length[~far])
        rest = length[far]
        moved = crc[far]
        for k in range(int(rest.max()).bit_length()):
            has = rest >> k & 1 == 1
            moved[has] = self.apply(self._power(k), moved[has])
        out[far] = moved
        return out


def scan(texts: Iterator[str | None]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Of all texts, one after the other: words of each, CRC before each word, CRC at its end, its bytes."""
    crc32 = zlib.crc32
    counts, before, at_end, lengths = array("I"), array("I"), array("I"), array("I")
    for text in texts:
        words = (text or "").encode().translate(LETTERS).split()
        counts.append(len(words))
        lengths.extend(map(len, words))
        state, gap = 0, b""
        for word in words:
            state = crc32(gap, state)
            before.append(state)
            state = crc32(word, state)
            at_end.append(state)
            gap = b" "
    held = [np.frombuffer(x, dtype=np.uint32) if x else np.zeros(0, dtype=np.uint32) for x in (counts, before, at_end, lengths)]
    return held[0].astype(np.int64), held[1], held[2], held[3].astype(np.int64)


def features(texts: Iterator[str | None], shifts: Shifts, order: int, buckets: int) -> tuple[np.ndarray, list[tuple[np.ndarray, np.ndarray]]]:
    """The words of each text, and for runs of 1 to ``order`` words the text and the bucket of each."""
    counts, before, at_end, lengths = scan(texts)
    text = np.repeat(np.arange(len(counts)), counts)
    stops = np.cumsum(lengths + 1)
    out = []
    for n in range(1, order + 1):
        last = np.arange(n - 1, len(text))
        last = last[text[last] == text[last - n + 1]]
        first = last - n + 1
        size = stops[last] - stops[first] + lengths[first]
        out.append((text[last], ((at_end[last] ^ shifts(before[first], size)) % np.uint32(buckets)).astype(np.int64)))
    return counts, out


def bucket_counts(texts: DataFrame, order: int = ORDER, buckets: int = BUCKETS) -> DataFrame:
    """``(bucket, n)``: how many features of ``texts`` fall into each bucket that has any."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        shifts, total = Shifts(), np.zeros(buckets, dtype=np.int64)
        for batch in batches:
            for _, found in features(batch["text"], shifts, order, buckets)[1]:
                total += np.bincount(found, minlength=buckets)
        yield pd.DataFrame({"bucket": np.flatnonzero(total), "n": total[total > 0]})

    return texts.select("text").mapInPandas(run, "bucket long, n long").groupBy("bucket").agg(F.sum("n").alias("n"))


def gains(source: DataFrame, target: DataFrame, buckets: int = BUCKETS) -> DataFrame:
    """``(bucket, gain)`` of every bucket, from the counts of both sides: at most ``buckets`` rows each."""
    all_of = source.sparkSession.range(buckets).withColumnRenamed("id", "bucket")
    both = all_of.join(source.withColumnRenamed("n", "s"), "bucket", "left").join(target.withColumnRenamed("n", "t"), "bucket", "left").na.fill(0, ["s", "t"])
    both = settle(both, "buckets")
    sums = both.agg(F.sum("s").alias("s"), F.sum("t").alias("t")).first()
    s, t = F.col("s").cast("double"), F.col("t").cast("double")
    ratio = (t + 1) * F.lit(float(sums["s"] + buckets)) / ((s + 1) * F.lit(float(sums["t"] + buckets)))
    return both.select("bucket", F.floor(1000 * F.ln(ratio)).cast("long").alias("gain"))


def weighed(docs: DataFrame, gain: DataFrame, order: int = ORDER, buckets: int = BUCKETS) -> DataFrame:
    """``(doc_id, n_words, n_features, weight)`` of every row of ``docs``."""
    held = np.zeros(buckets, dtype=np.int64)
    for r in gain.collect():  # one number a bucket
        held[r["bucket"]] = r["gain"]
    shipped = docs.sparkSession.sparkContext.broadcast(held)
    schema = T.StructType([docs.schema["doc_id"], *(T.StructField(c, T.LongType()) for c in ("n_words", "n_features", "weight"))])

    def run(batches: Iterator) -> Iterator:
        import pyarrow as pa

        shifts = Shifts()
        for batch in batches:
            n_words, found = features(batch.column(1).to_pylist(), shifts, order, buckets)
            n_features, weight = np.zeros_like(n_words), np.zeros_like(n_words)
            for text, bucket in found:
                n_features += np.bincount(text, minlength=len(n_words))
                # whole numbers stay whole: sums by prefix, not in floating point
                upto = np.concatenate([[0], np.cumsum(shipped.value[bucket])])
                ends = np.searchsorted(text, np.arange(len(n_words) + 1))
                weight += np.diff(upto[ends])
            yield pa.RecordBatch.from_arrays([batch.column(0), *map(pa.array, (n_words, n_features, weight))], names=schema.names)

    return docs.select("doc_id", "text").mapInArrow(run, schema)


def scored(rows: DataFrame, seed: str = SEED) -> DataFrame:
    """``rows`` with ``score``: the weight and a Gumbel variable from the digest of seed and id."""
    head = F.substring(F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col("doc_id").cast("string"), F.lit(""))), 256), 1, 8)
    share = (F.conv(head, 16, 10).cast("double") + 0.5) / F.lit(4294967296.0)
    return rows.withColumn("score", F.col("weight") + F.floor(-1000 * F.ln(-F.ln(share))).cast("long"))


def ranked(rows: DataFrame, percent: int = PERCENT, least_words: int = LEAST_WORDS) -> DataFrame:
    """``rows`` with ``rank``: 1 for the highest score among rows of enough words, null for those not drawn.

    A range sort gives each row its place within its range; the counts of the ranges, one number
    for each, give the places before it.
    """
    spark = rows.sparkSession
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    order = [F.desc("score"), F.asc_nulls_last("doc_id"), F.asc("n_features"), F.asc("n_words"), F.asc("weight")]
    able = rows.filter(F.col("n_words") >= least_words)
    # a row's place within its range: its id has the range in its upper bits and counts on from 0 in the lower 33
    placed = able.repartitionByRange(parts, *order).sortWithinPartitions(*order).withColumn("at", F.monotonically_increasing_id())
    placed = settle(placed.withColumn("range", F.shiftrightunsigned("at", 33)).withColumn("at", F.col("at").bitwiseAND((1 << 33) - 1)), "ranked")
    sizes = {r["range"]: r["count"] for r in placed.groupBy("range").count().collect()}
    starts, before = [], 0
    for k in sorted(sizes):
        starts.append((k, before))
        before += sizes[k]
    drawn = before * percent // 100
    starts = spark.createDataFrame(starts, "range long, before long")
    place = F.col("at") + F.col("before") + 1
    ranks = placed.join(F.broadcast(starts), "range").withColumn("rank", F.when(place <= drawn, place))
    rest = rows.filter(F.col("n_words") < least_words).withColumn("rank", F.lit(None).cast("long"))
    return ranks.select(*rows.columns, "rank").unionByName(rest)


def resampled(docs: DataFrame, target: DataFrame, order: int = ORDER, buckets: int = BUCKETS, percent: int = PERCENT, least_words: int = LEAST_WORDS, seed: str = SEED) -> DataFrame:
    """``(doc_id, n_words, n_features, weight, score, rank)`` of every row of ``docs``, drawn towards the texts of ``target``."""
    gain = gains(bucket_counts(docs, order, buckets), bucket_counts(target, order, buckets), buckets)
    # written once, as the range sort reads its rows twice
    rows = settle(scored(weighed(docs, gain, order, buckets), seed), "weighed")
    return ranked(rows, percent, least_words)


def op13_resample(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, target = table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark")
    return resampled(docs, target).select("doc_id", "n_features", "weight", "score", "rank")


#: CRC-32 byte by byte, over the distinct words only; its 256 table entries come from the polynomial.
ORACLE = r"""
WITH crc_table AS (
    SELECT list(v ORDER BY b) AS entries FROM (
        SELECT b, list_reduce(range(8)::BIGINT[], lambda c, k : CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END, b) AS v FROM range(256) AS r(b)
    )
),
words AS (
    SELECT 'd' AS side, doc_id AS id, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')) AS w FROM documents
    UNION ALL
    SELECT 't', NULL, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')) FROM benchmark
),
counted AS (SELECT side, id, w, count(*) AS n FROM words GROUP BY ALL),
vocabulary AS (SELECT w, sum(CASE WHEN side = 'd' THEN n ELSE 0 END) AS s, sum(CASE WHEN side = 't' THEN n ELSE 0 END) AS t FROM counted GROUP BY w),
hashed AS (
    SELECT w, s, t, xor(list_reduce(
        list_transform(range(1, octet_length(encode(w)) + 1), lambda i : ('0x' || substr(hex(encode(w)), 2 * i::INT - 1, 2))::BIGINT),
        lambda c, b : xor(c >> 8, entries[(xor(c, b) & 255) + 1]), 4294967295::BIGINT), 4294967295) % 10000 AS bucket
    FROM vocabulary, crc_table
),
sides AS (SELECT bucket, sum(s) AS s, sum(t) AS t FROM hashed GROUP BY bucket),
totals AS (SELECT sum(s)::DOUBLE AS s, sum(t)::DOUBLE AS t FROM sides),
gain AS (SELECT bucket, floor(1000 * ln((a.t::DOUBLE + 1) * (o.s + 10000) / ((a.s::DOUBLE + 1) * (o.t + 10000))))::BIGINT AS gain FROM sides AS a, totals AS o),
sums AS (
    SELECT c.id, sum(n)::BIGINT AS n_features, sum(n * gain)::BIGINT AS weight
    FROM counted AS c JOIN hashed AS h USING (w) JOIN gain AS g USING (bucket) WHERE side = 'd' GROUP BY c.id
),
scores AS (
    SELECT doc_id, coalesce(n_features, 0)::BIGINT AS n_features, coalesce(weight, 0)::BIGINT AS weight,
        coalesce(weight, 0)::BIGINT + floor(-1000 * ln(-ln((('0x' || substr(sha256('2024:' || doc_id), 1, 8))::BIGINT + 0.5::DOUBLE) / 4294967296::DOUBLE)))::BIGINT AS score
    FROM documents LEFT JOIN sums ON id = doc_id
),
places AS (
    SELECT doc_id, row_number() OVER (ORDER BY score DESC, doc_id) AS place, count(*) OVER () AS able FROM scores WHERE n_features >= 20
)
SELECT s.doc_id, n_features, weight, score, CASE WHEN place <= able * 10 // 100 THEN place END::BIGINT AS rank
FROM scores AS s LEFT JOIN places USING (doc_id)
"""
