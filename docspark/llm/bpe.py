"""Operator 1: byte-level BPE encoding and decoding.

Every match of the split pattern is one word.  The distinct words of an Arrow
batch are folded to token ids by ranked merges over their bytes against one rank
map; documents are then put together from the packed ids of their words, and
decoding concatenates the byte piece of each id.  No row leaves its partition:
the plan is a scan and one narrow map, without any exchange.

Defined results: a null or empty text has no tokens; repeated rows and null
``doc_id`` values give a row each; extra columns are ignored by ``encode`` unless
named in ``keep``.
"""

from __future__ import annotations

import base64
import hashlib
import heapq
from collections.abc import Iterator

from pyspark.sql import DataFrame, SparkSession, functions as F, types as T

#: Words that a worker remembers at most, between batches.
CACHE_WORDS = 300_000
#: Bytes of ids that a worker gathers before it hands them on.
TOGETHER = 1 << 20


def read_ranks(path: str) -> dict[bytes, int]:
    """The rank map of a ``.tiktoken`` file: token bytes to rank."""
    with open(path, "rb") as lines:
        return {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, lines)}


def merge_word(word: bytes, ranks: dict[bytes, int]) -> list[int]:
    """Ids of one word: the adjacent pair of lowest rank, leftmost first, merges until none can.

    A heap of candidate pairs keeps words of many thousand bytes at O(n log n).
    """
    if word in ranks:
        return [ranks[word]]
    n = len(word)
    end = list(range(1, n + 1))  # a piece starts at i and ends at end[i]; 0 marks a piece merged away
    before = list(range(-1, n - 1))
    heap = []
    for i in range(n - 1):
        rank = ranks.get(word[i : i + 2])
        if rank is not None:
            heap.append((rank, i, i + 2))
    heapq.heapify(heap)
    while heap:
        _, i, stop = heapq.heappop(heap)
        middle = end[i]
        if not middle or middle >= n or end[middle] != stop:
            continue
        end[i], end[middle] = stop, 0
        if stop < n:
            before[stop] = i
            rank = ranks.get(word[i : end[stop]])
            if rank is not None:
                heapq.heappush(heap, (rank, i, end[stop]))
        p = before[i]
        if p >= 0:
            rank = ranks.get(word[p:stop])
            if rank is not None:
                heapq.heappush(heap, (rank, p, stop))
    ids, i = [], 0
    while i < n:
        ids.append(ranks[word[i : end[i]]])
        i = end[i]
    return ids


class Coder:
    """Encoder and decoder of one worker: rank map, pieces by id and the words met so far."""

    def __init__(self, ranks: dict[bytes, int], pattern: str):
        import regex

        self.ranks, self.words = ranks, regex.compile(pattern).findall
        self.pieces = {i: token for token, i in ranks.items()}
        self.known: dict[str, bytes] = {}

    def encode(self, text: str | None) -> bytes:
        """Ids packed as little-endian unsigned 32-bit integers."""
        words = self.words(text or "")
        try:
            return b"".join([self.known[w] for w in words])
        except KeyError:
            new = {w for w in words if w not in self.known}
            if len(self.known) + len(new) > CACHE_WORDS:
                # a text with more distinct words than are remembered still has all of them at hand
                self.known, new = {}, set(words)
            for word in new:
                ids = merge_word(word.encode(), self.ranks)
                self.known[word] = b"".join([i.to_bytes(4, "little") for i in ids])
            return b"".join([self.known[w] for w in words])

    def decode(self, packed: bytes) -> bytes:
        return b"".join([self.pieces[i] for i in memoryview(packed).cast("I")])


def coded(batches: Iterator, coder: Coder, keep: tuple[str, ...]) -> Iterator:
    """Arrow batches of ``keep`` columns, ``ids`` and ``decoded``, of ``TOGETHER`` bytes of ids or one text more.

    A batch has thousands of texts; their ids and copies never stand in memory all at once.
    """
    import pyarrow as pa

    for batch in batches:
        ids, size, done = [], 0, 0
        for n, text in enumerate(batch.column("__text"), 1):
            ids.append(coder.encode(text.as_py()))
            size += len(ids[-1])
            if size >= TOGETHER or n == batch.num_rows:
                decoded = pa.array([coder.decode(x) for x in ids], pa.binary())
                kept = batch.slice(done, len(ids))
                yield pa.RecordBatch.from_arrays([*[kept.column(k) for k in keep], pa.array(ids, pa.binary()), decoded], names=[*keep, "ids", "decoded"])
                ids, size, done = [], 0, n


def encode(docs: DataFrame, rank_file: str, pattern: str, keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """``keep`` columns, ``ids`` (packed token ids) and ``decoded`` (bytes) of each row of ``docs``.

    The rank map is a fixed vocabulary file, read once on the driver and sent as
    a broadcast variable of known size; it does not grow with the corpus.
    """
    spark = docs.sparkSession
    shipped = spark.sparkContext.broadcast(read_ranks(rank_file))
    schema = T.StructType([docs.schema[k] for k in keep] + [T.StructField("ids", T.BinaryType()), T.StructField("decoded", T.BinaryType())])

    def run(batches: Iterator) -> Iterator:
        return coded(batches, Coder(shipped.value, pattern), keep)

    chosen = docs.select(*[F.col(f"`{k}`") for k in keep], F.coalesce(F.col("text"), F.lit("")).alias("__text"))
    return chosen.mapInArrow(run, schema)


def encode_digests(docs: DataFrame, rank_file: str, pattern: str) -> DataFrame:
    """``doc_id``, ``n_tokens``, ``ids_sha256`` and ``decoded_sha256``, by the same coder.

    The digests are taken where the ids are made, so ids do not travel back from
    the worker only to be hashed.
    """
    spark = docs.sparkSession
    shipped = spark.sparkContext.broadcast(read_ranks(rank_file))
    schema = T.StructType([docs.schema["doc_id"], T.StructField("n_tokens", T.LongType()), T.StructField("ids_sha256", T.StringType()), T.StructField("decoded_sha256", T.StringType())])

    def run(batches: Iterator) -> Iterator:
        import pyarrow as pa

        coder = Coder(shipped.value, pattern)
        for batch in batches:
            rows = []
            for text in batch.column("__text"):
                ids = coder.encode(text.as_py())
                rows.append((len(ids) // 4, hashlib.sha256(ids).hexdigest(), hashlib.sha256(coder.decode(ids)).hexdigest()))
            n, of_ids, of_text = zip(*rows) if rows else ((), (), ())
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(n, pa.int64()), pa.array(of_ids, pa.string()), pa.array(of_text, pa.string())], names=schema.names)

    # ids stay in their Arrow column, so none passes through a float beside a null
    chosen = docs.select("doc_id", F.coalesce(F.col("text"), F.lit("")).alias("__text"))
    return chosen.mapInArrow(run, schema)


def op1_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return encode_digests(docs, public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN)
