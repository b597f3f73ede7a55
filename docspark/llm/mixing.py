"""Operator 2: mixing sources to target weights.

The words of each source form one stream that is packed into blocks of
``BLOCK_WORDS``.  For every output shard the counts of its sources are drawn from
a multinomial distribution; the slots of a source, numbered over the shards, are
mapped to blocks by a pseudorandom permutation of the source's block numbers, a
new one for every pass; slots and blocks are joined by index.

Draws alone would miss the targets by their noise, so the running count of a source
stops at its target and what is missing after the last shard makes up one more.  Of the
last slot of a source only the first words are taken, as many as its target lacks: every
source ends at its target to the word.

At scale
  * Stream positions are prefix sums on three levels (rows in a bucket, buckets in
    a span, spans in a source), so a source with a third of all rows is no task of
    its own.
  * The join of slots and blocks is keyed by (source, block): even, whatever the
    sizes of sources and documents.
  * Sources may be as many as documents: their numbers come from a range sort, their
    targets from a few sums, and a shard draws first for groups of ``GROUP`` sources and
    then within each; what reaches the driver is one number for each group.

Defined results: a null text has size 0 and is never taken; null is a source of its
own, last in order; repeated rows are separate documents; an empty table gives no
rows; further columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window, functions as F

from docspark.llm.common import WORD, settle

BLOCK_WORDS = 64
SHARD_BLOCKS = 1 << 16
WEIGHTS = (1, 2, 3)
#: No document is taken more than this many times.
REPEATS = 3
#: Sources that are drawn for together.
GROUP = 4096
#: Slots that one task unfolds, about, and the most tasks that do so.
TASK_SLOTS, MAX_TASKS = 1 << 18, 20_000
SEED = 20
BUCKET_ROWS, SPAN_BUCKETS = 64, 128


def sized(docs: DataFrame) -> DataFrame:
    """``(doc_id, source, size, digest)``: size is the number of words."""
    return docs.select("doc_id", "source", F.coalesce(F.regexp_count("text", F.lit(WORD)), F.lit(0)).cast("long").alias("size"), F.xxhash64("text").alias("digest"))


def numbered(found: DataFrame) -> DataFrame:
    """Sources with their ``number`` in code-point order, null last: a range sort, then places within each range."""
    spark = found.sparkSession
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    known = F.col("source").isNotNull()
    ranged = found.filter(known).repartitionByRange(parts, "source").withColumn("range", F.spark_partition_id())
    ranged = settle(ranged.unionByName(found.filter(~known).withColumn("range", F.lit(parts))), "sources")
    # of every range one number reaches the driver, and their running sums go back
    counts = {r["range"]: r["count"] for r in ranged.groupBy("range").count().collect()}
    starts, at = [], 0
    for k in range(parts + 1):
        starts.append((k, at))
        at += counts.get(k, 0)
    place = F.row_number().over(Window.partitionBy("range").orderBy("source")) - 1
    starts = spark.createDataFrame(starts, "range int, before long")
    return ranged.withColumn("place", place).join(F.broadcast(starts), "range").withColumn("number", (F.col("place") + F.col("before")).cast("int")).drop("range", "place", "before")


def source_table(rows: DataFrame) -> DataFrame:
    """One row per source, in code-point order, null last: number, size, target, blocks and slots.

    Shares are by weight; a source stops at ``REPEATS`` times its size and the rest is shared again.
    """
    found = numbered(rows.groupBy("source").agg(F.sum("size").alias("source_size"), F.count("*").alias("docs")))
    weight = F.element_at(F.array(*map(F.lit, WEIGHTS)), F.col("number") % len(WEIGHTS) + 1)
    found = settle(found.withColumn("weight", weight), "numbered-sources")
    size, weight = F.col("source_size"), F.col("weight")
    total = found.agg(F.sum("source_size")).first()[0] or 0
    unit, stopped = 0.0, -1
    while True:
        # what a source of weight 1 gets; where that is too much for one it stops, and the others get more
        full = F.lit(unit) * weight > REPEATS * size
        now = found.agg(F.count_if(full).alias("stopped"), F.sum(F.when(full, size)).alias("size"), F.sum(F.when(~full, weight)).alias("weight")).first()
        if now["stopped"] == stopped or not now["weight"]:
            break
        unit, stopped = (total - REPEATS * (now["size"] or 0)) / now["weight"], now["stopped"]
    target = F.when(full, (REPEATS * size).cast("double")).otherwise(F.lit(unit) * weight)
    blocks = F.ceil(size / BLOCK_WORDS)
    table = found.select(
        "source", "number", "source_size", target.alias("target"), blocks.cast("long").alias("blocks"), F.greatest(F.lit(1), F.floor(F.col("docs") / BUCKET_ROWS)).cast("long").alias("buckets"),
    )

    def measured(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            found = [slots_for(r.source_size, r.blocks, r.number, round(r.target)) for r in batch.itertuples(index=False)]
            yield batch.assign(slots=[f[0] for f in found], last_words=[f[1] for f in found])

    return settle(table.mapInPandas(measured, f"{table.schema.simpleString()[7:-1].replace(':', ' ')}, slots long, last_words long"), "targets")


def placed(rows: DataFrame, sources: DataFrame) -> DataFrame:
    """``rows`` with the columns of their source and ``start``, their place in its stream of words."""
    rows = rows.join(sources, rows["source"].eqNullSafe(sources["source"])).drop(sources["source"])
    rows = rows.withColumn("bucket", F.pmod(F.xxhash64("doc_id"), F.col("buckets"))).withColumn("span", F.floor(F.col("bucket") / SPAN_BUCKETS))
    keys = ["number", "span", "bucket"]

    def before(value: str, by: list[str], order: list[str]) -> Column:
        w = Window.partitionBy(*by).orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
        return F.coalesce(F.sum(value).over(w), F.lit(0))

    buckets = rows.groupBy(*keys).agg(F.sum("size").alias("size"))
    spans = buckets.groupBy("number", "span").agg(F.sum("size").alias("size"))
    spans = spans.select("number", "span", before("size", ["number"], ["span"]).alias("span_start"))
    buckets = buckets.select(*keys, before("size", ["number", "span"], ["bucket"]).alias("bucket_start"))
    return (
        rows.withColumn("row_start", before("size", keys, ["doc_id", "size", "digest"]))
        .join(buckets, keys)
        .join(spans, ["number", "span"])
        .withColumn("start", F.col("span_start") + F.col("bucket_start") + F.col("row_start"))
        .drop("span", "bucket", "span_start", "bucket_start", "row_start", "buckets", "slots", "last_words")
    )


def permuted(index: np.ndarray, n: int, key: int, back: bool = False) -> np.ndarray:
    """A pseudorandom permutation of ``range(n)`` at ``index``, or ``back`` from its values: four Feistel rounds, walked until inside."""
    half = np.uint64(max(1, (int(n - 1).bit_length() + 1) // 2))
    mask = np.uint64((1 << int(half)) - 1)
    keys = np.random.default_rng([SEED, key]).integers(1, 1 << 63, size=4, dtype=np.uint64)

    def scrambled(right: np.ndarray, k: np.uint64) -> np.ndarray:
        mixed = (right ^ k) * np.uint64(0x9E3779B97F4A7C15)
        mixed ^= mixed >> np.uint64(29)
        mixed *= np.uint64(0xBF58476D1CE4E5B9)
        return (mixed >> np.uint64(32)) & mask

    out = index.astype(np.uint64)
    todo = np.arange(len(out))
    while len(todo):
        left, right = out[todo] >> half, out[todo] & mask
        for k in keys[::-1] if back else keys:
            left, right = (right ^ scrambled(left, k), left) if back else (right, left ^ scrambled(right, k))
        out[todo] = left << half | right
        todo = todo[out[todo] >= n]
    return out.astype(np.int64)


def pass_key(number: int, turn: int) -> int:
    """The key of the permutation of a source's blocks in its ``turn``-th pass."""
    return number * 16 + turn


def slots_for(size: int, blocks: int, number: int, words: int) -> tuple[int, int]:
    """How many slots give ``words`` words of a source, and how many words the last of them gives.

    Every block has ``BLOCK_WORDS`` words but the last, which is short; whether the last pass meets it
    before it ends is read off its permutation.
    """
    if not words or not size:
        return 0, 0
    turn, rest = divmod(words, size)
    if not rest:
        turn, rest = turn - 1, size
    short = size - (blocks - 1) * BLOCK_WORDS
    met = int(permuted(np.array([blocks - 1]), blocks, pass_key(number, turn), back=True)[0])
    slots = -(-rest // BLOCK_WORDS)
    if met < slots:
        # the short block is among them, or the last of them
        slots = max(met + 1, 1 - (short - rest) // BLOCK_WORDS) if rest > met * BLOCK_WORDS else slots
    before = (slots - 1) * BLOCK_WORDS - (BLOCK_WORDS - short if met < slots - 1 else 0)
    return turn * blocks + slots, rest - before


def draws(sources: DataFrame) -> DataFrame:
    """``(shard, number, first, n)``: how many slots of each source a shard has, and the number of the first."""
    spark = sources.sparkSession
    member = F.array_sort(F.collect_list(F.struct("number", "slots"))).alias("members")
    groups = settle(sources.groupBy(F.expr(f"number div {GROUP}").cast("int").alias("group")).agg(member, F.sum("slots").alias("slots")), "source-groups")
    held = groups.select("group", "slots").orderBy("group").collect()
    names, slots = np.array([r["group"] for r in held], dtype=np.int32), [r["slots"] for r in held]
    total = sum(slots)
    shards = -(-total // SHARD_BLOCKS)

    def between(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        p = np.array(slots, dtype=float) / max(total, 1)
        for batch in batches:
            for shard in batch["id"]:
                n = np.random.default_rng([SEED, int(shard)]).multinomial(min(SHARD_BLOCKS, total - int(shard) * SHARD_BLOCKS), p)
                yield pd.DataFrame({"shard": shard, "group": names[n > 0], "n": n[n > 0]})

    def within(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for shard, group, n, members in zip(batch["shard"], batch["group"], batch["n"], batch["members"]):
                goal = np.array([m["slots"] for m in members], dtype=float)
                drawn = np.random.default_rng([SEED, int(shard), int(group) + 1]).multinomial(int(n), goal / goal.sum())
                yield pd.DataFrame({"shard": shard, "number": np.array([m["number"] for m in members], dtype=np.int32), "n": drawn})

    # no source, no shard: then there is nothing to draw
    of_groups = spark.range(0, shards, 1, max(1, min(shards, 256))).mapInPandas(between, "shard long, group int, n long")
    drawn = of_groups.join(groups.select("group", "members"), "group").mapInPandas(within, "shard long, number int, n long")
    goal = sources.select("number", "slots")
    upto = F.sum("n").over(Window.partitionBy("number").orderBy("shard"))
    run_on = drawn.withColumn("upto", upto).join(goal, "number")
    first = F.least(F.col("upto") - F.col("n"), F.col("slots"))
    stopped = run_on.select("shard", "number", first.alias("first"), (F.least("upto", "slots") - first).alias("n"))
    had = drawn.groupBy("number").agg(F.sum("n").alias("had"))
    rest = goal.join(had, "number", "left").withColumn("had", F.coalesce("had", F.lit(0))).filter("had < slots").select(F.lit(shards).cast("long").alias("shard"), "number", F.col("had").alias("first"), (F.col("slots") - F.col("had")).alias("n"))
    return stopped.unionByName(rest).filter("n > 0")


def slot_blocks(sources: DataFrame) -> DataFrame:
    """``(shard, number, slot, turn, block, room)``: the block behind every slot of the mix, and how many of its words are taken."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for r in batch.itertuples(index=False):
                for at in range(r.first, r.first + r.n, SHARD_BLOCKS):
                    slot = np.arange(at, min(at + SHARD_BLOCKS, r.first + r.n))
                    turn, place = slot // r.blocks, slot % r.blocks
                    block = np.empty_like(slot)
                    for k in np.unique(turn):
                        block[turn == k] = permuted(place[turn == k], r.blocks, pass_key(r.number, int(k)))
                    room = np.where(slot == r.slots - 1, r.last_words, BLOCK_WORDS)
                    yield pd.DataFrame({"shard": r.shard, "number": np.int32(r.number), "slot": slot, "turn": turn.astype(np.int32), "block": block, "room": room})

    # a row stands for thousands of slots, so rows are spread before they unfold; a given
    # number of tasks keeps Spark from merging them by the few bytes these rows have
    rows = draws(sources).join(sources.select("number", "blocks", "slots", "last_words"), "number").select("shard", "number", "first", "n", "blocks", "slots", "last_words")
    slots = sources.agg(F.sum("slots")).first()[0] or 0
    tasks = min(MAX_TASKS, -(-slots // TASK_SLOTS)) or 1
    return rows.repartition(tasks, F.col("shard"), F.col("number")).mapInPandas(run, "shard long, number int, slot long, turn int, block long, room long")


def pieces(rows: DataFrame) -> DataFrame:
    """``(number, block, doc_id, size, digest, start, word, n_words)``: what of each block is which document's."""
    has = rows.filter("size > 0")
    at = F.explode(F.expr(f"sequence(start div {BLOCK_WORDS}, (start + size - 1) div {BLOCK_WORDS})"))
    word = F.greatest(F.lit(0), F.col("block") * BLOCK_WORDS - F.col("start"))
    stop = F.least(F.col("size"), (F.col("block") + 1) * BLOCK_WORDS - F.col("start"))
    return has.select("number", "doc_id", "size", "digest", "start", at.alias("block")).withColumn("word", word).withColumn("n_words", stop - F.col("word"))


def mix(docs: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The placed documents, and the mix: ``(shard, slot, turn, number, block, doc_id, digest, start, word, n_words)``.

    A row of the mix is a run of ``n_words`` words of a document from its word
    number ``word`` on; ``assembled`` turns runs into texts.
    """
    rows = settle(sized(docs), "sizes")
    sources = source_table(rows)
    rows = settle(placed(rows, sources), "places")
    # slots unfold from a few rows, so Spark would take them for small and broadcast them
    mixed = slot_blocks(sources).hint("merge").join(pieces(rows), ["number", "block"])
    room = F.col("room") - (F.col("start") + F.col("word") - F.col("block") * BLOCK_WORDS)
    return rows, mixed.withColumn("n_words", F.least("n_words", room)).filter("n_words > 0").drop("room")


def taken(docs: DataFrame) -> DataFrame:
    """``(doc_id, size, source_size, target, taken)`` of every row of ``docs``."""
    rows, mixed = mix(docs)
    keys = ["number", "start", "size"]
    sums = mixed.groupBy(*keys).agg(F.sum("n_words").alias("taken"))
    return rows.join(sums, keys, "left").select("doc_id", "size", "source_size", "target", F.coalesce("taken", F.lit(0)).cast("long").alias("taken"))


def assembled(docs: DataFrame) -> DataFrame:
    """The mix as documents: for each pass that takes words of a document, a row with those words.

    Columns are those of ``docs``; a document taken whole keeps its text as it is,
    other runs of words are joined by spaces; ``n_chars`` is counted anew.
    """
    rows, mixed = mix(docs)
    runs = mixed.groupBy("number", "start", "size", "doc_id", "digest", "turn").agg(F.array_sort(F.collect_list(F.struct("word", "n_words"))).alias("runs"), F.sum("n_words").alias("words"))
    runs = runs.select(F.col("doc_id").alias("__id"), F.col("digest").alias("__digest"), "runs", F.col("words") == F.col("size"))
    runs = runs.toDF("__id", "__digest", "__runs", "__whole")
    texts = docs.withColumn("__text_digest", F.xxhash64("text")).dropDuplicates(["doc_id", "__text_digest"])
    words = F.regexp_extract_all("text", F.lit(WORD), F.lit(0))
    part = F.array_join(F.flatten(F.transform("__runs", lambda r: F.slice(F.col("__words"), r["word"].cast("int") + 1, r["n_words"].cast("int")))), " ")
    both = runs.join(texts, runs["__id"].eqNullSafe(texts["doc_id"]) & (runs["__digest"] == texts["__text_digest"]))
    out = both.withColumn("__words", F.when(~F.col("__whole"), words)).withColumn("text", F.when(F.col("__whole"), F.col("text")).otherwise(part))
    if "n_chars" in docs.columns:
        out = out.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType))
    return out.select(*docs.columns)


def op2_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    return taken(spark.read.parquet(f"{sf_dir}/documents.parquet"))
