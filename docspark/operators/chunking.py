"""Packing blocks into chunks under a token budget, and the requests made of them."""

from __future__ import annotations

from bisect import bisect_right
from collections.abc import Iterator
from itertools import accumulate

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window, functions as F

from docspark.functions.text import estimate_tokens

MAX_TOKENS, CONTEXT_CHARS = 1000, 200
CHAPTER = ["doc_id", "chapter_index"]

# The wording of prompts, part of the request format.
STRUCTURE = "El texto a traducir tiene %1$d párrafos separados por líneas en blanco. Tu traducción debe preservar exactamente esas %1$d separaciones, en el mismo orden, para poder reconstruir cada párrafo por separado."
TERMS = "Usa exactamente estas traducciones para los siguientes términos, sin importar el contexto:"
PREVIOUS = 'Este es el final del fragmento anterior, solo para mantener coherencia — NO lo traduzcas ni lo incluyas en tu respuesta: "%s"'
SYSTEM = "Eres un traductor profesional. Traduce el siguiente texto de inglés a español. Devuelve ÚNICAMENTE la traducción, sin explicaciones, notas, comillas ni ningún texto adicional."
EXTRA = "Contexto adicional para esta traducción: %s"


def pack(blocks: DataFrame, max_tokens: int = MAX_TOKENS) -> DataFrame:
    """``blocks`` (without images) with ``est_tokens`` and ``chunk_index``.

    A chunk ends where the next block would pass the budget; a block is never cut.
    Packing is sequential within a chapter: one exchange brings chapters together in
    order, and a carry of three numbers runs over the sorted batches, so a long
    chapter needs no more memory than a short one.
    """
    rows = blocks.filter("type <> 'image'").select(*CHAPTER, "block_order", "block_id", "text", estimate_tokens("text").alias("est_tokens"))
    schema = rows.schema.simpleString()[7:-1].replace(":", " ") + ", chunk_index int"

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        key, chunk, held = None, 0, 0
        for batch in batches:
            out = []
            for doc, chapter, tokens in zip(batch["doc_id"], batch["chapter_index"], batch["est_tokens"]):
                if (doc, chapter) != key:
                    key, chunk, held, first = (doc, chapter), 0, 0, True
                elif not first and held + tokens > max_tokens:
                    chunk, held = chunk + 1, 0
                held, first = held + tokens, False
                out.append(chunk)
            yield batch.assign(chunk_index=pd.Series(out, dtype="int32", index=batch.index))

    return rows.repartition(*[F.col(c) for c in CHAPTER]).sortWithinPartitions(*CHAPTER, "block_order").mapInPandas(run, schema)


#: Blocks of a chapter that one task packs at once in ``pack_wide``.
RANGE_BLOCKS = 50_000


def range_steps(tokens: list[int], max_tokens: int) -> tuple[list[int], list[int], list[int], int, int]:
    """What a range of blocks does to a chunk that is open where it begins, by the room that the chunk has left.

    ``room`` are the prefix sums up to ``max_tokens``: a chunk with at least that much room left takes these blocks, then ``started`` chunks
    start and the last one holds ``end``; where none starts, the open chunk holds ``end`` more.  The two numbers are those of a range
    whose first block starts a chunk.  Chunks follow each other by pointers: from the start of each to that of the next.
    """
    n, upto = len(tokens), [0, *accumulate(tokens)]
    count, left, last = [0] * n, [0] * n, n
    for k in range(n - 1, -1, -1):
        while upto[last] > upto[k] + max_tokens:
            last -= 1
        follow = max(last, k + 1)
        count[k], left[k] = (count[follow] + 1, left[follow]) if follow < n else (0, min(upto[n] - upto[k], max_tokens + 1))
    room, started, end = [], [], []
    for k in range(n + 1):
        if upto[k] > max_tokens:
            break
        if room and room[-1] == upto[k]:
            room.pop(), started.pop(), end.pop()
        room.append(upto[k])
        started.append(count[k] + 1 if k < n else 0)
        end.append(left[k] if k < n else upto[n])
    return room, started, end, count[0], left[0]


def range_step(steps: tuple[list[int], list[int], list[int], int, int], state: int, max_tokens: int) -> tuple[int, int]:
    """Chunks that start in a range, and what is held at its end, where it begins with a chunk of ``state`` tokens; one more than ``max_tokens`` is any more, two more are no chunk at all."""
    room, started, end, first, left = steps
    if state > max_tokens:
        return first + (state == max_tokens + 1), left
    k = bisect_right(room, max_tokens - state) - 1
    return started[k], end[k] if started[k] else min(state + end[k], max_tokens + 1)


def range_table(tokens: np.ndarray, max_tokens: int) -> tuple[np.ndarray, np.ndarray]:
    """``range_step`` for each state: 0 to ``max_tokens`` tokens, more, and no chunk at all."""
    steps = range_steps([int(t) for t in tokens], max_tokens)
    started, end = zip(*[range_step(steps, state, max_tokens) for state in range(max_tokens + 3)])
    return np.array(started), np.array(end)


def pack_wide(blocks: DataFrame, max_tokens: int = MAX_TOKENS, range_blocks: int = RANGE_BLOCKS) -> DataFrame:
    """``pack`` for chapters larger than a task: the same rows.

    A chapter is cut into ranges of blocks.  What a range does to a chunk that is open where it begins is a table of no more
    rows than it has blocks, made for all ranges at once; one look-up a range tells with what each begins; then all ranges are packed at once.
    """
    rows = blocks.filter("type <> 'image'").select(*CHAPTER, "block_order", "block_id", "text", estimate_tokens("text").alias("est_tokens"), F.expr(f"cast(block_order div {range_blocks} as int)").alias("range"))
    part = [*CHAPTER, "range"]
    key = ", ".join(f"{c} {t}" for c, t in rows.select(*part).dtypes)
    steps = ["room", "started", "end", "first", "left"]

    def tables(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        now, held, out = None, [], []
        for batch in batches:
            for *name, tokens in zip(*[batch[c] for c in [*part, "est_tokens"]]):
                if name != now:
                    if held:
                        out.append((*now, *range_steps(held, max_tokens)))
                    now, held = name, []
                held.append(tokens)
            if out:
                yield pd.DataFrame(out, columns=[*part, *steps])
                out = []
        if held:
            yield pd.DataFrame([(*now, *range_steps(held, max_tokens))], columns=[*part, *steps])

    def begins(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        chapter, state, chunk = None, 0, 0
        for batch in batches:
            out = []
            for doc, number, range_, *told in zip(*[batch[c] for c in [*part, *steps]]):
                if (doc, number) != chapter:
                    chapter, state, chunk = (doc, number), max_tokens + 2, 0
                out.append((doc, number, range_, state, chunk))
                started, state = range_step(told, state, max_tokens)
                chunk += int(started)
                state = int(state)
            yield pd.DataFrame(out, columns=[*part, "state", "chunk"])

    def packed(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        state, chunk = 0, 0
        for batch in batches:
            out = []
            for tokens, begin, number in zip(batch["est_tokens"], batch["state"], batch["chunk"]):
                if begin >= 0:  # the row before a range's first block tells with what it begins
                    state, chunk = int(begin), int(number)
                elif state > max_tokens + 1:
                    state = tokens
                elif state + tokens > max_tokens:
                    state, chunk = tokens, chunk + 1
                else:
                    state += tokens
                state = state if begin >= 0 else min(state, max_tokens + 1)
                out.append(chunk)
            batch = batch.assign(chunk_index=pd.Series(out, dtype="int32", index=batch.index))
            yield batch[batch["state"] < 0][names]

    names = [*CHAPTER, "block_order", "block_id", "text", "est_tokens", "chunk_index"]
    lean = rows.select(*part, "block_order", "est_tokens").repartition(*part).sortWithinPartitions(*part, "block_order")
    found = lean.mapInPandas(tables, f"{key}, room array<int>, started array<int>, end array<int>, first int, left int")
    starts = found.repartition(*[F.col(c) for c in CHAPTER]).sortWithinPartitions(*part).mapInPandas(begins, f"{key}, state long, chunk long")
    marks = starts.withColumn("block_order", F.lit(-1))
    both = rows.withColumn("state", F.lit(-1).cast("long")).withColumn("chunk", F.lit(-1).cast("long")).unionByName(marks, allowMissingColumns=True)
    schema = rows.drop("range").schema.simpleString()[7:-1].replace(":", " ") + ", chunk_index int"
    return both.na.fill(0, ["est_tokens"]).repartition(*part).sortWithinPartitions(*part, "block_order").mapInPandas(packed, schema)


def chunks(packed: DataFrame, max_tokens: int = MAX_TOKENS, context_chars: int = CONTEXT_CHARS) -> DataFrame:
    """One row per chunk: blocks in order, text, context (the tail of the chapter's previous chunk) and place in the document."""
    if context_chars < 1:
        raise ValueError("context_chars must be positive")
    rows = packed.groupBy(*CHAPTER, "chunk_index").agg(F.array_sort(F.collect_list(F.struct("block_order", "block_id", "text"))).alias("blocks"), F.count("*").cast("int").alias("n_blocks"), F.sum("est_tokens").cast("int").alias("est_tokens"))
    rows = rows.withColumn("oversize", F.col("est_tokens") > max_tokens).withColumn("chunk_text", F.array_join(F.transform("blocks", lambda b: b["text"]), "\n\n"))
    before = F.lag("chunk_text").over(Window.partitionBy(*CHAPTER).orderBy("chunk_index"))
    rows = rows.withColumn("context", F.nullif(F.right(before, F.lit(context_chars)), F.lit("")))
    return rows.withColumn("chunk_seq", F.row_number().over(Window.partitionBy("doc_id").orderBy("chapter_index", "chunk_index")) - 1)


def chunk_starts(tokens: np.ndarray, max_tokens: int) -> list[int]:
    """Where the chunks of a chapter begin among its blocks: each goes as far as the prefix sums allow, by a block at least."""
    upto, out, at = np.concatenate([[0], np.cumsum(tokens, dtype=np.int64)]), [], 0
    while at < len(tokens):
        out.append(at)
        at = max(at + 1, int(np.searchsorted(upto, upto[at] + max_tokens, side="right")) - 1)
    return out


def chunk_rows(chapters: DataFrame, max_tokens: int = MAX_TOKENS, context_chars: int = CONTEXT_CHARS) -> DataFrame:
    """``chunks`` of chapters that come as rows ``(doc_id, chapter_index, blocks)``, blocks in order: nothing is shuffled.

    Only numbers of tokens go to Python.  ``chunk_seq`` grows along a document; from chapter to chapter it leaves numbers out.
    """
    if context_chars < 1:
        raise ValueError("context_chars must be positive")

    @F.pandas_udf("array<int>")
    def starts(tokens: pd.Series) -> pd.Series:
        return tokens.map(lambda t: chunk_starts(t, max_tokens))

    def part(array: str, i: Column) -> Column:
        return F.slice(array, F.get("starts", i) + 1, F.coalesce(F.get("starts", i + 1), F.size("blocks")) - F.get("starts", i))

    rows = chapters.select(*CHAPTER, "blocks", F.transform("blocks", lambda b: estimate_tokens(b["text"])).alias("tokens")).withColumn("starts", starts("tokens"))
    rows = rows.withColumn("texts", F.transform("starts", lambda s, i: F.array_join(F.transform(part("blocks", i), lambda b: b["text"]), "\n\n")))
    made = F.transform(
        "texts",
        lambda t, i: F.struct(
            i.alias("chunk_index"), part("blocks", i).alias("blocks"), F.aggregate(part("tokens", i), F.lit(0), lambda a, n: a + n).alias("est_tokens"),
            t.alias("chunk_text"), F.nullif(F.right(F.get("texts", i - 1), F.lit(context_chars)), F.lit("")).alias("context"),
        ),
    )
    rows = rows.select(*CHAPTER, F.explode(made).alias("c")).select(*CHAPTER, "c.*")
    place = F.col("chapter_index").cast("long") * (1 << 32) + F.col("chunk_index")
    return rows.withColumn("n_blocks", F.size("blocks")).withColumn("oversize", F.col("est_tokens") > max_tokens).withColumn("chunk_seq", place)


def structure_section(n_blocks: Column) -> Column:
    return F.when(n_blocks > 1, F.format_string(STRUCTURE, n_blocks))


def glossary_section(terms: Column) -> Column:
    lines = F.array_join(F.transform(terms, lambda t: F.concat(F.lit("- "), t["term"], F.lit(" → "), t["translation"])), "\n")
    return F.when(F.size(terms) > 0, F.concat(F.lit(TERMS + "\n"), lines))


def context_section(context: Column) -> Column:
    return F.when(context != "", F.format_string(PREVIOUS, context))


def requests(chunk_rows: DataFrame) -> DataFrame:
    """``chunk_rows`` with ``request_text`` and ``request_context``; uses ``terms`` where there is such a column."""
    terms = [glossary_section(F.col("terms"))] if "terms" in chunk_rows.columns else []
    sections = F.concat_ws("\n\n", structure_section(F.col("n_blocks")), *terms, context_section(F.col("context")))
    return chunk_rows.withColumn("request_text", F.col("chunk_text")).withColumn("request_context", F.nullif(sections, F.lit("")))


def system_prompt(context: Column, terms: Column | None = None) -> Column:
    parts = [F.lit(SYSTEM)]
    if terms is not None:
        parts.append(F.when(F.size(terms) > 0, F.concat(F.lit(TERMS + "\n"), F.array_join(F.transform(terms, lambda t: F.concat(F.lit("- "), t["term"], F.lit(" -> "), t["translation"])), "\n"))))
    return F.concat_ws("\n\n", *parts, F.when(context != "", F.format_string(EXTRA, context)))
