"""Leaf blocks of (X)HTML: text tags that hold no other text tag."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame

from docspark.sources import markup

BLOCKS = "doc_id long, chapter_index int, block_order int, block_id string, type string, text string"


def leaf_blocks(html: str, closed: bool = False) -> list[tuple[str, str]]:
    """``(type, text)`` of the leaf text tags in document order, blank ones left out."""
    return [(leaf.kind, leaf.text) for leaf in markup.leaves(html, closed)]


def _text(value: str | bytes | None) -> str:
    return markup.decoded(value)[0] if isinstance(value, bytes) else value or ""


def blocks(chapters: DataFrame, closed: bool = False) -> DataFrame:
    """Blocks of ``(doc_id, chapter_index, html)``, where ``html`` is text, or bytes in an encoding of their own.

    A chapter without any block gives no row.  With ``closed`` a reference without its semicolon is text.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            made = []
            for doc_id, chapter, value in zip(*[batch.column(k).to_pylist() for k in range(3)]):
                made += [(doc_id, chapter, n, f"ch-{chapter}-b{n}", *block) for n, block in enumerate(leaf_blocks(_text(value), closed))]
            kinds = [pa.int64(), pa.int32(), pa.int32(), pa.string(), pa.string(), pa.string()]
            names = [f.split(" ")[0] for f in BLOCKS.split(", ")]
            yield pa.RecordBatch.from_arrays([pa.array([r[k] for r in made], kind) for k, kind in enumerate(kinds)], names=names)

    return chapters.select("doc_id", "chapter_index", "html").mapInArrow(run, BLOCKS)


def chapters(rows: DataFrame) -> DataFrame:
    """``(doc_id, chapter_index, blocks)`` of the same rows: the blocks of a chapter in one array."""
    shape = pa.list_(pa.struct([("block_order", pa.int32()), ("block_id", pa.string()), ("text", pa.string())]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            made = []
            for chapter, value in zip(batch.column(1).to_pylist(), batch.column(2)):
                made.append([{"block_order": n, "block_id": f"ch-{chapter}-b{n}", "text": text} for n, (_, text) in enumerate(leaf_blocks(_text(value.as_py())))])
            yield pa.RecordBatch.from_arrays([*batch.columns[:2], pa.array(made, shape)], names=["doc_id", "chapter_index", "blocks"])

    return rows.select("doc_id", "chapter_index", "html").mapInArrow(run, "doc_id long, chapter_index int, blocks array<struct<block_order int, block_id string, text string>>")
