"""What is done in ranges equals what is done in one piece."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from docspark.operators import chunking, layout


def _sequential(tokens, most):
    out, chunk, held, first = [], 0, 0, True
    for t in tokens:
        if not first and held + t > most:
            chunk, held = chunk + 1, 0
        held, first = held + t, False
        out.append(chunk)
    return out, held


def test_range_tables():
    r = random.Random(1)
    for _ in range(400):
        most = r.choice([1, 3, 10, 40])
        tokens = [r.choice([0, 0, 1, 2, 5, most, most + 1, 3 * most]) for _ in range(r.randint(1, 30))]
        started, end = chunking.range_table(np.array(tokens), most)
        for held in range(most + 2):
            # an open chunk of so many tokens: one block before
            out, left = _sequential([held, *tokens], most)
            assert (started[held], end[held]) == (out[-1], min(left, most + 1)), (tokens, most, held)
        out, left = _sequential(tokens, most)
        assert (started[-1], end[-1]) == (out[-1], min(left, most + 1))


@pytest.mark.parametrize("size", [1, 3, 1000])
def test_pack_wide(spark, size):
    r = random.Random(size)
    rows = []
    for doc in range(6):
        for chapter in (0, 2, 11):
            at = 0
            for _ in range(r.choice([1, 5, 40])):
                at += r.choice([1, 1, 1, 9])  # numbers may have gaps
                rows.append((doc, chapter, at, f"b{at}", "image" if r.random() < 0.1 else "paragraph", "x" * r.choice([0, 1, 4, 20, 40, 45, 130])))
    blocks = spark.createDataFrame(rows, "doc_id long, chapter_index int, block_order int, block_id string, type string, text string")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", 7)
    try:
        wide, plain = (sorted(map(tuple, x.select("doc_id", "chapter_index", "block_order", "block_id", "text", "est_tokens", "chunk_index").collect())) for x in (chunking.pack_wide(blocks, 10, size), chunking.pack(blocks, 10)))
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    assert wide == plain and len(wide) > 100
    assert chunking.pack_wide(blocks.limit(0), 10, size).count() == 0


@pytest.mark.parametrize("pages", [1, 2, 5])
def test_islands_by_ranges(spark, pages):
    """Blocks of several lines and spans, images and empty pages: the same blocks, whatever the ranges."""
    r = random.Random(pages)
    spans, images = [], []
    for doc in range(12):
        for page in r.sample(range(1, 40), 22):
            for block in range(r.choice([0, 1, 1, 2, 3])):
                if r.random() < 0.15:
                    images.append((doc, page, block, b"i", "png", 1, 1))
                    continue
                for line in range(r.choice([1, 2])):
                    for span in range(r.choice([1, 1, 3])):
                        spans.append((doc, page, block, line, span, r.choice(["and so", "- item", "ends.", " ", "more ", "exam-"]), r.choice([11.0, 11.0, 11.0, 11.0, 14.0])))
    rows = spark.createDataFrame(spans, "doc_id long, page_number int, block_no int, line_no int, span_no int, text string, size double")
    held = spark.createDataFrame(images, "doc_id long, page_number int, block_no int, image_data binary, image_ext string, image_width int, image_height int")
    columns = ["doc_id", "block_order", "block_id", "type", "text", "page_number", "image_ext"]
    wide, plain = (sorted(map(repr, layout.blocks(rows, held, range_pages=n).select(*columns).collect())) for n in (pages, None))
    assert wide == plain
    # some paragraph goes on over three pages, so over a whole range
    assert layout.blocks(rows, held).filter(F.size(F.split("text", "and so|more|exam-")) > 3).count() > 0
