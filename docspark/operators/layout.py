"""Blocks of laid-out pages: font sizes, kinds of blocks, paragraphs across pages."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from docspark.functions.text import WS, collapse, strip

HEADING_RATIO = 1.15
BULLET = rf"(?U)^[•\-*]{WS}+"
NUMBER = rf"(?U)^([0-9]+[.)]|[a-zA-Z][.)]){WS}+"
SENTENCE_END = rf"(?U)[.!?…»\"')\]]{WS}*\z"


def body_sizes(spans: DataFrame) -> DataFrame:
    """The most frequent size of non-blank spans, to half points, half to even; of equals the one seen first."""
    place = F.struct("page_number", "block_no", "line_no", "span_no")
    sizes = spans.filter(strip("text") != "").select("doc_id", (F.bround(F.col("size") * 2) / 2).alias("body_size"), place.alias("at"))
    counts = sizes.groupBy("doc_id", "body_size").agg(F.count("*").alias("n"), F.min("at").alias("at"))
    best = F.row_number().over(Window.partitionBy("doc_id").orderBy(F.desc("n"), "at")) == 1
    found = counts.withColumn("best", best).filter("best").select("doc_id", "body_size")
    return spans.select("doc_id").distinct().join(found, "doc_id", "left").select("doc_id", F.coalesce("body_size", F.lit(0.0)).alias("body_size"))


def block_texts(spans: DataFrame) -> DataFrame:
    """``(doc_id, page_number, block_no, text, max_size)``: spans come together once, with their lines.

    Lines are joined by blanks, and as runs of white space become one blank, none of them is stripped alone.
    """
    rows = spans.groupBy("doc_id", "page_number", "block_no").agg(F.collect_list(F.struct("line_no", "span_no", "text")).alias("spans"), F.max("size").alias("max_size")).withColumn("spans", F.array_sort("spans"))
    breaks = lambda s, i: F.when((i > 0) & (s["line_no"] != F.get("spans", i - 1)["line_no"]), " ").otherwise("")
    joined = F.array_join(F.transform("spans", lambda s, i: F.concat(breaks(s, i), F.coalesce(s["text"], F.lit("")))), "")
    return rows.select("doc_id", "page_number", "block_no", collapse(joined).alias("text"), "max_size")


def kind(text: Column, max_size: Column, body_size: Column) -> Column:
    return F.when(max_size >= HEADING_RATIO * body_size, "heading").when(text.rlike(BULLET) | text.rlike(NUMBER), "list_item").otherwise("paragraph")


def candidates(spans: DataFrame, images: DataFrame | None = None) -> DataFrame:
    """Text blocks and images in reading order, with their kind."""
    rows = block_texts(spans).filter("text <> ''").join(body_sizes(spans), "doc_id")
    rows = rows.withColumn("type", kind(F.col("text"), F.col("max_size"), F.col("body_size")))
    bare = F.when(F.col("text").rlike(BULLET), F.regexp_replace("text", BULLET, "")).otherwise(F.regexp_replace("text", NUMBER, ""))
    rows = rows.withColumn("text", F.when(F.col("type") == "list_item", bare).otherwise(F.col("text"))).select("doc_id", "page_number", "block_no", "type", "text")
    if images is not None:
        rows = rows.unionByName(images.select("doc_id", "page_number", "block_no", F.lit("image").alias("type"), F.lit("").alias("text"), "image_data", "image_ext", "image_width", "image_height"), allowMissingColumns=True)
    return rows.withColumn("page_index", F.row_number().over(Window.partitionBy("doc_id", "page_number").orderBy("block_no")) - 1)


def _joins() -> Column:
    """Whether a candidate may go on with what stands before it: the first of a page, and a paragraph."""
    return (F.col("page_index") == 0) & (F.col("type") == "paragraph")


def _open() -> Column:
    """Whether a candidate may be gone on with: a paragraph without a full stop."""
    return (F.col("type") == "paragraph") & ~F.col("text").rlike(SENTENCE_END)


def _numbered(rows: DataFrame) -> DataFrame:
    """``rows`` with ``block_order``, a document in one piece."""
    order = Window.partitionBy("doc_id").orderBy("page_number", "block_no")
    goes_on = _joins() & F.coalesce(F.lag(_open()).over(order), F.lit(False))
    return rows.withColumn("starts", F.when(goes_on, 0).otherwise(1)).withColumn("block_order", (F.sum("starts").over(order) - 1).cast("int"))


def _numbered_by_ranges(rows: DataFrame, range_pages: int) -> DataFrame:
    """The same, by ranges of pages: each is numbered alone, and one row of each range tells what stands at its borders."""
    rows = rows.withColumn("range", F.expr(f"page_number div {range_pages}"))
    order = Window.partitionBy("doc_id", "range").orderBy("page_number", "block_no")
    goes_on = _joins() & F.coalesce(F.lag(_open()).over(order), F.lit(False))
    rows = rows.withColumn("inner", F.sum(F.when(goes_on, 0).otherwise(1)).over(order))
    place = F.struct("page_number", "block_no")
    borders = rows.groupBy("doc_id", "range").agg(F.min_by(_joins(), place).alias("joins"), F.max_by(_open(), place).alias("open"), F.max("inner").alias("n"))
    ranges = Window.partitionBy("doc_id").orderBy("range")
    # the first candidate of a range that goes on with the last one before it is no block of its own
    borders = borders.withColumn("less", (F.col("joins") & F.coalesce(F.lag("open").over(ranges), F.lit(False))).cast("int"))
    before = F.coalesce(F.sum(F.col("n") - F.col("less")).over(ranges.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    borders = borders.select("doc_id", "range", (before - F.col("less") - 1).alias("offset"))
    return rows.join(borders, ["doc_id", "range"]).withColumn("block_order", (F.col("offset") + F.col("inner")).cast("int"))


def blocks(spans: DataFrame, images: DataFrame | None = None, range_pages: int | None = None) -> DataFrame:
    """Candidates joined into blocks: a paragraph goes on from the page before where that one ends without a full stop.

    With ``range_pages`` no task sees more of a document than so many pages, for documents larger than a task.
    """
    rows = candidates(spans, images)
    rows = _numbered(rows) if range_pages is None else _numbered_by_ranges(rows, range_pages)
    extra = [c for c in ("image_data", "image_ext", "image_width", "image_height") if c in rows.columns]
    parts = F.array_sort(F.collect_list(F.struct("page_number", "block_no", "text")))
    out = rows.groupBy("doc_id", "block_order").agg(F.min_by("type", F.struct("page_number", "block_no")).alias("type"), F.array_join(F.transform(parts, lambda p: p["text"]), " ").alias("text"), F.min("page_number").alias("page_number"), *[F.first(c, ignorenulls=True).alias(c) for c in extra])
    return out.withColumn("chapter_index", F.lit(0)).withColumn("block_id", F.concat(F.lit("ch-0-b"), F.col("block_order").cast("string")))
