"""Documents built again from blocks: text, and HTML with its images."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window, functions as F

from docspark.functions.text import escape_html


def text(docs: DataFrame, blocks: DataFrame) -> DataFrame:
    """``(doc_id, output)``: translated or source texts in order, blank ones kept; documents without blocks give ''."""
    out = F.struct("chapter_index", "block_order", F.coalesce("translated_text", "text").alias("t"))
    made = blocks.groupBy("doc_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(out)), lambda b: b["t"]), "\n\n").alias("output"))
    return docs.select("doc_id").join(made, "doc_id", "left").select("doc_id", F.coalesce("output", F.lit("")).alias("output"))


def html(blocks: DataFrame) -> DataFrame:
    """``(doc_id, html)``: list items in runs, the first heading larger than the others."""
    order = Window.partitionBy("doc_id").orderBy("chapter_index", "block_order")
    body = escape_html(F.coalesce("translated_text", "text"))
    item, first = F.col("type") == "list_item", F.sum((F.col("type") == "heading").cast("int")).over(order) == 1
    level = F.when(first, "h1").otherwise("h2")
    tag = (
        F.when(item, F.concat(F.lit("<li>"), body, F.lit("</li>")))
        .when(F.col("type") == "heading", F.concat(F.lit("<"), level, F.lit(">"), body, F.lit("</"), level, F.lit(">")))
        .when(F.col("type") == "image", F.concat(F.lit('<img src="'), "block_id", F.lit("."), "image_ext", F.lit('"/>')))
        .otherwise(F.concat(F.lit("<p>"), body, F.lit("</p>")))
    )
    opens = item & F.coalesce(F.lag("type").over(order) != "list_item", F.lit(True))
    closes = item & F.coalesce(F.lead("type").over(order) != "list_item", F.lit(True))
    piece = F.concat(F.when(opens, "<ul>").otherwise(""), tag, F.when(closes, "</ul>").otherwise(""))
    rows = blocks.select("doc_id", "chapter_index", "block_order", piece.alias("piece"))
    return rows.groupBy("doc_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("chapter_index", "block_order", "piece"))), lambda b: b["piece"]), "").alias("html"))


def images(blocks: DataFrame) -> DataFrame:
    return blocks.filter("type = 'image'").select("doc_id", F.concat("block_id", F.lit("."), "image_ext").alias("filename"), "image_data")


def titles(chapters: DataFrame, blocks: DataFrame) -> DataFrame:
    """The text of a chapter's first block if that is a heading, else null."""
    first = blocks.groupBy("doc_id", "chapter_index").agg(F.min_by(F.struct("type", "text"), "block_order").alias("b"))
    return chapters.join(first, ["doc_id", "chapter_index"], "left").select("doc_id", "chapter_index", F.when(F.col("b.type") == "heading", F.col("b.text")).alias("title"))
