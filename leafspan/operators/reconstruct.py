"""A whole book from recognised blocks: the order of the steps is part of the result.

Front pages become images before contents are read, missing pages are filled, contents
are taken while divider pages still have their headings, and only then do pages full of
ink become images.  One plan for all books; each step is a join on (book, page).
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import pages as P
from . import render, toc

_BLOCK = ["book", "page", "idx", "block_type", "text", "level", "image_path", "bg"]


def as_images(blocks: DataFrame, which: DataFrame) -> DataFrame:
    """Blocks with the pages of ``which`` (book, page) as one picture each."""
    kinds = dict(blocks.dtypes)
    figure = {"idx": F.lit(0), "block_type": F.lit("figure"), "text": F.lit(""), "level": F.lit(0), "image_path": F.format_string("page_%04d_full.png", "page"), "bg": F.lit(None)}
    images = which.select("book", "page", *(c.cast(kinds[n]).alias(n) for n, c in figure.items()))
    return blocks.join(which, ["book", "page"], "left_anti").select(*_BLOCK).unionByName(images.select(*_BLOCK))


def reconstruct(blocks: DataFrame, facts: DataFrame, marks: DataFrame | None = None) -> tuple[DataFrame, DataFrame]:
    """Chapters (book, chapter, title, body) and a summary (book, n_pages, toc_count).

    ``facts`` has a row for each page of each book: has_layout, n_blocks, single_figure,
    has_image, blank, ink.  Pages without layout have no blocks.
    """
    there = blocks.select(*_BLOCK).join(facts.where("has_layout").select("book", "page"), ["book", "page"])
    covered = P.replace_cover(facts).where("covered and has_layout").select("book", "page")
    there = as_images(there, covered)
    known = facts.join(covered.withColumn("_cover", F.lit(True)), ["book", "page"], "left").withColumn("single_figure", F.col("single_figure") | F.col("_cover").isNotNull()).drop("_cover")
    front = P.replace_front(known, toc.first_divider(there)).where("replaced and has_layout").select("book", "page")
    there = as_images(there, front)
    filled = P.fill(facts)
    there = as_images(there, filled.where("filled = 'figure'").select("book", "page"))
    entries = toc.contents(there, marks)
    design = P.replace_design(known).where("replaced and has_layout").select("book", "page")
    there = as_images(there, design.join(filled.where("filled = 'keep'").select("book", "page"), ["book", "page"], "left_semi"))
    held = toc.chapters(entries, filled.select("book", "page"))
    summary = facts.groupBy("book").agg(F.count("*").alias("n_pages")).join(entries.groupBy("book").agg(F.count("*").alias("toc_count")), "book", "left")
    return render.render_chapters(there, held), summary.withColumn("toc_count", F.coalesce("toc_count", F.lit(0)))
