"""Tables of contents from bookmarks or headings, and the chapters they cut."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text as T

FRONT, BODY = "서문", "본문"


def bookmarks(rows: DataFrame, book: str = "book") -> DataFrame:
    """Entries of a bookmark table (level, title, page from 1)."""
    return rows.select(book, F.greatest(F.col("page") - 1, F.lit(0)).alias("page"), T.strip("title").alias("title"), "level", F.col("idx").alias("entry")).where("title <> ''")


def headings(blocks: DataFrame) -> DataFrame:
    return blocks.where((F.col("block_type") == "heading") & (T.strip("text") != "")).withColumn("text", T.strip("text"))


def divider_entries(blocks: DataFrame, book: str = "book") -> DataFrame:
    """Entries of pages with exactly one chapter divider; the next heading of the page is the chapter's name."""
    rows = headings(blocks).withColumn("divides", F.col("text").rlike(T.DIVIDER))
    page = Window.partitionBy(book, "page")
    rest = page.orderBy("idx").rowsBetween(1, Window.unboundedFollowing)
    rows = rows.withColumns({"n": F.count_if("divides").over(page), "next": F.first("text").over(rest)}).where("divides and n = 1")
    title = F.concat_ws(" ", "text", "next")
    return rows.select(book, "page", T.clip_title(T.to_plain(title)).alias("title"), F.lit(1).cast("bigint").alias("level"), F.col("idx").cast("bigint").alias("entry"))


def fallback_entries(blocks: DataFrame, book: str = "book") -> DataFrame:
    """Each page's first heading, if it has no level or the first."""
    rank = F.row_number().over(Window.partitionBy(book, "page").orderBy("idx"))
    rows = headings(blocks).withColumn("_rank", rank).where("_rank = 1 and level in (0, 1)")
    return rows.select(book, "page", T.clip_title(T.to_plain("text")).alias("title"), F.greatest(F.col("level"), F.lit(1)).cast("bigint").alias("level"), F.col("idx").cast("bigint").alias("entry"))


def books_with_dividers(blocks: DataFrame, book: str = "book") -> DataFrame:
    """Books that hold a divider anywhere, on a contents page or not."""
    return headings(blocks).where(F.col("text").rlike(T.DIVIDER)).select(book).distinct()


def contents(blocks: DataFrame, marks: DataFrame | None = None, book: str = "book") -> DataFrame:
    """Entries (book, page, title, level, entry) by the first source that a book has: bookmarks, dividers, first headings; entry is their order."""
    divided = books_with_dividers(blocks, book)
    found = divider_entries(blocks, book).unionByName(fallback_entries(blocks, book).join(divided, book, "left_anti"))
    if marks is None:
        return found
    own = bookmarks(marks, book).select(book, "page", "title", "level", F.col("entry").cast("bigint").alias("entry"))
    return own.unionByName(found.join(own.select(book).distinct(), book, "left_anti"))


def first_divider(blocks: DataFrame, book: str = "book") -> DataFrame:
    return divider_entries(blocks, book).groupBy(book).agg(F.min("page").alias("first_divider"))


def chapters(entries: DataFrame, pages: DataFrame, book: str = "book") -> DataFrame:
    """(book, chapter, title, page) of every page that a chapter holds.

    A page belongs to the last entry at or before it, pages before the first entry to a
    chapter of their own, all pages of a book without entries to one chapter.  Of two
    entries on a page the later, by entry, holds it (by title where entries are equal).  The last chapter runs to the end whatever
    pages are missing.  One window over a book's pages does it, without a range join.
    """
    order = [c for c in ("entry", "title") if c in entries.columns]
    marks = entries.groupBy(book, "page").agg(F.max_by("title", F.struct(*order)).alias("title"))
    rows = pages.select(book, "page").join(marks, [book, "page"], "full_outer").join(pages.select(book, "page", F.lit(True).alias("_there")), [book, "page"], "left")
    before = Window.partitionBy(book).orderBy("page").rowsBetween(Window.unboundedPreceding, 0)
    rows = rows.withColumns({"any": F.count("title").over(Window.partitionBy(book)), "seen": F.count("title").over(before), "name": F.last("title", True).over(before)}).where("_there")
    name = F.when(F.col("any") == 0, BODY).when(F.col("seen") == 0, FRONT).otherwise(F.col("name"))
    rows = rows.select(book, "page", "seen", name.alias("title"))
    return rows.withColumn("chapter", (F.dense_rank().over(Window.partitionBy(book).orderBy("seen")) - 1).cast("bigint")).select(book, "chapter", "title", "page")


def chapter_ranges(entries: DataFrame, pages: DataFrame, book: str = "book") -> DataFrame:
    """(book, chapter, title, first_page, last_page, n_pages)."""
    return chapters(entries, pages, book).groupBy(book, "chapter", "title").agg(F.min("page").alias("first_page"), F.max("page").alias("last_page"), F.count("*").alias("n_pages"))
