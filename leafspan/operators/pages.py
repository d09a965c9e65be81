"""What becomes of whole pages: filled, replaced by their image, or dropped.

Each rule is a projection over pages that carry has_layout, n_blocks, single_figure,
has_image, blank and ink; J-rules that look at a book take its scalar by a join on the
book, whose side is one row a book.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

INK = 0.5


def _yes(name: str) -> Column:
    return F.coalesce(F.col(name), F.lit(False))


def fill(pages: DataFrame) -> DataFrame:
    """Column filled: keep, figure or empty; blank pages without blocks vanish, as do those with neither layout nor image."""
    full = _yes("has_layout") & (F.col("n_blocks") > 0)
    to = F.when(full, "keep").when(_yes("blank"), None).when(_yes("has_image"), "figure").when(_yes("has_layout"), "empty")
    return pages.withColumn("filled", to).where("filled is not null")


def all_pages(books: DataFrame, layouts: DataFrame, book: str = "book") -> DataFrame:
    """One row for each page 0 .. n_pages - 1 of each book, with its layout where there is one; of several the last counts; a book of no pages has no rows."""
    wanted = books.where("n_pages > 0").select(book, F.explode(F.expr("sequence(0L, n_pages - 1L)")).alias("page"))
    last = layouts.groupBy(book, "page").agg(F.max_by(F.struct("has_layout", "n_blocks"), "layout_idx").alias("l")).select(book, "page", "l.*")
    return wanted.join(last, [book, "page"], "left")


def is_cover() -> Column:
    return _yes("has_image") & ~_yes("blank") & (F.col("ink") >= INK)


def replace_cover(pages: DataFrame) -> DataFrame:
    """Column covered: the first page is its image, where that is a designed cover."""
    return pages.withColumn("covered", (F.col("page") == 0) & is_cover())


def replace_front(pages: DataFrame, dividers: DataFrame, book: str = "book") -> DataFrame:
    """Column replaced: pages before the book's first chapter divider, but blank ones and those that are one figure already."""
    rows = pages.join(dividers.select(book, "first_divider"), book, "left")
    front = (F.col("page") < F.col("first_divider")) & ~_yes("single_figure") & _yes("has_image") & ~_yes("blank")
    return rows.withColumn("replaced", F.coalesce(front, F.lit(False)))


def replace_design(pages: DataFrame) -> DataFrame:
    """Column replaced: pages full of ink; run it after the contents are taken, as their headings vanish."""
    return pages.withColumn("replaced", ~_yes("single_figure") & is_cover())


def route(mode: Column | str, needed: Column | str, has_key: Column | str) -> Column:
    """Whether recognition runs: asked for, or automatic where it is needed and there is a key."""
    mode, needed, has_key = (F.col(c) if isinstance(c, str) else c for c in (mode, needed, has_key))
    return (mode == "api") | ((mode == "auto") & needed & has_key)


def rebase(index: Column | str, chunk: Column | str, size: int = 40) -> Column:
    """A page's number in the book from its number in a chunk."""
    index, chunk = (F.col(c) if isinstance(c, str) else c for c in (index, chunk))
    return chunk * size + F.coalesce(index, F.lit(0))


def union_chunks(chunks: DataFrame, index: str = "index", chunk: str = "chunk", size: int = 40) -> DataFrame:
    """The pages of all chunks of a book as one table, numbered in the book, in place of index and chunk."""
    return chunks.withColumn("page", rebase(index, chunk, size)).drop(index, chunk)


def encoded_mb(n_bytes: Column | str) -> Column:
    """Size of a request body in base64."""
    n = F.col(n_bytes) if isinstance(n_bytes, str) else n_bytes
    return n * 4 / 3 / (1 << 20)


def page_ranges(specs: DataFrame, spec: str, n_pages: Column | str, keys: tuple[str, ...]) -> DataFrame:
    """Pages (from 0) that '3,7-12' asks for, each once, those that the book has."""
    n = F.col(n_pages) if isinstance(n_pages, str) else n_pages
    part = F.btrim(F.col("part"), F.lit(" "))
    first, last = F.regexp_extract(part, "^([0-9]+)", 1), F.regexp_extract(part, "^[0-9]+-([0-9]+)$", 1)
    rows = specs.select(*keys, n.alias("_n"), F.explode(F.split(spec, ",")).alias("part")).where(part.rlike("^[0-9]+(-[0-9]+)?$"))
    rows = rows.select(*keys, "_n", F.greatest(first.cast("bigint"), F.lit(1)).alias("a"), F.least(F.when(last != "", last).otherwise(first).cast("bigint"), F.col("_n")).alias("b")).where("a <= b")
    return rows.select(*keys, F.explode(F.sequence(F.col("a") - 1, F.col("b") - 1)).alias("page")).distinct()
