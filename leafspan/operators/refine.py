"""Small print read again: targets, their crops, and the answers written back by position."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text as T
from ..functions.geometry import padded, scale_box
from .blocks import REFINED

PAD = 6


def last_dims(dims: DataFrame, book: str = "book") -> DataFrame:
    """One row a page: the last by dim_idx, where there is such a column, else the one with the greatest sizes."""
    order = ["dim_idx"] if "dim_idx" in dims.columns else ["width", "height", "ref_width", "ref_height"]
    return dims.groupBy(book, "page").agg(F.max_by(F.struct("width", "height", "ref_width", "ref_height"), F.struct(*order)).alias("d")).select(book, "page", "d.*")


def targets(blocks: DataFrame, dims: DataFrame, book: str = "book") -> DataFrame:
    """Blocks to read again, with their crop and their ordinal in the book; dims: image and reference size by page, of several rows the last by dim_idx."""
    placed = (F.col("x0") != 0) | (F.col("y0") != 0) | (F.col("x1") != 0) | (F.col("y1") != 0)
    rows = blocks.where(F.col("block_type").isin(*REFINED) & placed).join(last_dims(dims, book), [book, "page"])
    box = scale_box("x0", "y0", "x1", "y1", "width", "height", "ref_width", "ref_height")
    rows = rows.withColumn("crop", padded(box, "width", "height", PAD)).where("crop is not null")
    return rows.withColumn("ordinal", (F.row_number().over(Window.partitionBy(book).orderBy("page", "idx")) - 1).cast("bigint"))


def write_back(found: DataFrame, answers: DataFrame, book: str = "book") -> DataFrame:
    """Targets with the answer of their ordinal as text, where it is not blank, and whether it replaced."""
    rows = found.join(answers.select(book, "ordinal", F.col("answer")), [book, "ordinal"], "left")
    new = F.nullif(T.strip(F.coalesce("answer", F.lit(""))), F.lit(""))
    return rows.withColumns({"text": F.coalesce(new, F.col("text")), "replaced": new.isNotNull()}).drop("answer")
