"""Lines matched to the boxes they lie in.

The join is on the page, with the geometry as a further condition: pages bound how
many lines and boxes meet.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.geometry import area


def match_lines(blocks: DataFrame, lines: DataFrame, page: str = "page") -> DataFrame:
    """Pairs of a line and a block whose box holds the line's centre, edges included."""
    x, y = (F.col("line_x0") + F.col("line_x1")) / 2, (F.col("line_y0") + F.col("line_y1")) / 2
    inside = (x >= F.col("x0")) & (x <= F.col("x1")) & (y >= F.col("y0")) & (y <= F.col("y1"))
    return blocks.join(lines, page).where(inside)


def own_lines(blocks: DataFrame, lines: DataFrame, page: str = "page") -> DataFrame:
    """Blocks with the text of their own lines: a line belongs to the smallest box around it, ties to the first."""
    rank = F.row_number().over(Window.partitionBy(page, "line_idx").orderBy(area("x0", "y0", "x1", "y1"), "block_idx"))
    owned = match_lines(blocks, lines, page).withColumn("_rank", rank).where("_rank = 1")
    text = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("line_idx", "line_text"))), lambda s: s["line_text"]), "\n")
    found = owned.groupBy(page, "block_idx").agg(text.alias("text"), F.count("*").alias("n_lines"))
    return blocks.join(found, [page, "block_idx"], "left").withColumns({"text": F.coalesce("text", F.lit("")), "n_lines": F.coalesce("n_lines", F.lit(0))})


def reading_order(blocks: DataFrame, page: str = "page") -> DataFrame:
    """Blocks numbered from the top, then from the left, then as they came."""
    return blocks.withColumn("position", F.row_number().over(Window.partitionBy(page).orderBy("y0", "x0", "block_idx")) - 1)
