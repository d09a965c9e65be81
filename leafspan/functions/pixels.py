"""Statistics of images held as arrays of pixels (struct r, g, b), without Python."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .frames import OCCUPANCY
from .text import col

BLANK, INK, CHROMA = 8, 235, 25
BRIGHT, BRIGHT_SHARE, WHITE, DARK = 180, 0.3, 244, 180


def _least(p: Column) -> Column:
    return F.least(p["r"], p["g"], p["b"])


def _share(pixels: Column, test) -> Column:
    return F.size(F.filter(pixels, test)) / F.size(pixels)


def largest_deviation(pixels: Column | str) -> Column:
    """The largest population standard deviation of a channel."""
    pixels = col(pixels)

    def deviation(channel: str) -> Column:
        n = F.size(pixels)
        total = F.aggregate(pixels, F.lit(0).cast("bigint"), lambda s, p: s + p[channel])
        squares = F.aggregate(pixels, F.lit(0).cast("bigint"), lambda s, p: s + p[channel].cast("bigint") * p[channel])
        return F.sqrt((squares * n - total * total) / (n.cast("double") * n))

    return F.greatest(*(deviation(c) for c in "rgb"))


def is_blank(pixels: Column | str) -> Column:
    return largest_deviation(pixels) < BLANK


def ink_coverage(pixels: Column | str) -> Column:
    return _share(col(pixels), lambda p: _least(p) < INK)


def chroma_coverage(pixels: Column | str) -> Column:
    return _share(col(pixels), lambda p: F.greatest(p["r"], p["g"], p["b"]) - _least(p) >= CHROMA)


def background(pixels: Column | str) -> Column:
    """Median colour of the bright pixels, or null where it is white, dark, or too few are bright."""
    pixels = col(pixels)
    bright = F.filter(pixels, lambda p: _least(p) > BRIGHT)

    def median(channel: str) -> Column:
        values = F.array_sort(F.transform(bright, lambda p: p[channel]))
        n = F.size(values)
        return (F.get(values, ((n - 1) / 2).cast("int")) + F.get(values, (n / 2).cast("int"))) / 2.0

    r, g, b = (median(c) for c in "rgb")
    low = F.least(r, g, b)
    good = (F.size(bright) >= BRIGHT_SHARE * F.size(pixels)) & (low <= WHITE) & (low >= DARK)
    whole = lambda v: F.bround(v, 0).cast("bigint")
    return F.when(good, F.struct(whole(r).alias("r"), whole(g).alias("g"), whole(b).alias("b")))


def content_box(on: Column, width: int, occupancy: float = OCCUPANCY) -> Column:
    """Inclusive (left, top, right, bottom) of the rows and columns of which more than a share is content; null if none is.

    ``on`` says of each pixel, row by row, whether it is content.  No pixel leaves its row of the table.
    """
    height = (F.size(on) / width).cast("int")
    across = lambda y: F.size(F.filter(F.slice(on, (y * width + 1).cast("int"), F.lit(width)), lambda p: p)) / F.lit(width)
    down = lambda x: F.size(F.filter(F.sequence(F.lit(0), height - 1), lambda y: F.get(on, (y * width + x).cast("int")))) / height
    rows = F.filter(F.sequence(F.lit(0), height - 1), lambda y: across(y) > occupancy)
    columns = F.filter(F.sequence(F.lit(0), F.lit(width - 1)), lambda x: down(x) > occupancy)
    box = F.struct(F.array_min(columns).alias("left"), F.array_min(rows).alias("top"), F.array_max(columns).alias("right"), F.array_max(rows).alias("bottom"))
    return F.when((height > 0) & (F.size(rows) > 0) & (F.size(columns) > 0), box)
