"""What page images give: crops of blocks, colours behind texts, facts of whole pages.

A page's image goes to Python once, with the page's blocks as an array beside it, so its
bytes are not repeated by block.  Images that are missing or cannot be read, and blocks
without coordinates or outside the image, give no crop and no colour; the rest of the
page goes on.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import frames, geometry, pixels
from ..sources import png
from .blocks import CROPPED, TINTED

PAD = 6
Box = tuple[int, int, int, int]


def inside(rgb: np.ndarray, box: Box) -> Box | None:
    """The part of a half-open box that lies on the image."""
    height, width = rgb.shape[:2]
    x0, y0, x1, y1 = max(0, box[0]), max(0, box[1]), min(width, box[2]), min(height, box[3])
    return (x0, y0, x1, y1) if x1 > x0 and y1 > y0 else None


def crop_box(rgb: np.ndarray, box: Box) -> Box | None:
    """What is cut out for a block.

    The box grows to where its content ends, by a margin, and to a frame that encloses
    it on four sides; without one, pieces of frames at its edges are taken off.
    """
    if (kept := inside(rgb, box)) is None:
        return None
    x0, y0, x1, y1 = frames.extend_to_content(rgb, kept)
    kept = inside(rgb, (x0 - PAD, y0 - PAD, x1 + PAD, y1 + PAD))
    framed = frames.expand_to_frame(rgb, kept)
    if tuple(framed) != kept:
        return tuple(framed)
    x0, y0, x1, y1 = kept
    inner, _ = frames.strip_frame(rgb[y0:y1, x0:x1])
    return x0 + inner[0], y0 + inner[1], x0 + inner[2], y0 + inner[3]


def background(rgb: np.ndarray, box: Box) -> tuple[int, int, int] | None:
    """Median colour of a box's bright pixels; none where it is white, dark, or too few are bright (as ``pixels.background``)."""
    if (kept := inside(rgb, box)) is None:
        return None
    part = rgb[kept[1] : kept[3], kept[0] : kept[2]].reshape(-1, 3)
    bright = part[part.min(axis=1) > pixels.BRIGHT]
    if not len(bright) or len(bright) < pixels.BRIGHT_SHARE * len(part):
        return None
    colour = np.median(bright, axis=0)
    return tuple(int(np.rint(c)) for c in colour) if pixels.DARK <= colour.min() <= pixels.WHITE else None


def _side(content: str, at: int) -> Column:
    """A side of a PNG, from its header."""
    return F.conv(F.hex(F.substring(content, at, 4)), 16, 10).cast("bigint")


def _with_images(blocks: DataFrame, images: DataFrame) -> DataFrame:
    """One row a page: its image, and its blocks with their boxes in the image's pixels."""
    size = [_side("content", 17), _side("content", 21)]
    block = F.struct("idx", *(F.col(c).cast("double").alias(c) for c in ("x0", "y0", "x1", "y1")))
    packed = blocks.groupBy("book", "page").agg(F.array_sort(F.collect_list(block)).alias("blocks"))
    scale = lambda b: F.struct(b["idx"].cast("bigint").alias("idx"), geometry.scale_box(b["x0"], b["y0"], b["x1"], b["y1"], *size, F.col("ref_width"), F.col("ref_height")).alias("box"))
    return packed.join(images.select("book", "page", "content", "ref_width", "ref_height"), ["book", "page"]).select("book", "page", "content", F.transform("blocks", scale).alias("blocks"))


def _each_block(rows: DataFrame, use: Callable[[np.ndarray, Box], tuple | None], schema: str) -> DataFrame:
    """(book, page, idx, *use(image, box)) of the blocks for which there is something."""
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for book, page, content, blocks in zip(batch["book"], batch["page"], batch["content"], batch["blocks"]):
                try:
                    rgb = png.decode(content) if content is not None else None
                except ValueError:
                    rgb = None
                if rgb is None:
                    continue
                out = []
                for block in blocks:
                    box = block["box"]
                    box = None if box is None or any(box[c] is None for c in ("x0", "y0", "x1", "y1")) else tuple(int(box[c]) for c in ("x0", "y0", "x1", "y1"))
                    if box is not None and box[2] > box[0] and box[3] > box[1] and (made := use(rgb, box)) is not None:
                        out.append((book, page, block["idx"], *made))
                if out:
                    yield pd.DataFrame(out, columns=[f.split()[0] for f in f"book long, page long, idx long, {schema}".split(", ")])

    return rows.mapInPandas(run, f"book long, page long, idx long, {schema}")


def crops(blocks: DataFrame, images: DataFrame) -> DataFrame:
    """(book, page, idx, image, content, x0, y0, x1, y1) of figures and formulas that can be cut from their page.

    ``blocks`` has book, page, idx, block_type and a recorded box; ``images`` one row a
    page: book, page, content (PNG) and the size that boxes refer to, ref_width and
    ref_height (null: pixels).
    """
    def cut(rgb: np.ndarray, box: Box) -> tuple | None:
        kept = crop_box(rgb, box)
        return None if kept is None else (png.encode(rgb[kept[1] : kept[3], kept[0] : kept[2]]), *kept)

    found = _each_block(_with_images(blocks.where(F.col("block_type").isin(*CROPPED)), images), cut, "content binary, x0 long, y0 long, x1 long, y1 long")
    return found.select("book", "page", "idx", F.format_string("page_%04d_blk_%03d.png", "page", "idx").alias("image"), "content", "x0", "y0", "x1", "y1")


def tints(blocks: DataFrame, images: DataFrame) -> DataFrame:
    """(book, page, idx, r, g, b) of the text blocks that stand on a colour; inputs as in ``crops``."""
    return _each_block(_with_images(blocks.where(F.col("block_type").isin(*TINTED)), images), background, "r long, g long, b long")


def image_facts(images: DataFrame) -> DataFrame:
    """(book, page, has_image, blank, ink, width, height) of page images; one that cannot be read is no image, its size 0."""
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            out = []
            for book, page, content in zip(batch["book"], batch["page"], batch["content"]):
                try:
                    rgb = png.decode(content) if content is not None else None
                except ValueError:
                    rgb = None
                if rgb is None:
                    out.append((book, page, False, False, 0.0, 0, 0))
                else:
                    flat = rgb.reshape(-1, 3)
                    out.append((book, page, True, bool(flat.std(axis=0).max() < pixels.BLANK), float((flat.min(axis=1) < pixels.INK).mean()), rgb.shape[1], rgb.shape[0]))
            yield pd.DataFrame(out, columns=["book", "page", "has_image", "blank", "ink", "width", "height"])

    return images.select(F.col("book").cast("bigint").alias("book"), F.col("page").cast("bigint").alias("page"), "content").mapInPandas(run, "book long, page long, has_image boolean, blank boolean, ink double, width long, height long")


def page_facts(layouts: DataFrame, blocks: DataFrame, images: DataFrame) -> DataFrame:
    """What the page rules look at, from the data itself.

    ``layouts`` names the pages (book, page, has_layout).  A page of exactly one block,
    a figure, is single_figure; pages without blocks have 0, pages without image facts
    no image.
    """
    counted = blocks.groupBy("book", "page").agg(F.count("*").alias("n_blocks"), ((F.count("*") == 1) & (F.max("block_type") == "figure")).alias("single_figure"))
    rows = layouts.select("book", "page", "has_layout").join(counted, ["book", "page"], "left").join(images.select("book", "page", "has_image", "blank", "ink"), ["book", "page"], "left")
    return rows.fillna({"n_blocks": 0, "single_figure": False, "has_image": False, "blank": False, "ink": 0.0})
