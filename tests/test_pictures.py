import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from leafspan.operators import pictures
from leafspan.sources import png


def _page():
    """A page with a figure at (60, 60)-(140, 120) and a tinted box below it."""
    rgb = np.full((300, 200, 3), 255, np.int16)
    rgb[60:120, 60:140] = 40
    rgb[200:240, 20:180] = (200, 215, 230)
    rgb[215:220, 40:100] = 20
    return rgb


def _by_hand(kinds, samples):
    """Filtered rows of an image, sample by sample."""
    height, width, n = samples.shape
    out = bytearray()
    for y in range(height):
        out.append(kinds[y])
        for x in range(width):
            for c in range(n):
                left = int(samples[y, x - 1, c]) if x else 0
                above = int(samples[y - 1, x, c]) if y else 0
                corner = int(samples[y - 1, x - 1, c]) if x and y else 0
                p = left + above - corner
                nearest = min((abs(p - left), 0, left), (abs(p - above), 1, above), (abs(p - corner), 2, corner))[2]
                out.append((int(samples[y, x, c]) - (0, left, above, (left + above) // 2, nearest)[kinds[y]]) % 256)
    return bytes(out)


def _file(kind, samples, kinds, **extra):
    height, width = samples.shape[:2]
    head = width.to_bytes(4, "big") + height.to_bytes(4, "big") + bytes([8, kind, 0, 0, 0])
    others = b"".join(png._chunk(name.encode(), body) for name, body in extra.items())
    return png.SIGNATURE + png._chunk(b"IHDR", head) + others + png._chunk(b"IDAT", zlib.compress(_by_hand(kinds, samples))) + png._chunk(b"IEND", b"")


@pytest.mark.parametrize("kind,n", [(0, 1), (2, 3), (4, 2), (6, 4)])
def test_all_filters_and_colour_types_are_read(kind, n):
    rng = np.random.default_rng(kind)
    samples = rng.integers(0, 256, (11, 7, n)).astype(np.uint8)
    got = png.decode(_file(kind, samples, [y % 5 for y in range(11)]))
    colours = np.repeat(samples[:, :, :1], 3, axis=2) if n < 3 else samples[:, :, :3]
    alpha = samples[:, :, -1:] / 255 if n in (2, 4) else np.ones((11, 7, 1))
    assert (got == np.rint(colours * alpha + 255 * (1 - alpha))).all()


def test_palettes_are_read():
    samples = np.array([[[0], [1]], [[1], [0]]], np.uint8)
    got = png.decode(_file(3, samples, [0, 4], PLTE=bytes([9, 8, 7, 1, 2, 3]), tRNS=bytes([0])))
    assert got[0, 0].tolist() == [255, 255, 255] and got[0, 1].tolist() == [1, 2, 3]
    with pytest.raises(ValueError):
        png.decode(_file(3, samples, [0, 0], PLTE=bytes([9, 8, 7])))


def test_images_go_there_and_back_and_broken_ones_are_told():
    page = _page()
    data = png.encode(page)
    assert (png.decode(data) == page).all()
    for bad in (b"", b"no image", data[:60], data[:50] + b"\0" + data[51:], data[:-12]):
        with pytest.raises(ValueError):
            png.decode(bad)


def test_crops_and_backgrounds_of_arrays():
    page = _page()
    assert pictures.crop_box(page, (62, 62, 138, 118)) is not None
    x0, y0, x1, y1 = pictures.crop_box(page, (62, 62, 138, 118))
    assert x0 <= 60 and y0 <= 60 and x1 >= 140 and y1 >= 120  # the box was too small
    assert pictures.crop_box(page, (500, 500, 600, 600)) is None
    assert pictures.background(page, (20, 200, 180, 240)) == (200, 215, 230)
    assert pictures.background(page, (0, 250, 200, 300)) is None and pictures.background(page, (60, 60, 140, 120)) is None
    framed = np.full((100, 100, 3), 255, np.int16)
    framed[10:90, 10:90] = (150, 120, 230)
    framed[13:87, 13:87] = 255
    framed[45:55, 40:60] = 30
    assert pictures.crop_box(framed, (30, 40, 70, 60)) == (8, 8, 92, 92)


def _tables(spark):
    good = png.encode(_page())
    images = spark.createDataFrame([(1, 0, good, 200, 300), (1, 1, b"broken", None, None), (1, 2, None, None, None), (1, 3, png.encode(np.full((20, 20, 3), 250, np.int16)), None, None)], "book long, page long, content binary, ref_width int, ref_height int")
    box = (62.0, 62.0, 138.0, 118.0)
    rows = [(1, 0, 0, "figure", *box), (1, 0, 1, "paragraph", 20.0, 200.0, 180.0, 240.0), (1, 0, 2, "paragraph", 0.0, 250.0, 200.0, 300.0), (1, 0, 3, "formula", None, 1.0, 2.0, 3.0), (1, 0, 4, "figure", 9.0, 9.0, 5.0, 5.0), (1, 1, 0, "figure", *box), (1, 2, 0, "figure", *box), (1, 7, 0, "figure", *box)]
    return spark.createDataFrame(rows, "book long, page long, idx long, block_type string, x0 double, y0 double, x1 double, y1 double"), images


def test_crops_of_pages(spark):
    blocks, images = _tables(spark)
    found = pictures.crops(blocks, images).collect()
    assert [(r.page, r.idx, r.image) for r in found] == [(0, 0, "page_0000_blk_000.png")]
    assert png.decode(found[0].content).shape == (found[0].y1 - found[0].y0, found[0].x1 - found[0].x0, 3)
    assert [(r.idx, r.r, r.g, r.b) for r in pictures.tints(blocks, images).collect()] == [(1, 200, 215, 230)]
    assert pictures.crops(blocks.limit(0), images).count() == 0


def test_facts_come_from_blocks_and_images(spark):
    blocks, images = _tables(spark)
    looked = pictures.image_facts(images)
    assert {r.page: (r.has_image, r.blank, r.width, r.height) for r in looked.collect()} == {0: (True, False, 200, 300), 1: (False, False, 0, 0), 2: (False, False, 0, 0), 3: (True, True, 20, 20)}
    layouts = spark.range(5).select(F.lit(1).cast("long").alias("book"), F.col("id").alias("page"), (F.col("id") < 3).alias("has_layout"))
    facts = {r.page: r for r in pictures.page_facts(layouts, blocks, looked).collect()}
    assert facts[0].n_blocks == 5 and not facts[0].single_figure and 0.05 < facts[0].ink < 0.3
    assert facts[1].single_figure and not facts[1].has_image
    assert facts[3].blank and facts[3].n_blocks == 0 and facts[4].ink == 0.0 and facts[4].has_image is False


def test_books_hold_their_pictures_and_cover(spark):
    import io
    import zipfile

    from leafspan.sources import epub

    chapters = spark.createDataFrame([(1, 0, "A", "<p>x</p>"), (2, 0, "B", "<p>y</p>")], "book long, chapter long, title string, body string")
    images = spark.createDataFrame([(1, "f.png", b"1"), (1, "g.png", b"2"), (1, "h.png", None), (3, "z.png", b"3")], "book long, image string, content binary")
    covers = spark.createDataFrame([(1, "g.png"), (2, "none.png")], "book long, image_path string")
    found = {r.book: zipfile.ZipFile(io.BytesIO(bytes(r.epub))) for r in epub.build(chapters, images=images, covers=covers).collect()}
    assert set(found) == {1, 2}
    pictures_ = [n for n in found[1].namelist() if "images" in n]
    assert pictures_ == ["EPUB/images/cover_g.png", "EPUB/images/f.png", "EPUB/images/g.png"] and found[1].read(pictures_[0]) == b"2"
    package = found[1].read("EPUB/content.opf").decode()
    assert package.count("cover-image") == 1 and '<meta name="cover" content="i0"/>' in package
    assert "cover" not in found[2].read("EPUB/content.opf").decode()
    assert epub.build(chapters, images=images).count() == 2


def test_content_box_counts_shares(spark):
    from leafspan.functions import pixels

    on = [False] * 24
    on[9] = on[10] = on[17] = True  # 6 wide: rows 1 and 2
    rows = spark.createDataFrame([(on,), ([False] * 24,), ([],)], "on array<boolean>")
    whole, none, empty = (r[0] for r in rows.select(pixels.content_box(F.col("on"), 6)).collect())
    assert tuple(whole) == (3, 1, 5, 2) and none is None and empty is None
    assert tuple(rows.select(pixels.content_box(F.col("on"), 6, 0.2)).first()[0]) == (3, 1, 5, 1)
