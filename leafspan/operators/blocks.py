"""From recorded pages to typed blocks, and from text layers to blocks."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text as T

#: Types of recognised blocks and of local layout labels; fixed values.
RECOGNISED = {
    "text": "paragraph", "title": "heading", "list": "list_item", "table": "table", "image": "figure", "equation": "formula", "caption": "caption", "code": "code",
    "references": "footnote", "aside_text": "aside", "header": "page_header", "footer": "page_footer", "signature": "figure",
}
LAYOUT = {
    "Text": "paragraph", "Section-header": "heading", "Title": "heading", "Figure": "figure", "Picture": "figure", "Table": "table", "Formula": "formula", "Caption": "caption",
    "Footnote": "footnote", "Page-header": "page_header", "Page-footer": "page_footer", "List-item": "list_item", "Text-inline-math": "paragraph", "Handwriting": "paragraph",
    "Form": "paragraph", "Table-of-contents": "paragraph",
}
CROPPED = ("figure", "formula")
TINTED = ("heading", "paragraph", "list_item", "code", "caption")
HIDDEN = ("page_header", "page_footer")
REFINED = ("caption", "footnote")
IMAGE_PAGE = 50

#: Schema of one recorded page.
PAGE_SCHEMA = """index INT, markdown STRING, dimensions STRUCT<dpi:INT,height:INT,width:INT>,
blocks ARRAY<STRUCT<top_left_x:DOUBLE,top_left_y:DOUBLE,bottom_right_x:DOUBLE,bottom_right_y:DOUBLE,content:STRING,type:STRING,image_id:STRING>>"""


def block_type(name: Column | str, table: dict[str, str] = RECOGNISED) -> Column:
    """The type of a recognised name; unknown names are paragraphs."""
    known = F.create_map(*(F.lit(x) for pair in table.items() for x in pair))
    return F.coalesce(F.try_element_at(known, T.col(name)), F.lit("paragraph"))


def blocks_from_pages(pages: DataFrame, page: Column, keys: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """Blocks of recorded pages (a struct of PAGE_SCHEMA), in their recorded order.

    Blocks without content, lone characters, and pictures without an image are
    dropped; missing or broken coordinates are zeros.  Positions count what is left.
    """
    rows = pages.select(*keys, page.alias("_page"))
    rows = rows.select(*keys, F.coalesce(F.col("_page.index"), F.lit(0)).alias("page"), F.posexplode("_page.blocks").alias("raw_idx", "raw"))
    kind, content = block_type(F.col("raw.type")), T.strip(F.coalesce(F.col("raw.content"), F.lit("")))
    head = T.heading(content)
    corner = lambda c: F.coalesce(F.col(f"raw.{c}"), F.lit(0.0))
    broken = F.col("raw.top_left_x").isNull() | F.col("raw.top_left_y").isNull() | F.col("raw.bottom_right_x").isNull() | F.col("raw.bottom_right_y").isNull()
    cropped = kind.isin(*CROPPED)
    box = lambda c: F.when(cropped | broken, 0.0).otherwise(corner(c))
    rows = rows.where(F.when(cropped, F.col("raw.image_id").isNotNull()).otherwise((content != "") & ~T.is_noise(head["title"])))
    return rows.select(*keys, "page", F.col("raw_idx").cast("bigint").alias("raw_idx"), kind.alias("block_type"), box("top_left_x").alias("x0"), box("top_left_y").alias("y0"), box("bottom_right_x").alias("x1"), box("bottom_right_y").alias("y1"),
                       F.when(cropped, "").when(kind == "heading", head["title"]).otherwise(content).alias("text"), F.when(kind == "heading", head["level"]).otherwise(0).cast("bigint").alias("level"), F.when(cropped, F.col("raw.image_id")).alias("image_path"))


#: Elements of a web page that make blocks, and their recognised names.
HTML_TYPES = {"h1": "title", "p": "text", "li": "list", "div": "aside_text", "nav": "header", "footer": "footer"}


def blocks_from_html(pages: DataFrame, html: str = "html", keys: tuple[str, ...] = ("page_id",)) -> DataFrame:
    """Blocks of web pages: headings, paragraphs, list items, asides; each runs to the next block mark, however the page closes it."""
    body = F.regexp_replace(F.col(html), r"(?s)<!--.*?-->|<(script|style)[^>]*>.*?</\1>|<title>.*?</title>", "")
    pieces = F.regexp_extract_all(body, F.lit(r"<(?:h1|p|li|div class=\"ad\"|nav|footer)>[^<]*(?:<(?:b|br|a|i|em|strong|/b|/a|/i|/em|/strong)\b[^>]*>[^<]*)*"), F.lit(0))
    rows = pages.select(*keys, F.posexplode(pieces).alias("raw_idx", "piece"))
    tag = F.regexp_extract("piece", "^<([a-z0-9]+)", 1)
    known = F.create_map(*(F.lit(x) for pair in HTML_TYPES.items() for x in pair))
    text = F.regexp_replace(F.col("piece"), "<[^>]*>", " ")
    for entity, plain in (("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&amp;", "&")):
        text = F.replace(text, F.lit(entity), F.lit(plain))
    text = T.strip(F.regexp_replace(text, "[ \t\n\r\f\u000B]+", " "))
    rows = rows.select(*keys, F.col("raw_idx").cast("bigint").alias("raw_idx"), F.try_element_at(known, tag).alias("raw_type"), text.alias("text"))
    return rows.where((F.col("text") != "") & ~T.is_noise("text")).withColumn("block_type", block_type("raw_type"))


def text_layer(lines: Column) -> Column:
    """Lines of a text block without page numbers, lone bullets joined to the next line."""
    return T.merge_bullets(T.drop_page_numbers(lines))


def page_route(pages: DataFrame, book: str = "book", text: str = "text") -> DataFrame:
    """Per book: pages, characters, pages that are images, and whether recognition is needed (mean under IMAGE_PAGE)."""
    n = F.length(T.strip(F.coalesce(F.col(text), F.lit(""))))
    return pages.groupBy(book).agg(F.count("*").alias("n_pages"), F.sum(n).cast("bigint").alias("n_chars"), F.count_if(n < IMAGE_PAGE).alias("image_pages"), (F.coalesce(F.avg(n), F.lit(0.0)) < IMAGE_PAGE).alias("ocr_needed"))


def type_ranking(blocks: DataFrame, *order: str, kind: str = "block_type") -> DataFrame:
    """Counts by type with their rank: the most frequent first, of equal ones the one seen first in ``order``."""
    found = blocks.groupBy(kind).agg(F.count("*").alias("n"), F.min(F.struct(*order)).alias("_first"))
    return found.withColumn("rank", F.row_number().over(Window.orderBy(F.desc("n"), "_first")).cast("bigint")).drop("_first")  # one row a type


def layer_blocks(pages: DataFrame, texts: DataFrame, figures: DataFrame, book: str = "book") -> DataFrame:
    """Blocks of a text layer in reading order: book, page, idx, block_type, x0, y0, x1, y1, text, image.

    ``pages`` has text and has_image, ``texts`` idx, box and text, ``figures`` idx, box
    and image (null where it could not be read; such figures are left out).  A page of
    fewer than IMAGE_PAGE characters that has an image becomes that image alone.  Other
    pages' texts lose page numbers and lone bullets, blank ones vanish, and texts and
    figures merge by y0; equal ones keep texts before figures and their own order.
    """
    few = F.length(T.strip(F.coalesce(F.col("text"), F.lit("")))) < IMAGE_PAGE
    whole = pages.where(few & F.coalesce(F.col("has_image"), F.lit(False))).select(book, "page").distinct()
    box = ["x0", "y0", "x1", "y1"]
    cleaned = F.array_join(text_layer(F.split(F.coalesce(F.col("text"), F.lit("")), "\n")), "\n")
    own = texts.select(book, "page", *box, F.lit(0).alias("_kind"), "idx", cleaned.alias("text"), F.lit(None).cast("string").alias("image")).where(T.strip("text") != "")
    drawn = figures.where("image is not null").select(book, "page", *box, F.lit(1).alias("_kind"), "idx", F.lit("").alias("text"), "image")
    merged = own.unionByName(drawn).join(whole, [book, "page"], "left_anti").join(pages.select(book, "page").distinct(), [book, "page"], "left_semi")
    place = F.row_number().over(Window.partitionBy(book, "page").orderBy("y0", "_kind", "idx")) - 1
    merged = merged.withColumn("idx", place.cast("bigint")).select(book, "page", "idx", F.when(F.col("_kind") == 0, "paragraph").otherwise("figure").alias("block_type"), *box, "text", "image")
    picture = whole.select(book, "page", F.lit(0).cast("bigint").alias("idx"), F.lit("figure").alias("block_type"), *(F.lit(0.0).alias(c) for c in box), F.lit("").alias("text"), F.format_string("page_%04d_full.png", F.col("page")).alias("image"))
    return merged.unionByName(picture)


def type_histogram(blocks: DataFrame, page: str, kind: str = "block_type") -> DataFrame:
    """Counts by page and type, and by type alone (page null)."""
    return blocks.groupingSets([[page, kind], [kind]], page, kind).agg(F.count("*").alias("n"))
