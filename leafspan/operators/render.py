"""XHTML of pages and chapters from typed blocks.

A page is an ordered array of blocks (block_type, text, level, image_path, bg).  Its
tint runs cut it into slices; captions pair and lists group within a slice only; a
tinted slice becomes an aside in its colour.  Pages follow each other; nothing is
joined across a page's edge.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import text as T
from ..functions.geometry import accent, hex_colour, let
from .runs import caption_pairs, tint_runs

_STATE = "array<struct<list:boolean,ordered:boolean,html:string>>"


def _filled(b: Column) -> Column:
    """Whether a block has what a caption would describe."""
    text = T.strip(F.coalesce(b["text"], F.lit(""))) != ""
    image = b["image_path"].isNotNull()
    return F.when(b["block_type"] == "figure", image).when(b["block_type"] == "table", image | text).when(b["block_type"] == "code", text).otherwise(True)


def _table(b: Column, caption: Column) -> Column:
    source = F.concat(F.lit('<img src="images/'), b["image_path"], F.lit('" alt="표"/>'))
    picture = F.when(caption != "", F.concat(F.lit("<table><caption>"), T.to_xhtml(caption), F.lit("</caption><tr><td>"), source, F.lit("</td></tr></table>"))).otherwise(F.concat(F.lit('<div class="table-img">'), source, F.lit("</div>")))
    return F.when(b["image_path"].isNotNull(), picture).otherwise(T.table_html(F.coalesce(b["text"], F.lit("")), caption))


def _paragraphs(text: Column) -> Column:
    return F.array_join(F.transform(T.paragraphs(text), lambda p: F.concat(F.lit("<p>"), T.to_xhtml(p), F.lit("</p>"))), "\n")


def _alone(b: Column, caption: Column, has_caption: Column) -> Column:
    """One block, with its caption if it has one; empty where there is nothing to show."""
    text = T.strip(F.coalesce(b["text"], F.lit("")))
    kind = b["block_type"]
    wrap = lambda before, x, after: F.concat(F.lit(before), x, F.lit(after))
    tag = T.heading_tag(F.coalesce(b["level"], F.lit(0)))
    code = F.when(has_caption, T.listing_html(F.coalesce(b["text"], F.lit("")), caption)).otherwise(T.code_html(F.coalesce(b["text"], F.lit(""))))
    merged = T.merge_lines(F.coalesce(b["text"], F.lit("")))
    shown = (
        F.when(kind == "heading", F.when(text != "", F.concat(F.lit("<"), tag, F.lit(">"), T.to_xhtml(text), F.lit("</"), tag, F.lit(">"))))
        .when(kind == "paragraph", _paragraphs(text))
        .when(kind == "code", F.when(text != "", code))
        .when(kind == "aside", F.when(text != "", wrap('<aside class="memo">\n', _paragraphs(text), "\n</aside>")))
        .when(kind == "figure", F.when(b["image_path"].isNotNull(), T.figure_html(b["image_path"], caption)))
        .when(kind == "table", F.when(b["image_path"].isNotNull() | (text != ""), _table(b, caption)))
        .when(kind == "formula", F.when(b["image_path"].isNotNull(), wrap('<div class="formula"><img src="images/', b["image_path"], '" alt="수식"/></div>')))
        .when(kind == "caption", F.when(merged != "", wrap('<p class="caption">', T.to_xhtml(merged), "</p>")))
        .when(kind == "footnote", F.when(merged != "", wrap('<div class="footnote"><p>', T.to_xhtml(merged), "</p></div>")))
    )
    return F.coalesce(shown, F.lit(""))


def _list_items(done: Column, block: Column) -> Column:
    """The block's lines appended to the list that is open, or to new ones where the marker changes."""
    def add(state: Column, line: Column) -> Column:
        return let(T.list_item(line), lambda item: let(F.try_element_at(state, F.lit(-1)), lambda last: F.when(item["text"] == "", state).when(
            F.coalesce(last["list"] & (last["ordered"] == item["numbered"]), F.lit(False)),
            F.concat(F.slice(state, 1, F.greatest(F.size(state) - 1, F.lit(0))), F.array(F.struct(F.lit(True).alias("list"), item["numbered"].alias("ordered"), F.concat(last["html"], F.lit("\n<li>"), T.to_xhtml(item["text"]), F.lit("</li>")).alias("html"))))
        ).otherwise(F.concat(state, F.array(F.struct(F.lit(True).alias("list"), item["numbered"].alias("ordered"), F.concat(
            F.when(~item["numbered"], "<ul>").when(item["number"] == 1, "<ol>").otherwise(F.concat(F.lit('<ol start="'), item["number"].cast("string"), F.lit('">'))), F.lit("\n<li>"), T.to_xhtml(item["text"]), F.lit("</li>")).alias("html")))))))

    lines = F.filter(F.transform(F.split(F.coalesce(block["text"], F.lit("")), "\n"), T.strip), lambda x: x != "")
    return F.aggregate(lines, done, add)


def render_blocks(blocks: Column) -> Column:
    """XHTML of a slice of a page."""
    pairs = caption_pairs(F.transform(blocks, lambda b: F.struct(b["block_type"].alias("block_type"), _filled(b).alias("filled"))))

    def step(done: Column, pair: Column) -> Column:
        block = F.get(blocks, pair["at"])
        caption = F.coalesce(T.merge_lines(F.coalesce(F.get(blocks, pair["caption_at"])["text"], F.lit(""))), F.lit(""))
        html = _alone(block, caption, pair["caption_at"].isNotNull())
        # a block that shows nothing still ends a list, as any other block does
        one = F.struct(F.lit(False).alias("list"), F.lit(False).alias("ordered"), html.alias("html"))
        return F.when(block["block_type"] == "list_item", _list_items(done, block)).otherwise(F.concat(done, F.array(one)))

    parts = F.aggregate(pairs, F.array().cast(_STATE), step)
    closed = F.transform(parts, lambda p: F.when(p["list"], F.concat(p["html"], F.when(p["ordered"], "\n</ol>").otherwise("\n</ul>"))).otherwise(p["html"]))
    return F.array_join(F.filter(closed, lambda h: h != ""), "\n")


def render_page(blocks: Column) -> Column:
    """XHTML of a page: tinted runs as asides, what lies between them plain."""
    def cut(runs: Column) -> Column:
        """Slices (start, end, run) that cover the page."""
        none = F.lit(None).cast("struct<start:bigint,end:bigint,r:int,g:int,b:int>")
        slice_ = lambda s, e, r: F.struct(s.cast("bigint").alias("start"), e.cast("bigint").alias("end"), r.alias("run"))
        before = F.transform(runs, lambda r, i: slice_(F.when(i == 0, F.lit(0)).otherwise(F.get(runs, i - 1)["end"]), r["start"], none))
        last = F.array(slice_(F.coalesce(F.try_element_at(runs, F.lit(-1))["end"], F.lit(0)), F.size(blocks), none))
        own = F.transform(runs, lambda r: slice_(r["start"], r["end"], r))
        return F.array_sort(F.filter(F.concat(before, own, last), lambda s: s["start"] < s["end"]))

    def one(s: Column) -> Column:
        inner = render_blocks(F.slice(blocks, (s["start"] + 1).cast("int"), (s["end"] - s["start"]).cast("int")))
        run = s["run"]
        strong = let(accent(run["r"], run["g"], run["b"]), lambda a: hex_colour(a["r"], a["g"], a["b"]))
        opening = F.concat(F.lit('<aside class="tinted" style="background-color:'), hex_colour(run["r"], run["g"], run["b"]), F.lit(";border-left-color:"), strong, F.lit('">\n'))
        return let(inner, lambda h: F.when(run.isNull() | (h == ""), h).otherwise(F.concat(opening, h, F.lit("\n</aside>"))))

    pages = let(tint_runs(blocks), lambda runs: F.transform(cut(runs), one))
    return F.array_join(F.filter(pages, lambda h: h != ""), "\n")


def render_chapters(blocks: DataFrame, held: DataFrame, book: str = "book") -> DataFrame:
    """(book, chapter, title, body) from blocks (book, page, idx, block_type, text, level, image_path, bg) and the chapter that holds each page."""
    block = F.struct("idx", "block_type", "text", "level", "image_path", "bg")
    pages = blocks.groupBy(book, "page").agg(F.array_sort(F.collect_list(block)).alias("blocks")).select(book, "page", render_page(F.col("blocks")).alias("html"))
    rows = pages.where("html <> ''").join(held, [book, "page"])
    body = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("page", "html"))), lambda p: p["html"]), "\n")
    return rows.groupBy(book, "chapter", "title").agg(body.alias("body"))


def covers(blocks: DataFrame, held: DataFrame, book: str = "book") -> DataFrame:
    """(book, image_path) of books whose first chapter's first page begins with a picture."""
    first = blocks.join(held.where("chapter = 0"), [book, "page"]).groupBy(book).agg(F.min_by(F.struct("block_type", "image_path"), F.struct("page", "idx")).alias("b"))
    return first.where("b.block_type = 'figure' and b.image_path is not null").select(book, "b.image_path")
