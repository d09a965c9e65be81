"""EPUB files from chapters, one file a book."""

from __future__ import annotations

import io
import zipfile
from xml.sax.saxutils import escape, quoteattr

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: One rule a line; colours are the reader's own but on tinted boxes, which keep the page's colour and so dark letters.
STYLE = """\
body { font-family: serif; line-height: 1.75; margin: 0 5%; word-break: keep-all; overflow-wrap: break-word; }
h1, h2, h3 { line-height: 1.3; break-after: avoid; }
h1 { font-size: 1.6em; margin: 2em 0 1em; }
h2 { font-size: 1.3em; margin: 1.5em 0 .75em; }
h3 { font-size: 1.1em; margin: 1.25em 0 .5em; }
p { margin: 0 0 1em; text-align: justify; }
figure { margin: 1.5em 0; break-inside: avoid; }
figure.figure, .table-img, .formula, .caption { text-align: center; }
img { max-width: 100%; height: auto; }
figcaption, .caption, table caption { font-size: .85em; opacity: .75; }
table { border-collapse: collapse; width: 100%; margin: 1.25em 0; break-inside: avoid; }
th, td { border: 1px solid currentColor; padding: .35em .6em; text-align: left; }
pre { white-space: pre-wrap; padding: .75em 1em; border-left: .25em solid currentColor; }
pre, code { font-family: monospace; font-size: .85em; background: rgba(0, 0, 0, .05); }
pre code { font-size: 1em; background: none; }
figure.listing pre { margin: 0; }
aside.memo { margin: 1.25em 0; padding: .75em 1em; border-left: .3em solid currentColor; background: rgba(0, 0, 0, .05); }
ul, ol { margin: .75em 0; padding-left: 1.6em; }
li { margin: .35em 0; }
sup, sub { font-size: .7em; line-height: 0; }
.footnote { margin-top: 2em; padding-top: .5em; border-top: 1px solid currentColor; font-size: .85em; }
aside.tinted { margin: 1.25em 0 1em; padding: .5em 1em; border-left: .5em solid; break-inside: avoid; }
aside.tinted, aside.tinted * { color: #222; }
aside.tinted p:last-child { margin-bottom: 0; }
@media (prefers-color-scheme: dark) { pre, code, aside.memo { background: rgba(255, 255, 255, .1); } }
"""
_HEAD = '<?xml version="1.0" encoding="utf-8"?>\n'
_FIXED = (2020, 1, 1, 0, 0, 0)


def chapter_page(title: str, body: str, language: str) -> str:
    return f'{_HEAD}<!DOCTYPE html>\n<html xmlns="http://www.w3.org/1999/xhtml" xmlns:epub="http://www.idpf.org/2007/ops" lang={quoteattr(language)} xml:lang={quoteattr(language)}>\n<head>\n<title>{escape(title)}</title>\n<link rel="stylesheet" type="text/css" href="style/default.css"/>\n</head>\n<body>\n{body}\n</body>\n</html>'


def pack(identifier: str, title: str, chapters: list[tuple[str, str]], language: str = "ko", images: dict[str, bytes] | None = None, cover: str | None = None) -> bytes:
    """An EPUB 3 file; a book without text still gets one blank chapter.  The same input gives the same bytes.

    ``cover`` names the image that is the book's cover too, under a name of its own; one that is not there is no cover.
    """
    chapters = chapters if any(body.strip() for _, body in chapters) else [(title, "<p> </p>")]
    images, front = dict(images or {}), ""
    if cover in images:
        images[f"cover_{cover}"] = images[cover]
        front = f"cover_{cover}"
    files = [f"chapter_{i + 1:03d}.xhtml" for i in range(len(chapters))]
    items = "".join(f'<item id="c{i}" href="{f}" media-type="application/xhtml+xml"/>' for i, f in enumerate(files)) + "".join(f'<item id="i{i}" href="images/{escape(n)}" media-type="image/png"{' properties="cover-image"' if n == front else ""}/>' for i, n in enumerate(sorted(images)))
    meta = f'<meta name="cover" content="i{sorted(images).index(front)}"/>' if front else ""
    spine = "".join(f'<itemref idref="c{i}"/>' for i in range(len(files)))
    entries = "".join(f'<li><a href="{f}">{escape(t)}</a></li>' for f, (t, _) in zip(files, chapters))
    points = "".join(f'<navPoint id="n{i}" playOrder="{i + 1}"><navLabel><text>{escape(t)}</text></navLabel><content src="{f}"/></navPoint>' for i, (f, (t, _)) in enumerate(zip(files, chapters)))
    parts = {
        "META-INF/container.xml": f'{_HEAD}<container version="1.0" xmlns="urn:oasis:names:tc:opendocument:xmlns:container"><rootfiles><rootfile full-path="EPUB/content.opf" media-type="application/oebps-package+xml"/></rootfiles></container>',
        "EPUB/content.opf": f'{_HEAD}<package xmlns="http://www.idpf.org/2007/opf" version="3.0" unique-identifier="id"><metadata xmlns:dc="http://purl.org/dc/elements/1.1/"><dc:identifier id="id">{escape(identifier)}</dc:identifier><dc:title>{escape(title)}</dc:title><dc:language>{escape(language)}</dc:language><meta property="dcterms:modified">2020-01-01T00:00:00Z</meta>{meta}</metadata><manifest><item id="nav" href="nav.xhtml" media-type="application/xhtml+xml" properties="nav"/><item id="ncx" href="toc.ncx" media-type="application/x-dtbncx+xml"/><item id="css" href="style/default.css" media-type="text/css"/>{items}</manifest><spine toc="ncx">{spine}</spine></package>',
        "EPUB/nav.xhtml": f'{_HEAD}<html xmlns="http://www.w3.org/1999/xhtml" xmlns:epub="http://www.idpf.org/2007/ops"><head><title>{escape(title)}</title></head><body><nav epub:type="toc"><ol>{entries}</ol></nav></body></html>',
        "EPUB/toc.ncx": f'{_HEAD}<ncx xmlns="http://www.daisy.org/z3986/2005/ncx/" version="2005-1"><head><meta name="dtb:uid" content={quoteattr(identifier)}/></head><docTitle><text>{escape(title)}</text></docTitle><navMap>{points}</navMap></ncx>',
        "EPUB/style/default.css": STYLE,
        **{f"EPUB/{f}": chapter_page(t, b, language) for f, (t, b) in zip(files, chapters)},
    }
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w") as z:
        z.writestr(zipfile.ZipInfo("mimetype", _FIXED), b"application/epub+zip", zipfile.ZIP_STORED)
        for name, body in [*parts.items(), *((f"EPUB/images/{n}", b) for n, b in sorted(images.items()))]:
            z.writestr(zipfile.ZipInfo(name, _FIXED), body, zipfile.ZIP_DEFLATED)
    return out.getvalue()


def build(chapters: DataFrame, language: str = "ko", images: DataFrame | None = None, covers: DataFrame | None = None) -> DataFrame:
    """(book, n_chapters, epub) from rows (book, chapter, title, body); a book is one file and fits one task.

    ``images`` has the books' pictures (book, image, content), ``covers`` the picture
    that is a book's cover (book, image_path).  Pictures without content and those of
    books without chapters are left out.
    """
    def one(book: int, rows: pd.DataFrame, pictures: dict[str, bytes], cover: str | None) -> pd.DataFrame:
        rows = rows.sort_values("chapter")
        return pd.DataFrame([(book, len(rows), pack(f"book-{book}", f"Book {book}", list(zip(rows["title"], rows["body"])), language, pictures, cover))], columns=["book", "n_chapters", "epub"])

    kind = "book long, n_chapters long, epub binary"
    if images is None:
        return chapters.groupBy("book").applyInPandas(lambda rows: one(rows["book"].iloc[0], rows, {}, None), kind)
    held = images.where("content is not null").select("book", "image", "content")
    if covers is None:
        held = held.withColumn("cover", F.lit(False))
    else:
        held = held.join(covers.select("book", F.col("image_path").alias("image"), F.lit(True).alias("cover")).distinct(), ["book", "image"], "left")

    def both(rows: pd.DataFrame, own: pd.DataFrame) -> pd.DataFrame:
        if rows.empty:
            return pd.DataFrame({"book": [], "n_chapters": [], "epub": []})
        covers = own["image"][own["cover"].eq(True)]
        return one(rows["book"].iloc[0], rows, dict(zip(own["image"], own["content"])), covers.iloc[0] if len(covers) else None)

    return chapters.groupBy("book").cogroup(held.groupBy("book")).applyInPandas(both, kind)
