"""Facts about single rules."""

import io
import zipfile

import numpy as np
import pytest
from pyspark.sql import functions as F

from leafspan.functions import frames, geometry, pixels
from leafspan.functions import text as T
from leafspan.operators import blocks, jobs, pages, runs, spatial, toc


def one(spark, column, **values):
    row = spark.createDataFrame([tuple(values.values())], ", ".join(f"{k} {t}" for k, t in ((k, "string" if isinstance(v, str) or v is None else "double" if isinstance(v, float) else "long") for k, v in values.items()))) if values else spark.range(1)
    return row.select(column.alias("x")).first()["x"]


@pytest.mark.parametrize("text,level,title", [("## Title", 2, "Title"), ("#Title", 0, "#Title"), ("####### x", 0, "####### x"), ("# a\nb", 1, "a\nb"), ("plain", 0, "plain")])
def test_heading(spark, text, level, title):
    assert tuple(one(spark, T.heading("t"), t=text)) == (level, title)


@pytest.mark.parametrize("text,html", [
    ("**b** and *i*", "<strong>b</strong> and <em>i</em>"), ("note$^{5}$", "note<sup>5</sup>"), ("x$^2$", "x<sup>2</sup>"), ("a$_{i}$", "a<sub>i</sub>"), ("$x+y$", "x+y"), ("`c*d*`", "<code>c<em>d</em></code>"),
    ("a < b & \"c\"", "a &lt; b &amp; &quot;c&quot;"), ("**open", "**open"), ("snake_case_name", "snake_case_name"), ("$5", "$5"), ("it's", "it's")])
def test_inline(spark, text, html):
    assert one(spark, T.to_xhtml("t"), t=text) == html


@pytest.mark.parametrize("before,after,both", [("HttpClient ", "는 소켓", "HttpClient는 소켓"), ("a", "서버는", "a 서버는"), ("a", "는", "a는"), ("a ", " b", "a b")])
def test_merge_text(spark, before, after, both):
    assert one(spark, T.merge_text("a", "b"), a=before, b=after) == both


def test_paragraphs(spark):
    assert one(spark, T.paragraphs("t"), t="a\nb\n \nc\n\n\n는 d") == ["a b", "c", "는 d"]
    assert one(spark, T.paragraphs("t"), t="") == []
    assert one(spark, T.merge_lines("t"), t="a\n\n b \n는 c") == "a b는 c"


@pytest.mark.parametrize("text,item", [("7. x", ("x", True, 7)), ("3) y", ("y", True, 3)), ("- z", ("z", False, None)), ("• z", ("z", False, None)), ("1.x", ("1.x", False, None))])
def test_list_item(spark, text, item):
    assert tuple(one(spark, T.list_item("t"), t=text)) == item


def test_bullets_fold(spark):
    assert one(spark, T.merge_bullets(F.split("t", "\n")), t="•\n•\nx") == ["• •", "x"]
    assert one(spark, blocks.text_layer(F.split("t", "\n")), t=" • \n12\nitem\n \nnext") == ["• item", "next"]


def test_fences_and_tables(spark):
    assert one(spark, T.strip_code_fence("t"), t="```py\nx\n```") == "x"
    assert one(spark, T.strip_code_fence("t"), t="```\nx") == "```\nx"
    assert one(spark, T.table_html("t"), t="| a | b |\n|---|---|\n| **c** | |") == "<table><tr><th>a</th><th>b</th></tr><tr><td><strong>c</strong></td><td></td></tr></table>"
    assert one(spark, T.table_html("t"), t="no <table>") == "<pre>no &lt;table&gt;</pre>"


def test_titles_and_names(spark):
    assert len(one(spark, T.clip_title("t"), t="x" * 101)) == 100 and one(spark, T.clip_title("t"), t="x" * 100) == "x" * 100
    assert one(spark, T.safe_filename("t", F.lit("job")), t="a/b: 책?") == "ab 책"
    assert one(spark, T.safe_filename("t", F.lit("job")), t="??") == "job"


@pytest.mark.parametrize("text,noise", [("B", True), ("그", False), ("7", False), ("IP", False), (" ◆ ", True), ("", False)])
def test_noise(spark, text, noise):
    assert one(spark, T.is_noise("t"), t=text) is noise


def test_scale_box(spark):
    box = geometry.scale_box("a", "b", "c", "d", F.lit(1000), F.lit(2000), F.lit(None).cast("int"), F.lit(None).cast("int"))
    assert tuple(one(spark, box, a=0.1, b=0.2, c=0.5, d=0.9)) == (100, 400, 500, 1800)
    box = geometry.scale_box("a", "b", "c", "d", F.lit(1000), F.lit(2000), F.lit(500), F.lit(0))
    assert tuple(one(spark, box, a=10.0, b=20.0, c=30.7, d=40.0)) == (20, 20, 61, 40)


def test_colours(spark):
    grey = geometry.accent(F.lit(200), F.lit(200), F.lit(200))
    assert len(set(one(spark, grey))) == 1
    assert one(spark, geometry.hex_colour(F.lit(1), F.lit(255), F.lit(16))) == "#01ff10"


def test_block_types(spark):
    assert [one(spark, blocks.block_type("t"), t=k) for k in ("title", "references", "signature", "new", "")] == ["heading", "footnote", "figure", "paragraph", "paragraph"]
    assert one(spark, blocks.block_type("t", blocks.LAYOUT), t="Section-header") == "heading"


def test_tint_anchor_and_paper(spark):
    px = lambda r: None if r is None else (r, r, r)
    kind = "blocks array<struct<block_type:string,bg:struct<r:int,g:int,b:int>>>"
    of = lambda *tones: [tuple(x)[:3] for x in spark.createDataFrame([([("paragraph", px(t)) for t in tones],)], kind).select(runs.tint_runs(F.col("blocks")).alias("x")).first()["x"]]
    assert [(s, e) for s, e, _ in of(0, 5, 9, 14, 30)] == [(0, 2), (2, 4), (4, 5)]
    assert of(5, 6, 7) == []
    assert [(s, e) for s, e, _ in of(5, None, 5)] == [(0, 1), (2, 3)]


def test_caption_pairs(spark):
    kind = "blocks array<struct<block_type:string,filled:boolean>>"
    names = {"F": "figure", "C": "caption", "T": "table", "K": "code", "P": "paragraph"}
    of = lambda s: [(x["kind"], x["at"], x["caption_at"]) for x in spark.createDataFrame([([(names[c.upper()], c.isupper()) for c in s],)], kind).select(runs.caption_pairs(F.col("blocks")).alias("x")).first()["x"]]
    assert of("CFC") == [("figure", 1, 0), ("caption", 2, None)]
    assert of("FC") == [("figure", 0, 1)]
    assert of("CT") == [("table", 1, 0)] and of("CK") == [("code", 1, 0)] and of("Ct") == [("caption", 0, None), ("table", 1, None)]
    assert of("fC") == [("empty figure", 0, None), ("caption", 1, None)]


def test_list_runs_break_where_the_kind_flips(spark):
    rows = spark.createDataFrame([(1, i, t) for i, t in enumerate(["- a", "- b", "7. c", " ", "8. d", "e"])], "page long, idx long, line string")
    assert [(r.ordered, r.start, r.items) for r in runs.list_runs(rows, ["page"]).orderBy("run").collect()] == [(False, None, ["a", "b"]), (True, 7, ["c", "d"]), (False, None, ["e"])]


def _blocks(spark, *rows):
    return spark.createDataFrame([(1, p, i, "heading", lv, t) for p, i, lv, t in rows], "book long, page long, idx long, block_type string, level long, text string")


def test_contents(spark):
    found = toc.contents(_blocks(spark, (0, 0, 0, "1장"), (0, 1, 0, "2장"), (3, 0, 1, " 3장 "), (3, 1, 2, "**Name**"), (4, 0, 1, "x")))
    assert [(r.page, r.title) for r in found.collect()] == [(3, "3장 Name")]
    assert toc.contents(_blocks(spark, (0, 0, 0, "1장"), (0, 1, 0, "2장"), (1, 0, 1, "x"))).count() == 0
    assert [(r.page, r.title, r.level) for r in toc.contents(_blocks(spark, (0, 0, 0, "a"), (0, 1, 1, "b"), (1, 0, 2, "c"), (1, 1, 1, "d"))).collect()] == [(0, "a", 1)]


def test_last_chapter_keeps_its_pages(spark):
    pages_ = spark.createDataFrame([(1, p) for p in (0, 1, 3, 5, 6, 9)], "book long, page long")
    entries = spark.createDataFrame([(1, 3, "c"), (1, 3, "b")], "book long, page long, title string")
    found = {}
    for r in toc.chapters(entries, pages_).collect():
        found.setdefault(r.title, []).append(r.page)
    assert {k: sorted(v) for k, v in found.items()} == {toc.FRONT: [0, 1], "c": [3, 5, 6, 9]}


def test_spatial_owner(spark):
    boxes = spark.createDataFrame([(0, 0, 0.0, 0.0, 100.0, 100.0), (0, 1, 10.0, 10.0, 20.0, 20.0), (0, 2, 10.0, 10.0, 20.0, 20.0), (0, 3, 200.0, 200.0, 201.0, 201.0)], "page long, block_idx long, x0 double, y0 double, x1 double, y1 double")
    lines = spark.createDataFrame([(0, 0, "in", 14.0, 14.0, 16.0, 16.0), (0, 1, "edge", 99.0, 99.0, 101.0, 101.0), (0, 2, "out", 150.0, 150.0, 151.0, 151.0), (0, 3, "in2", 14.0, 14.0, 16.0, 17.0)], "page long, line_idx long, line_text string, line_x0 double, line_y0 double, line_x1 double, line_y1 double")
    assert {r.block_idx: r.text for r in spatial.own_lines(boxes, lines).collect()} == {0: "edge", 1: "in\nin2", 2: "", 3: ""}


def test_page_ranges(spark):
    rows = spark.createDataFrame([("3, 1-2,2,9-99",), ("x",)], "spec string")
    assert sorted(r.page for r in pages.page_ranges(rows, "spec", F.lit(10), ("spec",)).collect()) == [0, 1, 2, 8, 9]


@pytest.mark.parametrize("status,good,attempt,what", [(200, True, 1, "done"), (200, False, 1, "retry"), (429, True, 2, "retry"), (503, True, 3, "fail"), (None, False, 1, "retry"), (401, True, 1, "fail")])
def test_calls(spark, status, good, attempt, what):
    assert one(spark, jobs.call_outcome(F.lit(status).cast("int"), F.lit(good), F.lit(attempt))) == what


def test_pixels(spark):
    rows = spark.createDataFrame([(1, [(255, 255, 255)] * 9 + [(0, 0, 0)]), (2, [(200, 210, 220)] * 8), (3, [(0, 0, 0)] * 7 + [(200, 200, 200)])], "k int, px array<struct<r:int,g:int,b:int>>")
    found = {r.k: r for r in rows.select("k", pixels.is_blank("px").alias("blank"), pixels.ink_coverage("px").alias("ink"), pixels.background("px").alias("bg")).collect()}
    assert not found[1].blank and found[1].ink == 0.1 and found[1].bg is None
    assert found[2].blank and tuple(found[2].bg) == (200, 210, 220)
    assert found[3].bg is None


def test_frames():
    image = np.full((200, 200, 3), 255, np.int16)
    image[50:150, 50:150] = 0
    box = frames.trim_box(image)
    assert (box[2] - box[0], box[3] - box[1]) == (116, 116)
    assert frames.trim_box(np.full((50, 50, 3), 9, np.int16)) == (0, 0, 50, 50)
    framed = np.full((100, 100, 3), 255, np.int16)
    framed[10:90, 10:90] = (150, 120, 230)
    framed[13:87, 13:87] = 255
    framed[40:60, 30:70] = 0
    inner, found = frames.strip_frame(framed)
    assert found and inner[0] >= 13 and inner[2] <= 87
    assert frames.expand_to_frame(framed, (30, 40, 70, 60)) == (8, 8, 92, 92)
    assert frames.expand_to_frame(image, (60, 60, 140, 140)) == (60, 60, 140, 140)
    assert frames.extend_to_content(image, (60, 60, 140, 140))[3] == 151
    black = np.full((60, 60, 3), 255, np.int16)
    black[2:58, 2:58] = 0
    black[4:56, 4:56] = 255
    black[20:40, 20:40] = 90
    assert not frames.strip_frame(black)[1]


def test_epub_is_complete_and_repeatable():
    from leafspan.sources import epub

    made = epub.pack("id", "T & U", [("A <1>", "<p>x</p>"), ("B", "<p>y</p>")], images={"p.png": b"1"})
    assert made == epub.pack("id", "T & U", [("A <1>", "<p>x</p>"), ("B", "<p>y</p>")], images={"p.png": b"1"})
    with zipfile.ZipFile(io.BytesIO(made)) as z:
        assert z.namelist()[0] == "mimetype" and z.infolist()[0].compress_type == zipfile.ZIP_STORED
        assert "A &lt;1&gt;" in z.read("EPUB/nav.xhtml").decode() and b"<p>y</p>" in z.read("EPUB/chapter_002.xhtml")
    with zipfile.ZipFile(io.BytesIO(epub.pack("id", "t", []))) as z:
        assert "EPUB/chapter_001.xhtml" in z.namelist()


def test_recorded_pages(spark, tmp_path):
    from leafspan.sources import readers

    (tmp_path / "a.json").write_text('{"model":"m","pages":[{"index":1,"dimensions":{},"blocks":[{"type":"title","content":"# Ti","top_left_x":1,"top_left_y":2,"bottom_right_x":3,"bottom_right_y":4},{"type":"odd","content":" B "},{"type":"odd","content":"IP"}]},{"blocks":null}]}')
    rows = readers.recorded_pages(spark, str(tmp_path))
    found = blocks.blocks_from_pages(rows, F.col("page"), ("model",)).orderBy("raw_idx").collect()
    assert [(r.page, r.block_type, r.text, r.level, r.x0, r.x1) for r in found] == [(1, "heading", "Ti", 1, 1.0, 3.0), (1, "paragraph", "IP", 0, 0.0, 0.0)]


def _html(spark, *rows):
    from leafspan.operators import render

    kind = "blocks array<struct<block_type:string,text:string,level:int,image_path:string,bg:struct<r:int,g:int,b:int>>>"
    full = [(t, x, 1, im, bg) for t, x, im, bg in ((*r, *[None] * 4)[:4] for r in rows)]
    return spark.createDataFrame([(full,)], kind).select(render.render_page(F.col("blocks")).alias("h")).first()["h"]


def test_render_lists_span_blocks_and_flip(spark):
    assert _html(spark, ("list_item", "7. a\n\n8. b"), ("list_item", "9. **c**"), ("list_item", "- d")) == '<ol start="7">\n<li>a</li>\n<li>b</li>\n<li><strong>c</strong></li>\n</ol>\n<ul>\n<li>d</li>\n</ul>'
    assert _html(spark, ("list_item", "- a"), ("page_header", "x"), ("list_item", "- b")).count("<ul>") == 2


def test_render_captions(spark):
    assert _html(spark, ("figure", None, "f.png"), ("caption", "c\nd")) == '<figure class="figure"><img src="images/f.png" alt="그림"/><figcaption>c d</figcaption></figure>'
    assert _html(spark, ("caption", "c"), ("code", "x < 1")) == '<figure class="listing"><figcaption>c</figcaption><pre><code>x &lt; 1</code></pre></figure>'
    assert _html(spark, ("caption", "c"), ("table", "| a |\n|---|\n| b |")) == "<table><caption>c</caption><tr><th>a</th></tr><tr><td>b</td></tr></table>"
    assert _html(spark, ("figure", None), ("caption", "c")) == '<p class="caption">c</p>'
    assert _html(spark, ("caption", "c"), ("table", "x", "t.png")) == '<table><caption>c</caption><tr><td><img src="images/t.png" alt="표"/></td></tr></table>'


def test_render_tints_cut_pairs_and_lists(spark):
    tint = (200, 210, 220)
    html = _html(spark, ("figure", None, "f.png"), ("caption", "c", None, tint), ("list_item", "- a", None, tint), ("list_item", "- b"), ("paragraph", ""))
    assert html.split("\n") == ['<figure class="figure"><img src="images/f.png" alt="그림"/></figure>', '<aside class="tinted" style="background-color:#c8d2dc;border-left-color:#2f82d5">', '<p class="caption">c</p>', "<ul>", "<li>a</li>", "</ul>", "</aside>", "<ul>", "<li>b</li>", "</ul>"]
    assert "tinted" not in _html(spark, ("paragraph", "a", None, tint), ("paragraph", "b", None, tint))


def test_render_other_blocks(spark):
    assert _html(spark, ("heading", "T *x*"), ("aside", "m"), ("footnote", "n\no"), ("formula", None, "q.png"), ("page_footer", "9")) == '<h1>T <em>x</em></h1>\n<aside class="memo">\n<p>m</p>\n</aside>\n<div class="footnote"><p>n o</p></div>\n<div class="formula"><img src="images/q.png" alt="수식"/></div>'


def test_reconstruction_keeps_the_order_of_its_steps(spark):
    from leafspan.operators import reconstruct

    rows = [(1, 0, 0, "paragraph", "imprint"), (1, 1, 0, "heading", "1장"), (1, 1, 1, "heading", "Start"), (1, 2, 0, "paragraph", "body"), (1, 4, 0, "paragraph", "end")]
    blocks_ = spark.createDataFrame([(*r, 0, None, None) for r in rows], "book long, page long, idx long, block_type string, text string, level long, image_path string, bg struct<r:int,g:int,b:int>")
    facts = spark.createDataFrame([(1, 0, True, 1, False, True, False, 0.1), (1, 1, True, 2, False, True, False, 0.9), (1, 2, True, 1, False, True, False, 0.1), (1, 3, False, 0, False, True, True, 0.0), (1, 4, True, 1, False, True, False, 0.1), (1, 5, False, 0, False, True, False, 0.2)], "book long, page long, has_layout boolean, n_blocks long, single_figure boolean, has_image boolean, blank boolean, ink double")
    made, summary = reconstruct.reconstruct(blocks_, facts)
    found = {r.title: r.body for r in made.collect()}
    assert set(found) == {toc.FRONT, "1장 Start"}  # the divider page named the chapter before it became a picture
    assert "page_0000_full.png" in found[toc.FRONT] and "imprint" not in found[toc.FRONT]
    body = found["1장 Start"]
    assert body.index("page_0001_full.png") < body.index("<p>body</p>") < body.index("<p>end</p>") < body.index("page_0005_full.png") and "page_0003" not in body
    assert tuple(summary.first()) == (1, 6, 1)


def test_later_of_two_entries_holds_the_page(spark):
    entries = spark.createDataFrame([(1, 0, "Zebra", 0), (1, 0, "Apple", 1), (1, 2, "End", 2)], "book long, page long, title string, entry long")
    found = toc.chapters(entries, spark.range(4).selectExpr("1L AS book", "id AS page")).orderBy("page").collect()
    assert [r.title for r in found] == ["Apple", "Apple", "End", "End"]


def test_books_without_pages_have_no_rows(spark):
    from leafspan.operators import pages as P

    books = spark.createDataFrame([(1, 2), (2, 0), (3, None)], "book long, n_pages long")
    layouts = spark.createDataFrame([(1, 0, True, 3, 0), (1, 0, True, 5, 1), (2, 0, True, 1, 0)], "book long, page long, has_layout boolean, n_blocks long, layout_idx long")
    assert [(r.book, r.page, r.n_blocks) for r in P.all_pages(books, layouts).orderBy("page").collect()] == [(1, 0, 5), (1, 1, None)]


def test_last_dimensions_of_a_page_count(spark):
    from leafspan.operators import refine

    dims = spark.createDataFrame([(1, 0, 100, 100, 50, 50, 0), (1, 0, 80, 80, 40, 40, 1), (1, 1, 10, 10, 10, 10, 0)], "book long, page long, width long, height long, ref_width long, ref_height long, dim_idx long")
    assert sorted((r.page, r.width) for r in refine.last_dims(dims).collect()) == [(0, 80), (1, 10)]
    assert refine.last_dims(dims.drop("dim_idx")).count() == 2


def test_chunks_are_one_table(spark):
    from leafspan.operators import pages as P

    chunks = spark.createDataFrame([(0, 0, "a"), (1, 3, "b"), (2, None, "c")], "chunk long, index long, text string")
    assert sorted((r.page, r.text) for r in P.union_chunks(chunks).collect()) == [(0, "a"), (43, "b"), (80, "c")]


def test_jobs_are_stamped_and_looked_up(spark):
    from leafspan.operators import jobs as J

    kind = "id string, status string, created_at timestamp, started_at timestamp, finished_at timestamp"
    known = spark.createDataFrame([], kind)
    first = J.stamp(spark.createDataFrame([("a", "pending"), ("b", "processing"), ("c", "done")], "id string, status string"), known).collect()
    found = {r.id: (r.created_at is not None, r.started_at is not None, r.finished_at is not None) for r in first}
    assert found == {"a": (True, False, False), "b": (True, True, False), "c": (True, False, True)}
    again = J.stamp(spark.createDataFrame([("b", "done")], "id string, status string"), spark.createDataFrame(first, "id string, status string, created_at timestamp, started_at timestamp, finished_at timestamp")).first()
    old = next(r for r in first if r.id == "b")
    assert (again.created_at, again.started_at) == (old.created_at, old.started_at) and again.finished_at is not None
    table = spark.createDataFrame([("a", "done", 100, None, None, "t", 3, None)], "id string, status string, progress int, progress_stage string, progress_message string, title string, page_count int, error string")
    looked = {r.id: r.status for r in J.lookup(table, spark.createDataFrame([("a",), ("x",)], "id string")).collect()}
    assert looked == {"a": "done", "x": None} and J.lookup(table, table).columns == list(J.SHOWN)


def test_layer_blocks_merge_texts_and_figures(spark):
    from leafspan.operators import blocks as B

    long = "w" * 60
    pages = spark.createDataFrame([(1, 0, long, True), (1, 1, " short ", True), (1, 2, None, False), (1, 3, long, False)], "book long, page long, text string, has_image boolean")
    texts = spark.createDataFrame([(1, 0, 0, 20.0, "12\n•\nitem"), (1, 0, 1, 5.0, "top"), (1, 0, 2, 30.0, "7\n \n"), (1, 1, 0, 1.0, "gone"), (1, 2, 0, 1.0, "kept"), (9, 0, 0, 1.0, "no page")], "book long, page long, idx long, y0 double, text string")
    figures = spark.createDataFrame([(1, 0, 0, 20.0, "f.png"), (1, 0, 1, 1.0, None), (1, 1, 0, 1.0, "g.png")], "book long, page long, idx long, y0 double, image string")
    box = lambda d: d.selectExpr("*", "0.0D AS x0", "1.0D AS x1", "y0 + 1 AS y1")
    found = B.layer_blocks(pages, box(texts), box(figures)).orderBy("page", "idx").collect()
    assert [(r.page, r.idx, r.block_type, r.text, r.image) for r in found] == [(0, 0, "paragraph", "top", None), (0, 1, "paragraph", "• item", None), (0, 2, "figure", "", "f.png"), (1, 0, "figure", "", "page_0001_full.png"), (2, 0, "paragraph", "kept", None)]


def test_small_images_keep_their_corners():
    import numpy as np

    from leafspan.functions import frames

    tiny = np.zeros((5, 40, 3), np.uint8)
    tiny[0, 0] = (255, 0, 0)
    assert (frames.erase_corner_arcs(tiny) == tiny).all()


def test_images_are_numbered_by_name(spark, tmp_path):
    from leafspan.sources import readers

    for name in ("b.png", "a.png", "c.png"):
        (tmp_path / name).write_bytes(name.encode())
    assert sorted((r.number, bytes(r.content)) for r in readers.images(spark, str(tmp_path)).collect()) == [(0, b"a.png"), (1, b"b.png"), (2, b"c.png")]


def test_recorded_pages_and_jobs_are_read(spark, tmp_path):
    from leafspan.sources import readers

    (tmp_path / "r.json").write_text('{"model": "m", "pages": [{"index": 1, "markdown": "x", "blocks": [{"content": "hi", "type": "text"}]}]}')
    assert [(r.model, r.page["index"], r.page.blocks[0].content) for r in readers.recorded_pages(spark, str(tmp_path / "r.json")).collect()] == [("m", 1, "hi")]
    spark.createDataFrame([("a", "done")], "id string, status string").write.parquet(str(tmp_path / "jobs"))
    row = readers.jobs(spark, str(tmp_path / "jobs")).first()
    assert (row.id, row.status, row.client_ip) == ("a", "done", None)
