"""Queries over books: contents, chapters, whole pages, blocks and runs."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import geometry as G
from ..functions import text as T
from ..operators import blocks as B
from ..operators import pages as P
from ..operators import reconstruct as reconstruction
from ..operators import refine as R
from ..operators import render, runs, spatial, toc
from . import sqltext as Q
from .text_plans import _FOLD, _KEPT, BULLETED
from .tables import BLOCKS, LINES, PAGES, blocks, lines, pages, table

_DIV = r"'^[ \t\n\r\f\v]*[0-9]+[ \t\n\r\f\v]*장[ \t\n\r\f\v]*$'"
_HEADS = f", hd AS (SELECT book, page, idx, level, {Q.strip('text')} AS text FROM bl WHERE block_type = 'heading' AND {Q.strip('text')} <> '')"
_DIVIDERS = _HEADS + f""", dv AS (SELECT *, regexp_matches(text, {_DIV}) AS divides, lead(text) OVER (PARTITION BY book, page ORDER BY idx) AS next FROM hd),
  de AS (SELECT book, page, text || CASE WHEN next IS NULL THEN '' ELSE ' ' || next END AS t FROM (SELECT *, count(*) FILTER (divides) OVER (PARTITION BY book, page) AS n FROM dv) WHERE divides AND n = 1),
  dx AS (SELECT book, page, {Q.plain('t')} AS t FROM de), di AS (SELECT book, page, {Q.clip('t')} AS title, CAST(1 AS BIGINT) AS level FROM dx)"""
_FALLBACK = f""", fh AS (SELECT *, row_number() OVER (PARTITION BY book, page ORDER BY idx) AS rn FROM hd), fx AS (SELECT book, page, {Q.plain('text')} AS t, level FROM fh WHERE rn = 1 AND level IN (0, 1)),
  fb AS (SELECT book, page, {Q.clip('t')} AS title, CAST(greatest(level, 1) AS BIGINT) AS level FROM fx), db AS (SELECT DISTINCT book FROM dv WHERE divides)"""
_TOC = _DIVIDERS + _FALLBACK + ", hc AS (SELECT * FROM di UNION ALL SELECT * FROM fb WHERE book NOT IN (SELECT book FROM db))"
_MARKS = f", bm AS (SELECT book, greatest(page - 1, 0) AS page, {Q.strip('title')} AS title, level, doc_id AS entry FROM (SELECT doc_id, doc_id // 50 AS book, CASE doc_id % 50 WHEN 20 THEN 40 ELSE doc_id % 50 END AS page, CAST(1 + doc_id % 2 AS BIGINT) AS level, CASE WHEN doc_id % 20 = 10 THEN ' ' WHEN doc_id % 50 = 20 THEN '  Zone ' || doc_id ELSE '  Mark ' || doc_id || ' ' END AS title FROM documents WHERE doc_id // 50 % 5 = 4 AND doc_id % 10 = 0) WHERE {Q.strip('title')} <> '')"
_CHAPTERS = """, en AS (SELECT book, page, arg_max(title, entry) AS title FROM ct GROUP BY 1, 2),
  cp AS (SELECT p.book, p.page, (SELECT count(*) FROM en e WHERE e.book = p.book) AS any_, (SELECT count(*) FROM en e WHERE e.book = p.book AND e.page <= p.page) AS seen, (SELECT arg_max(title, page) FROM en e WHERE e.book = p.book AND e.page <= p.page) AS nm FROM pg p)"""


def _marks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Bookmarks of every fifth book; some books have two on a page, of which the later one's title comes first in the alphabet."""
    return pages(spark, sf_dir).where("book % 5 = 4 and doc_id % 10 = 0").selectExpr("book", "CASE page WHEN 20 THEN 40 ELSE page END AS page", "doc_id AS idx", "1 + doc_id % 2 AS level", "CASE WHEN doc_id % 20 = 10 THEN ' ' WHEN page = 20 THEN concat('  Zone ', doc_id) ELSE concat('  Mark ', doc_id, ' ') END AS title")


def toc_dividers(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toc.divider_entries(blocks(spark, sf_dir)).drop("entry")


def toc_fallback(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toc.fallback_entries(blocks(spark, sf_dir)).drop("entry")


def toc_mode(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toc.contents(blocks(spark, sf_dir), _marks(spark, sf_dir)).drop("entry")


def first_divider(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toc.first_divider(blocks(spark, sf_dir))


def chapters(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toc.chapter_ranges(toc.contents(blocks(spark, sf_dir), _marks(spark, sf_dir)), pages(spark, sf_dir))


def chapter_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toc.chapters(toc.contents(blocks(spark, sf_dir)), pages(spark, sf_dir))


def page_route(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = B.page_route(pages(spark, sf_dir))
    return found.withColumn("uses_api", P.route(F.when(F.col("book") % 3 == 0, "api").when(F.col("book") % 3 == 1, "auto").otherwise("text"), "ocr_needed", F.col("book") % 2 == 0))


#: Pages with what the page rules look at.
_FACTS = """SELECT doc_id, doc_id // 50 AS book, doc_id % 50 AS page, doc_id % 11 <> 3 AS has_layout, CASE WHEN doc_id % 11 = 5 THEN 0 ELSE len(string_split(text, chr(10))) END AS n_blocks,
  doc_id % 19 = 6 AS single_figure, doc_id % 13 <> 7 AS has_image, doc_id % 17 = 4 AS blank, (doc_id * 37 % 100) / 100.0::DOUBLE AS ink FROM documents"""


def _facts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pages(spark, sf_dir).selectExpr("doc_id", "book", "page", "doc_id % 11 <> 3 AS has_layout", "CASE WHEN doc_id % 11 = 5 THEN 0 ELSE size(split(text, '\\n')) END AS n_blocks", "doc_id % 19 = 6 AS single_figure", "doc_id % 13 <> 7 AS has_image", "doc_id % 17 = 4 AS blank", "(doc_id * 37 % 100) / 100.0D AS ink")


def fill_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    facts = _facts(spark, sf_dir)
    books = facts.groupBy("book").agg((F.max("page") + 3).cast("int").alias("n_pages"))
    layouts = facts.where("has_layout").select("book", "page", "has_layout", F.col("n_blocks").cast("bigint").alias("n_blocks"), F.col("doc_id").alias("layout_idx"))
    rows = P.all_pages(books, layouts).join(facts.select("book", "page", "has_image", "blank"), ["book", "page"], "left")
    return P.fill(rows).select("book", "page", "filled")


def replace_cover(spark: SparkSession, sf_dir: str) -> DataFrame:
    return P.replace_cover(_facts(spark, sf_dir)).select("book", "page", "covered")


def replace_front(spark: SparkSession, sf_dir: str) -> DataFrame:
    return P.replace_front(_facts(spark, sf_dir), toc.first_divider(blocks(spark, sf_dir))).select("book", "page", "replaced")


def replace_design(spark: SparkSession, sf_dir: str) -> DataFrame:
    return P.replace_design(_facts(spark, sf_dir)).select("book", "page", "replaced")


def _raw_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pages as recorded JSON: every line a block, types in turn, some without content, image or coordinates."""
    kinds = F.array(*(F.lit(k) for k in ("text", "title", "list", "image", "caption", "mystery", "references", "equation")))
    block = lambda s, i: F.struct(
        F.when(i % 7 != 6, F.lit(10.0) + i).alias("top_left_x"), F.lit(20.0).alias("top_left_y"), F.lit(90.5).alias("bottom_right_x"), F.lit(100.0).alias("bottom_right_y"),
        F.when(i % 9 == 8, "B").when(i % 9 == 7, " ").when(i % 8 == 1, F.concat(F.lit("## "), s)).otherwise(s).alias("content"), F.get(kinds, i % 8).alias("type"), F.when(i % 16 < 8, F.concat(F.lit("img-"), i)).alias("image_id"))
    page = F.struct(F.when(F.col("doc_id") % 5 != 0, F.col("page").cast("int")).alias("index"), F.transform(F.split("text", "\n"), block).alias("blocks"))
    return pages(spark, sf_dir).select("doc_id", F.to_json(page).alias("json"))


def raw_json_blocks(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = B.blocks_from_pages(_raw_pages(spark, sf_dir), F.from_json("json", B.PAGE_SCHEMA))
    return found.withColumn("page", F.col("page").cast("bigint"))


def block_typing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return B.blocks_from_html(table(spark, sf_dir, "pages")).where(~F.col("block_type").isin(*B.HIDDEN)).select("page_id", "raw_idx", "block_type", "text")


def type_ranking(spark: SparkSession, sf_dir: str) -> DataFrame:
    return B.type_ranking(B.blocks_from_html(table(spark, sf_dir, "pages")), "page_id", "raw_idx")


def layer_blocks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Four lines a text block, with bullets and page numbers put in; two figures on every third page, of which some cannot be read."""
    line = "CASE idx % 6 WHEN 1 THEN '•' WHEN 4 THEN '12' ELSE line END"
    texts = lines(spark, sf_dir).selectExpr("book", "page", "idx", f"{line} AS line").groupBy("book", "page", F.expr("idx div 4 AS idx")).agg(F.array_sort(F.collect_list(F.struct("idx", "line"))).alias("a"))
    box = lambda y: [F.lit(1.0).alias("x0"), y.cast("double").alias("y0"), F.lit(90.0).alias("x1"), F.lit(99.0).alias("y1")]
    texts = texts.select("book", "page", "idx", *box(F.expr("idx * 7 % 5 * 10")), F.array_join(F.transform("a", lambda x: x["line"]), "\n").alias("text"))
    figures = pages(spark, sf_dir).where("doc_id % 3 = 0").select("doc_id", "book", "page", F.explode(F.array(F.lit(0), F.lit(1))).alias("idx"))
    figures = figures.select("book", "page", "idx", *box(F.col("idx") * 10 + 10), F.when((F.col("doc_id") % 4 != 0) | (F.col("idx") == 0), F.format_string("page_%04d_img_%03d.png", F.col("page"), F.col("idx") + 1)).alias("image"))
    found = B.layer_blocks(pages(spark, sf_dir).withColumn("has_image", F.expr("doc_id % 13 <> 7")), texts.withColumn("idx", F.col("idx").cast("bigint")), figures.withColumn("idx", F.col("idx").cast("bigint")))
    return found.select("book", "page", "idx", "block_type", "y0", "text", "image")


def type_histogram(spark: SparkSession, sf_dir: str) -> DataFrame:
    return B.type_histogram(B.blocks_from_html(table(spark, sf_dir, "pages")), "page_id")


_HTML = r"""WITH h AS (SELECT page_id, regexp_replace(html, '(?s)<!--.*?-->|<script[^>]*>.*?</script>|<style[^>]*>.*?</style>|<title>.*?</title>', '', 'g') AS body FROM pages),
  p AS (SELECT page_id, regexp_extract_all(body, '<(?:h1|p|li|div class="ad"|nav|footer)>[^<]*(?:<(?:b|br|a|i|em|strong|/b|/a|/i|/em|/strong)\b[^>]*>[^<]*)*') AS a FROM h),
  e AS (SELECT page_id, unnest(range(len(a))) AS raw_idx, unnest(a) AS piece FROM p),
  t AS (SELECT page_id, raw_idx, regexp_extract(piece, '^<([a-z0-9]+)', 1) AS tag, trim(regexp_replace(replace(replace(replace(replace(regexp_replace(piece, '<[^>]*>', ' ', 'g'), '&lt;', '<'), '&gt;', '>'), '&quot;', '"'), '&amp;', '&'), '[ \t\n\r\f\v]+', ' ', 'g')) AS text FROM e),
  b AS (SELECT page_id, raw_idx, CASE tag WHEN 'h1' THEN 'heading' WHEN 'li' THEN 'list_item' WHEN 'div' THEN 'aside' WHEN 'nav' THEN 'page_header' WHEN 'footer' THEN 'page_footer' ELSE 'paragraph' END AS block_type, text FROM t
    WHERE text <> '' AND NOT (length(text) = 1 AND NOT regexp_matches(text, '^[0-9가-힣]$'))) """


def refine_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    kinds = "CASE idx % 5 WHEN 1 THEN 'caption' WHEN 3 THEN 'footnote' ELSE 'paragraph' END"
    rows = lines(spark, sf_dir).selectExpr("book", "page", "idx", f"{kinds} AS block_type", "line AS text", "CASE WHEN idx % 10 = 3 THEN 0.0D ELSE 10.0D + idx END AS x0", "CASE WHEN idx % 10 = 3 THEN 0.0D ELSE 20.0D END AS y0", "CASE WHEN idx % 10 = 3 THEN 0.0D ELSE 90.0D END AS x1", "CASE WHEN idx % 10 = 3 THEN 0.0D ELSE 60.0D END AS y1")
    dims = pages(spark, sf_dir).where("page % 13 <> 7").selectExpr("book", "page", "574L AS width", "1020L AS height", "287L AS ref_width", "0L AS ref_height")
    answers = table(spark, sf_dir, "benchmark").selectExpr("item_id % 20 AS book", "item_id div 20 AS ordinal", "CASE WHEN item_id % 3 = 0 THEN ' ' ELSE concat(' ', text) END AS answer")
    found = R.write_back(R.targets(rows, dims), answers)
    return found.select("book", "ordinal", "page", "idx", F.col("crop.x0").alias("x0"), F.col("crop.y0").alias("y0"), F.col("crop.x1").alias("x1"), F.col("crop.y1").alias("y1"), "text", "replaced")


def refined_count(spark: SparkSession, sf_dir: str) -> DataFrame:
    return refine_text(spark, sf_dir).groupBy("book").agg(F.count_if("replaced").alias("n_replaced"), F.count("*").alias("n_targets"))


_LAYER_KEPT, _LAYER_FOLD = _KEPT.replace(BULLETED, "ls"), _FOLD.replace(BULLETED, "ls")
_REFINE = f"""WITH {LINES}, k AS (SELECT book, page, idx, line, CASE idx % 5 WHEN 1 THEN 'caption' WHEN 3 THEN 'footnote' ELSE 'paragraph' END AS t FROM ln),
  g AS (SELECT *, row_number() OVER (PARTITION BY book ORDER BY page, idx) - 1 AS ordinal, CAST(trunc((10 + idx) * 2.0) AS BIGINT) AS bx FROM k WHERE t <> 'paragraph' AND idx % 10 <> 3 AND page % 13 <> 7 AND greatest(0, CAST(trunc((10 + idx) * 2.0) AS BIGINT) - 6) < 186),
  a AS (SELECT item_id % 20 AS book, item_id // 20 AS ordinal, CASE WHEN item_id % 3 = 0 THEN ' ' ELSE ' ' || text END AS answer FROM benchmark),
  o AS (SELECT g.book, g.ordinal, page, idx, greatest(0, bx - 6) AS x0, CAST(14 AS BIGINT) AS y0, CAST(186 AS BIGINT) AS x1, CAST(66 AS BIGINT) AS y1, line, nullif({Q.strip("coalesce(answer, '')")}, '') AS new FROM g LEFT JOIN a ON a.book = g.book AND a.ordinal = g.ordinal),
  f AS (SELECT book, ordinal, page, idx, x0, y0, x1, y1, coalesce(new, line) AS text, new IS NOT NULL AS replaced FROM o) """


def _coloured(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Turns as blocks with a derived colour; a conversation is a page."""
    kinds = F.get(F.array(*(F.lit(k) for k in ("heading", "paragraph", "figure", "caption", "code", "list_item"))), ((F.col("conv_id") + F.col("turn")) % 6).cast("int"))
    tone = F.col("conv_id") * 5 + F.col("turn") * (F.col("conv_id") % 4 + 3)
    bg = F.when((F.col("conv_id") % 7 != 0) & ((F.col("conv_id") + F.col("turn")) % 5 == 0), None).otherwise(F.struct((tone % 60 + 180).cast("int").alias("r"), (tone % 30 + 200).cast("int").alias("g"), F.lit(220).alias("b")))
    rows = table(spark, sf_dir, "conversations").select("conv_id", F.struct("turn", kinds.alias("block_type"), bg.alias("bg"), (F.col("turn") % 4 != 3).alias("filled")).alias("b"))
    return rows.groupBy("conv_id").agg(F.array_sort(F.collect_list("b")).alias("blocks"))


def tint_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _coloured(spark, sf_dir).select("conv_id", F.posexplode(runs.tint_runs(F.col("blocks"))).alias("run", "r"))
    return rows.select("conv_id", F.col("run").cast("bigint").alias("run"), "r.start", "r.end", G.hex_colour("r.r", "r.g", "r.b").alias("colour"))


def caption_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _coloured(spark, sf_dir).select("conv_id", F.posexplode(runs.caption_pairs(F.col("blocks"))).alias("n", "p"))
    return rows.select("conv_id", F.col("n").cast("bigint").alias("n"), "p.kind", F.col("p.at").cast("bigint").alias("at"), F.col("p.caption_at").cast("bigint").alias("caption_at"))


_COLOURED = """cb AS (SELECT conv_id, turn, ['heading', 'paragraph', 'figure', 'caption', 'code', 'list_item'][(conv_id + turn) % 6 + 1] AS t, conv_id % 7 <> 0 AND (conv_id + turn) % 5 = 0 AS bare,
  (conv_id * 5 + turn * (conv_id % 4 + 3)) % 60 + 180 AS r, (conv_id * 5 + turn * (conv_id % 4 + 3)) % 30 + 200 AS g, turn % 4 <> 3 AS filled, row_number() OVER (PARTITION BY conv_id ORDER BY turn) - 1 AS i FROM conversations)"""
_TINT = f"""WITH RECURSIVE {_COLOURED},
  tx AS (SELECT *, first_value(r) OVER w AS fr, first_value(g) OVER w AS fg, first_value(bare) OVER w AS fbare FROM cb WHERE t IN ('heading', 'paragraph', 'list_item', 'code', 'caption') WINDOW w AS (PARTITION BY conv_id ORDER BY i)),
  paper AS (SELECT conv_id FROM tx GROUP BY 1 HAVING bool_and(NOT bare AND NOT fbare AND abs(r - fr) <= 8 AND abs(g - fg) <= 8)),
  f AS (SELECT conv_id, i, bare, r AS ar, g AS ag, CASE WHEN bare THEN -1 ELSE i END AS s FROM cb WHERE i = 0
    UNION ALL SELECT c.conv_id, c.i, c.bare, CASE WHEN NOT c.bare AND f.s >= 0 AND abs(c.r - f.ar) <= 8 AND abs(c.g - f.ag) <= 8 THEN f.ar ELSE c.r END, CASE WHEN NOT c.bare AND f.s >= 0 AND abs(c.r - f.ar) <= 8 AND abs(c.g - f.ag) <= 8 THEN f.ag ELSE c.g END,
      CASE WHEN c.bare THEN -1 WHEN f.s >= 0 AND abs(c.r - f.ar) <= 8 AND abs(c.g - f.ag) <= 8 THEN f.s ELSE c.i END FROM f JOIN cb c ON c.conv_id = f.conv_id AND c.i = f.i + 1)
  SELECT conv_id, row_number() OVER (PARTITION BY conv_id ORDER BY s) - 1 AS run, s AS start, max(i) + 1 AS "end", '#' || lower(to_hex(any_value(ar))) || lower(to_hex(any_value(ag))) || 'dc' AS colour
  FROM f WHERE s >= 0 AND conv_id NOT IN (SELECT conv_id FROM paper) GROUP BY conv_id, s"""
_CAPTIONS = f"""WITH RECURSIVE {_COLOURED}, k AS (SELECT conv_id, i, CASE WHEN t = 'figure' AND NOT filled THEN 'empty figure' ELSE t END AS t, filled FROM cb),
  f AS (SELECT conv_id, i, t AS kind, CAST(NULL AS BIGINT) AS cap, i AS "at", CAST(0 AS BIGINT) AS n FROM k WHERE i = 0
    UNION ALL SELECT k.conv_id, k.i,
      CASE WHEN k.t = 'caption' AND f.cap IS NULL AND f.kind = 'figure' THEN 'figure' ELSE k.t END,
      CASE WHEN k.t = 'caption' AND f.cap IS NULL AND f.kind = 'figure' THEN k.i WHEN f.cap IS NULL AND f.kind = 'caption' AND k.t IN ('figure', 'table', 'code') AND k.filled THEN f."at" END,
      CASE WHEN k.t = 'caption' AND f.cap IS NULL AND f.kind = 'figure' THEN f."at" ELSE k.i END,
      CASE WHEN f.cap IS NULL AND ((k.t = 'caption' AND f.kind = 'figure') OR (f.kind = 'caption' AND k.t IN ('figure', 'table', 'code') AND k.filled)) THEN f.n ELSE f.n + 1 END
    FROM f JOIN k ON k.conv_id = f.conv_id AND k.i = f.i + 1)
  SELECT conv_id, n, arg_max(kind, i) AS kind, arg_max("at", i) AS "at", max(cap) AS caption_at FROM f GROUP BY conv_id, n"""


def _boxes(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """Orders as pages: their lines as boxes and, shifted, as text lines."""
    items = table(spark, sf_dir, "lineitem")
    q, p = F.col("l_quantity"), F.col("l_linenumber").cast("bigint")
    n = p * 1000000000000000 + F.col("l_partkey") * 1000000000 + F.col("l_suppkey") * 100 + q.cast("bigint")
    boxes = items.select(F.col("l_orderkey").alias("page"), n.alias("block_idx"), (q - 10 * (p % 3)).alias("x0"), (q / 2).alias("y0"), (q + 20).alias("x1"), (q / 2 + 30 - 5 * (p % 2)).alias("y1"))
    lines_ = items.select(F.col("l_orderkey").alias("page"), n.alias("line_idx"), F.concat(F.lit("line "), "l_partkey").alias("line_text"), (q - 4).alias("line_x0"), (q / 2 + 4).alias("line_y0"), (q + 14).alias("line_x1"), (q / 2 + 6).alias("line_y1"))
    return boxes, lines_


def line_owner(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spatial.own_lines(*_boxes(spark, sf_dir)).select("page", "block_idx", "text", "n_lines")


def line_match_all(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spatial.match_lines(*_boxes(spark, sf_dir)).groupBy("page", "block_idx").agg(F.count("*").alias("n_lines"), F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("line_idx", "line_text"))), lambda s: s["line_text"]), "\n").alias("text"))


def block_order(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = spatial.reading_order(_boxes(spark, sf_dir)[0])
    return found.select("page", "block_idx", F.col("position").cast("bigint").alias("position"), G.area("x0", "y0", "x1", "y1").alias("area"))


def bbox_scale(spark: SparkSession, sf_dir: str) -> DataFrame:
    items = table(spark, sf_dir, "lineitem").select("l_orderkey", F.col("l_linenumber").cast("bigint").alias("l_linenumber"), "l_quantity", "l_discount", "l_tax")
    share = F.col("l_orderkey") % 2 == 0
    at = lambda name, small: F.when(share, F.col(small)).otherwise(F.col("l_quantity") * name)
    rows = items.select("l_orderkey", "l_linenumber", at(1.0, "l_discount").alias("x0"), at(1.5, "l_tax").alias("y0"), at(4.0, "l_discount").alias("x1"), at(5.0, "l_tax").alias("y1"), F.when(F.col("l_orderkey") % 3 != 0, 574).alias("rw"), F.when(F.col("l_orderkey") % 5 != 0, 1020).otherwise(0).alias("rh"))
    box = G.scale_box("x0", "y0", "x1", "y1", F.lit(1000), F.lit(2000), "rw", "rh")
    return rows.select("l_orderkey", "l_linenumber", box["x0"].alias("x0"), box["y0"].alias("y0"), box["x1"].alias("x1"), box["y1"].alias("y1"), F.round(G.points(box["x1"]), 6).alias("width_pt"))


def chunk_rebase(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "documents").selectExpr("doc_id", "doc_id div 40 AS chunk", "CASE WHEN doc_id % 40 <> 0 THEN doc_id % 40 END AS idx", "octet_length(text) AS n")
    return rows.groupBy("chunk").agg(F.min(P.rebase("idx", "chunk")).alias("first_page"), F.max(P.rebase("idx", "chunk")).alias("last_page"), F.round(P.encoded_mb(F.sum("n")), 6).alias("mb"))


def page_ranges(spark: SparkSession, sf_dir: str) -> DataFrame:
    specs = table(spark, sf_dir, "documents").selectExpr("doc_id", "concat_ws(',', doc_id % 7, concat(doc_id % 50, '-', doc_id % 50 + 6), concat(' ', doc_id % 60 + 1), '2-1') AS spec")
    return P.page_ranges(specs, "spec", F.lit(50), ("doc_id",)).select("doc_id", F.col("page").cast("bigint").alias("page"))


def pipeline_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Per book: pages, whether recognition is needed, entries of contents, and its price."""
    entries = toc.contents(blocks(spark, sf_dir)).groupBy("book").agg(F.count("*").alias("toc_count"))
    found = B.page_route(pages(spark, sf_dir)).join(entries, "book", "left")
    return found.select("book", "n_pages", "ocr_needed", F.coalesce("toc_count", F.lit(0)).alias("toc_count"), F.round(F.col("n_pages") * 0.004, 6).alias("cost"))


def chapter_xhtml(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each chapter's body: headings and paragraphs of its pages in order."""
    held = toc.chapters(toc.contents(blocks(spark, sf_dir)), pages(spark, sf_dir))
    html = F.when(F.col("block_type") == "heading", F.concat(F.lit("<"), T.heading_tag("level"), F.lit(">"), T.to_xhtml(T.strip("text")), F.lit("</"), T.heading_tag("level"), F.lit(">"))).otherwise(F.concat(F.lit("<p>"), T.to_xhtml(T.merge_lines("text")), F.lit("</p>")))
    rows = blocks(spark, sf_dir).where(T.strip("text") != "").select("book", "page", "idx", html.alias("html")).join(held, ["book", "page"])
    body = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("page", "idx", "html"))), lambda s: s["html"]), "\n")
    return rows.groupBy("book", "chapter", "title").agg(body.alias("body"))


def render_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Turns of each conversation as the blocks of a page, rendered."""
    rows = table(spark, sf_dir, "conversations").join(_coloured(spark, sf_dir).select("conv_id", F.explode("blocks").alias("b")).select("conv_id", F.col("b.turn").alias("turn"), "b.block_type", "b.bg", "b.filled"), ["conv_id", "turn"])
    text = F.when(F.col("block_type") == "list_item", F.concat(F.col("turn") + 3, F.lit(". "), F.replace("text", F.lit("\n"), F.lit("\n- ")))).otherwise(F.col("text"))
    block = F.struct("turn", "block_type", text.alias("text"), (F.col("turn") % 4).cast("int").alias("level"), F.when((F.col("block_type") == "figure") & F.col("filled"), F.format_string("img_%02d.png", "turn")).alias("image_path"), "bg")
    return rows.groupBy("conv_id").agg(F.array_sort(F.collect_list(block)).alias("blocks")).select("conv_id", render.render_page(F.col("blocks")).alias("html"))


def _book(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    found = blocks(spark, sf_dir).withColumns({"image_path": F.lit(None).cast("string"), "bg": F.when(F.col("idx") % 4 == 1, F.struct(F.lit(200).alias("r"), F.lit(215).alias("g"), F.lit(230).alias("b")))})
    return reconstruction.reconstruct(found, _facts(spark, sf_dir), _marks(spark, sf_dir))


def reconstruct(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The whole way from blocks to chapters."""
    return _book(spark, sf_dir)[0]


def reconstruct_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _book(spark, sf_dir)[1]


def book_cover(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Books whose first page begins with a picture."""
    found = blocks(spark, sf_dir).selectExpr("book", "page", "idx", "CASE WHEN idx = 0 AND book % 2 = 0 THEN 'figure' ELSE block_type END AS block_type", "CASE WHEN idx = 0 AND book % 4 = 0 THEN concat('cover-', book, '.png') END AS image_path")
    return render.covers(found, toc.chapters(toc.contents(blocks(spark, sf_dir)), pages(spark, sf_dir)))


QUERIES = {f.__name__: f for f in (toc_dividers, toc_fallback, toc_mode, first_divider, chapters, chapter_pages, page_route, fill_pages, replace_cover, replace_front, replace_design, raw_json_blocks, block_typing, type_histogram, type_ranking, layer_blocks,
                                   refine_text, refined_count, tint_runs, caption_pairs, line_owner, line_match_all, block_order, bbox_scale, chunk_rebase, page_ranges, pipeline_summary, chapter_xhtml, render_pages, reconstruct, reconstruct_summary, book_cover)}

_NAME = "CASE WHEN any_ = 0 THEN '본문' WHEN seen = 0 THEN '서문' ELSE nm END"
_CT = f"WITH {BLOCKS}{_TOC}"
_HELD = f", ch AS (SELECT book, page, dense_rank() OVER (PARTITION BY book ORDER BY seen) - 1 AS chapter, {_NAME} AS title FROM cp)"
_BOXES = """WITH bx AS (SELECT l_orderkey AS page, l_linenumber::BIGINT * 1000000000000000 + l_partkey * 1000000000 + l_suppkey * 100 + CAST(l_quantity AS BIGINT) AS block_idx, l_quantity - 10 * (l_linenumber % 3) AS x0, l_quantity / 2 AS y0, l_quantity + 20 AS x1, l_quantity / 2 + 30 - 5 * (l_linenumber % 2) AS y1 FROM lineitem),
  tl AS (SELECT l_orderkey AS page, l_linenumber::BIGINT * 1000000000000000 + l_partkey * 1000000000 + l_suppkey * 100 + CAST(l_quantity AS BIGINT) AS line_idx, 'line ' || l_partkey AS line_text, (l_quantity - 4 + l_quantity + 14) / 2 AS cx, (l_quantity / 2 + 4 + l_quantity / 2 + 6) / 2 AS cy FROM lineitem),
  mt AS (SELECT bx.page, block_idx, line_idx, line_text, greatest(0, x1 - x0) * greatest(0, y1 - y0) AS area FROM bx JOIN tl ON bx.page = tl.page AND cx >= x0 AND cx <= x1 AND cy >= y0 AND cy <= y1)"""
_TYPES = "['paragraph', 'heading', 'list_item', 'figure', 'caption', 'paragraph', 'footnote', 'formula']"
SQL = {
    "toc_dividers": f"WITH {BLOCKS}{_DIVIDERS} SELECT * FROM di",
    "toc_fallback": f"WITH {BLOCKS}{_DIVIDERS}{_FALLBACK} SELECT * FROM fb",
    "toc_mode": f"{_CT}{_MARKS} SELECT book, page, title, level FROM bm UNION ALL SELECT * FROM hc WHERE book NOT IN (SELECT book FROM bm)",
    "first_divider": f"WITH {BLOCKS}{_DIVIDERS} SELECT book, min(page) AS first_divider FROM di GROUP BY book",
    "chapters": f"{_CT}{_MARKS}, ct AS (SELECT book, page, title, entry FROM bm UNION ALL SELECT book, page, title, 0 FROM hc WHERE book NOT IN (SELECT book FROM bm)){_CHAPTERS}{_HELD} SELECT book, chapter, title, min(page) AS first_page, max(page) AS last_page, count(*) AS n_pages FROM ch GROUP BY 1, 2, 3",
    "chapter_pages": f"{_CT}, ct AS (SELECT book, page, title, 0 AS entry FROM hc){_CHAPTERS}{_HELD} SELECT book, chapter, title, page FROM ch",
    "page_route": f"""WITH {PAGES}, n AS (SELECT book, length({Q.strip("coalesce(text, '')")}) AS n FROM pg), g AS (SELECT book, count(*) AS n_pages, CAST(sum(n) AS BIGINT) AS n_chars, count(*) FILTER (n < 50) AS image_pages, coalesce(avg(n), 0) < 50 AS ocr_needed FROM n GROUP BY book)
        SELECT *, book % 3 = 0 OR (book % 3 = 1 AND ocr_needed AND book % 2 = 0) AS uses_api FROM g""",
    "fill_pages": f"""WITH f AS ({_FACTS}), b AS (SELECT book, max(page) + 3 AS n FROM f GROUP BY book), w AS (SELECT book, unnest(range(n)) AS page FROM b),
        r AS (SELECT w.book, w.page, CASE WHEN coalesce(has_layout, false) AND n_blocks > 0 THEN 'keep' WHEN coalesce(blank, false) THEN NULL WHEN coalesce(has_image, false) THEN 'figure' WHEN coalesce(has_layout, false) THEN 'empty' END AS filled FROM w LEFT JOIN f ON f.book = w.book AND f.page = w.page)
        SELECT * FROM r WHERE filled IS NOT NULL""",
    "replace_cover": f"WITH f AS ({_FACTS}) SELECT book, page, page = 0 AND has_image AND NOT blank AND ink >= 0.5 AS covered FROM f",
    "replace_front": f"WITH {BLOCKS}{_DIVIDERS}, f AS ({_FACTS}), d AS (SELECT book, min(page) AS fd FROM di GROUP BY book) SELECT f.book, f.page, coalesce(f.page < fd, false) AND NOT single_figure AND has_image AND NOT blank AS replaced FROM f LEFT JOIN d ON d.book = f.book",
    "replace_design": f"WITH f AS ({_FACTS}) SELECT book, page, NOT single_figure AND has_image AND NOT blank AND ink >= 0.5 AS replaced FROM f",
    "raw_json_blocks": f"""WITH {LINES}, k AS (SELECT doc_id, CASE WHEN doc_id % 5 = 0 THEN 0 ELSE page END AS page, idx AS raw_idx, {_TYPES}[idx % 8 + 1] AS block_type,
          {Q.strip("CASE WHEN idx % 9 = 8 THEN 'B' WHEN idx % 9 = 7 THEN ' ' WHEN idx % 8 = 1 THEN '## ' || line ELSE line END")} AS c, CASE WHEN idx % 16 < 8 THEN 'img-' || idx END AS img FROM ln),
        h AS (SELECT *, CASE WHEN regexp_matches(c, '^#{{1,6}}[ \\t\\n\\r\\f\\v]') THEN length(regexp_extract(c, '^(#+)', 1)) ELSE 0 END AS lv, CASE WHEN regexp_matches(c, '^#{{1,6}}[ \\t\\n\\r\\f\\v]') THEN {Q.strip("regexp_replace(c, '^#+[ \\t\\n\\r\\f\\v]+', '')")} ELSE c END AS title FROM k)
        SELECT doc_id, page, raw_idx, block_type, CASE WHEN block_type IN ('figure', 'formula') OR raw_idx % 7 = 6 THEN 0.0 ELSE 10.0 + raw_idx END::DOUBLE AS x0, CASE WHEN block_type IN ('figure', 'formula') OR raw_idx % 7 = 6 THEN 0.0 ELSE 20.0 END::DOUBLE AS y0,
          CASE WHEN block_type IN ('figure', 'formula') OR raw_idx % 7 = 6 THEN 0.0 ELSE 90.5 END::DOUBLE AS x1, CASE WHEN block_type IN ('figure', 'formula') OR raw_idx % 7 = 6 THEN 0.0 ELSE 100.0 END::DOUBLE AS y1,
          CASE WHEN block_type IN ('figure', 'formula') THEN '' WHEN block_type = 'heading' THEN title ELSE c END AS text, CAST(CASE WHEN block_type = 'heading' THEN lv ELSE 0 END AS BIGINT) AS level, CASE WHEN block_type IN ('figure', 'formula') THEN img END AS image_path
        FROM h WHERE CASE WHEN block_type IN ('figure', 'formula') THEN img IS NOT NULL ELSE c <> '' AND NOT (length({Q.strip('title')}) = 1 AND NOT regexp_matches({Q.strip('title')}, '^[0-9가-힣]$')) END""",
    "block_typing": _HTML + "SELECT page_id, raw_idx, block_type, text FROM b WHERE block_type NOT IN ('page_header', 'page_footer')",
    "type_histogram": _HTML + "SELECT page_id, block_type, count(*) AS n FROM b GROUP BY GROUPING SETS ((page_id, block_type), (block_type))",
    "type_ranking": _HTML + "SELECT block_type, n, row_number() OVER (ORDER BY n DESC, f) AS rank FROM (SELECT block_type, count(*) AS n, min(struct_pack(a := page_id, b := raw_idx)) AS f FROM b GROUP BY 1)",
    "layer_blocks": f"""WITH {LINES}, t AS (SELECT book, page, idx // 4 AS blk, list(CASE idx % 6 WHEN 1 THEN '•' WHEN 4 THEN '12' ELSE line END ORDER BY idx) AS ls FROM ln GROUP BY 1, 2, 3),
        c AS (SELECT book, page, blk, CASE WHEN len({_LAYER_KEPT}) > 0 THEN {_LAYER_FOLD} ELSE '' END AS text FROM t),
        w AS (SELECT book, page FROM pg WHERE length({Q.strip('text')}) < 50 AND doc_id % 13 <> 7),
        e AS (SELECT book, page, blk * 7 % 5 * 10.0::DOUBLE AS y0, 0 AS kind, blk AS n, text, NULL AS image FROM c WHERE {Q.strip('text')} <> ''
          UNION ALL SELECT book, page, i * 10.0::DOUBLE + 10, 1, i, '', format('page_{{:04d}}_img_{{:03d}}.png', page, i + 1) FROM (SELECT *, unnest(range(2)) AS i FROM pg WHERE doc_id % 3 = 0) WHERE doc_id % 4 <> 0 OR i = 0)
        SELECT book, page, row_number() OVER (PARTITION BY book, page ORDER BY y0, kind, n) - 1 AS idx, CASE kind WHEN 0 THEN 'paragraph' ELSE 'figure' END AS block_type, y0, text, image FROM e WHERE (book, page) NOT IN (SELECT (book, page) FROM w)
        UNION ALL SELECT book, page, 0, 'figure', 0.0::DOUBLE, '', format('page_{{:04d}}_full.png', page) FROM w""",
    "refine_text": _REFINE + "SELECT * FROM f",
    "refined_count": _REFINE + "SELECT book, count(*) FILTER (replaced) AS n_replaced, count(*) AS n_targets FROM f GROUP BY book",
    "tint_runs": _TINT,
    "caption_pairs": _CAPTIONS,
    "line_owner": _BOXES + """, ow AS (SELECT *, row_number() OVER (PARTITION BY page, line_idx ORDER BY area, block_idx) AS rn FROM mt)
        SELECT bx.page, bx.block_idx, coalesce(string_agg(line_text, chr(10) ORDER BY line_idx), '') AS text, count(line_idx) AS n_lines FROM bx LEFT JOIN (SELECT * FROM ow WHERE rn = 1) o ON o.page = bx.page AND o.block_idx = bx.block_idx GROUP BY 1, 2""",
    "line_match_all": _BOXES + " SELECT page, block_idx, count(*) AS n_lines, string_agg(line_text, chr(10) ORDER BY line_idx) AS text FROM mt GROUP BY 1, 2",
    "block_order": _BOXES + " SELECT page, block_idx, row_number() OVER (PARTITION BY page ORDER BY y0, x0, block_idx) - 1 AS position, greatest(0, x1 - x0) * greatest(0, y1 - y0) AS area FROM bx",
    "bbox_scale": """WITH r AS (SELECT l_orderkey, CAST(l_linenumber AS BIGINT) AS l_linenumber, CASE WHEN l_orderkey % 2 = 0 THEN l_discount ELSE l_quantity * 1.0 END AS x0, CASE WHEN l_orderkey % 2 = 0 THEN l_tax ELSE l_quantity * 1.5 END AS y0, CASE WHEN l_orderkey % 2 = 0 THEN l_discount ELSE l_quantity * 4.0 END AS x1, CASE WHEN l_orderkey % 2 = 0 THEN l_tax ELSE l_quantity * 5.0 END AS y1,
        CASE WHEN l_orderkey % 3 <> 0 THEN 574 ELSE 1000 END AS rw, CASE WHEN l_orderkey % 5 <> 0 THEN 1020 ELSE 2000 END AS rh FROM lineitem), s AS (SELECT *, CASE WHEN greatest(x1, y1) <= 1.5 THEN 1000::DOUBLE ELSE 1000::DOUBLE / rw END AS fx, CASE WHEN greatest(x1, y1) <= 1.5 THEN 2000::DOUBLE ELSE 2000::DOUBLE / rh END AS fy FROM r)
        SELECT l_orderkey, l_linenumber, CAST(trunc(x0 * fx) AS BIGINT) AS x0, CAST(trunc(y0 * fy) AS BIGINT) AS y0, CAST(trunc(x1 * fx) AS BIGINT) AS x1, CAST(trunc(y1 * fy) AS BIGINT) AS y1, round(CAST(trunc(x1 * fx) AS BIGINT) * 72.0::DOUBLE / 300, 6) AS width_pt FROM s""",
    "chunk_rebase": "SELECT doc_id // 40 AS chunk, min(doc_id // 40 * 40 + doc_id % 40) AS first_page, max(doc_id // 40 * 40 + doc_id % 40) AS last_page, round(CAST(sum(octet_length(encode(text))) AS DOUBLE) * 4 / 3 / 1048576, 6) AS mb FROM documents GROUP BY 1",
    "page_ranges": "WITH s AS (SELECT doc_id, doc_id % 7 AS a, doc_id % 7 AS b FROM documents UNION ALL SELECT doc_id, doc_id % 50, doc_id % 50 + 6 FROM documents UNION ALL SELECT doc_id, doc_id % 60 + 1, doc_id % 60 + 1 FROM documents) SELECT DISTINCT doc_id, p - 1 AS page FROM (SELECT doc_id, unnest(range(greatest(a, 1), least(b, 50) + 1)) AS p FROM s)",
    "pipeline_summary": f"{_CT}, n AS (SELECT book, length({Q.strip('text')}) AS n FROM pg), g AS (SELECT book, count(*) AS n_pages, avg(n) < 50 AS ocr_needed FROM n GROUP BY book), e AS (SELECT book, count(*) AS c FROM hc GROUP BY book) SELECT g.book, n_pages, ocr_needed, coalesce(c, 0) AS toc_count, round(n_pages * 0.004::DOUBLE, 6) AS cost FROM g LEFT JOIN e ON e.book = g.book",
    "reconstruct_summary": f"""WITH {BLOCKS.replace(", bl AS", ", b0 AS")}, f AS (SELECT *, page = 0 AND has_image AND NOT blank AND ink >= 0.5 AS cover FROM ({_FACTS})),
        b1 AS (SELECT b0.*, n_blocks, single_figure, has_image, blank FROM b0 JOIN f ON f.book = b0.book AND f.page = b0.page WHERE has_layout AND NOT cover),
        fd AS (WITH bl AS (SELECT * FROM b1){_DIVIDERS} SELECT book, min(page) AS fd FROM di GROUP BY book),
        bl AS (SELECT b1.* FROM b1 LEFT JOIN fd ON fd.book = b1.book WHERE NOT (coalesce(page < fd, false) AND NOT single_figure AND has_image AND NOT blank) AND NOT (n_blocks = 0 AND NOT blank AND has_image)){_TOC}{_MARKS},
        ct AS (SELECT book FROM bm UNION ALL SELECT book FROM hc WHERE book NOT IN (SELECT book FROM bm)), n AS (SELECT book, count(*) AS c FROM ct GROUP BY book)
        SELECT f.book, count(*) AS n_pages, coalesce(any_value(c), 0) AS toc_count FROM f LEFT JOIN n ON n.book = f.book GROUP BY f.book""",
    "book_cover": "SELECT doc_id // 50 AS book, 'cover-' || doc_id // 50 || '.png' AS image_path FROM documents WHERE doc_id % 50 = 0 AND doc_id // 50 % 4 = 0",
    "chapter_xhtml": f"""{_CT}, ct AS (SELECT book, page, title, 0 AS entry FROM hc){_CHAPTERS}{_HELD}, x AS (SELECT book, page, idx, CASE WHEN block_type = 'heading' THEN '<' || CASE WHEN level <= 1 THEN 'h1' ELSE 'h2' END || '>' || {Q.xhtml(Q.strip('text'))} || '</' || CASE WHEN level <= 1 THEN 'h1' ELSE 'h2' END || '>' ELSE '<p>' || {Q.xhtml(Q.merged('text'))} || '</p>' END AS html FROM bl WHERE {Q.strip('text')} <> '')
        SELECT ch.book, chapter, title, string_agg(html, chr(10) ORDER BY x.page, idx) AS body FROM x JOIN ch ON ch.book = x.book AND ch.page = x.page GROUP BY 1, 2, 3""",
}
