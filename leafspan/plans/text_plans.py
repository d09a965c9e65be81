"""Queries over lines and page texts, with marks put in where the tables have none."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import geometry as G
from ..functions import text as T
from ..operators import blocks as B
from ..operators import runs as R
from . import sqltext as Q
from .tables import LINES, PAGES, lines, pages, table


def parse_heading(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = lines(spark, sf_dir).select("doc_id", "idx", F.concat(F.repeat(F.lit("#"), (F.col("idx") % 8).cast("int")), F.when(F.col("idx") % 5 == 4, "").otherwise(" "), "line").alias("m"))
    head = T.heading("m")
    return rows.select("doc_id", "idx", head["level"].cast("bigint").alias("level"), head["title"].alias("title"), T.heading_tag(head["level"]).alias("tag"))


MARKED = "'**' || line || '** & <x> `c` \"$^{2}$ $_{i}$ $^q$ $m$ *it* $ ** _u_ ' || idx"


def _marked(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lines(spark, sf_dir).select("doc_id", "idx", F.concat(F.lit("**"), "line", F.lit('** & <x> `c` "$^{2}$ $_{i}$ $^q$ $m$ *it* $ ** _u_ '), "idx").alias("m"))


def to_xhtml(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _marked(spark, sf_dir).select("doc_id", "idx", T.to_xhtml("m").alias("html"))


def to_plain(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _marked(spark, sf_dir).select("doc_id", "idx", T.to_plain("m").alias("plain"), T.clip_title(T.to_plain("m")).alias("title"))


WRAPPED = "replace(replace(text, '.' || chr(10), '.' || chr(10) || ' ' || chr(10)), ', ', ',' || chr(10) || '는 ')"


def _wrapped(spark: SparkSession, sf_dir: str) -> DataFrame:
    text = F.replace(F.replace(F.col("text"), F.lit(".\n"), F.lit(".\n \n")), F.lit(", "), F.lit(",\n는 "))
    return pages(spark, sf_dir).select("doc_id", text.alias("t"))


def soft_wrap(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _wrapped(spark, sf_dir).select("doc_id", F.posexplode(T.paragraphs("t")).alias("n", "paragraph"))
    return rows.withColumn("n", F.col("n").cast("bigint"))


def merge_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _wrapped(spark, sf_dir).select("doc_id", T.merge_lines("t").alias("merged"), T.merge_text(F.substring("t", 1, 20), F.substring("t", 21, 20)).alias("two"))


LISTED = "CASE idx % 7 WHEN 0 THEN '- ' WHEN 1 THEN '• ' WHEN 2 THEN (idx + 5)::VARCHAR || '. ' WHEN 3 THEN (idx + 5)::VARCHAR || ') ' WHEN 4 THEN (idx + 5)::VARCHAR || '. ' WHEN 5 THEN '* ' ELSE '' END || line"


def list_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    marker = F.element_at(F.array(F.lit("- "), F.lit("• "), F.concat(F.col("idx") + 5, F.lit(". ")), F.concat(F.col("idx") + 5, F.lit(") ")), F.concat(F.col("idx") + 5, F.lit(". ")), F.lit("* "), F.lit("")), (F.col("idx") % 7 + 1).cast("int"))
    rows = lines(spark, sf_dir).select("doc_id", "idx", F.concat(marker, "line").alias("line"))
    return R.list_runs(rows, ["doc_id"]).withColumn("items", F.array_join("items", "|"))


#: Lines of a page with lone bullets and page numbers between them.
BULLETED = "list_transform(string_split(text, chr(10)), lambda s, i: CASE i % 5 WHEN 0 THEN ' • ' WHEN 3 THEN ' ' || i || ' ' WHEN 4 THEN '-' ELSE s END)"


def _bulleted(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = F.transform(F.split("text", "\n"), lambda s, i: F.when((i + 1) % 5 == 0, " • ").when((i + 1) % 5 == 3, F.concat(F.lit(" "), i + 1, F.lit(" "))).when((i + 1) % 5 == 4, "-").otherwise(s))
    return pages(spark, sf_dir).select("doc_id", rows.alias("a"))


def drop_page_numbers(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _bulleted(spark, sf_dir).select("doc_id", F.array_join(T.drop_page_numbers(F.col("a")), "\n").alias("kept"))


def text_blocks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _bulleted(spark, sf_dir).select("doc_id", F.array_join(B.text_layer(F.col("a")), "\n").alias("cleaned")).where(T.strip("cleaned") != "")


_KEPT = f"list_filter({BULLETED}, lambda s: {Q.strip('s')} <> '' AND NOT regexp_matches({Q.strip('s')}, '^[0-9]+$'))"
_BULLET_SET = "'^[" + "".join(b for b in T.BULLETS if b != "-") + "-]$'"
_LAST = Q.strip("regexp_extract(a, '[^' || chr(10) || ']*$')")
_FOLD = f"list_reduce({_KEPT}, lambda a, s: CASE WHEN regexp_matches({_LAST}, {_BULLET_SET}) THEN regexp_replace(a, '[^' || chr(10) || ']*$', '') || {_LAST} || ' ' || {Q.strip('s')} ELSE a || chr(10) || s END)"


def code_block(spark: SparkSession, sf_dir: str) -> DataFrame:
    fence = F.when(F.col("doc_id") % 3 == 0, F.concat(F.lit("```py\n"), "text", F.lit("\n```"))).when(F.col("doc_id") % 3 == 1, F.concat(F.lit("```\n"), "text")).otherwise(F.concat("text", F.lit("\n")))
    return pages(spark, sf_dir).select("doc_id", T.code_html(fence).alias("html"))


_FENCED = "CASE doc_id % 3 WHEN 0 THEN '```py' || chr(10) || text || chr(10) || '```' WHEN 1 THEN '```' || chr(10) || text ELSE text || chr(10) END"


def pipe_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = F.transform(F.split("text", "\n"), lambda s, i: F.when(i == 1, "|---|:-:|").when(i % 4 == 3, s).otherwise(F.concat(F.lit("| "), F.replace(F.replace(s, F.lit("|"), F.lit("/")), F.lit(". "), F.lit(" | ")), F.lit(" |"))))
    return pages(spark, sf_dir).select("doc_id", T.table_html(F.array_join(rows, "\n"), F.concat(F.lit("Table *"), "doc_id", F.lit("*"))).alias("html"))


def _sql_table() -> str:
    cells = lambda r: f"list_transform(string_split(regexp_replace(regexp_replace({r}, '^\\|', ''), '\\|$', ''), '|'), lambda x: {Q.strip('x')})"
    tagged = lambda tag: f"array_to_string(list_transform({cells('r')}, lambda x: '<{tag}>' || {Q.xhtml('x')} || '</{tag}>'), '')"
    return f"""WITH {PAGES}, t AS (SELECT doc_id, array_to_string(list_transform(string_split(text, chr(10)), lambda s, i: CASE WHEN i = 2 THEN '|---|:-:|' WHEN i % 4 = 0 THEN s ELSE '| ' || replace(replace(s, '|', '/'), '. ', ' | ') || ' |' END), chr(10)) AS md FROM pg),
    r AS (SELECT doc_id, md, list_filter(list_transform(string_split(md, chr(10)), lambda s: {Q.strip('s')}), lambda s: starts_with(s, '|')) AS rows FROM t),
    k AS (SELECT *, list_filter(rows, lambda r: len(list_filter({cells('r')}, lambda x: NOT regexp_matches(x, '^[-: ]+$'))) > 0) AS kept FROM r)
    SELECT doc_id, CASE WHEN len(rows) < 2 THEN '<pre>' || {Q.escape(Q.strip('md'))} || '</pre>' ELSE '<table><caption>Table <em>' || doc_id || '</em></caption>' || array_to_string(list_transform(kept, lambda r, i: '<tr>' || CASE WHEN i = 1 THEN {tagged('th')} ELSE {tagged('td')} END || '</tr>'), '') || '</table>' END AS html FROM k"""


def figure_html(spark: SparkSession, sf_dir: str) -> DataFrame:
    name = F.format_string("page_%04d_blk_%03d.png", F.col("page"), (F.col("idx")).cast("int"))
    caption = F.when(F.col("idx") % 2 == 0, T.merge_lines("line")).otherwise("")
    return lines(spark, sf_dir).select("doc_id", "idx", T.figure_html(name, caption).alias("figure"), T.listing_html("line", T.merge_lines("line")).alias("listing"))


def safe_name(spark: SparkSession, sf_dir: str) -> DataFrame:
    title = F.when(F.col("doc_id") % 9 == 0, "").when(F.col("doc_id") % 9 == 1, "?!/").otherwise(F.substring("text", 1, 120))
    return table(spark, sf_dir, "documents").select("doc_id", T.safe_filename(title, F.concat(F.lit("job-"), "doc_id")).alias("name"), F.format_string("chapter_%03d", F.col("doc_id")).alias("chapter_file"))


def accent_colour(spark: SparkSession, sf_dir: str) -> DataFrame:
    at = lambda i: (F.floor(F.abs(F.get("embedding", i).cast("double")) * 1000.0) % 256).cast("bigint")
    rows = table(spark, sf_dir, "embeddings").select("vec_id", *(F.when(F.col("vec_id") % 10 == 0, at(0)).otherwise(at(i)).alias(c) for i, c in enumerate("rgb")))
    strong = G.accent("r", "g", "b")
    return rows.select("vec_id", G.hex_colour("r", "g", "b").alias("colour"), G.hex_colour(strong["r"], strong["g"], strong["b"]).alias("accent"))


def _sql_accent() -> str:
    channel = lambda shift: f"""CAST(least(greatest(round_even(CASE WHEN ns = 0 THEN nl ELSE CASE
      WHEN (h + {shift} - floor(h + {shift})) < 1.0::DOUBLE / 6 THEN lo + (hi - lo) * (h + {shift} - floor(h + {shift})) * 6
      WHEN (h + {shift} - floor(h + {shift})) < 0.5 THEN hi WHEN (h + {shift} - floor(h + {shift})) < 2.0::DOUBLE / 3 THEN lo + (hi - lo) * (2.0::DOUBLE / 3 - (h + {shift} - floor(h + {shift}))) * 6 ELSE lo END END * 255, 0), 0), 255) AS BIGINT)"""  # noqa: E731
    two = lambda x: f"lpad(lower(to_hex({x})), 2, '0')"
    return f"""WITH e AS (SELECT vec_id, CASE WHEN vec_id % 10 = 0 THEN 1 ELSE 2 END AS g1, CASE WHEN vec_id % 10 = 0 THEN 1 ELSE 3 END AS b1, embedding FROM embeddings),
    c AS (SELECT vec_id, floor(abs(embedding[1]::DOUBLE) * 1000)::BIGINT % 256 AS r, floor(abs(embedding[g1]::DOUBLE) * 1000)::BIGINT % 256 AS g, floor(abs(embedding[b1]::DOUBLE) * 1000)::BIGINT % 256 AS b FROM e),
    d AS (SELECT *, r / 255.0::DOUBLE AS x, g / 255.0::DOUBLE AS y, b / 255.0::DOUBLE AS z FROM c),
    m AS (SELECT *, greatest(x, y, z) AS mx, least(x, y, z) AS mn FROM d),
    s AS (SELECT *, (mx + mn) / 2 AS l, CASE WHEN mx = mn THEN 0 WHEN (mx + mn) / 2 <= 0.5 THEN (mx - mn) / (mx + mn) ELSE (mx - mn) / (2 - mx - mn) END AS sat,
      CASE WHEN mx = mn THEN 0 WHEN x = mx THEN (mx - z) / (mx - mn) - (mx - y) / (mx - mn) WHEN y = mx THEN 2 + (mx - x) / (mx - mn) - (mx - z) / (mx - mn) ELSE 4 + (mx - y) / (mx - mn) - (mx - x) / (mx - mn) END / 6 AS t FROM m),
    n AS (SELECT *, t - floor(t) AS h, least(l * 0.62::DOUBLE, 0.55::DOUBLE) AS nl, CASE WHEN sat <= 0 THEN 0 ELSE least(greatest(sat * 3, 0.45::DOUBLE), 1) END AS ns FROM s),
    o AS (SELECT *, CASE WHEN nl <= 0.5 THEN nl * (1 + ns) ELSE nl + ns - nl * ns END AS hi FROM n), p AS (SELECT *, 2 * nl - hi AS lo FROM o)
    SELECT vec_id, '#' || {two('r')} || {two('g')} || {two('b')} AS colour, '#' || {two(channel('1.0::DOUBLE / 3'))} || {two(channel('0.0::DOUBLE'))} || {two(channel('-1.0::DOUBLE / 3'))} AS accent FROM p"""


QUERIES = {f.__name__: f for f in (parse_heading, to_xhtml, to_plain, soft_wrap, merge_lines, list_runs, drop_page_numbers, text_blocks, code_block, pipe_table, figure_html, safe_name, accent_colour)}

_H = r"'^(#{1,6})[ \t\n\r\f\v]+((?s:.*))$'"
_ITEM = r"'^(?:([0-9]+)[.)]|[-*+•])[ \t\n\r\f\v]+'"
SQL = {
    "parse_heading": f"""WITH {LINES}, m AS (SELECT doc_id, idx, repeat('#', CAST(idx % 8 AS INT)) || CASE WHEN idx % 5 = 4 THEN '' ELSE ' ' END || line AS m FROM ln),
        l AS (SELECT *, length(regexp_extract(m, {_H}, 1)) AS level FROM m)
        SELECT doc_id, idx, level, CASE WHEN level > 0 THEN {Q.strip(f'regexp_extract(m, {_H}, 2)')} ELSE m END AS title, CASE WHEN level <= 1 THEN 'h1' WHEN level = 2 THEN 'h2' ELSE 'h3' END AS tag FROM l""",
    "to_xhtml": f"WITH {LINES}, m AS (SELECT doc_id, idx, {MARKED} AS m FROM ln) SELECT doc_id, idx, {Q.xhtml('m')} AS html FROM m",
    "to_plain": f"WITH {LINES}, m AS (SELECT doc_id, idx, {MARKED} AS m FROM ln), p AS (SELECT doc_id, idx, {Q.plain('m')} AS plain FROM m) SELECT *, {Q.clip('plain')} AS title FROM p",
    "soft_wrap": f"""WITH {PAGES}, w AS (SELECT doc_id, {WRAPPED} AS t FROM pg), g AS (SELECT doc_id, list_filter(list_transform(regexp_split_to_array(t, '\\n[ \\t]*\\n'), lambda x: {Q.merged('x')}), lambda x: x <> '') AS a FROM w)
        SELECT doc_id, unnest(range(len(a))) AS n, unnest(a) AS paragraph FROM g""",
    "merge_lines": f"""WITH {PAGES}, w AS (SELECT doc_id, {WRAPPED} AS t FROM pg), x AS (SELECT doc_id, {Q.merged('t')} AS merged, rtrim(substring(t, 1, 20), {Q.WS}) AS p, ltrim(substring(t, 21, 20), {Q.WS}) AS q FROM w)
        SELECT doc_id, merged, p || CASE WHEN {Q.particle('q')} THEN '' ELSE ' ' END || q AS two FROM x""",
    "list_runs": f"""WITH {LINES}, m AS (SELECT doc_id, idx, {Q.strip(LISTED)} AS s FROM ln), i AS (SELECT doc_id, idx, regexp_matches(s, {_ITEM}) AS marked, regexp_extract(s, {_ITEM}, 1) AS num, s FROM m WHERE s <> ''),
        t AS (SELECT doc_id, idx, num <> '' AS numbered, num, CASE WHEN marked THEN {Q.strip(f"regexp_replace(s, {_ITEM}, '')")} ELSE s END AS text FROM i), f AS (SELECT * FROM t WHERE text <> ''),
        n AS (SELECT *, CASE WHEN numbered IS DISTINCT FROM lag(numbered) OVER (PARTITION BY doc_id ORDER BY idx) THEN 1 ELSE 0 END AS new FROM f),
        r AS (SELECT *, sum(new) OVER (PARTITION BY doc_id ORDER BY idx) AS run FROM n)
        SELECT doc_id, CAST(run AS BIGINT) AS run, arg_min(numbered, idx) AS ordered, CASE WHEN arg_min(numbered, idx) THEN CAST(arg_min(num, idx) AS BIGINT) END AS start, count(*) AS n_items, string_agg(text, '|' ORDER BY idx) AS items FROM r GROUP BY doc_id, run""",
    "drop_page_numbers": f"WITH {PAGES} SELECT doc_id, array_to_string({_KEPT}, chr(10)) AS kept FROM pg",
    "text_blocks": f"WITH {PAGES}, f AS (SELECT doc_id, CASE WHEN len({_KEPT}) > 0 THEN {_FOLD} ELSE '' END AS cleaned FROM pg) SELECT * FROM f WHERE {Q.strip('cleaned')} <> ''",
    "code_block": f"""WITH {PAGES}, t AS (SELECT doc_id, string_split(trim({_FENCED}, chr(10)), chr(10)) AS a FROM pg)
        SELECT doc_id, '<pre><code>' || {Q.escape("array_to_string(CASE WHEN len(a) >= 2 AND regexp_matches(" + Q.strip('a[1]') + ", '^```[^ \\t\\n\\r\\f\\v]*$') AND " + Q.strip('a[-1]') + " = '```' THEN a[2:-2] ELSE a END, chr(10))")} || '</code></pre>' AS html FROM t""",
    "pipe_table": _sql_table(),
    "figure_html": f"""WITH {LINES}, c AS (SELECT doc_id, idx, line, format('page_{{:04d}}_blk_{{:03d}}.png', page, idx) AS name, {Q.merged('line')} AS cap FROM ln)
        SELECT doc_id, idx, '<figure class="figure"><img src="images/' || name || '" alt="그림"/>' || CASE WHEN idx % 2 = 0 AND cap <> '' THEN '<figcaption>' || {Q.xhtml('cap')} || '</figcaption>' ELSE '' END || '</figure>' AS figure,
        '<figure class="listing"><figcaption>' || {Q.xhtml('cap')} || '</figcaption><pre><code>' || {Q.escape('line')} || '</code></pre></figure>' AS listing FROM c""",
    "safe_name": f"""WITH t AS (SELECT doc_id, CASE doc_id % 9 WHEN 0 THEN '' WHEN 1 THEN '?!/' ELSE substring(text, 1, 120) END AS title, 'job-' || doc_id AS fb FROM documents),
        n AS (SELECT doc_id, fb, {Q.strip("substring(regexp_replace(" + Q.strip("CASE WHEN title <> '' THEN title ELSE fb END") + ", '[^\\p{L}\\p{M}\\p{N}\\p{Pc} .-]', '', 'g'), 1, 100)")} AS k FROM t)
        SELECT doc_id, CASE WHEN k <> '' THEN k ELSE fb END AS name, format('chapter_{{:03d}}', doc_id) AS chapter_file FROM n""",
    "accent_colour": _sql_accent(),
}
