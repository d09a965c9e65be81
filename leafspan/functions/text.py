"""Text rules of page blocks as Column functions: headings, inline markup, soft wraps, lists, code, tables."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

WHITE = " \t\n\r\f\v"
#: Particles that join the word before them without a blank; fixed value.
PARTICLES = "는은이가를을에의도로와과만라며고서나든"
#: Characters that stand for a list bullet on a line of their own; fixed value.
BULLETS = ("◼", "◻", "●", "○", "•", "·", "▪", "▫", "▶", "►", "‣", "⁃", "-", "–", "—")
TITLE_LIMIT = 100
DIVIDER = r"^\s*[0-9]+\s*장\s*$"


def col(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def strip(c: Column | str) -> Column:
    """Without white space at either end."""
    return F.btrim(col(c), F.lit(WHITE))


def heading(c: Column | str) -> Column:
    """(level, title): level 1 to 6 if the text begins with that many # and white space, else 0 and the text itself."""
    pattern = r"(?s)^(#{1,6})[ \t\n\r\f\u000B]+(.*)$"
    marks = F.regexp_extract(col(c), pattern, 1)
    return F.struct(F.length(marks).alias("level"), F.when(F.length(marks) > 0, strip(F.regexp_extract(col(c), pattern, 2))).otherwise(col(c)).alias("title"))


def heading_tag(level: Column | str) -> Column:
    return F.when(col(level) <= 1, "h1").when(col(level) == 2, "h2").otherwise("h3")


def escape_html(c: Column | str) -> Column:
    out = col(c)
    for plain, entity in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;")):
        out = F.replace(out, F.lit(plain), F.lit(entity))
    return out


#: Inline marks in the order of their replacement: pattern, tag; fixed values.
INLINE = (
    (r"\$\^\{([^{}$]+)\}\$", "sup"), (r"\$\^([^ \t\n\r\f\u000B${}]+)\$", "sup"), (r"\$_\{([^{}$]+)\}\$", "sub"), (r"\$([^$]+)\$", ""),
    (r"`([^`]+)`", "code"), (r"\*\*([^\n]+?)\*\*", "strong"), (r"\*([^\n]+?)\*", "em"),
)


def to_xhtml(c: Column | str) -> Column:
    """Inline marks as tags; marks without a partner stay."""
    out = escape_html(c)
    for pattern, tag in INLINE:
        out = F.regexp_replace(out, pattern, f"<{tag}>$1</{tag}>" if tag else "$1")
    return out


def to_plain(c: Column | str) -> Column:
    out = col(c)
    for pattern, _ in INLINE:
        out = F.regexp_replace(out, pattern, "$1")
    return out


def starts_with_particle(c: Column | str) -> Column:
    return col(c).rlike(f"^[{PARTICLES}]( |$)") & ~col(c).rlike(r"^.\n")


def merge_text(before: Column | str, after: Column | str) -> Column:
    """Two lines as one: a blank between them, unless the second begins with a particle."""
    first, second = F.regexp_replace(col(before), r"[ \t\n\r\f\u000B]+\z", ""), F.regexp_replace(col(after), r"\A[ \t\n\r\f\u000B]+", "")
    return F.concat(first, F.when(starts_with_particle(second), "").otherwise(" "), second)


def _joined(lines: Column) -> Column:
    return F.array_join(F.transform(lines, lambda x, i: F.when((i == 0) | starts_with_particle(x), x).otherwise(F.concat(F.lit(" "), x))), "")


def _filled_lines(c: Column) -> Column:
    return F.filter(F.transform(F.split(c, "\n"), strip), lambda x: x != "")


def merge_lines(c: Column | str) -> Column:
    """All lines as one; blank lines do not part."""
    return _joined(_filled_lines(col(c)))


def paragraphs(c: Column | str) -> Column:
    """Blank lines part paragraphs, other line ends are soft."""
    return F.filter(F.transform(F.split(col(c), r"\n[ \t]*\n"), merge_lines), lambda p: p != "")


def clip_title(c: Column | str) -> Column:
    return F.when(F.length(col(c)) > TITLE_LIMIT, F.concat(F.substring(col(c), 1, TITLE_LIMIT - 3), F.lit("..."))).otherwise(col(c))


LIST_MARKER = r"^(?:([0-9]+)[.)]|[-*+•])[ \t\n\r\f\u000B]+"


def list_item(c: Column | str) -> Column:
    """(text, numbered, number) of a list line."""
    marked, number = col(c).rlike(LIST_MARKER), F.regexp_extract(col(c), LIST_MARKER, 1)
    numbered = F.coalesce(number != "", F.lit(False))
    return F.struct(F.when(marked, strip(F.regexp_replace(col(c), LIST_MARKER, ""))).otherwise(col(c)).alias("text"), numbered.alias("numbered"), F.when(numbered, number.cast("bigint")).alias("number"))


def drop_page_numbers(lines: Column) -> Column:
    """Lines that are neither blank nor digits alone."""
    return F.filter(lines, lambda x: (strip(x) != "") & ~strip(x).rlike("^[0-9]+$"))


def merge_bullets(lines: Column) -> Column:
    """A line that is a bullet alone takes the next line in; an ordered fold, as merged lines can be bullets again."""
    def step(done: Column, line: Column) -> Column:
        last = strip(F.element_at(done, -1))
        open_bullet = (F.size(done) > 0) & last.isin(*BULLETS)
        return F.when(open_bullet, F.concat(F.slice(done, 1, F.size(done) - 1), F.array(F.concat(last, F.lit(" "), strip(line))))).otherwise(F.concat(done, F.array(line)))

    def safe(done: Column, line: Column) -> Column:
        return F.when(F.size(done) == 0, F.array(line)).otherwise(step(done, line))

    return F.aggregate(lines, F.array().cast("array<string>"), safe)


def strip_code_fence(c: Column | str) -> Column:
    """Without a pair of fence lines; one fence alone stays."""
    lines = F.split(col(c), "\n")
    fenced = (F.size(lines) >= 2) & strip(F.get(lines, 0)).rlike(r"^```[^ \t\n\r\f\u000B]*$") & (strip(F.element_at(lines, -1)) == "```")
    return F.when(fenced, F.array_join(F.slice(lines, 2, F.greatest(F.size(lines) - 2, F.lit(0))), "\n")).otherwise(col(c))


def code_html(c: Column | str) -> Column:
    return F.concat(F.lit("<pre><code>"), escape_html(strip_code_fence(F.btrim(col(c), F.lit("\n")))), F.lit("</code></pre>"))


def figure_html(image: Column | str, caption: Column | str | None = None) -> Column:
    picture = F.concat(F.lit('<figure class="figure"><img src="images/'), col(image), F.lit('" alt="그림"/>'))
    text = F.lit("") if caption is None else F.coalesce(col(caption), F.lit(""))
    return F.concat(picture, F.when(text != "", F.concat(F.lit("<figcaption>"), to_xhtml(text), F.lit("</figcaption>"))).otherwise(""), F.lit("</figure>"))


def listing_html(code: Column | str, caption: Column | str) -> Column:
    return F.concat(F.lit('<figure class="listing"><figcaption>'), to_xhtml(caption), F.lit("</figcaption>"), code_html(code), F.lit("</figure>"))


def table_html(c: Column | str, caption: Column | str | None = None) -> Column:
    """A pipe table; text with fewer than two rows stays as it is.

    Cells at the edges that are empty count, unlike in the engine this follows, where
    they vanish.
    """
    rows = F.filter(_filled_lines(col(c)), lambda r: r.startswith("|"))
    cells = lambda r: F.transform(F.split(F.regexp_replace(F.regexp_replace(r, r"^\|", ""), r"\|$", ""), r"\|"), strip)
    kept = F.filter(rows, lambda r: ~F.forall(cells(r), lambda x: x.rlike("^[-: ]+$")))
    row = lambda r, i: F.concat(F.lit("<tr>"), F.array_join(F.transform(cells(r), lambda x: F.when(i == 0, F.concat(F.lit("<th>"), to_xhtml(x), F.lit("</th>"))).otherwise(F.concat(F.lit("<td>"), to_xhtml(x), F.lit("</td>")))), ""), F.lit("</tr>"))
    text = F.lit("") if caption is None else F.coalesce(col(caption), F.lit(""))
    table = F.concat(F.lit("<table>"), F.when(text != "", F.concat(F.lit("<caption>"), to_xhtml(text), F.lit("</caption>"))).otherwise(""), F.array_join(F.transform(kept, row), ""), F.lit("</table>"))
    return F.when(F.size(rows) < 2, F.concat(F.lit("<pre>"), escape_html(strip(c)), F.lit("</pre>"))).otherwise(table)


def safe_filename(title: Column | str, fallback: Column | str) -> Column:
    base = strip(F.when(F.coalesce(col(title), F.lit("")) != "", col(title)).otherwise(col(fallback)))
    kept = strip(F.substring(F.regexp_replace(base, r"(?U)[^\w가-힣 ._-]", ""), 1, 100))
    return F.when(kept != "", kept).otherwise(col(fallback))


def is_noise(c: Column | str) -> Column:
    """One character alone that is neither a digit nor a Hangul syllable."""
    text = strip(c)
    return (F.length(text) == 1) & ~text.rlike("^[0-9가-힣]$")
