"""Runs of blocks on a page.

Lists break where the kind of marker changes, which a look at the line before
decides.  Tints and captions depend on what an earlier block has begun, so they are
ordered folds over the page's blocks; a page bounds the array.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text as T
from ..functions.geometry import close_colours
from .blocks import TINTED


def list_runs(lines: DataFrame, page: list[str], order: str = "idx", line: str = "line") -> DataFrame:
    """(page, run, ordered, start, n_items, items) of list lines; blank items vanish first."""
    item = T.list_item(T.strip(line))
    rows = lines.where(T.strip(line) != "").select(*page, order, item.alias("item")).where("item.text <> ''")
    by_page = Window.partitionBy(*page).orderBy(order)
    new = F.coalesce((F.col("item.numbered") != F.lag("item.numbered").over(by_page)).cast("int"), F.lit(1))
    rows = rows.withColumn("new", new).withColumn("run", F.sum("new").over(by_page.rowsBetween(Window.unboundedPreceding, 0)))
    items = F.transform(F.array_sort(F.collect_list(F.struct(order, "item"))), lambda s: s["item"])
    runs = rows.groupBy(*page, "run").agg(items.alias("items"))
    first = F.get("items", 0)
    return runs.select(*page, F.col("run").cast("bigint").alias("run"), first["numbered"].alias("ordered"), F.when(first["numbered"], first["number"]).alias("start"), F.size("items").cast("bigint").alias("n_items"), F.transform("items", lambda i: i["text"]).alias("items"))


def tint_runs(blocks: Column) -> Column:
    """Runs of blocks whose colour is close to that of the run's first: array of (start, end, r, g, b).

    ``blocks`` is an ordered array of struct(block_type, bg).  If all text blocks of
    the page have one colour it is the paper's, and there are no runs.
    """
    texts = F.filter(blocks, lambda b: b["block_type"].isin(*TINTED))
    anchor = F.get(texts, 0)["bg"]
    paper = (F.size(texts) > 0) & F.forall(texts, lambda b: F.coalesce(close_colours(b["bg"], anchor), F.lit(False)))
    kind = "array<struct<start:bigint,end:bigint,r:int,g:int,b:int>>"
    numbered = F.transform(blocks, lambda b, i: F.struct(i.alias("i"), b["bg"].alias("bg")))

    def step(runs: Column, b: Column) -> Column:
        last = F.try_element_at(runs, F.lit(-1))
        joins = (F.size(runs) > 0) & (last["end"] == b["i"]) & close_colours(b["bg"], last)
        new = F.struct(b["i"].cast("bigint").alias("start"), (b["i"] + 1).cast("bigint").alias("end"), b["bg"]["r"].cast("int").alias("r"), b["bg"]["g"].cast("int").alias("g"), b["bg"]["b"].cast("int").alias("b"))
        longer = F.struct(last["start"].alias("start"), (b["i"] + 1).cast("bigint").alias("end"), last["r"].alias("r"), last["g"].alias("g"), last["b"].alias("b"))
        return F.when(b["bg"].isNull(), runs).when(F.coalesce(joins, F.lit(False)), F.concat(F.slice(runs, 1, F.greatest(F.size(runs) - 1, F.lit(0))), F.array(longer))).otherwise(F.concat(runs, F.array(new)))

    return F.when(paper, F.array().cast(kind)).otherwise(F.aggregate(numbered, F.array().cast(kind), step))


def caption_pairs(blocks: Column) -> Column:
    """Blocks in order, captions joined to what they describe: array of (kind, at, caption_at).

    Greedy from the left: a figure takes a caption behind it; a caption takes a figure,
    table or code behind it; all else stands alone.  ``blocks`` is an ordered array of
    struct(block_type, filled), filled telling that there is an image or text.
    """
    kind = "array<struct<kind:string,at:int,caption_at:int>>"
    numbered = F.transform(blocks, lambda b, i: F.struct(i.alias("i"), b["block_type"].alias("t"), b["filled"].alias("filled")))
    one = lambda k, at, caption: F.struct(k.alias("kind"), at.cast("int").alias("at"), caption.cast("int").alias("caption_at"))
    none = F.lit(None).cast("int")

    def step(done: Column, b: Column) -> Column:
        last = F.try_element_at(done, F.lit(-1))
        alone = F.coalesce(last["caption_at"].isNull(), F.lit(False))
        before = F.slice(done, 1, F.greatest(F.size(done) - 1, F.lit(0)))
        takes = (b["t"] == "caption") & alone & (last["kind"] == "figure")
        taken = alone & (last["kind"] == "caption") & b["t"].isin("figure", "table", "code") & b["filled"]
        return (F.when(F.coalesce(takes, F.lit(False)), F.concat(before, F.array(one(F.lit("figure"), last["at"], b["i"]))))
                .when(F.coalesce(taken, F.lit(False)), F.concat(before, F.array(one(b["t"], b["i"], last["at"]))))
                .otherwise(F.concat(done, F.array(one(F.when((b["t"] == "figure") & ~b["filled"], F.lit("empty figure")).otherwise(b["t"]), b["i"], none)))))

    return F.aggregate(numbered, F.array().cast(kind), step)
