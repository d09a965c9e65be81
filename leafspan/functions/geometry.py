"""Boxes, colours, progress and names as Column functions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .text import col

TINT_TOLERANCE = 8
DPI = 300
#: Stage, first percent, span; fixed values.
STAGES = {"render": (0, 10), "preprocess": (10, 10), "ocr": (20, 55), "ocr_api": (20, 60), "extract": (20, 65), "layout": (75, 10), "build": (90, 10)}


def scale_box(x0, y0, x1, y1, width, height, ref_width, ref_height) -> Column:
    """Pixel box of a block: coordinates up to 1.5 are shares of the image, others are relative to the reference size."""
    x0, y0, x1, y1, width, height = map(col, (x0, y0, x1, y1, width, height))
    share = F.greatest(x1, y1) <= 1.5
    fx = F.when(share, width.cast("double")).otherwise(width / F.coalesce(F.nullif(col(ref_width), F.lit(0)), width))
    fy = F.when(share, height.cast("double")).otherwise(height / F.coalesce(F.nullif(col(ref_height), F.lit(0)), height))
    whole = lambda v: v.cast("bigint")  # noqa: E731  casts cut towards zero
    return F.struct(whole(x0 * fx).alias("x0"), whole(y0 * fy).alias("y0"), whole(x1 * fx).alias("x1"), whole(y1 * fy).alias("y1"))


def polygon_box(xs: Column, ys: Column) -> Column:
    return F.struct(F.array_min(xs).alias("x0"), F.array_min(ys).alias("y0"), F.array_max(xs).alias("x1"), F.array_max(ys).alias("y1"))


def area(x0, y0, x1, y1) -> Column:
    return F.greatest(F.lit(0), col(x1) - col(x0)) * F.greatest(F.lit(0), col(y1) - col(y0))


def padded(box: Column, width, height, pad: int) -> Column:
    """A box with a margin, inside the image; null if nothing is left."""
    x0, y0 = F.greatest(F.lit(0), box["x0"] - pad), F.greatest(F.lit(0), box["y0"] - pad)
    x1, y1 = F.least(col(width), box["x1"] + pad), F.least(col(height), box["y1"] + pad)
    return F.when((x1 > x0) & (y1 > y0), F.struct(x0.alias("x0"), y0.alias("y0"), x1.alias("x1"), y1.alias("y1")))


def points(pixels: Column | str) -> Column:
    """Length of a PDF side; longer than 14,400 points is more than a page may have."""
    return col(pixels) * 72.0 / DPI


def progress(stage: str, done, total) -> Column:
    first, span = STAGES[stage]
    return F.lit(first) + (col(done) / col(total) * span).cast("int")


def close_colours(a: Column, b: Column, tolerance: int = TINT_TOLERANCE) -> Column:
    return (F.abs(a["r"] - b["r"]) <= tolerance) & (F.abs(a["g"] - b["g"]) <= tolerance) & (F.abs(a["b"] - b["b"]) <= tolerance)


def hex_colour(r, g, b) -> Column:
    two = lambda c: F.lower(F.lpad(F.hex(col(c).cast("bigint")), 2, "0"))
    return F.concat(F.lit("#"), two(r), two(g), two(b))


def let(value: Column, use) -> Column:
    """``use`` of a value that is computed once, however often it is named."""
    return F.get(F.transform(F.array(value), use), 0)


def accent(r, g, b) -> Column:
    """The strong colour beside a tinted box: same hue, darker, more saturated; grey stays grey."""
    shares = F.struct((col(r) / 255.0).alias("r"), (col(g) / 255.0).alias("g"), (col(b) / 255.0).alias("b"))

    def hls(c: Column) -> Column:
        most, least = F.greatest(c["r"], c["g"], c["b"]), F.least(c["r"], c["g"], c["b"])
        return let(F.struct(most.alias("most"), least.alias("least"), (most - least).alias("spread"), ((most + least) / 2.0).alias("light")), lambda m: turned(c, m))

    def turned(c: Column, m: Column) -> Column:
        third = lambda x: (m["most"] - x) / m["spread"]
        saturation = F.when(m["spread"] == 0, 0.0).when(m["light"] <= 0.5, m["spread"] / (m["most"] + m["least"])).otherwise(m["spread"] / (2.0 - m["most"] - m["least"]))
        turn = F.when(m["spread"] == 0, 0.0).when(c["r"] == m["most"], third(c["b"]) - third(c["g"])).when(c["g"] == m["most"], 2.0 + third(c["r"]) - third(c["b"])).otherwise(4.0 + third(c["g"]) - third(c["r"])) / 6.0
        return let(F.struct(saturation.alias("s"), turn.alias("t"), F.least(m["light"] * 0.62, F.lit(0.55)).alias("l")), lambda v: raised(v))

    def raised(v: Column) -> Column:
        strong = F.when(v["s"] <= 0, 0.0).otherwise(F.least(F.greatest(v["s"] * 3, F.lit(0.45)), F.lit(1.0)))
        return let(F.struct((v["t"] - F.floor(v["t"])).alias("h"), v["l"].alias("l"), strong.alias("s")), lambda w: let(
            F.struct(w["h"].alias("h"), w["l"].alias("l"), w["s"].alias("s"), F.when(w["l"] <= 0.5, w["l"] * (1.0 + w["s"])).otherwise(w["l"] + w["s"] - w["l"] * w["s"]).alias("high")),
            lambda z: F.struct(*(channel(z, shift).alias(name) for name, shift in (("r", 1 / 3), ("g", 0.0), ("b", -1 / 3))))))

    def channel(z: Column, shift: float) -> Column:
        high, low = z["high"], 2.0 * z["l"] - z["high"]
        around = let(z["h"] + shift, lambda x: x - F.floor(x))
        value = let(around, lambda at: F.when(at < 1 / 6, low + (high - low) * at * 6.0).when(at < 0.5, high).when(at < 2 / 3, low + (high - low) * (2 / 3 - at) * 6.0).otherwise(low))
        return F.least(F.greatest(F.bround(F.when(z["s"] == 0, z["l"]).otherwise(value) * 255.0, 0), F.lit(0.0)), F.lit(255.0)).cast("bigint")

    return let(shares, hls)
