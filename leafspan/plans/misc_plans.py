"""Queries over jobs and their progress, and over images held as numbers."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import frames, geometry, pixels
from ..operators import jobs as J
from ..streaming import progress as S
from .tables import pages, table

_STATUS = "CASE event_type WHEN 'signup' THEN 'pending' WHEN 'view' THEN 'processing' WHEN 'click' THEN 'processing' WHEN 'purchase' THEN 'done' ELSE 'failed' END"


def _progress(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events as progress of a client's job."""
    return table(spark, sf_dir, "events").selectExpr("event_id", "user_id", "ts", "event_type AS stage", "cast(floor(value * 3) as bigint) - 20 AS progress", f"{_STATUS} AS status", "repeat(concat(event_type, ' ', event_id, ' '), 20) AS message", "props")


def latest_progress(spark: SparkSession, sf_dir: str) -> DataFrame:
    return J.latest(_progress(spark, sf_dir).select("user_id", "event_id", "ts", "stage", "progress"), "user_id", "ts", "event_id").select("user_id", "event_id", "stage", "progress")


def progress_changes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return J.changes(_progress(spark, sf_dir), "user_id", "stage", "ts", "event_id").select("user_id", "event_id", "stage")


def active_jobs(spark: SparkSession, sf_dir: str) -> DataFrame:
    now = J.latest(_progress(spark, sf_dir).select("user_id", "event_id", "ts", "status"), "user_id", "ts", "event_id")
    return J.active(now, "user_id")


def admit_uploads(spark: SparkSession, sf_dir: str) -> DataFrame:
    now = J.latest(_progress(spark, sf_dir).select("user_id", "event_id", "ts", "status"), "user_id", "ts", "event_id")
    uploads = table(spark, sf_dir, "customer").selectExpr("c_custkey", "c_custkey % 400 AS user_id", "concat(c_name, CASE WHEN c_custkey % 4 = 0 THEN '.txt' WHEN c_custkey % 4 = 1 THEN '.PDF' ELSE '.pdf' END) AS filename", "c_custkey * 300000 AS size")
    return J.admit(uploads, now, "user_id").select("c_custkey", "user_id", "filename")


def job_transitions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return J.transitions(_progress(spark, sf_dir), "user_id", "ts", "event_id")


def job_fields(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _progress(spark, sf_dir).selectExpr("event_id", "progress", "repeat(stage, 9) AS stage", "CASE WHEN event_id % 3 = 0 THEN '' ELSE message END AS message", "repeat(props, 300) AS error", "repeat(stage, 50) AS title", "CASE WHEN event_id % 5 = 0 THEN NULL WHEN event_id % 5 = 1 THEN '' ELSE repeat('10.0.0.1 ', 9) END AS client_ip")
    return J.clamp_fields(rows)


def job_states(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What a download and a repeated call would give."""
    rows = _progress(spark, sf_dir)
    status = F.when(F.col("event_id") % 7 != 0, F.col("status"))
    http = F.when(F.col("event_id") % 6 == 0, None).when(F.col("event_id") % 6 == 1, 200).when(F.col("event_id") % 6 == 2, 429).when(F.col("event_id") % 6 == 3, 503).when(F.col("event_id") % 6 == 4, 401).otherwise(200)
    stage = geometry.progress("ocr", F.col("event_id") % 40 + 1, F.lit(40))
    return rows.select("event_id", J.download_state(status, F.col("event_id") % 5 != 0).cast("bigint").alias("download"), J.call_outcome(http, F.col("event_id") % 6 != 5, F.col("event_id") % 3 + 1).alias("call"), stage.cast("bigint").alias("percent"))


def sessions_stream(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Extension: sessions of clients, by a stream over the events."""
    return S.run_sessions(spark, f"{sf_dir}/events.parquet")


def _pixels(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each vector as 64 pixels; every third page bright, every seventh plain."""
    value = lambda e: (F.floor(F.abs(e.cast("double")) * 2000.0) % 256).cast("int")
    bright = F.col("vec_id") % 3 == 0
    plain = F.col("vec_id") % 7 == 0
    tone = lambda v, m, i: F.when(plain, 200 + (v % 5)).when(bright, 255 - ((v * m + i) % 70)).otherwise((v * m + i) % 256).cast("int")
    pixel = lambda e, i: F.struct(tone(value(e), 1, 0).alias("r"), tone(value(e), 7, i).alias("g"), tone(value(e), 3, i * 2).alias("b"))
    return table(spark, sf_dir, "embeddings").select("vec_id", F.transform("embedding", pixel).alias("px"))


def blank_ink_chroma(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _pixels(spark, sf_dir).select("vec_id", F.round(pixels.largest_deviation("px"), 6).alias("deviation"), pixels.is_blank("px").alias("blank"), F.round(pixels.ink_coverage("px"), 6).alias("ink"), F.round(pixels.chroma_coverage("px"), 6).alias("chroma"))


def bg_colour(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = pixels.background("px")
    return _pixels(spark, sf_dir).select("vec_id", found["r"].alias("r"), found["g"].alias("g"), found["b"].alias("b"))


def content_bbox(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each vector as an 8 x 8 image: rows and columns with content, and the box that they span."""
    on = F.transform("embedding", lambda e: F.abs(e.cast("double")) > 0.25)
    box = geometry.let(on, lambda x: pixels.content_box(x, 8))
    rows = table(spark, sf_dir, "embeddings").select("vec_id", box.alias("box")).where("box is not null")
    return rows.select("vec_id", *(F.col(f"box.{c}").cast("bigint").alias(f"{c}_") for c in ("left", "top", "right", "bottom")))


def frame_ops(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Images drawn from page numbers: framed, round-cornered and plain ones, through the frame rules."""
    rows = pages(spark, sf_dir).select("doc_id", "page")

    def look(batches):
        for batch in batches:
            out = []
            for doc, page in zip(batch["doc_id"], batch["page"]):
                image = np.full((60, 80, 3), 255, np.int16)
                if page % 3:
                    image[8:52, 8:72] = (150, 120, 230)
                    image[10:50, 10:70] = 255
                if page % 3 == 2:
                    image[:4, :4] = (200, 60, 60)
                image[20 : 30 + page % 10, 25:55] = 30
                box, framed = frames.strip_frame(image)
                out.append((doc, *frames.trim_box(image, 2), *box, framed, *frames.expand_to_frame(image, (20, 15, 60, 45)), *frames.extend_to_content(image, (30, 22, 50, 28)), int((frames.erase_corner_arcs(image) != image).any(axis=2).sum())))
            names = ["doc_id", *(f"{k}_{c}" for k in ("trim", "inner") for c in ("x0", "y0", "x1", "y1")), "framed", *(f"{k}_{c}" for k in ("frame", "content") for c in ("x0", "y0", "x1", "y1")), "erased"]
            yield pd.DataFrame(out, columns=names)

    boxes = lambda *kinds: ", ".join(f"{k}_{c} long" for k in kinds for c in ("x0", "y0", "x1", "y1"))
    return rows.mapInPandas(look, f"doc_id long, {boxes('trim', 'inner')}, framed boolean, {boxes('frame', 'content')}, erased long")


def epub_zip(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each reconstructed book as an EPUB file: its size and the number of its chapters."""
    from ..sources import epub
    from . import book_plans

    files = epub.build(book_plans.reconstruct(spark, sf_dir))
    return files.select("book", "n_chapters", F.length("epub").cast("bigint").alias("n_bytes"), (F.substring("epub", 1, 2) == F.lit(b"PK")).alias("is_zip"))


QUERIES = {f.__name__: f for f in (latest_progress, progress_changes, active_jobs, admit_uploads, job_transitions, job_fields, job_states, sessions_stream, blank_ink_chroma, bg_colour, content_bbox, frame_ops, epub_zip)}

_PR = f"WITH pr AS (SELECT event_id, user_id, ts, event_type AS stage, CAST(floor(value * 3) AS BIGINT) - 20 AS progress, {_STATUS} AS status, repeat(event_type || ' ' || event_id || ' ', 20) AS message, props FROM events)"
_NOW = _PR + ", nw AS (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) AS rn FROM pr)"
_PX = """WITH v AS (SELECT vec_id, unnest(range(64)) AS i, CAST(floor(abs(unnest(embedding)::DOUBLE) * 2000) AS BIGINT) % 256 AS v FROM embeddings),
  px AS (SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN 200 + v % 5 WHEN vec_id % 3 = 0 THEN 255 - v % 70 ELSE v END AS r, CASE WHEN vec_id % 7 = 0 THEN 200 + v % 5 WHEN vec_id % 3 = 0 THEN 255 - (v * 7 + i) % 70 ELSE (v * 7 + i) % 256 END AS g,
    CASE WHEN vec_id % 7 = 0 THEN 200 + v % 5 WHEN vec_id % 3 = 0 THEN 255 - (v * 3 + i * 2) % 70 ELSE (v * 3 + i * 2) % 256 END AS b FROM v)"""
SQL = {
    "latest_progress": _NOW + " SELECT user_id, event_id, stage, progress FROM nw WHERE rn = 1",
    "progress_changes": _PR + ", l AS (SELECT *, lag(stage) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS before FROM pr) SELECT user_id, event_id, stage FROM l WHERE before IS NULL OR before <> stage",
    "active_jobs": _NOW + " SELECT user_id FROM nw WHERE rn = 1 AND status IN ('pending', 'processing')",
    "admit_uploads": _NOW + """, u AS (SELECT c_custkey, c_custkey % 400 AS user_id, c_name || CASE c_custkey % 4 WHEN 0 THEN '.txt' WHEN 1 THEN '.PDF' ELSE '.pdf' END AS filename, c_custkey * 300000 AS size FROM customer)
        SELECT c_custkey, user_id, filename FROM u WHERE lower(filename) LIKE '%.pdf' AND size <= 209715200 AND user_id NOT IN (SELECT user_id FROM nw WHERE rn = 1 AND status IN ('pending', 'processing'))""",
    "job_transitions": _PR + """, l AS (SELECT status, lag(status) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS before FROM pr)
        SELECT before, status, count(*) AS n, (before = 'pending' AND status = 'processing') OR (before = 'processing' AND status IN ('processing', 'done', 'failed')) AS allowed FROM l WHERE before IS NOT NULL GROUP BY 1, 2""",
    "job_fields": _PR + """ SELECT event_id, greatest(0, least(100, progress)) AS progress, substring(repeat(stage, 9), 1, 32) AS stage, CASE WHEN event_id % 3 <> 0 THEN substring(message, 1, 256) END AS message, substring(repeat(props, 300), 1, 2000) AS error, substring(repeat(stage, 50), 1, 256) AS title,
        CASE WHEN event_id % 5 < 2 THEN 'unknown' ELSE substring(repeat('10.0.0.1 ', 9), 1, 64) END AS client_ip FROM pr""",
    "job_states": _PR + """ SELECT event_id, CAST(CASE WHEN event_id % 7 = 0 THEN 404 WHEN status <> 'done' THEN 409 WHEN event_id % 5 = 0 THEN 410 ELSE 200 END AS BIGINT) AS download,
        CASE WHEN event_id % 6 = 1 THEN 'done' WHEN event_id % 6 <> 4 AND event_id % 3 + 1 < 3 THEN 'retry' ELSE 'fail' END AS call, 20 + CAST(trunc((event_id % 40 + 1) / 40.0::DOUBLE * 55) AS BIGINT) AS percent FROM pr""",
    "sessions_stream": """WITH e AS (SELECT user_id, ts, value, CASE WHEN ts - lag(ts) OVER w <= INTERVAL 30 MINUTE THEN 0 ELSE 1 END AS new FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts)),
        s AS (SELECT *, sum(new) OVER (PARTITION BY user_id ORDER BY ts ROWS UNBOUNDED PRECEDING) AS k FROM e), g AS (SELECT user_id, min(ts) AS start, max(ts) + INTERVAL 30 MINUTE AS "end", count(*) AS n, round(sum(value), 6) AS value FROM s GROUP BY user_id, k)
        SELECT * FROM g WHERE "end" <= (SELECT date_trunc('millisecond', max(ts)) - INTERVAL 10 MINUTE FROM events)""",
    "blank_ink_chroma": _PX + """, s AS (SELECT vec_id, greatest(stddev_pop(r), stddev_pop(g), stddev_pop(b)) AS d, avg(CASE WHEN least(r, g, b) < 235 THEN 1.0::DOUBLE ELSE 0 END) AS ink, avg(CASE WHEN greatest(r, g, b) - least(r, g, b) >= 25 THEN 1.0::DOUBLE ELSE 0 END) AS chroma FROM px GROUP BY vec_id)
        SELECT vec_id, round(d, 6) AS deviation, d < 8 AS blank, round(ink, 6) AS ink, round(chroma, 6) AS chroma FROM s""",
    "bg_colour": _PX + """, s AS (SELECT vec_id, count(*) AS n, count(*) FILTER (least(r, g, b) > 180) AS k, median(r) FILTER (least(r, g, b) > 180) AS r, median(g) FILTER (least(r, g, b) > 180) AS g, median(b) FILTER (least(r, g, b) > 180) AS b FROM px GROUP BY vec_id),
        t AS (SELECT *, k >= 0.3 * n AND least(r, g, b) BETWEEN 180 AND 244 AS good FROM s) SELECT vec_id, CASE WHEN good THEN CAST(round_even(r, 0) AS BIGINT) END AS r, CASE WHEN good THEN CAST(round_even(g, 0) AS BIGINT) END AS g, CASE WHEN good THEN CAST(round_even(b, 0) AS BIGINT) END AS b FROM t""",
    "content_bbox": "WITH v AS (SELECT vec_id, unnest(range(64)) AS i, abs(unnest(embedding)::DOUBLE) > 0.25 AS on_ FROM embeddings) SELECT vec_id, min(i % 8) AS left_, min(i // 8) AS top_, max(i % 8) AS right_, max(i // 8) AS bottom_ FROM v WHERE on_ GROUP BY vec_id",
}
