"""Conversion jobs: progress, admission, retries and states."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

ACTIVE = ("pending", "processing")
UPLOAD_LIMIT = 200 << 20


def clamp_fields(rows: DataFrame) -> DataFrame:
    """Progress and texts as the job table holds them."""
    cut = lambda c, n: F.substring(c, 1, n)
    return rows.withColumns({
        "progress": F.greatest(F.lit(0), F.least(F.lit(100), F.col("progress"))), "stage": cut("stage", 32), "message": F.nullif(cut("message", 256), F.lit("")),
        "error": cut("error", 2000), "title": cut("title", 256), "client_ip": F.coalesce(F.nullif(cut("client_ip", 64), F.lit("")), F.lit("unknown")),
    })


def latest(rows: DataFrame, key: str, *order: str) -> DataFrame:
    """The last row of each key: an aggregate, not a sort."""
    rest = [c for c in rows.columns if c != key]
    return rows.groupBy(key).agg(F.max_by(F.struct(*rest), F.struct(*order)).alias("_last")).select(key, "_last.*")


def changes(rows: DataFrame, key: str, value: str, *order: str) -> DataFrame:
    """Rows whose value differs from the key's row before."""
    before = F.lag(value).over(Window.partitionBy(key).orderBy(*order))
    return rows.withColumn("_before", before).where(f"_before is null or _before <> {value}").drop("_before")


def active(jobs: DataFrame, *client: str) -> DataFrame:
    """Clients with a job that has not ended."""
    return jobs.where(F.col("status").isin(*ACTIVE)).select(*client).distinct()


def admit(uploads: DataFrame, jobs: DataFrame, *client: str) -> DataFrame:
    """Uploads that may start: a PDF, not too large, no active job of the same client."""
    fits = F.lower("filename").endswith(".pdf") & (F.col("size") <= UPLOAD_LIMIT)
    return uploads.where(fits).join(active(jobs, *client), list(client), "left_anti")


def download_state(status: Column, has_file: Column) -> Column:
    """HTTP status of a download."""
    return F.when(status.isNull(), 404).when(status != "done", 409).when(~has_file, 410).otherwise(200)


def call_outcome(status: Column, good_body: Column, attempt: Column, attempts: int = 3) -> Column:
    """What follows a call: done, retry, or fail; network errors have no status."""
    again = status.isNull() | (status == 429) | (status >= 500) | ((status == 200) & ~good_body)
    return F.when((status == 200) & good_body, "done").when(again & (attempt < attempts), "retry").otherwise("fail")


#: States that may follow each other; fixed values.
TRANSITIONS = {("pending", "processing"), ("processing", "processing"), ("processing", "done"), ("processing", "failed")}


def stamp(rows: DataFrame, known: DataFrame, key: str = "id") -> DataFrame:
    """States with the job's stamps: created_at where it is new, started_at with its first processing, finished_at with its end."""
    now = F.current_timestamp()
    old = known.select(key, *(F.col(c).alias(f"_{c}") for c in ("created_at", "started_at", "finished_at")))
    rows = rows.join(old, key, "left")
    return rows.select(*(c for c in rows.columns if c not in ("_created_at", "_started_at", "_finished_at", "created_at", "started_at", "finished_at")), F.coalesce("_created_at", now).alias("created_at"),
                       F.coalesce("_started_at", F.when(F.col("status") == "processing", now)).alias("started_at"), F.coalesce("_finished_at", F.when(F.col("status").isin("done", "failed"), now)).alias("finished_at"))


#: What a look at one job shows.
SHOWN = ("id", "status", "progress", "progress_stage", "progress_message", "title", "page_count", "error")


def lookup(jobs: DataFrame, wanted: DataFrame, key: str = "id") -> DataFrame:
    """The wanted jobs with what is shown of them; unknown ones have nulls."""
    return wanted.select(key).join(jobs.select(*SHOWN), key, "left")


def transitions(rows: DataFrame, key: str, *order: str) -> DataFrame:
    """How often each state followed each other one, and whether a job may do that."""
    before = F.lag("status").over(Window.partitionBy(key).orderBy(*order))
    pairs = rows.withColumn("before", before).where("before is not null").groupBy("before", "status").agg(F.count("*").alias("n"))
    allowed = F.lit(False)
    for a, b in sorted(TRANSITIONS):
        allowed = allowed | ((F.col("before") == a) & (F.col("status") == b))
    return pairs.withColumn("allowed", allowed)
