"""Extension: job progress as a stream.

The model has progress rows, not a stream; these are the forms that a stream of them
takes.  Event times need time zones for watermarks, so local times count as UTC.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..sources.shared import folder

GAP, LATE = "30 minutes", "10 minutes"


def sessions(events: DataFrame, gap: str = GAP, late: str = LATE) -> DataFrame:
    """Sessions of each client: events no further apart than ``gap``."""
    rows = events.select("user_id", F.col("ts").cast("timestamp").alias("ts"), "value").withWatermark("ts", late)
    found = rows.groupBy("user_id", F.session_window("ts", gap).alias("w")).agg(F.count("*").alias("n"), F.sum("value").alias("value"))
    return found.select("user_id", F.col("w.start").alias("start"), F.col("w.end").alias("end"), "n", "value")


def latest_states(events: DataFrame) -> DataFrame:
    """The last state of each client, as a running aggregate (output mode update or complete)."""
    return events.groupBy("user_id").agg(F.max_by(F.struct("event_type", "value"), F.struct("ts", "event_id")).alias("last")).select("user_id", "last.*")


def run_sessions(spark: SparkSession, path: str) -> DataFrame:
    """Sessions of a whole table read as a stream, written to the shared folder and read back."""
    schema = spark.read.parquet(path).schema
    home = f"{folder(spark)}/sessions-{uuid.uuid4().hex}"
    # a pattern, as a stream takes a single file only by one
    stream = spark.readStream.schema(schema).parquet(path.replace("events.parquet", "event[s].parquet"))
    query = sessions(stream).writeStream.outputMode("append").format("parquet").option("path", f"{home}/out").option("checkpointLocation", f"{home}/state").trigger(availableNow=True).start()
    query.awaitTermination()
    found = spark.read.schema("user_id long, start timestamp, end timestamp, n long, value double").parquet(f"{home}/out")
    local = lambda c: F.col(c).cast("timestamp_ntz").alias(c)  # noqa: E731  back to the table's local times
    return found.select("user_id", local("start"), local("end"), "n", F.round("value", 6).alias("value"))
