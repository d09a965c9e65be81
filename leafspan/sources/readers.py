"""Readers and writers of the model's tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..operators.blocks import PAGE_SCHEMA


def recorded_pages(spark: SparkSession, path: str) -> DataFrame:
    """Recorded responses (one JSON object a file or line), one row a page; malformed ones give no rows."""
    rows = spark.read.schema(f"model STRING, pages ARRAY<STRUCT<{PAGE_SCHEMA.replace(' INT,', ':INT,').replace(' STRING,', ':STRING,').replace('dimensions STRUCT', 'dimensions:STRUCT').replace('blocks ARRAY', 'blocks:ARRAY')}>>").option("multiLine", True).option("mode", "DROPMALFORMED").json(path)
    return rows.select("model", F.explode("pages").alias("page"))


def images(spark: SparkSession, path: str, pattern: str = "*.png") -> DataFrame:
    """Image files (path, content, length) with their number in the order of their names; only names are sorted."""
    files = spark.read.format("binaryFile").option("pathGlobFilter", pattern).load(path)
    folder, name = F.regexp_extract("path", "^(.*)/[^/]*$", 1), F.regexp_extract("path", "([^/]*)$", 1)
    numbers = files.select("path", folder.alias("_folder"), name.alias("_name")).withColumn("number", F.row_number().over(Window.partitionBy("_folder").orderBy("_name")) - 1)
    return files.select("path", "content", "length").join(numbers.select("path", "number"), "path")


def write_page_dumps(lines: DataFrame, path: str) -> None:
    """Recognised lines as one JSON object a page: page, lines (text, bbox, confidence)."""
    line = F.struct("line_idx", "text", "bbox", F.coalesce("confidence", F.lit(0.0)).alias("confidence"))
    lines.groupBy("doc_id", "page").agg(F.array_sort(F.collect_list(line)).alias("lines")).write.mode("overwrite").json(path)


def jobs(spark: SparkSession, path: str) -> DataFrame:
    """The job table; columns that an older file lacks are null."""
    schema = "id STRING, status STRING, progress INT, progress_stage STRING, progress_message STRING, upload_path STRING, output_path STRING, title STRING, page_count INT, error STRING, created_at TIMESTAMP, started_at TIMESTAMP, finished_at TIMESTAMP, client_ip STRING, client_session STRING"
    return spark.read.schema(schema).parquet(path)
