"""The model's tables as views of the standard ones, for Spark and as SQL of the same content.

A book is fifty documents that follow each other, a page is a document, a line is a
line of its text: plain projections, so books stay bounded whatever the source.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

PAGES = "pg AS (SELECT doc_id, doc_id // 50 AS book, doc_id % 50 AS page, text FROM documents)"
LINES = PAGES + ", ln AS (SELECT doc_id, book, page, unnest(range(len(a))) AS idx, unnest(a) AS line FROM (SELECT *, string_split(text, chr(10)) AS a FROM pg))"
#: Blocks with injected headings: see ``blocks``.
BLOCKS = LINES + r""", bl AS (SELECT book, page, idx,
  CASE WHEN idx % 3 = 0 THEN 'heading' ELSE 'paragraph' END AS block_type, CASE WHEN idx % 3 = 0 THEN (page + idx) % 3 ELSE 0 END AS level,
  CASE WHEN book % 3 <> 0 AND idx = 0 AND page % 7 = 2 THEN (page // 7 + 1)::VARCHAR || '장'
       WHEN book % 3 = 1 AND page = 5 AND idx % 3 = 0 THEN ' ' || (idx + 1)::VARCHAR || ' 장'
       WHEN idx % 3 = 0 THEN '**' || line || '**' ELSE line END AS text FROM ln)"""


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").selectExpr("doc_id", "doc_id div 50 AS book", "doc_id % 50 AS page", "text")


def lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = pages(spark, sf_dir).select("doc_id", "book", "page", F.posexplode(F.split("text", "\n")).alias("idx", "line"))
    return rows.withColumn("idx", F.col("idx").cast("bigint"))


def blocks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every third line a heading; in two books of three every seventh page opens a chapter, and page 5 of one in three is a contents page."""
    return lines(spark, sf_dir).selectExpr("book", "page", "idx", "CASE WHEN idx % 3 = 0 THEN 'heading' ELSE 'paragraph' END AS block_type", "CASE WHEN idx % 3 = 0 THEN (page + idx) % 3 ELSE 0 END AS level", """
        CASE WHEN book % 3 <> 0 AND idx = 0 AND page % 7 = 2 THEN concat(page div 7 + 1, '장')
             WHEN book % 3 = 1 AND page = 5 AND idx % 3 = 0 THEN concat(' ', idx + 1, ' 장')
             WHEN idx % 3 = 0 THEN concat('**', line, '**') ELSE line END AS text""")
