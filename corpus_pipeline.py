"""From raw documents to packed sequences: five stages, each one operator of leafspan.llm.

Each stage is (name, function); a function takes (spark, docs, sf_dir) and returns a
DataFrame that is written as Parquet and read again as the next stage's docs.  All but
the last return the columns of documents.

Defined cases, beside those of the operators: a document that language identification
rejects has no letter, or is far from every learned language (score under MIN_SCORE);
if no label can be learned none is rejected.  A null lang is filled with the
prediction.  Of documents that link, the one with the smallest doc_id stays; of rows
with one doc_id, the one with the smallest text; rows without doc_id stay.  n_chars
follows the text.  Columns beside those of documents pass through.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from leafspan.llm import decontaminate, langid, ngram_join, packing, pii
from leafspan.llm.common import delete, folder, small, stage, swept

#: Score under which a text belongs to none of the learned languages.
MIN_SCORE = 0.2


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in one of the languages their labels teach."""
    profiles = langid.learned(docs)
    if not profiles:
        return docs
    names = docs.columns
    plain = docs.toDF(*(f"c{i}" for i in range(len(names))))
    text, lang = f"c{names.index('text')}", f"c{names.index('lang')}"
    found = langid.predict(plain, profiles, text, tuple(plain.columns)).where((F.col("lang_pred") != "und") & (F.col("score") >= MIN_SCORE))
    return found.withColumn(lang, F.coalesce(lang, "lang_pred")).select(*(F.col(f"c{i}").alias(c) for i, c in enumerate(names)))


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near duplicates: five-word shingles, Jaccard 0.8."""
    found = stage(ngram_join.ngram_jaccard_join(docs, 5, 80), "groups")
    gone = found.where("component_id < doc_id").select("doc_id").distinct()
    repeated = found.where("doc_id is not null").groupBy("doc_id").count().where("count > 1").select("doc_id")
    kept = docs.join(small(stage(gone, "gone")), "doc_id", "left_anti")
    if not repeated.isEmpty():
        again = small(stage(repeated, "repeated"))
        first = kept.join(again, "doc_id", "left_semi").withColumn("_n", F.row_number().over(Window.partitionBy("doc_id").orderBy("text"))).where("_n = 1").drop("_n")
        kept = kept.join(again, "doc_id", "left_anti").unionByName(first)
    return kept.select(*docs.columns)


def benchmark_free(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold no benchmark item."""
    row = F.xxhash64("doc_id", "text")
    leaks = decontaminate.find_leaks(docs.select(row.alias("row"), "text"), spark.read.parquet(f"{sf_dir}/benchmark.parquet"), ("row",))
    held = small(stage(leaks.select("row").distinct(), "leaks"))
    return docs.join(held, row == held.row, "left_anti").select(*docs.columns)


def surrogates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Personal data replaced."""
    changed = pii.replace_pii(docs)
    return changed.withColumn("n_chars", F.length("text").cast("long")).select(*docs.columns)


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of documents in sequences of tokens."""
    import public_tokenizers

    return packing.pack(docs, str(public_tokenizers.path("byte_bpe_50k.json")))


STAGES = [
    ("language_id", language_id),
    ("ngram_join", near_duplicates),
    ("decontaminate", benchmark_free),
    ("pii", surrogates),
    ("packing", packed),
]

ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents, each written to the shared folder; a stage's rows are deleted once the next one's are written, the last when the driver ends."""
    docs, before = spark.read.parquet(f"{sf_dir}/documents.parquet"), None
    for name, function in STAGES:
        written = folder(spark, f"pipeline-{name}")
        with swept(spark):
            function(spark, docs, sf_dir).write.parquet(written)
        docs = spark.read.parquet(written)
        if before:
            delete(spark, before)
        before = written
    return docs
