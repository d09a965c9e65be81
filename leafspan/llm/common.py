"""What the operators share: staged tables, plan sizes and connected components."""

from __future__ import annotations

import atexit
import contextlib
import os
import shutil
import tempfile
import uuid

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .textscan import U64, blocks, mix, utf8

#: Rows of texts in an Arrow batch.
ROWS = 2000
#: Rows, and bytes of their values, that may be broadcast; larger sides are shuffled.
BROADCAST_ROWS, BROADCAST_BYTES = 500_000, 32 << 20
#: Tasks of one shuffle at most; groups may be more, and are taken one at a time.
TASKS = 50_000


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir.

    Where that is unset, a local session gets a temporary folder and any other an
    error.  Also keeps Arrow batches at ROWS rows for the session: texts are large rows.
    """
    if int(spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")) > ROWS:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(ROWS))
    found = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not found:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that driver and executors share")
        found = "file://" + tempfile.mkdtemp(prefix="leafspan-")
        atexit.register(shutil.rmtree, found.removeprefix("file://"), True)
        spark.conf.set("spark.checkpoint.dir", found)
    return found.rstrip("/")


def delete(spark: SparkSession, folder: str) -> None:
    """Delete a folder and what it holds."""
    path = spark._jvm.org.apache.hadoop.fs.Path(folder)
    path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def folder(spark: SparkSession, name: str) -> str:
    """A new folder in the shared one, deleted when the driver's process ends."""
    path = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"

    def clear():
        with contextlib.suppress(Exception):  # the JVM may be gone
            delete(spark, path)

    atexit.register(clear)
    return path


@contextlib.contextmanager
def swept(spark: SparkSession):
    """Shuffle files of what runs inside are deleted when it ends; else they stay until the driver happens to collect its garbage."""
    key = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
    before = spark.conf.get(key, None)
    spark.conf.set(key, "true")
    try:
        yield
    finally:
        if before is None:
            spark.conf.unset(key)
        else:
            spark.conf.set(key, before)


def stage(df: DataFrame, name: str = "t") -> DataFrame:
    """Write a table to the shared folder and read it: lineage ends there, and lost executors cost nothing."""
    spark = df.sparkSession
    path = f"{folder(spark, 'stage')}/{name}"
    with swept(spark):
        df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def unstage(*tables: DataFrame) -> None:
    """Delete staged tables that nothing reads any more."""
    for table in tables:
        for found in {os.path.dirname(f) for f in table.inputFiles()}:
            if "/stage-" in found:
                delete(table.sparkSession, os.path.dirname(found))


def input_bytes(df: DataFrame) -> int:
    """The optimizer's estimate of a table's size."""
    return int(str(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))


def parts(df: DataFrame, each: int = 8 << 20) -> int:
    """Groups to deal a table to: the session's number of shuffle partitions, or more where a known size asks for more."""
    size, own = input_bytes(df), int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return own if size >= 1 << 60 else max(own, -(-size // each))


def _value_bytes(name: str, kind: str):
    if kind in ("string", "binary"):
        return F.coalesce(F.octet_length(f"`{name}`"), F.lit(0)) + 16
    return F.lit(8) if "<" not in kind else F.coalesce(F.octet_length(F.to_json(F.struct(f"`{name}`"))), F.lit(0))


def small(df: DataFrame, rows: int = BROADCAST_ROWS, size: int = BROADCAST_BYTES) -> DataFrame:
    """A broadcast hint, if a count of rows and bytes shows that the table is small; call it on staged tables."""
    if df.limit(rows + 1).count() > rows:
        return df
    total = df.agg(F.coalesce(F.sum(sum((_value_bytes(n, k) for n, k in df.dtypes), F.lit(0))), F.lit(0))).first()[0]
    return F.broadcast(df) if total <= size else df


def components(edges: DataFrame, a: str = "a", b: str = "b", rounds: int = 60) -> DataFrame:
    """Connected components of undirected edges: (node, component), component the smallest node.

    Alternating large-star and small-star: each round links every node to the
    smallest of its neighbourhood, by aggregates with map-side combine and joins
    that can be split, so a node with very many links needs no task of its own
    size.  Rounds grow with the logarithm of the longest path.  Each round is
    staged.  Nulls are ignored; nodes without links have no row.
    """
    def star(e: DataFrame, large: bool) -> DataFrame:
        both = e.union(e.select(F.col("b").alias("a"), F.col("a").alias("b"))) if large else e
        # in e, a > b always
        # staged, so that both sides of the join are shuffled for it alone and a hot node can be split
        least = stage(both.groupBy("a").agg(F.min("b").alias("m")).withColumn("m", F.least("m", "a")), "least")
        used.append(least)
        linked = both.join(least, "a")
        if large:
            return linked.where("b > a").select(F.col("b").alias("a"), F.col("m").alias("b")).distinct()
        return linked.select(F.col("b").alias("a"), F.col("m").alias("b")).union(least.select("a", F.col("m").alias("b"))).where("a > b").distinct()

    used: list[DataFrame] = []
    now = stage(edges.where(f"{a} <> {b}").select(F.greatest(a, b).alias("a"), F.least(a, b).alias("b")).distinct(), "edges")
    for _ in range(rounds):
        # settled: every node has one parent and no parent has a parent
        with swept(now.sparkSession):
            many = now.groupBy("a").agg(F.count("*").alias("n")).where("n > 1").limit(1)
            deep = now.select("b").distinct().join(now.select("a").distinct(), F.col("a") == F.col("b"), "left_semi").limit(1)
            settled = not many.select(F.lit(1)).union(deep.select(F.lit(1))).take(1)
        if settled:
            break
        large = stage(star(now, True), "edges")
        unstage(now, *used)
        used.clear()
        after = stage(star(large, False), "edges")
        unstage(large, *used)
        used.clear()
        now = after
    else:
        raise RuntimeError("components did not settle")
    return now.select(F.col("a").alias("node"), F.col("b").alias("component")).union(now.select(F.col("b").alias("node"), F.col("b").alias("component")).distinct())


def grouped(batches, keys):
    """Runs of equal keys in sorted Arrow batches: (key, slices), one run in memory at a time."""
    held, last = [], None
    for batch in batches:
        if not batch.num_rows:
            continue
        columns = [batch.column(k).to_numpy(zero_copy_only=False) for k in keys]
        change = np.zeros(batch.num_rows, bool)
        for c in columns:
            change[1:] |= c[1:] != c[:-1]
        cuts = [0, *np.flatnonzero(change).tolist(), batch.num_rows]
        for s, e in zip(cuts, cuts[1:]):
            key = tuple(c[s] for c in columns)
            if held and key != last:
                yield last, held
                held = []
            held.append(batch.slice(s, e - s))
            last = key
    if held:
        yield last, held


def blob_rows(key: np.ndarray, columns: list[np.ndarray], n: int):
    """Packed records for a shuffle by ``key``: (part, bytes) pairs, one for each part 0..n-1 that has records.

    All columns are 64 bits wide; ``unblob`` reads them back.  A record costs its
    own bytes in the shuffle and no row of its own.
    """
    if not len(key):
        return
    part = (mix(key) % U64(n)).astype(np.int64)
    order = np.argsort(part, kind="stable")
    part = part[order]
    table = np.stack([c.view(np.int64)[order] for c in columns], axis=1)
    cuts = np.flatnonzero(np.diff(part)) + 1
    for s, e in zip([0, *cuts], [*cuts, len(part)]):
        yield int(part[s]), table[s:e].tobytes()


def unblob(blobs, width: int) -> np.ndarray:
    """Records of packed rows as an (n, width) array of int64."""
    return np.frombuffer(b"".join(blobs), np.int64).reshape(-1, width)


def sliced(batches, column: str, size: int = 4 << 20):
    """The rows of Arrow batches in batches whose texts hold about ``size`` bytes, or one row with more."""
    for batch in batches:
        _, offsets = utf8(batch.column(column))
        for at, to in blocks(offsets, size):
            yield batch.slice(at, to - at)
