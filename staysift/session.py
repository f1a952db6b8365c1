"""Session-level helpers: the shared folder, lineage cuts, size-checked broadcasts, spreading."""

from __future__ import annotations

import functools
import tempfile
import uuid

from pyspark.sql import Column, DataFrame, Observation, SparkSession, functions as F

# A frame is broadcast only when a count has shown it to hold no more rows than this.
BROADCAST_ROWS = 500_000
# The same for frames of texts, by the bytes of the texts.
BROADCAST_BYTES = 64 << 20
# How frames with whole texts are written: Zstandard takes about two thirds of the room that Snappy does.
TEXTS = {"compression": "zstd"}


@functools.cache
def _local_dir() -> str:
    return tempfile.mkdtemp(prefix="staysift-")


def shared_dir(spark: SparkSession) -> str:
    """Folder that every executor can reach, as named by ``spark.checkpoint.dir``.

    When the setting is absent a temporary folder is used in local mode only; on a cluster the
    folder has to be named, since a machine-local path would be lost with its executor.
    """
    root = spark.conf.get("spark.checkpoint.dir", None)
    if root:
        return root.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder shared by all executors")
    return _local_dir()


def _scratch_root(spark: SparkSession) -> str:
    return f"{shared_dir(spark)}/staysift-{spark.sparkContext.applicationId}"


def scratch_path(spark: SparkSession, label: str) -> str:
    """A fresh path in this application's part of the shared folder."""
    return f"{_scratch_root(spark)}/{label}-{uuid.uuid4().hex}"


def remove_scratch(spark: SparkSession) -> None:
    """Delete this application's scratch tables; results that still read them are lost."""
    delete_folder(spark, _scratch_root(spark))


def delete_folder(spark: SparkSession, folder: str) -> None:
    path = spark._jvm.org.apache.hadoop.fs.Path(folder)
    path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def cut_lineage(df: DataFrame, **options: str) -> DataFrame:
    """Write ``df`` to the shared folder and read it back, so that it is computed once.

    The copy is parquet, so later readers still prune columns and push filters, and a lost
    executor costs a re-read, not a re-computation. ``options`` are those of the writer.
    """
    path = scratch_path(df.sparkSession, "cut")
    df.write.options(**options).parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def cut_and_measure(df: DataFrame, **metrics: Column) -> tuple[DataFrame, dict]:
    """``cut_lineage`` that also gives aggregates of the rows, taken while they are written.

    The number of rows is always there, as ``rows``.
    """
    seen = Observation()
    named = [F.count(F.lit(1)).alias("rows"), *[m.alias(n) for n, m in metrics.items()]]
    copy = cut_lineage(df.observe(seen, *named))
    return copy, seen.get


def broadcast_if_small(
    df: DataFrame, max_rows: int = BROADCAST_ROWS, rows: int | None = None
) -> DataFrame:
    """Hint a broadcast if the number of rows is known to be small; else leave the join to Spark.

    The number is ``rows`` where the caller has measured it, else at most ``max_rows + 1`` rows
    are counted. Meant for frames of short keys and numbers, where a row bound is a byte bound.
    """
    if rows is None:
        rows = df.limit(max_rows + 1).count()
    return F.broadcast(df) if rows <= max_rows else df


def spread(df: DataFrame, *keys: str) -> DataFrame:
    """Use every core when a scan has fewer splits than the cluster has cores.

    A large table has many splits and is returned as it is, without a shuffle. The keys make the
    placement repeatable when a task is run again. Meant for plain scans: counting the partitions
    of a plan with shuffles would run them.
    """
    cores = df.sparkSession.sparkContext.defaultParallelism
    if df.rdd.getNumPartitions() >= cores:
        return df
    return df.repartition(cores, *keys)
