"""Triggered index sync: new source rows become chunks and postings, once, on demand."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from staysift.operators.joins import join_on_unique
from staysift.operators.keyword import COMPACT, KeywordIndex, in_runs, make_postings, open_index, write_term_counts
from staysift.operators.ranking import latest_per_key
from staysift.session import TEXTS, broadcast_if_small, cut_lineage

BATCH, VERSION = "batch", "_version"


def _live(spark: SparkSession, path: str, table: str, key: str) -> DataFrame:
    """Rows of the newest version of every key that is not deleted.

    The versions table holds a key, its version, a batch number and a flag per change, so finding
    the newest is narrow; a key has few versions and is trimmed to one inside every task. Of equal
    versions the one that came last counts. Rows are not shuffled unless very many were replaced.
    """
    versions = spark.read.parquet(f"{path}/versions")
    order = [F.desc_nulls_last(VERSION), F.desc(BATCH)]
    latest = latest_per_key(versions, key, order).select(key, "deleted", F.col(BATCH).alias("_newest"))
    rows = spark.read.parquet(f"{path}/{table}")
    replaced = (F.col(BATCH) != F.col("_newest")) | F.col("_deleted")
    gone = versions.join(latest.withColumnRenamed("deleted", "_deleted"), key).where(replaced).select(key, BATCH)
    few = broadcast_if_small(gone)
    if few is not gone:
        return rows.join(few, [key, BATCH], "left_anti").select(key, *[c for c in rows.columns if c != key])
    newest = latest.where(~F.col("deleted")).select(key, "_newest")
    found = join_on_unique(rows, newest, key, spread_by="chunk_id")
    return found.where(F.col(BATCH) == F.col("_newest")).drop("_newest")


def live_chunks(spark: SparkSession, path: str, key: str) -> DataFrame:
    return _live(spark, path, "chunks", key).drop(BATCH)


def sync_index(
    rows: DataFrame,
    path: str,
    key: str,
    text: str,
    chunker: Callable[[DataFrame, str, str], DataFrame],
    version: Column,
    deleted: Column | None = None,
) -> None:
    """Take all rows of a streaming frame that were not taken before, then stop.

    Each micro-batch is written to a folder named by its number, which a replay overwrites, so a
    lost executor or a restart changes nothing. A key seen again replaces its older chunks; rows
    where ``deleted`` is true only remove them. The greatest ``version`` of a key (a column, or a
    struct of several) is the newest, in whatever batch it arrives. Progress is kept below ``path``, which has to be a shared folder.
    """
    flag = F.lit(False) if deleted is None else F.coalesce(deleted, F.lit(False))

    def take(batch: DataFrame, number: int) -> None:
        def write(df: DataFrame, table: str) -> None:
            df.write.mode("overwrite").options(**TEXTS).parquet(f"{path}/{table}/{BATCH}={number}")

        marked = batch.withColumns({"deleted": flag, VERSION: version})
        order = [F.desc_nulls_last(VERSION), F.desc(text)]
        rows = cut_lineage(latest_per_key(marked, key, order), **TEXTS)
        write(rows.select(key, "deleted", VERSION), "versions")
        write(chunker(rows.where(~F.col("deleted")).drop("deleted", VERSION), key, text), "chunks")
        written = batch.sparkSession.read.parquet(f"{path}/chunks/{BATCH}={number}")
        write(make_postings(written, "chunk_id", "text", key), "postings")

    query = (
        rows.writeStream.foreachBatch(take)
        .option("checkpointLocation", f"{path}/progress")
        .trigger(availableNow=True)
        .start()
    )
    query.awaitTermination()


def compact_index(spark: SparkSession, path: str, target: str, key: str) -> KeywordIndex:
    """Merge the batches into one keyword index over the live chunks, for searching."""
    postings = _live(spark, path, "postings", key).drop(BATCH, key)
    in_runs(postings, "term").write.mode("overwrite").options(**COMPACT).parquet(f"{target}/postings")
    write_term_counts(spark, target)
    live = live_chunks(spark, path, key).agg(F.count("*").alias("n_docs"))
    live.write.mode("overwrite").parquet(f"{target}/stats")
    return open_index(spark, target, "chunk_id")
