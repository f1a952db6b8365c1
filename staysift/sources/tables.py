"""Readers and writers of parquet folders and catalog tables."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, SparkSession

from staysift.session import spread


def read_table(
    spark: SparkSession, folder: str, name: str, *columns: str, spread_by: str | None = None
) -> DataFrame:
    """One table of a folder of parquet files; only the named columns, or all.

    ``spread_by`` puts a table of few splits on all cores; a large table is not shuffled.
    """
    df = spark.read.parquet(f"{folder}/{name}.parquet")
    df = df.select(*columns) if columns else df
    return spread(df, spread_by) if spread_by else df


def stream_table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    """One table of a folder as a streaming frame, whether the table is a file or a folder of part files.

    A name with a pattern may be either; a plain one would have to be a folder.
    """
    schema = spark.read.parquet(f"{folder}/{name}.parquet").schema
    return spark.readStream.schema(schema).parquet(f"{folder}/{name}[.]parquet")


def read_merged(spark: SparkSession, path: str) -> DataFrame:
    """A parquet folder whose files carry different columns, as the union of the columns."""
    return spark.read.option("mergeSchema", "true").parquet(path)


def union_schemas(*frames: DataFrame) -> DataFrame:
    """Rows of all frames under the union of their columns; missing values are null."""
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), frames)


def require_columns(df: DataFrame, expected: dict[str, str]) -> DataFrame:
    """Check names and types (simple type strings) of an input before it is used."""
    found = dict(df.dtypes)
    wrong = {c: t for c, t in expected.items() if found.get(c) != t}
    if wrong:
        raise ValueError(f"expected {wrong}, found { {c: found.get(c) for c in wrong} }")
    return df


def replace_path(df: DataFrame, path: str, *partition_by: str) -> DataFrame:
    """Replace a parquet folder by the rows of ``df``, new columns included, and read it back."""
    df.write.mode("overwrite").partitionBy(*partition_by).parquet(path)
    return df.sparkSession.read.parquet(path)


def replace_table(df: DataFrame, table: str, bucket_by: str | None = None, buckets: int = 64) -> DataFrame:
    """Create or replace a catalog table; bucketed tables join and group by the key in place."""
    writer = df.write.mode("overwrite").format("parquet")
    if bucket_by:
        writer = writer.bucketBy(buckets, bucket_by).sortBy(bucket_by)
    writer.saveAsTable(table)
    return df.sparkSession.table(table)
