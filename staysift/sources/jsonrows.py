"""JSON records of whole tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F


def json_rows(df: DataFrame) -> DataFrame:
    """One JSON record per row, as a single text column."""
    return df.select(F.to_json(F.struct(*df.columns)).alias("value"))


def write_json_rows(df: DataFrame, path: str, *partition_by: str) -> None:
    """Write a table of any size as JSON lines, one folder per group when asked."""
    df.write.mode("overwrite").partitionBy(*partition_by).json(path)
