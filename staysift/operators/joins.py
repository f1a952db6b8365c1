"""Joins that hold up when one key has a large share of the rows."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import DataFrame, functions as F

from staysift.session import broadcast_if_small, cut_and_measure

# A key with this many rows or more is split, into about this many rows a task. Rows without a key
# are spread over SALTS tasks.
HOT_ROWS = 1_000_000
SALTS = 64


def hot_keys(df: DataFrame, key: str, hot_rows: int = HOT_ROWS) -> DataFrame:
    """Every key with at least ``hot_rows`` rows, and ``_salts``, the tasks its rows are spread over."""
    counted = df.where(F.col(key).isNotNull()).groupBy(key).agg(F.count("*").alias("_n"))
    return counted.where(F.col("_n") >= hot_rows).select(
        key, (F.ceil(F.col("_n") / hot_rows) + 1).cast("int").alias("_salts")
    )


def join_on_unique(
    rows: DataFrame,
    lookup: DataFrame,
    key: str,
    spread_by: str | None = None,
    how: str = "inner",
    hot_rows: int = HOT_ROWS,
) -> DataFrame:
    """Join ``rows`` with a ``lookup`` that has one row per key, spreading the hot keys.

    Rows of a hot key are split over tasks, the more the more rows it has, by a hash of
    ``spread_by`` (all other columns if not given), and the one lookup row is repeated for each; all
    other keys take the usual shuffle. Rows with a null key, which match nothing, are spread too.
    Only the key column is read to find the hot keys. ``how`` is inner, left or left_semi.
    """
    columns = [spread_by] if spread_by else [c for c in rows.columns if c != key]
    hot, seen = cut_and_measure(hot_keys(rows, key, hot_rows))
    hot = broadcast_if_small(hot, rows=seen["rows"])
    parts = F.when(F.col(key).isNull(), SALTS).otherwise(F.coalesce("_salts", F.lit(1)))
    salt = F.pmod(F.xxhash64(*columns), parts) if columns else F.lit(0)
    every_salt = F.sequence(F.lit(0), F.coalesce("_salts", F.lit(1)) - 1)
    left = rows.join(hot, key, "left").withColumn("_salt", salt.cast("int")).drop("_salts")
    right = lookup.join(hot, key, "left").withColumn("_salt", F.explode(every_salt)).drop("_salts")
    return left.join(right, [key, "_salt"], how).drop("_salt")


def keep_ids(df: DataFrame, key: str, ids: Iterable | DataFrame, **spreading) -> DataFrame:
    """Rows whose key is in a list or in the key column of a frame, whatever its size."""
    if not isinstance(ids, DataFrame):
        return df.where(F.col(key).isin(list(ids)))
    wanted = ids.select(key).distinct()
    small = broadcast_if_small(wanted)
    if small is not wanted:
        return df.join(small, key, "left_semi")
    return join_on_unique(df, wanted, key, how="left_semi", **spreading)
