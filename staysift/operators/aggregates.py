"""Key counts and the two text renderings of small results."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, functions as F

from staysift.functions.text import drop_digit_words, strip
from staysift.operators.ranking import numbered, top_k_per_group


def keys_with_more_than(df: DataFrame, key: str, counted: str, n: int) -> DataFrame:
    """Keys with more than ``n`` non-null values of ``counted``; each key once."""
    counts = df.groupBy(key).agg(F.count(counted).alias("_n"))
    return counts.where(F.col("_n") > n).select(key)


def _pages(df: DataFrame, group: str, order: Sequence[Column], page_rows: int) -> DataFrame:
    """All rows with ``_rank`` in their group and ``page_no`` (from 0) of ``page_rows`` rows each."""
    every = numbered(df, group, order, "_rank")
    return every.withColumn("page_no", F.floor((F.col("_rank") - 1) / page_rows).cast("int"))


def _records(ranked: DataFrame, by: Sequence[str], columns: Sequence[str]) -> DataFrame:
    record = F.struct("_rank", F.struct(*columns).alias("record"))
    rows = F.sort_array(F.collect_list(record))
    return ranked.groupBy(*by).agg(
        F.to_json(F.transform(rows, lambda r: r["record"])).alias("records")
    )


def json_records(
    df: DataFrame, group: str, order: Sequence[Column], columns: Sequence[str], page_rows: int
) -> DataFrame:
    """All rows as JSON arrays of records: ``group, page_no, records``.

    A page holds at most ``page_rows`` rows of a group, in order, so every row comes out and a
    large group is spread over many pages.
    """
    return _records(_pages(df, group, order, page_rows), [group, "page_no"], columns)


def top_json_records(
    df: DataFrame, group: str, order: Sequence[Column], columns: Sequence[str], n: int
) -> DataFrame:
    """Only the first ``n`` rows of each group, as one JSON array: ``group, records``."""
    return _records(top_k_per_group(df, group, order, n, "_rank"), [group], columns)


def clean_join(
    df: DataFrame,
    group: str,
    order: Sequence[Column],
    columns: Sequence[str],
    page_rows: int,
    keep_numbers: bool = False,
    sep: str = ", ",
) -> DataFrame:
    """Values of all rows as texts: ``group, page_no, joined``, at most ``page_rows`` rows a page.

    Empty values are dropped, digit words deleted (unless kept), white space trimmed.
    """
    ranked = _pages(df, group, order, page_rows)
    cells = F.array(*[F.col(c).cast("string") for c in columns])
    rows = F.sort_array(F.collect_list(F.struct("_rank", cells.alias("cells"))))
    values = F.filter(
        F.flatten(F.transform(rows, lambda r: r["cells"])), lambda v: v.isNotNull() & (v != "")
    )
    cleaned = F.transform(values, lambda v: strip(v if keep_numbers else drop_digit_words(v)))
    return ranked.groupBy(group, "page_no").agg(F.array_join(cleaned, sep).alias("joined"))
