"""Column profile of a table."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F


def table_profile(df: DataFrame, exact: bool = False) -> DataFrame:
    """One row per column: name, type, rows, nulls, distinct values.

    Distinct values are estimated in one pass without a shuffle of the data. With ``exact`` they
    are counted: values are first made unique per column inside the tasks, and the shuffle is by
    (column, value), so a frequent value costs one row per task.
    """
    types = dict(df.dtypes)
    names = df.columns
    if not exact:
        stats = [
            F.struct(
                F.lit(c).alias("column_name"),
                F.lit(types[c]).alias("column_type"),
                F.count(F.lit(1)).alias("n_rows"),
                F.count_if(F.col(c).isNull()).alias("n_nulls"),
                F.approx_count_distinct(F.col(c)).alias("n_distinct"),
            )
            for c in names
        ]
        return df.agg(F.array(*stats).alias("stats")).select(F.inline("stats"))
    cells = F.array(
        *[F.struct(F.lit(c).alias("column_name"), F.col(c).cast("string").alias("v")) for c in names]
    )
    values = df.select(F.inline(cells)).groupBy("column_name", "v").agg(F.count("*").alias("n"))
    counted = values.groupBy("column_name").agg(
        F.sum("n").alias("n_rows"),
        F.coalesce(F.sum(F.when(F.col("v").isNull(), F.col("n"))), F.lit(0)).alias("n_nulls"),
        F.count("v").alias("n_distinct"),
    )
    type_of = F.create_map(*[F.lit(x) for c in names for x in (c, types[c])])
    return counted.select(
        "column_name", type_of[F.col("column_name")].alias("column_type"), "n_rows", "n_nulls", "n_distinct"
    )
