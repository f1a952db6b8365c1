"""Column profiles as sketches by part, which merge without reading the rows again."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F, types as T

# Buckets of the distinct sketch (2 to this power): a standard error of about 0.8 %.
DISTINCT_BITS = 14
# Numbers kept per level of the quantile sketch: a rank error of about 0.7 %.
QUANTILE_K = 400
# Values followed by the sketch of frequent values, and of them those that are given out.
FOLLOWED, SHOWN = 10_000, 5
# Characters of a value in the sketch of frequent values; longer values are named by their digest.
VALUE_CHARACTERS = 100


def value_name(value) -> F.Column:
    """A value as the sketches know it: its text, or a digest where the text is long."""
    text = value.cast("string")
    return F.when(F.length(text) <= VALUE_CHARACTERS, text).otherwise(F.concat(F.lit("md5:"), F.md5(text)))


def profile_sketches(df: DataFrame) -> DataFrame:
    """One row per column: rows, nulls and three sketches (distinct, quantiles, frequent values).

    One pass; a task gives one row of sketches, whose size does not grow with the table. Quantiles
    are those of numeric columns, NaN left out. A column of nulls has empty sketches.
    """
    rows = []
    for field in df.schema.fields:
        value = F.col(f"`{field.name}`")
        number = value.cast("double") if isinstance(field.dataType, T.NumericType) else F.lit(None).cast("double")
        atomic = isinstance(field.dataType, T.AtomicType)
        named = value_name(value if atomic else F.when(value.isNotNull(), F.to_json(F.struct(value))))
        # The distinct sketch skips empty texts, hence the sign before each value.
        rows.append(
            F.struct(
                F.lit(field.name).alias("column_name"),
                F.lit(field.dataType.simpleString()).alias("column_type"),
                F.count(F.lit(1)).alias("n_rows"),
                F.count_if(value.isNull()).alias("n_nulls"),
                F.hll_sketch_agg(F.concat(F.lit("="), named), F.lit(DISTINCT_BITS)).alias("distinct_sketch"),
                F.kll_sketch_agg_double(F.nullif(number, F.lit(float("nan"))), F.lit(QUANTILE_K)).alias("quantile_sketch"),
                F.call_function("approx_top_k_accumulate", named, F.lit(FOLLOWED)).alias("frequent_sketch"),
            )
        )
    return df.agg(F.array(*rows).alias("stats")).select(F.inline("stats"))


def write_profile_part(df: DataFrame, path: str, part: int) -> None:
    """Store the sketches of one part of a table, for instance of the rows that were added.

    Only ``df`` is read. Writing a part again replaces it, so a repeated job counts nothing twice.
    """
    profile_sketches(df).write.mode("overwrite").parquet(f"{path}/part={part:06d}")


def merged_profile(spark: SparkSession, path: str, probabilities: tuple[float, ...] = (0.25, 0.5, 0.75)) -> DataFrame:
    """Profile of all parts together, from their sketches alone.

    ``n_distinct`` is an estimate, ``quantiles`` are values at about the ``probabilities`` (null
    for columns without numbers), ``frequent`` holds the most frequent values with their counts.
    A column that a part does not have adds nothing there; a changed type is given as the last.
    """
    parts = spark.read.parquet(path)
    merged = parts.groupBy("column_name").agg(
        F.max_by("column_type", "part").alias("column_type"),
        F.sum("n_rows").alias("n_rows"),
        F.sum("n_nulls").alias("n_nulls"),
        F.hll_sketch_estimate(F.hll_union_agg("distinct_sketch")).alias("n_distinct"),
        F.kll_merge_agg_double("quantile_sketch").alias("_quantiles"),
        F.call_function("approx_top_k_combine", F.col("frequent_sketch"), F.lit(FOLLOWED)).alias("_frequent"),
    )
    numbers = F.kll_sketch_get_n_double("_quantiles") > 0
    at = F.array(*[F.lit(p) for p in probabilities])
    # The sketch follows nulls like a value; they have a count of their own.
    most = F.call_function("approx_top_k_estimate", F.col("_frequent"), F.lit(SHOWN + 1))
    return merged.select(
        "column_name", "column_type", "n_rows", "n_nulls", "n_distinct",
        F.when(numbers, F.kll_sketch_get_quantile_double("_quantiles", at)).alias("quantiles"),
        F.slice(F.filter(most, lambda x: x["item"].isNotNull()), 1, SHOWN).alias("frequent"),
    )
