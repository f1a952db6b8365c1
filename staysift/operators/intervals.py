"""How sure a retrieval metric is: nDCG, paired differences, bootstrap intervals over the queries."""

from __future__ import annotations

import math
from functools import reduce

from pyspark.sql import Column, DataFrame, functions as F

# Hash values that draw the weights are below this.
DRAWS = 1 << 32


def poisson_steps() -> list[int]:
    """Least draws that give a weight of 1, 2, ... of a Poisson variable of mean 1."""
    steps, below, term = [], 0.0, math.exp(-1)
    while math.floor(DRAWS * (below + term)) < DRAWS - 1:
        below += term
        term /= len(steps) + 1
        steps.append(math.floor(DRAWS * below))
    return steps


def poisson_weight(qid: Column | str, replicate: Column | str, seed: int = 0) -> Column:
    """The weight of a query in a replicate: drawn by MD5, so every run and every engine gives the same.

    The draw is the number in the first eight hex digits of the digest of ``seed:replicate:qid``.
    """
    named = F.concat_ws(":", F.lit(str(seed)), F.col(replicate) if isinstance(replicate, str) else replicate,
                        F.col(qid) if isinstance(qid, str) else qid)
    draw = F.conv(F.substring(F.md5(named), 1, 8), 16, 10).cast("long")
    return reduce(lambda a, b: a + b, [(draw >= s).cast("int") for s in poisson_steps()])


def ndcg(hits: DataFrame, truth: DataFrame, qid: str, key: str, k: int) -> DataFrame:
    """Per query of ``truth``: normalized discounted cumulative gain of its first ``k`` hits.

    Every expected pair has gain 1; repeated pairs count once. Queries without a hit have 0,
    queries that expect nothing are not in the result.
    """
    expected = truth.select(qid, key).distinct()
    ranked = hits.where(F.col("rank") <= k).groupBy(qid, key).agg(F.min("rank").alias("rank"))
    best = F.aggregate(
        F.sequence(F.lit(1), F.least(F.lit(k), F.count("*").cast("int"))),
        F.lit(0.0),
        lambda total, i: total + 1 / F.log2(i + 1.0),
    )
    gained = F.coalesce(F.sum(1 / F.log2(F.col("rank") + 1.0)), F.lit(0.0))
    return expected.join(ranked, [qid, key], "left").groupBy(qid).agg((gained / best).alias("ndcg"))


def paired_differences(first: DataFrame, second: DataFrame, qid: str, metrics: list[str]) -> DataFrame:
    """Per query in both tables (one row a query each): metrics of the first less those of the second."""
    other = second.select(qid, *[F.col(m).alias(f"_other_{m}") for m in metrics])
    difference = [(F.col(m) - F.col(f"_other_{m}")).alias(m) for m in metrics]
    return first.select(qid, *metrics).join(other, qid).select(qid, *difference)


def bootstrap_intervals(
    per_query: DataFrame, qid: str, metrics: list[str],
    replicates: int = 200, level: float = 0.95, seed: int = 0,
) -> DataFrame:
    """Per metric: ``n_queries``, ``estimate`` (the mean), ``lower`` and ``upper`` of its interval.

    Each replicate weighs every query by a Poisson variable of mean 1, which is the bootstrap
    without a draw over the whole table: weights come from the row itself, tasks sum their rows,
    and one row per replicate and task is shuffled. The interval lies between two percentiles of
    the replicates' means. ``per_query`` has one row a query; a null metric leaves its query out
    of that metric, and a metric without any value has nulls and 0 queries. An empty table gives
    the metrics with nulls.
    """
    numbered = per_query.select(
        F.coalesce(F.col(qid).cast("string"), F.lit("")).alias("_query"),
        *[F.col(m).cast("double").alias(f"_m{i}") for i, m in enumerate(metrics)],
        F.explode(F.sequence(F.lit(0), F.lit(replicates))).alias("_replicate"),
    )
    # Replicate 0 is the table itself.
    weight = F.when(F.col("_replicate") == 0, 1).otherwise(poisson_weight("_query", "_replicate", seed))
    sums = []
    for i in range(len(metrics)):
        there = F.when(F.col(f"_m{i}").isNotNull(), F.col("_weight"))
        sums += [F.sum(there).alias(f"_w{i}"), F.sum(there * F.col(f"_m{i}")).alias(f"_s{i}")]
    totals = numbered.withColumn("_weight", weight).groupBy("_replicate").agg(*sums)
    drawn = F.when(F.col("_replicate") > 0, F.col("mean"))
    plain = F.col("_replicate") == 0
    means = totals.select(
        "_replicate",
        F.inline(
            F.array(*[
                F.struct(
                    F.lit(m).alias("metric"),
                    F.col(f"_w{i}").alias("weight"),
                    F.try_divide(F.col(f"_s{i}"), F.col(f"_w{i}")).alias("mean"),
                )
                for i, m in enumerate(metrics)
            ])
        ),
    )
    tail = (1 - level) / 2
    found = means.groupBy("metric").agg(
        F.coalesce(F.max(F.when(plain, F.col("weight"))), F.lit(0)).cast("long").alias("n_queries"),
        F.max(F.when(plain, F.col("mean"))).alias("estimate"),
        F.percentile(drawn, F.lit(tail)).alias("lower"),
        F.percentile(drawn, F.lit(1 - tail)).alias("upper"),
    )
    names = per_query.sparkSession.createDataFrame([(m,) for m in metrics], "metric string")
    every = names.join(found, "metric", "left")
    return every.select(
        "metric", F.coalesce("n_queries", F.lit(0).cast("long")).alias("n_queries"), "estimate", "lower", "upper"
    )
