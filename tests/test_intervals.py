"""Metrics and bootstrap intervals against plain loops."""

from __future__ import annotations

import hashlib
import math

import numpy as np
import pytest

from staysift.operators.intervals import (
    DRAWS,
    bootstrap_intervals,
    ndcg,
    paired_differences,
    poisson_steps,
    poisson_weight,
)


def plain_weight(qid, replicate, seed):
    draw = int(hashlib.md5(f"{seed}:{replicate}:{qid}".encode()).hexdigest()[:8], 16)
    return sum(draw >= s for s in poisson_steps())


def plain_interval(values, replicates, seed, level):
    means = []
    for r in range(1, replicates + 1):
        w = [plain_weight(q, r, seed) for q in values]
        if sum(w):
            means.append(sum(a * v for a, v in zip(w, values.values())) / sum(w))
    return np.quantile(means, [(1 - level) / 2, (1 + level) / 2])


def test_steps_are_those_of_a_poisson_variable():
    steps = [0, *poisson_steps(), DRAWS]
    for n in range(8):
        share = (steps[n + 1] - steps[n]) / DRAWS
        assert share == pytest.approx(math.exp(-1) / math.factorial(n), abs=1e-8)


def test_weights_equal_those_of_a_loop(spark):
    rows = spark.range(50).selectExpr("cast(id as string) AS q", "cast(id % 7 as int) AS r")
    got = rows.withColumn("w", poisson_weight("q", "r", 3)).collect()
    assert all(x.w == plain_weight(x.q, x.r, 3) for x in got)
    assert len({x.w for x in got}) > 2


def test_intervals_equal_those_of_a_loop(spark):
    values = {i: (i * 37 % 11) / 10 for i in range(40)}
    frame = spark.createDataFrame([*values.items()], "q int, recall double").repartition(3)
    row = bootstrap_intervals(frame, "q", ["recall"], replicates=60, level=0.9, seed=5).first()
    low, high = plain_interval(values, 60, 5, 0.9)
    assert row.n_queries == 40
    assert row.estimate == pytest.approx(np.mean([*values.values()]))
    assert (row.lower, row.upper) == (pytest.approx(low), pytest.approx(high))
    assert row.lower < row.estimate < row.upper


def test_null_metrics_single_queries_and_empty_tables(spark):
    schema = "q string, recall double, none double, extra int"
    frame = spark.createDataFrame([("a", 0.5, None, 1), (None, 1.0, None, 2), ("c", None, None, 3)], schema)
    got = {r.metric: r for r in bootstrap_intervals(frame, "q", ["recall", "none"], replicates=20).collect()}
    assert (got["recall"].n_queries, got["recall"].estimate) == (2, 0.75)
    assert tuple(got["none"])[1:] == (0, None, None, None)
    empty = bootstrap_intervals(frame.limit(0), "q", ["recall"], replicates=20).collect()
    assert [tuple(r) for r in empty] == [("recall", 0, None, None, None)]


def test_ndcg(spark):
    truth = spark.createDataFrame([(1, 10), (1, 11), (1, 11), (2, 20), (3, 30)], "q int, doc int")
    hits = spark.createDataFrame(
        [(1, 11, 1), (1, 99, 2), (1, 10, 3), (2, 21, 1), (3, 30, 9), (4, 1, 1)], "q int, doc int, rank int"
    )
    got = {r.q: r.ndcg for r in ndcg(hits, truth, "q", "doc", 5).collect()}
    assert got == {1: pytest.approx((1 + 0.5) / (1 + 1 / math.log2(3))), 2: 0.0, 3: 0.0}


def test_paired_differences_are_surer_than_the_two_means(spark):
    rows = [(i, (i % 10) / 10, (i % 10) / 10 - 0.05) for i in range(60)]
    both = spark.createDataFrame(rows, "q int, a double, b double")
    first, second = both.selectExpr("q", "a AS recall"), both.selectExpr("q", "b AS recall")
    row = bootstrap_intervals(paired_differences(first, second, "q", ["recall"]), "q", ["recall"], 50).first()
    assert (row.lower, row.upper) == (pytest.approx(0.05), pytest.approx(0.05))
    alone = bootstrap_intervals(first, "q", ["recall"], 50).first()
    assert alone.upper - alone.lower > 0.1
