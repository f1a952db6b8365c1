"""Search over stored cells of vectors against numpy, with the cells that it reads."""

from __future__ import annotations

import numpy as np
import pytest
from pyspark.sql import functions as F

from staysift.operators import placed
from staysift.operators.placed import open_placed, place_vectors, placed_topk, visited_share


def frame(spark, rows, name):
    return spark.createDataFrame([(i, None if v is None else [float(x) for x in v]) for i, v in enumerate(rows)], f"{name} long, embedding array<double>")


def brute(vectors, queries, k):
    def unit(rows):
        norms = np.linalg.norm(rows, axis=1, keepdims=True)
        return np.divide(rows, norms, out=np.zeros_like(rows), where=norms > 0)

    scores = np.round(unit(queries) @ unit(vectors).T, 6)
    return {(q, int(v)): (float(s[v]), r + 1) for q, s in enumerate(scores) for r, v in enumerate(np.lexsort((np.arange(len(s)), -s))[:k])}


@pytest.fixture(scope="module")
def data():
    rng = np.random.default_rng(5)
    centres = rng.normal(size=(12, 16))
    vectors = centres[rng.integers(0, 12, 1500)] + 0.15 * rng.normal(size=(1500, 16))
    vectors[:300] = vectors[0]  # copies
    vectors[700] = 0
    queries = np.vstack([vectors[rng.integers(0, 1500, 20)] + 0.05 * rng.normal(size=(20, 16)), -vectors[900:901], np.zeros((1, 16))])
    return vectors, queries


@pytest.mark.parametrize("k", [1, 5, 400, 2000])
def test_equals_brute_force(spark, tmp_path, data, k, monkeypatch):
    monkeypatch.setattr(placed, "BLOCK_ROWS", 100)
    vectors, queries = data
    index = place_vectors(frame(spark, vectors, "v"), f"{tmp_path}/p", "v", cell_rows=50)
    got = placed_topk(index, frame(spark, queries, "q"), k, "q").collect()
    assert {(r["q"], r["v"]): (pytest.approx(r["score"], abs=2e-6), r["rank"]) for r in got} == brute(vectors, queries, k)


def test_few_cells_are_read(spark, tmp_path, data):
    vectors, queries = data
    place_vectors(frame(spark, vectors, "v"), f"{tmp_path}/p", "v", cell_rows=50)
    index = open_placed(spark, f"{tmp_path}/p", "v")
    assert index.cells.count() > 15 and index.cells.agg(F.sum("n")).first()[0] == 1500
    near = frame(spark, queries[:20], "q")
    share = visited_share(index, near, 5, "q")
    assert share < 0.35, share
    visits = placed._visits(index, near.limit(1), "q", "embedding", 5, known=False)
    plan = placed._compared(index, visits, "q", "embedding", 5)._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters" in plan and "_cell" in plan.split("PartitionFilters: [")[1].split("]")[0]


def test_empty_null_and_clashing(spark, tmp_path):
    empty = place_vectors(frame(spark, [None], "v"), f"{tmp_path}/e", "v")
    one = frame(spark, [[1, 0], None], "q")
    assert placed_topk(empty, one, 3, "q").count() == 0
    index = place_vectors(frame(spark, [[1, 0], None, [0, 2]], "v"), f"{tmp_path}/o", "v")
    got = placed_topk(index, one, 3, "q").orderBy("rank").collect()
    assert [tuple(r) for r in got] == [(0, 0, 1.0, 1), (0, 2, 0.0, 2)]
    assert placed_topk(index, one.limit(0), 3, "q").count() == 0
    with pytest.raises(ValueError):
        placed_topk(index, frame(spark, [[1, 0]], "v"), 3, "v")
