"""Exact top-k and vector near-duplicates against plain versions."""

from __future__ import annotations

import math

import numpy as np
import pytest

from staysift.llm import projection, topk

NAN = float("nan")
INF = float("inf")
ODD = [
    (1, [0.5, -0.25], 1, "q"), (1, [0.5, -0.25], 1, "q"), (2, [0.25, 0.5], 1, "q"), (2, [0.1, 0.5], 0, "q"),
    (3, None, 1, "q"), (4, [NAN, 1.0], 1, "q"), (5, [INF, 1.0], 1, "q"), (6, [None, 1.0], 1, "q"),
    (7, [], 1, "q"), (8, [0.0, 0.0], 1, "q"), (None, [1.0, 1.0], 1, "q"), (9, [0.5, -0.25, 0.0], 1, "q"),
    (10, [0.5, -0.25], None, "q"), (11, [1.0, -0.5], 1, "q"), (12, [-1e30, 1e300], 1, "q"), (13, [1.0, -0.52], 1, "q"),
]
SCHEMA = "vec_id long, embedding array<double>, label int, score string"


def usable(v):
    return v is not None and len(v) and all(x is not None and math.isfinite(x) for x in v)


def plain_topk(rows, queries, k):
    best = {}
    for i, v, *_ in rows:
        if i is not None and usable(v):
            best[i] = min(best.get(i, v), v)
    whole = {i: [int(math.floor(min(max(256 * x, -1.7976931348623157e308), 1.7976931348623157e308))) for x in v] for i, v in best.items()}
    low, high = -(2**63) + 1, 2**63 - 1
    out = []
    for q in sorted(set(queries) & set(whole)):
        scores = [
            (-min(max(sum(a * b for a, b in zip(whole[q], v)), low), high), i)
            for i, v in whole.items() if i != q and len(v) == len(whole[q])
        ]
        out += [(q, r, i, -s) for r, (s, i) in enumerate(sorted(scores)[:k], 1)]
    return out


def listed(df):
    return sorted((r.query_id, r["rank"], r.vec_id, r.score) for r in df.collect())


@pytest.mark.parametrize("k", [1, 5, 50])
def test_topk_of_odd_rows(spark, k):
    df = spark.createDataFrame(ODD, SCHEMA)
    assert listed(topk.exact_topk(df, df, k)) == plain_topk(ODD, [r[0] for r in ODD], k)
    assert listed(topk.exact_topk(df.limit(0), df, k)) == []
    assert listed(topk.exact_topk(df, df.limit(0), k)) == []


def test_topk_with_ties_in_many_tiles_and_rounds(spark, monkeypatch):
    rng = np.random.default_rng(2)
    rows = [(int(i), [float(x) for x in rng.integers(-3, 3, 6) / 256], 0, "q") for i in rng.permutation(700)]
    df = spark.createDataFrame(rows, SCHEMA).repartition(6)
    for name, value in (("TILE", 37), ("QUERIES", 11), ("ROUND_BYTES", 1500)):
        monkeypatch.setattr(topk, name, value)
    asked = [i for i, *_ in rows if i % 20 == 0]
    got = topk.exact_topk(df, df.where("vec_id % 20 = 0"), 5)
    assert listed(got) == plain_topk(rows, asked, 5)


def test_the_driver_holds_one_block_of_queries_at_a_time(spark, monkeypatch):
    from pyspark import Broadcast, SparkContext

    from staysift.operators import vectors

    held, most = set(), []
    make, drop, toarrow = SparkContext.broadcast, Broadcast.destroy, type(spark.range(1)).toArrow
    collect = type(spark.range(1)).collect

    def made(self, value):
        out = make(self, value)
        held.add(id(out))
        most.append(len(held))
        return out

    def dropped(self, blocking=False):
        held.discard(id(self))
        return drop(self, blocking)

    fetched = []
    monkeypatch.setattr(SparkContext, "broadcast", made)
    monkeypatch.setattr(Broadcast, "destroy", dropped)
    monkeypatch.setattr(type(spark.range(1)), "collect", lambda self: (fetched.append(len(held)), collect(self))[1])
    monkeypatch.setattr(type(spark.range(1)), "toArrow", lambda self: (fetched.append(len(held)), toarrow(self))[1])
    for name, value in (("QUERIES", 11), ("ROUND_BYTES", 1500)):
        monkeypatch.setattr(topk, name, value)
    rng = np.random.default_rng(3)
    rows = [(i, [float(x) for x in rng.normal(size=6)], 0, "q") for i in range(300)]
    df = spark.createDataFrame(rows, SCHEMA).repartition(3)
    found = topk.exact_topk(df, df.where("vec_id % 5 = 0"), 3)
    assert len(most) > 1 and max(most) == 1 and max(fetched) == 0 and not held
    assert listed(found) == plain_topk(rows, [i for i in range(300) if i % 5 == 0], 3)
    most.clear(), fetched.clear()
    asked = df.where("vec_id % 5 = 0").withColumnRenamed("vec_id", "q")
    near_ones = vectors.vector_topk(df, asked, 3, "vec_id", "q", query_numbers=60)
    assert len(most) > 1 and max(most) == 1 and max(fetched) == 0 and not held
    unit = np.array([v for _, v, *_ in rows])
    unit /= np.linalg.norm(unit, axis=1, keepdims=True)
    got = {(r.q, r["rank"]): r.vec_id for r in near_ones.collect()}
    assert got == {(i, n): int(j) for i in range(0, 300, 5) for n, j in enumerate(np.argsort(-(unit @ unit[i]))[:3], 1)}


def test_products_are_exact():
    big = np.array([[2.0**40, -(2.0**40) + 1], [3.0, 5.0]])
    assert topk.products(big, big).tolist() == [
        [2**63 - 1, -(2**40) * 2 + 5], [-(2**40) * 2 + 5, 34]
    ] or topk.products(big, big)[1].tolist() == [3 * 2**40 + 5 * (1 - 2**40), 34]


def plain_near(rows, threshold=0.98):
    best = {}
    for i, v, label, *_ in rows:
        key = (label is not None, label, v is not None, [(x is not None, x if x == x else INF) for x in v or []])
        if i not in best or key < best[i][0]:
            best[i] = (key, v, label)
    ids = list(best)
    unit = {}
    for i in ids:
        _, v, label = best[i]
        if i is not None and label is not None and usable(v) and any(v):
            x = np.array(v) / np.abs(v).max()
            unit[i] = (label, x / np.linalg.norm(x))
    links = {i: [] for i in ids}
    for i in unit:
        for j in unit:
            if i != j and unit[i][0] == unit[j][0] and len(unit[i][1]) == len(unit[j][1]) and unit[i][1] @ unit[j][1] >= threshold:
                links[i].append(j)
    out = []
    for i in ids:
        seen, todo = {i}, [i]
        while todo:
            for j in links[todo.pop()]:
                if j not in seen:
                    seen.add(j)
                    todo.append(j)
        low = None if i is None else min(seen)
        out.append((i, len(links[i]), low, low == i))
    return sorted(out, key=str)


def near(df, **options):
    return sorted([(r.vec_id, r.n_links, r.component_id, r.kept) for r in projection.near_vectors(df, **options).collect()], key=str)


def test_near_vectors_of_odd_rows(spark):
    df = spark.createDataFrame(ODD, SCHEMA)
    assert near(df) == plain_near(ODD)
    assert near(df.limit(0)) == []


@pytest.mark.parametrize("window", [4, 32])
def test_a_group_larger_than_every_window_is_counted_in_full(spark, monkeypatch, window):
    rng = np.random.default_rng(4)
    centre = rng.normal(size=16)
    vectors = [centre + rng.normal(size=16) * 0.06 for _ in range(150)] + list(rng.normal(size=(150, 16)))
    vectors += [vectors[-1] * s for s in (2.0, 1e-3)]
    rows = [(i, [float(x) for x in v], i % 2 if i > 150 else 0, "q") for i, v in enumerate(vectors)]
    monkeypatch.setattr(projection, "PART", 40)
    monkeypatch.setattr(projection, "LOT", 16)
    df = spark.createDataFrame(rows, SCHEMA).repartition(4)
    assert near(df, window=window, passes=24) == plain_near(rows)


def test_pairs_in_a_hot_cluster_are_found_among_many_neighbours(spark):
    rng = np.random.default_rng(6)

    def unit(x):
        return x / np.linalg.norm(x, axis=1, keepdims=True)

    def beside(v, cosine):
        other = rng.normal(size=v.shape)
        other = unit(other - (other * v).sum(axis=1, keepdims=True) * v)
        return cosine * v + math.sqrt(1 - cosine**2) * other

    centre = unit(rng.normal(size=(1, 64)))
    cluster = beside(np.repeat(centre, 3000, axis=0), math.sqrt(0.93))
    vectors = np.vstack([cluster, beside(cluster[:300], 0.982), unit(rng.normal(size=(3000, 64)))])
    near_ones = vectors @ vectors.T >= projection.THRESHOLD
    want = near_ones.sum(axis=1) - 1
    assert (want[:300] > 0).all() and want.max() < 10
    rows = [(i, [float(x) for x in v], 0, "q") for i, v in enumerate(vectors)]
    got = near(spark.createDataFrame(rows, SCHEMA).repartition(4))
    assert [n for _, n, *_ in sorted(got)] == want.tolist()


def test_equal_vectors_count_each_other(spark):
    rows = [(i, [1.0, 0.0 if i < 200 else 0.1], i % 2, "q") for i in range(300)]
    assert near(spark.createDataFrame(rows, SCHEMA).repartition(4)) == plain_near(rows)


def test_queries_over_embeddings(spark):
    from staysift.llm.queries import QUERIES

    rows = spark.read.parquet("/root/testdata/sf0.001/embeddings.parquet").select("vec_id", "embedding", "label").collect()
    got = QUERIES["op7_projection_passes"](spark, "/root/testdata/sf0.001").collect()
    assert sorted([(r.vec_id, r.n_links, r.component_id, r.kept) for r in got], key=str) == plain_near(rows)
    found = QUERIES["op5_exact_topk"](spark, "/root/testdata/sf0.001")
    assert listed(found) == plain_topk(rows, [r.vec_id for r in rows if r.vec_id % 50 == 0], 5)
