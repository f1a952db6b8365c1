from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from staysift.operators import joins
from staysift.operators.joins import hot_keys, join_on_unique, keep_ids
from staysift.operators.ranking import first_rows, numbered, top_k_per_group, top_n
from staysift.session import (
    broadcast_if_small,
    cut_and_measure,
    cut_lineage,
    remove_scratch,
    scratch_path,
    shared_dir,
    spread,
)


@pytest.fixture(scope="module")
def sides(spark):
    rows = spark.range(3000).select(
        F.when(F.col("id") < 1000, 1).when(F.col("id") < 1010, None).otherwise(F.col("id") % 50).alias("k"), "id"
    )
    lookup = spark.range(0, 40).select(F.col("id").alias("k"), (F.col("id") * 10).alias("v"))
    return rows, lookup


@pytest.mark.parametrize("how", ["inner", "left", "left_semi"])
@pytest.mark.parametrize("hot_rows", [1, 500, 10**9])
def test_join_on_unique_equals_plain_join(sides, how, hot_rows):
    rows, lookup = sides
    got = join_on_unique(rows, lookup, "k", "id", how, hot_rows)
    want = rows.join(lookup, "k", how)
    assert got.columns == want.columns
    assert sorted(got.collect(), key=str) == sorted(want.collect(), key=str)


def test_hot_keys(sides):
    rows, _ = sides
    assert [r.k for r in hot_keys(rows, "k", 500).collect()] == [1]
    assert hot_keys(rows, "k", 10**9).count() == 0


def test_hot_key_is_spread(sides, spark):
    rows, lookup = sides
    off = {"spark.sql.autoBroadcastJoinThreshold": "-1", "spark.sql.adaptive.coalescePartitions.enabled": "false"}
    for name, value in off.items():
        spark.conf.set(name, value)
    try:
        one_key = rows.where("k = 1")
        for hot_rows, many in ((1, True), (10**9, False)):
            joined = join_on_unique(one_key, lookup, "k", "id", hot_rows=hot_rows)
            assert (joined.select(F.spark_partition_id()).distinct().count() > 1) == many
    finally:
        for name in off:
            spark.conf.unset(name)


def test_keep_ids(sides, spark, monkeypatch):
    rows, lookup = sides
    ids = lookup.select("k").union(lookup.select("k"))
    want = sorted(rows.where("k < 40").collect())
    assert sorted(keep_ids(rows, "k", range(40)).collect()) == want
    assert sorted(keep_ids(rows, "k", ids).collect()) == want
    monkeypatch.setattr(joins, "broadcast_if_small", lambda df, **_: df)
    assert sorted(keep_ids(rows, "k", ids, hot_rows=100).collect()) == want


def test_top_n_is_the_top_of_all_tasks(spark):
    df = spark.range(5000).select(F.xxhash64("id").alias("h"), "id").repartition(13)
    want = sorted(df.collect(), key=lambda r: (-r.h, r.id))[:20]
    assert top_n(df, 20, F.desc("h"), F.asc("id")).collect() == want
    assert first_rows(df, 20, F.desc("h"), F.asc("id")).collect() == want
    assert first_rows(df, 20, any_rows=True).count() == 20


def test_top_k_per_group(spark):
    df = spark.createDataFrame([("a", 1, 1), ("a", 2, 1), ("a", 3, 2), ("b", 4, 0), (None, 5, 0)], "g string, id int, s int")
    out = top_k_per_group(df, "g", [F.desc("s"), F.asc("id")], 2).collect()
    assert sorted((str(r.g), r.id, r["rank"]) for r in out) == [("None", 5, 1), ("a", 1, 2), ("a", 3, 1), ("b", 4, 1)]


def test_cut_and_measure(spark):
    df = spark.range(10).withColumn("v", F.col("id") * 2)
    copy, seen = cut_and_measure(df, total=F.sum("v"))
    assert seen == {"rows": 10, "total": 90}
    assert sorted(copy.collect()) == sorted(df.collect())
    assert cut_lineage(df.where("id < 0")).count() == 0


def test_shared_folder_is_the_one_the_session_names(spark):
    assert shared_dir(spark) == spark.conf.get("spark.checkpoint.dir")
    assert scratch_path(spark, "x") != scratch_path(spark, "x")


def test_scratch_can_be_removed(spark):
    other = spark.newSession()
    copy = cut_lineage(other.range(5).toDF("id"))
    assert copy.count() == 5
    kept = f"{shared_dir(spark)}/kept"
    spark.range(3).write.parquet(kept)
    remove_scratch(other)
    assert spark.read.parquet(kept).count() == 3
    with pytest.raises(Exception):
        copy.count()


def test_without_the_setting_only_local_mode_has_a_folder(spark):
    class Session:
        def __init__(self, master):
            self.sparkContext = type("Context", (), {"master": master})
            self.conf = type("Conf", (), {"get": staticmethod(lambda name, default: default)})

    assert shared_dir(Session("local[2]")) == shared_dir(Session("local[2]"))
    with pytest.raises(ValueError, match="spark.checkpoint.dir"):
        shared_dir(Session("yarn"))


def test_broadcast_only_when_small(spark, plan_of):
    df = spark.range(100)
    assert broadcast_if_small(df, 99) is df
    assert broadcast_if_small(df, 99, rows=5) is not df
    assert "hint" in broadcast_if_small(df, 100)._jdf.queryExecution().logical().toString().lower()


def test_spread(spark):
    few = spark.range(100).coalesce(1)
    assert spread(few, "id").rdd.getNumPartitions() == spark.sparkContext.defaultParallelism
    many = spark.range(100).repartition(16)
    assert spread(many, "id") is many


def test_every_key_above_the_bound_is_split(spark):
    rows = spark.range(6000).select((F.col("id") % 1500).alias("k"), "id")
    lookup = spark.range(1500).select(F.col("id").alias("k"), (F.col("id") * 2).alias("v"))
    assert hot_keys(rows, "k", 4).count() == 1500
    assert {r._salts for r in hot_keys(rows, "k", 2).collect()} == {3}
    got = join_on_unique(rows, lookup, "k", "id", hot_rows=2)
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, rows.join(lookup, "k").collect()))


def test_rows_without_a_key_are_spread_in_a_left_join(spark):
    rows = spark.range(3000).select(F.when(F.col("id") % 10 == 0, F.col("id")).alias("k"), "id")
    lookup = spark.range(100).select((F.col("id") * 10).alias("k"), F.lit("v").alias("v"))
    got = join_on_unique(rows, lookup, "k", "id", how="left")
    assert got.count() == 3000 and got.where("v IS NOT NULL").count() == 100
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        placed = join_on_unique(rows, lookup, "k", "id", how="left").where("k IS NULL")
        assert placed.groupBy(F.spark_partition_id()).count().count() > 1
    finally:
        spark.conf.unset("spark.sql.adaptive.enabled")
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")


@pytest.mark.parametrize("k", [3, 1000, 1001])
def test_top_k_beyond_the_group_limit(spark, k):
    rows = spark.range(4000).select(F.when(F.col("id") % 5 > 0, F.lit("big")).alias("g"), (F.col("id") * 7 % 4001).alias("v"), "id")
    order = [F.desc("v"), F.asc("id")]
    got = sorted((r.g or "", r["rank"], r.id) for r in top_k_per_group(rows.repartition(7), "g", order, k).collect())
    want = []
    for g in ("big", ""):
        own = sorted(((-r.v, r.id) for r in rows.collect() if (r.g or "") == g))[:k]
        want += [(g, i, x[1]) for i, x in enumerate(own, 1)]
    assert got == sorted(want)
    best = [r.id for r in top_n(rows.repartition(7), k, *order).collect()]
    assert best == [r.id for r in rows.orderBy(*order).limit(k).collect()]


def test_numbers_of_a_group_run_through_all_ranges(spark):
    rows = spark.range(1000).select((F.col("id") % 3).alias("g"), "id").repartition(5)
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        got = numbered(rows, "g", [F.desc("id")], "no").collect()
    finally:
        spark.conf.unset("spark.sql.adaptive.enabled")
    for g in range(3):
        own = sorted((r.no, r.id) for r in got if r.g == g)
        assert own == list(enumerate(sorted((i for i in range(1000) if i % 3 == g), reverse=True), 1))
