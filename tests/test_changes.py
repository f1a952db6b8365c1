"""Change feeds with whole rows: against plain multisets, with few buckets read."""

from __future__ import annotations

import random
from collections import Counter

import pytest
from pyspark.sql import functions as F

from staysift.sources import changes
from staysift.sources.changes import apply_changes, changed_rows, differing_buckets, open_snapshot, write_snapshot

OLD = "k long, name string, n int, gone string"
NEW = "k long, n int, name string, added array<int>"


def _rows(df, columns):
    return Counter(str([r[c] for c in columns]) for r in df.collect())


def _plain(old, new):
    """Multisets of (change, row) by key; rows are dictionaries without their nulls."""
    def bag(rows):
        out = {}
        for r in rows:
            out.setdefault(r.get("k"), Counter())[str(sorted(r.items()))] += 1
        return out
    a, b = bag(old), bag(new)
    want = Counter()
    for k in a.keys() | b.keys():
        both = k in a and k in b
        for row, n in (a.get(k, Counter()) - b.get(k, Counter())).items():
            want["update_before" if both else "delete", row] += n
        for row, n in (b.get(k, Counter()) - a.get(k, Counter())).items():
            want["update_after" if both else "insert", row] += n
    return want


def _dicts(df):
    return [{c: v for c, v in r.asDict().items() if v is not None} for r in df.collect()]


def test_feed_and_its_application(spark, tmp_path):
    rng = random.Random(2)
    old = [(rng.choice([None, *range(40)]), rng.choice("abc"), rng.randint(0, 2), rng.choice(["x", None])) for _ in range(300)]
    old += [(7, "same", 1, None)] * 50  # a key with many equal rows
    new = [(k, n, name, None) for k, name, n, _ in old[:150]] + [(7, 1, "same", None)] * 20
    new += [(rng.choice([None, *range(30, 60)]), rng.randint(0, 2), "b", [1]) for _ in range(60)]
    one, two = spark.createDataFrame(old, OLD), spark.createDataFrame(new, NEW)
    before = write_snapshot(one, f"{tmp_path}/a", "k", 16)
    after = write_snapshot(two, f"{tmp_path}/b", "k", 16)
    feed = changed_rows(before, after)
    assert feed.columns == ["_change", "k", "n", "name", "added", "gone"]
    got = Counter((d.pop("_change"), str(sorted(d.items()))) for d in _dicts(feed))
    assert got == _plain(_dicts(one), _dicts(two))
    applied = apply_changes(one, feed, "k")
    assert _rows(applied, ["k", "n", "name", "added", "gone"]) == _rows(
        two.withColumn("gone", F.lit(None)), ["k", "n", "name", "added", "gone"]
    )


def test_only_differing_buckets_are_read(spark, tmp_path):
    df = spark.range(2000).select(F.col("id").alias("k"), (F.col("id") % 7).alias("v"))
    old = write_snapshot(df, f"{tmp_path}/a", "k", 64)
    edited = df.withColumn("v", F.when(F.col("k") == 1234, 99).otherwise(F.col("v"))).withColumn("more", F.lit(None).cast("int"))
    new = write_snapshot(edited, f"{tmp_path}/b", "k", 64)
    assert len(differing_buckets(old, new)) == 1  # a column without values makes no difference
    feed = changed_rows(old, open_snapshot(spark, f"{tmp_path}/b", "k"))
    assert sorted(tuple(r) for r in feed.collect()) == [("update_after", 1234, 99, None), ("update_before", 1234, 2, None)]
    read = new.rows.where(F.col("_bucket").isin(differing_buckets(old, new)))
    assert read.count() < 2000 / 20
    plan = read._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [" in plan and "_bucket" in plan.split("PartitionFilters")[1].split("]")[0]


def test_odd_snapshots(spark, tmp_path):
    df = spark.createDataFrame([(1, "a", 1, None)], OLD)
    full = write_snapshot(df, f"{tmp_path}/a", "k", 8)
    empty = write_snapshot(df.limit(0), f"{tmp_path}/b", "k", 8)
    assert [r[0] for r in changed_rows(empty, full).collect()] == ["insert"]
    assert [r[0] for r in changed_rows(full, empty).collect()] == ["delete"]
    assert changed_rows(full, full).count() == 0 and changed_rows(empty, empty).count() == 0
    assert apply_changes(df.limit(0), changed_rows(empty, full), "k").collect() == df.collect()
    with pytest.raises(ValueError):
        changed_rows(full, write_snapshot(df, f"{tmp_path}/c", "k", 4))
    with pytest.raises(ValueError):
        write_snapshot(df.withColumn("_bucket", F.lit(1)), f"{tmp_path}/d", "k")


@pytest.mark.parametrize("few, hashes", [(500_000, 4_000_000), (0, 4_000_000), (0, 0)])
def test_rows_are_not_shuffled_for_a_feed(spark, tmp_path, plan_of, monkeypatch, few, hashes):
    """Digests are; rows come as they are read, and all ways of finding the changed ones agree."""
    monkeypatch.setattr(changes, "BROADCAST_ROWS", few)
    monkeypatch.setattr(changes, "HASHES", hashes)
    one = spark.createDataFrame([(i, f"row {i}") for i in range(40)] + [(3, "row 3"), (3, "row 3"), (None, "x")], "k long, name string")
    two = spark.createDataFrame([(i, f"row {i}" if i % 5 else "new") for i in range(2, 45)] + [(3, "row 3"), (None, "x")], "k long, name string")
    before, after = write_snapshot(one, f"{tmp_path}/a", "k", 4), write_snapshot(two, f"{tmp_path}/b", "k", 4)
    feed = changed_rows(before, after)
    got = Counter((d.pop("_change"), str(sorted(d.items()))) for d in _dicts(feed))
    assert got == _plain(_dicts(one), _dicts(two))
    applied = apply_changes(one, feed, "k")
    assert _rows(applied, ["k", "name"]) == _rows(two, ["k", "name"])
    single = spark.range(20).select(F.col("id").alias("k"), F.concat(F.lit("row "), F.col("id").cast("string")).alias("name"))
    feed = changed_rows(write_snapshot(single, f"{tmp_path}/c", "k", 4), write_snapshot(single.where("k > 5"), f"{tmp_path}/d", "k", 4))
    if few:
        assert "hashpartitioning" not in plan_of(feed) + plan_of(apply_changes(single, feed, "k"))
