"""Profiles of parts, merged from their sketches."""

from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from staysift.sources.sketches import merged_profile, write_profile_part

FIELDS = "id long, price double, city string, tags array<string>, `odd name` int, nothing string"


def rows(first, n):
    return [
        (i, None if i % 10 == 0 else float(i), "Rome" if i % 3 else f"c{i}", [str(i % 5)], i % 4, None)
        for i in range(first, first + n)
    ]


def by_column(df):
    return {r.column_name: r for r in df.collect()}


def test_parts_merge_to_the_profile_of_all_rows(spark, tmp_path):
    path = str(tmp_path / "profile")
    write_profile_part(spark.createDataFrame(rows(0, 3000), FIELDS), path, 0)
    write_profile_part(spark.createDataFrame(rows(3000, 1500), FIELDS).repartition(3), path, 1)
    got = by_column(merged_profile(spark, path))
    assert {n: (r.n_rows, r.n_nulls) for n, r in got.items()} == {
        "id": (4500, 0), "price": (4500, 450), "city": (4500, 0), "tags": (4500, 0),
        "odd name": (4500, 0), "nothing": (4500, 4500),
    }
    for name, n in {"id": 4500, "price": 4050, "city": 1501, "tags": 5, "odd name": 4, "nothing": 0}.items():
        assert got[name].n_distinct == pytest.approx(n, rel=0.04), name
    assert got["price"].quantiles[1] == pytest.approx(2250, abs=0.02 * 4500)
    assert got["city"].quantiles is None and got["nothing"].quantiles is None
    top = got["city"].frequent[0]
    assert (top[0], top[1]) == ("Rome", 3000)
    assert sorted(x[1] for x in got["odd name"].frequent) == [1125] * 4


def test_a_part_written_again_counts_once(spark, tmp_path):
    path = str(tmp_path / "again")
    frame = spark.createDataFrame(rows(0, 100), FIELDS)
    write_profile_part(frame, path, 7)
    write_profile_part(frame, path, 7)
    assert by_column(merged_profile(spark, path))["id"].n_rows == 100


def test_only_new_rows_are_read(spark, tmp_path):
    """The old rows are gone when the new ones are added; the merged profile still has them."""
    path, table = str(tmp_path / "new"), tmp_path / "table"
    spark.createDataFrame(rows(0, 200), FIELDS).write.parquet(str(table))
    write_profile_part(spark.read.parquet(str(table)), path, 0)
    for file in table.iterdir():
        file.write_bytes(b"")  # a scan of it would fail
    write_profile_part(spark.createDataFrame(rows(200, 50), FIELDS), path, 1)
    got = by_column(merged_profile(spark, path))
    assert (got["id"].n_rows, got["id"].n_distinct) == (250, pytest.approx(250, rel=0.02))
    files = {f for f in merged_profile(spark, path).inputFiles()}
    assert files and all("/new/part=" in f for f in files)


def test_empty_parts_new_columns_and_long_values(spark, tmp_path):
    path = str(tmp_path / "odd")
    write_profile_part(spark.createDataFrame([], "a string"), path, 0)
    long = spark.createDataFrame([("x" * 5000,), ("x" * 5000,), (None,), ("",)], "a string")
    write_profile_part(long.withColumn("part_no", F.lit(1)), path, 1)
    got = by_column(merged_profile(spark, path))
    assert (got["a"].n_rows, got["a"].n_nulls, got["a"].n_distinct) == (4, 1, 2)
    assert got["a"].frequent[0][0].startswith("md5:") and got["a"].frequent[0][1] == 2
    assert got["part_no"].n_rows == 4


def test_null_lists_are_no_values(spark, tmp_path):
    frame = spark.createDataFrame([(["a"],), (None,), (None,)], "tags array<string>")
    write_profile_part(frame, str(tmp_path / "lists"), 0)
    row = merged_profile(spark, str(tmp_path / "lists")).first()
    assert (row.n_rows, row.n_nulls, row.n_distinct, len(row.frequent)) == (3, 2, 1, 1)
