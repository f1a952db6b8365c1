from __future__ import annotations

import json

import pytest
from pyspark.sql import functions as F

from staysift.operators.conversations import prepend_system_turn, prompt_per_group, route_by_last_turn
from staysift.sources.changes import snapshot_diff
from staysift.sources.jsonrows import json_rows, write_json_rows
from staysift.sources.profile import table_profile
from staysift.sources.tables import (
    read_merged,
    read_table,
    replace_path,
    replace_table,
    require_columns,
    union_schemas,
)


def test_snapshot_diff(spark):
    old = spark.createDataFrame([(1, "a", None), (2, "b", "x"), (3, "c", "x"), (5, "r", "r"), (5, "r", "r"), (6, None, "v"), (7, "s", "s")],
                                "k int, a string, b string")
    new = spark.createDataFrame([("a", 1, None), ("B", 2, "x"), ("n", 4, "x"), ("r", 5, "r"), ("v", 6, None), ("s", 7, "s"), ("t", 7, "t")],
                                "a string, k int, b string")
    got = sorted(tuple(r) for r in snapshot_diff(old, new, "k").collect())
    assert got == [
        (2, "update", 1, 1), (3, "delete", 1, 0), (4, "insert", 0, 1), (5, "update", 1, 0),
        (6, "update", 1, 1), (7, "update", 0, 1),
    ]
    assert snapshot_diff(old, old, "k").count() == 0


def test_snapshot_diff_rebuilds_the_new_table(spark):
    old = spark.range(500).select("id", (F.col("id") % 7).alias("v"))
    new = old.where("id % 5 <> 0").withColumn("v", F.when(F.col("id") % 3 == 0, 9).otherwise(F.col("v"))).union(spark.range(600, 650).select("id", F.lit(1)))
    diff = snapshot_diff(old, new, "id")
    kept = old.join(diff, "id", "left_anti")
    taken = new.join(diff.where("change_type <> 'delete'"), "id", "left_semi")
    assert sorted(kept.union(taken).collect()) == sorted(new.collect())


def test_profile(spark):
    df = spark.createDataFrame([(1, "a"), (2, None), (2, "a"), (None, None)], "n int, s string")
    exact = {r.column_name: tuple(r)[1:] for r in table_profile(df, exact=True).collect()}
    assert exact == {"n": ("int", 4, 1, 2), "s": ("string", 4, 2, 1)}
    assert {r.column_name: tuple(r)[1:] for r in table_profile(df).collect()} == exact


def test_writers(spark, tmp_path):
    path = str(tmp_path / "t")
    narrow = spark.createDataFrame([(1, "a")], "id int, text string")
    wide = spark.createDataFrame([(2, "b", "c")], "id int, text string, extra string")
    assert replace_path(narrow, path).count() == 1
    again = replace_path(wide, path)
    assert [tuple(r) for r in again.collect()] == [(2, "b", "c")]
    narrow.write.mode("append").parquet(path)
    assert sorted(tuple(r) for r in read_merged(spark, path).select("id", "extra").collect()) == [(1, None), (2, "c")]
    assert sorted(tuple(r) for r in union_schemas(narrow, wide).collect()) == [(1, "a", None), (2, "b", "c")]
    wide.write.parquet(str(tmp_path / "named.parquet"))
    assert read_table(spark, str(tmp_path), "named", "id").columns == ["id"]


def test_replace_table_and_bucketed_grouping(spark, plan_of):
    df = spark.range(100).select((F.col("id") % 10).alias("k"), F.col("id").alias("v"))
    assert replace_table(df.limit(1), "chunk_table").count() == 1
    table = replace_table(df, "chunk_table", bucket_by="k", buckets=4)
    assert table.count() == 100
    assert "Exchange" not in plan_of(table.groupBy("k", "v").count())
    spark.sql("DROP TABLE chunk_table")


def test_require_columns(spark):
    df = spark.createDataFrame([(1, "a")], "id int, text string")
    assert require_columns(df, {"id": "int"}) is df
    with pytest.raises(ValueError, match="text"):
        require_columns(df, {"text": "array<string>"})


def test_json(spark, tmp_path):
    df = spark.createDataFrame([(1, "é"), (2, None)], "id int, t string")
    assert sorted(r.value for r in json_rows(df).collect()) == ['{"id":1,"t":"é"}', '{"id":2}']
    path = str(tmp_path / "j")
    write_json_rows(df, path, "id")
    assert sorted(tuple(r) for r in spark.read.json(path).select("id", "t").collect()) == [(1, "é"), (2, None)]


@pytest.fixture
def turns(spark):
    return spark.createDataFrame(
        [(1, 0, "user", "hi"), (1, 1, "assistant", "call tool"), (2, 3, "user", "x"), (2, 4, "assistant", None)],
        "conv_id int, turn int, role string, text string",
    )


def test_system_turn(turns):
    assert prepend_system_turn(turns, None) is turns
    assert prepend_system_turn(turns, "") is turns
    out = sorted(tuple(r) for r in prepend_system_turn(turns, "p").where("role = 'system'").collect())
    assert out == [(1, -1, "system", "p"), (2, 2, "system", "p")]


def test_route(turns):
    out = route_by_last_turn(turns, F.col("text").contains("tool")).orderBy("conv_id").collect()
    assert [tuple(r) for r in out] == [(1, 1, "assistant", "continue"), (2, 4, "assistant", "end")]


def test_prompt(turns):
    out = prompt_per_group(turns, "conv_id", [F.desc("turn")], ["turn", "text"], "Data: %s!", page_rows=1)
    prompts = {(r.conv_id, r.page_no): r.prompt for r in out.collect()}
    assert len(prompts) == turns.count()
    assert json.loads(prompts[1, 0][6:-1]) == [{"turn": 1, "text": "call tool"}]


def test_snapshot_diff_with_other_columns(spark):
    old = spark.createDataFrame([(1, "a", 5), (2, "b", None)], "k long, v string, gone int")
    new = spark.createDataFrame([(1, "a", None), (2, "b", 0.5)], "k long, v string, more double")
    got = sorted(tuple(r) for r in snapshot_diff(old, new, "k").collect())
    assert got == [(1, "update", 1, 1), (2, "update", 1, 1)]
    same = old.where("k = 2").drop("gone")
    assert snapshot_diff(old.where("k = 2"), same, "k").count() == 0
