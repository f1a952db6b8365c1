"""Searches through the trigram index against scans."""

from __future__ import annotations

import random

import pytest
from pyspark.sql import functions as F

from staysift.functions.predicates import text_match
from staysift.operators import substring
from staysift.operators.substring import build_substring_index, open_substring_index, possible_rows, rows_that_may_contain


@pytest.fixture(scope="module")
def table(spark):
    rng = random.Random(4)
    words = ["wheelchair", "Ramp", "éÀü", "x%y_z", "lift", "ab", "中文字", "😀😀😀", "line\nbreak"]
    rows = [(i, i // 100, " ".join(rng.choice(words) for _ in range(rng.randint(0, 4))), None if i % 7 else "lobby ramp") for i in range(1000)]
    rows += [(1000, 10, None, None), (1001, 10, "", None), (1002, 10, "only here: Escalator" + " pad" * 30_000, None)]
    return spark.createDataFrame(rows, "id int, area int, notes string, other string").repartition(5)


@pytest.fixture(scope="module")
def index(table, tmp_path_factory):
    path = str(tmp_path_factory.mktemp("grams"))
    return build_substring_index(table, path, [F.col("notes"), F.col("other")], ["area", "id"], 50), path


TERMS = ["wheelchair", "RAMP", "éàü", "x%y_z", "lift ab", "ab", "a", "", "中文字", "😀😀", "e\nb", "nowhere", "escalator", "airramp", "lobby ramp"]


@pytest.mark.parametrize("term", TERMS)
def test_same_as_a_scan(table, index, term):
    hit = text_match("notes", term) | text_match("other", term)
    want = sorted(r["id"] for r in table.where(hit).collect())
    found = rows_that_may_contain(index[0], term)
    assert found.columns == table.columns
    assert sorted(r["id"] for r in found.where(hit).collect()) == want


def test_few_rows_and_files_are_read(spark, index):
    index, path = index
    found = rows_that_may_contain(index, "escalator")
    assert [r["id"] for r in found.collect()] == [1002]
    files = index.rows.where(F.col("_block").isin([r[0] for r in possible_rows(index, "escalator").select("_block").distinct().collect()]))
    opened = files.select(F.input_file_name()).distinct().count()
    assert opened == 1 and index.rows.select("_block").distinct().count() > 15
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters" in plan and "_block" in plan.split("PartitionFilters")[1].split("]")[0]
    assert rows_that_may_contain(index, "nowhere").count() == 0
    again = open_substring_index(spark, path)
    assert rows_that_may_contain(again, "escalator").count() == 1


def test_several_terms_and_many_blocks(table, index, monkeypatch):
    monkeypatch.setattr(substring, "NAMED_BLOCKS", 2)
    found = rows_that_may_contain(index[0], ["wheelchair", "ramp"])
    hit = text_match("notes", "wheelchair") | text_match("notes", "ramp") | text_match("other", "ramp")
    assert found.where(hit).count() == table.where(hit).count()
    assert rows_that_may_contain(index[0], ["wheelchair", "zz"]).count() == table.count()


def test_empty_table_and_clashing_names(spark, table, tmp_path):
    empty = build_substring_index(table.limit(0), f"{tmp_path}/e", [F.col("notes")], ["id"])
    assert rows_that_may_contain(empty, "ramp").count() == 0 and rows_that_may_contain(empty, "ramp").columns == table.columns
    odd = table.withColumnsRenamed({"other": "rows", "area": "gram"})
    index = build_substring_index(odd, f"{tmp_path}/o", [F.col("notes")], ["id"], 100)
    assert rows_that_may_contain(index, "lift").where(text_match("notes", "lift")).count() == odd.where(text_match("notes", "lift")).count()
    with pytest.raises(ValueError):
        build_substring_index(table.withColumn("_row", F.lit(1)), f"{tmp_path}/c", [F.col("notes")], ["id"])
