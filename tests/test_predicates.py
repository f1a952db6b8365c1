from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from staysift.functions import predicates as p
from staysift.functions.text import drop_digit_words, first_number, join_list, show_nested, strip, tokens


def values(df):
    return [r[0] for r in df.collect()]


def texts(spark, *items):
    return spark.createDataFrame([(i, t) for i, t in enumerate(items)], "id int, t string")


def kept(df, predicate):
    return sorted(r.id for r in df.where(predicate).collect())


def test_modes_ignore_case_and_null(spark):
    df = texts(spark, "Wheelchair ramp", "has a WHEELCHAIR", "none", None)
    assert kept(df, p.text_match("t", "wheelchair")) == [0, 1]
    assert kept(df, p.text_match("t", "wheelchair", mode="prefix")) == [0]
    assert kept(df, p.text_match("t", "wheelchair", mode="suffix")) == [1]


def test_wildcards_are_literal_unless_asked(spark):
    df = texts(spark, "100% sure", "1000 sure", "a_b", "axb")
    assert kept(df, p.text_match("t", "0% s")) == [0]
    assert kept(df, p.text_match("t", "0% s", raw_pattern=True)) == [0, 1]
    assert kept(df, p.text_match("t", "a_b")) == [2]
    assert kept(df, p.text_match("t", "a_b", raw_pattern=True)) == [2, 3]


@pytest.mark.parametrize("off", [None, "", "NULL"])
def test_optional_argument_off(spark, off):
    df = texts(spark, "x", None)
    assert p.optional_match("t", off) is None
    assert kept(p.where_all(df, p.optional_match("t", off)), F.lit(True)) == [0, 1]


def test_optional_argument_on(spark):
    df = texts(spark, "New York", "york", "Boston", None)
    assert kept(p.where_all(df, p.optional_match("t", "YORK")), F.lit(True)) == [0, 1]


def test_optional_column_argument(spark):
    rows = [(0, "Paris", None), (1, "Paris", ""), (2, "Paris", "NULL"), (3, "Paris", "par"), (4, "Paris", "x"), (5, None, "x")]
    df = spark.createDataFrame(rows, "id int, t string, a string")
    assert kept(df, p.optional_match_column("t", "a")) == [0, 1, 2, 3]


def test_any_element_is_never_null(spark):
    rows = [(0, ["a wheel chair", None]), (1, [None, "x"]), (2, None), (3, []), (4, ["WHEELCHAIR"])]
    df = spark.createDataFrame(rows, "id int, r array<string>")
    hit = p.any_element("r", ["wheelchair", "wheel chair"])
    assert kept(df, hit) == [0, 4]
    assert kept(df, ~hit) == [1, 2, 3]


def test_nested_match_as_if_joined(spark):
    rows = [(0, [("ends with a",), ("b starts",)]), (1, [("a, b",)]), (2, [(None,), ("z",)]), (3, None)]
    df = spark.createDataFrame(rows, "id int, r array<struct<review string>>")
    assert kept(df, p.nested_match("r", "review", "a, b")) == [0, 1]
    assert kept(df, p.nested_match("r", "review", "Z")) == [2]
    assert kept(df, ~p.nested_match("r", "review", "Z")) == [0, 1, 3]


def test_struct_match_sees_fields_and_names(spark):
    rows = [(0, [("quiet", 1)]), (1, [("loud", 2)])]
    df = spark.createDataFrame(rows, "id int, r array<struct<review string, n int>>")
    assert kept(df, p.struct_match("r", "LOUD")) == [1]
    assert kept(df, p.struct_match("r", "review")) == [0, 1]


def test_any_of_nothing_is_false(spark):
    assert kept(texts(spark, "x"), p.any_of([])) == []


def test_null_operand_does_not_hide_a_hit(spark):
    df = spark.createDataFrame([(0, None, "x"), (1, None, "y")], "id int, a string, b string")
    assert kept(df, p.any_of([p.text_match("a", "x"), p.text_match("b", "x")])) == [0]


def test_first_number(spark):
    df = texts(spark, "4.5 stars", "rated 3", "n/a", "", None, "7. x")
    assert values(df.orderBy("id").select(first_number("t"))) == [4.5, 3.0, None, None, None, 7.0]
    assert df.select(first_number("t").alias("n")).dtypes == [("n", "float")]


def test_rendering(spark):
    df = spark.createDataFrame([(["a", None, "b"],), (None,)], "r array<string>")
    assert values(df.select(join_list("r", "\n"))) == ["a\nb", ""]
    nested = spark.createDataFrame([([(1, "x")],), (None,)], "r array<struct<a int, b string>>")
    assert values(nested.select(show_nested("r"))) == ["[{1, x}]", ""]


def test_digit_words_and_strip(spark):
    df = texts(spark, "a1 12 b", "é5 7é 8", "\t 9\n")
    assert values(df.orderBy("id").select(strip(drop_digit_words("t")))) == ["a1  b", "é5 7é", ""]


def test_tokens_in_any_script(spark):
    df = texts(spark, "Ça va, l'été 2024! ", "", "--")
    assert values(df.orderBy("id").select(tokens("t"))) == [["ça", "va", "l", "été", "2024"], [], []]
