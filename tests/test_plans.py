"""The plans are the ones meant: what is pushed down, trimmed, and kept in the JVM."""

from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from staysift.operators import listings
from staysift.operators.chunking import fixed_chunks, recursive_chunks
from staysift.operators.curate import curated_listings
from staysift.operators.keyword import make_postings
from staysift.operators.ranking import latest_per_key, top_n
from staysift.plans.fixtures import hotels, places, stays
from staysift.sources.changes import snapshot_diff
from staysift.sources.profile import table_profile

FOLDER = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def searches(spark):
    return {
        "place": listings.place_search(places(spark, FOLDER)),
        "hotel": listings.hotel_search(hotels(spark, FOLDER)),
        "keyword": listings.keyword_any(hotels(spark, FOLDER)),
        "review": listings.review_search(stays(spark, FOLDER)),
        "curated": curated_listings(stays(spark, FOLDER), tie="doc_id"),
        "multi": listings.multi_review_listings(stays(spark, FOLDER), stays(spark, FOLDER), tie="doc_id"),
        "fixed": fixed_chunks(stays(spark, FOLDER).select("doc_id", "description"), "doc_id", "description"),
    }


def test_no_python_in_searches(searches, plan_of):
    for name, df in searches.items():
        plan = plan_of(df)
        assert "Python" not in plan and "Arrow" not in plan, name


def test_only_text_crosses_to_python(spark, plan_of):
    docs = spark.read.parquet(f"{FOLDER}/documents.parquet")
    plan = plan_of(recursive_chunks(docs, "doc_id", "text"))
    assert "ArrowEvalPython" in plan and "MapInPandas" not in plan and "Exchange" not in plan


def test_limits_are_top_k(searches, plan_of):
    for name in ("place", "keyword", "review"):
        assert "TakeOrderedAndProject" in plan_of(searches[name]), name


def test_window_is_trimmed_before_the_shuffle(spark, searches, plan_of):
    assert "WindowGroupLimit" in plan_of(searches["curated"])
    events = spark.read.parquet(f"{FOLDER}/events.parquet")
    plan = plan_of(latest_per_key(events, "user_id", [F.desc("ts"), F.desc("event_id")]))
    tree = plan[: plan.index("(1)")]
    assert tree.count("WindowGroupLimit") == 2 and tree.count("Exchange") == 1


def test_columns_and_filters_reach_the_scan(spark, plan_of):
    parts = spark.read.parquet(f"{FOLDER}/part.parquet")
    plan = plan_of(listings.guarded_filter(parts, "p_size > 10", key="p_partkey"))
    assert "GreaterThan(p_size,10)" in plan and "ReadSchema: struct<p_partkey:bigint,p_size:int>" in plan
    docs = spark.read.parquet(f"{FOLDER}/documents.parquet")
    assert "ReadSchema: struct<n_chars:bigint>" in plan_of(top_n(docs.select("n_chars"), 5, F.desc("n_chars")))


def test_off_filters_leave_no_trace(spark, plan_of):
    plan = plan_of(listings.place_search(places(spark, FOLDER), address=None, city="", category="NULL"))
    assert "NULL)" not in plan and "coalesce" not in plan.lower()


def test_text_is_split_once(spark, plan_of):
    docs = spark.read.parquet(f"{FOLDER}/documents.parquet")
    tree = plan_of(make_postings(docs, "doc_id", "text"))
    assert tree.count("split(lower(text") == 1 and tree[: tree.index("(1)")].count("Exchange") == 1


def test_partial_aggregates_come_before_shuffles(spark, plan_of):
    docs = spark.read.parquet(f"{FOLDER}/documents.parquet")
    for df, exchanges in ((snapshot_diff(docs, docs.limit(5), "doc_id"), 3), (table_profile(docs, exact=True), 2), (table_profile(docs), 1)):
        plan = plan_of(df)
        tree = plan[: plan.index("(1)")]
        assert tree.count("Exchange") <= exchanges and "HashAggregate" in tree


def test_hotels_are_searched_once_for_the_sort(spark, searches, plan_of):
    plan = plan_of(listings.hotel_search(spark.read.parquet(f"{FOLDER}/documents.parquet").selectExpr(
        "doc_id AS hotel_id", "text AS description", "text AS fine_print", "text AS property_highlights",
        "array(named_struct('review', text)) AS top_reviews", "array(named_struct('description', text)) AS house_rules",
        "double(n_chars) AS review_score", "lang AS city")))
    tree = plan[: plan.index("(1)")]
    assert tree.count("Exchange") == 2
