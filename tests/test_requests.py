"""Batches of place requests against one search for each."""

from __future__ import annotations

import random

from staysift.operators import requests as requests_module
from staysift.operators.listings import place_search
from staysift.operators.requests import place_search_batch

PLACES = (
    "title string, accessibility array<struct<description string>>, business_category array<string>,"
    " business_status string, city string, country string, address string, phone_number string,"
    " place_information string, rating string, place_url string"
)
REQUESTS = "request_id int, term string, address string, zipcode string, city string, category string, country string, other int"


def test_batch_equals_single_searches(spark):
    rng = random.Random(3)
    notes = ["Wheelchair ramp", "ramp", "lift, RAMP", "stairs only", "Ünïcode dôor", "", "ramp" * 50]
    places = [
        (f"p{i}", rng.choice([None, [(rng.choice(notes),), (rng.choice(notes),)]]), rng.choice([None, ["Cafe", "Bar"], ["Museum"]]), "OPEN",
         rng.choice(["New York", "york", "Rome", None]), rng.choice(["US", "IT"]), f"{i % 9} Main St 1000{i % 4}", None, None,
         rng.choice([None, "none", f"{rng.randint(1, 5)}.{rng.randint(0, 9)} stars"]), f"u{i}")
        for i in range(300)
    ]
    asked = [
        (0, "ramp", None, None, None, None, "US", 1), (1, "RAMP", None, "10001", "york", "", None, 1),
        (2, "ünïcode DÔOR", "main", None, "NULL", "museum", None, 1), (3, "nowhere", None, None, None, None, None, 1),
        (4, "", None, None, "rome", None, "IT", 1), (5, None, None, None, None, None, None, 1), (6, "ram", None, None, None, "cafe", "US", 1),
        (7, "rampramp", None, None, None, None, None, 1), (8, "ramp", None, None, None, None, "US", 1),
    ]
    table, requests = spark.createDataFrame(places, PLACES).repartition(4), spark.createDataFrame(asked, REQUESTS)
    for most in (200_000, 3):  # one automaton, and blocks of terms
        got = {}
        for r in place_search_batch(table, requests, n=7, most_terms=most).orderBy("request_id", "rank").collect():
            got.setdefault(r["request_id"], []).append(r["place_url"])
        for rid, term, address, zipcode, city, category, country, _ in asked:
            want = []
            if term is not None:
                found = place_search(table, term, address, zipcode, city, category, country, n=7)
                want = [r["place_url"] for r in found.collect()]
            assert got.get(rid, []) == want, rid
    assert place_search_batch(table, requests.limit(0)).count() == 0
    assert place_search_batch(table.limit(0), requests).count() == 0


def test_many_requests_cost_one_scan(spark, plan_of, tmp_path):
    spark.createDataFrame([("p", [("ramp 77",)], None, "OPEN", "Rome", "IT", "x", None, None, "4", "u")], PLACES).write.parquet(f"{tmp_path}/p")
    many = spark.range(10_000).selectExpr(
        "cast(id as int) request_id", "concat('ramp ', id) term", "cast(null as string) address", "'' zipcode",
        "'' city", "'' category", "'IT' country")
    found = place_search_batch(spark.read.parquet(f"{tmp_path}/p"), many)
    plan = plan_of(found)
    assert sum("accessibility" in line for line in plan.splitlines() if "ReadSchema" in line) == 1
    assert "Cartesian" not in plan and "NestedLoop" not in plan
    assert sorted(r["request_id"] for r in found.collect()) == [7, 77]


def test_frequent_terms_do_not_meet_all_listings(spark, monkeypatch):
    """Requests that are done after the best listings are not asked of the others; rare ones go on to the end."""
    places = [(f"p{i}", [("ramp" if i else "lift",)], None, "OPEN", "Rome", "IT", "a", None, None, f"{i % 50}", f"u{i:04}") for i in range(600)]
    asked = [(i, "ramp", None, None, None, None, None, 1) for i in range(20)] + [(20, "lift", None, None, None, None, None, 1)]
    seen = []
    plain = requests_module._hits
    monkeypatch.setattr(requests_module, "_hits", lambda *a: seen.append(a[2]) or plain(*a))
    table, wanted = spark.createDataFrame(places, PLACES).repartition(3), spark.createDataFrame(asked, REQUESTS)
    got = place_search_batch(table, wanted, n=5).collect()
    assert seen == [21, 1, 1, 1]
    best = sorted(places[1:], key=lambda p: (-float(p[9]), p[10]))[:5]
    for rid in range(20):
        assert [r["place_url"] for r in sorted(got, key=lambda r: r["rank"]) if r["request_id"] == rid] == [p[10] for p in best]
    assert [(r["rank"], r["place_url"]) for r in got if r["request_id"] == 20] == [(1, "u0000")]
