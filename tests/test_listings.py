from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from staysift.functions.sqlfuncs import register_all
from staysift.operators import listings
from staysift.operators.aggregates import clean_join, json_records, keys_with_more_than, top_json_records
from staysift.operators.curate import COLUMNS, LISTS, NESTED, RENAMED, curated_listings
from staysift.operators.ranking import latest_per_key

PLACE = (
    "title string, accessibility array<struct<description string>>, business_category array<string>,"
    " business_status string, city string, country string, address string, phone_number string,"
    " place_information string, rating string, place_url string"
)


def place(title, notes, rating="4 stars", city="New York", country="US", categories=("restaurant",), address="1 A St, NY 10012"):
    notes = None if notes is None else [(n,) for n in notes]
    return (title, notes, list(categories), "OPEN", city, country, address, "1", "info", rating, f"u/{title}")


@pytest.fixture(scope="module")
def places(spark):
    rows = [
        place("a", ["Wheelchair ramp", "lift"], "4.5 (20)"),
        place("b", ["wheelchair seat"], "no rating"),
        place("c", ["stairs"], "5"),
        place("d", ["WHEELCHAIR"], "4.5", categories=("Fast Restaurant", "bar")),
        place("e", ["wheelchair"], "4.9", city="Boston"),
        place("f", ["wheelchair"], "4.8", country="CA"),
        place("g", None, "4.9"),
        place("h", ["wheelchair"], "3", categories=("museum",), address="9 B St, NY 10001"),
    ]
    return spark.createDataFrame(rows, PLACE)


def names(df):
    return [r.business_name for r in df.collect()]


def test_place_search_orders_and_filters(places):
    assert names(listings.place_search(places)) == ["a", "d", "h", "b"]
    assert names(listings.place_search(places, n=2)) == ["a", "d"]
    assert names(listings.place_search(places, category="RESTAURANT")) == ["a", "d", "b"]
    assert names(listings.place_search(places, zipcode="10001")) == ["h"]
    assert names(listings.place_search(places, city=None)) == ["e", "a", "d", "h", "b"]
    assert names(listings.place_search(places, city="NULL", country=None)) == ["e", "f", "a", "d", "h", "b"]
    assert names(listings.place_search(places, term="lift")) == ["a"]
    assert names(listings.place_search(places, term="ramp, LIFT")) == ["a"]


def test_place_search_columns(places):
    out = listings.place_search(places)
    assert len(out.columns) == 13
    first = out.first()
    assert (first.accessibility, first.accessibility_list) == ("Wheelchair ramp, lift", ["Wheelchair ramp", "lift"])


def test_place_function_in_sql(spark, places):
    register_all(spark, {"place_search": places})
    run = lambda call: names(spark.sql(f"SELECT * FROM {call}"))
    assert run("place_search()") == ["a", "d", "h", "b"]
    assert run("place_search(business_category => 'restaurant')") == ["a", "d", "b"]
    assert run("place_search(city => 'NULL', zipcode => '')") == ["e", "a", "d", "h", "b"]
    assert run("place_search(address => '9 b', term => 'wheel')") == ["h"]
    assert run("place_search(address => '%')") == []


HOTEL = (
    "hotel_id long, description string, fine_print string, property_highlights string,"
    " top_reviews array<struct<review string, stars int>>, house_rules array<struct<description string>>,"
    " review_score double, city string, location string"
)


@pytest.fixture(scope="module")
def hotels(spark):
    rows = [
        (1, "Wheelchair ok", None, None, None, None, 7.0, "New York", "NY"),
        (2, None, "no wheelchair", None, None, None, 9.0, "New York", "NY"),
        (3, "x", "x", "wheelchair access", [], [], 8.0, "New York", "NY"),
        (4, "x", "x", "for wheelchair", [], [], 8.5, "New York", "NY"),
        (5, "x", "x", "x", [("fine for Wheelchair", 5), (None, 1)], [], 8.0, "New York City", "NY"),
        (6, "x", "x", "x", [], [("wheelchair rule",)], None, "new york", "NY"),
        (7, "x", "x", "x", [("stars", 5)], [("none",)], 9.9, "New York", "NY"),
        (8, "wheelchair", "x", "x", [], [], 9.9, "Boston", "Boston"),
    ]
    return spark.createDataFrame(rows, HOTEL)


def test_hotel_search(hotels):
    ids = lambda df: [r.hotel_id for r in df.collect()]
    assert ids(listings.hotel_search(hotels)) == [2, 4, 3, 5, 1, 6]
    suffix = listings.hotel_search(hotels, modes={"property_highlights": "suffix"})
    assert ids(suffix) == [2, 4, 5, 1, 6]
    assert ids(listings.hotel_search(hotels, city=None))[0] == 8
    assert {"hotel_id", "review_score"} <= set(listings.hotel_search(hotels).columns)


def test_hotel_function_in_sql(spark, hotels):
    register_all(spark, {"hotel_search": hotels, "city_listings": hotels})
    run = lambda q: sorted(r.hotel_id for r in spark.sql(q).collect())
    assert run("SELECT * FROM hotel_search()") == [1, 2, 3, 4, 5, 6]
    assert run("SELECT * FROM hotel_search(city => 'boston')") == [8]
    lateral = "SELECT c.hotel_id FROM VALUES ('Boston'), ('new york') AS w(city), LATERAL city_listings(w.city) c"
    assert run(lateral) == [6, 8]


def test_keyword_any(hotels):
    ids = lambda df: [r.hotel_id for r in df.collect()]
    assert ids(listings.keyword_any(hotels)) == [1, 2, 3, 4, 5, 6, 8]
    assert ids(listings.keyword_any(hotels, n=2)) == [1, 2]
    assert ids(listings.keyword_any(hotels, location="bost")) == [8]
    assert ids(listings.keyword_any(hotels, term="stars", text_cols=[])) == [5, 7]


def test_review_search(spark):
    rows = [
        (1, "New York", 1001, ["x", "wheelchair"]),
        (2, "New York", 1000, ["wheelchair"]),
        (3, "new york", 5000, ["wheel chair"]),
        (4, "Boston", 5000, ["wheelchair", None]),
        (5, "New York", 5000, [None]),
    ]
    df = spark.createDataFrame(rows, "property_id long, location string, host_number_of_reviews long, reviews array<string>")
    ids = lambda d: [r.property_id for r in d.collect()]
    assert ids(listings.review_search(df, location="NEW YORK")) == [1]
    assert ids(listings.review_search(df, ["wheelchair", "wheel chair"])) == [1, 3, 4]
    assert ids(listings.review_search(df, min_reviews=0, n=1)) == [1]
    assert ids(listings.review_search(df, min_reviews=0, n=1, any_rows=True))[0] in (1, 2, 4)


def test_multi_review_listings(spark):
    rows = spark.createDataFrame(
        [(1, "r"), (1, None), (2, "r"), (2, "s"), (None, "a"), (None, "b"), (3, None), (3, None)],
        "property_id long, reviews string",
    )
    details = spark.createDataFrame(
        [(2, "u2"), (2, "u1"), (1, "u"), (3, "u"), (None, "u")], "property_id long, url string"
    )
    assert [r.property_id for r in keys_with_more_than(rows, "property_id", "reviews", 1).orderBy("property_id").collect()] == [None, 2]
    for hot_rows in (1, 10**9):
        out = listings.multi_review_listings(rows, details, hot_rows=hot_rows)
        assert [(r.property_id, r.url) for r in out.collect()] == [(2, "u1"), (2, "u2")]


def test_guarded_filter(spark):
    df = spark.range(100).select(F.col("id").alias("property_id"), (F.col("id") % 7).alias("rating"))
    assert [r[0] for r in listings.guarded_filter(df, "rating >= 6", n=3).collect()] == [6, 13, 20]
    assert listings.guarded_filter(df, "rating >= 0").columns == ["property_id"]
    assert listings.guarded_filter(df, "rating >= 0").count() == 50
    listings.guarded_filter(df, "concat('select ', rating) = 'select 3'").collect()
    names = df.withColumnsRenamed({"rating": "from"})
    assert listings.guarded_filter(names, "(from > 5) and `from` in (6, 7)").count() == 14
    arrays = df.withColumn("marks", F.array("rating"))
    assert listings.guarded_filter(arrays, "exists(marks, x -> x = 3) OR lower('A') = 'b'").count() == 14
    for bad in (
        "rating > 10 /* ' */ or exists (select 1 from other) /* ' */",
        "rating > 10 -- ' \n or exists (select 1 from other) -- '",
        "reflect('java.lang.System', 'getProperty', 'user.home') is not null",
        "java_method('java.lang.System', 'getProperty', 'user.home') is not null",
        "`reflect`('java.lang.System', 'getProperty', 'user.home') is not null",
        "exists (select * from other)",
        "rating in (with a as (select 1) select * from a)",
    ):
        with pytest.raises(ValueError):
            listings.guarded_filter(df, bad)
    for bad in ("property_id IN (SELECT 1)", "exists(select 1)", "1 = 1) UNION (SELECT 1", "count(1) > 0", "DROP TABLE x"):
        with pytest.raises(Exception):
            listings.guarded_filter(df, bad).collect()


def test_guard_reads_the_parsed_predicate(spark):
    df = spark.range(20).select(F.col("id").alias("property_id"), (F.col("id") % 7).alias("rating"))
    spark.createDataFrame([(2, False)], "id int, flag boolean").createOrReplaceTempView("secret")
    odd = df.withColumnsRenamed({"rating": "select"}).withColumn("table", F.array("property_id"))
    for good in ("select = 3", "(select) > 2 and select <= 3", "`select` in (3)", "select <=> 3", "size(table) = 1 and select = 3",
                 "case when select = 3 then true else false end", "select between 3 and 3", "cast(select as int) - 3 = 0",
                 "forall(table, x -> x % 7 = 3)", "table[0] % 7 = 3", "not select <> 3", "'--' <> '/*' and select = 3"):
        assert [r[0] for r in listings.guarded_filter(odd, good).collect()] == [3, 10, 17], good
    for bad in (
        "exists (select !flag from secret where id = 2)",
        "exists (select =1 from secret)",
        "exists (from secret)",
        "exists (table secret)",
        "rating = (select max(id) from secret)",
        "rating in (select id from secret)",
        "rating in (values 1, 2)",
        "exists(select <> 1 from secret)",
        "('a')(1)",
        "array(1)[0](1)",
        "rank() over (order by rating) > 1",
        "count(*) > 1",
        "struct(*) is not null",
        "current_user = 'root'",
        "other > 1",
        "system.builtin.reflect('java.lang.System', 'getProperty', 'user.home') = 'x'",
        "identifier('reflect')('a') = 1",
        "assert_true(rating > 1) is null",
        ":name = 1",
    ):
        with pytest.raises(ValueError):
            listings.guarded_filter(df, bad)


def test_latest_per_key(spark):
    df = spark.createDataFrame(
        [(1, "a", 1), (1, "b", 2), (1, "b", 3), (2, None, 4), (None, "z", 5)], "k int, url string, t int"
    )
    out = latest_per_key(df, "k", [F.desc_nulls_last("url"), F.desc("t")]).orderBy("k").collect()
    assert [(r.k, r.url, r.t) for r in out] == [(1, "b", 3), (2, None, 4)]


def _stays(spark):
    types = {c: "string" for c in COLUMNS}
    types.update({c: "array<string>" for c in LISTS})
    types.update({c: "array<struct<n int, name string>>" for c in NESTED})
    types["property_id"] = "long"
    schema = ", ".join(f"`{c}` {t}" for c, t in {**types, "url": "string"}.items())
    def row(key, url, full):
        out = []
        for c in COLUMNS:
            if c == "property_id":
                out.append(key)
            elif c in LISTS:
                out.append(["x", None, url] if full else None)
            elif c in NESTED:
                out.append([(1, url)] if full else None)
            else:
                out.append(f"{c}-{url}")
        return (*out, url)
    return spark.createDataFrame([row(1, "a", True), row(1, "b", True), row(2, "c", False), row(None, "d", True)], schema)


def test_curated_listings(spark):
    out = curated_listings(_stays(spark), keep_lists=True)
    assert out.columns == [RENAMED.get(c, c) for c in COLUMNS] + ["reviews_list"]
    assert len(COLUMNS) == 36
    one, two = out.orderBy("property_id").collect()
    assert (one.reviews, one.amenities, one.reviews_list) == ("x\nb", "[{1, b}]", ["x", None, "b"])
    assert (two.reviews, two.amenities, two.listing_description) == ("", "", "description-c")
    as_json = curated_listings(_stays(spark), as_json=True).orderBy("property_id").first()
    assert as_json.amenities == '[{"n":1,"name":"b"}]'


def test_json_records_and_clean_join(spark):
    df = spark.createDataFrame(
        [("g", 2, "b 12", ""), ("g", 1, "a7", None), ("g", 3, "drop", "drop"), ("h", 1, " 5 ", "x")],
        "g string, n int, s string, t string",
    )
    first = {"g": '[{"n":1,"s":"a7"},{"n":2,"s":"b 12"}]', "h": '[{"n":1,"s":" 5 "}]'}
    out = {(r.g, r.page_no): r.records for r in json_records(df, "g", [F.asc("n")], ["n", "s"], 2).collect()}
    assert out == {("g", 0): first["g"], ("g", 1): '[{"n":3,"s":"drop"}]', ("h", 0): first["h"]}
    assert {r.g: r.records for r in top_json_records(df, "g", [F.asc("n")], ["n", "s"], 2).collect()} == first
    joined = {(r.g, r.page_no): r.joined for r in clean_join(df, "g", [F.asc("n")], ["s", "t"], 2).collect()}
    assert joined == {("g", 0): "a7, b", ("g", 1): "drop, drop", ("h", 0): ", x"}
    kept = clean_join(df, "g", [F.asc("n")], ["s", "n"], 2, keep_numbers=True).collect()
    assert {(r.g, r.page_no): r.joined for r in kept} == {
        ("g", 0): "a7, 1, b 12, 2", ("g", 1): "drop, 3", ("h", 0): "5, 1"
    }
