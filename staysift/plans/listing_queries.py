"""Queries of the listing operators: filters, searches, curation, aggregates, functions."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from staysift.functions.predicates import (
    any_element,
    nested_match,
    optional_match_column,
    struct_match,
    text_match,
)
from staysift.functions.sqlfuncs import register_all
from staysift.functions.text import first_number, join_list
from staysift.operators.aggregates import clean_join, json_records, keys_with_more_than
from staysift.operators.curate import curated_listings
from staysift.operators.joins import join_on_unique, keep_ids
from staysift.operators.listings import (
    guarded_filter,
    hotel_search,
    keyword_any,
    multi_review_listings,
    place_rows,
    place_search,
    review_search,
)
from staysift.operators.ranking import latest_per_key, top_k_per_group, top_n
from staysift.operators.requests import place_search_batch
from staysift.operators.substring import build_substring_index, rows_that_may_contain
from staysift.plans.fixtures import CURATED_SQL, HOTELS_SQL, PLACES_SQL, hotels, places, stays
from staysift.plans.registry import query
from staysift.session import cut_lineage, scratch_path
from staysift.sources.tables import read_table, replace_path, replace_table



@query("projected_scan", "SELECT doc_id, lang, source FROM documents WHERE text IS NOT NULL")
def _(spark, folder):
    docs = read_table(spark, folder, "documents", "doc_id", "lang", "source", "text")
    return docs.where(F.col("text").isNotNull()).drop("text")


@query("full_scan_equality", "SELECT * FROM documents WHERE lang = 'fr'")
def _(spark, folder):
    return read_table(spark, folder, "documents").where(F.col("lang") == "fr")


@query(
    "threshold_and_lower_match",
    """SELECT p_name AS part_name, p_size * 2 AS double_size, * EXCLUDE (p_name) FROM part
       WHERE p_size > 25 AND lower(p_name) LIKE '%bolt%'""",
)
def _(spark, folder):
    parts = read_table(spark, folder, "part").where((F.col("p_size") > 25) & text_match("p_name", "BOLT"))
    renamed = parts.withColumnRenamed("p_name", "part_name")
    return renamed.select((F.col("p_size") * 2).alias("double_size"), "*")


PLACE_ORDER = "ORDER BY rating_numeric DESC NULLS LAST, place_url LIMIT 50"
PLACE_FACETS = dict(term="heon", country="EN")


@query("place_rows", f"WITH {PLACES_SQL} SELECT * FROM place_rows")
def _(spark, folder):
    return place_rows(places(spark, folder)).drop("accessibility_list")


def _place_check(filters: str) -> str:
    return f"""WITH {PLACES_SQL} SELECT * FROM place_rows
        WHERE country = 'EN' AND accessibility ILIKE '%heon%' {filters} {PLACE_ORDER}"""


def _places(spark, folder, **facets):
    return place_search(places(spark, folder), **PLACE_FACETS, **facets).drop("accessibility_list")


@query("place_search", _place_check("AND city ILIKE '%example%' AND business_category ILIKE '%sch%'"))
def _(spark, folder):
    return _places(spark, folder, city="EXAMPLE", category="Sch")


@query("place_search_address_zip", _place_check("AND address ILIKE '%/en/%' AND address ILIKE '%5%'"))
def _(spark, folder):
    return _places(spark, folder, city=None, address="/EN/", zipcode="5")


@query("optional_filters_null", _place_check(""))
def _(spark, folder):
    return _places(spark, folder, city=None, address=None, category=None)


@query("optional_filters_empty", _place_check("AND city ILIKE '%blog%'"))
def _(spark, folder):
    return _places(spark, folder, city="blog", address="", category="")


@query("optional_filters_literal_null", _place_check("AND business_category ILIKE '%für%'"))
def _(spark, folder):
    return _places(spark, folder, city="NULL", address="NULL", category="für")


@query(
    "optional_filter_by_column",
    """WITH asked AS (
         SELECT d.doc_id, d.lang,
                CASE WHEN l.toxic = 1 THEN 'NULL' WHEN l.quality = 1 THEN 'EN' WHEN d.lang = 'de' THEN ''
                     WHEN d.lang = 'fr' THEN 'x' END AS wanted
         FROM documents d JOIN labels l ON d.doc_id = l.doc_id)
       SELECT doc_id, lang FROM asked
       WHERE wanted IS NULL OR wanted IN ('', 'NULL') OR lang ILIKE '%' || wanted || '%'""",
)
def _(spark, folder):
    wanted = (
        F.when(F.col("toxic") == 1, "NULL")
        .when(F.col("quality") == 1, "EN")
        .when(F.col("lang") == "de", "")
        .when(F.col("lang") == "fr", "x")
    )
    labels = read_table(spark, folder, "labels")
    docs = read_table(spark, folder, "documents", "doc_id", "lang")
    asked = join_on_unique(docs, labels, "doc_id", spread_by="lang").withColumn("wanted", wanted)
    return asked.where(optional_match_column("lang", "wanted")).select("doc_id", "lang")


@query("suffix_match", "SELECT p_partkey, p_name FROM part WHERE p_name ILIKE '%RING'")
def _(spark, folder):
    parts = read_table(spark, folder, "part", "p_partkey", "p_name")
    return parts.where(text_match("p_name", "RING", mode="suffix"))


@query("prefix_match", "SELECT p_partkey, p_name FROM part WHERE p_name ILIKE 'Red%'")
def _(spark, folder):
    parts = read_table(spark, folder, "part", "p_partkey", "p_name")
    return parts.where(text_match("p_name", "Red", mode="prefix"))


@query("wildcard_match", "SELECT p_partkey, p_name FROM part WHERE p_name ILIKE '%R_d%G%'")
def _(spark, folder):
    parts = read_table(spark, folder, "part", "p_partkey", "p_name")
    return parts.where(text_match("p_name", "R_d%G", raw_pattern=True))


HOTEL_HIT = """(description ILIKE '%heon%' OR fine_print ILIKE '%heon%' OR property_highlights ILIKE '%heon%'
    OR array_to_string(reviews, ', ') ILIKE '%heon%' OR array_to_string(rules, ', ') ILIKE '%heon%')"""


@query(
    "hotel_search",
    f"""WITH {HOTELS_SQL} SELECT hotel_id, city, review_score, description, fine_print
        FROM hotels WHERE city ILIKE '%EN%' AND {HOTEL_HIT}
        ORDER BY review_score DESC NULLS LAST, hotel_id""",
)
def _(spark, folder):
    found = hotel_search(hotels(spark, folder), term="heon", city="EN")
    return found.select("hotel_id", "city", "review_score", "description", "fine_print")


@query(
    "hotel_search_suffix_mode",
    f"""WITH {HOTELS_SQL} SELECT hotel_id, review_score FROM hotels
        WHERE description ILIKE '%src7%' OR fine_print ILIKE '%src7%' OR property_highlights ILIKE '%src7'
        OR array_to_string(reviews, ', ') ILIKE '%src7%' OR array_to_string(rules, ', ') ILIKE '%src7%'
        ORDER BY review_score DESC NULLS LAST, hotel_id""",
)
def _(spark, folder):
    modes = {"property_highlights": "suffix"}
    found = hotel_search(hotels(spark, folder), term="src7", city=None, modes=modes)
    return found.select("hotel_id", "review_score")


@query(
    "keyword_any_columns",
    f"""WITH {HOTELS_SQL} SELECT hotel_id, description, fine_print, property_highlights FROM hotels
        WHERE location ILIKE '%src1%' AND {HOTEL_HIT} ORDER BY hotel_id LIMIT 10""",
)
def _(spark, folder):
    found = keyword_any(hotels(spark, folder), term="heon", location="src1")
    return found.select("hotel_id", "description", "fine_print", "property_highlights")


REQUESTS_SQL = """requests AS (
  SELECT doc_id AS request_id, string_split(text, ' ')[2] AS term,
         CASE WHEN doc_id % 3 = 0 THEN 'EXAMPLE' WHEN doc_id % 3 = 1 THEN 'NULL' END AS city,
         CASE WHEN doc_id % 4 = 0 THEN 'sch' ELSE '' END AS category,
         CASE WHEN doc_id % 5 > 0 THEN upper(lang) END AS country,
         CASE WHEN doc_id % 7 = 0 THEN '5' END AS zipcode
  FROM documents)"""


@query(
    "place_search_batch",
    f"""WITH {PLACES_SQL}, {REQUESTS_SQL}
        SELECT request_id, place_url, rating_numeric, rank FROM (
          SELECT request_id, place_url, rating_numeric, CAST(row_number() OVER (
                   PARTITION BY request_id ORDER BY rating_numeric DESC NULLS LAST, place_url) AS INTEGER) AS rank
          FROM requests r JOIN place_rows p ON contains(lower(accessibility), lower(term))
          WHERE (r.country IS NULL OR p.country = r.country)
            AND (coalesce(r.city, '') IN ('', 'NULL') OR contains(lower(p.city), lower(r.city)))
            AND (r.category = '' OR contains(lower(business_category), r.category))
            AND (r.zipcode IS NULL OR contains(address, r.zipcode)))
        WHERE rank <= 50""",
)
def _(spark, folder):
    """A request for every document: its second word, with changing facets."""
    key = F.col("doc_id")
    requests = read_table(spark, folder, "documents", "doc_id", "text", "lang").select(
        key.alias("request_id"),
        F.get(F.split("text", " "), 1).alias("term"),
        F.lit(None).cast("string").alias("address"),
        F.when(key % 7 == 0, "5").alias("zipcode"),
        F.when(key % 3 == 0, "EXAMPLE").when(key % 3 == 1, "NULL").alias("city"),
        F.when(key % 4 == 0, "sch").otherwise("").alias("category"),
        F.when(key % 5 > 0, F.upper("lang")).alias("country"),
    )
    found = place_search_batch(places(spark, folder), requests)
    return found.select("request_id", "place_url", "rating_numeric", "rank")


def _hotel_index(spark, folder, nested, block_rows=256):
    """Hotels with the texts that a search reads, nested columns in the form it searches."""
    texts = [F.col(c) for c in ("description", "fine_print", "property_highlights")]
    path = scratch_path(spark, "substrings")
    return build_substring_index(
        hotels(spark, folder), path, [*texts, *nested], ["location", "hotel_id"], block_rows
    )


@query(
    "keyword_any_indexed",
    f"""WITH {HOTELS_SQL} SELECT hotel_id, description, fine_print, property_highlights FROM hotels
        WHERE location ILIKE '%src1%' AND (description ILIKE '%eauvi%' OR fine_print ILIKE '%eauvi%'
          OR property_highlights ILIKE '%eauvi%' OR array_to_string(reviews, ', ') ILIKE '%eauvi%'
          OR array_to_string(rules, ', ') ILIKE '%eauvi%') ORDER BY hotel_id LIMIT 10""",
)
def _(spark, folder):
    index = _hotel_index(spark, folder, [F.to_json("top_reviews"), F.to_json("house_rules")])
    found = keyword_any(rows_that_may_contain(index, "eauvi"), term="eauvi", location="src1")
    return found.select("hotel_id", "description", "fine_print", "property_highlights")


@query(
    "hotel_search_indexed",
    f"""WITH {HOTELS_SQL} SELECT hotel_id, city, review_score, description, fine_print
        FROM hotels WHERE city ILIKE '%EN%' AND {HOTEL_HIT}
        ORDER BY review_score DESC NULLS LAST, hotel_id""",
)
def _(spark, folder):
    joined = [F.concat_ws(", ", F.col(c)[f]) for c, f in (("top_reviews", "review"), ("house_rules", "description"))]
    index = _hotel_index(spark, folder, joined)
    found = hotel_search(rows_that_may_contain(index, "heon"), term="heon", city="EN")
    return found.select("hotel_id", "city", "review_score", "description", "fine_print")


@query("place_search_indexed", _place_check("AND city ILIKE '%example%' AND business_category ILIKE '%sch%'"))
def _(spark, folder):
    notes = join_list(F.col("accessibility")["description"], ", ")
    path = scratch_path(spark, "substrings")
    index = build_substring_index(places(spark, folder), path, [notes], ["country", "place_url"], 256)
    found = place_search(rows_that_may_contain(index, "heon"), city="EXAMPLE", category="Sch", **PLACE_FACETS)
    return found.drop("accessibility_list")


@query(
    "review_search",
    """SELECT doc_id // 10 AS property_id, doc_id, n_chars FROM documents
       WHERE n_chars > 1000 AND source || ', ' || lang ILIKE '%EN%' AND text ILIKE '%whou%'
       ORDER BY property_id, doc_id LIMIT 5""",
)
def _(spark, folder):
    listed = stays(spark, folder).withColumn("n_chars", F.col("host_number_of_reviews"))
    found = review_search(listed, "whou", location="EN", key="doc_id")
    return found.select("property_id", "doc_id", "n_chars")


@query(
    "review_spellings",
    """SELECT doc_id FROM documents
       WHERE len(list_filter(string_split(text, chr(10)),
                             lambda x: x ILIKE '%eauvi%' OR x ILIKE '%DOUBLE%')) > 0""",
)
def _(spark, folder):
    return stays(spark, folder).where(any_element("reviews", ["eauvi", "DOUBLE"])).select("doc_id")


@query(
    "nested_field_search",
    f"WITH {HOTELS_SQL} SELECT hotel_id FROM hotels WHERE array_to_string(rules, ', ') ILIKE '%whou%'",
)
def _(spark, folder):
    return hotels(spark, folder).where(nested_match("house_rules", "description", "whou")).select("hotel_id")


@query(
    "nested_field_search_joined",
    f"WITH {HOTELS_SQL} SELECT hotel_id FROM hotels WHERE array_to_string(reviews, ', ') ILIKE '%., the %'",
)
def _(spark, folder):
    return hotels(spark, folder).where(nested_match("top_reviews", "review", "., the ")).select("hotel_id")


@query(
    "json_struct_search",
    f"""WITH {HOTELS_SQL} SELECT hotel_id FROM hotels
        WHERE lower(to_json(list_transform(reviews, lambda x, i: {{'turn': i - 1, 'review': x}})))
              LIKE '%"turn":7%'""",
)
def _(spark, folder):
    return hotels(spark, folder).where(struct_match("top_reviews", '"turn":7')).select("hotel_id")


@query(
    "latest_per_key",
    """SELECT user_id, event_id, ts, event_type, value, props FROM (
         SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) AS r
         FROM events WHERE user_id IS NOT NULL) WHERE r = 1""",
)
def _(spark, folder):
    events = read_table(spark, folder, "events")
    found = latest_per_key(events, "user_id", [F.desc("ts"), F.desc("event_id")])
    return found.select("user_id", "event_id", "ts", "event_type", "value", "props")


@query("curated_listings", f"WITH {CURATED_SQL} SELECT * FROM curated")
def _(spark, folder):
    return curated_listings(stays(spark, folder), tie="doc_id")


@query(
    "curated_table",
    f"WITH {CURATED_SQL} SELECT category, count(*) AS n, sum(price) AS price FROM curated GROUP BY category",
)
def _(spark, folder):
    table = replace_path(
        curated_listings(stays(spark, folder), tie="doc_id"), scratch_path(spark, "curated")
    )
    return table.groupBy("category").agg(F.count("*").alias("n"), F.sum("price").alias("price"))


@query(
    "reviewed_keys",
    "SELECT o_custkey FROM orders GROUP BY o_custkey HAVING count(o_totalprice) > 10",
)
def _(spark, folder):
    return keys_with_more_than(read_table(spark, folder, "orders"), "o_custkey", "o_totalprice", 10)


@query(
    "multi_review_keys",
    """SELECT o_custkey, o_orderkey, o_orderstatus, o_totalprice FROM orders
       WHERE o_custkey IN (SELECT o_custkey FROM orders GROUP BY o_custkey HAVING count(o_totalprice) > 10)
       ORDER BY o_custkey, o_orderkey""",
)
def _(spark, folder):
    orders = read_table(spark, folder, "orders", "o_custkey", "o_orderkey", "o_orderstatus", "o_totalprice")
    return multi_review_listings(
        orders, orders, key="o_custkey", counted="o_totalprice", more_than=10, tie="o_orderkey"
    )


@query(
    "join_on_key",
    """SELECT o.o_custkey, o.o_orderkey, c.c_name, c.c_mktsegment
       FROM orders o JOIN customer c ON o.o_custkey = c.c_custkey""",
)
def _(spark, folder):
    orders = read_table(spark, folder, "orders", "o_custkey", "o_orderkey")
    customers = read_table(spark, folder, "customer", "c_custkey", "c_name", "c_mktsegment")
    return join_on_unique(
        orders, customers.withColumnRenamed("c_custkey", "o_custkey"), "o_custkey", spread_by="o_orderkey"
    )


RATING_SQL = """rated AS (
  SELECT c_custkey AS id,
         CASE WHEN c_mktsegment = 'HOUSEHOLD' THEN 'n/a' ELSE c_acctbal::VARCHAR || ' points' END AS rating
  FROM customer),
parsed AS (
  SELECT id, rating,
         try_cast(regexp_extract(rating, '([0-9]+\\.?[0-9]*)', 1) AS FLOAT) AS rating_numeric
  FROM rated)"""


def _ratings(spark, folder):
    rating = F.when(F.col("c_mktsegment") == "HOUSEHOLD", "n/a").otherwise(
        F.concat(F.col("c_acctbal").cast("string"), F.lit(" points"))
    )
    rated = read_table(spark, folder, "customer").select(F.col("c_custkey").alias("id"), rating.alias("rating"))
    return rated.withColumn("rating_numeric", first_number("rating"))


@query("rating_parse", f"WITH {RATING_SQL} SELECT * FROM parsed")
def _(spark, folder):
    return _ratings(spark, folder)


@query(
    "rating_parse_topk",
    f"WITH {RATING_SQL} SELECT * FROM parsed ORDER BY rating_numeric DESC NULLS LAST, id LIMIT 50",
)
def _(spark, folder):
    return top_n(_ratings(spark, folder), 50, F.desc_nulls_last("rating_numeric"), F.asc("id"))


@query(
    "id_list_filter",
    """SELECT doc_id, source, lang FROM documents
       WHERE doc_id IN (SELECT doc_id FROM labels WHERE quality = 1)""",
)
def _(spark, folder):
    good = read_table(spark, folder, "labels").where("quality = 1")
    return keep_ids(read_table(spark, folder, "documents", "doc_id", "source", "lang"), "doc_id", good)


@query(
    "guarded_filter",
    """SELECT p_partkey FROM part WHERE p_size > 10 AND (p_name ILIKE '%ring%' OR p_type = 'ECONOMY')
       ORDER BY p_partkey LIMIT 50""",
)
def _(spark, folder):
    wanted = "p_size > 10 AND (p_name ILIKE '%ring%' OR p_type = 'ECONOMY')"
    return guarded_filter(read_table(spark, folder, "part"), wanted, key="p_partkey")


@query(
    "top_2000_orders",
    """SELECT o_orderkey, o_totalprice FROM orders ORDER BY o_totalprice DESC, o_orderkey LIMIT 2000""",
)
def _(spark, folder):
    orders = read_table(spark, folder, "orders", "o_orderkey", "o_totalprice")
    return top_n(orders, 2000, F.desc("o_totalprice"), F.asc("o_orderkey"))


@query(
    "top_1200_per_priority",
    """SELECT * FROM (
         SELECT o_orderpriority, o_orderkey, CAST(row_number() OVER (
           PARTITION BY o_orderpriority ORDER BY o_totalprice DESC, o_orderkey) AS INTEGER) AS rank FROM orders)
       WHERE rank <= 1200""",
)
def _(spark, folder):
    orders = read_table(spark, folder, "orders", "o_orderkey", "o_orderpriority", "o_totalprice")
    order = [F.desc("o_totalprice"), F.asc("o_orderkey")]
    return top_k_per_group(orders, "o_orderpriority", order, 1200).drop("o_totalprice")


@query("replaced_catalog_table", "SELECT o_custkey, count(*) AS n, sum(o_totalprice::DECIMAL(20,2))::DOUBLE AS total FROM orders GROUP BY o_custkey")
def _(spark, folder):
    """A bucketed table in the catalog, replaced once, then grouped by its bucket key in place."""
    orders = read_table(spark, folder, "orders", "o_custkey", "o_orderkey", "o_totalprice")
    name = f"orders_by_customer_{uuid.uuid4().hex}"
    replace_table(orders.drop("o_totalprice"), name, "o_custkey", 8)
    table = replace_table(orders, name, "o_custkey", 8)
    total = F.sum(F.col("o_totalprice").cast("decimal(20,2)")).cast("double").alias("total")
    return table.groupBy("o_custkey").agg(F.count("*").alias("n"), total)


@query(
    "clean_join",
    """WITH ranked AS (
         SELECT *, row_number() OVER (PARTITION BY p_brand ORDER BY p_retailprice DESC, p_partkey) AS r FROM part),
       cells AS (
         SELECT p_brand, r, unnest([p_name || ' ' || p_size::VARCHAR, p_type, p_size::VARCHAR]) AS v,
                unnest([1, 2, 3]) AS c
         FROM ranked)
       SELECT p_brand, CAST((r - 1) // 50 AS INTEGER) AS page_no,
              string_agg(trim(regexp_replace(v, '\\b\\d+\\b', '', 'g')), ', ' ORDER BY r, c) AS joined
       FROM cells WHERE v <> '' GROUP BY ALL""",
)
def _(spark, folder):
    parts = read_table(spark, folder, "part").withColumn("label", F.concat_ws(" ", "p_name", "p_size"))
    order = [F.desc("p_retailprice"), F.asc("p_partkey")]
    return clean_join(parts, "p_brand", order, ["label", "p_type", "p_size"], page_rows=50)


@query(
    "json_records",
    """SELECT o_custkey, CAST((r - 1) // 10 AS INTEGER) AS page_no, to_json(list({'o_orderkey': o_orderkey, 'o_orderstatus': o_orderstatus,
                                       'o_orderpriority': o_orderpriority} ORDER BY r))::VARCHAR AS records
       FROM (SELECT *, row_number() OVER (PARTITION BY o_custkey ORDER BY o_totalprice DESC, o_orderkey) AS r
             FROM orders)
       GROUP BY ALL""",
)
def _(spark, folder):
    order = [F.desc("o_totalprice"), F.asc("o_orderkey")]
    columns = ["o_orderkey", "o_orderstatus", "o_orderpriority"]
    return json_records(read_table(spark, folder, "orders"), "o_custkey", order, columns, page_rows=10)


@query(
    "sql_place_search",
    f"""WITH {PLACES_SQL} SELECT * REPLACE ('US' AS country) FROM place_rows
        WHERE accessibility ILIKE '%heon%' AND city ILIKE '%example%' AND business_category ILIKE '%sch%'
        {PLACE_ORDER}""",
)
def _(spark, folder):
    listed = places(spark, folder).withColumn("country", F.lit("US"))
    register_all(spark, {"place_search": listed})
    return spark.sql(
        "SELECT * FROM place_search(business_category => 'SCH', city => 'example', term => 'heon')"
    )


@query(
    "sql_hotel_search",
    f"""WITH {HOTELS_SQL} SELECT hotel_id, review_score, description FROM hotels
        WHERE city ILIKE '%en%' AND {HOTEL_HIT}""",
)
def _(spark, folder):
    register_all(spark, {"hotel_search": hotels(spark, folder)})
    return spark.sql(
        "SELECT hotel_id, review_score, description FROM hotel_search('en', term => 'HEON')"
        " ORDER BY review_score DESC NULLS LAST, hotel_id"
    )


@query(
    "lateral_city_listings",
    f"""WITH {HOTELS_SQL}, wanted AS (SELECT DISTINCT d.lang FROM documents d JOIN labels l USING (doc_id)
                                       WHERE l.toxic = 1)
        SELECT w.lang, h.hotel_id, h.review_score FROM wanted w JOIN hotels h ON h.city = w.lang""",
)
def _(spark, folder):
    register_all(spark, {"city_listings": hotels(spark, folder)})
    toxic = read_table(spark, folder, "labels").where("toxic = 1")
    docs = read_table(spark, folder, "documents", "doc_id", "lang")
    # Written out, so that Spark knows how small the calling side is and broadcasts it.
    wanted = cut_lineage(keep_ids(docs, "doc_id", toxic).select("lang").distinct())
    wanted.createOrReplaceTempView("wanted_cities")
    return spark.sql("SELECT w.lang, c.* FROM wanted_cities w, LATERAL city_listings(city => w.lang) c")
