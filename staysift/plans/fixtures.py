"""Listing frames with nested columns, derived row by row from the given tables.

Nested columns come from splitting a text of the same row, so no rows are gathered into a group
and the work grows with the table alone. Each frame has the SQL of the same rows next to it.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from staysift.sources.tables import read_table

# Where the parts of a page are found.
HTML_TITLE = "<title>([^<]*)</title>"
HTML_HEAD = "<h1>([^<]*)</h1>"
HTML_TEXT = "<p>([^<]+)</p>"
HTML_LINK = '<a href="[^"]*">([^<]*)</a>'
HTML_LANG = '<html lang="([a-z]*)"'
URL_PATH = "^https?://[^/]*(/.*)$"


def _structs(texts: Column, field: str, number: str | None = None) -> Column:
    if number is None:
        return F.transform(texts, lambda x: F.struct(x.alias(field)))
    return F.transform(texts, lambda x, i: F.struct(i.alias(number), x.alias(field)))


def places(spark: SparkSession, folder: str) -> DataFrame:
    """Pages as places: paragraphs are accessibility notes, links are categories."""
    pages = read_table(spark, folder, "pages", spread_by="page_id")
    path = F.regexp_extract("url", URL_PATH, 1)
    return pages.select(
        F.regexp_extract("html", HTML_TITLE, 1).alias("title"),
        _structs(F.regexp_extract_all("html", F.lit(HTML_TEXT), F.lit(1)), "description").alias(
            "accessibility"
        ),
        F.regexp_extract_all("html", F.lit(HTML_LINK), F.lit(1)).alias("business_category"),
        F.lit("OPEN").alias("business_status"),
        F.split_part("url", F.lit("/"), F.lit(3)).alias("city"),
        F.upper(F.regexp_extract("html", HTML_LANG, 1)).alias("country"),
        path.alias("address"),
        F.col("page_id").cast("string").alias("phone_number"),
        F.regexp_extract("html", HTML_HEAD, 1).alias("place_information"),
        F.concat(path, F.lit(" stars")).alias("rating"),
        F.concat("url", F.lit("#"), F.col("page_id").cast("string")).alias("place_url"),
    )


PLACES_SQL = f"""places AS (
  SELECT regexp_extract(html, '{HTML_TITLE}', 1) AS title,
         regexp_extract_all(html, '{HTML_TEXT}', 1) AS accessibility_list,
         regexp_extract_all(html, '{HTML_LINK}', 1) AS categories,
         'OPEN' AS business_status,
         split_part(url, '/', 3) AS city,
         upper(regexp_extract(html, '{HTML_LANG}', 1)) AS country,
         regexp_extract(url, '{URL_PATH}', 1) AS address,
         page_id::VARCHAR AS phone_number,
         regexp_extract(html, '{HTML_HEAD}', 1) AS place_information,
         regexp_extract(url, '{URL_PATH}', 1) || ' stars' AS rating,
         url || '#' || page_id::VARCHAR AS place_url
  FROM pages),
place_rows AS (
  SELECT coalesce(array_to_string(accessibility_list, ', '), '') AS accessibility,
         title AS business_name,
         coalesce(array_to_string(categories, ', '), '') AS business_category,
         business_status, city, country, address, phone_number, place_information, rating, place_url,
         try_cast(regexp_extract(rating, '([0-9]+\\.?[0-9]*)', 1) AS FLOAT) AS rating_numeric
  FROM places)"""


def hotels(spark: SparkSession, folder: str) -> DataFrame:
    """Documents as hotels: lines are reviews, sentences are house rules."""
    docs = read_table(spark, folder, "documents", spread_by="doc_id")
    lines = F.split("text", "\n")
    return docs.select(
        F.col("doc_id").alias("hotel_id"),
        F.element_at(lines, 1).alias("description"),
        F.element_at(lines, -1).alias("fine_print"),
        F.concat_ws(" ", "lang", "source").alias("property_highlights"),
        _structs(lines, "review", "turn").alias("top_reviews"),
        _structs(F.split("text", r"\. "), "description").alias("house_rules"),
        (F.pmod("n_chars", F.lit(100)) / 10).alias("review_score"),
        F.col("lang").alias("city"),
        F.concat_ws(", ", "source", "lang").alias("location"),
        F.upper("lang").alias("country"),
    )


HOTELS_SQL = """hotels AS (
  SELECT doc_id AS hotel_id,
         string_split(text, chr(10))[1] AS description,
         string_split(text, chr(10))[-1] AS fine_print,
         lang || ' ' || source AS property_highlights,
         string_split(text, chr(10)) AS reviews,
         string_split(text, '. ') AS rules,
         (n_chars % 100) / 10.0::DOUBLE AS review_score,
         lang AS city, source || ', ' || lang AS location, upper(lang) AS country
  FROM documents)"""


def stays(spark: SparkSession, folder: str) -> DataFrame:
    """Documents as stay listings, several rows per property, with all columns of the listings."""
    docs = read_table(spark, folder, "documents", spread_by="doc_id")
    pair = F.array(F.col("lang"), F.lit(None).cast("string"), F.col("source"))

    def rated(label: str) -> Column:
        return F.array(F.struct(F.lit(label).alias("name"), F.col("n_chars").alias("value")))

    return docs.select(
        F.floor(F.col("doc_id") / 10).cast("long").alias("property_id"),
        F.col("source").alias("url"),
        "doc_id",
        F.split("text", "\n").alias("reviews"),
        _structs(F.array("lang", "source"), "name", "id").alias("amenities"),
        rated("beds").alias("arrangement_details"),
        F.col("text").alias("description"),
        pair.alias("available_dates"),
        F.concat_ws(" > ", "lang", "source").alias("breadcrumbs"),
        F.when(F.col("lang") == "en", rated("refund")).alias("cancellation_policy"),
        F.col("lang").alias("category"),
        rated("clean").alias("category_rating"),
        F.lit("USD").alias("currency"),
        F.split("source", "").alias("description_items"),
        F.array("source", "lang").alias("details"),
        F.lit(None).cast("string").alias("discount"),
        F.concat_ws("/", F.lit("stay"), "source", F.col("doc_id").cast("string")).alias("final_url"),
        F.pmod("n_chars", F.lit(8)).alias("guests"),
        rated("view").alias("highlights"),
        F.col("n_chars").alias("host_number_of_reviews"),
        (F.pmod("n_chars", F.lit(50)) / 10).alias("host_rating"),
        F.pmod("n_chars", F.lit(101)).alias("host_response_rate"),
        F.pmod("n_chars", F.lit(12)).alias("hosts_year"),
        F.when(F.col("lang") != "de", pair).alias("house_rules"),
        (F.col("n_chars") > 2000).alias("is_guest_favorite"),
        (F.col("n_chars") > 4000).alias("is_supperhost"),
        (F.col("n_chars") / 8).alias("lat"),
        F.concat_ws(" ", F.lit("Stay"), F.col("doc_id").cast("string")).alias("listing_name"),
        F.concat_ws(" ", F.lit("Title"), F.col("doc_id").cast("string")).alias("listing_title"),
        F.concat_ws(", ", "source", "lang").alias("location"),
        (F.col("n_chars") / 4).alias("long"),
        F.col("source").alias("name"),
        (F.col("lang") == "fr").alias("pets_allowed"),
        (F.col("n_chars") / 2).alias("price"),
        rated("night").alias("pricing_details"),
        F.pmod("n_chars", F.lit(300)).alias("property_number_of_reviews"),
        (F.pmod("n_chars", F.lit(40)) / 8).alias("ratings"),
        F.col("n_chars").cast("double").alias("total_price"),
    )


def _rated_sql(label: str) -> str:
    return f"'[{{{label}, ' || n_chars || '}}]'"


# One row per property and the curated rendering of its columns.
CURATED_SQL = f"""chosen AS (
  SELECT * FROM (
    SELECT *, doc_id // 10 AS property_id,
           row_number() OVER (PARTITION BY doc_id // 10 ORDER BY source DESC, doc_id DESC) AS instance
    FROM documents) WHERE instance = 1),
curated AS (
  SELECT property_id,
         array_to_string(string_split(text, chr(10)), chr(10)) AS reviews,
         '[{{0, ' || lang || '}}, {{1, ' || source || '}}]' AS amenities,
         {_rated_sql("beds")} AS arrangement_details,
         text AS listing_description,
         lang || chr(10) || source AS available_dates,
         lang || ' > ' || source AS breadcrumbs,
         CASE WHEN lang = 'en' THEN {_rated_sql("refund")} ELSE '' END AS cancellation_policy,
         lang AS category,
         {_rated_sql("clean")} AS category_ratings,
         'USD' AS currency,
         array_to_string(string_split(source, ''), chr(10)) AS description_items,
         source || chr(10) || lang AS details,
         NULL::VARCHAR AS discount,
         'stay/' || source || '/' || doc_id AS final_url,
         n_chars % 8 AS guests,
         {_rated_sql("view")} AS highlights,
         n_chars AS host_number_of_reviews,
         (n_chars % 50) / 10::DOUBLE AS host_rating,
         n_chars % 101 AS host_response_rate,
         n_chars % 12 AS hosts_year,
         CASE WHEN lang <> 'de' THEN lang || chr(10) || source ELSE '' END AS house_rules,
         n_chars > 2000 AS is_guest_favorite,
         n_chars > 4000 AS is_supperhost,
         n_chars / 8::DOUBLE AS lat,
         'Stay ' || doc_id AS listing_name,
         'Title ' || doc_id AS listing_title,
         source || ', ' || lang AS location,
         n_chars / 4::DOUBLE AS long,
         source AS name,
         lang = 'fr' AS pets_allowed,
         n_chars / 2::DOUBLE AS price,
         {_rated_sql("night")} AS pricing_details,
         n_chars % 300 AS number_of_reviews,
         (n_chars % 40) / 8::DOUBLE AS ratings,
         n_chars::DOUBLE AS total_price
  FROM chosen)"""


def update_events(turns: DataFrame) -> DataFrame:
    """Conversation turns as update events: a node per role, a message per line.

    System turns have no message list.
    """
    lines = F.transform(F.split("text", "\n"), lambda x: F.struct(F.col("role"), x.alias("content")))
    messages = F.when(F.col("role") != "system", lines)
    return turns.select(
        F.concat_ws(":", "conv_id", "turn").alias("event_id"),
        F.create_map("role", F.struct(messages.alias("messages"))).alias("updates"),
    )
