"""The searches as SQL table functions over temporary views."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import DataFrame, SparkSession

from staysift.functions.text import FIRST_NUMBER
from staysift.operators.chunking import text_splitter
from staysift.operators.ranking import FAN_IN


def _switch(column: str, arg: str) -> str:
    """Optional contains-filter in SQL; wildcards in the argument are taken literally."""
    return (
        f"(coalesce({arg}, '') IN ('', 'NULL') OR contains(lower({column}), lower({arg})))"
    )


def register_place_search(spark: SparkSession, view: str, name: str = "place_search") -> None:
    """``name(address, zipcode, city, business_category, term)`` over a view of places."""
    filters = " AND ".join(
        [
            _switch("city", f"{name}.city"),
            _switch("business_category", f"{name}.business_category"),
            _switch("address", f"{name}.address"),
            _switch("address", f"{name}.zipcode"),
            f"contains(lower(accessibility), lower({name}.term))",
        ]
    )
    spark.sql(rf"""
        CREATE OR REPLACE TEMPORARY FUNCTION {name}(
          address STRING DEFAULT NULL COMMENT 'Part of the address',
          zipcode STRING DEFAULT NULL COMMENT 'Zip code, looked for in the address',
          city STRING DEFAULT 'New York' COMMENT 'Part of the city name',
          business_category STRING DEFAULT NULL COMMENT 'Part of a category name',
          term STRING DEFAULT 'wheelchair' COMMENT 'Word looked for in the accessibility notes')
        RETURNS TABLE
        COMMENT 'The 50 best rated US places whose accessibility notes mention a term'
        RETURN
          WITH listed AS (
            SELECT concat_ws(', ', p.accessibility.description) AS accessibility,
                   p.title AS business_name,
                   concat_ws(', ', p.business_category) AS business_category,
                   p.business_status, p.city, p.country, p.address, p.phone_number,
                   p.place_information, p.rating, p.place_url,
                   try_cast(regexp_extract(p.rating, r'{FIRST_NUMBER}', 1) AS FLOAT) AS rating_numeric
            FROM {view} p
            WHERE p.country = 'US'),
          hits AS (SELECT *, spark_partition_id() % {FAN_IN} AS task FROM listed WHERE {filters}),
          trimmed AS (
            SELECT *, row_number() OVER (
                     PARTITION BY task ORDER BY rating_numeric DESC NULLS LAST, place_url) AS task_rank
            FROM hits)
          SELECT * EXCEPT (task, task_rank) FROM trimmed
          WHERE task_rank <= 50
          ORDER BY rating_numeric DESC NULLS LAST, place_url
          LIMIT 50""")


def register_hotel_search(spark: SparkSession, view: str, name: str = "hotel_search") -> None:
    """``name(city, term)`` over a view of hotels. Callers that rely on the order sort again."""
    needle = f"lower({name}.term)"
    texts = [f"contains(lower({c}), {needle})" for c in ("description", "fine_print", "property_highlights")]
    nested = [
        f"contains(lower(concat_ws(', ', {c}.{f})), {needle})"
        for c, f in (("top_reviews", "review"), ("house_rules", "description"))
    ]
    spark.sql(f"""
        CREATE OR REPLACE TEMPORARY FUNCTION {name}(
          city STRING DEFAULT 'New York' COMMENT 'Part of the city name',
          term STRING DEFAULT 'wheelchair' COMMENT 'Word looked for in texts, reviews and rules')
        RETURNS TABLE
        COMMENT 'Hotels of a city that mention a term, best review score first'
        RETURN
          SELECT description, fine_print, property_highlights, top_reviews, house_rules,
                 review_score, hotel_id
          FROM {view}
          WHERE {_switch('city', f'{name}.city')} AND ({' OR '.join(texts + nested)})
          ORDER BY review_score DESC NULLS LAST, hotel_id""")


def register_city_listings(spark: SparkSession, view: str, name: str = "city_listings") -> None:
    """``name(city)``: listings of exactly one city. A lateral call over a column is an equi-join."""
    spark.sql(f"""
        CREATE OR REPLACE TEMPORARY FUNCTION {name}(city STRING COMMENT 'City name')
        RETURNS TABLE
        COMMENT 'Hotels of one city'
        RETURN SELECT hotel_id, review_score FROM {view} h WHERE h.city = {name}.city""")


def register_text_chunks(spark: SparkSession, name: str = "text_chunks", **sizes) -> None:
    """``name(text)``: an array of chunks, for ``LATERAL VIEW posexplode``."""
    spark.udf.register(name, text_splitter(**sizes))


REGISTER = {
    "place_search": register_place_search,
    "hotel_search": register_hotel_search,
    "city_listings": register_city_listings,
}


def register_all(spark: SparkSession, frames: Mapping[str, DataFrame]) -> list[str]:
    """Register the functions whose frame is given: function name to the frame it searches."""
    for name, frame in frames.items():
        view = f"{name}_source"
        frame.createOrReplaceTempView(view)
        REGISTER[name](spark, view, name)
    return list(frames)
