"""Searches over place, hotel and stay listings."""

from __future__ import annotations

import json
import re
from collections.abc import Sequence

from pyspark.sql import DataFrame, functions as F

from staysift.functions.predicates import (
    any_element,
    any_of,
    nested_match,
    optional_match,
    struct_match,
    text_match,
    where_all,
)
from staysift.functions.text import first_number, join_list
from staysift.operators.aggregates import keys_with_more_than
from staysift.operators.joins import join_on_unique
from staysift.operators.ranking import first_rows, top_n

# Defaults of the searches.
TERM = "wheelchair"
CITY = "New York"
COUNTRY = "US"


def place_rows(places: DataFrame) -> DataFrame:
    """Places with list columns rendered to text and the rating parsed to a number."""
    listed = places.select(
        F.col("title").alias("business_name"),
        F.col("accessibility")["description"].alias("accessibility_list"),
        join_list("business_category", ", ").alias("business_category"),
        "business_status",
        "city",
        "country",
        "address",
        "phone_number",
        "place_information",
        "rating",
        "place_url",
        first_number("rating").alias("rating_numeric"),
    )
    return listed.select(join_list("accessibility_list", ", ").alias("accessibility"), "*")


def place_search(
    places: DataFrame,
    term: str = TERM,
    address: str | None = None,
    zipcode: str | None = None,
    city: str | None = CITY,
    category: str | None = None,
    country: str | None = COUNTRY,
    n: int = 50,
) -> DataFrame:
    """The ``n`` best rated places whose accessibility notes mention ``term``.

    Facets are off when null, '' or 'NULL'. A zipcode is looked for in the address. Places
    without a number in their rating come last; ties go by ``place_url``.
    """
    in_country = places if country is None else places.where(F.col("country") == country)
    hits = where_all(
        place_rows(in_country),
        optional_match("city", city),
        optional_match("business_category", category),
        optional_match("address", address),
        optional_match("address", zipcode),
        text_match("accessibility", term),
    )
    return top_n(hits, n, F.desc_nulls_last("rating_numeric"), F.asc_nulls_last("place_url"))


HOTEL_MODES = {"description": "contains", "fine_print": "contains", "property_highlights": "contains"}
HOTEL_NESTED = {"top_reviews": "review", "house_rules": "description"}


def hotel_hits(
    hotels: DataFrame,
    term: str = TERM,
    city: str | None = CITY,
    modes: dict[str, str] | None = None,
) -> DataFrame:
    """Hotels that mention ``term`` in a text column, a review or a house rule, in no order.

    ``modes`` sets contains, prefix or suffix per text column.
    """
    modes = {**HOTEL_MODES, **(modes or {})}
    mentions = any_of(
        [text_match(c, term, mode=m) for c, m in modes.items()]
        + [nested_match(c, f, term) for c, f in HOTEL_NESTED.items()]
    )
    return where_all(hotels, optional_match("city", city), mentions)


def hotel_search(hotels: DataFrame, term: str = TERM, city: str | None = CITY, **how) -> DataFrame:
    """``hotel_hits`` with the best review score first.

    A sort samples its input before it runs. The hits are shuffled first, so that the sample is
    taken from them and the hotels are searched once.
    """
    hits = hotel_hits(hotels, term, city, **how).repartition("hotel_id")
    return hits.orderBy(F.desc_nulls_last("review_score"), F.asc("hotel_id"))


def mentions_any_column(term: str, text_cols: Sequence[str], nested_cols: Sequence[str] = ()):
    """One predicate over a list of text columns and a list of nested columns (as JSON)."""
    return any_of([text_match(c, term) for c in text_cols] + [struct_match(c, term) for c in nested_cols])


def keyword_any(
    hotels: DataFrame,
    term: str = TERM,
    text_cols: Sequence[str] = ("description", "fine_print", "property_highlights"),
    nested_cols: Sequence[str] = ("top_reviews", "house_rules"),
    location: str | None = None,
    country: str | None = None,
    n: int = 10,
    key: str = "hotel_id",
    any_rows: bool = False,
) -> DataFrame:
    """``n`` listings of a location that mention ``term`` in any of the given columns.

    The first by key; with ``any_rows`` the first that are found.
    """
    hits = where_all(
        hotels,
        optional_match("location", location),
        optional_match("country", country),
        mentions_any_column(term, text_cols, nested_cols),
    )
    return first_rows(hits, n, F.asc(key), any_rows=any_rows)


def review_search(
    stays: DataFrame,
    terms: str | Sequence[str] = TERM,
    location: str | None = None,
    min_reviews: int = 1000,
    n: int = 5,
    key: str = "property_id",
    any_rows: bool = False,
) -> DataFrame:
    """``n`` stays of hosts with more than ``min_reviews`` reviews where a review mentions a term.

    The first by key; with ``any_rows`` the first that are found.
    """
    spellings = [terms] if isinstance(terms, str) else list(terms)
    hits = where_all(
        stays,
        F.col("host_number_of_reviews") > min_reviews,
        optional_match("location", location),
        any_element("reviews", spellings),
    )
    return first_rows(hits, n, F.asc(key), any_rows=any_rows)


def multi_review_listings(
    rows: DataFrame,
    details: DataFrame,
    key: str = "property_id",
    counted: str = "reviews",
    more_than: int = 1,
    tie: str = "url",
    **spreading,
) -> DataFrame:
    """Details of the keys that have more than ``more_than`` reviewed rows, in key order.

    The key side is unique, so this is a semi-join; hot keys are spread over tasks, and the sort
    takes a second column so that one key may span several output ranges.
    """
    keys = keys_with_more_than(rows, key, counted, more_than)
    kept = join_on_unique(details, keys, key, spread_by=tie, how="left_semi", **spreading)
    return kept.orderBy(F.asc(key), F.asc(tie))


# Functions that a predicate may call: of one row, without effects.
CALLS = frozenset(
    "in like ilike rlike between "
    "exists forall filter transform size array_contains array_size element_at get "
    "lower upper trim ltrim rtrim length char_length substring substr left right instr locate position replace "
    "concat concat_ws split startswith endswith contains regexp_like regexp_extract regexp_count "
    "coalesce nullif nvl ifnull if isnull isnotnull isnan greatest least "
    "abs ceil floor round sqrt power mod pmod sign cast try_cast "
    "int bigint double float string date timestamp boolean decimal "
    "to_date year month day dayofmonth hour datediff date_add date_sub".split()
)
# What else a parsed predicate may consist of; subqueries, windows, stars, parameters are none of it.
NODES = frozenset(
    "And Or Not EqualTo EqualNullSafe GreaterThan GreaterThanOrEqual LessThan LessThanOrEqual "
    "In IsNull IsNotNull IsTrue IsNotTrue IsUnknown IsNotUnknown Like ILike RLike LikeAny LikeAll NotLikeAny NotLikeAll Lower "
    "Add Subtract Multiply Divide IntegralDivide Remainder UnaryMinus UnaryPositive "
    "BitwiseAnd BitwiseOr BitwiseXor BitwiseNot Concat CaseWhen If Cast TryCast Literal "
    "UnresolvedAttribute UnresolvedExtractValue LambdaFunction UnresolvedNamedLambdaVariable UnresolvedFunction".split()
)


def check_predicate(predicate: str, df: DataFrame) -> None:
    """Refuse a predicate unless all it consists of, as Spark parses it, is known to be harmless.

    Every node of the parsed expression has to be in NODES, every function in CALLS, and every
    name a column of ``df``, so neither another table nor the session can be read. Comments are
    refused too.
    """
    spark = df.sparkSession
    try:
        parsed = spark._jsparkSession.sessionState().sqlParser().parseExpression(predicate)
        nodes = json.loads(parsed.toJSON())
    except Exception as error:
        raise ValueError(f"the predicate cannot be read: {str(error)[:200]}") from error
    if re.search(r"--|/[*]", re.sub(r"'(?:[^'\\]|\\.|'')*'|\"(?:[^\"\\]|\\.|\"\")*\"|`[^`]*`", "", predicate)):
        raise ValueError("the predicate must not contain a comment")
    columns = {c.lower() for c in df.columns}
    for node in nodes:
        kind = node["class"].rpartition(".")[2]
        if kind not in NODES:
            raise ValueError(f"{kind} is not among the parts of a predicate")
        name = str(node.get("nameParts", "")).strip("[]").lower()
        if kind == "UnresolvedFunction" and name not in CALLS:
            raise ValueError(f"{name} is not among the functions of a predicate")
        if kind == "UnresolvedAttribute" and name not in columns and name.split(",")[0] not in columns:
            raise ValueError(f"{name} is not a column")


def guarded_filter(df: DataFrame, predicate: str, key: str = "property_id", n: int = 50) -> DataFrame:
    """Keys of at most ``n`` rows that meet a predicate given as SQL text.

    The text can only be a row predicate: aggregates and windows are refused by Spark inside a
    filter; comments, subqueries, names that are no columns and functions that are not in CALLS are
    refused here, and the result is the key column alone.
    """
    check_predicate(predicate, df)
    return top_n(df.where(F.expr(predicate)).select(key), n, F.asc(key))
