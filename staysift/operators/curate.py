"""The curated stay table: one row per property with nested columns rendered to text."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from staysift.functions.text import join_list, show_nested
from staysift.operators.ranking import latest_per_key

SEP = "\n"

# The columns of the curated table, by how each is made from the stay listings.
LISTS = ["reviews", "available_dates", "description_items", "details", "house_rules"]
NESTED = [
    "amenities",
    "arrangement_details",
    "cancellation_policy",
    "category_rating",
    "highlights",
    "pricing_details",
]
RENAMED = {
    "description": "listing_description",
    "category_rating": "category_ratings",
    "property_number_of_reviews": "number_of_reviews",
}
COLUMNS = [
    "property_id",
    "reviews",
    "amenities",
    "arrangement_details",
    "description",
    "available_dates",
    "breadcrumbs",
    "cancellation_policy",
    "category",
    "category_rating",
    "currency",
    "description_items",
    "details",
    "discount",
    "final_url",
    "guests",
    "highlights",
    "host_number_of_reviews",
    "host_rating",
    "host_response_rate",
    "hosts_year",
    "house_rules",
    "is_guest_favorite",
    "is_supperhost",
    "lat",
    "listing_name",
    "listing_title",
    "location",
    "long",
    "name",
    "pets_allowed",
    "price",
    "pricing_details",
    "property_number_of_reviews",
    "ratings",
    "total_price",
]


def _rendered(name: str, as_json: bool) -> Column:
    if name in LISTS:
        col = join_list(name, SEP)
    elif name in NESTED:
        col = F.coalesce(F.to_json(name), F.lit("")) if as_json else show_nested(name)
    else:
        col = F.col(name)
    return col.alias(RENAMED.get(name, name))


def curated_listings(
    stays: DataFrame, tie: str | None = None, as_json: bool = False, keep_lists: bool = False
) -> DataFrame:
    """One row per property, the one with the highest ``url``; ``tie`` decides equal urls.

    Nested columns come in Spark's display form, or as JSON. With ``keep_lists`` the reviews also
    stay an array, as ``reviews_list``, so that element predicates keep working on the result.
    The rows are chosen before anything is rendered.
    """
    order = [F.desc_nulls_last("url")] + ([F.desc(tie)] if tie else [])
    needed = list(dict.fromkeys(COLUMNS + ["url"] + ([tie] if tie else [])))
    chosen = latest_per_key(stays.select(*needed), "property_id", order)
    extra = [F.col("reviews").alias("reviews_list")] if keep_lists else []
    return chosen.select(*[_rendered(c, as_json) for c in COLUMNS], *extra)
