"""Place searches for a whole table of requests in one pass over the listings."""

from __future__ import annotations

from functools import reduce

import pandas as pd
from pyspark.sql import Column, DataFrame, functions as F, types as T

from staysift.functions.predicates import optional_match_column
from staysift.operators.listings import place_rows
from staysift.operators.joins import join_on_unique
from staysift.operators.ranking import numbered, top_k_per_group
from staysift.session import broadcast_if_small, cut_and_measure, cut_lineage

# Different terms in one automaton; more go in blocks, with a pass over the listings for each.
TERMS = 200_000
# The best listings, in multiples of the rows wanted, that all requests meet, and how much longer the next blocks are.
FIRST, WIDER = 4, 4
FACETS = ("address", "zipcode", "city", "category")


def terms_in(terms: list[str]):
    """Pandas UDF from a text to the numbers of the ``terms`` that it contains (each once, ascending).

    An Aho-Corasick automaton reads a text once, whatever the number of terms. An empty term is in every text.
    """
    always = [i for i, t in enumerate(terms) if t == ""]
    built: list = []  # filled by the worker

    @F.pandas_udf(T.ArrayType(T.IntegerType()))
    def find(texts: pd.Series) -> pd.Series:
        if not built:
            import ahocorasick

            automaton = ahocorasick.Automaton()
            for i, t in enumerate(terms):
                if t:
                    automaton.add_word(t, i)
            if len(automaton):
                automaton.make_automaton()
            built.append(automaton)
        automaton = built[0]

        def found(text: str | None) -> list[int] | None:
            if text is None:
                return None
            hits = {i for _, i in automaton.iter(text)} if len(automaton) else set()
            return sorted(hits.union(always))

        return texts.map(found)

    return find


def place_search_batch(
    places: DataFrame, requests: DataFrame, rid: str = "request_id", n: int = 50, most_terms: int = TERMS
) -> DataFrame:
    """The ``n`` best places of every request: ``rid``, ``rank`` and the columns of a place.

    ``requests``: ``rid`` (unique), term, address, zipcode, city, category, country, with the meaning
    that they have in ``place_search``; a null country stands for all, a null term for none. The distinct
    terms are sent to the tasks, a listing is read once and meets the requests whose term it holds, facets
    are tested there, and tasks trim their rows to ``n`` a request before the shuffle. Hits of one term in very many listings
    stay where the listings are if the requests are few enough to be sent out.

    The listings are numbered from the best on and searched in blocks, each WIDER times as long as all before. A request
    with ``n`` hits in the blocks so far is done, so a frequent term does not meet the listings that cannot be among its best.
    """
    listed = place_rows(places).drop("accessibility_list")
    if rid in listed.columns or "rank" in listed.columns:
        raise ValueError(f"places have a column {rid} or rank too")
    wanted = requests.where(F.col("term").isNotNull()).select(
        F.col(rid).alias("_rid"), F.lower("term").alias("_term"), F.col("country").alias("_country"),
        *[F.col(c).alias(f"_{c}") for c in FACETS],
    )
    order = [F.desc_nulls_last("rating_numeric"), F.asc_nulls_last("place_url")]
    placed = numbered(listed.withColumn("_all", F.lit(0)), "_all", order, "_place").drop("_all")
    placed, listings = cut_and_measure(placed)
    wanted, seen = cut_and_measure(wanted)
    tasks = listed.sparkSession.sparkContext.defaultParallelism
    found, low, high = [], 0, FIRST * n
    while True:
        block = placed.where(F.col("_place").between(low + 1, high)).repartition(tasks, "_place")
        hits = _hits(block, wanted, seen["rows"], most_terms).select(F.col("_rid").alias(rid), "_place")
        found.append(cut_lineage(top_k_per_group(hits, rid, [F.asc("_place")], n).drop("rank")))
        every = reduce(DataFrame.unionByName, found)
        low, high = high, high * WIDER
        if low >= listings["rows"]:
            break
        done = every.groupBy(F.col(rid).alias("_done")).agg(F.count(F.lit(1)).alias("_n")).where(F.col("_n") >= n)
        wanted, seen = cut_and_measure(wanted.join(done, F.col("_rid").eqNullSafe(F.col("_done")), "left_anti"))
        if not seen["rows"]:
            break
    best = top_k_per_group(every, rid, [F.asc("_place")], n)
    return join_on_unique(best, placed, "_place", spread_by=rid).select(rid, *listed.columns, "rank")


def _hits(listed: DataFrame, wanted: DataFrame, rows: int, most_terms: int) -> DataFrame:
    """Pairs of a listing and a request (``rows`` of them) that it fulfils."""
    terms = wanted.select("_term").distinct()
    blocks = max(1, -(-terms.count() // most_terms))
    parts = []
    for b in range(blocks):
        own = terms.where(F.pmod(F.xxhash64("_term"), F.lit(blocks)) == b)
        named = sorted(r[0] for r in own.collect())  # about TERMS texts
        numbers = listed.sparkSession.createDataFrame(list(enumerate(named)), "_number int, _term string")
        asked = wanted.join(broadcast_if_small(numbers, rows=len(named)), "_term").drop("_term")
        found = listed.withColumn("_numbers", terms_in(named)(F.lower("accessibility")))
        found = found.select("*", F.explode("_numbers").alias("_number")).drop("_numbers")
        parts.append(found.join(broadcast_if_small(asked, rows=rows), "_number").drop("_number"))
    hits = reduce(DataFrame.unionByName, parts)

    def facet(column: str, asked: str) -> Column:
        return optional_match_column(column, asked)

    return hits.where(
        (F.col("_country").isNull() | (F.col("country") == F.col("_country")))
        & facet("city", "_city") & facet("business_category", "_category")
        & facet("address", "_address") & facet("address", "_zipcode")
    )
