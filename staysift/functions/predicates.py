"""Keyword and facet predicates as plain Column expressions.

Every builder stays inside Catalyst: no Python worker runs on a filter path. Terms are matched
literally unless ``raw_pattern=True``, which lets ``%`` and ``_`` act as wildcards.
"""

from __future__ import annotations

from collections.abc import Iterable
from functools import reduce

from pyspark.sql import Column, DataFrame, functions as F

# Argument strings that, like null, switch an optional filter off.
OFF_VALUES = ("", "NULL")

_WILDCARD_FORM = {"contains": "%{}%", "prefix": "{}%", "suffix": "%{}"}
_LITERAL_FORM = {"contains": F.contains, "prefix": F.startswith, "suffix": F.endswith}


def as_column(col: Column | str) -> Column:
    return F.col(col) if isinstance(col, str) else col


def text_match(
    col: Column | str, term: str, mode: str = "contains", raw_pattern: bool = False
) -> Column:
    """Case-insensitive match of one text column: ``contains``, ``prefix`` or ``suffix``."""
    if raw_pattern:
        return as_column(col).ilike(_WILDCARD_FORM[mode].format(term))
    return _LITERAL_FORM[mode](F.lower(as_column(col)), F.lower(F.lit(term)))


def any_of(predicates: Iterable[Column]) -> Column:
    """OR over any number of predicates; FALSE when there are none."""
    return reduce(lambda seen, p: seen | p, predicates, F.lit(False))


def any_term(col: Column | str, terms: Iterable[str], **how) -> Column:
    """True when one of several spellings matches."""
    return any_of(text_match(col, t, **how) for t in terms)


def is_off(arg: str | None) -> bool:
    return arg is None or arg in OFF_VALUES


def optional_match(col: Column | str, arg: str | None, **how) -> Column | None:
    """Contains-match on a constant argument, or None when the argument switches it off."""
    return None if is_off(arg) else text_match(col, arg, **how)


def optional_match_column(col: Column | str, arg: Column | str) -> Column:
    """The same rule when the argument is itself a column."""
    arg = as_column(arg)
    hit = F.contains(F.lower(as_column(col)), F.lower(arg))
    return arg.isNull() | arg.isin(*OFF_VALUES) | hit


def where_all(df: DataFrame, *predicates: Column | None) -> DataFrame:
    """AND of the predicates that are switched on."""
    return reduce(lambda d, p: d.where(p), [p for p in predicates if p is not None], df)


def any_element(col: Column | str, terms: Iterable[str], **how) -> Column:
    """True when an element of a string array matches one of the terms; never null."""
    terms = list(terms)
    return F.coalesce(F.exists(as_column(col), lambda x: any_term(x, terms, **how)), F.lit(False))


def nested_match(col: Column | str, field: str, term: str, sep: str = ", ") -> Column:
    """Contains-match over one field of an array of structs, as if joined by ``sep``.

    Only a term that shares a character with the separator can match across two elements, so
    every other term is tested per element, which stops at the first hit and builds no string.
    """
    arr = as_column(col)
    if set(term) & set(sep):
        return text_match(F.concat_ws(sep, F.transform(arr, lambda x: x[field])), term)
    return F.coalesce(F.exists(arr, lambda x: text_match(x[field], term)), F.lit(False))


def struct_match(col: Column | str, term: str) -> Column:
    """Contains-match over the JSON form of a nested column: any field value or field name."""
    return F.contains(F.lower(F.to_json(as_column(col))), F.lower(F.lit(term)))

