"""Text rendering, number parsing and tokens."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

from staysift.functions.predicates import as_column

# Patterns that results depend on.
FIRST_NUMBER = r"([0-9]+\.?[0-9]*)"
DIGIT_WORD = r"(?U)\b\d+\b"
OUTER_SPACE = r"(?U)^\s+|\s+$"
TOKEN_BREAK = r"[^\p{L}\p{N}]+"


def first_number(col: Column | str) -> Column:
    """First number inside a text as FLOAT; null when there is none."""
    return F.regexp_extract(as_column(col), FIRST_NUMBER, 1).try_cast("float")


def join_list(col: Column | str, sep: str) -> Column:
    """String array to one text: null elements are skipped, a null array gives ''."""
    return F.concat_ws(sep, as_column(col))


def show_nested(col: Column | str) -> Column:
    """Display form of a nested column; '' for null."""
    return F.coalesce(as_column(col).cast("string"), F.lit(""))


def strip(col: Column | str) -> Column:
    """Remove white space of every kind at both ends."""
    return F.regexp_replace(as_column(col), OUTER_SPACE, "")


def drop_digit_words(col: Column | str) -> Column:
    """Delete digit runs that stand alone as words."""
    return F.regexp_replace(as_column(col), DIGIT_WORD, "")


def tokens(col: Column | str) -> Column:
    """Lower-case runs of letters and digits, in any script."""
    return F.filter(F.split(F.lower(as_column(col)), TOKEN_BREAK), lambda t: t != "")
