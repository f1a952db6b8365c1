"""Overlapping text chunks: fixed windows in Catalyst, recursive splitting in Arrow batches."""

from __future__ import annotations

import re
from bisect import bisect_left, bisect_right
from collections.abc import Iterator, Sequence

import pandas as pd
from pyspark.sql import Column, DataFrame, functions as F, types as T

# Chunk size and overlap in characters, and the separators in order of preference.
SIZE = 1000
OVERLAP = 200
SEPARATORS = ("\n\n", "\n", " ", "")


def _check(size: int, overlap: int) -> None:
    if not 0 <= overlap < size:
        raise ValueError(f"the overlap has to be from 0 to below the size, got {overlap} and {size}")


def chunk_key(*parts: Column | str) -> Column:
    """Key that is the same on every run: sha-256 of the row key and the chunk number."""
    return F.sha2(F.concat_ws(":", *[F.col(p) if isinstance(p, str) else p for p in parts]), 256)


def _as_rows(df: DataFrame, pieces: Column, key: str, text: str) -> DataFrame:
    carried = [c for c in df.columns if c != text]
    rows = df.select(*carried, F.posexplode(pieces).alias("chunk_no", "text"))
    return rows.withColumn("chunk_id", chunk_key(key, "chunk_no"))


def fixed_chunks(
    df: DataFrame, key: str, text: str, size: int = SIZE, overlap: int = OVERLAP
) -> DataFrame:
    """Windows of ``size`` characters that start every ``size - overlap`` characters.

    One regular expression walks the text once: it looks ahead for a window and moves on by a
    stride, so the cost stays linear in the text. A last window that lies inside the one before
    it is left out. All other columns are carried along. No Python worker, no shuffle.
    """
    _check(size, overlap)
    stride = size - overlap
    windows = F.regexp_extract_all(
        F.col(text), F.lit(f"(?s)(?=(.{{1,{size}}})).{{1,{stride}}}"), F.lit(1)
    )
    count = F.greatest(F.lit(1), F.ceil((F.length(text) - overlap) / stride)).cast("int")
    return _as_rows(df.where(F.length(text) > 0), F.slice(windows, F.lit(1), count), key, text)


def _whole_runs(cuts: Sequence[int], size: int, overlap: int) -> Iterator[tuple[int, int]]:
    """Spans that pack the pieces between neighbouring ``cuts``, none of which exceeds ``size``."""
    first, last = 0, len(cuts) - 1
    while True:
        end = bisect_right(cuts, cuts[first] + size) - 1
        yield cuts[first], cuts[end]
        if end == last:
            return
        # Step back over whole pieces: within the overlap, and with room for the next piece.
        first = bisect_left(cuts, max(cuts[end] - overlap, cuts[end + 1] - size))


def chunk_spans(
    text: str, lo: int, hi: int, size: int, overlap: int, separators: Sequence[str]
) -> Iterator[tuple[int, int]]:
    """Spans of the chunks of ``text[lo:hi]``.

    The first separator that occurs (the last one if none does) cuts the text in front of each
    occurrence. Pieces shorter than
    ``size`` are packed; a longer one ends the packing and is split by the remaining separators.
    """
    last = len(separators) - 1
    level = next((i for i, s in enumerate(separators) if s == "" or text.find(s, lo, hi) >= 0), last)
    sep, finer = separators[level], separators[level + 1 :]
    if sep == "":
        stride = size - overlap
        for start in range(lo, max(hi - overlap, lo + 1), stride):
            yield start, min(start + size, hi)
        return
    cuts = [lo]
    cuts += [m for m in (x.start() for x in re.compile(re.escape(sep)).finditer(text, lo, hi)) if m > lo]
    cuts.append(hi)
    run = [lo]
    for a, b in zip(cuts, cuts[1:]):
        if b - a < size:
            run.append(b)
            continue
        if len(run) > 1:
            yield from _whole_runs(run, size, overlap)
        if finer:
            yield from chunk_spans(text, a, b, size, overlap, finer)
        else:
            yield a, b
        run = [b]
    if len(run) > 1:
        yield from _whole_runs(run, size, overlap)


def text_splitter(
    size: int = SIZE, overlap: int = OVERLAP, separators: Sequence[str] = SEPARATORS
):
    """Pandas UDF from a text to its chunks; blank chunks are left out."""
    _check(size, overlap)
    if not separators:
        raise ValueError("at least one separator is needed")

    @F.pandas_udf(T.ArrayType(T.StringType()))
    def split(texts: pd.Series) -> pd.Series:
        def pieces(t: str | None) -> list[str] | None:
            if not t:
                return None if t is None else []
            spans = chunk_spans(t, 0, len(t), size, overlap, separators)
            return [c for c in (t[a:b].strip() for a, b in spans) if c]

        return texts.map(pieces)

    return split


def recursive_chunks(
    df: DataFrame,
    key: str,
    text: str,
    size: int = SIZE,
    overlap: int = OVERLAP,
    separators: Sequence[str] = SEPARATORS,
) -> DataFrame:
    """Chunks that end at blank lines, lines or words where they can.

    Packing is sequential inside one text, so it runs in Arrow batches; only the text column
    crosses to Python and every other column stays in the JVM. Rows are independent: no shuffle.
    """
    split = text_splitter(size, overlap, separators)
    return _as_rows(df.where(F.length(text) > 0), split(F.col(text)), key, text)
