"""Text vectors by signed term hashing: the digest of a term tells its place and its sign."""

from __future__ import annotations

import hashlib
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from staysift.functions.text import tokens

DIMS = 1024


@dataclass
class Weights:
    """``n`` texts, and for each place the logarithm of how rare it is among them."""

    n: int
    idf: np.ndarray


def places_of(terms: list[str], dims: int) -> tuple[np.ndarray, np.ndarray]:
    """Place and sign of each term: the first eight hex digits of its MD5, and the ninth's last bit."""
    digests = [hashlib.md5(t.encode(), usedforsecurity=False).hexdigest() for t in terms]
    place = np.fromiter((int(d[:8], 16) % dims for d in digests), np.int64, len(digests))
    sign = np.fromiter((1 - 2 * (int(d[8], 16) & 1) for d in digests), np.int64, len(digests))
    return place, sign


def _cells(words: pa.Array, dims: int) -> tuple[np.ndarray, np.ndarray]:
    """The cells (row times ``dims`` plus place) that the words of the rows touch, and the sum of signs there."""
    flat = words.flatten().dictionary_encode()
    if not len(flat):
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    place, sign = places_of(flat.dictionary.to_pylist(), dims)
    codes = flat.indices.to_numpy(zero_copy_only=False)
    length = np.diff(words.offsets.to_numpy())
    row = np.repeat(np.arange(len(words)), length)
    cells, back = np.unique(row * dims + place[codes], return_inverse=True)
    return cells, np.bincount(back, sign[codes], len(cells)).astype(np.int64)


def fit_signed_vectors(df: DataFrame, text: str, dims: int = DIMS) -> Weights:
    """Count in how many texts each place is touched. Each task sends at most ``dims`` + 1 numbers.

    Null texts do not count; an empty table gives weights of zero.
    """

    def rows(batches):
        touched, n = np.zeros(dims, np.int64), 0
        for batch in batches:
            cells, _ = _cells(batch.column(0), dims)
            touched += np.bincount(cells % dims, minlength=dims)
            n += batch.num_rows
        at = np.flatnonzero(touched)
        yield pa.RecordBatch.from_arrays(
            [pa.array(np.append(-1, at), pa.int64()), pa.array(np.append(n, touched[at]), pa.int64())], ["place", "n"]
        )

    words = df.where(F.col(text).isNotNull()).select(tokens(text).alias("words"))
    counted = words.mapInArrow(rows, "place long, n long").groupBy("place").agg(F.sum("n").alias("n"))
    found = {r.place: r.n for r in counted.collect()}  # dims + 1 rows at most
    n = found.pop(-1, 0)
    idf = np.log((n + 1) / (1 + np.zeros(dims)))
    for place, texts in found.items():
        idf[place] = np.log((n + 1) / (texts + 1))
    return Weights(n, idf)


def signed_vectors(df: DataFrame, text: str, weights: Weights, out: str = "embedding") -> DataFrame:
    """All rows and columns of ``df`` and ``out``, the unit vector of the row's text (list of doubles).

    A term adds its sign at its place, so terms that meet there cancel out on the average instead
    of adding up; sums are weighed by the place's rarity. Nothing is shuffled. A null text gives
    null, a text without words or with common places alone the zero vector. A column named
    ``out`` is replaced.
    """
    base = df.drop(out)
    words = "_words"
    while words.lower() in {c.lower() for c in [*base.columns, out]}:
        words = "_" + words
    idf, dims = weights.idf, len(weights.idf)

    def rows(batches):
        for batch in batches:
            for start in range(0, batch.num_rows, 1024):
                part = batch.slice(start, 1024)
                terms = part.column(words)
                matrix = np.zeros((part.num_rows, dims))
                cells, sums = _cells(pa.array(terms.fill_null([]).to_pylist(), terms.type), dims)
                matrix.reshape(-1)[cells] = sums * idf[cells % dims]
                norms = np.linalg.norm(matrix, axis=1, keepdims=True)
                unit = np.divide(matrix, norms, out=np.zeros_like(matrix), where=norms > 0)
                ends = pa.array(np.arange(0, dims * (part.num_rows + 1), dims), pa.int32())
                vectors = pa.ListArray.from_arrays(ends, pa.array(unit.reshape(-1)), mask=terms.is_null())
                yield part.drop_columns([words]).append_column(out, vectors)

    schema = ", ".join(f"`{n}` {k}" for n, k in base.dtypes)
    return base.withColumn(words, tokens(text)).mapInArrow(rows, f"{schema}, `{out}` array<double>")
