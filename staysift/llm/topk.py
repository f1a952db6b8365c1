"""Exact top-k by integer inner product: tiles of queries and shards, selected and merged."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.core.broadcast import Broadcast
from pyspark.sql import Column, DataFrame, functions as F

from staysift.llm.work import numbers
from staysift.operators.ranking import top_k_per_group
from staysift.session import cut_lineage

SCALE = 256
# Rows of a tile's two sides, bytes of query vectors held by a task at once, lanes of the merge.
TILE, QUERIES, ROUND_BYTES, LANES = 4096, 1024, 32 << 20, 64
_NONE = np.iinfo(np.int64).min


def finite(vec: str) -> Column:
    """Whether a vector is not null, not empty and holds only finite numbers."""
    good = F.forall(
        vec,
        lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x.cast("double")) < F.lit(float("inf"))),
    )
    return F.col(vec).isNotNull() & (F.size(vec) > 0) & good


def one_per_id(df: DataFrame, key: str, vec: str) -> DataFrame:
    """``_id`` and ``_vec``: one usable vector per non-null key (of repeated keys the least one)."""
    usable = df.select(F.col(key).alias("_id"), F.col(vec).alias("_vec")).where(F.col("_id").isNotNull())
    return usable.where(finite("_vec")).groupBy("_id").agg(F.min("_vec").alias("_vec"))


def quantized(column: pa.Array, scale: int = SCALE) -> np.ndarray:
    """floor(scale * x) of vectors of one length, as doubles that hold integers."""
    flat = column.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
    top = np.finfo(np.float64).max
    return np.floor(np.clip(flat * scale, -top, top)).reshape(len(column), -1)


def products(queries: np.ndarray, rows: np.ndarray) -> np.ndarray:
    """Integer inner products; by floating point where every partial sum is exact in a double."""
    if not len(queries) or not len(rows):
        return np.zeros((len(queries), len(rows)), np.int64)
    if np.abs(queries).max() * np.abs(rows).max() * rows.shape[1] < 2**53:
        return (queries @ rows.T).astype(np.int64)
    whole = np.vectorize(int, otypes=[object])
    exact = whole(queries) @ whole(rows).T
    return np.clip(exact, _NONE + 1, np.iinfo(np.int64).max).astype(np.int64)


def best_of(scores: np.ndarray, ids: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Per row the ``k`` highest scores, ties to the smaller id; both arrays have a row per query."""
    by = np.lexsort((ids, ~scores), axis=1)[:, :k]  # ~x falls as x rises, without overflow
    return np.take_along_axis(scores, by, 1), np.take_along_axis(ids, by, 1)


def tile_best(scores: np.ndarray, ids: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """The same for one tile whose columns have ascending ``ids``: a partial selection first."""
    n = scores.shape[1]
    if n > 4 * k and np.abs(scores[scores != _NONE]).max(initial=0) < 2**62 // n:
        # One integer orders by score, then by column; a missing score sorts last.
        order = np.where(scores == _NONE, _NONE, scores * n + (n - 1 - np.arange(n)))
        pick = np.argpartition(order, n - k, axis=1)[:, n - k :]
        return best_of(np.take_along_axis(scores, pick, 1), ids[pick], k)
    return best_of(scores, np.broadcast_to(ids, scores.shape), k)


def _blocks(queries: DataFrame) -> DataFrame:
    """Queries packed into blocks: ``dim``, ``n``, ``ids`` and ``values`` (doubles)."""

    def rows(batches):
        for batch in batches:
            size = np.array([len(v) for v in batch.column(1)])
            for dim in np.unique(size):
                at = np.flatnonzero(size == dim)
                for i in range(0, len(at), QUERIES):
                    part = pa.array(at[i : i + QUERIES])
                    values = quantized(batch.column(1).take(part))
                    ids = numbers(batch.column(0).take(part)).astype(np.int64)
                    yield pa.RecordBatch.from_arrays(
                        [pa.array([int(dim)]), pa.array([len(ids)]), pa.array([ids.tobytes()]),
                         pa.array([values.tobytes()])],
                        names=["dim", "n", "ids", "values"],
                    )

    return queries.mapInArrow(rows, "dim long, n long, ids binary, values binary")


def _round(rows: DataFrame, blocks: list, k: int) -> tuple[DataFrame, Broadcast]:
    """Best ``k`` rows of each task for every query of ``blocks`` (bounded by ROUND_BYTES).

    The blocks lie in the broadcast, which the caller may destroy once the rows are written.
    """
    held = [(b["dim"], bytes(b["ids"]), bytes(b["values"])) for b in blocks]
    shared = rows.sparkSession.sparkContext.broadcast(held)
    del held

    def search(batches):
        sides = [
            (dim, np.frombuffer(ids, np.int64), np.frombuffer(values).reshape(-1, dim))
            for dim, ids, values in shared.value
        ]
        best: list = [None] * len(sides)
        for batch in batches:
            size = np.array([len(v) for v in batch.column(1)])
            for dim in np.unique(size):
                at = np.flatnonzero(size == dim)
                for i in range(0, len(at), TILE):
                    part = pa.array(at[i : i + TILE])
                    ids = numbers(batch.column(0).take(part)).astype(np.int64)
                    by = np.argsort(ids)
                    ids, values = ids[by], quantized(batch.column(1).take(part))[by]
                    for b, (wide, asked, vectors) in enumerate(sides):
                        if wide != dim:
                            continue
                        scores = products(vectors, values)
                        own = np.minimum(np.searchsorted(ids, asked), len(ids) - 1)
                        same = np.flatnonzero(ids[own] == asked)
                        scores[same, own[same]] = _NONE
                        found = tile_best(scores, ids, k)
                        if best[b] is not None:
                            found = best_of(
                                np.hstack([best[b][0], found[0]]), np.hstack([best[b][1], found[1]]), k
                            )
                        best[b] = found
        lane = TaskContext.get().partitionId() % LANES
        for (_, asked, _), found in zip(sides, best):
            if found is None:
                continue
            row, column = np.nonzero(found[0] != _NONE)
            if len(row):
                yield pa.RecordBatch.from_arrays(
                    [pa.array(asked[row]), pa.array(found[1][row, column]), pa.array(found[0][row, column]),
                     pa.array(np.full(len(row), lane))],
                    names=["query_id", "vec_id", "score", "lane"],
                )

    return rows.mapInArrow(search, "query_id long, vec_id long, score long, lane long"), shared


def exact_topk(
    candidates: DataFrame, queries: DataFrame, k: int = 5, key: str = "vec_id", vec: str = "embedding"
) -> DataFrame:
    """``query_id``, ``rank`` (from 1), ``vec_id``, ``score``: each query's ``k`` best candidates.

    Vectors become integers floor(256 x); the score is their inner product, ties go to the
    smaller key. A query's own key is no candidate. A vector that is null, empty or holds a null
    or non-finite number takes no part, nor does a null key; of repeated keys the least vector
    counts. Vectors of different lengths are not compared. Scores beyond a long are cut to it.
    Integer keys; other columns are not read. With fewer than ``k`` candidates all come out.

    Query blocks are handed to the tasks in rounds of bounded size, with a scan of the candidates
    each; a round's best rows are written before the next one is collected, so the driver holds one
    round whatever the number of queries. A task multiplies each of its
    tiles with each block, selects per tile and merges, so only k rows per query leave it; lanes of
    tasks are merged next, then the lanes.
    """
    rows = one_per_id(candidates, key, vec)
    blocks = cut_lineage(_blocks(one_per_id(queries, key, vec)))
    sizes = blocks.select("n", F.length("values").alias("bytes")).agg(F.sum("bytes"), F.count("n")).first()
    rounds = max(1, -(-(sizes[0] or 0) // ROUND_BYTES))
    numbered = cut_lineage(blocks.withColumn("round", F.pmod(F.xxhash64("ids"), F.lit(rounds))))
    if rounds > 1:
        rows = cut_lineage(rows)
    order = [F.col("score").desc(), F.col("vec_id")]
    found = None
    for r in range(rounds):
        # About ROUND_BYTES of query vectors: rounds split all blocks evenly by hash.
        part, shared = _round(rows, numbered.where(F.col("round") == r).collect(), k)
        lanes = top_k_per_group(part, ["query_id", "lane"], order, k, "_rank").drop("_rank", "lane")
        # A query is in one round only.
        best = top_k_per_group(lanes, "query_id", order, k).select("query_id", "rank", "vec_id", "score")
        if rounds > 1:
            best = cut_lineage(best)
            shared.destroy()
        found = best if found is None else found.unionByName(best)
    return found
