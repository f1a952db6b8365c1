"""Vectors stored in a two-level tree of cells, so that a search reads the cells that can hold a hit.

The build groups a sample into cells around centres, and each of those into smaller ones; every vector goes
down the tree to a cell, and cells are folders of the stored table. Beside it lies a table of the cells:
centre, radius (greatest angle to a vector), size. A query first reads the cells nearest to it that hold k vectors
together; the k-th score found there and the triangle inequality of angles rule out most other cells.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, functions as F, types as T

from staysift.operators.ranking import top_k_per_group
from staysift.operators.vectors import SCORES, best_of, by_id, unit_rows
from staysift.session import broadcast_if_small, cut_lineage

CELL = "_cell"
# Vectors meant for a cell, and the most cells: their centres are held by the driver and every task.
CELL_ROWS, MAX_CELLS = 4096, 4096
# Sampled vectors for each cell, and rounds of regrouping the sample.
SAMPLED, ROUNDS = 16, 6
# Rows of one cell, or queries that visit it, that meet in one task.
BLOCK_ROWS = 50_000
# Wider than the rounding of scores can make an angle, ties included.
SLACK = 2e-3


@dataclass(frozen=True)
class PlacedVectors:
    """vectors: key, vector and cell (a partition column); cells: cell, centre, radius, n."""

    vectors: DataFrame
    cells: DataFrame
    vid: str
    vec: str


def _centres(sample: np.ndarray, count: int) -> np.ndarray:
    """Unit centres of ``count`` groups of unit rows, or fewer; the same for the same rows."""
    sample = np.unique(sample, axis=0)
    if len(sample) <= count:
        return sample
    centres = sample[np.linspace(0, len(sample) - 1, count).astype(int)]
    for _ in range(ROUNDS):
        near = (sample @ centres.T).argmax(axis=1)
        sums = np.zeros_like(centres)
        np.add.at(sums, near, sample)
        norms = np.linalg.norm(sums, axis=1)
        centres = np.where(norms[:, None] > 0, sums / np.maximum(norms, 1e-12)[:, None], centres)
    return centres


def _tree(sample: np.ndarray, cells: int) -> tuple[np.ndarray, list[np.ndarray], np.ndarray]:
    """Centres of the upper cells, of the lower cells in each, and the first number of each upper cell's."""
    upper = _centres(sample, max(1, round(cells**0.5)))
    near = (sample @ upper.T).argmax(axis=1)
    share = np.bincount(near, minlength=len(upper)) / len(sample)
    lower = [_centres(sample[near == u], max(1, round(cells * share[u]))) if share[u] else upper[u : u + 1] for u in range(len(upper))]
    return upper, lower, np.cumsum([0, *map(len, lower)])


def _down(rows: np.ndarray, tree) -> tuple[np.ndarray, np.ndarray]:
    """Cell of each unit row, and its angle to the cell's centre."""
    upper, lower, first = tree
    near = (rows @ upper.T).argmax(axis=1)
    cell, cosine = np.zeros(len(rows), np.int32), np.zeros(len(rows))
    for u in np.unique(near):
        at = np.flatnonzero(near == u)
        scores = rows[at] @ lower[u].T
        best = scores.argmax(axis=1)
        cell[at], cosine[at] = first[u] + best, scores[np.arange(len(at)), best]
    return cell, np.arccos(np.clip(cosine, -1.0, 1.0))


def place_vectors(
    df: DataFrame, path: str, vid: str, vec: str = "embedding", cell_rows: int = CELL_ROWS, max_cells: int = MAX_CELLS
) -> PlacedVectors:
    """Write the vectors of ``df`` (unique ``vid``) in cells below ``path`` and open them.

    Cells follow the number of rows. The tree is made on the driver from SAMPLED vectors a cell, picked by
    a hash, so a build repeats. Rows without a vector are left out; a zero vector has the score 0 with all.
    A cell of very many vectors is written by several tasks.
    """
    spark = df.sparkSession
    rows = df.where(F.col(vec).isNotNull()).select(vid, vec)
    cells = min(max_cells, max(1, -(-rows.count() // cell_rows)))
    sample = rows.select(vec).orderBy(F.xxhash64(vec), F.col(vec)).limit(SAMPLED * cells).toArrow()
    width = len(sample.column(vec)[0]) if sample.num_rows else 1
    units = unit_rows(sample.column(vec), width) if sample.num_rows else np.zeros((1, 1))
    tree = _tree(units, cells)

    def placed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                cell, angle = _down(unit_rows(batch.column(vec), width), tree)
                columns = [*batch.columns, pa.array(cell), pa.array(angle)]
                yield pa.RecordBatch.from_arrays(columns, names=[*batch.schema.names, CELL, "_angle"])

    schema = T.StructType([*rows.schema.fields, T.StructField(CELL, T.IntegerType()), T.StructField("_angle", T.DoubleType())])
    found = rows.mapInArrow(placed, schema).hint("rebalance", CELL)
    found.write.mode("overwrite").partitionBy(CELL).parquet(f"{path}/vectors")
    rows.limit(0).write.mode("overwrite").parquet(f"{path}/schema")
    stored = spark.read.schema(schema).parquet(f"{path}/vectors")
    centres = np.concatenate(tree[1])
    kinds = f"{CELL} int, centre array<double>"
    named = spark.createDataFrame([(i, [float(x) for x in c]) for i, c in enumerate(centres)], kinds)
    sizes = stored.groupBy(CELL).agg(F.count(F.lit(1)).alias("n"), F.max("_angle").alias("radius"))
    sizes.join(F.broadcast(named), CELL).coalesce(1).write.mode("overwrite").parquet(f"{path}/cells")
    return open_placed(spark, path, vid, vec)


def open_placed(spark: SparkSession, path: str, vid: str, vec: str = "embedding") -> PlacedVectors:
    fields = spark.read.parquet(f"{path}/schema").schema.fields
    schema = T.StructType([*fields, T.StructField(CELL, T.IntegerType())])
    return PlacedVectors(spark.read.schema(schema).parquet(f"{path}/vectors"), spark.read.parquet(f"{path}/cells"), vid, vec)


def _visits(index: PlacedVectors, queries: DataFrame, qid: str, vec: str, k: int, known: bool) -> DataFrame:
    """``qid, vec, _cell`` of the cells that a query has to read.

    At first the nearest cells with k vectors together; with ``known`` (a column ``_kth``, the k-th score so far, null if
    there are fewer) the other cells that can hold a vector at least as near.
    """
    cells = index.cells.orderBy(CELL).toArrow()  # MAX_CELLS rows at most
    numbers = [cells.column(c).to_numpy() for c in (CELL, "n", "radius")]
    centres = np.array(cells.column("centre").to_pylist() or [[0.0]])

    def visited(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cell, n, radius = numbers
        for batch in batches:
            for at in range(0, batch.num_rows if len(cell) else 0, 1024):
                part = batch.slice(at, 1024)
                units = unit_rows(part.column(vec), centres.shape[1])
                angle = np.arccos(np.clip(units @ centres.T, -1.0, 1.0))
                order = angle.argsort(axis=1, kind="stable")
                held = n[order].cumsum(axis=1)
                first = np.zeros(angle.shape, bool)
                np.put_along_axis(first, order, (held - n[order]) < k, axis=1)
                wanted = first
                if known:
                    kth = part.column("_kth").to_numpy(zero_copy_only=False).astype(float)
                    reach = np.where(np.isnan(kth), np.pi, np.arccos(np.clip(kth, -1.0, 1.0)))
                    zero = ~units.any(axis=1)  # a zero query has the score 0 with all vectors
                    near = (angle - radius <= reach[:, None] + SLACK) | zero[:, None]
                    # A zero vector lies at a right angle to its centre, but has the score 0 with every query.
                    near |= (radius >= np.pi / 2 - SLACK) & (reach[:, None] >= np.pi / 2 - SLACK)
                    wanted = near & ~first
                q, c = np.nonzero(wanted)
                out = part.select([qid, vec]).take(pa.array(q))
                yield pa.RecordBatch.from_arrays([*out.columns, pa.array(cell[c].astype("int32"))], names=[qid, vec, CELL])

    fields = [queries.schema[qid], queries.schema[vec], T.StructField(CELL, T.IntegerType())]
    return cut_lineage(queries.mapInArrow(visited, T.StructType(fields)))


def _compared(index: PlacedVectors, visits: DataFrame, qid: str, vec: str, k: int) -> DataFrame:
    """The k best of every query in every block of a cell that it visits: a join by cell and blocks."""
    asked = visits.groupBy(CELL).agg(F.ceil(F.count(F.lit(1)) / BLOCK_ROWS).cast("int").alias("_qbs"))
    blocks = index.cells.select(CELL, F.ceil(F.col("n") / BLOCK_ROWS).cast("int").alias("_vbs")).join(asked, CELL)
    blocks = F.broadcast(cut_lineage(blocks))
    opened = [r[0] for r in blocks.select(CELL).collect()]  # MAX_CELLS at most; the other folders are not read
    vid, own_vec = index.vid, index.vec

    def dealt(df: DataFrame, key: str, own: str, other: str, number: str, others: str) -> DataFrame:
        rows = df.join(blocks, CELL)
        mine = F.pmod(F.xxhash64(key), F.col(own)).cast("int").alias(number)
        every = F.explode(F.sequence(F.lit(0), F.col(other) - 1)).alias(others)
        return rows.select(*df.columns, mine, every)

    left = dealt(index.vectors.where(F.col(CELL).isin(opened)), vid, "_vbs", "_qbs", "_vb", "_qb")
    right = dealt(visits, qid, "_qbs", "_vbs", "_qb", "_vb")
    schema = T.StructType([visits.schema[qid], index.vectors.schema[vid], T.StructField("score", T.DoubleType())])

    def compare(vs: pa.Table, qs: pa.Table) -> pa.Table:
        names = [qid, vid, "score"]
        if not vs.num_rows or not qs.num_rows:
            return pa.table([qs.column(qid).slice(0, 0), vs.column(vid).slice(0, 0), pa.array([], pa.float64())], names=names)
        vs = by_id(vs, vid)
        rows = unit_rows(vs.column(own_vec))
        asked = unit_rows(qs.column(vec), rows.shape[1])
        ids, step = np.arange(len(rows)), max(1, SCORES // len(rows))
        found = []
        for at in range(0, len(asked), step):
            best = best_of(asked[at : at + step] @ rows.T, ids, k)
            best["q"] += at
            found.append(best)
        best = pd.concat(found)
        q, v = (pa.array(best[c].astype("int64")) for c in ("q", "id"))
        return pa.table([qs.column(qid).take(q), vs.column(vid).take(v), pa.array(best["score"])], names=names)

    group = [CELL, "_vb", "_qb"]
    return left.groupBy(*group).cogroup(right.groupBy(*group)).applyInArrow(compare, schema)


def placed_topk(index: PlacedVectors, queries: DataFrame, k: int, qid: str, vec: str = "embedding") -> DataFrame:
    """The ``k`` nearest stored vectors of every query by cosine: ``qid, vid, score, rank``. Exact.

    Query vectors stay in Spark: they meet the vectors of a cell in a join by cell, both sides cut into blocks
    of BLOCK_ROWS by hash, so neither a large cell nor a cell that all queries visit becomes one task. Only the
    folders of visited cells are opened. Queries without a vector have no hits; equal scores go by ``vid``.
    """
    if qid == index.vid:
        raise ValueError(f"rename the query id: the vectors have a column {qid} too")
    asked = queries.where(F.col(vec).isNotNull()).select(qid, vec)
    order = [F.desc("score"), F.asc(index.vid)]
    near = _visits(index, asked, qid, vec, k, known=False)
    first = cut_lineage(top_k_per_group(_compared(index, near, qid, vec, k), qid, order, k))
    kth = first.where(F.col("rank") == k).select(F.col(qid).alias("_of"), F.col("score").alias("_kth"))
    limits = asked.join(broadcast_if_small(kth), F.col(qid) == F.col("_of"), "left").drop("_of")
    rest = _visits(index, limits, qid, vec, k, known=True)
    both = first.drop("rank").unionByName(_compared(index, rest, qid, vec, k))
    return top_k_per_group(both, qid, order, k)


def visited_share(index: PlacedVectors, queries: DataFrame, k: int, qid: str, vec: str = "embedding") -> float:
    """Pairs of query and vector that ``placed_topk`` compares, as a share of all pairs."""
    asked = queries.where(F.col(vec).isNotNull()).select(qid, vec)
    first = _visits(index, asked, qid, vec, k, known=False)
    order = [F.desc("score"), F.asc(index.vid)]
    best = top_k_per_group(_compared(index, first, qid, vec, k), qid, order, k)
    kth = best.where(F.col("rank") == k).select(F.col(qid).alias("_of"), F.col("score").alias("_kth"))
    rest = _visits(index, asked.join(kth, F.col(qid) == F.col("_of"), "left").drop("_of"), qid, vec, k, known=True)
    pairs = first.unionByName(rest).join(F.broadcast(index.cells.select(CELL, "n")), CELL).agg(F.sum("n")).first()[0]
    every = asked.count() * index.cells.agg(F.sum("n")).first()[0]
    return (pairs or 0) / every if every else 0.0
