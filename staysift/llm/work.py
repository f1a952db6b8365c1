"""What the operators share: worker caches, Arrow helpers, group streaming, components."""

from __future__ import annotations

import sys
import types
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, functions as F

from staysift.session import cut_and_measure, cut_lineage


def once(key: str, make: Callable):
    """A value kept for the life of a Python worker, so that tasks after the first reuse it."""
    store = sys.modules.setdefault("_llm_worker_values", types.ModuleType("_llm_worker_values"))
    if key not in store.__dict__:
        store.__dict__[key] = make()
    return store.__dict__[key]


def forget(kept: str = "") -> None:
    """Drop the values of a reused worker whose key does not begin with ``kept``: those of earlier operators."""
    store = sys.modules.get("_llm_worker_values")
    for key in [k for k in vars(store or types.ModuleType("none")) if not k.startswith("__")]:
        if not kept or not key.startswith(kept):
            del store.__dict__[key]


def free_name(df: DataFrame, name: str) -> str:
    """``name``, with as many underscores before it as it takes to be no column of ``df`` in any case."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name = "_" + name
    return name


def by_bytes(batch: pa.RecordBatch, column: int | str, most: int = 2 << 20) -> Iterator[pa.RecordBatch]:
    """Slices of a batch with about ``most`` bytes in a text column each, or one row."""
    size = pc.fill_null(pc.binary_length(batch.column(column)), 0).to_numpy(zero_copy_only=False)
    part = np.cumsum(size) // most
    cuts = [0, *(np.flatnonzero(part[1:] != part[:-1]) + 1).tolist(), batch.num_rows]
    for a, b in zip(cuts, cuts[1:]):
        if b > a:
            yield batch.slice(a, b - a)


def texts_of(column: pa.Array) -> list[str]:
    """A text column as strings; null counts as empty."""
    return [t or "" for t in column.to_pylist()]


def numbers(column: pa.Array) -> np.ndarray:
    """An integer column without nulls as an array."""
    return column.to_numpy(zero_copy_only=False)


def text_bytes(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """UTF-8 bytes of a text column in one array, and the n + 1 offsets of the rows (null: empty)."""
    column = column.cast(pa.large_string()).fill_null("")
    if not len(column):
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    _, offsets, data = column.buffers()
    at = np.frombuffer(offsets, np.int64)[column.offset : column.offset + len(column) + 1]
    whole = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    return whole[at[0] : at[-1]], at - at[0]


def group_runs(
    batches: Iterator[pa.RecordBatch], keys: list[str], most: int = 0
) -> Iterator[tuple[pa.Table, bool]]:
    """Tables of whole groups from batches sorted by integer ``keys``, several groups at a time.

    The last group of a batch waits for the next one. With ``most``, a group is given out in
    parts once it has more rows than that; the flag tells that its last group goes on.
    """
    waiting: list[pa.Table] = []
    for batch in batches:
        if not batch.num_rows:
            continue
        waiting.append(pa.Table.from_batches([batch]))
        table = pa.concat_tables(waiting) if len(waiting) > 1 else waiting[0]
        same = np.ones(table.num_rows, bool)
        for k in keys:
            v = table[k].to_numpy()
            same &= v == v[-1]
        start = int(len(same) - np.argmin(same[::-1])) if not same.all() else 0
        if start:
            yield table.slice(0, start), False
        rest = table.slice(start)
        if most and rest.num_rows >= most:
            yield rest, True
            waiting = []
        else:
            waiting = [rest]
    if waiting and sum(t.num_rows for t in waiting):
        yield pa.concat_tables(waiting), False


def starts_of(table: pa.Table, keys: list[str]) -> np.ndarray:
    """First rows of the groups of a table sorted by ``keys``, and its number of rows at the end."""
    new = np.zeros(table.num_rows, bool)
    new[0] = True
    for k in keys:
        v = table[k].to_numpy()
        new[1:] |= v[1:] != v[:-1]
    return np.append(np.flatnonzero(new), table.num_rows)


class Union:
    """Union-find over the numbers below ``n``; the root of a set is its least number."""

    def __init__(self, n: int):
        self.up = list(range(n))

    def root(self, x: int) -> int:
        up = self.up
        while up[x] != x:
            up[x] = up[up[x]]
            x = up[x]
        return x

    def join(self, a: int, b: int) -> None:
        a, b = self.root(a), self.root(b)
        if a != b:
            self.up[max(a, b)] = min(a, b)


def components(links: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """``node`` and ``component`` (the least node reachable) of every node with a link.

    Labels fall to the least label next door, then to the label of the label, until none
    changes; the rounds grow with the logarithm of the longest path. Each round is written to
    the shared folder. A node with very many links is only ever the large side of a join
    (which adaptive execution splits) or of a partial minimum.
    """
    one = links.select(F.col(a).alias("a"), F.col(b).alias("b")).where("a != b")
    both = cut_lineage(one.union(one.select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct())
    labels = cut_lineage(
        both.groupBy(F.col("a").alias("node")).agg(F.min("b").alias("component"))
        .select("node", F.least("node", "component").alias("component"))
    )
    while True:
        near = (
            both.join(labels.select(F.col("node").alias("b"), "component"), "b")
            .groupBy(F.col("a").alias("node"))
            .agg(F.min("component").alias("near"))
        )
        lower = labels.join(near, "node").select(
            "node", F.col("component").alias("old"), F.least("component", "near").alias("low")
        )
        jump = labels.select(F.col("node").alias("low"), F.col("component").alias("up"))
        labels, seen = cut_and_measure(
            lower.join(jump, "low").select("node", "old", F.least("low", "up").alias("component")),
            changed=F.sum((F.col("old") != F.col("component")).cast("long")),
        )
        labels = labels.select("node", "component")
        if not seen["changed"]:
            return labels
