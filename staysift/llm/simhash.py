"""SimHash near-duplicates: 64-bit fingerprints, linked through BK-trees of bounded shards."""

from __future__ import annotations

from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from staysift.llm.work import Union, components, forget, free_name, group_runs, starts_of, texts_of
from staysift.operators.ranking import top_k_per_group
from staysift.session import cut_and_measure, cut_lineage

BITS = 64
RADIUS = 4
SHINGLE = 4
# Expected fingerprints per shard that decide on the number of blocks, and the most in one tree.
SHARD, TREE = 64, 4096


def fingerprint(text: str, shingle: int = SHINGLE) -> int:
    """SimHash of a text: a bit is set if it is set in over half the shingles' XXH64 (seed 42)."""
    import xxhash

    words = text.encode().lower().split()  # bytes: A-Z only, ASCII white space only
    if not words:
        return 0
    n = max(1, len(words) - shingle + 1)
    joined, digest = b" ".join(words), xxhash.xxh64_intdigest
    if n == 1:
        return digest(joined, 42)
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1) - 1
    starts = np.append(0, ends[:-1] + 1)[:n].tolist()
    hashes = np.fromiter(
        [digest(joined[i:j], 42) for i, j in zip(starts, ends[shingle - 1 :].tolist())], "<u8", n
    )
    counts = np.zeros(BITS, np.int64)
    for i in range(0, n, 1 << 14):  # very long texts in parts
        part = hashes[i : i + (1 << 14)].view(np.uint8).reshape(-1, 8)
        counts += np.unpackbits(part, axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return sum(1 << int(b) for b in np.flatnonzero(2 * counts > n))


def fingerprints(df: DataFrame, text: str, *keep: str) -> DataFrame:
    """The columns ``keep`` and ``fp``, the fingerprint as a signed long, for each row of ``df``.

    A null or empty text has fingerprint zero; other columns are not read.
    """

    def rows(batches):
        forget()
        for batch in batches:
            fps = [fingerprint(t) for t in texts_of(batch.column(0))]
            fps = pa.array(np.array(fps, np.uint64).view(np.int64))
            yield pa.RecordBatch.from_arrays([*batch.columns[1:], fps], names=[*keep, "fp"])

    picked = df.select(text, *keep)
    kinds = dict(picked.dtypes)
    schema = ", ".join([*[f"`{k}` {kinds[k]}" for k in keep], "fp long"])
    return picked.mapInArrow(rows, schema)


def block_masks(rows: int, radius: int = RADIUS) -> list[int]:
    """Masks of the bits that a shard's fingerprints share, one mask per table.

    Two fingerprints with at most ``radius`` differing bits agree on all but ``radius`` of the
    blocks, so some table puts them into one shard, whatever the number of blocks. More rows
    get more blocks: longer shared parts, more tables, shards of the same size.
    """
    blocks = radius + 1
    while blocks < radius + 5 and rows / 2 ** (BITS * (blocks - radius) / blocks) > SHARD:
        blocks += 1
    edges = [round(BITS * i / blocks) for i in range(blocks + 1)]
    parts = [((1 << b) - 1) ^ ((1 << a) - 1) for a, b in zip(edges, edges[1:])]
    return [sum(c) for c in combinations(parts, blocks - radius)]


class BKTree:
    """Burkhard-Keller tree over integers: children are keyed by the distance to their parent."""

    def __init__(self):
        self.values: list[int] = []
        self.children: list[dict[int, int]] = []

    def add(self, value: int) -> None:
        new = len(self.values)
        self.values.append(value)
        self.children.append({})
        at = 0
        while new:
            d = (value ^ self.values[at]).bit_count()
            down = self.children[at].setdefault(d, new)
            if down == new:
                return
            at = down

    def near(self, value: int, radius: int) -> list[int]:
        """Numbers of the values within the radius: only edges that can lead to one are followed."""
        found, todo = [], [0] if self.values else []
        values, children = self.values, self.children
        while todo:
            at = todo.pop()
            d = (value ^ values[at]).bit_count()
            if d <= radius:
                found.append(at)
            for edge, child in children[at].items():
                if -radius <= edge - d <= radius:
                    todo.append(child)
        return found


def tree_links(own: list[int], other: list[int], radius: int) -> list[tuple[int, int]]:
    """A spanning forest of the links between ``own`` and ``other`` (or within ``own`` if empty)."""
    tree, sets = BKTree(), Union(len(own) + len(other))
    for i, value in enumerate(own):
        if not other:
            for j in tree.near(value, radius):
                sets.join(j, i)
        tree.add(value)
    for i, value in enumerate(other, len(own)):
        for j in tree.near(value, radius):
            sets.join(j, i)
    every = own + other
    return [(every[i], every[r]) for i in range(len(every)) if (r := sets.root(i)) != i]


def hamming_links(
    values: DataFrame, rows: int, radius: int = RADIUS, tree: int = TREE
) -> DataFrame:
    """Links ``a``, ``b`` that connect whatever lies within ``radius`` bits among distinct ``fp``.

    Shards are cut by shared blocks of bits. A shard with more than ``tree`` fingerprints is cut
    into numbered parts, and every two parts meet in a task of their own (one part's tree, the
    other part's queries), so no task holds more than two parts and no pair is left out. What
    goes out is a spanning forest of each task's links, never all pairs.
    """
    masks = block_masks(rows, radius)
    signed = [m - (1 << BITS) if m >> (BITS - 1) else m for m in masks]
    keyed = values.select(
        "fp", F.posexplode(F.array(*[F.col("fp").bitwiseAND(F.lit(m)) for m in signed])).alias("t", "k")
    )
    sizes = keyed.groupBy("t", "k").agg(F.count(F.lit(1)).alias("n")).where("n > 1")
    parts = F.ceil(F.col("n") / tree).cast("int")
    placed = keyed.join(sizes, ["t", "k"]).select(
        "t", "k", "fp",
        F.pmod(F.xxhash64("fp", "t"), parts).cast("int").alias("part"),
        F.explode(F.sequence(F.lit(0), parts - 1)).alias("other"),
    )
    tasks = placed.select(
        "t", "k", F.least("part", "other").alias("i"), F.greatest("part", "other").alias("j"),
        (F.col("part") > F.col("other")).cast("int").alias("side"), "fp",
    )
    keys = ["t", "k", "i", "j"]

    def link(batches):
        for table, _ in group_runs(batches, keys):
            cuts = starts_of(table, keys).tolist()
            side = table["side"].to_numpy()
            fps = table["fp"].to_numpy().view(np.uint64).tolist()
            inner = (table["i"].to_numpy() == table["j"].to_numpy()).tolist()
            out = []
            for a, b in zip(cuts, cuts[1:]):
                if inner[a]:
                    out += tree_links(fps[a:b], [], radius)
                    continue
                m = a + int(np.searchsorted(side[a:b], 1))
                if a < m < b:
                    out += tree_links(fps[a:m], fps[m:b], radius)
            if out:
                pairs = np.array(out, np.uint64).view(np.int64)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(pairs[:, 0]), pa.array(pairs[:, 1])], names=["a", "b"]
                )

    sorted_tasks = tasks.repartition(*keys).sortWithinPartitions(*keys, "side", "fp")
    return sorted_tasks.mapInArrow(link, "a long, b long")


def _grouped(df: DataFrame, key: str, text: str, radius: int, tree: int) -> DataFrame:
    """``_key``, ``_hash`` (of the text), ``fp``, ``component`` and ``component_id`` of every row."""
    rows = df.select(
        F.col(key).alias("_key"), F.col(text).alias("_text"), F.xxhash64(text).alias("_hash")
    )
    prints = cut_lineage(fingerprints(rows, "_text", "_key", "_hash"))
    distinct, seen = cut_and_measure(prints.groupBy("fp").agg(F.min("_key").alias("least")))
    nodes = components(hamming_links(distinct.select("fp"), seen["rows"], radius, tree))
    joined = distinct.join(nodes.withColumnRenamed("node", "fp"), "fp", "left").select(
        "fp", F.coalesce("component", "fp").alias("component"), "least"
    )
    lowest = joined.groupBy("component").agg(F.min("least").alias("component_id"))
    by_print = cut_lineage(joined.select("fp", "component").join(lowest, "component"))
    return prints.join(by_print, "fp")


def near_duplicates(
    df: DataFrame, key: str = "doc_id", text: str = "text", radius: int = RADIUS, tree: int = TREE
) -> DataFrame:
    """``key``, ``fp`` and ``component_id`` (the smallest key reachable over links) of every row.

    Fingerprints with at most ``radius`` differing bits link, so equal ones do. Null and empty
    texts have fingerprint zero and link like any other. Rows with a null key take part; a
    component of only such rows has a null ``component_id``. Repeated rows stay repeated. Other
    columns are not read, so their names do not matter. An empty table gives no rows.
    """
    found = _grouped(df, key, text, radius, tree)
    return found.select(F.col("_key").alias(key), "fp", "component_id")


def keep_one(
    df: DataFrame, key: str = "doc_id", text: str = "text", radius: int = RADIUS, tree: int = TREE
) -> DataFrame:
    """The rows of ``df`` without near-duplicates, all columns: one row of each component stays.

    It is the row with the smallest key (null keys last; of a repeated key one of the rows with
    the smallest text hash, and of equal rows one).
    """
    found = _grouped(df, key, text, radius, tree)
    chosen = (
        found.groupBy("component")
        .agg(F.min(F.struct(F.col("_key").isNull().alias("none"), "_key", "_hash")).alias("best"))
        .select(F.col("best._key").alias("_key"), F.col("best._hash").alias("_hash"))
        .distinct()
    )
    hashed, copy = free_name(df, "_hash"), free_name(df, "_copy")
    rows = df.withColumn(hashed, F.xxhash64(text))
    kept = rows.join(
        chosen, rows[key].eqNullSafe(chosen["_key"]) & (rows[hashed] == chosen["_hash"]), "left_semi"
    )
    return top_k_per_group(kept, [key, hashed], [F.col(hashed)], 1, copy).drop(copy, hashed)
