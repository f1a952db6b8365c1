"""Trie of conversation prefixes: z-fast tries of lots of conversations, expanded and merged by prefix.

A node is a distinct sequence of first turns. Its name is a hash of the sequence (122 bits, with its
length), which every task computes alike, so tries built apart from each other merge by name. A lot's
trie holds compacted nodes, each with a run of depths (low, high]; a hash table has every node under its handle, the
prefix at the two-fattest number of its run (the one divisible by the highest power of two). The exit node of a
conversation is found by binary search over such numbers.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window, functions as F

from staysift.operators.ranking import numbered
from staysift.session import cut_and_measure, cut_lineage

# Turns of a conversation that are hashed and inserted as one string; longer ones are cut.
SEGMENT = 128
# Distinct turns in the trie of a lot.
LOT = 50_000
# Conversations up to this length are ranked in one task; longer ones over ranges.
LONG = 4096
# Conversations that end at one node up to this number are listed in one piece.
LISTED = 10_000

# Polynomial hashes modulo a Mersenne prime, with two bases; turns count from 1, so lengths differ.
PRIME = (1 << 61) - 1
BASES = (0x1F3A5C7E9B2D4F61 % PRIME, 0x0B7D3E91C5A82F47 % PRIME)
MASK = PRIME


@dataclass(frozen=True)
class PrefixTrie:
    """nodes: conv (smallest member), depth, parent_conv, n_convs, n_children, n_leaves, saved, and the
    name (a, b) with the parent's (pa, pb). ends: conv, depth, a, b of the node where each conversation ends."""

    nodes: DataFrame
    ends: DataFrame


def positions(df: DataFrame, conv: str, order: list[Column], name: str, long: int = LONG) -> DataFrame:
    """All rows with their number in their conversation, from 1, by ``order``; rows of equal order in any.

    A conversation of more than ``long`` rows is numbered over ranges, not in one task.
    """
    counts = df.groupBy(conv).agg(F.count(F.lit(1)).alias("_rows")).where(F.col("_rows") > long)
    hot, seen = cut_and_measure(counts.select(conv))
    own = F.row_number().over(Window.partitionBy(conv).orderBy(*order)).cast("long")
    if not seen["rows"]:
        return df.withColumn(name, own)
    few = F.broadcast(hot) if seen["rows"] <= 100_000 else hot
    short = df.join(few, conv, "left_anti").withColumn(name, own)
    marked = df.withColumn("_id", F.monotonically_increasing_id()).join(few, conv, "left_semi")
    every = numbered(marked, conv, [*order, F.asc("_id")], name).drop("_id")
    return short.unionByName(every.withColumn(name, F.col(name).cast("long")))


def turn_digest(role: Column, text: Column) -> list[Column]:
    """Two 60-bit numbers, ``ta`` and ``tb``, of a role and a text without nulls."""
    digest = F.md5(F.concat(F.length(role).cast("string"), F.lit(":"), role, text))
    return [F.conv(F.substring(digest, k, 15), 16, 10).cast("long").alias(n) for k, n in ((1, "ta"), (16, "tb"))]


def two_fattest(low: int, high: int) -> int:
    """The number in (low, high] that is divisible by the highest power of two."""
    return high & (-1 << ((low ^ high).bit_length() - 1))


class Node:
    __slots__ = ("low", "high", "path", "parent", "count", "least", "rest")

    def __init__(self, low, high, path, parent):
        self.low, self.high, self.path, self.parent = low, high, path, parent
        self.count, self.least, self.rest = 0, None, 0


class Path:
    """A string of turns that begins at depth ``start``: names of its prefixes and sizes of its turns."""

    __slots__ = ("start", "names", "sizes")

    def __init__(self, start: int, names: list[int], sizes: list[int]):
        self.start, self.names, self.sizes = start, names, sizes

    def name(self, depth: int) -> int:
        return self.names[depth - self.start]

    @property
    def end(self) -> int:
        return self.start + len(self.names) - 1


class ZFastTrie:
    """Compacted trie of paths; paths may begin at any depth, below the node that their start names."""

    def __init__(self):
        self.handles: dict[tuple[int, int], Node] = {}
        self.edges: dict[tuple[int, int], Node] = {}
        self.roots: dict[tuple[int, int], Node] = {}

    def _enter(self, node: Node) -> None:
        f = two_fattest(node.low, node.high)
        self.handles[f, node.path.name(f)] = node

    def locate(self, path: Path) -> tuple[Node, int]:
        """The exit node of a path, and the depth down to which they agree."""
        key = (path.start, path.names[0])
        node = self.roots.get(key)
        if node is None:
            node = self.roots[key] = Node(path.start, path.start, path, None)
            return node, path.start
        low, high = path.start, path.end
        while low < high:
            f = two_fattest(low, high)
            found = self.handles.get((f, path.name(f)))
            if found is None:
                high = f - 1
            elif found.high <= path.end and found.path.name(found.high) == path.name(found.high):
                node, low = found, found.high
                high = max(high, low)
            else:
                return found, self._agree(found, path, f)
        if low < path.end:
            below = self.edges.get((low + 1, path.name(low + 1)))
            if below is not None:
                return below, self._agree(below, path, low + 1)
        return node, low

    @staticmethod
    def _agree(node: Node, path: Path, low: int) -> int:
        """Greatest depth at which a path and a node's run have the same prefix; they have it at ``low``."""
        high = min(node.high, path.end)
        while low < high:
            middle = (low + high + 1) // 2
            if node.path.name(middle) == path.name(middle):
                low = middle
            else:
                high = middle - 1
        return low

    def _split(self, node: Node, depth: int) -> Node:
        """Cut a node's run at ``depth``; the upper part is new, the lower keeps what hangs below."""
        upper = Node(node.low, depth, node.path, node.parent)
        self.edges[upper.low + 1, upper.path.name(upper.low + 1)] = upper
        node.low, node.parent = depth, upper
        self.edges[depth + 1, node.path.name(depth + 1)] = node
        self._enter(upper)
        self._enter(node)
        return upper

    def insert(self, path: Path) -> Node:
        """The node whose run ends where the path does, made if it is not there."""
        node, depth = self.locate(path)
        if depth < node.high:
            node = self._split(node, depth)
        if depth == path.end:
            return node
        leaf = Node(depth, path.end, path, node)
        self.edges[depth + 1, path.name(depth + 1)] = leaf
        self._enter(leaf)
        return leaf

    def expanded(self) -> Iterator[tuple]:
        """(depth, name, name above, count, least, size below, size) for every depth of every run.

        What paths brought to the nodes where they end is first handed up, deepest nodes first.
        """
        nodes = sorted(self.edges.values(), key=lambda n: -n.high)
        for n in nodes:
            up, sizes, first = n.parent, n.path.sizes, n.low - n.path.start
            up.count += n.count
            up.least = n.least if up.least is None else min(up.least, n.least)
            up.rest += n.rest + n.count * sum(sizes[first : n.high - n.path.start])
        for n in nodes:
            below = n.rest
            for depth in range(n.high, n.low, -1):
                below += n.count * n.path.sizes[depth - 1 - n.path.start]
                yield depth, n.path.name(depth), n.path.name(depth - 1), n.count, n.least, below


def _lots(strings: Iterator[tuple], most: int = LOT) -> Iterator[tuple]:
    """Nodes of lots of strings (conv, path, size behind it), equal strings folded before insertion."""

    def nodes(batch: dict) -> Iterator[tuple]:
        trie = ZFastTrie()
        for path, count, least, rest in batch.values():
            node = trie.insert(path)
            node.count += count
            node.least = least if node.least is None else min(node.least, least)
            node.rest += rest
        yield from trie.expanded()

    batch: dict = {}
    held = 0
    for conv, path, rest in strings:
        key = (path.start, path.names[0], path.end, path.names[-1])
        if key in batch:
            first, count, least, behind = batch[key]
            batch[key] = (first, count + 1, min(least, conv), behind + rest)
            continue
        batch[key] = (path, 1, conv, rest)
        held += len(path.sizes)
        if held >= most:
            yield from nodes(batch)
            batch, held = {}, 0
    yield from nodes(batch)


def _names(a: list[int], b: list[int], start: tuple[int, int]) -> list[int]:
    """Names of all prefixes of a string of turn digests, that of its start first; a name is 122 bits."""
    x, y = start
    names = [x << 61 | y]
    for ta, tb in zip(a, b):
        x = (x * BASES[0] + ta + 1) % PRIME
        y = (y * BASES[1] + tb + 1) % PRIME
        names.append(x << 61 | y)
    return names


SEGMENTS = "conv long, segment long, a array<long>, b array<long>, size array<long>"
STARTS = "conv long, segment long, sa long, sb long, behind long"


def _starts(segments: DataFrame, several: bool) -> DataFrame:
    """Segments with the hash before them (sa, sb) and the size of what follows them (behind)."""
    if not several:
        zero = F.lit(0).cast("long")
        return segments.select("*", zero.alias("sa"), zero.alias("sb"), zero.alias("behind"))

    def hashed(batches):
        import pyarrow as pa

        for batch in batches:
            rows = []
            for r in batch.to_pylist():
                last = _names(r["a"], r["b"], (0, 0))[-1]
                rows.append((r["conv"], r["segment"], len(r["a"]), last >> 61, last & MASK, sum(r["size"])))
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*rows)] if rows else [pa.array([], pa.int64())] * 6,
                                             names=["conv", "segment", "n", "ha", "hb", "size"])

    def started(batches):
        import pyarrow as pa
        from itertools import groupby

        def rows():
            for batch in batches:
                yield from zip(*[c.to_pylist() for c in batch.columns])

        out = []
        for conv, group in groupby(rows(), lambda r: r[0]):
            group = list(group)  # a few numbers for each SEGMENT turns
            x = y = 0
            behind = sum(r[5] for r in group)
            for _, segment, n, ha, hb, size in group:
                behind -= size
                out.append((conv, segment, x, y, behind))
                x = (x * pow(BASES[0], n, PRIME) + ha) % PRIME
                y = (y * pow(BASES[1], n, PRIME) + hb) % PRIME
            if len(out) > 10_000:
                yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*out)], names=["conv", "segment", "sa", "sb", "behind"])
                out = []
        if out:
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*out)], names=["conv", "segment", "sa", "sb", "behind"])

    sums = segments.select("conv", "segment", "a", "b", "size").mapInArrow(
        hashed, "conv long, segment long, n long, ha long, hb long, size long"
    )
    starts = sums.repartition("conv").sortWithinPartitions("conv", "segment").mapInArrow(started, STARTS)
    return segments.join(starts, ["conv", "segment"])


def _paths(segments: DataFrame) -> DataFrame:
    """``conv, segment, na, nb, size, below, behind``: names of all prefixes of a segment, from its start
    on, sizes of its turns, and for each turn the size of the conversation from it on."""

    def named(batches):
        import pyarrow as pa

        for batch in batches:
            rows = []
            for r in batch.to_pylist():
                names = _names(r["a"], r["b"], (r["sa"], r["sb"]))
                below, total = [], r["behind"]
                for size in reversed(r["size"]):
                    total += size
                    below.append(total)
                rows.append({"conv": r["conv"], "segment": r["segment"], "na": [n >> 61 for n in names],
                             "nb": [n & MASK for n in names], "size": r["size"], "below": below[::-1], "behind": r["behind"]})
            many = pa.list_(pa.int64())
            kinds = {"conv": pa.int64(), "segment": pa.int64(), "na": many, "nb": many, "size": many, "below": many, "behind": pa.int64()}
            yield pa.RecordBatch.from_pylist(rows, pa.schema(kinds))

    many = "array<long>"
    return segments.mapInArrow(
        named, f"conv long, segment long, na {many}, nb {many}, size {many}, below {many}, behind long"
    )


def _lot_nodes(paths: DataFrame) -> DataFrame:
    def built(batches):
        import pyarrow as pa

        def strings():
            for batch in batches:
                for r in batch.to_pylist():
                    names = [x << 61 | y for x, y in zip(r["na"], r["nb"])]
                    yield r["conv"], Path(r["segment"] * SEGMENT, names, r["size"]), r["behind"]

        out = []
        for depth, name, above, count, least, below in _lots(strings(), LOT):
            out.append((depth, name >> 61, name & MASK, above >> 61, above & MASK, count, least, below))
            if len(out) >= 10_000:
                yield table(out, pa)
                out = []
        yield table(out, pa)

    columns = ["depth", "a", "b", "pa", "pb", "n", "least", "below"]

    def table(rows, pa):
        data = zip(*rows) if rows else [[]] * len(columns)
        return pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in data], names=columns)

    return paths.select("conv", "segment", "na", "nb", "size", "behind").mapInArrow(
        built, ", ".join(f"{c} long" for c in columns)
    )


NAME = ["depth", "a", "b"]


def build_trie(turns: DataFrame, convs: DataFrame) -> PrefixTrie:
    """The trie of all conversations.

    ``turns``: conv (long), depth (long, 1, 2, ... without gaps in a conversation), role, text or the
    numbers ``ta``, ``tb`` of ``turn_digest`` and ``size`` in their place. ``convs``: conv, each once, also those
    without turns, which end at the root; turns of a conversation that is not there, or without
    one, take no part. Null roles and texts are empty, other columns are not read. Without a conversation there
    is no node.

    Segments of at most SEGMENT turns are named and put into the tries of lots; a lot gives one row a
    node, so a prefix that a third of all conversations share is summed up before it is shuffled. A node belongs
    to its smallest member. What is below a node is summed along the paths of those members: a leaf
    and every stretch of nodes belong to exactly one of them.
    """
    if "ta" not in turns.columns:
        role, text = (F.coalesce(F.col(c), F.lit("")) for c in ("role", "text"))
        turns = turns.select("conv", "depth", *turn_digest(role, text), F.length(text).cast("long").alias("size"))
    segment = F.floor((F.col("depth") - 1) / SEGMENT).cast("long").alias("segment")
    row = F.struct("depth", "ta", "tb", "size")
    listed = turns.groupBy("conv", segment).agg(F.sort_array(F.collect_list(row)).alias("rows"))
    listed = listed.select("conv", "segment", F.col("rows.ta").alias("a"), F.col("rows.tb").alias("b"), F.col("rows.size").alias("size"))
    segments, seen = cut_and_measure(listed, last=F.max("segment"))
    paths = cut_lineage(_paths(_starts(segments, bool(seen["last"]))))

    merged = _lot_nodes(paths).groupBy(*NAME).agg(
        F.first("pa").alias("pa"), F.first("pb").alias("pb"),
        F.sum("n").alias("n_convs"), F.min("least").alias("conv"), F.sum("below").alias("below"),
    )
    zero = F.lit(0).cast("long")
    tops = paths.where("segment = 0").select(F.lit(None).cast("long").alias("conv"), F.element_at("below", 1).alias("below"))
    every = convs.select("conv", zero.alias("below")).unionByName(tops)
    root = every.agg(F.count("conv").alias("n_convs"), F.min("conv").alias("conv"), F.sum("below").alias("below"))
    root = root.where("n_convs > 0").select(
        *[zero.alias(c) for c in NAME], F.lit(None).cast("long").alias("pa"), F.lit(None).cast("long").alias("pb"),
        "n_convs", "conv", "below",
    )
    nodes = cut_lineage(merged.unionByName(root))

    up = nodes.where("depth > 0").groupBy((F.col("depth") - 1).alias("depth"), F.col("pa").alias("a"), F.col("pb").alias("b"))
    children = up.agg(F.count(F.lit(1)).alias("n_children"))
    nodes = cut_lineage(nodes.join(children, NAME, "left").withColumn("n_children", F.coalesce("n_children", zero)))

    owners = nodes.groupBy("conv").agg(
        F.min("depth").alias("own"), F.max((F.col("n_children") == 0).cast("long")).alias("leaf")
    )
    start = F.col("segment") * SEGMENT
    # The stretch of nodes that belongs to a conversation begins in one of its segments, or at the root.
    first = F.greatest("own", F.lit(1))
    stretch = paths.join(owners, "conv").where((first > start) & (first <= start + F.size("size")))
    stretch = stretch.select("conv", F.element_at("below", (first - start).cast("int")).alias("owned"))
    owners = cut_lineage(owners.join(stretch, "conv", "left").withColumn("owned", F.coalesce("owned", zero)))
    zipped = F.arrays_zip(*[F.slice(c, n, SEGMENT).alias(c) for c, n in (("na", 2), ("nb", 2), ("below", 1))])
    walked = paths.join(owners, "conv").select(start.alias("start"), "leaf", "own", "owned", F.posexplode(zipped).alias("at", "turn"))
    depth = (F.col("start") + F.col("at") + 1).alias("depth")
    # From the first node that it owns on, a conversation owns all that is left of it; above, the whole stretch counts.
    ours = F.when(depth >= F.col("own"), F.col("turn.below")).otherwise(F.col("owned"))
    sums = walked.select(depth, F.col("turn.na").alias("a"), F.col("turn.nb").alias("b"), "leaf", ours.alias("ours"))
    at_root = owners.select(*[zero.alias(c) for c in NAME], "leaf", F.col("owned").alias("ours"))
    sums = sums.unionByName(at_root).groupBy(*NAME).agg(F.sum("leaf").alias("n_leaves"), F.sum("ours").alias("ours"))

    above = nodes.select((F.col("depth") + 1).alias("depth"), F.col("a").alias("pa"), F.col("b").alias("pb"), F.col("conv").alias("parent_conv"))
    full = nodes.join(sums, NAME, "left").join(above, ["depth", "pa", "pb"], "left")
    full = full.select("conv", "depth", "parent_conv", "n_convs", "n_children", "n_leaves", (F.col("below") - F.col("ours")).alias("saved"), "a", "b", "pa", "pb")

    last = paths.groupBy("conv").agg(F.max("segment").alias("segment"))
    stop = paths.join(last, ["conv", "segment"]).select(
        "conv", (start + F.size("size")).alias("depth"), F.element_at("na", -1).alias("a"), F.element_at("nb", -1).alias("b")
    )
    ends = convs.select("conv").join(stop, "conv", "left").select("conv", *[F.coalesce(c, zero).alias(c) for c in NAME])
    return PrefixTrie(cut_lineage(full), cut_lineage(ends))


def end_digests(trie: PrefixTrie, listed: int = LISTED) -> DataFrame:
    """``depth, a, b, ends_sha256``: SHA-256 of the conversations that end at a node, ascending, joined by commas.

    Up to ``listed`` they make one list. More are numbered over ranges and listed in pieces, and one task
    reads the pieces in order, as a digest has no parts.
    """
    counts = trie.ends.groupBy(*NAME).agg(F.count(F.lit(1)).alias("_n")).where(F.col("_n") > listed)
    hot, seen = cut_and_measure(counts.select(*NAME))
    few = F.broadcast(hot) if seen["rows"] <= 100_000 else hot
    joined = F.array_join(F.sort_array(F.collect_list("conv")), ",")
    short = trie.ends.join(few, NAME, "left_anti") if seen["rows"] else trie.ends
    short = short.groupBy(*NAME).agg(F.sha2(joined, 256).alias("ends_sha256"))
    if not seen["rows"]:
        return short
    every = numbered(trie.ends.join(few, NAME, "left_semi"), NAME, [F.asc("conv")], "_number")
    pieces = every.groupBy(*NAME, F.floor((F.col("_number") - 1) / listed).alias("piece")).agg(joined.alias("list"))

    def digested(batches):
        import hashlib

        import pyarrow as pa
        from itertools import groupby

        def rows():
            for batch in batches:
                for at in range(batch.num_rows):
                    yield tuple(c[0].as_py() for c in batch.slice(at, 1).columns)

        for key, group in groupby(rows(), lambda r: r[:3]):
            digest = hashlib.sha256()
            for k, r in enumerate(group):
                digest.update((b"," if k else b"") + r[4].encode())
            names = [*NAME, "ends_sha256"]
            yield pa.RecordBatch.from_arrays([pa.array([v]) for v in (*key, digest.hexdigest())], names=names)

    placed = pieces.repartition(*NAME).sortWithinPartitions(*NAME, "piece")
    return short.unionByName(placed.mapInArrow(digested, "depth long, a long, b long, ends_sha256 string"))
