"""Near-duplicate vectors: sorted passes over random projections, then exact counts of links."""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window, functions as F

from staysift.llm.topk import finite
from staysift.llm.work import Union, components, group_runs, numbers, starts_of
from staysift.session import broadcast_if_small, cut_and_measure, cut_lineage

THRESHOLD = 0.98
# Neighbours compared after each vector, rows multiplied at once, members in one part of a group.
WINDOW, LOT, PART = 32, 512, 2048
BITS = 64
SEED = 20
# Chance that a pair at the threshold itself is missed by all passes.
MISS = 1e-5
# Leading bits that a run may share, vectors of a group and passes that measure its runs, and how
# many compared pairs cost as much as one row of a pass.
DEPTHS, SAMPLE, TRIED, ROW_COST = range(4, 61, 4), 4096, 2, 500


def passes_for(bits: int, threshold: float = THRESHOLD) -> int:
    """Passes after which a pair at the threshold shared ``bits`` leading bits but for the chance MISS.

    One random hyperplane parts the two with a chance of their angle / pi, whatever lies around them.
    """
    met = (1 - math.acos(threshold) / math.pi) ** bits
    return min(1 << 30, max(8, math.ceil(math.log(MISS) / math.log1p(-met)))) if met < 1 else 8


def bits_for(passes: int, threshold: float = THRESHOLD) -> int:
    """The most leading bits that ``passes`` passes allow with the same chance."""
    met = 1 - MISS ** (1 / passes)
    part = 1 - math.acos(threshold) / math.pi
    return min(BITS, int(math.log(met) / math.log(part))) if part < 1 else BITS


def sign_keys(unit: np.ndarray, number: int) -> np.ndarray:
    """64 sign bits of random projections, first bit most significant, as signed longs in that order."""
    planes = np.random.default_rng([SEED, number, unit.shape[1]]).standard_normal((BITS, unit.shape[1]))
    bits = np.packbits(unit @ planes.T > 0, axis=1)
    return bits.view(">u8").ravel().astype(np.uint64).view(np.int64) ^ np.int64(-(2**63))


def units(column: pa.Array, dim: int) -> np.ndarray:
    """Vectors of one length, scaled to length one in double precision (large numbers first tamed)."""
    flat = column.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(-1, dim)
    flat = flat / np.abs(flat).max(axis=1, keepdims=True)
    return flat / np.linalg.norm(flat, axis=1, keepdims=True)


def window_links(ids: np.ndarray, unit: np.ndarray, old: int, window: int, threshold: float):
    """Forest of links among sorted neighbours; the first ``old`` rows were compared before."""
    near = unit[old:] @ unit.T >= threshold
    row, column = np.nonzero(near)
    row += old
    keep = (column < row) & (row - column <= window)
    sets = Union(len(ids))
    for a, b in zip(row[keep].tolist(), column[keep].tolist()):
        sets.join(a, b)
    root = np.array([sets.root(i) for i in range(len(ids))])
    linked = np.flatnonzero(root != np.arange(len(ids)))
    return ids[linked], ids[root[linked]]


def tile_links(ids: np.ndarray, unit: np.ndarray, rows: int, columns: int, threshold: float):
    """Forest of links between the first ``rows`` vectors and those from ``columns`` on."""
    label = np.arange(len(ids))
    for i in range(0, rows, LOT):
        near = unit[i : min(rows, i + LOT)] @ unit[columns:].T >= threshold
        for r in np.flatnonzero(near.any(axis=1)):
            met = np.append(label[columns:][near[r]], label[i + r])
            if (met != met[-1]).any():
                met = np.unique(met)
                label[np.isin(label, met)] = met[0]
    linked = np.flatnonzero(label != np.arange(len(ids)))
    return ids[linked], ids[label[linked]]


def _passes(vectors: DataFrame, vec: bool = True) -> DataFrame:
    """A row per vector and pass, with its sign bits and its run (the leading ``bits`` of them).

    ``vectors`` has ``id``, ``label``, ``vec``, ``bits`` and ``passes``; without ``vec`` the
    vectors themselves are left out.
    """

    def rows(batches):
        for batch in batches:
            size = np.array([len(v) for v in batch.column(2)])
            for dim in np.unique(size):
                part = batch.take(pa.array(np.flatnonzero(size == dim)))
                unit = units(part.column(2), int(dim))
                bits, passes = numbers(part.column(3)), numbers(part.column(4))
                for p in range(passes.max()):
                    at = np.flatnonzero(passes > p)
                    some = part.take(pa.array(at))
                    keys = sign_keys(unit[at], p)
                    run = np.where(bits[at] > 0, keys >> np.minimum(BITS - bits[at], BITS - 1), 0)
                    columns = [pa.array(np.full(len(at), p)), some.column(1), pa.array(np.full(len(at), dim)),
                               pa.array(keys), pa.array(run), some.column(0)]
                    names = ["pass", "label", "dim", "key", "run", "id", "vec"]
                    if vec:
                        columns.append(some.column(2))
                    yield pa.RecordBatch.from_arrays(columns, names=names[: len(columns)])

    kinds = dict(vectors.dtypes)
    schema = f"pass long, label {kinds['label']}, dim long, key long, run long, id long"
    picked = vectors.select("id", "label", "vec", F.col("bits").cast("long"), F.col("passes").cast("long"))
    return picked.mapInArrow(rows, f"{schema}, vec {kinds['vec']}" if vec else schema)


def _planned(vectors: DataFrame, threshold: float, window: int) -> DataFrame:
    """``vectors`` with ``bits`` and ``passes`` of their label and length, by how dense its runs are.

    The pairs within runs of each of DEPTHS bits are counted on about SAMPLE vectors of a group in
    TRIED passes. Longer runs need more passes and leave fewer pairs; the cheapest depth is taken.
    The chance MISS holds at every depth, so the sample decides on time alone.
    """
    sized = vectors.withColumn("dim", F.size("vec").cast("long"))
    groups = cut_lineage(sized.groupBy("label", "dim").agg(F.count(F.lit(1)).alias("n")))
    few = broadcast_if_small(groups)
    rate = F.least(F.lit(1.0), SAMPLE / F.col("n"))
    drawn = sized.join(few, ["label", "dim"]).where(F.pmod(F.xxhash64("id"), F.lit(1 << 30)) < rate * (1 << 30))
    tried = _passes(drawn.select("id", "label", "vec", F.lit(1).alias("bits"), F.lit(TRIED).alias("passes")), False)
    runs = tried.select(
        "label", "dim", "pass", F.explode(F.array(*map(F.lit, DEPTHS))).alias("bits"), "key"
    ).groupBy("label", "dim", "pass", "bits", F.expr(f"shiftright(key, {BITS} - bits)").alias("run"))
    pairs = (
        runs.agg(F.count(F.lit(1)).cast("double").alias("c"))
        .groupBy("label", "dim", "bits")
        .agg((F.sum(F.col("c") * (F.col("c") - 1)) / TRIED).alias("pairs"))
    )
    passes = F.create_map(*[F.lit(x) for d in DEPTHS for x in (d, passes_for(d, threshold))])
    whole = F.col("pairs") / (rate * rate)
    # A row of a run beyond the window is shuffled again for the tiles.
    dense = F.least(F.lit(1.0), whole / (F.col("n") * window))
    cost = F.col("passes") * (F.col("n") * ROW_COST * (1 + 2 * dense) + whole)
    best = (
        groups.join(pairs, ["label", "dim"])
        .withColumn("passes", passes[F.col("bits")])
        .groupBy("label", "dim")
        .agg(F.min(F.struct(cost.alias("cost"), "bits", "passes")).alias("best"))
        .select("label", "dim", "best.bits", "best.passes")
    )
    best = broadcast_if_small(cut_lineage(best))
    first = F.lit(DEPTHS[0])  # a group without a drawn vector is a small one
    return sized.join(best, ["label", "dim"], "left").select(
        "id", "label", "vec", F.coalesce("bits", first).alias("bits"),
        F.coalesce("passes", F.lit(passes_for(DEPTHS[0], threshold))).alias("passes"),
    )


def _run_links(planned: DataFrame, window: int, threshold: float, part: int) -> DataFrame:
    """Links within every run of more rows than a window reaches, compared in full.

    A run is cut into parts of about ``part`` rows, and every two parts meet in a task of their
    own as one matrix product; a spanning forest of each task's links goes out.
    """
    names = ["pass", "label", "dim", "run"]
    kept = _passes(planned, False).select(*names, "id")
    large, seen = cut_and_measure(
        kept.groupBy(*names).agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > window + 1)
    )
    large = broadcast_if_small(large, rows=seen["rows"])
    parts = F.ceil(F.col("n") / part).cast("int")
    placed = kept.join(large, names).select(
        *names, "id", F.pmod(F.xxhash64("id", "pass"), parts).cast("int").alias("own"),
        F.explode(F.sequence(F.lit(0), parts - 1)).alias("other"),
    )
    tasks = placed.select(
        *names, F.least("own", "other").alias("i"),
        F.greatest("own", "other").alias("j"), (F.col("own") > F.col("other")).cast("int").alias("side"), "id",
    ).join(planned.select("id", "vec"), "id")
    keys = [*names, "i", "j"]

    def link(batches):
        for table, _ in group_runs(batches, keys):
            cuts = starts_of(table, keys)
            side, ids = table["side"].to_numpy(), table["id"].to_numpy()
            inner = table["i"].to_numpy() == table["j"].to_numpy()
            vectors = table["vec"].combine_chunks()
            vectors = vectors.chunk(0) if isinstance(vectors, pa.ChunkedArray) else vectors
            for a, b in zip(cuts, cuts[1:]):
                m = b - a if inner[a] else int(np.searchsorted(side[a:b], 1))
                if not m or not inner[a] and m == b - a:
                    continue
                unit = units(vectors.slice(a, b - a), len(vectors[a]))
                found = tile_links(ids[a:b], unit, m, 0 if inner[a] else m, threshold)
                if len(found[0]):
                    yield pa.RecordBatch.from_arrays([pa.array(found[0]), pa.array(found[1])], names=["a", "b"])

    picked = tasks.select(*keys, "side", "id", "vec")
    ordered = picked.repartition(*keys).sortWithinPartitions(*keys, "side", "id")
    return ordered.mapInArrow(link, "a long, b long")


def _sorted_links(keyed: DataFrame, window: int, threshold: float) -> DataFrame:
    """Links of neighbours in the sorted passes, by range partitions; borders are joined after.

    A task streams its sorted rows and keeps the last ``window`` of them. It also gives out its
    first and last rows, and each task's last rows meet the next one's first rows.
    """
    columns = ["pass", "label", "dim", "key", "id"]
    kinds = dict(keyed.dtypes)
    edge = "part long, side int, place int, pass long, dim long, same long, id long, vec binary"

    def streamed(batches):
        part = TaskContext.get().partitionId()
        names = ["a", "b", *[c.split()[0] for c in edge.split(", ")]]

        def links(a, b):
            gaps = [pa.nulls(len(a), t) for t in kept_types]
            return pa.RecordBatch.from_arrays([pa.array(a), pa.array(b), *gaps], names=names)

        def border(side, rows):
            if not rows:
                return
            columns = [[part] * len(rows), [side] * len(rows), list(range(len(rows))),
                       *zip(*[(p, d, s, i, u.tobytes()) for p, d, s, i, u in rows])]
            yield pa.RecordBatch.from_arrays(
                [pa.nulls(len(rows), pa.int64())] * 2
                + [pa.array(c, t) for c, t in zip(columns, kept_types)],
                names=names,
            )

        first, last, state = [], [], None
        for batch in batches:
            label = batch.column(1).to_numpy(zero_copy_only=False).astype(np.int64)
            pass_, dim, ids = (numbers(batch.column(i)) for i in (0, 2, 5))
            new = np.ones(len(ids), bool)
            new[1:] = (pass_[1:] != pass_[:-1]) | (label[1:] != label[:-1]) | (dim[1:] != dim[:-1])
            cuts = np.append(np.flatnonzero(new), len(ids))
            for a, b in zip(cuts, cuts[1:]):
                group = (pass_[a], label[a], dim[a])
                if state is None or state[0] != group:
                    state = [group, np.zeros(0, np.int64), np.zeros((0, dim[a]))]
                unit = units(batch.column(6).slice(a, b - a), int(dim[a]))
                for i in range(0, b - a, LOT):
                    both = np.append(state[1], ids[a:b][i : i + LOT])
                    rows = np.vstack([state[2], unit[i : i + LOT]])
                    found = window_links(both, rows, len(state[1]), window, threshold)
                    if len(found[0]):
                        yield links(*found)
                    state[1], state[2] = both[-window:], rows[-window:]
                edge_rows = [
                    (int(pass_[a]), int(dim[a]), int(label[a]), int(i), u)
                    for i, u in zip(ids[a:b][:window], unit[:window])
                ]
                first += edge_rows[: max(0, window - len(first))]
                tail = [
                    (int(pass_[a]), int(dim[a]), int(label[a]), int(i), u)
                    for i, u in zip(ids[a:b][-window:], unit[-window:])
                ]
                last = (last + tail)[-window:]
        yield from border(1, first)
        yield from border(0, last)

    kept_types = [pa.int64(), pa.int32(), pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.binary()]
    assert kinds["label"] in ("int", "bigint", "smallint", "tinyint"), "labels are integers"
    ordered = keyed.repartitionByRange(*columns).sortWithinPartitions(*columns)
    both = cut_lineage(ordered.mapInArrow(streamed, f"a long, b long, {edge}"))
    inner = both.where("a IS NOT NULL").select("a", "b")
    borders = both.where("a IS NULL").drop("a", "b")
    # One row per task, to number the tasks that had rows.
    parts = borders.select("part").distinct().withColumn("number", F.row_number().over(Window.orderBy("part")))
    placed = borders.join(parts, "part").withColumn("border", F.col("number") - F.col("side"))

    def across(batches):
        for table, _ in group_runs(batches, ["border"]):
            cuts = starts_of(table, ["border"])
            for a, b in zip(cuts, cuts[1:]):
                rows = table.slice(a, b - a)
                same = [tuple(x) for x in zip(*(rows[c].to_pylist() for c in ("pass", "dim", "same")))]
                for group in set(same):
                    at = [i for i, s in enumerate(same) if s == group]
                    unit = np.vstack([np.frombuffer(rows["vec"][i].as_py()) for i in at])
                    ids = rows["id"].to_numpy()[at]
                    found = window_links(ids, unit, 0, window, threshold)
                    if len(found[0]):
                        yield pa.RecordBatch.from_arrays([pa.array(found[0]), pa.array(found[1])], names=["a", "b"])

    sort = ["border", "side", "place"]
    met = placed.repartition("border").sortWithinPartitions(*sort).mapInArrow(across, "a long, b long")
    return inner.union(met)


def link_counts(members: DataFrame, threshold: float = THRESHOLD, part: int = PART) -> DataFrame:
    """``id`` and ``n_links``: for each of ``id``, ``component``, ``vec``, ``copies`` the exact number
    of linked members of its component; a vector of several copies stands for all of them.

    A component is cut into parts of about ``part`` members, and every two parts meet in a task of
    their own as one matrix product; only counts go out.
    """
    sizes = members.groupBy("component").agg(F.ceil(F.count(F.lit(1)) / part).cast("int").alias("parts"))
    placed = members.join(sizes, "component").withColumn("own", F.pmod(F.xxhash64("id"), F.col("parts")).cast("int"))
    tasks = placed.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("parts") - 1))).select(
        "component", F.least("own", "other").alias("i"), F.greatest("own", "other").alias("j"),
        (F.col("own") > F.col("other")).cast("int").alias("side"), "id", "vec", "copies",
    )
    keys = ["component", "i", "j"]

    def count(batches):
        for table, _ in group_runs(batches, keys):
            cuts = starts_of(table, keys)
            side, ids, copies = (table[c].to_numpy() for c in ("side", "id", "copies"))
            inner = table["i"].to_numpy() == table["j"].to_numpy()
            vectors = table["vec"].combine_chunks()
            vectors = vectors.chunk(0) if isinstance(vectors, pa.ChunkedArray) else vectors
            out_ids, out_n = [], []
            for a, b in zip(cuts, cuts[1:]):
                dim = len(vectors[a])
                unit = units(vectors.slice(a, b - a), dim)
                m = b - a if inner[a] else int(np.searchsorted(side[a:b], 1))
                rows, columns = unit[:m], unit if inner[a] else unit[m:]
                left, right = copies[a : a + m], copies[a:b] if inner[a] else copies[a + m : b]
                down, across = np.zeros(len(rows), np.int64), np.zeros(len(columns), np.int64)
                for i in range(0, len(rows), LOT):
                    near = rows[i : i + LOT] @ columns.T >= threshold
                    if inner[a]:
                        near[np.arange(len(near)), i + np.arange(len(near))] = False
                    down[i : i + LOT] = near @ right
                    across += left[i : i + LOT] @ near
                out_ids.append(ids[a:b])
                # Of its own copies a vector meets all but itself.
                out_n.append(down + left - 1 if inner[a] else np.append(down, across))
            yield pa.RecordBatch.from_arrays(
                [pa.array(np.concatenate(out_ids)), pa.array(np.concatenate(out_n))], names=["id", "n"]
            )

    ordered = tasks.repartition(*keys).sortWithinPartitions(*keys, "side", "id")
    return ordered.mapInArrow(count, "id long, n long").groupBy("id").agg(F.sum("n").alias("n_links"))


def near_vectors(
    df: DataFrame, key: str = "vec_id", vec: str = "embedding", label: str = "label",
    threshold: float = THRESHOLD, window: int = WINDOW, passes: int | None = None,
) -> DataFrame:
    """One row per key: ``key``, ``n_links``, ``component_id`` (smallest key reachable), ``kept``.

    Vectors of equal non-null integer label and equal length link at a cosine of ``threshold`` or more.
    A vector that is null, empty, all zero or holds a null or non-finite number, or has a null
    label, links with nothing and is kept. Of a repeated key the least (label, vector) counts and
    one row comes out; rows with a null key come out as one kept row with a null component.

    Equal vectors of a label are one in the passes. Rows that share their leading bits in a pass are
    a run; every pair in a run is compared, by the window of sorted neighbours or, in runs longer
    than that, in tiles. So a pair at the threshold itself is missed by all passes with a chance of
    MISS however many vectors lie around it, a closer pair with less. Links within each component
    are then counted in full, however many neighbours a vector has. Other columns are not read.
    """
    picked = df.select(F.col(key).cast("long").alias("id"), F.col(label).alias("label"), F.col(vec).alias("vec"))
    one = picked.groupBy("id").agg(F.min(F.struct("label", "vec")).alias("least"))
    base = cut_lineage(one.select("id", "least.label", "least.vec"))
    usable = base.where("id IS NOT NULL AND label IS NOT NULL").where(
        finite("vec") & F.exists("vec", lambda x: x != 0)
    )
    folded = cut_lineage(
        usable.groupBy("label", "vec").agg(F.min("id").alias("first"), F.count(F.lit(1)).alias("copies"))
    )
    distinct = folded.select(F.col("first").alias("id"), "label", "vec")
    if passes:
        planned = distinct.select(
            "*", F.lit(bits_for(passes, threshold)).alias("bits"), F.lit(passes).alias("passes")
        )
    else:
        planned = _planned(distinct, threshold, window)
    planned = cut_lineage(planned)
    several = folded.where("copies > 1").select("label", "vec", "first")
    same = cut_lineage(usable.join(several, ["label", "vec"]).select("id", "first"))
    links = _sorted_links(_passes(planned), window, threshold).union(_run_links(planned, window, threshold, PART))
    nodes = components(links.union(same.select(F.col("id").alias("a"), F.col("first").alias("b"))))
    nodes = nodes.withColumnRenamed("node", "id")
    members = folded.withColumnRenamed("first", "id").join(nodes, "id")
    counts = link_counts(members.select("id", "component", "vec", "copies"), threshold, PART)
    counts = counts.withColumnRenamed("id", "first")
    firsts = base.select("id").join(same, "id", "left").withColumn("first", F.coalesce("first", "id"))
    joined = firsts.join(nodes, "id", "left").join(counts, "first", "left")
    return joined.select(
        F.col("id").alias(key),
        F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"),
        F.coalesce("component", "id").alias("component_id"),
        F.coalesce(F.col("component") == F.col("id"), F.lit(True)).alias("kept"),
    )
