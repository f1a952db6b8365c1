"""Removal of repeated byte strings by a depth-limited radix sort of suffixes.

Every string of ``threshold`` bytes is a suffix cut at that depth; equal groups of the sort are
exactly the repeated strings. The most significant digit of a string is its rarest-looking gram:
the GRAM bytes with the least hash in it, leftmost on ties. Equal strings agree on that gram and on
its place in them, so the first pass deals suffixes by the gram, and it needs one record for all the
strings that share a gram occurrence (its anchor). The second takes all bytes of an anchor's strings
as one digit: anchors equal in it have every string repeated. What is left is fetched with its bytes,
and the further passes sort the bytes right of the gram and the bytes left of it, eight at a time, and
only among records that are still equal. Two strings are equal if the left parts agree to the depth of their start and the
right parts to the depth of their end, which the depths of neighbours in the two orders tell.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from staysift.llm.work import by_bytes, forget, group_runs, starts_of, text_bytes
from staysift.session import broadcast_if_small, cut_and_measure, cut_lineage

THRESHOLD = 200
GRAM = 32
# A gram with more occurrences than this has its strings counted one by one, in all tasks.
HOT = 20_000
# Documents handled at once, to bound what a worker holds.
SLICE = 2000
# Bytes handled at once; places in them fit into the low 24 bits of a hash.
_PART = 1 << 20
_PLACE = np.uint64((1 << 24) - 1)
# Odd multipliers of the gram hash.
_ODD = np.array(
    [0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0x27D4EB2F165667C5, 0xD6E8FEB86659FD93],
    np.uint64,
)


def gram_hashes(data: np.ndarray) -> np.ndarray:
    """A hash of the GRAM bytes from each place of ``data``."""
    n = len(data) - GRAM + 1
    eights = np.ndarray((len(data) - 7,), "<u8", data.tobytes(), strides=(1,)).copy()
    h = eights[:n] * _ODD[0]
    for i in (1, 2, 3):
        h += (eights[8 * i : 8 * i + n] ^ (h >> np.uint64(29))) * _ODD[i]
    h ^= h >> np.uint64(32)
    h *= _ODD[4]
    h ^= h >> np.uint64(29)
    return h


def sliding_least(values: np.ndarray, width: int) -> np.ndarray:
    """The least of each ``width`` values in a row."""
    span = 1
    while 2 * span <= width:
        values = np.minimum(values[:-span], values[span:])
        span *= 2
    rest = width - span
    return np.minimum(values[: len(values) - rest], values[rest:]) if rest else values


def anchors(data: np.ndarray, offsets: np.ndarray, threshold: int = THRESHOLD):
    """Anchors of all strings of ``threshold`` bytes inside the documents that ``offsets`` cut.

    Gives arrays: gram hash, document number, first string's place in the document, bytes of it
    left of the gram, and number of strings (at places one after the other) with this anchor.
    Long inputs are worked through in parts that overlap by a string.
    """
    width = threshold - GRAM + 1
    out = []
    for at in range(0, max(0, len(data) - threshold + 1), _PART):
        part = data[at : at + _PART + threshold - 1]
        h = gram_hashes(part)
        place = np.arange(len(h), dtype=np.uint64)
        anchor = (sliding_least((h & ~_PLACE) | place, width) & _PLACE).astype(np.int64)
        doc = np.searchsorted(offsets, np.arange(at, at + len(anchor)), side="right") - 1
        inside = np.flatnonzero(np.arange(at, at + len(anchor)) + threshold <= offsets[doc + 1])
        if not len(inside):
            continue
        doc, anchor = doc[inside], anchor[inside]
        new = np.append(True, (doc[1:] != doc[:-1]) | (anchor[1:] != anchor[:-1]))
        first = np.flatnonzero(new)
        count = np.diff(np.append(first, len(inside)))
        q, d = inside[first] + at, doc[first]
        out.append((h[anchor[first]].view(np.int64), d, q - offsets[d], anchor[first] + at - q, count))
    if not out:
        return tuple(np.zeros(0, np.int64) for _ in range(5))
    return tuple(np.concatenate(x) for x in zip(*out))


def radix_order(rows: np.ndarray, group: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Order of ``rows`` (bytes, a multiple of 8 wide) in each group, and the depth to which
    each agrees with the one before it (-1 at the start of a group).

    ``group`` is ascending. Most significant digit first: each pass sorts only rows that are still
    equal to another one.
    """
    n, width = rows.shape
    digits = np.ascontiguousarray(rows).view(">u8").astype(np.uint64)
    order = np.arange(n)
    depth = np.full(n, width, np.int64)
    depth[0] = -1
    depth[1:][group[1:] != group[:-1]] = -1
    for k in range(width // 8):
        joined = depth == width  # in one class with the row before
        active = joined | np.append(joined[1:], False)
        at = np.flatnonzero(active)
        if not len(at):
            break
        cls = np.cumsum(~joined[at])
        digit = digits[order[at], k]
        differs = (cls[1:] == cls[:-1]) & (digit[1:] != digit[:-1])
        mixed = np.unique(cls[1:][differs])
        if not len(mixed):
            continue
        pick = np.isin(cls, mixed)
        at, cls, digit = at[pick], cls[pick], digit[pick]
        by = np.lexsort((digit, cls))
        order[at] = order[at][by]
        digit = digit[by]
        cut = np.flatnonzero((cls[1:] == cls[:-1]) & (digit[1:] != digit[:-1])) + 1
        x = digit[cut] ^ digit[cut - 1]
        same = sum((x < np.uint64(1 << 8 * (8 - j))).astype(np.int64) for j in range(1, 8))
        depth[at[cut]] = 8 * k + same
    return order, depth


def bytes_from(data: np.ndarray, start: np.ndarray, step: int, size: np.ndarray, width: int) -> np.ndarray:
    """A row of ``size`` bytes for each start, read up (step 1) or down (-1), filled with zeros."""
    out = np.zeros((len(start), width), np.uint8)
    columns = np.arange(width)
    for i in range(0, len(start), 2048):
        inside = columns < size[i : i + 2048, None]
        places = np.where(inside, start[i : i + 2048, None] + step * columns, 0)
        out[i : i + 2048] = np.where(inside, data[places], 0)
    return out


def repeated_depths(
    group: np.ndarray, data: np.ndarray, at: np.ndarray, left: np.ndarray, count: np.ndarray,
    threshold: int = THRESHOLD,
) -> tuple[np.ndarray, np.ndarray]:
    """For each anchor the least and the greatest depth (bytes left of the gram) at which a string
    occurs at another anchor of its group too; -1 where none does.

    The anchor's bytes start at ``data[at]`` with ``left`` bytes before the gram.
    """
    n = len(group)
    most_left = threshold - GRAM
    reach = -(-most_left // 8) * 8, -(-threshold // 8) * 8
    low = left - count + 1  # least depth of the anchor's strings
    lefts = bytes_from(data, at + left - 1, -1, left, reach[0])
    rights = bytes_from(data, at + left, 1, threshold - low, reach[1])
    by_left, agree_left = radix_order(lefts, group)
    by_right, agree_right = radix_order(rights, group)
    least, greatest = np.full(n, -1), np.full(n, -1)
    class_left, class_right = np.empty(n, np.int64), np.empty(n, np.int64)
    for d in range(int(low.min()), int(left.max()) + 1):
        rows = np.flatnonzero((low <= d) & (d <= left))
        if len(rows) < 2:
            continue
        class_left[by_left] = np.cumsum(agree_left < d)
        class_right[by_right] = np.cumsum(agree_right < threshold - d)
        code = class_left[rows] * (n + 1) + class_right[rows]
        by = np.argsort(code, kind="stable")
        equal = code[by][1:] == code[by][:-1]
        twice = rows[by[np.append(equal, False) | np.append(False, equal)]]
        greatest[twice] = d
        least[twice[least[twice] < 0]] = d
    return least, greatest


IDS = ["_id1", "_id2"]


def _anchors(docs: DataFrame, threshold: int, whole: bool) -> DataFrame:
    """First pass: a row per anchor (``whole``), or the number of anchors by gram.

    An anchor's ``digest`` is that of the bytes of all its strings.
    """

    def rows(batches):
        forget()
        for batch in (b.slice(i, SLICE) for b in batches for i in range(0, b.num_rows, SLICE)):
            data, offsets = text_bytes(batch.column(0))
            gram, doc, place, left, count = anchors(data, offsets, threshold)
            if not len(gram):
                continue
            if not whole:
                value, times = np.unique(gram, return_counts=True)
                yield pa.RecordBatch.from_arrays([pa.array(value), pa.array(times)], names=["gram", "n"])
                continue
            raw, starts = data.tobytes(), offsets[doc] + place
            stops = starts + count + threshold - 1
            digest = hashlib.blake2b
            digests = b"".join(
                [digest(raw[i:j], digest_size=8).digest() for i, j in zip(starts.tolist(), stops.tolist())]
            )
            at = pa.array(doc)
            columns = [pa.array(gram), pa.array(np.frombuffer(digests, "<i8")), batch.column(1).take(at),
                       batch.column(2).take(at), *(pa.array(x.astype(np.int32)) for x in (place, left, count))]
            yield pa.RecordBatch.from_arrays(
                columns, names=["gram", "digest", *IDS, "place", "left", "count"]
            )

    picked = docs.select("_text", *IDS)
    slim = "gram long, digest long, _id1 long, _id2 long, place int, left int, count int"
    return picked.mapInArrow(rows, slim if whole else "gram long, n long")


def _classes(found: DataFrame, threshold: int) -> DataFrame:
    """Second pass: of each gram, anchors that are alike in all their bytes.

    Grams that occur once are done. Anchors of one class have all their strings repeated: they give
    a span. Where a gram has several classes, an anchor of each goes on to the third pass.
    """
    names = ["gram", *IDS, "place", "left", "count", "done"]

    def rows(batches):
        for table, _ in group_runs(batches, ["gram"]):
            cuts = starts_of(table, ["gram", "digest"])
            size = np.diff(cuts)
            gram = table["gram"].to_numpy()[cuts[:-1]]
            alone = np.append(True, gram[1:] != gram[:-1])
            alone &= np.append(alone[1:], True)  # the only class of its gram
            for at, done in ((np.flatnonzero(np.repeat(size > 1, size)), True), (cuts[:-1][~alone], False)):
                if len(at):
                    part = table.take(pa.array(at)).drop_columns(["digest"])
                    part = part.append_column("done", pa.array(np.full(len(at), done)))
                    yield from part.select(names).to_batches()

    placed = found.repartition("gram").sortWithinPartitions("gram", "digest")
    return placed.mapInArrow(
        rows, "gram long, _id1 long, _id2 long, place int, left int, count int, done boolean"
    )


def _with_bytes(docs: DataFrame, found: DataFrame, threshold: int) -> DataFrame:
    """The bytes of the strings of ``found`` anchors, read from their documents."""
    at = F.struct("gram", "place", "left", "count")
    wanted = found.groupBy(*IDS).agg(F.collect_list(at).alias("_wanted"))  # of one document
    joined = docs.join(wanted, IDS)
    text, ids = docs.columns.index("_text"), [docs.columns.index(c) for c in IDS]

    def rows(batches):
        for batch in (part for b in batches for part in by_bytes(b, text)):
            for i, (t, wanted) in enumerate(zip(batch.column(text).to_pylist(), batch.column("_wanted").to_pylist())):
                raw, n = t.encode(), len(wanted)
                columns = [pa.array([w[c] for w in wanted], pa.int64()) for c in ("gram", "place", "left")]
                picked = [raw[w["place"] : w["place"] + w["count"] + threshold - 1] for w in wanted]
                own = [pa.array(np.full(n, batch.column(c)[i].as_py())) for c in ids]
                yield pa.RecordBatch.from_arrays(
                    [columns[0], *own, *columns[1:], pa.array(picked, pa.binary())],
                    names=["gram", *IDS, "place", "left", "bytes"],
                )

    # All columns of the documents, so that this join and the last one read the same exchange.
    every = joined.select(*docs.columns, "_wanted")
    return every.mapInArrow(rows, "gram long, _id1 long, _id2 long, place long, left long, bytes binary")


def _sorted_spans(found: DataFrame, threshold: int) -> DataFrame:
    """Third pass: spans ``_id1``, ``_id2``, ``start``, ``stop`` by sorting each gram's suffixes."""

    def rows(batches):
        for table, _ in group_runs(batches, ["gram"]):
            cuts = starts_of(table, ["gram"])
            size = np.diff(cuts)
            keep = np.flatnonzero(np.repeat(size > 1, size))
            if not len(keep):
                continue
            table = table.take(pa.array(keep))
            group = np.repeat(np.arange((size > 1).sum()), size[size > 1])
            packed = table["bytes"].combine_chunks().cast(pa.large_binary())
            packed = packed.chunk(0) if isinstance(packed, pa.ChunkedArray) else packed
            _, offsets, data = packed.buffers()
            at = np.frombuffer(offsets, np.int64)[packed.offset : packed.offset + len(packed) + 1]
            left = table["left"].to_numpy()
            count = np.diff(at) - threshold + 1
            least, greatest = repeated_depths(
                group, np.frombuffer(data, np.uint8), at[:-1], left, count, threshold
            )
            hit = np.flatnonzero(greatest >= 0)
            if not len(hit):
                continue
            anchor = table["place"].to_numpy()[hit] + left[hit]
            picked = table.take(pa.array(hit))
            done = pa.table(
                [*(picked[c] for c in IDS), anchor - greatest[hit], anchor - least[hit] + threshold],
                names=[*IDS, "start", "stop"],
            )
            yield from done.to_batches()

    placed = found.repartition("gram").sortWithinPartitions("gram")
    return placed.mapInArrow(rows, "_id1 long, _id2 long, start long, stop long")


def _counted_spans(found: DataFrame, threshold: int) -> DataFrame:
    """The same for grams with very many occurrences: every string is a row, counted by digest.

    Counts combine inside the tasks, and the join back is one that adaptive execution can split,
    so a string in a third of all documents never meets in one task.
    """

    def rows(batches):
        for batch in batches:
            for i, (raw, place) in enumerate(zip(batch.column(5).to_pylist(), batch.column(3).to_pylist())):
                n = len(raw) - threshold + 1
                digests = b"".join(
                    hashlib.blake2b(raw[j : j + threshold], digest_size=16).digest() for j in range(n)
                )
                pair = np.frombuffer(digests, "<i8").reshape(n, 2)
                spot = pa.array(np.full(n, i))
                yield pa.RecordBatch.from_arrays(
                    [pa.array(pair[:, 0]), pa.array(pair[:, 1]), batch.column(1).take(spot),
                     batch.column(2).take(spot), pa.array(np.arange(n) + place)],
                    names=["h1", "h2", *IDS, "start"],
                )

    strings = found.mapInArrow(rows, "h1 long, h2 long, _id1 long, _id2 long, start long")
    repeated = strings.groupBy("h1", "h2").agg(F.count(F.lit(1)).alias("n")).where("n > 1")
    hits = strings.join(repeated.drop("n"), ["h1", "h2"])
    # Strings that start less than half a threshold apart overlap, so their union is one span.
    near = F.floor(F.col("start") / (threshold // 2))
    return (
        hits.groupBy(*IDS, near.alias("near"))
        .agg(F.min("start").alias("start"), (F.max("start") + threshold).alias("stop"))
        .drop("near")
    )


def _identified(df: DataFrame, key: str, text: str) -> DataFrame:
    """``df`` with ``_text`` and two hashes of key and text, by which spans come back to their rows.

    Rows equal in both share them; their strings are the same, and so are their spans.
    """
    ids = F.xxhash64(key, text), F.xxhash64(text, F.lit(1), key)
    rows = df.drop("_text", *IDS) if text != "_text" else df
    return rows.withColumns(dict(zip(["_text", *IDS], [F.col(text), *ids])))


def repeated_spans(docs: DataFrame, threshold: int = THRESHOLD, hot: int = HOT) -> DataFrame:
    """Spans of bytes that a string of ``threshold`` bytes covers which also starts elsewhere.

    ``docs`` has ``_text`` and two ids; columns ``_id1``, ``_id2``, ``start``, ``stop``; spans may overlap.
    """
    if threshold < 2 * GRAM:
        raise ValueError(f"threshold must be at least {2 * GRAM} bytes")
    counts = _anchors(docs, threshold, False).groupBy("gram").agg(F.sum("n").alias("n"))
    frequent, seen = cut_and_measure(counts.where(F.col("n") > hot).select("gram"))
    every = _anchors(docs, threshold, True)
    usual = every
    if seen["rows"]:
        frequent = broadcast_if_small(frequent, rows=seen["rows"])
        usual = every.join(frequent, "gram", "left_anti")
    classes = cut_lineage(_classes(usual, threshold))
    stop = F.col("place").cast("long") + F.col("count") + threshold - 1
    spans = classes.where("done").select(*IDS, F.col("place").cast("long").alias("start"), stop.alias("stop"))
    left = _with_bytes(docs, classes.where("NOT done").drop("done"), threshold)
    spans = spans.union(_sorted_spans(left, threshold))
    if seen["rows"]:
        # Anchors alike in all bytes are one class, counted by digest: a class of several is repeated
        # whole, and one member of each class meets the strings of the others.
        many = cut_lineage(every.join(frequent, "gram", "left_semi"))
        member = F.struct(*IDS, "place", "left", "count").alias("member")
        alike = cut_lineage(many.groupBy("gram", "digest").agg(F.count(F.lit(1)).alias("n"), F.min(member).alias("member")))
        several = broadcast_if_small(alike.where("n > 1").select("gram", "digest"))
        whole = many.join(several, ["gram", "digest"], "left_semi")
        spans = spans.union(whole.select(*IDS, F.col("place").cast("long").alias("start"), stop.alias("stop")))
        single = alike.select("gram", "member.*")
        spans = spans.union(_counted_spans(_with_bytes(docs, single, threshold), threshold))
    return spans


def merged(spans: list[dict] | None) -> list[tuple[int, int]]:
    """Spans joined where they overlap or touch, in order."""
    out: list[tuple[int, int]] = []
    for a, b in sorted((s["start"], s["stop"]) for s in spans or []):
        if out and a <= out[-1][1]:
            out[-1] = out[-1][0], max(b, out[-1][1])
        else:
            out.append((a, b))
    return out


def remove_repeats(
    df: DataFrame, key: str = "doc_id", text: str = "text", threshold: int = THRESHOLD,
    hot: int = HOT, as_text: bool = False,
) -> DataFrame:
    """All rows and columns of ``df`` and a struct ``_repeats``: ``n_bytes``, ``n_removed``,
    ``n_spans`` and ``kept``, the UTF-8 bytes without those in a repeated string.

    A byte goes if a string of ``threshold`` bytes that covers it also starts at any other place of
    any row; every copy goes, the first too. Strings never cross rows. A null text counts as
    empty; a text shorter than the threshold stays whole; repeated rows are different places, so
    rows of the threshold's length or more that occur twice are emptied. Null and repeated keys are
    fine: spans belong to the pair of key and text. ``as_text`` gives ``kept`` as a string, without the bytes of
    characters of which only a part is kept. A column named ``_repeats`` is replaced, columns
    named ``_text``, ``_id1`` or ``_id2`` (unless one is the text) are not kept; an empty
    table gives no rows.
    """
    base = _identified(df.drop("_repeats"), key, text)
    spans = (
        repeated_spans(base, threshold, hot)
        .distinct()
        .groupBy(*IDS)
        .agg(F.collect_list(F.struct("start", "stop")).alias("_spans"))
    )
    columns = [c for c in base.columns if c not in ("_text", *IDS)]
    joined = base.join(spans, IDS, "left").select(*columns, "_spans")
    kept = pa.string() if as_text else pa.binary()
    fields = [("n_bytes", pa.int64()), ("n_removed", pa.int64()), ("n_spans", pa.int64()), ("kept", kept)]

    def rows(batches):
        forget()
        for batch in (part for b in batches for part in by_bytes(b, text)):
            texts, spans = batch.column(text).to_pylist(), batch.column("_spans").to_pylist()
            out = []
            for t, found in zip(texts, spans):
                raw = (t or "").encode()
                gone = merged(found)
                parts, at = [], 0
                for a, b in gone:
                    parts.append(raw[at:a])
                    at = b
                left = b"".join([*parts, raw[at:]])
                out.append((len(raw), len(raw) - len(left), len(gone),
                            left.decode(errors="ignore") if as_text else left))
            columns = [pa.array(c, kind) for c, (_, kind) in zip(zip(*out), fields)]
            packed = pa.StructArray.from_arrays(columns, names=[n for n, _ in fields])
            rest = batch.drop_columns(["_spans"])
            yield rest.append_column("_repeats", packed)

    shape = "struct<n_bytes: long, n_removed: long, n_spans: long, kept: {}>"
    schema = ", ".join(f"`{n}` {k}" for n, k in df.select(*columns).dtypes)
    return joined.mapInArrow(rows, f"{schema}, _repeats {shape.format('string' if as_text else 'binary')}")
