"""Token ids in raw shard files, with a minimal perfect hash index from document keys to places.

A shard file is a header, the raw ids (2 or 4 bytes each) of its documents in ascending key order,
the place of each document in them, and a trailer. The index is cut into buckets by the hash of the
key. A bucket holds a minimal perfect hash of its keys (levels of bits: a key is placed at the first
level where no other key shares its bit, and its slot is the number of set bits before it), and for
each slot a fingerprint and where the key's documents lie: shard, first document, number of them. A
lookup is a few hashes, a comparison of the fingerprint and a read at an offset.
"""

from __future__ import annotations

import struct
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window, functions as F

from staysift.llm.tokens import END_ID, coder, runs
from staysift.llm.work import group_runs, starts_of, texts_of
from staysift.session import broadcast_if_small, cut_lineage, scratch_path

MAGIC = b"IDS1"
HEADER, TRAILER = "<4sHxx", "<QQ4s"  # as struct has them
BUCKET_KEYS = 20_000
# Bits of a level for each key that is still to be placed.
GAMMA = 2


@dataclass
class Store:
    """A written store: its folder, the shards (``shard``, ``file``, ``n_ids``, ``start``) and the index."""

    path: str
    key: str
    shards: DataFrame
    index: DataFrame
    buckets: int
    unkeyed: DataFrame


def _mixed(h1: np.ndarray, h2: np.ndarray, level: int) -> np.ndarray:
    x = h1 ^ (h2 * np.uint64((0x9E3779B97F4A7C15 * (2 * level + 1)) % 2**64))
    x = (x ^ (x >> np.uint64(31))) * np.uint64(0xBF58476D1CE4E5B9)
    return x ^ (x >> np.uint64(29))


def fingerprint_of(h1: np.ndarray, h2: np.ndarray) -> np.ndarray:
    return (_mixed(h2, h1, 1000) >> np.uint64(32)).astype("<u4")


def perfect_hash(h1: np.ndarray, h2: np.ndarray) -> list[np.ndarray]:
    """Levels (words of 64 bits) of a minimal perfect hash of distinct pairs of hashes."""
    levels, left = [], np.arange(len(h1))
    while len(left):
        size = max(64, -(-GAMMA * len(left) // 64) * 64)
        spot = (_mixed(h1[left], h2[left], len(levels)) % np.uint64(size)).astype(np.int64)
        alone = np.bincount(spot, minlength=size) == 1
        levels.append(np.packbits(alone, bitorder="little").view("<u8"))
        left = left[~alone[spot]]
    return levels


def slots_of(levels: list[np.ndarray], h1: np.ndarray, h2: np.ndarray) -> np.ndarray:
    """Slot of each key; a key that was not there may get any slot or -1."""
    slot, left, before = np.full(len(h1), -1, np.int64), np.arange(len(h1)), 0
    for n, words in enumerate(levels):
        spot = _mixed(h1[left], h2[left], n) % np.uint64(64 * len(words))
        word, bit = (spot >> np.uint64(6)).astype(np.int64), spot & np.uint64(63)
        ones = np.bitwise_count(words).astype(np.int64)
        rank = np.cumsum(ones) - ones
        hit = (words[word] >> bit) & np.uint64(1) == 1
        under = np.bitwise_count(words[word] & ((np.uint64(1) << bit) - np.uint64(1)))
        slot[left[hit]] = before + rank[word[hit]] + under[hit]
        left, before = left[~hit], before + int(ones.sum())
    return slot


def _write_shards(df: DataFrame, path: str, tokenizer: str, key: str, text: str, end_id: int) -> DataFrame:
    """Write the shard files; gives one row per run of documents with equal key in a shard."""
    kind = dict(df.dtypes)[key]
    names = [key, "shard", "file", "first", "copies", "n_ids"]

    def rows(batches):
        from pyarrow import fs

        shard = TaskContext.get().partitionId()
        # A name of this attempt alone: files of failed attempts are in no table.
        file = f"{shard:06d}-{TaskContext.get().taskAttemptId()}.ids"
        system, folder = fs.FileSystem.from_uri(path)
        out, places, n, waiting = None, [0], 0, None
        coding = coder(tokenizer)
        wide = coding.tokenizer.get_vocab_size(with_added_tokens=True) > 1 << 16 or end_id >= 1 << 16
        for batch in batches:
            keys, texts = batch.column(0).to_pylist(), texts_of(batch.column(1))
            key_type, found = batch.schema.field(0).type, []
            if out is None and keys:
                system.create_dir(folder, recursive=True)
                out = system.open_output_stream(f"{folder}/{file}")
                out.write(struct.pack(HEADER, MAGIC, 4 if wide else 2))
            for a, b in runs(texts):
                for k, ids in zip(keys[a:b], coding.encode(texts[a:b])):
                    ids = np.append(np.frombuffer(ids, "<u4"), np.uint32(end_id))
                    out.write(ids.astype("<u4" if wide else "<u2").tobytes())
                    if waiting is None or k != waiting[0]:
                        if waiting is not None:
                            found.append(waiting)
                        waiting = [k, shard, file, len(places) - 1, 0, 0]
                    waiting[4] += 1
                    waiting[5] += len(ids)
                    places.append(places[-1] + len(ids))
            if found:
                yield pa.RecordBatch.from_arrays(
                    [pa.array([f[i] for f in found], key_type if i == 0 else None) for i in range(6)], names
                )
        if out is not None:
            out.write(np.array(places, "<u8").tobytes())
            out.write(struct.pack(TRAILER, len(places) - 1, places[-1], MAGIC))
            out.close()
            yield pa.RecordBatch.from_arrays(
                [pa.array([waiting[i]], key_type if i == 0 else None) for i in range(6)], names
            )

    order = [F.col(key).asc_nulls_first(), F.xxhash64(text)]
    placed = df.select(key, text).repartitionByRange(*order).sortWithinPartitions(*order, F.col(text))
    schema = f"`{key}` {kind}, shard long, file string, first long, copies long, n_ids long"
    return cut_lineage(placed.mapInArrow(rows, schema))


def _build_index(spans: DataFrame, key: str, buckets: int) -> DataFrame:
    """One row per bucket: levels, fingerprints, and per slot the shards, first documents, copies."""
    places = (
        spans.where(F.col(key).isNotNull())
        .groupBy(key)
        .agg(F.collect_list(F.struct("shard", "first", "copies")).alias("at"))  # one per shard
        .select(
            F.xxhash64(key).alias("h1"), F.xxhash64(key, F.lit(1)).alias("h2"),
            F.col("at.shard").alias("shard"), F.col("at.first").alias("first"),
            F.col("at.copies").alias("copies"),
        )
        .withColumn("bucket", F.pmod("h1", F.lit(buckets)))
    )

    def rows(batches):
        for table, _ in group_runs(batches, ["bucket"]):
            cuts = starts_of(table, ["bucket"])
            for a, b in zip(cuts, cuts[1:]):
                part = table.slice(a, b - a)
                h1, h2 = (part[c].to_numpy().view(np.uint64) for c in ("h1", "h2"))
                levels = perfect_hash(h1, h2)
                by_slot = np.empty(len(h1), np.int64)
                by_slot[slots_of(levels, h1, h2)] = np.arange(len(h1))
                lists = part.select(["shard", "first", "copies"]).take(pa.array(by_slot)).combine_chunks()
                ends = np.cumsum([0, *map(len, lists["shard"].to_pylist())]).astype("<u4")
                flat = [
                    np.array([x for xs in lists[c].to_pylist() for x in xs], "<i8").tobytes()
                    for c in ("shard", "first", "copies")
                ]
                prints = fingerprint_of(h1[by_slot], h2[by_slot]).tobytes()
                row = [part["bucket"][0].as_py(), [x.tobytes() for x in levels], prints, ends.tobytes(), *flat]
                yield pa.RecordBatch.from_arrays(
                    [pa.array([row[0]]), pa.array([row[1]], pa.list_(pa.binary())),
                     *[pa.array([x], pa.binary()) for x in row[2:]]],
                    names=["bucket", "levels", "prints", "ends", "shard", "first", "copies"],
                )

    schema = (
        "bucket long, levels array<binary>, prints binary, ends binary,"
        " shard binary, first binary, copies binary"
    )
    return cut_lineage(places.repartition("bucket").sortWithinPartitions("bucket").mapInArrow(rows, schema))


def write_store(
    df: DataFrame, tokenizer: str, path: str | None = None, key: str = "doc_id", text: str = "text",
    end_id: int = END_ID, bucket_keys: int = BUCKET_KEYS,
) -> Store:
    """Tokenize whole texts and write shard files and index to ``path`` (else a scratch folder).

    Documents lie in ascending key order over all shards, rows with a null key first; rows with
    equal keys are ordered by their text. A null or empty text is the end id alone. Null keys
    have no index entry and are read by ``fetch_unkeyed`` only. Other columns are not read. An empty table
    writes no shard.
    """
    spark = df.sparkSession
    path = path or scratch_path(spark, "tokens")
    spans = _write_shards(df, f"{path}/shards", tokenizer, key, text, end_id)
    # One row per shard, ranked in one task: as many rows as there are files.
    shards = spans.groupBy("shard").agg(F.first("file").alias("file"), F.sum("n_ids").alias("n_ids"))
    before = Window.orderBy("shard").rowsBetween(Window.unboundedPreceding, -1)
    shards = cut_lineage(
        shards.withColumn("start", F.coalesce(F.sum("n_ids").over(before), F.lit(0)).cast("long"))
    )
    keys = spans.where(F.col(key).isNotNull()).count()  # runs, about as many as keys
    buckets = max(1, -(-keys // bucket_keys))
    unkeyed = spans.where(F.col(key).isNull()).select(key, "shard", "first", "copies")
    return Store(path, key, shards, _build_index(spans, key, buckets), buckets, unkeyed)


def locate(store: Store, keys: DataFrame) -> DataFrame:
    """``key``, ``shard``, ``first`` and ``copies`` of the distinct ``keys``, by the index alone.

    A key whose documents lie in several shards has several rows; an unknown or null key has none.
    """
    key = store.key
    asked = keys.select(key).where(F.col(key).isNotNull()).distinct().select(
        key, F.xxhash64(key).alias("h1"), F.xxhash64(key, F.lit(1)).alias("h2")
    ).withColumn("bucket", F.pmod("h1", F.lit(store.buckets)))
    kind = dict(keys.dtypes)[key]

    def find(asked: pa.Table, index: pa.Table) -> pa.Table:
        names = [key, "shard", "first", "copies"]
        if not asked.num_rows or not index.num_rows:
            empty = [pa.array([], asked.schema.field(key).type), *[pa.array([], pa.int64())] * 3]
            return pa.table(empty, names=names)
        row = index.slice(0, 1).to_pylist()[0]
        levels = [np.frombuffer(x, "<u8") for x in row["levels"]]
        ends, prints = np.frombuffer(row["ends"], "<u4").astype(np.int64), np.frombuffer(row["prints"], "<u4")
        h1, h2 = (asked[c].to_numpy().view(np.uint64) for c in ("h1", "h2"))
        slot = slots_of(levels, h1, h2)
        hit = np.flatnonzero(slot >= 0)
        hit = hit[prints[slot[hit]] == fingerprint_of(h1[hit], h2[hit])]
        size = ends[slot[hit] + 1] - ends[slot[hit]]
        inner = np.arange(size.sum()) - np.repeat(np.cumsum(size) - size, size)
        at = np.repeat(ends[slot[hit]], size) + inner
        values = [np.frombuffer(row[c], "<i8")[at] for c in names[1:]]
        found = asked[key].take(pa.array(np.repeat(hit, size)))
        return pa.table([found, *map(pa.array, values)], names=names)

    return (
        asked.groupBy("bucket")
        .cogroup(store.index.groupBy("bucket"))
        .applyInArrow(find, f"`{key}` {kind}, shard long, first long, copies long")
    )


def _read(store: Store, places: DataFrame) -> DataFrame:
    """Documents at ``places``: ``key``, ``start``, ``n_tokens``, ``ids`` read from the shard files."""
    key, folder = store.key, f"{store.path}/shards"
    kind = dict(places.dtypes)[key]
    shards = store.shards.select("shard", "file", F.col("start").alias("base"))
    joined = places.join(broadcast_if_small(shards), "shard")

    def rows(batches):
        from pyarrow import fs

        system, root = fs.FileSystem.from_uri(folder)
        opened, source = None, None
        for batch in batches:
            out = []
            columns = batch.to_pydict()
            for k, file, base, first, copies in zip(
                columns[key], columns["file"], columns["base"], columns["first"], columns["copies"]
            ):
                if file != opened:
                    if source is not None:
                        source.close()
                    source, opened = system.open_input_file(f"{root}/{file}"), file
                    source.seek(source.size() - struct.calcsize(TRAILER))
                    documents, n_ids, magic = struct.unpack(TRAILER, source.read(struct.calcsize(TRAILER)))
                    source.seek(0)
                    _, width = struct.unpack(HEADER, source.read(struct.calcsize(HEADER)))
                    assert magic == MAGIC
                    table = struct.calcsize(HEADER) + n_ids * width
                    source.seek(table)
                    places = np.frombuffer(source.read(8 * (documents + 1)), "<u8").astype(np.int64)
                for r in range(first, first + copies):
                    a, b = int(places[r]), int(places[r + 1])
                    source.seek(struct.calcsize(HEADER) + a * width)
                    ids = np.frombuffer(source.read((b - a) * width), f"<u{width}")
                    out.append((k, base + a, b - a, ids.astype("<u4").tobytes()))
                    if len(out) >= 1000:
                        yield packed(out, batch.schema.field(key).type)
                        out = []
            if out:
                yield packed(out, batch.schema.field(key).type)
        if source is not None:
            source.close()

    def packed(out, key_type):
        k, start, n, ids = zip(*out)
        return pa.RecordBatch.from_arrays(
            [pa.array(k, key_type), pa.array(start), pa.array(n), pa.array(ids, pa.binary())],
            names=[key, "start", "n_tokens", "ids"],
        )

    ordered = joined.repartition("shard").sortWithinPartitions("shard", "first")
    picked = ordered.select(key, "file", "base", "first", "copies")
    return picked.mapInArrow(rows, f"`{key}` {kind}, start long, n_tokens long, ids binary")


def fetch(store: Store, keys: DataFrame) -> DataFrame:
    """Documents of ``keys`` through the index: ``key``, ``start`` (ids of all documents before it),
    ``n_tokens`` and ``ids`` (little-endian unsigned 32-bit), one row per stored document.

    Repeated and null keys in ``keys`` change nothing; unknown ones give no rows (but for one in
    2**32, which the caller can rule out by a join).
    """
    return _read(store, locate(store, keys))


def fetch_unkeyed(store: Store) -> DataFrame:
    """The documents with a null key, which the index cannot name; columns as those of ``fetch``."""
    return _read(store, store.unkeyed)
