"""The index of merged parts against a fresh index of the live rows."""

from __future__ import annotations

import random
from pathlib import Path

import pytest
from pyspark.sql import functions as F

from staysift.operators.chunking import fixed_chunks
from staysift.operators.hybrid import build_hybrid_index, search
from staysift.sources.changes import changed_rows, write_snapshot
from staysift.streaming import parts
from staysift.streaming.parts import PartIndex

SCHEMA = "id long, version int, gone boolean, text string"
WORDS = "ramp lift door wide step hall bath sea view quiet".split()


def embed(chunks):
    """Vectors from the text alone, so that a fresh index has the same."""
    return chunks.withColumn("embedding", F.array(*[F.regexp_count("text", F.lit(w)).cast("float") + 0.01 * k for k, w in enumerate(WORDS[:4])]))


def short_chunks(df, key, text):
    return fixed_chunks(df, key, text, size=40, overlap=10)


def texts(seed, ids):
    rng = random.Random(seed)
    return [(i, seed, False, " ".join(rng.choice(WORDS) for _ in range(rng.randint(1, 25)))) for i in ids]


def files_of(path):
    return {str(f): f.stat().st_mtime_ns for f in Path(path).rglob("*.parquet") if "/parts/" in str(f)}


def agree(spark, index, live, tmp_path, name):
    """Both halves, their fusion, the chunks and the counts equal those of a new index of the live rows."""
    chunks = embed(short_chunks(spark.createDataFrame(live, "id long, text string"), "id", "text"))
    fresh = build_hybrid_index(chunks, f"{tmp_path}/{name}", "chunk_id", "text", "embedding", attributes=["id"])
    opened = index.open()
    asked = spark.createDataFrame([(1, "sea lift", [1.0, 0.0, 0.0, 0.0]), (2, "ramp door hall", [0.0, 0.0, 1.0, 1.0])], "q int, text string, embedding array<float>")
    both = [search(i, asked, "q", "text", k=20, columns=["id", "text"]) for i in (opened, fresh)]
    got, want = (sorted(tuple(r) for r in b.select("q", "rank", "chunk_id", "score", "id", "text").collect()) for b in both)
    assert got == want
    counts = [sorted(tuple(r) for r in i.words.terms.select("term", "df", "total_tf").collect()) for i in (opened, fresh)]
    assert counts[0] == counts[1]
    assert sorted(r[0] for r in index.chunks().select("chunk_id").collect()) == sorted(r[0] for r in chunks.select("chunk_id").collect())


@pytest.fixture
def index(spark, tmp_path):
    return PartIndex(spark, f"{tmp_path}/index", "id", "text", short_chunks, embed, fan=3, tier=1000)


def test_small_sync_leaves_older_parts_alone(spark, index, tmp_path):
    first = texts(1, range(60))
    index.add(spark.createDataFrame(first, SCHEMA), 0, F.col("version"), F.col("gone"))
    before = files_of(index.path)
    second = texts(2, [3, 70]) + [(5, 2, True, None), (6, 0, False, "late and older"), (None, 9, False, "no key"), (8, 2, False, None)]
    index.add(spark.createDataFrame(second, SCHEMA), 1, F.col("version"), F.col("gone"))
    after = files_of(index.path)
    assert before.items() <= after.items() and len(index.parts()) == 2
    live = {r[0]: r[3] for r in first} | {r[0]: r[3] for r in second[:2]}
    live.pop(5)
    live.pop(8)
    agree(spark, index, sorted(live.items()), tmp_path, "fresh")
    assert index.open().vectors.join(index.chunks().where("id = 5"), "chunk_id").count() == 0
    index.add(spark.createDataFrame(texts(9, [1, 2]), SCHEMA), 1, F.col("version"), F.col("gone"))  # a replay
    assert files_of(index.path) == after


def test_parts_are_merged_and_stay_exact(spark, index, tmp_path):
    live = {}
    for n in range(5):
        ids = [(7 * n + k) % 30 for k in range(9)]
        rows = texts(10 + n, ids) + [(100 + n, 1, False, "ramp by the sea")]
        gone = [(29, 50 + n, n % 2 == 0, "back again")]
        index.add(spark.createDataFrame(rows + gone, SCHEMA), n, F.col("version"), F.col("gone"))
        live |= {r[0]: r[3] for r in rows}
        live.pop(29, None)
        if n % 2:
            live[29] = "back again"
    assert len(index.parts()) < 3 and any(len(p["batches"]) >= 3 for p in index.parts())
    dropped = index.drop_unused()
    assert dropped and not any(Path(d).exists() for d in dropped)
    agree(spark, index, sorted(live.items()), tmp_path, "last")


def test_stream_then_feed(spark, index, tmp_path):
    folder = f"{tmp_path}/in"
    one = spark.createDataFrame([(i, t) for i, _, _, t in texts(1, range(20))], "id long, text string")
    one.write.parquet(folder)
    here = F.struct(F.lit(0).alias("number"), F.lit(True).alias("here"))
    index.sync(spark.readStream.schema(one.schema).parquet(folder), here)
    edited = one.where("id <> 4").withColumn("text", F.when(F.col("id") == 7, "quiet view").otherwise(F.col("text")))
    edited = edited.unionByName(spark.createDataFrame([(50, "new lift")], "id long, text string"))
    old, new = (write_snapshot(df, f"{tmp_path}/s{k}", "id", 8) for k, df in enumerate((one, edited)))
    index.add_feed(changed_rows(old, new), 1)
    agree(spark, index, sorted(tuple(r) for r in edited.collect()), tmp_path, "fresh")


def test_empty(spark, index):
    with pytest.raises(ValueError):
        index.open()
    index.add(spark.createDataFrame([], SCHEMA), 0, F.col("version"))
    asked = spark.createDataFrame([(1, "sea", [1.0, 0.0, 0.0, 0.0])], "q int, text string, embedding array<float>")
    assert search(index.open(), asked, "q", "text").count() == 0


def bytes_per_posting(spark, path):
    stored = spark.read.parquet(path)
    return sum(Path(f.removeprefix("file:")).stat().st_size for f in stored.inputFiles()) / stored.count()


def test_postings_are_written_in_place_and_compact(spark, tmp_path, monkeypatch):
    """Their ids are digests in no order: a dictionary holds each once, and no shuffle moves them."""
    monkeypatch.setattr(parts, "ranged_postings", lambda *a: pytest.fail("postings were shuffled"))
    index = PartIndex(spark, f"{tmp_path}/index", "id", "text", short_chunks, embed, fan=2, tier=100_000)
    words = F.concat_ws(" ", *[F.concat(F.lit("w"), (F.col("id") * k % 97).cast("string")) for k in range(1, 9)])
    rows = spark.range(20_000).withColumn("text", words)
    index.add(rows, 0, F.lit(0))
    folder = f"{index.path}/parts/b0/postings"
    assert bytes_per_posting(spark, folder) < 15
    terms = [r["term"] for r in spark.read.parquet(spark.read.parquet(folder).inputFiles()[0]).select("term").collect()]
    assert terms == sorted(terms)
    index.add(rows.limit(3).withColumn("text", F.lit("sea view")), 1, F.lit(1))
    assert len(index.parts()) == 1
    merged = spark.read.parquet(f"{index.path}/parts/{index.parts()[0]['name']}/postings")
    assert merged.where("term IN ('sea', 'view')").count() == 6 and bytes_per_posting(spark, f"{index.path}/parts/{index.parts()[0]['name']}/postings") < 15


def test_chunks_with_one_id_are_added_up(spark, tmp_path):
    def twice(df, key, text):
        return short_chunks(df, key, text).unionAll(short_chunks(df, key, text))

    index = PartIndex(spark, f"{tmp_path}/index", "id", "text", twice, embed)
    index.add(spark.createDataFrame([(1, 1, False, "sea lift sea")], SCHEMA), 0, F.col("version"))
    assert sorted(tuple(r) for r in index.open().words.postings.select("term", "doc_len", "tf").collect()) == [("lift", 3, 2), ("sea", 3, 4)]
