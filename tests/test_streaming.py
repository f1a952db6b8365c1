from __future__ import annotations

from pathlib import Path

import pytest
from pyspark.sql import functions as F

from staysift.operators import keyword
from staysift.operators.chunking import fixed_chunks, recursive_chunks
from staysift.plans.fixtures import update_events
from staysift.session import scratch_path
from staysift.sources.tables import stream_table
from staysift.streaming.sync import compact_index, live_chunks, sync_index
from staysift.streaming.updates import flatten_updates

SCHEMA = "id long, version int, gone boolean, text string"


def drop_files(spark, folder, rows):
    spark.createDataFrame(rows, SCHEMA).write.mode("append").parquet(folder)


def stream(spark, folder):
    return spark.readStream.schema(SCHEMA).parquet(folder)


def sync(spark, folder, path, chunker=fixed_chunks):
    sync_index(
        stream(spark, folder), path, "id", "text", chunker,
        version=F.col("version"), deleted=F.col("gone"),
    )


def rows_of(df):
    return sorted((r.id, r.chunk_no, r.text, r.chunk_id) for r in df.collect())


FIRST = [(1, 1, False, "a" * 1500), (2, 1, False, "two words"), (3, 1, None, "to go"), (4, 1, False, None)]
SECOND = [(1, 2, False, "short now"), (3, 2, True, None), (5, 1, False, "new"), (5, 2, False, "newer"), (2, 2, False, None)]
LIVE = [(1, "short now"), (5, "newer")]


@pytest.mark.parametrize("chunker", [fixed_chunks, recursive_chunks])
def test_two_runs_equal_one_batch(spark, tmp_path, chunker):
    folder, path = str(tmp_path / "in"), str(tmp_path / "out")
    drop_files(spark, folder, FIRST)
    sync(spark, folder, path, chunker)
    first = spark.createDataFrame([(r[0], r[3]) for r in FIRST], "id long, text string")
    assert rows_of(live_chunks(spark, path, "id")) == rows_of(chunker(first, "id", "text"))
    drop_files(spark, folder, SECOND)
    sync(spark, folder, path, chunker)
    want = chunker(spark.createDataFrame(LIVE, "id long, text string"), "id", "text")
    assert rows_of(live_chunks(spark, path, "id")) == rows_of(want)
    before = rows_of(live_chunks(spark, path, "id"))
    sync(spark, folder, path, chunker)  # nothing new: nothing changes
    assert rows_of(live_chunks(spark, path, "id")) == before
    drop_files(spark, folder, [(5, 0, False, "older, but late"), (3, 1, True, None)])
    sync(spark, folder, path, chunker)
    assert rows_of(live_chunks(spark, path, "id")) == before


@pytest.mark.parametrize("parts", [1, 3])
def test_a_table_is_a_file_or_a_folder_of_files(spark, tmp_path, parts):
    rows = spark.createDataFrame([(i, f"text {i}") for i in range(9)], "doc_id long, text string")
    for name in ("documents", "others"):
        rows.repartition(parts, "doc_id").write.parquet(str(tmp_path / f"{name}.parquet"))
    if parts == 1:  # the one file under the table's own name
        folder = (tmp_path / "documents.parquet").rename(tmp_path / "old")
        next(folder.glob("part-*")).rename(tmp_path / "documents.parquet")
    path = str(tmp_path / "out")
    sync_index(stream_table(spark, str(tmp_path), "documents"), path, "doc_id", "text", fixed_chunks, version=F.lit(0))
    got = live_chunks(spark, path, "doc_id").select("doc_id", "chunk_no", "text", "chunk_id")
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, fixed_chunks(rows, "doc_id", "text").select(got.columns).collect()))


def test_compacted_index_equals_a_fresh_one(spark, tmp_path):
    folder, path = str(tmp_path / "in"), str(tmp_path / "out")
    for part in (FIRST, SECOND):
        drop_files(spark, folder, part)
        sync(spark, folder, path)
    merged = compact_index(spark, path, str(tmp_path / "merged"), "id")
    chunks = fixed_chunks(spark.createDataFrame(LIVE, "id long, text string"), "id", "text")
    fresh = keyword.build_index(chunks, scratch_path(spark, "t"), "chunk_id", "text")
    for table in ("postings", "terms", "stats"):
        a, b = getattr(merged, table), getattr(fresh, table)
        assert sorted(a.select(*b.columns).collect()) == sorted(b.collect())
    asked = spark.createDataFrame([("q", "newer short two")], "q string, text string")
    found = lambda ix: sorted(tuple(r) for r in keyword.bm25_topk(ix, asked, 5, "q", "text").collect())
    assert found(merged) == found(fresh) and len(found(merged)) == 2


def test_flatten_updates_batch_and_stream(spark, tmp_path):
    turns = spark.createDataFrame(
        [(1, 0, "system", "x"), (1, 1, "user", "a\nb"), (2, 0, "tool", None)], "conv_id int, turn int, role string, text string"
    )
    want = [("1:1", 0, "user", 0, "user", "a"), ("1:1", 0, "user", 1, "user", "b")]
    assert sorted(tuple(r) for r in flatten_updates(update_events(turns), "event_id").collect()) == want
    folder = str(tmp_path / "turns")
    turns.write.parquet(folder)
    source = spark.readStream.schema(turns.schema).parquet(folder)
    flat = flatten_updates(update_events(source), "event_id")
    query = flat.writeStream.format("memory").queryName("flat_out").trigger(availableNow=True).start()
    query.awaitTermination()
    assert sorted(tuple(r) for r in spark.table("flat_out").collect()) == want


def test_flatten_keeps_order_of_nodes(spark):
    events = spark.sql(
        "SELECT 7 AS id, map('agent', named_struct('messages', array(named_struct('role', 'a', 'content', '1'),"
        " named_struct('role', 'a', 'content', '2'))), 'tools', named_struct('messages',"
        " array(named_struct('role', 't', 'content', '3'))), 'none', NULL) AS updates"
    )
    out = flatten_updates(events, "id").orderBy("node_no", "message_no").collect()
    assert [(r.node_no, r.node, r.message_no, r.content) for r in out] == [
        (0, "agent", 0, "1"), (0, "agent", 1, "2"), (1, "tools", 0, "3")]


def test_live_rows_are_not_shuffled(spark, tmp_path, plan_of):
    folder, path = str(tmp_path / "in"), str(tmp_path / "out")
    drop_files(spark, folder, FIRST)
    sync(spark, folder, path)
    drop_files(spark, folder, SECOND)
    sync(spark, folder, path)
    live = live_chunks(spark, path, "id")
    plan = plan_of(live)
    assert "LeftAnti" in plan and "chunk_id" not in "".join(line for line in plan.splitlines() if "hashpartitioning" in line)
    assert sorted(r["text"] for r in live.collect()) == ["new" + "er", "short now"]


def test_compacted_postings_name_a_chunk_once_a_row_group(spark, tmp_path):
    words = F.concat_ws(" ", *[F.concat(F.lit("w"), (F.col("id") * k % 97).cast("string")) for k in range(1, 9)])
    folder, path = str(tmp_path / "in"), str(tmp_path / "out")
    spark.range(20_000).select("id", F.lit(1).alias("version"), F.lit(False).alias("gone"), words.alias("text")).write.parquet(folder)
    sync(spark, folder, path)
    stored = compact_index(spark, path, str(tmp_path / "merged"), "id").postings
    size = sum(Path(f.removeprefix("file:")).stat().st_size for f in stored.inputFiles())
    assert size < 15 * stored.count()
    terms = [r["term"] for r in spark.read.parquet(stored.inputFiles()[0]).select("term").collect()]
    assert terms == sorted(terms)
