"""Columns with names that the operators use themselves: their values come out as they went in."""

from __future__ import annotations

import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from staysift.llm import mixing, simhash, toxicity

CLASHING = (
    "_key array<int>, _hash string, _HASH_ string, _copy long, _words array<string>, _toxicity string, _row int,"
    " _text string, _row_hash string, _source string, _turn int, _parts int, sid long, component string, `a b` int, _repeats string"
)


def frame(spark, n=60):
    rows = []
    for i in range(n):
        text = " ".join(f"w{i * j % 97}x{i}" for j in range(30)) + (" awful" if i % 3 == 0 else "")
        own = ([i], f"h{i}", f"H{i}", -i, [f"x{i}"], f"t{i}", i, f"own {i}", "r", f"s{i}", 9, 8, i, f"c{i}", i, f"p{i}")
        rows.append((i, text, f"src{i % 3}", *own))
    rows += rows[:5]
    return spark.createDataFrame(rows, f"doc_id long, text string, source string, {CLASHING}")


def values(df, but=()):
    return {r.doc_id: tuple(r[c] for c in df.columns if c not in but) for r in df.collect()}


def test_near_duplicates_keep_values(spark):
    df = frame(spark)
    kept = simhash.keep_one(df)
    assert kept.columns == df.columns
    before, after = values(df), values(kept)
    assert after and all(before[i] == v for i, v in after.items())
    assert kept.count() == len(after)


def test_toxicity_keeps_values(spark):
    df = frame(spark)
    labels = df.selectExpr("doc_id", "cast(doc_id % 3 = 0 as int) AS toxic").distinct()
    kept = toxicity.drop_toxic(df, toxicity.train(df, labels))
    assert kept.columns == df.columns
    before, after = values(df), values(kept)
    assert after and all(before[i] == v for i, v in after.items())


@pytest.mark.parametrize("share", [mixing.SHARE, 0.5])
def test_mix_keeps_values(spark, share):
    df = frame(spark)
    mixed = mixing.mixed_documents(df, share=share)
    assert mixed.columns == df.columns
    before, after = values(df, ["text"]), values(mixed, ["text"])
    assert after and all(before[i] == v for i, v in after.items())
    texts = values(df.select("doc_id", "text"))
    assert all(set(r.text.split()) <= set(texts[r.doc_id][1].split()) for r in mixed.collect())


def test_stages_keep_values(spark):
    df = frame(spark)
    before = values(df, ["text"])
    docs = df.selectExpr("*", "length(text) AS n_chars")
    for stage in (corpus_pipeline.without_repeats, corpus_pipeline.mixed):
        out = stage(spark, docs, "")
        assert out.columns == docs.columns
        after = values(out, ["text", "n_chars"])
        assert after and all(before[i] == v for i, v in after.items())


def test_stages_take_empty_tables_and_null_texts(spark):
    docs = frame(spark).selectExpr("*", "length(text) AS n_chars")
    labels = docs.selectExpr("doc_id", "cast(doc_id % 3 = 0 as int) AS toxic").distinct()
    machine = toxicity.train(docs, labels)
    empty = docs.limit(0)
    assert toxicity.drop_toxic(empty, toxicity.train(empty, labels)).count() == 0
    assert toxicity.drop_toxic(empty, machine).count() == 0
    nulls = docs.limit(4).withColumn("text", F.lit(None).cast("string"))
    for stage in (corpus_pipeline.without_near_copies, corpus_pipeline.without_repeats, corpus_pipeline.mixed):
        assert stage(spark, empty, "").count() == 0
    assert corpus_pipeline.without_near_copies(spark, nulls, "").count() == 1
    assert corpus_pipeline.without_repeats(spark, nulls, "").where("text = '' OR text IS NULL").count() == 4
    assert corpus_pipeline.mixed(spark, nulls, "").count() == 0
