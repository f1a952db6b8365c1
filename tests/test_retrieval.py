from __future__ import annotations

import math
import random
import re
from collections import Counter
from pathlib import Path

import numpy as np
import pyarrow as pa
import pytest
from pyspark.ml.feature import HashingTF
from pyspark.sql import functions as F

from staysift.operators import hybrid, keyword, ranking
from staysift.operators.evaluate import containing_documents, retrieval_recall, retrieval_summary
from staysift.operators.hybrid import hybrid_topk, hybrid_topk_full
from staysift.operators.keyword import build_index
from staysift.operators import vectors as vectors_module
from staysift.operators.vectors import (
    fit_text_vectors,
    mean_vectors,
    text_vectors,
    vector_topk,
    vector_topk_cells,
)
from staysift.session import cut_lineage, scratch_path

RNG = random.Random(7)
WORDS = [f"w{i}" for i in range(60)]
DOCS = {
    i: " ".join(RNG.choices(WORDS, weights=[1 / (j + 1) for j in range(60)], k=RNG.randint(1, 60)))
    for i in range(150)
}
# A group of copies, a text of one repeated word, one without words.
DOCS |= {200 + i: DOCS[3] for i in range(70)}
DOCS |= {300: "w0 " * 500, 301: "-- !"}
ASKED = {
    "q1": "w0 w1 w2 w40 w41",
    "q2": "W59, w58; w0 w0",
    "q3": "nothing here",
    "q4": DOCS[3],
    "q5": "w0",
    "q6": " ".join(WORDS),
}


def words(text):
    return [t for t in re.split(r"[^\w]+|_", text.lower()) if t]


def brute_bm25(docs, asked, k, allowed=None):
    tf = {d: Counter(words(t)) for d, t in docs.items()}
    size = {d: sum(c.values()) for d, c in tf.items()}
    mean = sum(size.values()) / len(docs)
    df = Counter(t for c in tf.values() for t in c)
    out = []
    for q, text in asked.items():
        scores = {}
        for d, c in tf.items():
            hits = [t for t in set(words(text)) if t in c]
            if hits and (allowed is None or d in allowed):
                scores[d] = round(
                    sum(
                        math.log(1 + (len(docs) - df[t] + 0.5) / (df[t] + 0.5))
                        * c[t] * 2.2 / (c[t] + 1.2 * (0.25 + 0.75 * size[d] / mean))
                        for t in hits
                    ),
                    6,
                )
        best = sorted(scores.items(), key=lambda x: (-x[1], x[0]))[:k]
        out += [(q, d, s, n + 1) for n, (d, s) in enumerate(best)]
    return sorted(out)


@pytest.fixture(scope="module")
def index(spark):
    docs = spark.createDataFrame(list(DOCS.items()), "doc long, text string").repartition(3)
    return keyword.build_index(docs, scratch_path(spark, "t"), "doc", "text")


@pytest.fixture(scope="module")
def asked(spark):
    return spark.createDataFrame(list(ASKED.items()), "q string, text string")


def hits(df):
    return sorted((r.q, r.doc, r.score, r["rank"]) for r in df.collect())


def close(got, want):
    assert [(g[0], g[1], g[3]) for g in got] == [(w[0], w[1], w[3]) for w in want]
    assert np.allclose([g[2] for g in got], [w[2] for w in want], atol=2e-6)


@pytest.mark.parametrize("direct_pairs", [10**9, 0])
@pytest.mark.parametrize("k", [1, 5, 100])
def test_bm25_equals_brute_force(index, asked, k, direct_pairs):
    got = keyword.bm25_topk(index, asked, k, "q", "text", direct_pairs=direct_pairs, probe=10)
    close(hits(got), brute_bm25(DOCS, ASKED, k))


@pytest.mark.parametrize("direct_pairs", [10**9, 0])
def test_bm25_without_broadcasts(index, asked, direct_pairs, monkeypatch):
    monkeypatch.setattr(keyword, "BROADCAST_ROWS", 0)
    monkeypatch.setattr(keyword, "broadcast_if_small", lambda df, *a, **k: df)
    monkeypatch.setattr(keyword, "HOT_ROWS", 30)
    got = keyword.bm25_topk(index, asked, 5, "q", "text", direct_pairs=direct_pairs, probe=10)
    close(hits(got), brute_bm25(DOCS, ASKED, 5))


@pytest.mark.parametrize("direct_pairs", [10**9, 0])
def test_bm25_filters_before_ranking(spark, index, asked, direct_pairs):
    ids = [d for d in DOCS if d % 3 == 0]
    allowed = spark.createDataFrame([(i,) for i in ids], "doc long")
    got = keyword.bm25_topk(index, asked, 4, "q", "text", allowed, direct_pairs=direct_pairs)
    close(hits(got), brute_bm25(DOCS, ASKED, 4, set(ids)))


@pytest.mark.parametrize("named", [0, 10**6])
def test_words_named_in_the_scan(index, asked, monkeypatch, plan_of, named):
    monkeypatch.setattr(keyword, "NAMED_WORDS", named)
    close(hits(keyword.bm25_topk(index, asked, 5, "q", "text")), brute_bm25(DOCS, ASKED, 5))
    few = keyword.bm25_topk(index, asked.where("q = 'q5'"), 5, "q", "text")
    assert ("EqualTo(term,w0)" in plan_of(few)) == bool(named)
    close(hits(few), brute_bm25(DOCS, {"q5": ASKED["q5"]}, 5))


def test_index_tables(index):
    terms = {r.term: r for r in index.terms.collect()}
    tf = {d: Counter(words(t)) for d, t in DOCS.items()}
    assert terms["w0"].df == sum("w0" in c for c in tf.values())
    assert terms["w0"].max_tf == 500
    assert index.stats.first().n_docs == len(DOCS)
    assert index.postings.count() == sum(map(len, tf.values()))


# ---- vectors


def make_vectors(n=400, dims=8, seed=3):
    rng = np.random.default_rng(seed)
    v = rng.normal(size=(n, dims)) + rng.integers(0, 4, size=(n, 1)) * 2
    v[: n // 3] = v[0]  # a third are copies
    v[n - 1] = 0
    return v.astype(np.float32)


def brute_cosine(vectors, queries, k):
    def unit(m):
        m = m.astype(np.float64)
        norm = np.linalg.norm(m, axis=1, keepdims=True)
        return np.divide(m, norm, out=np.zeros_like(m), where=norm > 0)

    scores = np.round(unit(queries) @ unit(vectors).T, 6)
    out = []
    for q, row in enumerate(scores):
        best = sorted(range(len(row)), key=lambda i: (-row[i], i))[:k]
        out += [(q, i, row[i], n + 1) for n, i in enumerate(best)]
    return sorted(out)


@pytest.fixture(scope="module")
def vector_frames(spark):
    v, q = make_vectors(), make_vectors(40, seed=9)
    frame = spark.createDataFrame([(i, x.tolist()) for i, x in enumerate(v)], "vid long, embedding array<float>")
    asked = spark.createDataFrame([(i, x.tolist()) for i, x in enumerate(q)], "qid long, embedding array<float>")
    extra = spark.createDataFrame([(999, None)], "vid long, embedding array<float>")
    return v, q, frame.unionByName(extra).repartition(3), asked


def neighbours(df):
    return sorted((r.qid, r.vid, r.score, r["rank"]) for r in df.collect())


@pytest.mark.parametrize("k", [1, 5, 500])
def test_vector_topk(vector_frames, k):
    v, q, frame, asked = vector_frames
    assert neighbours(vector_topk(frame, asked, k, "vid", "qid")) == brute_cosine(v, q, k)


@pytest.mark.parametrize("k,pivots,block", [(1, 16, 50), (5, 64, 7), (200, 4, 100), (500, 8, 1000)])
def test_vector_topk_cells(vector_frames, k, pivots, block):
    v, q, frame, asked = vector_frames
    got = vector_topk_cells(frame, asked, k, "vid", "qid", pivots=pivots, block_rows=block)
    assert neighbours(got) == brute_cosine(v, q, k)


def test_many_queries_are_cut_into_blocks(vector_frames):
    v, q, frame, asked = vector_frames
    got = vector_topk(frame, asked, 3, "vid", "qid", query_numbers=8)
    assert neighbours(got) == brute_cosine(v, q, 3)


def test_small_batches_and_string_ids(spark, vector_frames):
    v, q, frame, asked = vector_frames
    assert neighbours(vector_topk(frame, asked, 7, "vid", "qid")) == brute_cosine(v, q, 7)
    named = frame.withColumn("vid", F.format_string("v%05d", "vid"))
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "16")
    try:
        got = neighbours(vector_topk(named, asked, 7, "vid", "qid"))
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    assert [(a, int(b[1:]), c, d) for a, b, c, d in got] == brute_cosine(v, q, 7)


def test_ragged_vectors_are_refused(spark, vector_frames):
    _, _, frame, asked = vector_frames
    bad = frame.unionByName(spark.createDataFrame([(1000, [1.0])], "vid long, embedding array<float>"))
    with pytest.raises(Exception, match="numbers"):
        vector_topk(bad, asked, 3, "vid", "qid").collect()


def test_equal_id_names_are_refused(index, asked, vector_frames):
    _, _, frame, _ = vector_frames
    with pytest.raises(ValueError, match="rename"):
        vector_topk(frame, frame, 3, "vid", "vid")
    with pytest.raises(ValueError, match="rename"):
        keyword.bm25_topk(index, asked.withColumnRenamed("q", "doc"), 3, "doc", "text")


def test_no_queries_no_rows(vector_frames):
    _, _, frame, asked = vector_frames
    assert vector_topk(frame, asked.where("false"), 3, "vid", "qid").count() == 0
    assert vector_topk_cells(frame.where("false"), asked, 3, "vid", "qid").count() == 0


def test_mean_vectors(spark):
    df = spark.createDataFrame([(1, [1.0, 2.0]), (1, [3.0, 4.0]), (2, [5.0, 5.0])], "g int, e array<float>")
    assert {r.g: r.e for r in mean_vectors(df, "g", "e").collect()} == {1: [2.0, 3.0], 2: [5.0, 5.0]}


def test_text_vectors_equal_brute_force(spark):
    docs = {d: t for d, t in DOCS.items() if d < 40}
    frame = spark.createDataFrame([*docs.items(), (-1, None)], "doc long, text string").where("doc >= 0")
    out = text_vectors(frame, "text", fit_text_vectors(frame, "text", dims=32))
    tf = HashingTF(numFeatures=32)
    counts = {d: Counter(tf.indexOf(w) for w in words(t)) for d, t in docs.items()}
    df = Counter(i for c in counts.values() for i in c)
    for r in out.collect():
        want = np.zeros(32)
        for i, n in counts[r.doc].items():
            want[i] = n * math.log((len(docs) + 1) / (df[i] + 1))
        norm = np.linalg.norm(want)
        assert np.allclose(r.embedding, want / norm if norm else want, atol=1e-6)


# ---- fusion and evaluation


def test_fuse_ranks(spark):
    a = spark.createDataFrame([("q", "x", 1), ("q", "y", 2)], "q string, doc string, rank int")
    b = spark.createDataFrame([("q", "y", 1), ("q", "z", 2), ("p", "z", 1)], "q string, doc string, rank int")
    out = sorted(tuple(r) for r in hybrid.fuse_ranks([a, b], 2, "q", "doc").collect())
    assert out == [("p", "z", round(1 / 61, 6), 1), ("q", "x", round(1 / 61, 6), 2), ("q", "y", round(1 / 62 + 1 / 61, 6), 1)]


@pytest.mark.parametrize("as_frame", [True, False])
def test_hybrid_filter_keeps_k_results(spark, index, as_frame):
    rng = np.random.default_rng(1)
    data = [(d, rng.normal(size=4).tolist()) for d in DOCS]
    vectors = spark.createDataFrame(data, "doc long, embedding array<double>")
    asked = spark.createDataFrame([("q1", "w0 w1", [1.0, 0.0, 0.0, 0.0])], "q string, text string, embedding array<double>")
    ids = [d for d in DOCS if d % 2]
    frame = spark.createDataFrame([(i,) for i in ids], "doc long")
    out = hybrid.hybrid_topk(index, vectors, asked, "q", "text", k=5, depth=10, filter_ids=frame if as_frame else ids)
    rows = out.collect()
    assert len(rows) == 5 and {r.doc for r in rows} <= set(ids)
    words_rank = {d: n for _, d, _, n in brute_bm25(DOCS, {"q1": "w0 w1"}, 10, set(ids))}
    v = np.array([x for d, x in data if d in set(ids)])
    near = {ids[i]: n for _, i, _, n in brute_cosine(v, np.array([[1.0, 0, 0, 0]]), 10)}
    fused = {d: round(sum(1 / (60 + r[d]) for r in (words_rank, near) if d in r), 6) for d in {*words_rank, *near}}
    want = sorted(fused.items(), key=lambda x: (-x[1], x[0]))[:5]
    assert [(r.doc, r.score) for r in sorted(rows, key=lambda r: r["rank"])] == want


def test_built_index_with_vectors_equals_the_parts(spark, index, asked):
    rng = np.random.default_rng(2)
    data = [(d, t, rng.normal(size=4).tolist()) for d, t in DOCS.items()]
    chunks = spark.createDataFrame(data, "doc long, text string, v array<double>")
    asked = asked.withColumn("embedding", F.array(*[F.lit(x) for x in (1.0, 0.5, 0.0, -1.0)]))
    path = scratch_path(spark, "h")
    hybrid.build_hybrid_index(chunks, path, "doc", "text", "v")
    built = hybrid.open_hybrid_index(spark, path, "doc", hashed=False)
    vectors = chunks.select("doc", F.col("v").alias("embedding"))
    want = hybrid.hybrid_topk(index, vectors, asked, "q", "text")
    found = hybrid.search(built, asked, "q", "text")
    assert sorted(found.collect()) == sorted(want.collect())


def test_built_index_makes_vectors(spark):
    docs = {1: "red house by the sea", 2: "blue house", 3: "sea sea sea", 4: "nothing alike"}
    frame = spark.createDataFrame(list(docs.items()), "doc long, text string")
    index = hybrid.build_hybrid_index(frame, scratch_path(spark, "h"), "doc", "text", dims=64)
    asked = spark.createDataFrame([("a", "red house"), ("b", "sea")], "q string, text string")
    best = {r.q: r.doc for r in hybrid.search(index, asked, "q", "text", k=1).collect()}
    assert best == {"a": 1, "b": 3}


@pytest.mark.parametrize("max_rows", [100, 0])
def test_attributes_of_hits(spark, max_rows):
    found = spark.createDataFrame([("q", 1, 0.5, 1), ("p", 1, 0.4, 1), ("p", 2, 0.3, 2)], "q string, doc long, score double, rank int")
    chunks = spark.createDataFrame([(1, "one"), (2, "two"), (3, "three")], "doc long, text string")
    out = hybrid.with_attributes(found, chunks, "doc", "q", max_rows)
    assert sorted((r.q, r.doc, r.text) for r in out.collect()) == [("p", 1, "one"), ("p", 2, "two"), ("q", 1, "one")]


def test_recall(spark):
    hits_ = spark.createDataFrame([("a", 1, 2), ("a", 5, 1), ("b", 1, 1)], "q string, doc long, rank int")
    truth = spark.createDataFrame([("a", 1), ("a", 2), ("a", 1), ("c", 1)], "q string, doc long")
    per = retrieval_recall(hits_, truth, "q", "doc")
    assert sorted(tuple(r) for r in per.collect()) == [("a", 2, 1, 0.5, 0.5), ("c", 1, 0, 0.0, 0.0)]
    assert tuple(retrieval_summary(per).first()) == (2, 0.25, 0.25)


def test_containing_documents(spark):
    docs = {1: "One two three four. Five", 2: "xone two threeish", 3: "one TWO three", 4: "two three four one", 5: "one two three"}
    asked = {"a": "one two three", "b": "ne two three", "c": "one unseen three", "d": "two three fo",
             "e": "ne t", "f": ".", "g": "", "h": "TWO", "i": "no such"}
    frame = spark.createDataFrame(list(docs.items()), "doc long, text string")
    index = keyword.build_index(frame, scratch_path(spark, "t"), "doc", "text")
    passages = spark.createDataFrame([*asked.items(), ("null", None)], "q string, passage string")
    got = containing_documents(index, frame, "text", passages, "q", "passage")
    want = sorted((q, d) for q, p in asked.items() for d, t in docs.items() if p in t)
    assert sorted(tuple(r) for r in got.collect()) == want


def test_hybrid_depth_follows_k(spark):
    docs = spark.range(300).select(F.col("id").alias("doc"), F.concat(F.lit("w "), F.col("id").cast("string")).alias("text"))
    index = keyword.build_index(docs, scratch_path(spark, "deep"), "doc", "text")
    vectors = docs.where("doc < 20").select("doc", F.array(F.lit(1.0), F.col("doc") / 100.0).alias("embedding"))
    asked = spark.createDataFrame([("q", "w", [1.0, 0.0]), ("no vector", "w", None)], "q string, text string, embedding array<double>")
    rows = hybrid.hybrid_topk(index, vectors, asked, "q", "text", k=120).collect()
    for q in ("q", "no vector"):
        assert sorted(r["rank"] for r in rows if r.q == q) == list(range(1, 121))
    with pytest.raises(ValueError):
        hybrid.hybrid_topk(index, vectors, asked, "q", "text", k=20, depth=10)
    ids = list(range(10, 40))  # half of them without a vector
    frame = spark.createDataFrame([(i,) for i in ids], "doc long")
    both = [
        sorted(tuple(r) for r in hybrid.hybrid_topk(index, vectors, asked, "q", "text", k=50, filter_ids=f).collect())
        for f in (ids, frame)
    ]
    assert both[0] == both[1] and {r[1] for r in both[0]} == set(ids)


def test_full_fusion_finds_what_is_deep_in_both_lists(spark, tmp_path):
    """Rank 51 of both lists beats the first of a single list; rankings of any depth agree."""
    tf = {**{i: 60 - i for i in range(50)}, 99: 5}
    words = [(i, "sea " * tf.get(i, 0) + "pad " * (100 - tf.get(i, 0))) for i in range(101)]
    turned = {**{i: 0.01 * (i - 50) for i in range(50, 99)}, 100: 0.6, 99: 1.0}
    vecs = [(i, [math.cos(a), math.sin(a)]) for i, a in turned.items()]
    index = build_index(spark.createDataFrame(words, "d long, text string"), f"{tmp_path}/w", "d", "text")
    vectors = spark.createDataFrame(vecs, "d long, embedding array<double>")
    queries = spark.createDataFrame([(1, "sea", [1.0, 0.0]), (2, "nothing", [0.0, 1.0]), (3, "sea", None)], "q int, text string, embedding array<double>")
    whole = hybrid_topk(index, vectors, queries, "q", "text", k=5, depth=101).collect()
    for depth in (5, 50, 200):
        got = hybrid_topk_full(index, vectors, queries, "q", "text", k=5, depth=depth).collect()
        assert sorted(map(str, got)) == sorted(map(str, whole)), depth
    cut = hybrid_topk(index, vectors, queries, "q", "text", k=5, depth=50).collect()
    assert [r["d"] for r in whole if r["q"] == 1 and r["rank"] == 1] == [99]
    assert 99 not in {r["d"] for r in cut if r["q"] == 1}


def test_full_fusion_counts_the_open_ranks(spark, tmp_path, monkeypatch):
    """Rankings are made once, at one depth; ranks beyond it are counted, ties and text keys included."""
    many = 400
    words = [(f"d{i:03}", "sea " * (1 + i % 30) + "pad " * 40 + ("sky " * 3 if i % 7 == 0 else "")) for i in range(many)]
    # Many equal vectors, and a nearest chunk that is far down by words.
    vecs = [(f"d{i:03}", [math.cos(a), math.sin(a)]) for i in range(0, many, 2) for a in [0.05 * ((i * 7) % 40)]]
    index = build_index(spark.createDataFrame(words, "d string, text string"), f"{tmp_path}/w", "d", "text")
    vectors = spark.createDataFrame(vecs, "d string, embedding array<double>")
    asked = [(1, "sea", [1.0, 0.0]), (2, "sky sea", [0.0, 1.0]), (3, "sky", [1.0, 1.0]), (4, "pad", None), (5, "none", [1.0, 0.2])]
    queries = spark.createDataFrame(asked, "q int, text string, embedding array<double>")
    whole = hybrid_topk(index, vectors, queries, "q", "text", k=5, depth=1000).collect()
    depths = []
    ranked = hybrid.bm25_topk
    monkeypatch.setattr(hybrid, "bm25_topk", lambda index, queries, k, *more: depths.append(k) or ranked(index, queries, k, *more))
    got = hybrid_topk_full(index, vectors, queries, "q", "text", k=5).collect()
    assert sorted(map(str, got)) == sorted(map(str, whole))
    assert len(depths) == 1 and depths[0] < many // 2


def test_ranks_are_counted_in_passes(spark):
    """Counted ranks equal sorted ones: null keys, ties, several passes, query vectors in blocks."""
    rows = [(g, k, s) for g in ("a", "b", "c") for k in [None, *range(40)] for s in [float((k or 0) * 7 % 5)]]
    scores = spark.createDataFrame(rows, "g string, k long, score double")
    want = ranking.numbered(scores, "g", [F.desc("score"), F.asc("k")]).select("g", "k", "rank").where("k IS NULL OR k % 3 = 0")
    wanted = scores.where("k IS NULL OR k % 3 = 0")
    for places in (20, 1000):
        got = ranking.ranks_by_count(
            wanted, "g", "k", lambda groups, make: ranking.counted_rows(scores, "g", "k", make), places=places
        )
        assert sorted(map(str, got.collect())) == sorted(map(str, want.collect()))
    vectors = spark.createDataFrame([(i, [1.0, i % 9 / 9]) for i in range(90)], "v long, embedding array<double>")
    queries = spark.createDataFrame([(q, [1.0, q / 5]) for q in range(5)], "q long, embedding array<double>")
    ranked = vectors_module.vector_topk(vectors, queries, 90, "v", "q").select("q", "v", "rank")
    wanted = ranked.where("rank % 8 = 0").select("q", "v").union(spark.createDataFrame([(1, 999)], "q long, v long"))
    for numbers in (4, 1000):
        got = vectors_module.vector_ranks(vectors, queries, wanted, "v", "q", query_numbers=numbers)
        assert sorted(map(str, got.collect())) == sorted(map(str, ranked.where("rank % 8 = 0").collect()))


def test_words_are_counted_without_a_shuffle(spark, plan_of, tmp_path):
    rows = [(1, "b a b", "x"), (2, None, "x"), (3, "", "y"), (None, "a", "z"), (4, "ä Ä 1", "z"), (1, "c b a", "x"), (1, "a", "x")]
    docs = spark.createDataFrame(rows, "id long, text string, more string")
    postings = keyword.make_postings(docs.where("id <> 1 OR id IS NULL"), "id", "text", "more")
    assert "Exchange" not in plan_of(postings)
    assert postings.columns == ["id", "term", "doc_len", "more", "tf"]
    assert set(map(tuple, postings.collect())) == {(None, "a", 1, "z", 1), (4, "ä", 3, "z", 2), (4, "1", 3, "z", 1)}
    # Rows of a key with the same length are added up, as one of them would be.
    built = build_index(docs, str(tmp_path), "id", "text").postings
    got = {tuple(r) for r in built.select("id", "term", "doc_len", "tf").collect()}
    twice = {(1, "a", 3, 2), (1, "b", 3, 3), (1, "c", 3, 1), (1, "a", 1, 1)}
    assert got == twice | {(None, "a", 1, 1), (4, "ä", 3, 2), (4, "1", 3, 1)} and built.count() == 7


def test_postings_are_dealt_once_whatever_the_number_of_queries(index, asked, plan_of):
    qid = asked.columns[0]
    plan = plan_of(keyword.bm25_topk(index, asked, 3, qid, "text"))
    dealt = [line for line in plan.splitlines() if "hashpartitioning(" in line]
    assert any("REPARTITION_BY_NUM" in line for line in dealt)
    assert not any(f"hashpartitioning({qid}#" in line and f", {index.key}#" in line for line in dealt)


def test_bounded_search_reads_the_index_once(spark, index, asked, plan_of):
    """Several passes go over the asked postings alone, which were written with numbers for their terms."""
    qid = asked.columns[0]
    found = keyword.bm25_topk(index, asked, 3, qid, "text", direct_pairs=0, probe=1)
    assert "/postings" not in plan_of(found)
    plain = keyword.bm25_topk(index, asked, 3, qid, "text")
    assert sorted(map(str, found.collect())) == sorted(map(str, plain.collect()))


def test_asked_postings_follow_their_document(spark, monkeypatch):
    """A key that follows itself takes next to no room; a run's end is no end of the rows."""
    terms = spark.range(8).select(F.concat(F.lit("w"), "id").alias("term"))
    rows = spark.range(20_000).select(F.sha2(F.col("id").cast("string"), 256).alias("key")).crossJoin(F.broadcast(terms))
    rows = rows.unionAll(terms.select(F.lit(None).cast("string").alias("key"), "term"))
    rows = rows.withColumns({"tf": F.lit(1).cast("long"), "doc_len": F.lit(8)})
    postings = cut_lineage(rows.coalesce(1).sortWithinPartitions("term"))
    asked = terms.withColumn("q", F.lit(1))
    kept, numbered = keyword._asked_postings(postings, asked, "key")
    size = sum(Path(f.removeprefix("file:")).stat().st_size for f in kept.inputFiles())
    assert size < 25 * kept.count()
    assert kept.where("key IS NULL").count() == 8 and numbered.count() == 8
    assert kept.groupBy("key").count().where("count <> 8").count() == 0
    monkeypatch.setattr(keyword, "RUN_ROWS", 3)
    batches = [pa.record_batch({"k": k, "n": n}) for k, n in ((["b", None], [1, 2]), (["a"], [3]), ([], []), (["c"], [4]))]
    batches[2] = batches[0].slice(0, 0)
    runs = [r.to_pydict() for r in keyword._runs(iter(batches), "k")]
    assert runs == [{"k": ["a", "b", None], "n": [3, 1, 2]}, {"k": ["c"], "n": [4]}]
