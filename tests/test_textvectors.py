"""Signed text vectors against a loop."""

from __future__ import annotations

import hashlib
import math

import numpy as np
import pytest

from staysift.operators.textvectors import fit_signed_vectors, signed_vectors

TEXTS = ["The cat, the dog", "a cat", "", None, "Über 9 cats", "cat " * 500, "the the dog"]


def plain(texts, dims):
    counts = []
    for t in texts:
        words = "".join(c if c.isalnum() else " " for c in (t or "").lower()).split()
        row = {}
        for w in words:
            d = hashlib.md5(w.encode()).hexdigest()
            row.setdefault(int(d[:8], 16) % dims, []).append(-1 if int(d[8], 16) % 2 else 1)
        counts.append(row)
    n = sum(t is not None for t in texts)
    out = []
    for row in counts:
        v = np.zeros(dims)
        for place, signs in row.items():
            v[place] = sum(signs) * math.log((n + 1) / (sum(place in r for r in counts) + 1))
        out.append(v / np.linalg.norm(v) if v.any() else v)
    return out


@pytest.mark.parametrize("dims", [5, 64])
def test_vectors_equal_those_of_a_loop(spark, dims):
    rows = [(i, t, [i], "kept") for i, t in enumerate(TEXTS)]
    df = spark.createDataFrame(rows, "id int, text string, _words array<int>, embedding string").repartition(3)
    got = signed_vectors(df, "text", fit_signed_vectors(df, "text", dims)).collect()
    want = plain(TEXTS, dims)
    assert len(got) == len(TEXTS)
    for r in got:
        assert r._words == [r.id]
        if r.text is None:
            assert r.embedding is None
        else:
            assert np.allclose(r.embedding, want[r.id])


def test_empty_tables_and_other_texts(spark):
    df = spark.createDataFrame([(1, "one two")], "id int, text string")
    none = fit_signed_vectors(df.limit(0), "text", 8)
    assert none.n == 0 and not none.idf.any()
    assert signed_vectors(df, "text", none).first().embedding == [0.0] * 8
    assert signed_vectors(df.limit(0), "text", none).count() == 0


def test_texts_with_common_terms_are_near(spark):
    texts = [f"subject{i // 2} subject{i // 2}a subject{i // 2}b word{i}" for i in range(40)]
    df = spark.createDataFrame([*enumerate(texts)], "id int, text string")
    rows = signed_vectors(df, "text", fit_signed_vectors(df, "text", 512)).orderBy("id").collect()
    m = np.array([r.embedding for r in rows])
    scores = m @ m.T - 2 * np.eye(40)
    assert (scores.argmax(axis=1) == np.arange(40) ^ 1).mean() > 0.9
