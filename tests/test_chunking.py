from __future__ import annotations

import pytest
from hypothesis import given, settings, strategies as st
from pyspark.errors import AnalysisException

from staysift.functions.sqlfuncs import register_text_chunks
from staysift.functions.tablefuncs import register_chunks_table
from staysift.operators.chunking import SEPARATORS, chunk_spans, fixed_chunks, recursive_chunks


def plain_split(text, size, overlap, separators):
    """The same contract written with lists of pieces, one piece at a time."""
    sep = next(s for s in separators if s == "" or s in text)
    rest = separators[separators.index(sep) + 1 :]
    if sep == "":
        pieces = list(text)
    else:
        first, *others = text.split(sep)
        pieces = [x for x in [first, *[sep + o for o in others]] if x]
    out, good = [], []

    def flush():
        current = []
        for piece in good:
            if current and sum(map(len, current)) + len(piece) > size:
                out.append("".join(current))
                while sum(map(len, current)) > overlap or (current and sum(map(len, current)) + len(piece) > size):
                    current.pop(0)
            current.append(piece)
        if current:
            out.append("".join(current))
        good.clear()

    for piece in pieces:
        if len(piece) < size or sep == "":
            good.append(piece)
        else:
            flush()
            out.extend(plain_split(piece, size, overlap, rest) if rest else [piece])
    flush()
    return out


texts = st.text(alphabet=st.sampled_from("ab \n"), min_size=1, max_size=120)


@settings(max_examples=400, deadline=None)
@given(texts, st.integers(2, 20), st.integers(0, 10))
def test_spans_follow_the_contract(text, size, overlap):
    overlap = min(overlap, size - 1)
    spans = list(chunk_spans(text, 0, len(text), size, overlap, SEPARATORS))
    pieces = [text[a:b] for a, b in spans]
    assert [p.strip() for p in pieces if p.strip()] == [
        p.strip() for p in plain_split(text, size, overlap, list(SEPARATORS)) if p.strip()
    ]
    assert all(0 < b - a <= size for a, b in spans)
    covered = {i for a, b in spans for i in range(a, b)}
    assert covered == set(range(len(text)))
    if len(text) < size:
        assert spans == [(0, len(text))]


TEXTS = [
    (0, None),
    (1, ""),
    (2, "word"),
    (3, "x" * 5000),
    (4, "para one\n\n" + "line\n" * 300 + "\n\npara three " + "w " * 700),
    (5, "é" * 999 + " " + "ß" * 1500),
    (6, " \n "),
]


def test_recursive_chunks(spark):
    df = spark.createDataFrame(TEXTS, "id long, text string").selectExpr("*", "id * 2 AS carried")
    rows = recursive_chunks(df, "id", "text").collect()
    got = {}
    for r in sorted(rows, key=lambda r: (r.id, r.chunk_no)):
        got.setdefault(r.id, []).append(r.text)
        assert r.carried == r.id * 2
    for key, text in TEXTS:
        want = [p.strip() for p in plain_split(text, 1000, 200, list(SEPARATORS)) if p.strip()] if text else []
        assert got.get(key, []) == want
    numbers = {}
    for r in rows:
        numbers.setdefault(r.id, set()).add(r.chunk_no)
    assert all(n == set(range(len(n))) for n in numbers.values())
    assert len({r.chunk_id for r in rows}) == len(rows)
    again = recursive_chunks(df.repartition(3), "id", "text").collect()
    assert {(r.id, r.chunk_no, r.chunk_id) for r in again} == {(r.id, r.chunk_no, r.chunk_id) for r in rows}


@pytest.mark.parametrize("size,overlap", [(1000, 200), (10, 0), (7, 5), (10, 9)])
def test_fixed_chunks(spark, size, overlap):
    data = [(i, t) for i, t in TEXTS] + [(100 + n, "abcdefghij\n" * 3 + "z" * n) for n in range(12)]
    data.append((200, "a\U0001f600b" * 20))
    df = spark.createDataFrame(data, "id long, text string")
    got = {}
    for r in sorted(fixed_chunks(df, "id", "text", size, overlap).collect(), key=lambda r: (r.id, r.chunk_no)):
        got.setdefault(r.id, []).append(r.text)
    stride = size - overlap
    for key, text in data:
        want = []
        if text:
            n = max(1, -(-(len(text) - overlap) // stride))
            want = [text[i * stride : i * stride + size] for i in range(n)]
        assert got.get(key, []) == want, key


def test_chunks_in_sql(spark):
    register_text_chunks(spark, "few_chars", size=20, overlap=5)
    df = spark.createDataFrame(TEXTS, "id long, text string")
    df.createOrReplaceTempView("texts")
    got = spark.sql("SELECT id, n, c FROM texts LATERAL VIEW posexplode(few_chars(text)) t AS n, c").collect()
    want = recursive_chunks(df, "id", "text", size=20, overlap=5).select("id", "chunk_no", "text").collect()
    assert sorted(tuple(r) for r in got) == sorted(tuple(r) for r in want)


def test_the_last_separator_is_the_fallback(spark):
    df = spark.createDataFrame([(1, "abcdef" * 10), (2, "a b")], "id long, text string")
    out = recursive_chunks(df, "id", "text", size=5, overlap=1, separators=("\n", " ")).collect()
    assert sorted((r.id, r.text) for r in out) == [(1, "abcdef" * 10), (2, "a b")]


@pytest.mark.parametrize("size, overlap", [(5, 5), (5, 9), (5, -1), (0, 0)])
def test_overlap_has_to_be_below_the_size(spark, size, overlap):
    df = spark.createDataFrame([(1, "abc")], "id long, text string")
    for chunks in (fixed_chunks, recursive_chunks):
        with pytest.raises(ValueError):
            chunks(df, "id", "text", size=size, overlap=overlap)


def test_chunks_as_a_table_function(spark):
    register_chunks_table(spark, "cut_up")
    rows = [(1, "aa bb cc dd ee ff gg", 7), (2, None, 8), (2, "xx yy", 9), (None, "no key", 1), (3, "", 2), (4, "  ", 3)]
    df = spark.createDataFrame(rows, "id int, body string, extra int")
    df.createOrReplaceTempView("to_cut")
    want = recursive_chunks(df, "id", "body", size=8, overlap=2)
    for table in ("TABLE(to_cut)", "TABLE(to_cut) PARTITION BY (id)"):
        got = spark.sql(f"SELECT * FROM cut_up({table}, 'body', 'id', 8, 2)")
        assert got.columns == ["id", "extra", "chunk_no", "text", "chunk_id"]
        assert sorted(map(str, got.collect())) == sorted(map(str, want.select(*got.columns).collect()))
    assert spark.sql("SELECT * FROM cut_up(TABLE(to_cut), text => 'body', key => 'id') WHERE id = 1").count() == 1
    for bad in ("TABLE(to_cut), 'nope', 'id'", "TABLE(to_cut), 'body', 'nope'", "TABLE(to_cut), 'body', 'id', 5, 5",
                "TABLE(SELECT id, body, 1 AS text FROM to_cut), 'body', 'id'"):
        with pytest.raises(AnalysisException):
            spark.sql(f"SELECT * FROM cut_up({bad})").collect()
