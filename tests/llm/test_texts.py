"""Token coder, packing, token store, SimHash and suffix dedup against plain versions."""

from __future__ import annotations

import hashlib
import random
import re
import zlib

import numpy as np
import public_tokenizers
import pytest
import xxhash
from hypothesis import given, settings, strategies as st
from pyspark.sql import functions as F

from staysift.llm import packing, simhash, suffix, token_store, tokens
from staysift.llm.tokens import coder, runs

PATH = public_tokenizers.path("byte_bpe_50k.json")
SCHEMA = "doc_id long, text string, fp string, _key int, bytes double, ids string, _hash long"
LONG = " ".join(f"word{i % 977}" for i in range(20_000))
ROWS = [
    (5, "The same text, twice.", "a", 1, 0.5, "x", 1),
    (5, "The same text, twice.", "a", 1, 0.5, "x", 1),
    (5, "Another text under the same key.", None, None, None, None, None),
    (None, "No key at all", "b", 2, 0.1, None, 3),
    (None, None, "b", 2, 0.1, None, 3),
    (1, "", "b", 2, 0.1, None, 3),
    (2, None, "b", 2, 0.1, None, 3),
    (3, LONG, "b", 2, 0.1, None, 3),
    (4, " \n\t ", "b", 2, 0.1, None, 3),
    (9, "Ünïcödé 中文  x\x1c\x85y  z<|endoftext|> end", "b", 2, 0.1, None, 3),
]


@pytest.fixture(scope="module")
def odd(spark):
    return spark.createDataFrame(ROWS, SCHEMA)


@pytest.fixture(scope="module")
def small(spark):
    return spark.read.parquet("/root/testdata/sf0.001/documents.parquet")


def ids_of(text):
    return [*coder(PATH).tokenizer.encode(text or "", add_special_tokens=False).ids, 2]


def crc(ids):
    return zlib.crc32(np.array(ids, "<u4").tobytes())


@settings(max_examples=300, deadline=None)
@given(st.lists(st.text(st.sampled_from("ab'sÉ9.,中 \n\t\x85 \x1c\x00<|>endoftx"), max_size=40)))
def test_pieces_give_the_ids_of_whole_texts(texts):
    got = coder(PATH).encode(texts)
    for text, ids in zip(texts, got):
        assert np.frombuffer(ids, "<u4").tolist() == ids_of(text)[:-1]


def test_ids_stay_right_when_tables_of_words_are_full(monkeypatch):
    monkeypatch.setattr(tokens, "_KEPT", 7)
    coding = tokens.PieceCoder(PATH)
    words = ["ab", "Émile", "", "\1", "a\0", "x" * 30, "it's", "a,b", "中文", "9"]
    for n in range(40):
        texts = [" ".join(words[(n * i + j) % len(words)] + str(j % (n + 1)) for j in range(9)) for i in range(5)]
        for text, ids in zip(texts, coding.encode([*texts, ""])):
            assert np.frombuffer(ids, "<u4").tolist() == ids_of(text)[:-1]


def test_runs_cover_all_texts():
    texts = ["x" * n for n in (3, 0, 50, 1, 1)]
    assert [i for a, b in runs(texts, 4) for i in range(a, b)] == list(range(5))
    assert list(runs([])) == []


def test_bins_hold_no_more_than_their_length_and_close_the_fullest():
    bins = packing.OpenBins(10, 2)
    assert [bins.place(n) for n in (6, 5, 4)] == [(0, 0), (1, 0), (0, 6)]
    assert bins.place(9) == (2, 0)
    assert bins.place(8) == (3, 0)  # a third open bin: number 2, with one place left, closes
    assert bins.place(1) == (3, 8)
    assert bins.place(5) == (1, 5)


def check_packing(rows, docs, length):
    """Pieces hold the documents' ids, and lie in their sequences without gaps or overlaps."""
    left = {}
    for r in rows:
        left.setdefault((r.doc_id, r.piece, r.start, crc(np.frombuffer(bytes(r.ids), "<u4"))), []).append(r)
    total = 0
    for key, text in docs:
        ids = ids_of(text)
        total += len(ids)
        cuts = packing.cut_points(len(ids), length)
        assert all(b - a == length for a, b in zip(cuts[1:], [*cuts[2:], len(ids)]))
        for piece, (a, b) in enumerate(zip(cuts, [*cuts[1:], len(ids)])):
            r = left[(key, piece, a, crc(ids[a:b]))].pop()
            assert r.length == b - a <= length
    assert not any(left.values())
    by = {}
    for r in rows:
        by.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for pieces in by.values():
        at = 0
        for offset, n in sorted(pieces):
            assert offset == at
            at += n
        assert at <= length
    return len(by), total


def test_packing_of_odd_rows(odd):
    rows = packing.pack(odd, PATH, length=64, open_bins=3).collect()
    check_packing(rows, [r[:2] for r in ROWS], 64)
    assert not packing.pack(odd.limit(0), PATH).collect()


def test_packing_is_tight(small):
    rows = packing.pack(small.coalesce(1), PATH).collect()
    used, total = check_packing(rows, [(r.doc_id, r.text) for r in small.collect()], 1024)
    assert used <= 1.02 * total / 1024 + 1


def store_rows(df, **options):
    store = token_store.write_store(df, PATH, **options)
    return store, token_store.fetch(store, df).union(token_store.fetch_unkeyed(store)).collect()


@pytest.mark.parametrize("bucket_keys", [2, 1000])
def test_store_gives_back_every_document(odd, bucket_keys):
    _, rows = store_rows(odd, bucket_keys=bucket_keys)
    got = sorted((r.doc_id is not None, r.doc_id or 0, r.n_tokens, crc(np.frombuffer(bytes(r.ids), "<u4"))) for r in rows)
    want = sorted((r[0] is not None, r[0] or 0, len(ids_of(r[1])), crc(ids_of(r[1]))) for r in ROWS)
    assert got == want
    # Starts run through in ascending key order, null keys first.
    rows.sort(key=lambda r: r.start)
    at = 0
    for r in rows:
        assert r.start == at
        at += r.n_tokens
    keys = [r.doc_id for r in rows]
    assert keys == sorted(keys, key=lambda k: (k is not None, k or 0))


def test_store_answers_only_for_its_keys(spark, odd):
    store, _ = store_rows(odd)
    asked = spark.createDataFrame([(77,), (3,), (3,), (None,)], "doc_id long")
    assert [r.doc_id for r in token_store.fetch(store, asked).collect()] == [3]
    assert store_rows(odd.limit(0))[1] == []


def test_perfect_hash_is_minimal():
    rng = np.random.default_rng(1)
    h1, h2 = (rng.integers(0, 2**64, 5000, dtype=np.uint64) for _ in range(2))
    h1[:50] = h1[50:100]  # equal first hashes
    levels = token_store.perfect_hash(h1, h2)
    assert sorted(token_store.slots_of(levels, h1, h2).tolist()) == list(range(5000))


def test_store_query_over_documents(spark, small):
    from staysift.llm.queries import QUERIES

    got = {r.doc_id: (r.start, r.n_tokens, r.ids_crc32) for r in QUERIES["op1_token_store"](spark, "/root/testdata/sf0.001").collect()}
    at, want = 0, {}
    for r in small.orderBy("doc_id").collect():
        ids = ids_of(r.text)
        want[r.doc_id] = (at, len(ids), crc(ids))
        at += len(ids)
    assert got == want


def plain_fingerprint(text):
    text = re.sub("[A-Z]", lambda m: m[0].lower(), text or "")
    words = re.findall(r"[^\x20\x09-\x0D]+", text)
    if not words:
        return 0
    shingles = [" ".join(words[i : i + 4]) for i in range(max(1, len(words) - 3))]
    hashes = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def plain_components(prints, keys, radius=4):
    up = list(range(len(prints)))

    def root(x):
        while up[x] != x:
            x = up[x]
        return x

    for i in range(len(prints)):
        for j in range(i):
            if (prints[i] ^ prints[j]).bit_count() <= radius:
                up[max(root(i), root(j))] = min(root(i), root(j))
    low = {}
    for i, k in enumerate(keys):
        if k is not None:
            low[root(i)] = min(k, low.get(root(i), k))
    return [low.get(root(i)) for i in range(len(prints))]


@settings(max_examples=60, deadline=None)
@given(st.text(st.sampled_from("abAÉ \n \x1c"), max_size=60))
def test_fingerprints(text):
    assert simhash.fingerprint(text) == plain_fingerprint(text)


def test_tree_follows_every_edge_that_can_lead_to_a_hit():
    rng = random.Random(3)
    base = [rng.getrandbits(64) for _ in range(20)]
    values = [b ^ sum(1 << rng.randrange(64) for _ in range(rng.randrange(6))) for b in base for _ in range(20)]
    tree = simhash.BKTree()
    for v in values:
        tree.add(v)
    for v in values[::7]:
        want = [i for i, w in enumerate(values) if (v ^ w).bit_count() <= 4]
        assert sorted(tree.near(v, 4)) == want


@pytest.mark.parametrize("rows", [10, 10**8, 10**10, 10**12])
def test_some_table_holds_every_pair_within_the_radius(rows):
    masks, rng = simhash.block_masks(rows), random.Random(rows)
    for _ in range(300):
        change = sum(1 << b for b in rng.sample(range(64), 4))
        assert any(change & m == 0 for m in masks)


@pytest.mark.parametrize("tree", [4, 4096])
def test_near_duplicates_of_odd_rows(spark, odd, tree):
    got = simhash.near_duplicates(odd, tree=tree).collect()
    prints = [plain_fingerprint(r[1]) for r in ROWS]
    want = plain_components(prints, [r[0] for r in ROWS])
    pairs = sorted(zip([r[0] or -1 for r in ROWS], prints, want), key=str)
    assert sorted([(r.doc_id or -1, r.fp % 2**64, r.component_id) for r in got], key=str) == pairs
    assert not simhash.near_duplicates(odd.limit(0)).collect()


@pytest.mark.parametrize("tree", [8, 4096])
def test_near_duplicates_of_documents(small, tree):
    docs = small.unionByName(small.where("doc_id % 9 = 0").withColumn("doc_id", F.col("doc_id") + 10_000)
                             .withColumn("text", F.regexp_replace("text", "the", "The the")))
    rows = docs.collect()
    want = plain_components([plain_fingerprint(r.text) for r in rows], [r.doc_id for r in rows])
    got = {r.doc_id: r.component_id for r in simhash.near_duplicates(docs, tree=tree).collect()}
    assert got == dict(zip([r.doc_id for r in rows], want))
    kept = simhash.keep_one(docs)
    assert kept.columns == docs.columns
    assert sorted(r.doc_id for r in kept.collect()) == sorted(set(want))


def test_one_row_of_each_component_stays(odd):
    kept = simhash.keep_one(odd).collect()
    prints = [plain_fingerprint(r[1]) for r in ROWS]
    assert len(kept) == len(set(plain_components(prints, range(len(ROWS)))))
    assert {r.doc_id for r in kept} == {1, 3, 5, 9, None}


def plain_repeats(texts, size):
    raws = [(t or "").encode() for t in texts]
    seen = {}
    for raw in raws:
        for q in range(len(raw) - size + 1):
            seen[raw[q : q + size]] = seen.get(raw[q : q + size], 0) + 1
    out = []
    for raw in raws:
        gone = bytearray(len(raw))
        for q in range(len(raw) - size + 1):
            if seen[raw[q : q + size]] > 1:
                gone[q : q + size] = b"\1" * size
        kept = bytes(b for b, g in zip(raw, gone) if not g)
        spans = sum(1 for i, g in enumerate(gone) if g and not (i and gone[i - 1]))
        out.append((len(raw), sum(gone), spans, kept))
    return out


def repeat_texts():
    rng = random.Random(5)
    passages = ["".join(rng.choice("abc dé\n") for _ in range(n)) for n in (40, 120, 199, 200, 230, 900)]
    texts = ["a" * 700, "a" * 150, "xy" * 400, "", None, "b" + "a" * 199]
    for _ in range(40):
        parts = [rng.choice(passages)[rng.randrange(60) :] for _ in range(rng.randrange(4))]
        texts.append("".join(p + "".join(rng.choice("efgh ") for _ in range(rng.randrange(50))) for p in parts))
    return texts


@pytest.mark.parametrize("hot", [3, 10**6])
@pytest.mark.parametrize("threshold", [64, 200])
def test_repeats_are_removed(spark, hot, threshold):
    texts = repeat_texts()
    rows = [(i if i % 7 else None, t, 0, "c") for i, t in enumerate(texts)]
    rows += rows[8:11] + [(3, texts[9], 0, "c")]
    df = spark.createDataFrame(rows, "doc_id long, text string, _repeats int, start string").repartition(5)
    got = suffix.remove_repeats(df, threshold=threshold, hot=hot)
    assert got.columns == ["doc_id", "text", "start", "_repeats"]
    want = plain_repeats([r[1] for r in rows], threshold)
    pairs = [(r[0], r[1], *w) for r, w in zip(rows, want)]
    found = [(r.doc_id, r.text, r._repeats.n_bytes, r._repeats.n_removed, r._repeats.n_spans, bytes(r._repeats.kept)) for r in got.collect()]
    assert sorted(found, key=str) == sorted(pairs, key=str)


def test_repeats_as_text_keep_whole_characters(spark):
    common = "é" + "".join(chr(97 + i % 26) for i in range(300))
    df = spark.createDataFrame([(1, common + "ñ"), (2, common + "ò"), (3, None)], "doc_id long, text string")
    rows = {r.doc_id: r._repeats for r in suffix.remove_repeats(df, as_text=True).collect()}
    assert rows[1].kept == "" and rows[1].n_bytes - rows[1].n_removed == 1  # half of ñ
    assert rows[3].kept == ""
    assert not suffix.remove_repeats(df.limit(0)).collect()
    with pytest.raises(ValueError):
        suffix.remove_repeats(df, threshold=30)


def test_repeats_query_over_documents(spark, small):
    from staysift.llm.queries import QUERIES

    rows = small.collect()
    want = {
        r.doc_id: (*w[:3], hashlib.sha256(w[3]).hexdigest())
        for r, w in zip(rows, plain_repeats([r.text for r in rows], 200))
    }
    got = QUERIES["op6_suffix_radix_dedup"](spark, "/root/testdata/sf0.001").collect()
    assert {r.doc_id: (r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in got} == want
