"""The prefix trie against plain dictionaries, whole and cut into segments, lots and pieces."""

from __future__ import annotations

import hashlib
import random
import zlib

import pytest
from hypothesis import given, settings, strategies as st
from pyspark.sql import functions as F

from staysift.llm import prefix_trie
from staysift.llm.prefix_trie import Path, ZFastTrie, two_fattest
from staysift.llm.queries import op12_prefix_trie


def test_two_fattest():
    for low in range(40):
        for high in range(low + 1, 60):
            power = lambda n: n & -n
            assert two_fattest(low, high) == max(range(low + 1, high + 1), key=power)


def path(symbols, start=0):
    names = [hash(("", start)) & (1 << 60) - 1]
    for s in symbols:
        names.append(hash((names[-1], s)) & (1 << 60) - 1)
    return Path(start, names, [ord(s) - 90 for s in symbols])


@settings(max_examples=200, deadline=None)
@given(st.lists(st.text(st.sampled_from("abc"), min_size=1, max_size=20), max_size=40), st.integers(0, 300))
def test_z_fast_trie(words, start):
    trie, ends = ZFastTrie(), {}
    for k, w in enumerate(words):
        own = path(w, start)
        for seen, node in ends.items():  # the exit of what is in the trie is its end
            assert trie.locate(path(seen, start))[1] == start + len(seen)
        _, depth = trie.locate(own)
        shared = max((sum(1 for _ in iter_shared(w, v)) for v in words[:k]), default=0)
        assert depth == start + shared
        node = trie.insert(own)
        node.count += 1
        node.least = k if node.least is None else min(k, node.least)
        node.rest += 7
        ends[w] = node
    want = {}
    for k, w in enumerate(words):
        for d in range(1, len(w) + 1):
            p = path(w[:d], start)
            below = 7 + sum(ord(s) - 90 for s in w[d - 1 :])
            n, least, rest = want.get((start + d, p.names[-1]), (0, k, 0))
            want[start + d, p.names[-1]] = (n + 1, least, rest + below)
    assert {(d, name): (n, least, below) for d, name, _, n, least, below in trie.expanded()} == want
    compacted = len(trie.edges)
    assert compacted <= 2 * len(set(words)) and len(trie.handles) >= compacted


def iter_shared(a, b):
    for x, y in zip(a, b):
        if x != y:
            return
        yield x


def plain(rows):
    """The contract over (conv, turn, role, text)."""
    own = {}
    for c, t, role, text in sorted(((c, t, r or "", x or "") for c, t, r, x in rows if c is not None),
                                   key=lambda r: (r[0], r[1] is not None, r[1] or 0, r[2], r[3])):
        own.setdefault(c, []).append((role, text))
    seqs = {}
    for c, turns in own.items():
        h = zlib.crc32(str(c).encode()) % 6
        base = c - (abs(c) % 100) * (1 if c >= 0 else -1)
        seqs[c] = tuple(own.get(base, [])[:h] + turns[h:])
    nodes = {}
    for c, s in seqs.items():
        for d in range(len(s) + 1):
            nodes.setdefault(s[:d], []).append(c)
    children = {}
    for s in nodes:
        if s:
            children.setdefault(s[:-1], []).append(s)
    under = {s: [0, 0] for s in nodes}
    for s, members in nodes.items():
        for d in range(len(s) + 1):
            under[s[:d]][0] += s not in children
            under[s[:d]][1] += (len(members) - 1) * (len(s[-1][1]) if s else 0)
    out = []
    for s, members in nodes.items():
        ends = ",".join(str(c) for c in sorted(c for c in members if seqs[c] == s))
        out.append((min(members), len(s), min(nodes[s[:-1]]) if s else None, len(members), len(children.get(s, [])),
                    *under[s], hashlib.sha256(ends.encode()).hexdigest()))
    return sorted(out, key=str)


COLUMNS = ["conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256"]
SCHEMA = "conv_id long, turn long, role string, text string, depth int, a string, _number int, conv string"


def made(seed):
    rng = random.Random(seed)
    rows = []
    for c in [*range(0, 60), 100, 101, 130, 207, -3, -100, -101, 10**12 + 5, 10**12]:
        for t in range(rng.choice([1, 2, 3, 8, 40 if c % 7 == 0 else 5])):
            text = rng.choice(["hello", "hi", "", None, f"own {c}", "ünï 中"])
            rows.append((c, rng.choice([t, t, None]), rng.choice(["user", "user", "assistant", None]), text))
    rows += [(c, t, "user", "the same") for c in range(300, 330) for t in range(9)]  # copies
    rows += [(400, t, "user", f"long {t}") for t in range(150)] + [(401, t, "user", f"long {t}") for t in range(140)]
    rows += [(None, 1, "user", "none"), (None, None, None, None)] + rows[:5] * 2
    return rows


def run(spark, tmp_path, rows):
    df = spark.createDataFrame([(*r, 1, "x", 2, "y") for r in rows], SCHEMA).repartition(3)
    df.write.mode("overwrite").parquet(f"{tmp_path}/conversations.parquet")
    return sorted((tuple(r) for r in op12_prefix_trie(spark, str(tmp_path)).select(*COLUMNS).collect()), key=str)


def test_trie_of_conversations(spark, tmp_path):
    rows = made(1)
    assert run(spark, tmp_path, rows) == plain(rows)


def test_cut_conversations_lots_and_lists(spark, tmp_path, monkeypatch):
    rows = made(2)
    for name, value in (("SEGMENT", 4), ("LOT", 30)):
        monkeypatch.setattr(prefix_trie, name, value)
    positions = prefix_trie.positions
    monkeypatch.setattr(prefix_trie, "positions", lambda *a: positions(*a, long=8))
    digests = prefix_trie.end_digests
    monkeypatch.setattr(prefix_trie, "end_digests", lambda trie: digests(trie, listed=5))
    assert run(spark, tmp_path, rows) == plain(rows)


@pytest.mark.parametrize("rows", [[], [(5, 0, "user", "x " * 300_000), (6, 0, "user", "x " * 300_000)], [(None, 0, "user", "x")]])
def test_empty_and_long(spark, tmp_path, rows):
    assert run(spark, tmp_path, rows) == plain(rows)


def test_general_form(spark):
    turns = spark.createDataFrame([(1, 1, "user", "a"), (2, 1, "user", "a"), (2, 2, None, None)], "conv long, depth long, role string, text string")
    convs = spark.createDataFrame([(1,), (2,), (3,)], "conv long")
    trie = prefix_trie.build_trie(turns, convs)
    got = trie.nodes.orderBy("depth").select("conv", "depth", "parent_conv", "n_convs", "n_children", "n_leaves", "saved").collect()
    assert [tuple(r) for r in got] == [(1, 0, None, 3, 1, 1, 1), (1, 1, 1, 2, 1, 1, 1), (2, 2, 1, 1, 0, 1, 0)]
    ends = {r["conv"]: r["depth"] for r in trie.ends.collect()}
    assert ends == {1: 1, 2: 2, 3: 0}
    assert trie.nodes.select(F.countDistinct("a", "b")).first()[0] == 3
