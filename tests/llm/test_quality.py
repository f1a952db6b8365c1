"""Quality rules against plain loops."""

from __future__ import annotations

import re
from collections import Counter

import pytest
from hypothesis import HealthCheck, given, settings, strategies as st
from pyspark.sql import functions as F

from staysift.llm import quality_rules
from staysift.llm.quality_rules import Rule, judge, keep

PLAIN = " ".join(f"the word{i} of text{i % 7}x{i}" for i in range(40)) + "."
MANY = " ".join(f"w{i % 40} w{i % 40} w{i % 41}" for i in range(400))  # over FEW repeated windows


def plain(text):
    text = text or ""
    words = re.findall(r"[^\x20\x09-\x0D]+", text)
    windows = [tuple(words[i : i + 3]) for i in range(len(words) - 2)]
    times = Counter(windows)
    covered = {i + k for i, w in enumerate(windows) if times[w] > 1 for k in range(3)}
    lines = [x for x in text.split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    return {
        "n_words": len(words),
        "word_chars": sum(map(len, words)),
        "n_symbols": sum(c in "#*$%&|<>" for c in text),
        "n_dup_lines": len(lines) - len(set(lines)),
        "n_repeat_words": len(covered),
        "n_lines": len(lines),
        "n_exclamations": text.count("!"),
        "n_stop_words": sum(w in quality_rules.SPELLINGS for w in words),
    }


def compare(spark, texts):
    rows = spark.createDataFrame(list(enumerate(texts)), "id long, text string")
    for r in judge(rows).collect():
        want = plain(r["text"])
        assert {k: r["quality"][k] for k in want} == want, r["text"]
        few = want["n_words"] < 50 or 100 * want["n_repeat_words"] > 50 * want["n_words"]
        assert r["quality"]["base_failed"] == few
        assert r["quality"]["kept"] <= (not few)


def test_counts(spark):
    long = " ".join(f"a{i % 5000} b{i % 3}" for i in range(20_000))
    compare(spark, [None, "", " \n\t\r ", "a", "a b", "a b c", "a a a a", "x y z x y z", "a b c d e",
                    "l\nl\n\nl\r\nl", "**bold** <b> & 5% | $", "é ü 中文 ß!", PLAIN, MANY, long])


@settings(max_examples=15, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(st.lists(st.text(st.sampled_from("ab c\n\td! #é"), max_size=60), min_size=20, max_size=40))
def test_counts_of_random_texts(spark, texts):
    compare(spark, texts)


def test_both_ways_to_find_repeats(spark, monkeypatch):
    texts = [PLAIN, MANY, "a b c a b c a b c " * 5]
    for few in (0, 1000):
        monkeypatch.setattr(quality_rules, "FEW", few)
        compare(spark, texts)


def test_verdicts(spark):
    junk = {
        "length": "short text",
        "symbols": PLAIN.replace(" ", "*** "),
        "capitals": PLAIN.upper(),
        "exclamations": PLAIN.replace(" ", "!! "),
        "stop_words": PLAIN.replace("the ", "xq ").replace("of ", "vb "),
        "repeated_words": "the same words of text again " * 30,
        "repeated_lines": (PLAIN[:200] + "\n") + "the end\n" * 9 + PLAIN[200:],
        "bullet_lines": "\n".join(f"- the item{i} of list{i} x{i}" for i in range(30)),
        "cut_lines": "\n".join(f"the line{i} of text{i} x{i}..." for i in range(30)),
        "word_length": " ".join(["the of"] + [f"{'long' * 9}{i}" for i in range(60)]),
    }
    rows = [(name, text) for name, text in junk.items()] + [("fine", PLAIN)]
    told = judge(spark.createDataFrame(rows, "name string, text string"))
    for r in told.collect():
        assert r["quality"]["kept"] == (r["name"] == "fine")
        if r["name"] != "fine":
            assert r["name"] in r["quality"]["failed"]


def test_clashing_names_repeated_rows_and_empty_tables(spark):
    schema = "quality string, Quality_ int, n_words string, text string, _hash long"
    rows = [("a", 1, "x", PLAIN, 7), ("a", 1, "x", PLAIN, 7), (None, None, None, None, None)]
    docs = spark.createDataFrame(rows, schema)
    told = judge(docs)
    assert told.columns == [*docs.columns, "quality__"]
    assert sorted(r["quality__"]["kept"] for r in told.collect()) == [False, True, True]
    assert [tuple(r) for r in keep(docs).collect()] == rows[:2]
    assert keep(docs.limit(0)).collect() == [] and judge(docs.where("false")).count() == 0


def test_own_rules_and_no_user_function(spark, plan_of):
    docs = spark.createDataFrame([(1, "one two"), (2, PLAIN)], "id long, text string")
    told = judge(docs, rules=[Rule("long", "n_words", None, None, 10)]).orderBy("id")
    assert [r["quality"]["failed"] for r in told.collect()] == [[], ["long"]]
    assert judge(docs, rules=[]).where("quality.kept").count() == 1
    plan = plan_of(judge(spark.range(9).select(F.col("id").cast("string").alias("text"))))
    assert not any(word in plan for word in ("Python", "Pandas", "Arrow", "Exchange"))


@pytest.mark.parametrize("folder", ["/root/testdata/sf0.01"])
def test_labels(spark, folder):
    told = judge(spark.read.parquet(f"{folder}/documents.parquet").select("doc_id", "text"))
    labels = spark.read.parquet(f"{folder}/labels.parquet").withColumnRenamed("quality", "good")
    found = told.join(labels, "doc_id").where("quality.n_words >= 50")
    pairs = found.select("good", "quality.kept").distinct().collect()
    assert {tuple(r) for r in pairs} == {(0, False), (1, True)}
