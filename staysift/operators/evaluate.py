"""Retrieval quality against a table of expected pairs, and passage containment."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window, functions as F

from staysift.functions.text import tokens
from staysift.operators.keyword import KeywordIndex
from staysift.session import BROADCAST_BYTES, broadcast_if_small, cut_and_measure, cut_lineage


def retrieval_recall(hits: DataFrame, truth: DataFrame, qid: str, key: str) -> DataFrame:
    """Per query: expected pairs, those found, recall, reciprocal rank of the first found."""
    expected = truth.select(qid, key).distinct()
    ranked = hits.select(qid, key, "rank")
    judged = expected.join(ranked, [qid, key], "left")
    return judged.groupBy(qid).agg(
        F.count("*").alias("n_expected"),
        F.count("rank").alias("n_found"),
        (F.count("rank") / F.count("*")).alias("recall"),
        F.coalesce(1 / F.min("rank"), F.lit(0.0)).alias("reciprocal_rank"),
    )


def retrieval_summary(per_query: DataFrame) -> DataFrame:
    """Means over the queries: recall and mean reciprocal rank."""
    return per_query.agg(
        F.count("*").alias("n_queries"),
        F.avg("recall").alias("mean_recall"),
        F.avg("reciprocal_rank").alias("mrr"),
    )


# Short passages that are compared with a text at once.
SHORT_BLOCK = 500


def _containing_short(
    docs: DataFrame, key: str, text: str, short: DataFrame, n: int, qid: str, passage: str
) -> DataFrame:
    """The same for ``n`` short passages, without an index: one scan of the texts, each compared
    with blocks of passages."""
    blocks = -(-n // SHORT_BLOCK)
    packed = short.groupBy(F.pmod(F.xxhash64(qid), F.lit(blocks)).alias("_block")).agg(
        F.collect_list(F.struct(F.col(qid).alias("q"), F.col(passage).alias("p"))).alias("_passages")
    )
    every = docs.select(key, text).withColumn("_block", F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))))
    joined = every.join(broadcast_if_small(packed, rows=n), "_block")
    hits = F.filter("_passages", lambda x: F.contains(F.col(text), x["p"]))
    return joined.select(F.explode(hits).alias("_hit"), key).select(F.col("_hit.q").alias(qid), key)


def containing_documents(
    index: KeywordIndex, docs: DataFrame, text: str, passages: DataFrame, qid: str, passage: str
) -> DataFrame:
    """Pairs ``qid, key`` where the document's text contains the passage. Exact.

    A word inside a passage, not at its ends, occurs as a whole word in every text that contains
    the passage. Documents that have the rarest such word are looked up in the index and only
    those are compared. Passages of fewer than three words have no inner word; they are compared
    with all documents, in blocks. Null passages are in none.
    """
    key = index.key
    words = passages.where(F.col(passage).isNotNull()).select(qid, passage, tokens(passage).alias("_w"))
    short, seen = cut_and_measure(words.where(F.size("_w") < 3).select(qid, passage))
    words = words.where(F.size("_w") >= 3)
    inner = words.select(
        qid, F.explode(F.array_distinct(F.slice("_w", 2, F.size("_w") - 2))).alias("term")
    )
    known = index.terms.select("term", "df").join(broadcast_if_small(inner), "term")
    rarest = Window.partitionBy(qid).orderBy("df", "term")
    # A passage with a word that no document has is contained in none.
    complete = inner.join(known, [qid, "term"], "left").groupBy(qid).agg(
        F.count_if(F.col("df").isNull()).alias("_missing")
    )
    probe = cut_lineage(
        known.withColumn("_r", F.row_number().over(rarest))
        .where("_r = 1")
        .join(complete.where("_missing = 0"), qid, "left_semi")
        .select(qid, "term")
    )
    candidates = cut_lineage(
        index.postings.select(key, "term").join(broadcast_if_small(probe), "term").drop("term")
    )
    texts = passages.select(qid, F.col(passage).alias("_passage"))
    n_bytes = texts.agg(F.sum(F.octet_length("_passage"))).first()[0] or 0
    if n_bytes <= BROADCAST_BYTES:
        texts = F.broadcast(texts)
    compared = (
        docs.select(key, text)
        .join(broadcast_if_small(candidates), key)
        .join(texts, qid)
    )
    found = compared.where(F.contains(F.col(text), F.col("_passage"))).select(qid, key)
    if not seen["rows"]:
        return found
    return found.union(_containing_short(docs, key, text, short, seen["rows"], qid, passage))
