"""Keyword relevance: an inverted index kept as tables, and exact BM25 top-k over it."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession, Window, functions as F, types as T

from staysift.functions.text import tokens
from staysift.operators.joins import HOT_ROWS
from staysift.operators.ranking import counted_rows, ranks_by_count, top_k_per_group
from staysift.session import BROADCAST_ROWS, broadcast_if_small, cut_and_measure, cut_lineage, spread

# BM25 saturation and length weight.
K1 = 1.2
B = 0.75

# Scores are compared after rounding to this many digits, so that equal texts tie exactly.
DIGITS = 6
# Slack on score bounds: wider than the rounding, so a rounded tie is never pruned.
SLACK = 1e-5
# Postings read per query to find a first bound on its k-th score.
PROBE = 2000
# Up to this many different words are named in the scan of the index.
NAMED_WORDS = 1000
# Up to this many (query, posting) pairs everything is scored in one pass; above, in three steps.
DIRECT_PAIRS = 50_000_000
# About so many (query, posting) pairs go to a task, which holds at most a score for each.
TASK_PAIRS = 4_000_000
# Postings that a task holds at a time to sort them (about 100 MB with long keys).
RUN_ROWS = 1_000_000
# How postings in runs are written: a row group holds each of its keys once, so its dictionary may be larger than
# the usual 1 MB, and the group is small enough for it. Zstandard halves keys that are digests, Snappy does not.
COMPACT = {"compression": "zstd", "parquet.block.size": 16 << 20, "parquet.dictionary.page.size": 8 << 20}


@dataclass(frozen=True)
class KeywordIndex:
    """Three tables; ``terms`` and ``stats`` hold counts only, so scores follow the data.

    postings: key, term, tf, doc_len; terms: term, df, max_tf, min_len, total_tf;
    stats: n_docs.
    """

    postings: DataFrame
    terms: DataFrame
    stats: DataFrame
    key: str


def _runs(batches: Iterator[pa.RecordBatch], by: str) -> Iterator[pa.RecordBatch]:
    """The rows in runs of about RUN_ROWS, each sorted by a column; a task holds one run at a time."""
    held: list[pa.RecordBatch] = []

    def run() -> pa.RecordBatch:
        rows = pa.Table.from_batches(held).combine_chunks()
        held.clear()
        values = rows.column(by).combine_chunks().dictionary_encode()
        place = np.empty(len(values.dictionary) + 1, dtype=np.int64)  # the last one is for nulls
        place[pc.sort_indices(values.dictionary).to_numpy()] = np.arange(len(values.dictionary))
        place[-1] = len(values.dictionary)
        codes = pc.fill_null(values.indices, len(values.dictionary)).to_numpy(zero_copy_only=False)
        order = np.argsort(place[codes], kind="stable")
        return rows.take(pa.array(order)).combine_chunks().to_batches()[0]

    for batch in batches:
        if batch.num_rows:
            held.append(batch)
        if sum(b.num_rows for b in held) >= RUN_ROWS:
            yield run()
    if held:
        yield run()


def in_runs(df: DataFrame, by: str) -> DataFrame:
    """Rows sorted by a column inside runs of about RUN_ROWS: no shuffle, and no spill however large a task is."""
    return df.mapInArrow(lambda batches: _runs(batches, by), df.schema)


def make_postings(
    docs: DataFrame, key: str, text: str, *carried: str, by_term: bool = False, scan: bool = True
) -> DataFrame:
    """``key, term, doc_len, tf``, without a shuffle: the words of a text are counted where it is read.

    ``carried`` columns come along. A key of several rows has the postings of each. With ``by_term`` they come in runs
    sorted by term, else text by text. A scan of fewer splits than cores is spread over all cores; for ``docs`` that
    hold shuffles say ``scan=False``, since counting their partitions would run them.
    """
    docs = docs.select(key, *carried, text)
    words = (spread(docs, key) if scan else docs).select(key, *carried, tokens(text).alias("_words"))
    kinds = words.schema
    fields = [
        kinds[key], T.StructField("term", T.StringType()), T.StructField("doc_len", T.IntegerType()),
        *[kinds[c] for c in carried], T.StructField("tf", T.LongType()),
    ]

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lists = batch.column("_words")
            flat = pc.list_flatten(lists).dictionary_encode()
            different = max(1, len(flat.dictionary))
            cells = pc.list_parent_indices(lists).to_numpy().astype(np.int64) * different + flat.indices.to_numpy()
            cells, tf = np.unique(cells, return_counts=True)
            row = pa.array(cells // different)
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column(key).take(row),
                    flat.dictionary.take(pa.array(cells % different)),
                    pc.list_value_length(lists).take(row),
                    *[batch.column(c).take(row) for c in carried],
                    pa.array(tf.astype(np.int64)),
                ],
                names=[f.name for f in fields],
            )

    return words.mapInArrow((lambda batches: _runs(count(batches), "term")) if by_term else count, T.StructType(fields))


def ranged_postings(postings: DataFrame, key: str, *carried: str) -> DataFrame:
    """Postings in ranges of (term, key), sorted by term; those of equal rows of a key are added up.

    The postings should be stored: a pass over them finds the ranges, and one tells if keys come twice.
    The ranges hold all postings of a term and a key, so adding up takes no further shuffle.
    """
    ranged = postings.repartitionByRange("term", key)
    twice = postings.groupBy(key).agg((F.sum("tf") > F.max("doc_len")).alias("_twice")).where("_twice")
    if twice.limit(1).count():
        ranged = ranged.groupBy(key, "term", "doc_len", *carried).agg(F.sum("tf").alias("tf"))
    return ranged.sortWithinPartitions("term")


def term_counts(postings: DataFrame) -> DataFrame:
    return postings.groupBy("term").agg(
        F.count("*").alias("df"),
        F.max("tf").alias("max_tf"),
        F.min("doc_len").alias("min_len"),
        F.sum("tf").alias("total_tf"),
    )


def write_term_counts(spark: SparkSession, path: str) -> None:
    counts = term_counts(spark.read.parquet(f"{path}/postings"))
    counts.repartitionByRange("term").sortWithinPartitions("term").write.mode("overwrite").parquet(f"{path}/terms")


def build_index(docs: DataFrame, path: str, key: str, text: str) -> KeywordIndex:
    """Write the index tables of ``docs`` (unique ``key``) below ``path`` and open them.

    Files hold ranges of (term, key) and are sorted by term, so a search for few words opens the
    few files that can hold them; a frequent term spans several files.
    """
    docs = docs.where(F.col(text).isNotNull())
    counted = cut_lineage(make_postings(docs, key, text, scan=False))
    ranged_postings(counted, key).write.mode("overwrite").parquet(f"{path}/postings")
    spark = docs.sparkSession
    write_term_counts(spark, path)
    docs.agg(F.count("*").alias("n_docs")).write.mode("overwrite").parquet(f"{path}/stats")
    return open_index(spark, path, key)


def open_index(spark: SparkSession, path: str, key: str) -> KeywordIndex:
    read = spark.read.parquet
    return KeywordIndex(read(f"{path}/postings"), read(f"{path}/terms"), read(f"{path}/stats"), key)


def _weight(tf: Column, doc_len: Column, mean_len: Column) -> Column:
    return tf * (K1 + 1) / (tf + K1 * (1 - B + B * doc_len / mean_len))


def _asked_words(queries: DataFrame, qid: str, text: str) -> tuple[DataFrame, Column]:
    """``qid, term`` of the queries, and a filter on ``term`` that the scan of the index can use.

    A join filter does not reach the files. A short list of words does, and their pages are found
    by the statistics; for more words than NAMED_WORDS the filter is TRUE.
    """
    asked = queries.select(qid, F.explode(F.array_distinct(tokens(text))).alias("term"))
    some = [r["term"] for r in asked.select("term").distinct().limit(NAMED_WORDS + 1).collect()]
    return asked, F.col("term").isin(some) if len(some) <= NAMED_WORDS else F.lit(True)


def query_terms(index: KeywordIndex, asked: DataFrame, qid: str, named: Column) -> DataFrame:
    """``qid, term, df, idf, mean_len, cap`` of the words that occur: cap bounds what the term can add to any score.

    Weights grow with tf and fall with length, so the largest tf and the smallest length of a
    term bound it whatever the mean length is; both survive merging of index parts.
    """
    known = index.terms.where(named).join(broadcast_if_small(asked), "term")
    n_docs = index.stats.select(F.sum("n_docs").cast("double")).scalar()
    n_words = index.terms.select(F.sum("total_tf").cast("double")).scalar()
    return (
        known.withColumn("mean_len", n_words / n_docs)
        .withColumn("idf", F.log(1 + (n_docs - F.col("df") + 0.5) / (F.col("df") + 0.5)))
        .withColumn(
            "cap", F.col("idf") * _weight(F.col("max_tf"), F.col("min_len"), F.col("mean_len"))
        )
        .select(qid, "term", "df", "idf", "mean_len", "cap")
    )


def _part() -> Column:
    return F.col("idf") * _weight(F.col("tf"), F.col("doc_len"), F.col("mean_len"))


def _match(postings: DataFrame, asked: DataFrame, rows: int, key: str) -> DataFrame:
    """Postings of the asked terms, once per query that asks; ``rows`` bounds the asked rows.

    A small query side is broadcast. Otherwise both sides shuffle by term, with the postings of
    frequent terms split by key and the few query rows of such a term repeated for each split.
    """
    if rows <= BROADCAST_ROWS:
        return postings.join(F.broadcast(asked), "term")
    salts = (F.ceil(F.col("df") / HOT_ROWS) + 1).cast("int").alias("_salts")
    hot = broadcast_if_small(asked.where(F.col("df") >= HOT_ROWS).select("term", salts).distinct())
    own = F.coalesce("_salts", F.lit(1))
    split = F.pmod(F.xxhash64(key), own).cast("int")
    left = postings.join(hot, "term", "left").withColumn("_salt", split).drop("_salts")
    right = asked.join(hot, "term", "left")
    right = right.withColumn("_salt", F.explode(F.sequence(F.lit(0), own - 1))).drop("_salts")
    return left.join(right, ["term", "_salt"]).drop("_salt")


def _numbered(asked: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Different terms (at most BROADCAST_ROWS) with a number each, and ``asked`` with the numbers for the terms."""
    numbers = cut_lineage(
        asked.select("term").distinct().withColumn("_no", F.row_number().over(Window.orderBy("term")))
    )
    return F.broadcast(numbers), F.broadcast(asked.join(F.broadcast(numbers), "term").drop("term"))


def _tasks(df: DataFrame, pairs: int) -> int:
    """Tasks for so many (query, posting) pairs: the scores of a task's documents are in memory."""
    return max(int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")), -(-pairs // TASK_PAIRS))


def _narrow(postings: DataFrame, numbers: DataFrame, key: str) -> DataFrame:
    return postings.join(numbers, "term").select(key, "_no", "tf", "doc_len")


def _asked_postings(postings: DataFrame, asked: DataFrame, key: str) -> tuple[DataFrame, DataFrame]:
    """The postings of the asked terms, written once for several passes, with numbers for terms on both sides.

    They are written in runs sorted by document: a key that follows itself takes next to no room there and in the
    shuffles of the passes.
    """
    numbers, asked = _numbered(asked)
    kept = in_runs(_narrow(postings, numbers, key).withColumnRenamed("_no", "term"), key)
    return cut_lineage(kept), asked.withColumnRenamed("_no", "term")


def _scores(postings: DataFrame, asked: DataFrame, rows: int, pairs: int, qid: str, key: str) -> DataFrame:
    """``qid, key, score`` by the ``asked`` words (``rows`` rows, ``pairs`` pairs with postings).

    Postings are dealt by document and meet the queries there: a posting is shuffled once, whatever the
    number of queries that ask for its term, and scores are added up where they are.
    """
    if rows <= BROADCAST_ROWS:
        numbers, asked = _numbered(asked)
        matched = _narrow(postings, numbers, key).repartition(_tasks(postings, pairs), key).join(asked, "_no")
    else:
        matched = _match(postings, asked, rows, key)
    return matched.groupBy(qid, key).agg(F.sum(_part()).alias("score"))


def _kth(scores: DataFrame, qid: str, key: str, k: int) -> DataFrame:
    """``qid, bound``: the k-th best score, a little lowered, of the queries that have k."""
    best = top_k_per_group(scores, qid, [F.desc("score"), F.asc(key)], k)
    return best.where(F.col("rank") == k).select(qid, (F.col("score") - SLACK).alias("bound"))


def bm25_topk(
    index: KeywordIndex,
    queries: DataFrame,
    k: int,
    qid: str,
    text: str,
    allowed: DataFrame | None = None,
    probe: int = PROBE,
    direct_pairs: int = DIRECT_PAIRS,
) -> DataFrame:
    """The ``k`` best documents of every query: ``qid, key, score, rank``. Exact.

    The document frequencies tell in advance how many (query, posting) pairs there are. When
    there are few they are scored in one pass; else in the steps of ``_scores_of_contenders``.
    ``allowed`` (a frame with the key column) restricts the documents before anything is ranked.
    """
    key = index.key
    if qid == key:
        raise ValueError(f"rename the query id: the documents have a column {key} too")
    words, named = _asked_words(queries, qid, text)
    asked, seen = cut_and_measure(query_terms(index, words, qid, named), pairs=F.sum("df"))
    postings = index.postings.where(named)
    if allowed is not None:
        postings = postings.join(broadcast_if_small(allowed.select(key).distinct()), key, "left_semi")
    if (seen["pairs"] or 0) <= direct_pairs:
        scored = _scores(postings, asked, seen["rows"], seen["pairs"] or 0, qid, key)
    else:
        if seen["rows"] <= BROADCAST_ROWS:
            postings, asked = _asked_postings(postings, asked, key)
        scored = _scores_of_contenders(postings, asked, seen["rows"], k, qid, key, probe)
    rounded = scored.withColumn("score", F.round("score", DIGITS))
    return top_k_per_group(rounded, qid, [F.desc("score"), F.asc(key)], k)


def bm25_ranks(
    index: KeywordIndex, queries: DataFrame, wanted: DataFrame, qid: str, text: str, allowed: DataFrame | None = None
) -> DataFrame:
    """The ranks of the ``wanted`` pairs ``qid, key`` in the whole rankings of ``bm25_topk``: ``qid, key, rank``.

    Pairs without a common word have none. Every document is scored once and counted where its score is;
    no ranking is sorted.
    """
    key = index.key

    def scores(queries: DataFrame, only: DataFrame | None) -> DataFrame:
        words, named = _asked_words(queries, qid, text)
        asked, seen = cut_and_measure(query_terms(index, words, qid, named), pairs=F.sum("df"))
        postings = index.postings.where(named)
        if only is not None:
            postings = postings.join(broadcast_if_small(only.select(key).distinct()), key, "left_semi")
        scored = _scores(postings, asked, seen["rows"], seen["pairs"] or 0, qid, key)
        return scored.withColumn("score", F.round("score", DIGITS))

    own = scores(queries.join(wanted.select(qid).distinct(), qid, "left_semi"), wanted).join(wanted, [qid, key])

    def count(some: DataFrame, make) -> DataFrame:
        return counted_rows(scores(queries.join(some, qid, "left_semi"), allowed), qid, key, make)

    return ranks_by_count(own.select(qid, key, "score"), qid, key, count)


def _scores_of_contenders(
    postings: DataFrame, asked: DataFrame, rows: int, k: int, qid: str, key: str, probe: int
) -> DataFrame:
    """Full scores of a set of documents that holds the ``k`` best of every query.

    Scoring every document that shares any word with a query would pair each query with most of
    the collection through its commonest words. Instead: (1) the rarest words of a query give k
    documents whose partial scores bound its k-th score from below; (2) words whose caps together
    stay below that bound cannot bring in a document alone, so candidates come from the other
    words only; (3) candidates that can still reach the k-th score get their remaining words added.
    """
    rare_first = Window.partitionBy(qid).orderBy("df", "term").rowsBetween(Window.unboundedPreceding, -1)
    read_before = F.coalesce(F.sum("df").over(rare_first), F.lit(0))
    seeds = asked.withColumn("_before", read_before).where(F.col("_before") < probe).drop("_before")
    seeds, seeds_seen = cut_and_measure(seeds, pairs=F.sum("df"))
    partial = _scores(postings, seeds, rows, seeds_seen["pairs"] or 0, qid, key)
    bound, seen = cut_and_measure(_kth(partial, qid, key, k))

    low_first = Window.partitionBy(qid).orderBy("cap", "term")
    weak = F.sum(F.when(~F.col("essential"), F.col("cap"))).over(Window.partitionBy(qid))
    asked, asked_seen = cut_and_measure(
        asked.join(broadcast_if_small(bound, rows=seen["rows"]), qid, "left")
        .withColumn("bound", F.coalesce("bound", F.lit(0.0)))
        .withColumn("_reach", F.sum("cap").over(low_first.rowsBetween(Window.unboundedPreceding, 0)))
        .withColumn("essential", F.col("_reach") >= F.col("bound"))
        .withColumn("rest", F.coalesce(weak, F.lit(0.0))),
        others=F.count_if(~F.col("essential")),
        pairs=F.sum(F.when(F.col("essential"), F.col("df"))),
        other_pairs=F.sum(F.when(~F.col("essential"), F.col("df"))),
    )
    found = _scores(postings, asked.where("essential"), rows, asked_seen["pairs"] or 0, qid, key)
    reach = broadcast_if_small(asked.select(qid, "bound", "rest").distinct(), rows=rows)
    found = found.join(reach, qid).where(F.col("score") + F.col("rest") >= F.col("bound"))
    found = cut_lineage(found.select(qid, key, "score"))
    if not asked_seen["others"]:
        return found
    # The k-th best of these scores is a closer bound; few documents can still reach it.
    closer = _kth(found, qid, key, k).withColumnRenamed("bound", "closer")
    limits, limits_seen = cut_and_measure(
        asked.select(qid, "bound", "rest").distinct().join(closer, qid, "left")
    )
    within = F.col("score") + F.col("rest") >= F.greatest("bound", "closer")
    left = found.join(broadcast_if_small(limits, rows=limits_seen["rows"]), qid).where(within)
    left = left.select(qid, key, "score")
    others = asked.where(~F.col("essential")).select(qid, "term", "idf", "mean_len")
    if rows <= BROADCAST_ROWS:
        return _completed(left, postings, others, asked_seen["other_pairs"] or 0, qid, key)
    others = broadcast_if_small(others, rows=asked_seen["others"])
    pending, pending_seen = cut_and_measure(left.select(qid, key).join(others, qid))
    # Only the postings of the remaining words, and of the candidates when those are few.
    words = others.select("term").distinct()
    open_ = postings.join(broadcast_if_small(words, rows=asked_seen["others"]), "term", "left_semi")
    wanted = pending.select(key).distinct()
    small = broadcast_if_small(wanted)
    if small is not wanted:
        open_ = open_.join(small, key, "left_semi")
    pending = broadcast_if_small(pending, rows=pending_seen["rows"])
    added = open_.join(pending, [key, "term"]).select(qid, key, _part().alias("score"))
    return left.unionByName(added).groupBy(qid, key).agg(F.sum("score").alias("score"))


def _completed(left: DataFrame, postings: DataFrame, others: DataFrame, pairs: int, qid: str, key: str) -> DataFrame:
    """Scores of the candidates ``left`` with the ``others`` words added.

    Candidates and the postings of the words are dealt by document in one shuffle; postings of documents
    that are no candidates of a query drop out with their sum.
    """
    numbers, others = _numbered(others)
    left = cut_lineage(left)
    wanted = left.select(key).distinct()
    small = broadcast_if_small(wanted)
    if small is not wanted:
        postings = postings.join(small, key, "left_semi")
    open_ = _narrow(postings, numbers, key)
    dealt = open_.unionByName(left, allowMissingColumns=True).repartition(_tasks(postings, pairs), key)
    pairs_of = dealt.withColumnRenamed(qid, "_candidate").join(others, "_no", "left")
    known = F.col("_no").isNull()
    scores = pairs_of.select(
        F.when(known, F.col("_candidate")).otherwise(F.col(qid)).alias(qid), key,
        F.when(known, F.col("score")).otherwise(_part()).alias("score"), known.alias("_known"),
    ).groupBy(qid, key).agg(F.sum("score").alias("score"), F.max("_known").alias("_known"))
    return scores.where("_known").drop("_known")
