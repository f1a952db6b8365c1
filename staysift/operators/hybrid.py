"""Hybrid retrieval: keyword and vector rankings fused, with an optional id filter."""

from __future__ import annotations

from collections.abc import Iterable
from dataclasses import dataclass

from pyspark.ml import PipelineModel
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from staysift.operators.joins import join_on_unique, keep_ids
from staysift.operators.keyword import KeywordIndex, bm25_ranks, bm25_topk, build_index, open_index
from staysift.operators.ranking import top_k_per_group
from staysift.operators.vectors import fit_text_vectors, text_vectors, vector_ranks, vector_topk
from staysift.session import BROADCAST_ROWS, cut_and_measure, cut_lineage

# The constant of reciprocal rank fusion, and the results per query.
RRF = 60
K = 5
# Least length of the two rankings that are fused.
DEPTH = 50
DIGITS = 6


@dataclass(frozen=True)
class HybridIndex:
    """A keyword index, the vectors of the same chunks, the model that made them, if any, and the
    chunks' texts and attributes."""

    words: KeywordIndex
    vectors: DataFrame
    model: PipelineModel | None
    chunks: DataFrame


def build_hybrid_index(
    chunks: DataFrame,
    path: str,
    key: str,
    text: str,
    vec: str | None = None,
    dims: int = 256,
    attributes: Iterable[str] = (),
) -> HybridIndex:
    """Write the tables a hybrid search needs below ``path``.

    ``attributes`` are columns that searches may filter by or return. ``vec`` names the column with the vectors of a model. Without it the texts get hashed term
    vectors, and the model is kept for the queries.
    """
    build_index(chunks, f"{path}/words", key, text)
    if vec is None:
        model = fit_text_vectors(chunks.where(F.col(text).isNotNull()), text, dims)
        model.write().overwrite().save(f"{path}/model")
        vectors = text_vectors(chunks.select(key, text), text, model).select(key, "embedding")
    else:
        vectors = chunks.where(F.col(vec).isNotNull()).select(key, F.col(vec).alias("embedding"))
    vectors.write.mode("overwrite").parquet(f"{path}/vectors")
    chunks.select(key, text, *attributes).write.mode("overwrite").parquet(f"{path}/chunks")
    return open_hybrid_index(chunks.sparkSession, path, key, hashed=vec is None)


def open_hybrid_index(spark: SparkSession, path: str, key: str, hashed: bool) -> HybridIndex:
    model = PipelineModel.load(f"{path}/model") if hashed else None
    read = spark.read.parquet
    return HybridIndex(
        open_index(spark, f"{path}/words", key), read(f"{path}/vectors"), model, read(f"{path}/chunks")
    )


def search(
    index: HybridIndex,
    queries: DataFrame,
    qid: str,
    text: str,
    vec: str = "embedding",
    where: dict[str, Iterable] | None = None,
    columns: Iterable[str] = (),
    **how,
) -> DataFrame:
    """``hybrid_topk`` over a built index; query vectors are made if the index has the model.

    ``where`` restricts the chunks by the values of attributes before they are ranked;
    ``columns`` of the chunks (text, attributes) come along with the hits.
    """
    key = index.words.key
    if index.model is not None:
        queries = text_vectors(queries, text, index.model, vec)
    if where:
        if how.get("filter_ids") is not None:
            raise ValueError("filter by ids or by attributes, not by both")
        kept = index.chunks
        for name, values in where.items():
            kept = kept.where(F.col(name).isin(list(values)))
        how["filter_ids"] = kept.select(key)
    vectors = index.vectors.withColumnRenamed("embedding", vec)
    hits = hybrid_topk(index.words, vectors, queries, qid, text, vec, **how)
    wanted = list(columns)
    return with_attributes(hits, index.chunks.select(key, *wanted), key, qid) if wanted else hits


def fuse_ranks(rankings: Iterable[DataFrame], k: int, qid: str, key: str) -> DataFrame:
    """Reciprocal rank fusion of rankings ``qid, key, rank``: ``qid, key, score, rank``."""
    parts = [r.select(qid, key, (1 / (RRF + F.col("rank"))).alias("score")) for r in rankings]
    united = parts[0]
    for part in parts[1:]:
        united = united.unionByName(part)
    fused = united.groupBy(qid, key).agg(F.round(F.sum("score"), DIGITS).alias("score"))
    return top_k_per_group(fused, qid, [F.desc("score"), F.asc(key)], k)


def hybrid_topk(
    index: KeywordIndex,
    vectors: DataFrame,
    queries: DataFrame,
    qid: str,
    text: str,
    vec: str = "embedding",
    k: int = K,
    depth: int | None = None,
    filter_ids: DataFrame | Iterable | None = None,
) -> DataFrame:
    """The ``k`` best chunks of every query by keyword and vector rank together.

    ``vectors`` holds the index key and the vector; ``queries`` the query id, its text and vector.
    Chunks without a vector are found by their words, queries without one (null) too.
    ``filter_ids``, a list or a frame, restricts the chunks before either ranking is made, so k
    results remain. The ``depth`` best of each ranking are fused: a chunk further down in one of them
    gets nothing from that one. It is DEPTH, or ``k`` if that is more, unless given; less than ``k``
    is refused.
    """
    key = index.key
    depth = max(DEPTH, k) if depth is None else depth
    if k > depth:
        raise ValueError(f"depth has to be at least k, got {depth} and {k}")
    allowed = None
    if filter_ids is not None:
        allowed = filter_ids
        if not isinstance(allowed, DataFrame):
            kind = index.postings.schema[key].dataType.simpleString()
            allowed = queries.sparkSession.createDataFrame([(i,) for i in set(filter_ids)], f"`{key}` {kind}")
        vectors = keep_ids(vectors, key, allowed)
    by_word = bm25_topk(index, queries, depth, qid, text, allowed)
    by_vector = vector_topk(vectors, queries.where(F.col(vec).isNotNull()), depth, key, qid, vec)
    return fuse_ranks([by_word, by_vector], k, qid, key)


def hybrid_topk_full(
    index: KeywordIndex,
    vectors: DataFrame,
    queries: DataFrame,
    qid: str,
    text: str,
    vec: str = "embedding",
    k: int = K,
    depth: int = DEPTH,
    filter_ids: DataFrame | None = None,
) -> DataFrame:
    """``hybrid_topk`` with the whole rankings fused, so the result does not depend on ``depth``.

    A chunk that is beyond the depth of a ranking has at most 1 / (61 + depth) from it, and one that is
    in neither at most twice that, which from a depth of 2 * (RRF + k) on is less than the k-th score. Where
    the k best still hang on a rank beyond the depth, that rank is counted in a pass over all scores
    (``bm25_ranks``, ``vector_ranks``). Should rounding let unseen chunks tie with the k-th, the queries
    concerned are ranked four times as deep.
    """
    key = index.key
    depth = max(depth, 2 * (RRF + k))
    vectors = keep_ids(vectors, key, filter_ids) if filter_ids is not None else vectors
    none = F.lit(None).cast("int")
    done = None
    while True:
        by_word = bm25_topk(index, queries, depth, qid, text, filter_ids).select(qid, key, F.col("rank").alias("w"))
        by_vector = vector_topk(vectors, queries.where(F.col(vec).isNotNull()), depth, key, qid, vec)
        by_vector = by_vector.select(qid, key, F.col("rank").alias("v"))
        ranks = cut_lineage(
            by_word.withColumn("v", none).unionByName(by_vector.withColumn("w", none))
            .groupBy(qid, key).agg(F.max("w").alias("w"), F.max("v").alias("v"))
        )
        # A ranking that does not reach the depth has come to its end: a missing rank there is none.
        beyond = {c: F.when(F.max(c) >= depth, 1 / (RRF + 1 + F.lit(depth))).otherwise(0.0) for c in "wv"}
        beyond = ranks.groupBy(qid).agg(*[b.alias(f"{c}_beyond") for c, b in beyond.items()])
        open_ = {c: F.when(F.col(c).isNull(), F.col(f"{c}_beyond")).otherwise(0.0) for c in "wv"}
        known = _fused("w", "v")
        scored = ranks.join(beyond, qid).select(
            qid, key, "w", "v", F.round(known, DIGITS).alias("score"),
            F.round(known + open_["w"] + open_["v"], DIGITS).alias("most"),
            F.round(F.col("w_beyond") + F.col("v_beyond"), DIGITS).alias("unseen"),
            *[(o > 0).alias(f"{c}_open") for c, o in open_.items()],
        )
        scored = cut_lineage(scored)
        best = top_k_per_group(scored, qid, [F.desc("score"), F.asc(key)], k)
        kth = best.groupBy(qid).agg(F.when(F.count("rank") >= k, F.min("score")).alias("kth"))
        reaches = [(F.col("kth").isNull() | (F.col(c) >= F.col("kth"))) for c in ("most", "unseen")]
        judged = cut_lineage(
            scored.join(kth, qid).withColumns({"_wins": reaches[0], "_deeper": (F.col("unseen") > 0) & reaches[1]})
        )
        pending = judged.where("_wins AND NOT _deeper")
        for c in "wv":
            wanted = cut_lineage(pending.where(f"{c}_open").select(qid, key))
            if not wanted.limit(1).count():
                continue
            if c == "w":
                found = bm25_ranks(index, queries, wanted, qid, text, filter_ids)
            else:
                found = vector_ranks(vectors, queries, wanted, key, qid, vec)
            pending = pending.join(found.withColumnRenamed("rank", "_found"), [qid, key], "left")
            pending = pending.withColumn(c, F.coalesce(c, "_found")).drop("_found")
        fused = pending.withColumn("score", F.round(_fused("w", "v"), DIGITS)).select(qid, key, "score")
        part = cut_lineage(top_k_per_group(fused, qid, [F.desc("score"), F.asc(key)], k))
        done = part if done is None else done.unionByName(part)
        left = judged.where("_deeper").select(qid).distinct()
        if not left.limit(1).count():
            return done
        queries = cut_lineage(queries.join(left, qid, "left_semi"))
        depth *= 4


def _fused(*ranks: str) -> Column:
    return sum(F.coalesce(1 / (RRF + F.col(c)), F.lit(0.0)) for c in ranks)


def with_attributes(hits: DataFrame, chunks: DataFrame, key: str, qid: str, max_rows: int = BROADCAST_ROWS) -> DataFrame:
    """Hits with the columns of their chunk.

    Few hits are broadcast to the scan of the chunks; otherwise hits of a much returned chunk are
    spread over tasks. The hits are written once, so the search behind them runs once.
    """
    hits, seen = cut_and_measure(hits)
    if seen["rows"] <= max_rows:
        return chunks.join(F.broadcast(hits), key)
    return join_on_unique(hits, chunks, key, spread_by=qid)
