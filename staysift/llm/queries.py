"""The registered queries of this folder: thin forms of the operators over the given tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from staysift.llm import (
    checks,
    html_layout,
    licenses,
    mixing,
    packing,
    prefix_trie,
    projection,
    quality_rules,
    simhash,
    suffix,
    token_store,
    topk,
    toxicity,
    turns,
)
from staysift.session import cut_lineage
from staysift.sources.tables import read_table

QUERIES = {}
CHECKS = {}


def tokenizer_path() -> str:
    """The tokenizer file that the queries use; the operators take any path."""
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


def query(build):
    QUERIES[build.__name__] = build
    return build


@query
def op4_simhash_bk_trees(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents", "doc_id", "text")
    found = simhash.near_duplicates(docs)
    return found.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


@query
def op6_suffix_radix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents", "doc_id", "text")
    return suffix.remove_repeats(docs).select(
        "doc_id", "_repeats.n_bytes", "_repeats.n_removed", "_repeats.n_spans",
        F.sha2("_repeats.kept", 256).alias("kept_sha256"),
    )


@query
def op8_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents", "doc_id", "text")
    pieces = packing.pack(docs, tokenizer_path())
    return pieces.select(
        "doc_id", "piece", "start", "length", F.crc32("ids").alias("ids_crc32"), "sequence_id", "offset"
    )


@query
def op1_token_store(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents", "doc_id", "text")
    store = token_store.write_store(docs, tokenizer_path())
    read = token_store.fetch(store, docs).union(token_store.fetch_unkeyed(store))
    return read.select("doc_id", "start", "n_tokens", F.crc32("ids").alias("ids_crc32"))


@query
def op5_exact_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = read_table(spark, sf_dir, "embeddings", "vec_id", "embedding")
    return topk.exact_topk(vectors, vectors.where("vec_id % 50 = 0"), 5)


@query
def op7_projection_passes(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = read_table(spark, sf_dir, "embeddings", "vec_id", "embedding", "label")
    return projection.near_vectors(vectors)


CHECKS |= {
    "op5_exact_topk": checks.OP5.strip(),
    "op7_projection_passes": checks.OP7.strip(),
    "op10_source_mix": checks.OP10.strip(),
}


@query
def op10_source_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents", "doc_id", "text", "source")
    return mixing.mix(docs)


@query
def op3_toxicity_machine(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents", "doc_id", "text")
    machine = toxicity.train(docs, read_table(spark, sf_dir, "labels", "doc_id", "toxic"))
    return toxicity.score(docs, machine).select(
        "doc_id",
        toxicity.held_out("doc_id").alias("held_out"),
        "score",
        (F.col("score") >= toxicity.REJECT).cast("int").alias("predicted"),
    )


@query
def op2_html_layout(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = read_table(spark, sf_dir, "pages", "page_id", "url", "html")
    return html_layout.extract(pages).select("page_id", "url", "text")


@query
def op9_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licenses.scan_licenses(read_table(spark, sf_dir, "documents", "doc_id", "text"))


@query
def op13_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents", "doc_id", "text")
    counts = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")
    return quality_rules.judge(docs).select("doc_id", *[f"quality.{c}" for c in counts])


CHECKS["op13_quality_rules"] = checks.OP13.strip()


def damaged(df: DataFrame) -> DataFrame:
    """Conversations with faults by a hash of conversation and turn; nulls become one space first."""
    parts = [F.coalesce(F.col(c).cast("string"), F.lit(" ")) for c in ("conv_id", "turn")]
    kind = F.crc32(F.concat_ws(":", *parts)) % 20
    role, text = (F.coalesce(c, F.lit(" ")) for c in ("role", "text"))
    told = df.select(
        "conv_id", "turn",
        F.when(kind == 4, "user").otherwise(role).alias("role"),
        F.when(kind == 1, "").when(kind == 2, F.regexp_replace(text, "[.!?]", "")).otherwise(text).alias("text"),
        F.when(kind == 0, 0).when(kind == 3, 2).otherwise(1).alias("times"),
    )
    copies = F.explode(F.array_repeat(F.lit(1), F.col("times")))
    return told.select("*", copies.alias("one")).drop("times", "one")


@query
def op11_structure_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = read_table(spark, sf_dir, "conversations", "conv_id", "turn", "role", "text")
    found = turns.digests(turns.repair(damaged(rows)))
    every = rows.select("conv_id").distinct()
    told = every.join(found, F.col("conv_id").eqNullSafe(F.col("conv")), "left")
    nothing = F.coalesce("repaired_sha256", F.sha2(F.lit(""), 256)).alias("repaired_sha256")
    return told.select(
        "conv_id",
        *[F.coalesce(c, F.lit(0)).alias(c) for c in (*turns.FAULTS, "cost")],
        F.coalesce("audit", F.lit("")).alias("audit"),
        nothing,
    )


CHECKS["op11_structure_repair"] = checks.OP11.strip()


def rebuilt(df: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Turns (conv, depth, digests, size) and ids of conversations that begin like that of their hundred.

    The first h turns come from conversation c - c % 100, h = crc32(c) % 6, then c's own turns behind
    its first h. Rows without a conversation take no part; turns of equal number go by role and text.
    """
    role, text = (F.coalesce(F.col(c), F.lit("")) for c in ("role", "text"))
    conv = F.col("conv_id").cast("long").alias("conv")
    size = F.length(text).cast("long").alias("size")
    rows = df.where(F.col("conv_id").isNotNull()).select(
        conv, "turn", role.alias("role"), text.alias("text"), *prefix_trie.turn_digest(role, text), size
    )
    order = [F.asc("turn"), F.asc("role"), F.asc("text")]
    ranked = prefix_trie.positions(rows, "conv", order, "place").select("conv", "place", "ta", "tb", "size")
    ranked = cut_lineage(ranked)
    head = (F.crc32(F.col("conv").cast("string").cast("binary")) % 6).alias("head")
    base = (F.col("conv") - F.col("conv") % 100).alias("base")
    convs = ranked.select("conv").distinct()
    first = ranked.where((F.col("place") <= 5) & (F.col("conv") % 100 == 0)).withColumnRenamed("conv", "base")
    lent = convs.select("conv", base, head).join(first, "base").where("place <= head")
    lent = lent.select("conv", F.col("place").alias("depth"), "ta", "tb", "size")
    have = first.groupBy("base").agg(F.max("place").alias("have"))
    own = ranked.select("*", base, head).where("place > head").join(have, "base", "left")
    shift = F.least("head", F.coalesce("have", F.lit(0))) - F.col("head")
    own = own.select("conv", (F.col("place") + shift).alias("depth"), "ta", "tb", "size")
    return lent.unionByName(own), convs


@query
def op12_prefix_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = read_table(spark, sf_dir, "conversations", "conv_id", "turn", "role", "text")
    trie = prefix_trie.build_trie(*rebuilt(rows))
    ends = prefix_trie.end_digests(trie)
    return trie.nodes.join(ends, prefix_trie.NAME, "left").select(
        F.col("conv").alias("conv_id"),
        "depth",
        F.col("parent_conv").alias("parent_conv_id"),
        "n_convs",
        "n_children",
        "n_leaves",
        F.col("saved").alias("saved_tokens"),
        F.coalesce("ends_sha256", F.sha2(F.lit(""), 256)).alias("ends_sha256"),
    )


CHECKS["op12_prefix_trie"] = checks.OP12.strip()
