"""A corpus through five of the operators: what is toxic or said before goes, the rest is mixed and packed.

Each stage takes (spark, docs, sf_dir), docs with the columns of documents, and gives such a table
again; the last gives the packed pieces. A stage's result is written and read again before the next.

Null and empty texts are documents like others: they are scored as empty texts, are near copies of
each other, hold no repeats, and end in the mix, which takes words. Null keys and repeated rows take
part in every stage. An empty table passes through as one (the machine is then fitted on nothing
and rejects nothing). Further columns keep their values, whatever their names, up to the last stage.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from staysift.llm import mixing, packing, simhash, suffix, toxicity
from staysift.llm.queries import tokenizer_path
from staysift.session import scratch_path
from staysift.sources.tables import read_table


def without_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that score under the limit, by a machine fitted on the labels of ``sf_dir``."""
    machine = toxicity.train(docs, read_table(spark, sf_dir, "labels", "doc_id", "toxic"))
    return toxicity.drop_toxic(docs, machine)


def without_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near-duplicates."""
    return simhash.keep_one(docs)


def without_repeats(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every document, without the bytes that repeat elsewhere; ``n_chars`` follows the text."""
    # The operator keeps some names for itself; here every column comes back.
    names = {c: f"column{i}" for i, c in enumerate(docs.columns) if c not in ("doc_id", "text")}
    kept = suffix.remove_repeats(docs.withColumnsRenamed(names), as_text=True)
    text = F.col("_repeats.kept")
    made = {"text": text, "n_chars": F.length(text).cast("long")}
    return kept.select(*[made.get(c, F.col(names.get(c, c))).alias(c) for c in docs.columns])


def mixed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The words that the mix takes, in documents; one that is taken twice comes twice."""
    rows = mixing.mixed_documents(docs)
    return rows.withColumn("n_chars", F.length("text").cast("long")).select(*docs.columns)


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Training sequences: one row per piece of a document, with its token ids."""
    return packing.pack(docs, tokenizer_path())


STAGES = [
    ("toxicity", without_toxic),
    ("simhash_near_dedup", without_near_copies),
    ("suffix_array_dedup", without_repeats),
    ("source_mix", mixed),
    ("best_fit_packing", packed),
]

# Hashes, tokenizer and fitted machine are beyond SQL: tests/llm compare stages with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``; every stage's result is a Parquet table in the shared folder."""
    docs = read_table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        path = scratch_path(spark, f"pipeline-{name}")
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
    return docs
