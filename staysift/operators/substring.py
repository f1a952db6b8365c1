"""An index for substring searches: which blocks of a table, and which of their rows, can hold a term.

A row that contains a term contains all of the term's trigrams. The index is a table of (trigram,
block, rows): the file filter of every block and the posting lists of its rows in one, in ranges of the
trigram, so a term opens the few index files that can have its trigrams. The searched rows lie in folders
by block, so blocks that lack a trigram are not opened. What is found are candidates; the search
itself then tests the texts, so results equal a scan.
"""

from __future__ import annotations

from collections.abc import Iterable, Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from staysift.session import broadcast_if_small, cut_and_measure

GRAM = 3
# Rows in a block.
BLOCK_ROWS = 4096
# Up to this many blocks are named in the scan; more are found by a join.
NAMED_BLOCKS = 2000
BLOCK, ROW = "_block", "_row"


@dataclass(frozen=True)
class SubstringIndex:
    """rows: all columns, the block (a partition column) and the row's number in it; grams: gram, block, rows."""

    rows: DataFrame
    grams: DataFrame

    @property
    def columns(self) -> list[str]:
        return [c for c in self.rows.columns if c not in (BLOCK, ROW)]


def grams_of(text: Column) -> Column:
    """The distinct trigrams of a text in lower case, found in one pass."""
    every = F.regexp_extract_all(F.lower(text), F.lit(f"(?s)(?=(.{{{GRAM}}}))"), F.lit(1))
    return F.array_distinct(every)


def build_substring_index(
    df: DataFrame, path: str, texts: Sequence[Column], order: Sequence[str], block_rows: int = BLOCK_ROWS
) -> SubstringIndex:
    """Write the rows of ``df`` and the trigrams of their ``texts`` below ``path`` and open them.

    ``texts`` are the expressions that searches test (a nested column in the form in which it is
    searched). Rows go to blocks by ranges of ``order``, so that blocks differ: a facet that
    searches ask for, then a key that is unique. Rows whose texts are null are in a block but under no trigram.
    """
    clash = {BLOCK, ROW} & set(df.columns)
    if clash:
        raise ValueError(f"columns {sorted(clash)} are names of the index")
    spark = df.sparkSession
    blocks = max(1, -(-df.count() // block_rows))
    dealt = df.repartitionByRange(blocks, *order).sortWithinPartitions(*order)
    place = F.monotonically_increasing_id()
    placed = dealt.withColumns(
        {BLOCK: F.shiftright(place, 33).cast("int"), ROW: place.bitwiseAND(F.lit((1 << 33) - 1)).cast("int")}
    )
    placed.write.mode("overwrite").partitionBy(BLOCK).parquet(f"{path}/rows")
    kinds = ", ".join([*[f"`{f.name}` {f.dataType.simpleString()}" for f in df.schema], f"{ROW} int, {BLOCK} int"])
    rows = spark.read.schema(kinds).parquet(f"{path}/rows")
    found = F.array_distinct(F.flatten(F.array(*[F.coalesce(grams_of(t), F.array().cast("array<string>")) for t in texts])))
    each = rows.select(BLOCK, ROW, F.explode(found).alias("gram"))
    lists = each.groupBy("gram", BLOCK).agg(F.sort_array(F.collect_list(ROW)).alias("rows"))
    lists = lists.repartitionByRange("gram", BLOCK).sortWithinPartitions("gram", BLOCK)
    lists.write.mode("overwrite").parquet(f"{path}/grams")
    return open_substring_index(spark, path, kinds)


def open_substring_index(spark: SparkSession, path: str, schema: str | None = None) -> SubstringIndex:
    reader = spark.read.schema(schema) if schema else spark.read
    return SubstringIndex(reader.parquet(f"{path}/rows"), spark.read.parquet(f"{path}/grams"))


def term_grams(spark: SparkSession, term: str) -> list[str]:
    """Trigrams of a term, lowered as Spark lowers texts; none for a term of under three characters."""
    lowered = spark.range(1).select(F.lower(F.lit(term))).first()[0]
    return sorted({lowered[i : i + GRAM] for i in range(len(lowered) - GRAM + 1)})


def possible_rows(index: SubstringIndex, term: str) -> DataFrame | None:
    """Block and row of every row that has all trigrams of the term; None if it is too short to tell.

    A block's posting lists meet in one task: at most one list of its rows for each trigram.
    """
    grams = term_grams(index.rows.sparkSession, term)
    if not grams:
        return None
    lists = index.grams.where(F.col("gram").isin(grams)).groupBy(BLOCK)
    lists = lists.agg(F.collect_list("rows").alias("lists")).where(F.size("lists") == len(grams))
    rest = F.slice("lists", 2, len(grams))
    shared = F.aggregate(rest, F.element_at("lists", 1), lambda seen, rows: F.array_intersect(seen, rows))
    return lists.select(BLOCK, F.explode(shared).alias(ROW))


def rows_that_may_contain(index: SubstringIndex, terms: str | Iterable[str]) -> DataFrame:
    """The rows, with their own columns, that can contain one of the terms, in any case.

    Only the blocks that have such a row are opened. All rows come if a term is shorter than three characters.
    """
    parts = [possible_rows(index, t) for t in ([terms] if isinstance(terms, str) else list(terms))]
    if any(p is None for p in parts):
        return index.rows.select(*index.columns)
    wanted = index.rows.sparkSession.createDataFrame([], f"{BLOCK} int, {ROW} int")
    for part in parts:
        wanted = wanted.unionByName(part)
    wanted, seen = cut_and_measure(wanted.distinct())
    blocks = [r[0] for r in wanted.select(BLOCK).distinct().limit(NAMED_BLOCKS + 1).collect()]
    rows = index.rows
    if len(blocks) <= NAMED_BLOCKS:
        rows = rows.where(F.col(BLOCK).isin(blocks))
    small = broadcast_if_small(wanted, rows=seen["rows"])
    return rows.join(small, [BLOCK, ROW], "left_semi").select(*index.columns)
