"""The chunker as a SQL table function over a whole table."""

from __future__ import annotations

import hashlib

from pyspark.sql import SparkSession, types as T
from pyspark.sql.functions import udtf
from pyspark.sql.udtf import AnalyzeArgument, AnalyzeResult

from staysift.operators.chunking import OVERLAP, SEPARATORS, SIZE, chunk_spans

MADE = [("chunk_no", T.IntegerType()), ("text", T.StringType()), ("chunk_id", T.StringType())]


class ChunksTable:
    """``(TABLE(t) [PARTITION BY key], text, key[, size, overlap])``: a row per chunk of every row's text.

    All columns of the table but its text are carried, then chunk_no, text and chunk_id. Rows without a text and
    blank chunks give nothing. Rows are independent of each other, so the table needs no partitioning; with
    one by the key, the chunks of a key come from one task. The result's columns follow the table's, which
    takes ``analyze``; functions that get whole Arrow batches cannot have it, so rows travel in Arrow and
    come one by one.
    """

    @staticmethod
    def analyze(
        table: AnalyzeArgument, text: AnalyzeArgument, key: AnalyzeArgument,
        size: AnalyzeArgument | None = None, overlap: AnalyzeArgument | None = None,
    ) -> AnalyzeResult:
        if not table.isTable:
            raise ValueError("the first argument has to be a table")
        fields = {f.name: f for f in table.dataType.fields}
        for name in (text.value, key.value):
            if name not in fields:
                raise ValueError(f"the table has no column {name}")
        carried = [f for n, f in fields.items() if n != text.value]
        clash = {f.name.lower() for f in carried} & {n for n, _ in MADE}
        if clash:
            raise ValueError(f"columns {sorted(clash)} are names of the result")
        width, shared = (SIZE if size is None else size.value), (OVERLAP if overlap is None else overlap.value)
        if not 0 <= shared < width:
            raise ValueError(f"the overlap has to be from 0 to below the size, got {shared} and {width}")
        return AnalyzeResult(T.StructType([*carried, *[T.StructField(n, k) for n, k in MADE]]))

    def eval(self, row, text, key, size=None, overlap=None):
        body = row[text]
        if not body:
            return
        spans = chunk_spans(body, 0, len(body), size or SIZE, OVERLAP if overlap is None else overlap, SEPARATORS)
        carried = [v for n, v in row.asDict(recursive=False).items() if n != text]
        shown, number = row[key], 0
        for piece in (body[a:b].strip() for a, b in spans):
            if piece:
                joined = str(number) if shown is None else f"{shown}:{number}"
                yield *carried, number, piece, hashlib.sha256(joined.encode()).hexdigest()
                number += 1


def register_chunks_table(spark: SparkSession, name: str = "chunks_table") -> None:
    """Register the function in the session under ``name``."""
    spark.udtf.register(name, udtf(ChunksTable, useArrow=True))
