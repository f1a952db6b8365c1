"""Best-fit packing of tokenized documents into sequences of a fixed length."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame

from staysift.llm.tokens import END_ID, coder, runs
from staysift.llm.work import texts_of

LENGTH = 1024
# Open bins of a task; pieces (and bytes of ids) that wait to be placed longest first.
OPEN, AHEAD, AHEAD_BYTES = 1024, 16_384, 24 << 20


class OpenBins:
    """A bounded number of open bins. A bitset has bit f set if a bin with f free places is open."""

    def __init__(self, length: int, most: int):
        self.length, self.most = length, most
        self.bits, self.count, self.made = 0, 0, 0
        self.free: list[list[int]] = [[] for _ in range(length + 1)]

    def _take(self, free: int) -> int:
        bins = self.free[free]
        taken = bins.pop()
        if not bins:
            self.bits &= ~(1 << free)
        self.count -= 1
        return taken

    def place(self, size: int) -> tuple[int, int]:
        """Bin number and offset for a piece: the open bin with the least room that is enough."""
        fitting = self.bits >> size
        if fitting:
            free = size + (fitting & -fitting).bit_length() - 1
            number = self._take(free)
        else:
            free, number = self.length, self.made
            self.made += 1
        left = free - size
        if left:
            self.free[left].append(number)
            self.bits |= 1 << left
            self.count += 1
            if self.count > self.most:  # the fullest closes first
                self._take((self.bits & -self.bits).bit_length() - 1)
        return number, self.length - free


def cut_points(n: int, length: int) -> list[int]:
    """Starts of the pieces of ``n`` ids: all but the first are full."""
    first = n % length or length
    return [0, *range(first, n, length)]


def pack(
    df: DataFrame, tokenizer: str, key: str = "doc_id", text: str = "text",
    length: int = LENGTH, open_bins: int = OPEN, end_id: int = END_ID,
) -> DataFrame:
    """One row per piece: ``key``, ``piece`` (from 0), ``start`` (ids of the row before it),
    ``length``, ``sequence_id``, ``offset`` and ``ids`` (little-endian unsigned 32-bit).

    A row's ids are those of its whole text and ``end_id``; null and empty texts give the end id
    alone. Rows with more than ``length`` ids are cut into pieces that are full but for the first.
    Each task packs what it reads, without a shuffle: bounded lots of pieces, longest first, into
    at most ``open_bins`` open sequences. Pieces lie in a sequence without gaps. Null keys and
    repeated rows are packed like any other; other columns are not read. An empty table gives
    no rows.
    """
    kind = dict(df.dtypes)[key]

    def rows(batches):
        coding, bins = coder(tokenizer), OpenBins(length, open_bins)
        base = TaskContext.get().partitionId() << 34
        waiting, size = [], 0
        end = np.array([end_id], "<u4").tobytes()

        def placed():
            waiting.sort(key=lambda w: len(w[3]), reverse=True)
            lot = []
            for k, piece, start, ids in waiting:
                number, offset = bins.place(len(ids) // 4)
                lot.append((k, piece, start, len(ids) // 4, base + number, offset, ids))
            kinds = (key_type, pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.int32(), pa.binary())
            names = [key, "piece", "start", "length", "sequence_id", "offset", "ids"]
            for i in range(0, len(lot), 2048):
                columns = [pa.array(c, t) for c, t in zip(zip(*lot[i : i + 2048]), kinds)]
                yield pa.RecordBatch.from_arrays(columns, names=names)

        for batch in batches:
            key_type = batch.schema.field(0).type
            keys, texts = batch.column(0).to_pylist(), texts_of(batch.column(1))
            for a, b in runs(texts):
                for k, ids in zip(keys[a:b], coding.encode(texts[a:b])):
                    ids += end
                    cuts = cut_points(len(ids) // 4, length)
                    for piece, (s, e) in enumerate(zip(cuts, [*cuts[1:], len(ids) // 4])):
                        waiting.append((k, piece, s, ids[4 * s : 4 * e]))
                    size += len(ids)
                    if len(waiting) >= AHEAD or size >= AHEAD_BYTES:
                        yield from placed()
                        waiting, size = [], 0
        if waiting:
            yield from placed()

    schema = (
        f"`{key}` {kind}, piece int, start long, length long, sequence_id long, offset int, ids binary"
    )
    return df.select(key, text).mapInArrow(rows, schema)
