"""Toxicity scores by a factorization machine over hashed terms.

Terms are a text's distinct lower-cased words and their beginnings. All labelled training rows count
the terms (by hash bucket, summed before the shuffle); the buckets that go with the label most
clearly are the machine's inputs. The machine itself, a linear weight and a few factors per input, so
that every pair of inputs has a weight of its own, is fitted on a bounded sample of those rows.
"""

from __future__ import annotations

import re
import zlib
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from staysift.llm.work import free_name, once, texts_of
from staysift.session import broadcast_if_small

BUCKETS = 1 << 18
PREFIXES = (3, 4, 5, 6)
# Inputs of the machine, least chi-square of an input, factors per input.
INPUTS, CLEAR, FACTORS = 4096, 10.8, 4
# Labelled rows (expected number) on which the machine is fitted.
SAMPLE = 20_000
REJECT = 0.3
_WORD = re.compile(r"\w+")
# Tokens that a worker remembers, with all their buckets, and with the inputs among them.
_KNOWN, _KNOWN_INPUTS = 60_000, 250_000


@dataclass
class Machine:
    """``buckets`` (ascending), the bias, a weight and FACTORS factors per bucket."""

    buckets: np.ndarray
    bias: float
    weights: np.ndarray
    factors: np.ndarray


def buckets_of(token: str) -> tuple[int, ...]:
    """Hash buckets of the words in a blank-free token and of their beginnings."""
    found = []
    for word in _WORD.findall(token):
        found.append(zlib.crc32(b"=" + word.encode()) % BUCKETS)
        found += [zlib.crc32(word[:n].encode()) % BUCKETS for n in PREFIXES if len(word) >= n]
    return tuple(found)


def terms(text: str) -> set[int]:
    """Buckets of all terms of a text."""
    known: dict[str, tuple] = once("toxicity terms", dict)
    if len(known) > _KNOWN:
        known.clear()
    found: set[int] = set()
    for token in set(text.lower().split()):
        got = known.get(token)
        if got is None:
            got = buckets_of(token)
            if len(token) <= 64:
                known[token] = got
        found.update(got)
    return found


def held_out(key: str) -> Column:
    """Whether labels of the key are kept from the fit; a null key is not held out."""
    return F.coalesce(F.crc32(F.col(key).cast("string").cast("binary")) % 4 == 2, F.lit(False))


def _term_counts(rows: DataFrame) -> DataFrame:
    """``bucket``, ``toxic``, ``clean``: rows with a term in the bucket; bucket -1 counts all rows."""

    def count(batches):
        counts = np.zeros((2, BUCKETS), np.int64)
        total = np.zeros(2, np.int64)
        for batch in batches:
            for text, toxic in zip(texts_of(batch.column(0)), batch.column(1).to_pylist()):
                total[toxic] += 1
                found = terms(text)
                counts[toxic, np.fromiter(found, np.int64, len(found))] += 1
        some = np.flatnonzero(counts.sum(axis=0))
        if total.sum():
            yield pa.RecordBatch.from_arrays(
                [pa.array(np.append(some, -1)), pa.array(np.append(counts[1, some], total[1])),
                 pa.array(np.append(counts[0, some], total[0]))],
                names=["bucket", "toxic", "clean"],
            )

    found = rows.mapInArrow(count, "bucket long, toxic long, clean long")
    return found.groupBy("bucket").agg(F.sum("toxic").alias("toxic"), F.sum("clean").alias("clean"))


def _inputs(rows: DataFrame, buckets: np.ndarray) -> DataFrame:
    """``order``, ``label`` and ``inputs`` (places in ``buckets``) of labelled rows."""

    def pick(batches):
        for batch in batches:
            found = []
            for text in texts_of(batch.column(0)):
                got = np.array(sorted(terms(text)), np.int64)
                found.append(np.flatnonzero(np.isin(buckets, got)).astype(np.int32))
            yield pa.RecordBatch.from_arrays(
                [batch.column(2), batch.column(1), pa.array(found, pa.list_(pa.int32()))],
                names=["order", "label", "inputs"],
            )

    return rows.mapInArrow(pick, "order long, label int, inputs array<int>")


def fit_machine(
    inputs: list[np.ndarray], labels: np.ndarray, buckets: np.ndarray, factors: int = FACTORS,
    epochs: int = 30, batch: int = 128, rate: float = 0.02, decay: float = 1e-4, seed: int = 7,
) -> Machine:
    """Logistic loss, minimized by Adam over shuffled batches; every input is 0 or 1."""
    rng = np.random.default_rng(seed)
    n, share = len(labels), (labels.sum() + 0.5) / (len(labels) + 1) if len(labels) else 0.5
    theta = np.zeros((len(buckets) + 1, factors + 1))  # last row: bias; first column: weights
    theta[:-1, 1:] = rng.normal(0, 0.05, (len(buckets), factors))
    theta[-1, 0] = np.log(share / (1 - share))
    first, second, step = np.zeros_like(theta), np.zeros_like(theta), 0
    for _ in range(epochs if n and len(buckets) else 0):
        order = rng.permutation(n)
        for i in range(0, n, batch):
            rows = order[i : i + batch]
            flat = np.concatenate([inputs[r] for r in rows])
            row = np.repeat(np.arange(len(rows)), [len(inputs[r]) for r in rows])
            own = theta[flat, 1:]
            sums = np.stack([np.bincount(row, own[:, f], len(rows)) for f in range(factors)], 1)
            squares = np.bincount(row, (own**2).sum(axis=1), len(rows))
            raw = theta[-1, 0] + np.bincount(row, theta[flat, 0], len(rows))
            raw += ((sums**2).sum(axis=1) - squares) / 2
            slope = (1 / (1 + np.exp(-np.clip(raw, -30, 30))) - labels[rows]) / len(rows)
            grad = decay * theta
            grad[-1] = 0
            grad[-1, 0] = slope.sum()
            grad[:-1, 0] += np.bincount(flat, slope[row], len(buckets))
            for f in range(factors):
                grad[:-1, f + 1] += np.bincount(flat, slope[row] * (sums[row, f] - own[:, f]), len(buckets))
            step += 1
            first = 0.9 * first + 0.1 * grad
            second = 0.999 * second + 0.001 * grad**2
            theta -= rate * (first / (1 - 0.9**step)) / (np.sqrt(second / (1 - 0.999**step)) + 1e-8)
    return Machine(buckets, float(theta[-1, 0]), theta[:-1, 0].copy(), theta[:-1, 1:].copy())


def machine_scores(machine: Machine, texts: list[str]) -> list[float]:
    """Between 0 and 1; higher is likelier toxic."""
    # Most tokens have no input of the machine, and the worker remembers that.
    known: dict[str, tuple] = once(f"toxicity {zlib.crc32(machine.buckets.tobytes())}", dict)
    place = {int(b): i for i, b in enumerate(machine.buckets)}
    scores = []
    for text in texts:
        if len(known) > _KNOWN_INPUTS:
            known.clear()
        found: set[int] = set()
        for token in set(text.lower().split()):
            got = known.get(token)
            if got is None:
                got = tuple(place[b] for b in buckets_of(token) if b in place)
                if len(token) <= 64:
                    known[token] = got
            if got:
                found.update(got)
        hit = np.array(sorted(found), np.int64)
        own = machine.factors[hit]
        pairs = ((own.sum(axis=0) ** 2).sum() - (own**2).sum()) / 2
        raw = machine.bias + machine.weights[hit].sum() + pairs
        scores.append(float(1 / (1 + np.exp(-np.clip(raw, -700, 700)))))
    return scores


def train(
    df: DataFrame, labels: DataFrame, key: str = "doc_id", text: str = "text", label: str = "toxic",
    sample: int = SAMPLE,
) -> Machine:
    """Fit on rows of ``df`` with a label of 0 or 1 whose key is not held out.

    Rows with a null key or label do not count; of repeated labels of a key the greater one does.
    Term counts are over all labelled rows, the fit takes about ``sample`` of them, picked by a hash
    of the key. Without labelled rows every score is one half.
    """
    marked = (
        labels.where(F.col(key).isNotNull() & F.col(label).isin(0, 1))
        .groupBy(F.col(key).alias("_key"))
        .agg(F.max(F.col(label).cast("int")).alias("_label"))
        .where(~held_out("_key"))
    )
    docs = df.select(F.col(key).alias("_doc"), F.col(text).alias("_text"))
    rows = docs.join(broadcast_if_small(marked), F.col("_doc") == F.col("_key")).select(
        "_text", "_label", F.xxhash64("_key").alias("_order")
    )
    counts = _term_counts(rows.select("_text", "_label"))
    table = counts.toPandas()  # at most BUCKETS + 1 rows
    total = table[table.bucket == -1]
    if not len(total):
        return Machine(np.zeros(0, np.int64), 0.0, np.zeros(0), np.zeros((0, FACTORS)))
    toxic, clean = int(total.toxic.iloc[0]), int(total.clean.iloc[0])
    table = table[table.bucket >= 0]
    with np.errstate(divide="ignore", invalid="ignore"):
        a, b = table.toxic.to_numpy() / max(1, toxic), table.clean.to_numpy() / max(1, clean)
        share = (table.toxic + table.clean).to_numpy() / (toxic + clean)
        chi = (a - b) ** 2 / (share * (1 - share) * (1 / max(1, toxic) + 1 / max(1, clean)))
    clear = (a > b) & (np.nan_to_num(chi) > CLEAR) & (table.toxic.to_numpy() >= 3)
    best = np.argsort(-np.where(clear, np.nan_to_num(chi), -1), kind="stable")[: min(INPUTS, int(clear.sum()))]
    buckets = np.sort(table.bucket.to_numpy()[best])
    limit = int(2**62 * min(1.0, sample / (toxic + clean)))
    picked = rows.where(F.pmod(F.col("_order"), F.lit(2**62)) < limit)
    got = _inputs(picked.select("_text", "_label", "_order"), buckets).toPandas()
    got = got.assign(size=got.inputs.map(len)).sort_values(["order", "label", "size"])
    inputs = [np.asarray(x, np.int64) for x in got.inputs]
    return fit_machine(inputs, got.label.to_numpy(np.float64), buckets)


def score(df: DataFrame, machine: Machine, text: str = "text", name: str = "score") -> DataFrame:
    """All rows and columns of ``df`` and ``name``, the score of the whole text (null: empty).

    A column of that name is replaced; repeated rows get equal scores.
    """
    base = df.drop(name)

    def rows(batches):
        for batch in batches:
            scores = machine_scores(machine, texts_of(batch.column(text)))
            yield batch.append_column(name, pa.array(scores, pa.float64()))

    schema = ", ".join(f"`{n}` {k}" for n, k in base.dtypes)
    return base.mapInArrow(rows, f"{schema}, `{name}` double")


def drop_toxic(df: DataFrame, machine: Machine, text: str = "text", reject: float = REJECT) -> DataFrame:
    """The rows of ``df`` that score under ``reject``, with all their columns, whatever their names."""
    name = free_name(df, "_toxicity")
    return score(df, machine, text, name).where(F.col(name) < reject).drop(name)
