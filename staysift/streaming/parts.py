"""A retrieval index kept as immutable parts: small syncs add a part, old ones are never rewritten.

Every batch of changes becomes one part with the chunks of its keys, their postings, term counts and vectors. What a
key had before is marked dead by (chunk, batch), with the counts that it takes off the statistics.
Parts of like size are merged into one, without their dead rows; the parts that went into it stay until
``drop_unused``. A manifest, written last, names the parts that count, so a lost job changes nothing and readers see
one state. Searches read all parts, without the dead chunks, under exact statistics of the live ones.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from staysift.operators.hybrid import HybridIndex
from staysift.operators.keyword import COMPACT, KeywordIndex, in_runs, make_postings, ranged_postings, term_counts
from staysift.operators.ranking import latest_per_key
from staysift.session import TEXTS, broadcast_if_small, cut_lineage, delete_folder
from staysift.sources.changes import BEFORE, CHANGE, DELETE

BATCH, VERSION = "batch", "_version"
# Parts of one tier that are merged; a tier's parts have up to FAN times the chunks of the tier below.
FAN = 4
# Chunks of the lowest tier's parts.
TIER = 50_000
TABLES = ("docs", "chunks", "postings", "terms", "vectors")
MARKS = ("dead", "dead_terms")
_MANIFEST = "kind string, name string, batches array<long>, chunks long, last long"


@dataclass(frozen=True)
class PartIndex:
    """A folder of parts: the key of its source rows, and how texts become chunks and vectors."""

    spark: SparkSession
    path: str
    key: str
    text: str
    chunker: Callable[[DataFrame, str, str], DataFrame]
    embed: Callable[[DataFrame], DataFrame]
    fan: int = FAN
    tier: int = TIER

    # The manifest: one small table a state, the last one counts.

    def _states(self) -> DataFrame:
        return self.spark.read.schema(f"{_MANIFEST}, state long").parquet(f"{self.path}/manifest")

    def state(self) -> list:
        """Rows (kind, name, batches, chunks, last) of the newest manifest; none for a new index."""
        try:
            numbers = self._states()
            newest = numbers.select(F.max("state")).first()[0]
        except Exception as error:
            if "PATH_NOT_FOUND" in str(error):
                return []
            raise
        if newest is None:
            return []
        return numbers.where(F.col("state") == newest).collect()

    def _commit(self, rows: list[tuple]) -> None:
        entries = self.spark.createDataFrame(rows, _MANIFEST).coalesce(1)
        number = 1 + max([r["state"] for r in self.state()], default=0)
        entries.write.mode("overwrite").parquet(f"{self.path}/manifest/state={number}")

    def parts(self) -> list:
        return [r for r in self.state() if r["kind"] == "part"]

    def last_batch(self) -> int:
        return max([r["last"] for r in self.state()], default=-1)

    def _read(self, table: str, names: list[str] | None = None) -> DataFrame | None:
        kind = "dead" if table in MARKS else "part"
        if names is None:
            names = [r["name"] for r in self.state() if r["kind"] == kind]
        if not names:
            return None
        frames = [self.spark.read.parquet(f"{self.path}/{kind}s/{n}/{table}") for n in names]
        return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), frames)

    def _live(self, table: str, names: list[str] | None = None) -> DataFrame:
        rows, dead = self._read(table, names), self._read("dead")
        if rows is None:
            raise ValueError(f"there is no index in {self.path}")
        if dead is None:
            return rows
        gone = dead.select(F.col("chunk_id").alias("_gone"), F.col(BATCH).alias("_batch"))
        is_gone = (F.col("chunk_id") == F.col("_gone")) & (F.col(BATCH) == F.col("_batch"))
        return rows.join(broadcast_if_small(gone), is_gone, "left_anti")

    def chunks(self) -> DataFrame:
        """All live chunks with the columns they were given."""
        return self._live("chunks").drop(BATCH)

    # Adding a batch.

    def add(self, changes: DataFrame, number: int, version: Column, deleted: Column | None = None) -> None:
        """Take one batch of rows: the newest version of a key replaces the older ones, in whatever batch it came.

        Rows where ``deleted`` is true take their key out. Of equal versions the later batch counts, and
        in one batch the greatest text. A batch that was taken before (a replay) is left out.
        """
        flag = F.lit(False) if deleted is None else F.coalesce(deleted, F.lit(False))
        self._add(changes.withColumns({"_deleted": flag, VERSION: version}), number)

    def _add(self, marked: DataFrame, number: int) -> None:
        if number <= self.last_batch():
            return
        newest = cut_lineage(latest_per_key(marked, self.key, [F.desc_nulls_last(VERSION), F.desc(self.text)]), **TEXTS)
        before = self._read("docs")
        if before is not None:
            keys = broadcast_if_small(newest.select(self.key))
            known = latest_per_key(
                before.join(keys, self.key, "left_semi"), self.key, [F.desc_nulls_last(VERSION), F.desc(BATCH)]
            )
            known = cut_lineage(known.select(self.key, F.col(VERSION).alias("_known"), F.col(BATCH).alias("_of")))
            both = newest.join(known, self.key, "left")
            newer = F.col("_known").isNull() | (F.col(VERSION) >= F.col("_known"))
            newest = cut_lineage(both.where(newer), **TEXTS)
            self._mark(newest.where("_of IS NOT NULL").select(self.key, "_of"), number)
            newest = newest.drop("_known", "_of")
        rows = newest.where(~F.col("_deleted")).drop("_deleted", VERSION)
        docs = newest.select(self.key, VERSION, "_deleted")
        self._write(f"b{number}", number, docs, self.chunker(rows, self.key, self.text))
        self._merge()

    def add_feed(self, feed: DataFrame, number: int) -> None:
        """Take a change feed (``sources.changes.changed_rows``): after images in, keys without one out."""
        gone = F.col(CHANGE).isin(DELETE, BEFORE)
        version = F.struct(F.lit(number).alias("number"), (~gone).alias("here"))
        self._add(feed.withColumns({"_deleted": gone, VERSION: version}).drop(CHANGE), number)

    def _mark(self, keys: DataFrame, number: int) -> None:
        """Write which chunks a batch makes dead, and the counts that they take off."""
        old = keys.select(F.col(self.key).alias("_key"), F.col("_of"))
        was = (F.col(self.key) == F.col("_key")) & (F.col(BATCH) == F.col("_of"))
        dead = cut_lineage(self._live("chunks").join(broadcast_if_small(old), was, "left_semi"), **TEXTS)
        folder = f"{self.path}/deads/b{number}"
        dead.select("chunk_id", BATCH).write.mode("overwrite").parquet(f"{folder}/dead")
        words = make_postings(dead, "chunk_id", "text", BATCH).groupBy(BATCH, "term")
        counts = words.agg(F.count("*").alias("df"), F.sum("tf").alias("total_tf"))
        counts.write.mode("overwrite").parquet(f"{folder}/dead_terms")

    def _write(self, name: str, number: int, docs: DataFrame, chunks: DataFrame) -> None:
        folder = f"{self.path}/parts/{name}"
        docs.withColumn(BATCH, F.lit(number).cast("long")).write.mode("overwrite").parquet(f"{folder}/docs")
        numbered = chunks.withColumn(BATCH, F.lit(number).cast("long"))
        numbered.write.mode("overwrite").options(**TEXTS).parquet(f"{folder}/chunks")
        written = self.spark.read.parquet(f"{folder}/chunks")
        if written.groupBy("chunk_id").count().where("count > 1").limit(1).count():  # their counts are added up
            postings = ranged_postings(cut_lineage(make_postings(written, "chunk_id", "text", BATCH)), "chunk_id", BATCH)
        else:
            postings = make_postings(written, "chunk_id", "text", BATCH, by_term=True)
        self._write_postings(folder, postings)
        vectors = self.embed(written).select("chunk_id", BATCH, "embedding").where("embedding IS NOT NULL")
        vectors.write.mode("overwrite").parquet(f"{folder}/vectors")
        entries = [tuple(r)[:4] + (number,) for r in self.state()]
        entries.append(("part", name, [number], written.count(), number))
        if self._exists(f"{self.path}/deads/b{number}/dead_terms"):
            entries.append(("dead", name, [number], 0, number))
        self._commit(entries)

    def _exists(self, path: str) -> bool:
        try:
            self.spark.read.parquet(path)
            return True
        except Exception as error:
            if "PATH_NOT_FOUND" in str(error):
                return False
            raise

    def _write_postings(self, folder: str, postings: DataFrame) -> None:
        """Write postings in runs sorted by term: a search reads the pages of its words in each run, a write shuffles nothing."""
        postings.write.mode("overwrite").options(**COMPACT).parquet(f"{folder}/postings")
        counts = term_counts(self.spark.read.parquet(f"{folder}/postings"))
        counts.write.mode("overwrite").parquet(f"{folder}/terms")

    # Merging.

    def _tier(self, chunks: int) -> int:
        tier, most = 0, self.tier
        while chunks > most:
            tier, most = tier + 1, most * self.fan
        return tier

    def _merge(self) -> None:
        """Merge the parts of a tier once there are ``fan`` of them, from the lowest tier up."""
        while True:
            tiers: dict[int, list] = {}
            for part in self.parts():
                tiers.setdefault(self._tier(part["chunks"]), []).append(part)
            full = [t for t, parts in sorted(tiers.items()) if len(parts) >= self.fan]
            if not full:
                return
            self._merge_parts(tiers[full[0]])

    def _merge_parts(self, parts: list) -> None:
        state = self.state()
        last = max(r["last"] for r in state)
        names = [p["name"] for p in parts]
        batches = sorted(b for p in parts for b in p["batches"])
        name = f"m{batches[0]}-{batches[-1]}-{last}"
        folder = f"{self.path}/parts/{name}"
        # A key needs only its newest version, wherever that is, to tell late rows.
        docs = latest_per_key(self._read("docs", names), self.key, [F.desc_nulls_last(VERSION), F.desc(BATCH)])
        docs.write.mode("overwrite").parquet(f"{folder}/docs")
        for table in ("chunks", "vectors"):
            self._live(table, names).write.mode("overwrite").options(**TEXTS).parquet(f"{folder}/{table}")
        self._write_postings(folder, in_runs(self._live("postings", names), "term"))
        entries = [tuple(r)[:5] for r in state if r["kind"] == "part" and r["name"] not in names]
        entries.append(("part", name, batches, self.spark.read.parquet(f"{folder}/chunks").count(), last))
        dead = self._read("dead")
        if dead is not None:  # what is gone from the merged part need not be marked any more
            marks = f"{self.path}/deads/{name}"
            for table in MARKS:
                self._read(table).where(~F.col(BATCH).isin(batches)).write.mode("overwrite").parquet(f"{marks}/{table}")
            if self.spark.read.parquet(f"{marks}/dead").limit(1).count():
                entries.append(("dead", name, [], 0, last))
        self._commit(entries)

    def drop_unused(self) -> list[str]:
        """Delete the folders that only older states name; searches opened before may still read them."""
        now = {(r["kind"], r["name"]) for r in self.state()}
        old = {(r["kind"], r["name"]) for r in self._states().select("kind", "name").distinct().collect()}
        folders = sorted(f"{self.path}/{kind}s/{name}" for kind, name in old - now)
        for folder in folders:
            delete_folder(self.spark, folder)
        return folders

    # Searching.

    def open(self) -> HybridIndex:
        """All parts as one index for ``operators.hybrid.search`` and ``operators.keyword.bm25_topk``.

        Counts of the parts are added and those of dead chunks taken off, so scores are those of an index of the
        live chunks alone. Largest tf and least length still bound a term's weight when some chunks are dead.
        """
        counts = self._read("terms")
        if counts is None:
            raise ValueError(f"there is no index in {self.path}")
        dead_terms, dead = self._read("dead_terms"), self._read("dead")
        if dead_terms is not None:
            taken = dead_terms.select("term", (-F.col("df")).alias("df"), (-F.col("total_tf")).alias("total_tf"))
            counts = counts.unionByName(taken, allowMissingColumns=True)
        terms = counts.groupBy("term").agg(
            F.sum("df").alias("df"), F.max("max_tf").alias("max_tf"), F.min("min_len").alias("min_len"), F.sum("total_tf").alias("total_tf")
        ).where("df > 0")
        stats = self._live("chunks").agg(F.count("*").alias("n_docs"))
        words = KeywordIndex(self._live("postings").drop(BATCH), terms, stats, "chunk_id")
        return HybridIndex(words, self._live("vectors").drop(BATCH), None, self.chunks())

    def sync(self, rows: DataFrame, version: Column, deleted: Column | None = None) -> None:
        """Take all rows of a streaming frame that were not taken before, a part for each micro-batch, then stop.

        The stream's numbers are the batch numbers; a feed that is added as well has to go on from there.
        """

        def take(batch: DataFrame, number: int) -> None:
            self.add(batch, number, version, deleted)

        query = (
            rows.writeStream.foreachBatch(take)
            .option("checkpointLocation", f"{self.path}/progress")
            .trigger(availableNow=True)
            .start()
        )
        query.awaitTermination()
