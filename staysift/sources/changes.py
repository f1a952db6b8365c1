"""Row changes between two snapshots of a table: keys and counts, or a feed of whole rows."""

from __future__ import annotations

from collections.abc import Iterable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from staysift.session import BROADCAST_ROWS, TEXTS, cut_and_measure, cut_lineage


def snapshot_diff(old: DataFrame, new: DataFrame, key: str) -> DataFrame:
    """Keys whose rows differ between two snapshots: ``key, change_type, n_removed, n_added``.

    Rows are compared as (key, hash of the other columns) with a count on each side, so repeated
    rows and repeated keys are handled and nothing is paired up. Both groupings combine inside
    the tasks first: only key, hash and counts are shuffled, and a hot key is already cut down to
    its distinct rows, which the first shuffle spreads. A column that only one snapshot has is
    null in the other, so a row changes if it holds a value there.
    """
    columns = sorted((set(new.columns) | set(old.columns)) - {key})

    def side(df: DataFrame, n_old: int, n_new: int) -> DataFrame:
        other = dict(old.dtypes) | dict(new.dtypes)
        cells = [F.col(c) if c in df.columns else F.lit(None).cast(other[c]).alias(c) for c in columns]
        digest = F.sha2(F.to_json(F.struct(*cells), {"ignoreNullFields": "false"}), 256)
        return df.select(
            key, digest.alias("_row"), F.lit(n_old).alias("_old"), F.lit(n_new).alias("_new")
        )

    both = side(old, 1, 0).unionAll(side(new, 0, 1))
    per_row = both.groupBy(key, "_row").agg(F.sum("_old").alias("_old"), F.sum("_new").alias("_new"))
    zero = F.lit(0)
    per_key = per_row.groupBy(key).agg(
        F.sum("_old").alias("_old"),
        F.sum("_new").alias("_new"),
        F.sum(F.greatest(F.col("_old") - F.col("_new"), zero)).alias("n_removed"),
        F.sum(F.greatest(F.col("_new") - F.col("_old"), zero)).alias("n_added"),
    )
    change = (
        F.when(F.col("_old") == 0, "insert").when(F.col("_new") == 0, "delete").otherwise("update")
    )
    changed = per_key.where((F.col("n_removed") > 0) | (F.col("n_added") > 0))
    return changed.select(key, change.alias("change_type"), "n_removed", "n_added")


# Hash buckets of a stored snapshot; a bucket is the least that a comparison reads.
BUCKETS = 256
# Hashes of digests (8 bytes each) that are broadcast at most, to drop other rows before a shuffle.
HASHES = 4_000_000
BUCKET, CHANGE = "_bucket", "_change"
INSERT, DELETE, BEFORE, AFTER = "insert", "delete", "update_before", "update_after"


@dataclass(frozen=True)
class Snapshot:
    """A stored table: its rows by hash bucket of the key, and a digest of every bucket beside them."""

    rows: DataFrame
    digests: DataFrame
    key: str

    @property
    def columns(self) -> list[str]:
        return [c for c in self.rows.columns if c != BUCKET]


def _row_text(df: DataFrame, columns: Iterable[str]) -> Column:
    """A row as text; null cells are left out, so a column that is nowhere filled changes nothing."""
    return F.to_json(F.struct(*sorted(columns)))


def write_snapshot(df: DataFrame, path: str, key: str, buckets: int = BUCKETS) -> Snapshot:
    """Store a table in hash buckets of its key, with a digest and a row count for each bucket.

    The digest is a sum over the rows, so their order does not count and repeated rows do. Large
    buckets, as of a key with very many rows, are written by several tasks.
    """
    if {BUCKET, CHANGE} & set(df.columns):
        raise ValueError(f"{BUCKET} and {CHANGE} are names of the snapshot")
    spark = df.sparkSession
    placed = df.withColumn(BUCKET, F.pmod(F.xxhash64(key), F.lit(buckets)).cast("int"))
    placed.hint("rebalance", BUCKET).write.mode("overwrite").options(**TEXTS).partitionBy(BUCKET).parquet(f"{path}/rows")
    rows = _read_rows(spark, path, df)
    digest = F.md5(_row_text(df, df.columns))
    halves = [F.conv(F.substring(digest, at, 15), 16, 10).cast("decimal(38,0)") for at in (1, 16)]
    sums = rows.groupBy(BUCKET).agg(F.count(F.lit(1)).alias("n"), *[F.sum(h).alias(f"digest{i}") for i, h in enumerate(halves)])
    sums.withColumn("buckets", F.lit(buckets)).write.mode("overwrite").parquet(f"{path}/digests")
    df.limit(0).write.mode("overwrite").parquet(f"{path}/schema")
    return open_snapshot(spark, path, key)


def _read_rows(spark: SparkSession, path: str, like: DataFrame) -> DataFrame:
    fields = [*[f"`{f.name}` {f.dataType.simpleString()}" for f in like.schema], f"{BUCKET} int"]
    return spark.read.schema(", ".join(fields)).parquet(f"{path}/rows")


def open_snapshot(spark: SparkSession, path: str, key: str) -> Snapshot:
    like = spark.read.parquet(f"{path}/schema")
    return Snapshot(_read_rows(spark, path, like), spark.read.parquet(f"{path}/digests"), key)


def differing_buckets(old: Snapshot, new: Snapshot) -> list[int]:
    """Buckets whose digests or row counts differ; a bucket is a row here, so they are few thousand at most."""
    counts = [s.digests.agg(F.max("buckets")).first()[0] for s in (old, new)]
    if None not in counts and counts[0] != counts[1]:
        raise ValueError(f"the snapshots have {counts[0]} and {counts[1]} buckets")
    one = old.digests.select(BUCKET, F.struct("n", "digest0", "digest1").alias("old"))
    two = new.digests.select(BUCKET, F.struct("n", "digest0", "digest1").alias("new"))
    both = one.join(two, BUCKET, "full").where(~F.col("old").eqNullSafe(F.col("new")))
    return sorted(r[0] for r in both.select(BUCKET).collect())


def _digest(df: DataFrame, columns: Iterable[str]) -> Column:
    return F.unhex(F.sha2(_row_text(df, columns), 256))


def _among(rows: DataFrame, wanted: DataFrame, n: int) -> DataFrame:
    """``rows`` joined with the ``n`` ``wanted`` rows by ``_digest``; other rows are shuffled only if ``n`` is very large."""
    if n <= BROADCAST_ROWS:
        return rows.join(F.broadcast(wanted), "_digest")
    if n <= HASHES:
        hashes = wanted.select(F.xxhash64("_digest").alias("_hash"))
        rows = rows.join(F.broadcast(hashes), F.xxhash64("_digest") == F.col("_hash"), "left_semi")
    return rows.join(wanted, "_digest")


def changed_rows(old: Snapshot, new: Snapshot) -> DataFrame:
    """The change feed between two snapshots: ``_change`` and whole rows under the union of the columns.

    A row that is gone comes as ``delete``, or as ``update_before`` if its key still has rows; a row that is
    new as ``insert``, or ``update_after`` if its key had rows. Repeated rows come as often as
    their number changed. Only buckets with different digests are read. Rows are compared by digest
    with partial counts, so a key with very many rows is spread over tasks; the cells are read again
    for the rows that changed.
    """
    if old.key != new.key:
        raise ValueError("the snapshots have different keys")
    key, buckets = old.key, differing_buckets(old, new)
    columns = [*new.columns, *[c for c in old.columns if c not in new.columns]]
    kinds = dict(old.rows.dtypes) | dict(new.rows.dtypes)

    def side(snapshot: Snapshot, n_old: int, n_new: int) -> DataFrame:
        rows = snapshot.rows.where(F.col(BUCKET).isin(buckets)).drop(BUCKET)
        cells = [F.col(c) if c in rows.columns else F.lit(None).cast(kinds[c]).alias(c) for c in columns]
        digest = _digest(rows, snapshot.columns).alias("_digest")
        return rows.select(F.struct(*cells).alias("_cells"), digest, F.lit(n_old).alias("_old"), F.lit(n_new).alias("_new"))

    both = side(old, 1, 0).unionAll(side(new, 0, 1)).withColumn("_key", F.col("_cells")[key])
    counted = cut_lineage(both.groupBy("_key", "_digest").agg(F.sum("_old").alias("_old"), F.sum("_new").alias("_new")))
    changed = counted.where("_old <> _new")
    sides = counted.groupBy("_key").agg(F.max(F.col("_old") > 0).alias("_had"), F.max(F.col("_new") > 0).alias("_has"))
    sides = sides.withColumnRenamed("_key", "_of")
    kept = F.col("_had") & F.col("_has")
    kind = F.when(F.col("_old") > F.col("_new"), F.when(kept, BEFORE).otherwise(DELETE)).otherwise(F.when(kept, AFTER).otherwise(INSERT))
    marked, seen = cut_and_measure(
        changed.join(sides, F.col("_key").eqNullSafe(F.col("_of"))).select(
            "_digest", kind.alias(CHANGE), F.abs(F.col("_old") - F.col("_new")).cast("int").alias("_times"),
            (F.col("_old") + F.col("_new") > 1).alias("_repeated"),
        ),
        repeated=F.count_if("_repeated"),
    )
    cells = both.select("_digest", "_cells")
    # A row that is there once on one side only is the one to show; of repeated rows one is taken.
    feed = _among(cells, marked.where("NOT _repeated"), seen["rows"]).select(CHANGE, "_cells")
    if seen["repeated"]:
        some = _among(cells, marked.where("_repeated"), seen["repeated"]).groupBy("_digest", CHANGE, "_times")
        some = some.agg(F.first("_cells").alias("_cells")).select(CHANGE, "_cells", F.explode(F.array_repeat(F.lit(0), F.col("_times"))))
        feed = feed.unionAll(some.select(CHANGE, "_cells"))
    return feed.select(CHANGE, "_cells.*")


def apply_changes(table: DataFrame, feed: DataFrame, key: str) -> DataFrame:
    """The table after a change feed, under the feed's columns.

    Rows are known by the digest of their cells. Those that the feed takes off are counted, and what is left of
    them stays; all others and the feed's new rows pass through.
    """
    columns = [c for c in feed.columns if c != CHANGE]
    kinds = dict(feed.dtypes)
    cells = [F.col(c).cast(kinds[c]) if c in table.columns else F.lit(None).cast(kinds[c]).alias(c) for c in columns]
    gone = F.col(CHANGE).isin(DELETE, BEFORE)
    added = cut_lineage(feed.where(~gone).select(*columns))
    taken = feed.where(gone).select(_digest(feed, columns).alias("_digest")).groupBy("_digest").agg(F.count("*").alias("_taken"))
    taken, seen = cut_and_measure(taken)
    rows = table.select(*cells).unionAll(added)
    rows = rows.select(F.struct(*columns).alias("_cells"), _digest(rows, columns).alias("_digest"))
    if seen["rows"] > HASHES:
        marked = rows.join(taken, "_digest", "left")
        same, hit = marked.where("_taken IS NULL").drop("_taken"), marked.where("_taken IS NOT NULL")
    else:
        hashes = F.broadcast(taken.select(F.xxhash64("_digest").alias("_hash")))
        met = F.xxhash64("_digest") == F.col("_hash")
        same, hit = rows.join(hashes, met, "left_anti"), rows.join(hashes, met, "left_semi")
    # A hash may meet a digest that was not taken; the counts go by the digest itself.
    counts = hit.groupBy("_digest").agg(F.count("*").alias("_n")).join(taken, "_digest", "left")
    left = counts.select("_digest", (F.col("_n") - F.coalesce("_taken", F.lit(0))).cast("int").alias("_n")).where("_n > 0")
    left, some = cut_and_measure(left)
    if some["rows"]:
        stays = _among(hit.select("_digest", "_cells"), left, some["rows"]).groupBy("_digest", "_n").agg(F.first("_cells").alias("_cells"))
        same = same.select("_cells").unionAll(stays.select("_cells", F.explode(F.array_repeat(F.lit(0), F.col("_n")))).select("_cells"))
    return same.select("_cells.*")
