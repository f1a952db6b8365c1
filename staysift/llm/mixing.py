"""Mixing sources to target weights, with DataFrame functions only.

The words of a source, document after document in a pseudorandom order, are packed into blocks of a
fixed length. Output shards of a fixed number of slots draw how many slots each source gets (a
multinomial draw, slot by slot); a source that drew more than its quota passes its last slots on to
those that drew less, so totals are met. The j-th slot of a source takes the block that the source's
index permutation gives for j, and a second round of the permutation starts when all blocks are used.
Blocks and documents then meet in a join by source and block index.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from staysift.session import broadcast_if_small, cut_and_measure, cut_lineage

WORD = r"[^\x20\x09-\x0D]+"
WEIGHTS = (5, 2, 1)
SHARE = 1.5
# A source's words are used this often at most.
MOST = 2
# Words of a block (fewer in a source with under LEAST such blocks), and slots of an output shard.
BLOCK, LEAST, SLOTS = 256, 256, 8192
# Rows of a chunk in which places are summed up, copies of a row handled together, grid of the draw.
CHUNK, COPIES, GRID = 50_000, 1000, 4096
# Fixed primes: multipliers of the index permutations.
PRIMES = (1048583, 1048589, 1048601, 1048609, 1048613, 1048627, 1048633, 1048661, 1048681, 1048703)


def digest(text: Column) -> Column:
    """48 bits of md5, a hash that any SQL engine has."""
    return F.conv(F.substring(F.md5(text), 1, 12), 16, 10).cast("long")


def documents_of(df: DataFrame, key: str, text: str, source: str) -> DataFrame:
    """Sizes in words of equal rows, counted: ``source``, ``key``, ``hash``, ``size``, ``n``."""
    return (
        df.select(
            F.col(source).alias("source"),
            F.col(key).alias("key"),
            F.md5(F.coalesce(F.col(text), F.lit(""))).alias("hash"),
            F.size(F.regexp_extract_all(F.coalesce(F.col(text), F.lit("")), F.lit(WORD), F.lit(0))).cast("long").alias("size"),
        )
        .groupBy("source", "key", "hash", "size")
        .agg(F.count(F.lit(1)).alias("n"))
    )


def source_targets(
    units: DataFrame, weights=WEIGHTS, share: float = SHARE, block: int = BLOCK
) -> DataFrame:
    """One row per source: ``sid`` (its rank by code point, null last), sizes, target, blocks, quota.

    Targets share ``share`` of all sizes by weight; one that would pass MOST times its source's
    size stops there, and the rest is shared by weight among the others. Sources in the order of
    the size at which they stop, taken one after the other, give this directly: a source stops if
    the level left by those before it is at least its own. (One row per source, in one task.)
    """
    per = units.groupBy("source").agg(F.sum(F.col("size") * F.col("n")).alias("source_size"))
    rank = F.row_number().over(Window.orderBy(F.col("source").isNull(), F.col("source")))
    cycle = F.element_at(F.array(*map(F.lit, weights)), ((rank - 1) % len(weights) + 1).cast("int"))
    every = Window.partitionBy()
    level = Window.orderBy(F.col("cap") / F.col("weight"), "sid")
    rows = per.select("source", "source_size", rank.alias("sid"), cycle.cast("double").alias("weight"))
    rows = rows.withColumns(
        {"cap": F.lit(float(MOST)) * F.col("source_size"), "total": F.lit(share) * F.sum("source_size").over(every)}
    ).withColumns(
        {
            "before": F.coalesce(F.sum("cap").over(level.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0.0)),
            "left": F.sum("weight").over(level.rowsBetween(0, Window.unboundedFollowing)),
        }
    )
    rows = rows.withColumn("level", (F.col("total") - F.col("before")) / F.col("left")).withColumn(
        "stops", F.col("level") >= F.col("cap") / F.col("weight")
    )
    last = F.max(F.when(~F.col("stops"), F.col("level"))).over(every)
    rows = rows.withColumn("target", F.when(F.col("stops"), F.col("cap")).otherwise(last * F.col("weight")))
    length = F.greatest(F.lit(1), F.least(F.lit(block), F.floor(F.col("source_size") / LEAST)))
    rows = rows.withColumn("block", length.cast("long"))
    rows = rows.withColumn("blocks", F.ceil(F.col("source_size") / F.col("block")).cast("long"))
    near = F.least(F.floor(F.col("target") / F.col("block") + 0.5), MOST * F.col("blocks"))
    rows = rows.withColumn("quota", F.when(F.col("stops"), MOST * F.col("blocks")).otherwise(near).cast("long"))
    # The first prime of the list, read from the source's rank on, that does not divide the blocks.
    primes = F.array(*map(F.lit, PRIMES))
    turned = F.concat(
        F.slice(primes, (F.col("sid") % len(PRIMES) + 1).cast("int"), F.lit(len(PRIMES))), primes
    )
    step = F.try_element_at(F.filter(turned, lambda p: F.col("blocks") % p != 0), F.lit(1))
    return rows.select(
        "sid", "source", "source_size", "target", "block", "blocks", "quota", F.coalesce(step, F.lit(1)).cast("long").alias("step")
    )


def spread_to(sources: DataFrame, width: str, slots: int) -> DataFrame:
    """``sid`` and the interval [``low``, ``high``) of each source, by grid cell of [0, slots)."""
    before = Window.orderBy("sid").rowsBetween(Window.unboundedPreceding, 0)
    cell = max(1, -(-slots // GRID))
    rows = sources.where(F.col(width) > 0).select("sid", F.col(width).alias("_w"), F.sum(width).over(before).alias("high"))
    rows = rows.withColumn("low", F.col("high") - F.col("_w")).drop("_w")
    cells = F.sequence(F.floor(F.col("low") / cell), F.floor((F.col("high") - 1) / cell))
    return rows.withColumn("cell", F.explode(cells))


def drawn_slots(spark, sources: DataFrame, slots: int, per_shard: int = SLOTS) -> DataFrame:
    """``shard``, ``slot``, ``sid``, ``j``: the j-th slot of each source, for all output slots."""
    if not slots:
        return spark.createDataFrame([], "shard long, slot long, sid int, j long")
    cell = max(1, -(-slots // GRID))
    grid = spread_to(sources, "quota", slots)
    drawn = spark.range(slots).select(
        F.col("id").alias("slot"),
        F.floor(F.col("id") / per_shard).alias("shard"),
        (digest(F.col("id").cast("string")) % slots).alias("draw"),
    ).withColumn("cell", F.floor(F.col("draw") / cell))
    picked = drawn.join(broadcast_if_small(grid), "cell").where("draw >= low AND draw < high")
    picked = cut_lineage(picked.select("shard", "slot", "sid"))
    # How many slots each shard drew of each source, and the number of the first of them.
    counts = picked.groupBy("shard", "sid").agg(F.count(F.lit(1)).alias("n"))
    earlier = Window.partitionBy("sid").orderBy("shard").rowsBetween(Window.unboundedPreceding, -1)
    firsts = cut_lineage(counts.withColumn("first", F.coalesce(F.sum("n").over(earlier), F.lit(0))))
    inside = F.row_number().over(Window.partitionBy("shard", "sid").orderBy("slot"))
    numbered = picked.join(firsts.drop("n"), ["shard", "sid"]).withColumn("j", F.col("first") + inside - 1)
    # Settle: slots beyond a source's quota, numbered through, go to the sources that lack some.
    drew = firsts.groupBy("sid").agg(F.sum("n").alias("drew"))
    state = sources.select("sid", "quota").join(drew, "sid", "left").na.fill(0, ["drew"])
    through = Window.orderBy("sid").rowsBetween(Window.unboundedPreceding, -1)
    over, under = (F.greatest(x, F.lit(0)) for x in (F.col("drew") - F.col("quota"), F.col("quota") - F.col("drew")))
    state = cut_lineage(
        state.withColumns({"over": over, "under": under}).withColumns(
            {f"{c}_first": F.coalesce(F.sum(c).over(through), F.lit(0)) for c in ("over", "under")}
        )
    )
    placed = numbered.join(broadcast_if_small(state.select("sid", "quota", "over_first")), "sid")
    stays = placed.where("j < quota").select("shard", "slot", "sid", "j")
    passed = placed.where("j >= quota").select(
        "shard", "slot", (F.col("over_first") + F.col("j") - F.col("quota")).alias("number")
    )
    lacking = state.where("under > 0").select(
        "sid", "drew", F.posexplode(F.sequence(F.col("under_first"), F.col("under_first") + F.col("under") - 1)).alias("i", "number")
    ).select("number", "sid", (F.col("drew") + F.col("i")).alias("j"))
    moved = passed.join(lacking, "number").select("shard", "slot", "sid", "j")
    return stays.unionByName(moved)


def block_of(j: Column) -> Column:
    """Block of a source's j-th slot: round ``j div blocks`` of the permutation, shifted by it."""
    turn = F.floor(j / F.col("blocks"))
    return F.pmod(F.col("step") * (F.pmod(j, F.col("blocks")) + 1) + turn * 7919, F.col("blocks"))


def placed_documents(units: DataFrame, sources: DataFrame, rows: int) -> DataFrame:
    """Every document with the place ``at`` of its first word in its source's stream.

    Chunks of bounded size are summed up first, so no source is put in order in one task.
    """
    chunks = max(1, -(-rows // CHUNK))
    ids = broadcast_if_small(sources.select("sid", F.col("source").alias("_source")))
    lots = F.explode(F.sequence(F.lit(0), F.floor((F.col("n") - 1) / COPIES)))
    parts = units.join(ids, F.col("source").eqNullSafe(F.col("_source"))).withColumn("lot", lots)
    parts = parts.withColumn("n", F.least(F.lit(COPIES), F.col("n") - F.col("lot") * COPIES))
    name = F.concat_ws("|", F.coalesce(F.col("key").cast("string"), F.lit("")), "hash", F.col("lot").cast("string"))
    parts = parts.select(
        "sid", (digest(name) % chunks).alias("chunk"), "key", "hash", "lot", "size", "n",
        (F.col("size") * F.col("n")).alias("words"),
    )
    totals = parts.groupBy("sid", "chunk").agg(F.sum("words").alias("words"))
    earlier = Window.partitionBy("sid").orderBy("chunk").rowsBetween(Window.unboundedPreceding, -1)
    bases = totals.select("sid", "chunk", F.coalesce(F.sum("words").over(earlier), F.lit(0)).alias("base"))
    before = (
        Window.partitionBy("sid", "chunk").orderBy(F.col("key").asc_nulls_first(), "hash", "lot")
        .rowsBetween(Window.unboundedPreceding, -1)
    )
    summed = parts.withColumn("before", F.coalesce(F.sum("words").over(before), F.lit(0)))
    copies = F.explode(F.sequence(F.lit(0), F.col("n").cast("int") - 1))
    return (
        summed.join(bases, ["sid", "chunk"])
        .withColumn("copy", copies)
        .select(
            "sid", "key", "hash", "lot", "copy", "size",
            (F.col("base") + F.col("before") + F.col("copy") * F.col("size")).alias("at"),
        )
    )


def _joined(df: DataFrame, key: str, text: str, source: str, weights, share: float, block: int):
    """Sources, and every document's parts by block with the number of times the mix takes them."""
    units, seen = cut_and_measure(documents_of(df, key, text, source), most=F.max("n"))
    sources, totals = cut_and_measure(source_targets(units, weights, share, block), slots=F.sum("quota"))
    slots = drawn_slots(df.sparkSession, sources, totals["slots"] or 0)
    small = broadcast_if_small(sources.select("sid", "blocks", "step"))
    uses = (
        slots.join(small, "sid")
        .select("sid", block_of(F.col("j")).alias("index"))
        .groupBy("sid", "index")
        .agg(F.count(F.lit(1)).alias("uses"))
    )
    docs = placed_documents(units, sources, seen["rows"])
    docs = docs.join(broadcast_if_small(sources.select("sid", "block")), "sid")
    first, last = F.floor(F.col("at") / F.col("block")), F.floor((F.col("at") + F.col("size") - 1) / F.col("block"))
    spans = docs.withColumn(
        "index", F.explode_outer(F.when(F.col("size") > 0, F.sequence(first, last)))
    )
    start = F.greatest(F.col("at"), F.col("index") * F.col("block"))
    stop = F.least(F.col("at") + F.col("size"), (F.col("index") + 1) * F.col("block"))
    parts = spans.select(
        "sid", "key", "hash", "lot", "copy", "size", "index",
        (start - F.col("at")).alias("from"), (stop - start).alias("words"),
    ).join(uses, ["sid", "index"], "left")
    return sources, parts, seen["most"] or 0


def mix(
    df: DataFrame, key: str = "doc_id", text: str = "text", source: str = "source",
    weights=WEIGHTS, share: float = SHARE, block: int = BLOCK,
) -> DataFrame:
    """One row per row of ``df``: ``key``, ``size`` (words), ``source_size``, ``target`` (words of its
    source), ``taken`` (words of it in the mix, repeats counted).

    Null and empty texts have size 0 and are never taken; a null source is a source, the last.
    Null and repeated keys are fine, equal rows lie one after the other in the stream. No word is
    taken more than MOST times. The result depends on the rows alone, not on their
    partitions, so reruns agree. Other columns are not read. An empty table gives no rows.
    """
    sources, parts, _ = _joined(df, key, text, source, weights, share, block)
    taken = parts.groupBy("sid", "key", "hash", "lot", "copy", "size").agg(
        F.coalesce(F.sum(F.col("words") * F.col("uses")), F.lit(0)).alias("taken")
    )
    named = taken.join(broadcast_if_small(sources.select("sid", "source_size", "target")), "sid")
    return named.select(F.col("key").alias(key), "size", "source_size", "target", "taken")


def mixed_documents(
    df: DataFrame, key: str = "doc_id", text: str = "text", source: str = "source",
    weights=WEIGHTS, share: float = SHARE, block: int = BLOCK,
) -> DataFrame:
    """The mix as rows with the columns of ``df``: the text holds the words that are taken.

    A document of which words are taken twice comes out twice, the second time with those words
    alone; one that is not taken does not come out. White space between words is kept, before the
    first and after the last it is not.
    """
    _, parts, most = _joined(df, key, text, source, weights, share, block)
    part = F.struct("from", "words", "uses")
    lists = (
        parts.where("uses > 0")
        .groupBy(F.col("key").alias("_key"), F.col("hash").alias("_hash"), "sid", "lot", "copy")
        .agg(F.sort_array(F.collect_list(part)).alias("_parts"))  # of one document
        .withColumn("_turn", F.explode(F.sequence(F.lit(1), F.array_max("_parts.uses").cast("int"))))
        .select("_key", "_hash", "_parts", "_turn", "sid")
    )
    # A row's other columns travel in one struct, so their names meet no name used here.
    others = [F.col(f"`{c}`") for c in df.columns if c != text]
    rows = df.select(
        F.struct(*others).alias("_row"),
        F.col(text).alias("_text"),
        F.col(key).alias("_row_key"),
        F.md5(F.coalesce(F.col(text), F.lit(""))).alias("_row_hash"),
        F.col(source).alias("_source"),
    )
    if most > 1:  # equal rows: the lists count them
        same = Window.partitionBy("_row_key", "_row_hash", "_source").orderBy("_row_hash")
        rows = rows.withColumn("_copy", F.row_number().over(same)).where("_copy = 1").drop("_copy")
    ids = source_ids(df, source)
    named = lists.join(broadcast_if_small(ids), "sid").withColumnRenamed("_name", "_list_source").drop("sid")
    joined = rows.join(
        named,
        F.col("_row_key").eqNullSafe(F.col("_key"))
        & (F.col("_row_hash") == F.col("_hash"))
        & F.col("_source").eqNullSafe(F.col("_list_source")),
    )
    words = F.regexp_extract_all(F.col("_text"), F.lit(r"[\x20\x09-\x0D]*" + WORD), F.lit(0))
    chosen = F.transform(
        F.filter("_parts", lambda p: p["uses"] >= F.col("_turn")),
        lambda p: F.concat_ws("", F.slice(F.col("_words"), (p["from"] + 1).cast("int"), p["words"].cast("int"))),
    )
    built = F.regexp_replace(F.concat_ws("", chosen), r"^[\x20\x09-\x0D]+", "")
    return joined.withColumn("_words", words).select(
        *[built.alias(c) if c == text else F.col("_row").getField(c).alias(c) for c in df.columns]
    )


def source_ids(df: DataFrame, source: str) -> DataFrame:
    """``sid`` of each source, as ``source_targets`` numbers them."""
    rank = F.row_number().over(Window.orderBy(F.col("_name").isNull(), F.col("_name")))
    return df.select(F.col(source).alias("_name")).distinct().select("_name", rank.alias("sid"))
