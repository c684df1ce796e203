"""Sharding by fixed virtual slots, in DataFrame operations only.

A record's name is hashed into one of 4,096 slots, for good. A small table, the *slot map*, says which shard
holds a slot. It is made from the bytes of the slots, largest first, each to the shard with the fewest bytes so
far, and kept in numbered versions. When sizes drift or shards are added, :func:`rebalanced` edits it: slots stay
where they are unless their shard is too full.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from crowdlake.operators.materialize import materialize

#: Virtual slots; a power of 16, so that a slot is the first hex digits of a record's hash.
SLOTS = 4096
#: A name that more rows share than this, and more than one in 65,536 of all, is dealt over several slots.
COPIES = 1000
#: What :func:`sharded` adds.
ADDED = ["size", "text_crc32", "law", "virtual_slot", "shard", "slot", "grown_shard"]


def _slot(key: Column) -> Column:
    return F.conv(F.substring(key, 1, 3), 16, 10).cast("int")


def slot_sizes(rows: DataFrame) -> DataFrame:
    """Bytes and rows of every slot, empty ones included, from (virtual_slot, size): always ``SLOTS`` rows."""
    seen = rows.groupBy("virtual_slot").agg(F.sum("size").alias("bytes"), F.count(F.lit(1)).alias("rows"))
    zero = F.lit(0).cast("long")
    every = rows.sparkSession.range(SLOTS).select(F.col("id").cast("int").alias("virtual_slot"))
    return every.join(seen, "virtual_slot", "left").select(
        "virtual_slot", F.coalesce("bytes", zero).alias("bytes"), F.coalesce("rows", zero).alias("rows")
    )


def _dealt(items: Column, loads: Column, keep: bool, limit: Column) -> Column:
    """Fold over slots, largest first: ``loads`` per shard, ``placed`` slots and, with ``keep``, the ``left`` ones.

    With ``keep`` a slot goes to its old shard while that stays within ``limit``; else to the emptiest shard.
    """
    empty = F.array()
    start = F.struct(
        loads.alias("loads"),
        empty.cast("array<struct<virtual_slot:int,shard:int>>").alias("placed"),
        empty.cast("array<struct<less:bigint,virtual_slot:int,old:int>>").alias("left"),
    )

    def put(acc: Column, x: Column, shard: Column) -> Column:
        more = F.transform(acc["loads"], lambda v, i: F.when(i == shard, v - x["less"]).otherwise(v))
        here = F.array(F.struct(x["virtual_slot"].alias("virtual_slot"), shard.cast("int").alias("shard")))
        return F.struct(more.alias("loads"), F.concat(acc["placed"], here).alias("placed"), acc["left"].alias("left"))

    def step(acc: Column, x: Column) -> Column:
        if not keep:
            return put(acc, x, F.array_position(acc["loads"], F.array_min(acc["loads"])).cast("int") - 1)
        fits = F.get(acc["loads"], x["old"]) - x["less"] <= limit
        waits = F.struct(acc["loads"].alias("loads"), acc["placed"].alias("placed"), F.concat(acc["left"], F.array(x)).alias("left"))
        return F.when(F.coalesce(fits, F.lit(False)), put(acc, x, x["old"])).otherwise(waits)

    return F.aggregate(items, start, step)


def rebalanced(sizes: DataFrame, shards: int, old: DataFrame | None = None, slack: float = 0.01) -> DataFrame:
    """The slot map (virtual_slot, shard, bytes, version) for ``sizes``, one row per slot.

    Without ``old`` all slots are dealt, largest first, to the emptiest shard; that is version 1. With it, slots
    are taken from shards that hold more than ``1 + slack`` times the mean (or that no longer exist), and only
    those move; the version goes up by one. ``SLOTS`` rows are folded, whatever the size of the data.
    """
    before = old.select("virtual_slot", F.col("shard").alias("old"), "version") if old is not None else None
    d = sizes.join(before, "virtual_slot", "left") if before is not None else sizes.withColumns({"old": F.lit(None).cast("int"), "version": F.lit(0)})
    item = F.struct((-F.col("bytes")).alias("less"), "virtual_slot", F.col("old").cast("int").alias("old"))
    d = d.agg(
        F.array_sort(F.collect_list(item)).alias("items"),
        F.ceil(F.sum("bytes") * F.lit((1.0 + slack) / shards)).alias("limit"),
        (F.coalesce(F.max("version"), F.lit(0)) + 1).cast("int").alias("version"),
    )
    none = F.array_repeat(F.lit(0).cast("long"), shards)
    d = d.withColumn("first", _dealt(F.col("items"), none, True, F.col("limit")))
    d = d.withColumn("second", _dealt(F.col("first.left"), F.col("first.loads"), False, F.col("limit")))
    placed = d.select("version", F.inline(F.concat("first.placed", "second.placed")))
    return placed.join(sizes.select("virtual_slot", "bytes"), "virtual_slot").select("virtual_slot", "shard", "bytes", "version")


def _versions(spark: SparkSession, path: str) -> list[int]:
    jvm = spark.sparkContext._jvm
    root = jvm.org.apache.hadoop.fs.Path(path)
    found = root.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).globStatus(jvm.org.apache.hadoop.fs.Path(f"{path}/v=*/_SUCCESS"))
    return sorted(int(s.getPath().getParent().getName()[2:]) for s in found or [])


def load_map(spark: SparkSession, path: str, version: int | None = None) -> DataFrame | None:
    """The newest complete version below ``path``, or the named one; None if there is none."""
    found = [v for v in _versions(spark, path) if version in (None, v)]
    return spark.read.parquet(f"{path}/v={found[-1]}") if found else None


def store_map(slot_map: DataFrame, path: str) -> DataFrame:
    """Write the map as its version's folder below ``path`` and read it back. Versions are never overwritten."""
    slot_map = materialize(slot_map)
    version = slot_map.first()["version"]
    target = f"{path}/v={version}"
    slot_map.coalesce(1).write.parquet(target)
    return slot_map.sparkSession.read.parquet(target)


def sharded(
    docs: DataFrame,
    shards: int = 16,
    id: str = "doc_id",
    text: str = "text",
    map_path: str | None = None,
    slack: float = 0.01,
    keep_text: bool = True,
) -> DataFrame:
    """``docs`` with size, text_crc32, law (``bytes``), virtual_slot, shard, slot and grown_shard (null).

    Shards have nearly equal bytes: they differ by the size of a small slot, unless a single document is larger than
    that. ``slot`` numbers a shard's rows from 0 without gaps, in order of virtual slot and record hash. A record's virtual slot depends
    on its id alone (on the text's checksum if the id is null), so edits and reruns leave it in place.

    Null texts have no bytes and checksum 0. Rows of one id share a slot, unless they are so many that they would
    outweigh the others: then they are dealt over several by their place in the table. Fully repeated rows are
    interchangeable. Columns named like the added ones are replaced; an empty table gives none.

    With ``map_path`` the newest stored map is edited and stored as the next version; else the map serves this call only.
    Only tables of ``SLOTS`` or at most 65,536 rows are broadcast.
    """
    lower = {c.lower() for c in ADDED}
    docs = docs.drop(*[c for c in docs.columns if c.lower() in lower])
    kept = [c for c in docs.columns if keep_text or c != text]
    crc = F.coalesce(F.crc32(F.col(text)), F.lit(0).cast("long"))
    packed = docs.select(
        F.struct(*[F.col(f"`{c}`") for c in kept]).alias("doc"),
        (F.coalesce(F.octet_length(text), F.lit(0)) + 1).cast("long").alias("size"),
        crc.alias("text_crc32"),
        F.md5(F.coalesce(F.col(id).cast("string"), F.concat(F.lit("text "), crc.cast("string")))).alias("key"),
        F.monotonically_increasing_id().alias("place"),
    )
    # The places are written, so they stay as they are from here on.
    rows = _unclustered(materialize(packed.withColumn("virtual_slot", _slot(F.col("key")))))
    sizes = materialize(slot_sizes(rows))
    old = load_map(docs.sparkSession, map_path) if map_path else None
    slot_map = rebalanced(sizes, shards, old, slack)
    slot_map = store_map(slot_map, map_path) if map_path else materialize(slot_map)

    earlier = Window.partitionBy("shard").orderBy("virtual_slot").rowsBetween(Window.unboundedPreceding, -1)
    starts = slot_map.join(sizes.select("virtual_slot", "rows"), "virtual_slot").select(
        "virtual_slot", "shard", F.coalesce(F.sum("rows").over(earlier), F.lit(0)).alias("start")
    )
    inside = Window.partitionBy("virtual_slot").orderBy("key", "size", "text_crc32", "place")
    numbered = rows.withColumn("nth", F.row_number().over(inside)).join(F.broadcast(starts), "virtual_slot")
    return numbered.select(
        "doc.*", "size", "text_crc32", F.lit("bytes").alias("law"), "virtual_slot", "shard",
        (F.col("start") + F.col("nth") - 1).cast("long").alias("slot"), F.lit(None).cast("int").alias("grown_shard"),
    )


def _unclustered(rows: DataFrame) -> DataFrame:
    """``rows`` with names that very many of them share dealt over all slots.

    Only slots with far more rows than the mean can hold such a name, and only their rows are counted by name.
    """
    counts = materialize(rows.groupBy("virtual_slot").agg(F.count(F.lit(1)).alias("n")))
    total = counts.agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]
    limit = max(COPIES, total // 65536)
    fat = counts.where(F.col("n") > limit + 2 * total // SLOTS).select("virtual_slot")
    if fat.isEmpty():
        return rows
    hot = rows.join(F.broadcast(fat), "virtual_slot", "left_semi").groupBy("key").count().where(F.col("count") > limit).select("key")
    dealt = F.md5(F.concat_ws(":", "key", F.floor(F.col("place") / F.lit(limit)).cast("string")))
    marked = rows.join(F.broadcast(hot.withColumn("hot", F.lit(True))), "key", "left")
    key = F.when(F.col("hot"), dealt).otherwise(F.col("key"))
    return materialize(marked.withColumn("key", key).drop("hot").withColumn("virtual_slot", _slot(F.col("key"))))


def write_shards(rows: DataFrame, path: str, files: int) -> None:
    """Write :func:`sharded` rows in slot order, one folder a shard, about ``files`` files in all."""
    ranged = rows.repartitionByRange(files, "shard", "slot").sortWithinPartitions("shard", "slot")
    ranged.write.mode("overwrite").partitionBy("shard").parquet(path)
