"""Sharding by fixed virtual slots and a versioned slot map.

Records are hashed into a fixed number of slots.  Only slots are ever placed: the
bytes of each slot are summed and a small table says which shard holds a slot.
Rebalancing edits that table into its next version; records are not rehashed.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from panelspark.operators.quality import Rule
from panelspark.sources.published import manifest, publish, read_published

from .common import stage, text_or_empty

#: Virtual slots, whatever the number of shards or records.
SLOTS = 4096


def slot_of(id_col: str, content: Column, slots: int = SLOTS) -> Column:
    """Slot of a record from its id and content, so that null or repeated ids spread."""
    return F.pmod(F.xxhash64(F.col(id_col), content), F.lit(slots)).cast("int")


def first_map(spark: SparkSession, shards: int, slots: int = SLOTS) -> DataFrame:
    """Version 0: slots dealt to shards in turn.  Columns ``version, slot, shard``."""
    return spark.range(slots).select(
        F.lit(0).alias("version"),
        F.col("id").cast("int").alias("slot"),
        (F.col("id") % shards).cast("int").alias("shard"),
    )


def store_map(slot_map: DataFrame, path: str) -> None:
    """Publish ``slot_map`` as the next version at ``path``; earlier ones stay readable.

    A slot without a shard, or a version that is there already, is refused, and the
    stored versions are then as before.
    """
    spark = slot_map.sparkSession
    rows = slot_map.select("version", "slot", "shard")
    if manifest(spark, path) is not None:
        old = read_published(spark, path)
        latest = old.agg(F.max("version").alias("v")).first()["v"]
        late = rows.where(F.col("version") <= latest).take(1)
        if late:
            raise ValueError(f"version {late[0]['version']} is not after {latest}")
        rows = old.unionByName(rows)
    unplaced = F.col("slot").isNull() | F.col("shard").isNull() | (F.col("shard") < 0)
    publish(rows, path, rules=[Rule("placed:slot", unplaced)])


def stored_map(spark: SparkSession, path: str, version: int | None = None) -> DataFrame | None:
    """The given version of the map at ``path``, else the latest; None if there is none."""
    if manifest(spark, path) is None:
        return None
    rows = read_published(spark, path)
    if version is None:
        version = rows.agg(F.max("version").alias("v")).first()["v"]
    return rows.where(F.col("version") == version)


def rebalance(slot_map: DataFrame, loads: DataFrame, shards: int) -> DataFrame:
    """The next version of ``slot_map`` for the given ``loads`` (``slot, bytes``).

    Slots are visited from the heaviest down.  A slot stays where it is while its
    shard keeps within the mean; else it moves to the shard with the least so
    far.  Ties go to the smaller slot and shard.  Slots without records weigh
    nothing.  ``shards`` may differ from before; slots of a shard that no longer
    exists move.  The fold runs over one row per slot, a fixed number.
    """
    weighed = slot_map.join(loads, "slot", "left").select(
        "version", "slot", "shard", F.coalesce("bytes", F.lit(0)).cast("long").alias("bytes")
    )
    row = weighed.agg(
        (F.max("version") + 1).alias("version"),
        F.sort_array(F.collect_list(F.struct((-F.col("bytes")).alias("neg"), "slot", "shard"))).alias("items"),
        (F.sum("bytes") / shards).alias("mean"),
    )
    start = F.struct(
        F.array_repeat(F.lit(0).cast("long"), shards).alias("load"),
        F.array().cast("array<int>").alias("placed"),
    )

    def place(acc: Column, x: Column) -> Column:
        load, size = acc["load"], -x["neg"]
        stays = (x["shard"] < shards) & (F.get(load, x["shard"]) + size <= F.col("mean"))
        least = (F.array_position(load, F.array_min(load)) - 1).cast("int")
        to = F.when(stays, x["shard"]).otherwise(least)
        return F.struct(
            F.transform(load, lambda v, i: F.when(i == to, v + size).otherwise(v)).alias("load"),
            F.concat(acc["placed"], F.array(to)).alias("placed"),
        )

    placed = row.select("version", "items", F.aggregate("items", start, place)["placed"].alias("placed"))
    return placed.select(
        "version", F.explode(F.arrays_zip("items.slot", "placed")).alias("x")
    ).select("version", F.col("x.slot").alias("slot"), F.col("x.placed").alias("shard"))


def assign(
    docs: DataFrame,
    shards: int = 8,
    slots: int = SLOTS,
    id_col: str = "doc_id",
    text_col: str = "text",
    slot_map: DataFrame | None = None,
    store: str | None = None,
) -> DataFrame:
    """One row per row of ``docs`` with its shard; shards hold nearly equal bytes.

    Size: UTF-8 bytes of the text (null: none) plus 1.  The map starts from
    ``slot_map``, else from the latest one at ``store``, else from version 0, and is
    rebalanced to the sizes at hand; its version is returned with each row.  With
    ``store`` the new version is published there, for the next run to edit.  ``slot`` is the row's place in its shard,
    gapless from 0: by virtual slot, then id (null first), then content.  Rows
    equal in id and text share a virtual slot.  Other columns are not read; an
    empty table gives no rows.
    """
    spark = docs.sparkSession
    text = text_or_empty(text_col)
    slim = stage(
        docs.select(
            F.col(id_col).alias("doc_id"),
            (F.octet_length(text) + 1).cast("long").alias("size"),
            F.crc32(text.cast("binary")).cast("long").alias("text_crc32"),
        ).withColumn("virtual_slot", slot_of("doc_id", F.col("text_crc32"), slots)),
        "sharded",
    )
    per_slot = slim.groupBy(F.col("virtual_slot").alias("slot")).agg(
        F.sum("size").alias("bytes"), F.count(F.lit(1)).alias("n")
    )
    per_slot = stage(per_slot, "slot-loads")
    old = slot_map
    if old is None and store is not None:
        old = stored_map(spark, store)
    if old is None:
        old = first_map(spark, shards, slots)
    new = stage(rebalance(old, per_slot.select("slot", "bytes"), shards), "slot-map")
    if store is not None:
        store_map(new, store)
    before = Window.partitionBy("shard").orderBy("vs").rowsBetween(Window.unboundedPreceding, -1)
    placed = new.join(per_slot, "slot").select(
        F.col("slot").alias("vs"), "shard", F.col("version").alias("map_version"), "n"
    ).withColumn("start", F.coalesce(F.sum("n").over(before), F.lit(0)))
    order = Window.partitionBy("virtual_slot").orderBy("doc_id", "text_crc32", "size")
    return (
        slim.withColumn("place", F.row_number().over(order) - 1)
        .join(placed, F.col("virtual_slot") == F.col("vs"))
        .select(
            "doc_id",
            "size",
            "text_crc32",
            F.lit("bytes").alias("law"),
            "shard",
            (F.col("start") + F.col("place")).cast("long").alias("slot"),
            F.lit(None).cast("int").alias("grown_shard"),
            "virtual_slot",
            "map_version",
        )
    )
