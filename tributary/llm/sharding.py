"""Sharding by fixed virtual slots.

Records are hashed into a fixed number of virtual slots; a versioned table says which shard
owns each slot. Adding a shard appends a version in which some slots point to the new shard and
all others stay, so rows move only into the new shard. ``rebalance`` appends a version edited by the
bytes that slots were measured to hold. The map is a table in the shared folder, written once per
change and read back. DataFrame operations only.

Defined results: a null or empty text has size 1 (its newline) and text_crc32 0; a null doc_id
hashes as the empty key, and such rows are numbered in ``PARTS`` parts by their texts; repeated rows get places of
their own, ties in any order; texts of any length are only measured; an empty table gives an empty
result; other columns of the input, whatever their names, are not read (the stage returns them; a column
named shard or slot is replaced).
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import fresh, stage, table

VIRTUAL_SLOTS = 4096
#: Parts of a virtual slot that are numbered apart, so one key's rows do not all meet in one task.
PARTS = 16


def virtual_slot(key, slots: int = VIRTUAL_SLOTS, seed: int = 17):
    """Column: the virtual slot of a key, by a seeded hash that depends on nothing else."""
    return F.pmod(F.xxhash64(F.lit(seed), F.coalesce(key.cast("string"), F.lit(""))), F.lit(slots)).cast("int")


def initial_map(spark: SparkSession, shards: int, slots: int = VIRTUAL_SLOTS) -> DataFrame:
    """Version 1 of the map for ``shards`` shards: (version, vslot, shard).

    Built by the same edits that later growth makes, from one shard on, so that the owner of a slot
    depends on the slot and the shard count alone.
    """
    m = spark.range(slots).select(F.lit(1).alias("version"), F.col("id").cast("int").alias("vslot"), F.lit(0).alias("shard"))
    for n in range(1, shards):
        m = _grow(m, n, slots).withColumn("version", F.lit(1))
    return m


def _grow(current: DataFrame, shards: int, slots: int) -> DataFrame:
    """Give the new shard an equal share: each old shard hands over the slots that a fixed hash ranks first."""
    w = Window.partitionBy("shard").orderBy(F.xxhash64(F.lit(shards), "vslot"), "vslot")
    size = Window.partitionBy("shard")
    share = F.floor(F.count("*").over(size) / F.lit(shards + 1) + F.lit(0.5))
    ranked = current.select("version", "vslot", "shard", F.row_number().over(w).alias("r"), share.alias("share"))
    return ranked.select("version", "vslot", F.when(F.col("r") <= F.col("share"), F.lit(shards)).otherwise(F.col("shard")).cast("int").alias("shard"))


def add_shard(slot_map: DataFrame, slots: int = VIRTUAL_SLOTS) -> DataFrame:
    """``slot_map`` with one more version, in which one more shard owns its share of the slots."""
    last = slot_map.agg(F.max("version").alias("v"), (F.max("shard") + 1).alias("n")).first()
    top = slot_map.where(F.col("version") == last["v"])
    shards = top.agg((F.max("shard") + 1).alias("n")).first()["n"]
    return slot_map.unionByName(_grow(top, shards, slots).withColumn("version", F.lit(last["v"] + 1)))


def rebalance(slot_map: DataFrame, slot_bytes: DataFrame, tolerance: float = 1.0) -> DataFrame:
    """``slot_map`` with a version edited by measured bytes: over-full shards hand slots to under-full ones.

    ``slot_bytes`` (vslot, bytes). An over-full shard gives up its smallest slots as long as it stays at
    or above ``tolerance`` times the mean; those slots go, in order of cumulative bytes, to the shards with
    room, in proportion to their room. All windows run over slots, of which there is a fixed number.
    """
    last = slot_map.agg(F.max("version")).first()[0]
    cur = slot_map.where(F.col("version") == last).join(slot_bytes, "vslot", "left").select("vslot", "shard", F.coalesce("bytes", F.lit(0)).alias("bytes"))
    per = cur.groupBy("shard").agg(F.sum("bytes").alias("total"))
    mean = per.agg(F.avg("total").alias("mean"))
    w = Window.partitionBy("shard").orderBy("bytes", "vslot")
    state = cur.join(per, "shard").join(F.broadcast(mean)).withColumn("given", F.sum("bytes").over(w))
    give = (F.col("total") - F.col("given")) >= F.col("mean") * F.lit(tolerance)
    give = give & (F.col("bytes") > 0)
    moved = state.where(give).select("vslot", "bytes", F.sum("bytes").over(Window.orderBy("bytes", "vslot")).alias("at"))
    room = per.join(F.broadcast(mean)).where("total < mean").select("shard", (F.col("mean") - F.col("total")).alias("room"))
    edge = Window.orderBy(F.desc("room"), "shard")
    room = room.select("shard", F.sum("room").over(edge).alias("hi"), (F.sum("room").over(edge) - F.col("room")).alias("lo"))
    target = moved.join(F.broadcast(room), (F.col("at") > F.col("lo")) & (F.col("at") <= F.col("hi"))).select("vslot", F.col("shard").alias("to"))
    new = cur.join(target, "vslot", "left").select(F.lit(last + 1).alias("version"), "vslot", F.coalesce("to", "shard").cast("int").alias("shard"))
    return slot_map.unionByName(new)


def slot_statistics(rows: DataFrame) -> DataFrame:
    """``rows`` (vslot, size) to (vslot, slot_rows, slot_bytes): one row per slot in use."""
    return rows.groupBy("vslot").agg(F.count("*").alias("slot_rows"), F.sum("size").alias("slot_bytes"))


def assign_shards(docs: DataFrame, slot_map: DataFrame, version: int, slots: int = VIRTUAL_SLOTS, keep: tuple[str, ...] = ()) -> DataFrame:
    """Every document with its shard under ``version`` and its place in that shard, counted from 0 without gaps.

    Places are numbered per part of a virtual slot and shifted by the rows in the shard's earlier parts, so no task
    ever sorts a whole shard. Only keys, sizes and checksums are shuffled, never texts (``keep`` names further columns).
    """
    size, crc = (F.coalesce(F.octet_length("text"), F.lit(0)) + 1).cast("long"), F.crc32(F.coalesce(F.col("text"), F.lit("")).cast("binary"))
    rows = docs.select("doc_id", *keep, size.alias("size"), crc.alias("text_crc32"), virtual_slot(F.col("doc_id"), slots).alias("vslot"))
    rows = rows.withColumn("part", F.pmod(F.xxhash64("text_crc32", "size"), F.lit(PARTS)).cast("int"))
    owner = slot_map.where(F.col("version") == version).select("vslot", "shard")
    stats = rows.groupBy("vslot", "part").agg(F.count("*").alias("rows"), F.sum("size").alias("bytes"))
    w = Window.partitionBy("shard").orderBy("vslot", "part")
    place = stats.join(F.broadcast(owner), "vslot").select(
        "vslot", "part", "shard", F.sum("bytes").over(Window.partitionBy("vslot")).alias("slot_bytes"), (F.sum("rows").over(w) - F.col("rows")).alias("before")
    )  # at most slots x PARTS rows
    inner = Window.partitionBy("vslot", "part").orderBy(F.col("doc_id").asc_nulls_last(), "text_crc32", "size")
    numbered = rows.withColumn("r", F.row_number().over(inner))
    return numbered.join(F.broadcast(place), ["vslot", "part"]).withColumn("slot", (F.col("before") + F.col("r") - 1).cast("long")).drop("before", "r", "part")


def op6_virtual_slot_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Law ``key``: version 1 of the stored map decides, and version 2, with one more shard, for ``grown_shard``."""
    docs = table(spark, sf_dir, "documents")
    slot_map = stage(add_shard(stage(initial_map(spark, 8), "slot-map")), "slot-map")
    grown = slot_map.where("version = 2").select("vslot", F.col("shard").alias("grown_shard"))
    out = assign_shards(docs, slot_map, 1)
    return out.join(F.broadcast(grown), "vslot").select(
        "doc_id", "size", "text_crc32", F.lit("key").alias("law"), "shard", "slot", "grown_shard",
        F.col("vslot").alias("virtual_slot"), F.col("slot_bytes").alias("virtual_slot_bytes"),
    )


def sharding_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Last pipeline stage: all columns of the documents with shard and slot, under a map that was rebalanced by measured bytes."""
    sized = docs.select(virtual_slot(F.col("doc_id")).alias("vslot"), (F.coalesce(F.octet_length("text"), F.lit(0)) + 1).cast("long").alias("size"))
    per_slot = slot_statistics(sized).select("vslot", F.col("slot_bytes").alias("bytes"))
    slot_map = stage(rebalance(stage(initial_map(spark, 8), "slot-map"), stage(per_slot, "slot-bytes")), "slot-map")
    (row,) = fresh(docs.select("doc_id", "text"), "row")
    placed = assign_shards(docs.select("doc_id", "text", F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias(row)), slot_map, 2, keep=(row,))
    return placed.select(*[F.col(f"{row}.`{c}`").alias(c) for c in docs.columns if c.lower() not in ("shard", "slot")], "shard", "slot")


QUERIES = {"op6_virtual_slot_sharding": op6_virtual_slot_sharding}
ORACLE: dict[str, str] = {}
