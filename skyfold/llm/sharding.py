"""Sharding by fixed virtual slots.

A record hashes into one of ``SLOTS`` slots for good; a table with one row per slot says which shard holds it. Bytes are
added up per slot, so balancing works on that table alone and its size never depends on the records. Each edit of the
map is stored as a new version: ``first`` deals slots to shards, ``rebalanced`` moves the few slots that overfill a shard,
``grown`` moves slots into one more shard and nowhere else. Only DataFrame functions are used; the map is edited as
one row of arrays.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from skyfold.llm.common import shuffle_partitions, without
from skyfold.session import stored

SLOTS = 4096
CHUNK = 1 << 16


def slot_of(doc_id: Column, text: Column, slots: int = SLOTS) -> Column:
    """Slot of a record: from its id, or from its text where it has none."""
    key = F.coalesce(doc_id.cast("string"), text, F.lit(""))
    return (F.conv(F.substring(F.md5(key.cast("binary")), 1, 8), 16, 10).cast("long") % slots).cast("int")


def records(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", slots: int = SLOTS) -> DataFrame:
    """(slot, doc_id, size, crc, copies): records by slot, rows that are equal in all of these as one."""
    key, body = F.col(f"`{doc_id}`"), F.col(f"`{text}`")
    rows = docs.select(slot_of(key, body, slots).alias("slot"), key.alias("doc_id"), (F.coalesce(F.octet_length(body), F.lit(0)) + 1).cast("long").alias("size"),
                       F.crc32(F.coalesce(body, F.lit("")).cast("binary")).alias("crc"))
    return rows.groupBy("slot", "doc_id", "size", "crc").agg(F.count("*").alias("copies"))


def slot_bytes(rows: DataFrame, slots: int = SLOTS) -> DataFrame:
    """(slot, bytes, records) of every slot, empty ones too."""
    used = rows.groupBy("slot").agg(F.sum(F.col("size") * F.col("copies")).alias("bytes"), F.sum("copies").alias("records"))
    every = rows.sparkSession.range(slots).select(F.col("id").cast("int").alias("slot"))
    return every.join(used, "slot", "left").select("slot", *[F.coalesce(c, F.lit(0)).cast("long").alias(c) for c in ("bytes", "records")])


def _edited(weights: DataFrame, shards: int, slack: float, into: int | None = None) -> DataFrame:
    """(slot, shard, bytes) from (slot, bytes, shard or null).

    Slots in falling order of bytes stay in their shard while it holds at most an even share, and ``slack`` of it more;
    the others go one by one to the shard with the least bytes by then (the first of several), or all to ``into``.
    Empty slots stay, or are dealt by number.
    """
    item = F.struct((-F.col("bytes")).alias("order"), "slot", "bytes", "shard")
    row = weights.groupBy().agg(F.sort_array(F.collect_list(item)).alias("slots"), F.sum("bytes").alias("total"))
    none = F.array_repeat(F.lit(0).cast("long"), shards)
    item_type = "array<struct<order:bigint,slot:int,bytes:bigint,shard:int>>"
    start = F.struct(none.alias("loads"), F.array().cast(item_type).alias("placed"), F.array().cast(item_type).alias("moved"))

    def place(state: Column, slot: Column, shard: Column) -> Column:
        """The slot put into its shard (null: the lightest one)."""
        lightest = (F.array_position(state["loads"], F.array_min(state["loads"])) - 1).cast("int")
        chosen = F.coalesce(shard, F.when(slot["bytes"] == 0, F.pmod(slot["slot"], F.lit(shards))), lightest).cast("int")
        loads = F.transform(state["loads"], lambda x, i: x + F.when(i == chosen, slot["bytes"]).otherwise(F.lit(0).cast("long")))
        put = F.struct(slot["order"].alias("order"), slot["slot"].alias("slot"), slot["bytes"].alias("bytes"), chosen.alias("shard"))
        return F.struct(loads.alias("loads"), F.concat(state["placed"], F.array(put)).alias("placed"), state["moved"].alias("moved"))

    most = F.col("total") / shards * (1 + slack)

    def keep_or_move(state: Column, slot: Column) -> Column:
        stays = slot["shard"].isNotNull() & (F.get(state["loads"], slot["shard"]) + slot["bytes"] <= most)
        moved = F.struct(state["loads"].alias("loads"), state["placed"].alias("placed"), F.concat(state["moved"], F.array(slot)).alias("moved"))
        return F.when(stays, place(state, slot, slot["shard"])).otherwise(moved)

    target = F.lit(into).cast("int")
    kept = F.array(F.aggregate("slots", start, keep_or_move))  # one element, so that it is computed once
    done = F.transform(kept, lambda state: F.aggregate(state["moved"], state, lambda s, slot: place(s, slot, target)))
    return row.select(F.explode(done[0]["placed"]).alias("p")).select("p.slot", "p.shard", "p.bytes")


def first(weights: DataFrame, shards: int) -> DataFrame:
    """The first map: all slots dealt, the largest ones before the others."""
    return _edited(weights.select("slot", "bytes", F.lit(None).cast("int").alias("shard")), shards, 0.0)


def rebalanced(slot_map: DataFrame, weights: DataFrame, shards: int, slack: float = 0.01) -> DataFrame:
    """The map after the bytes changed: only slots that overfill their shard move."""
    return _edited(weights.select("slot", "bytes").join(slot_map.select("slot", "shard"), "slot"), shards, slack)


def grown(slot_map: DataFrame, weights: DataFrame, shards: int) -> DataFrame:
    """The map for one shard more than ``shards``: slots move into the new one only."""
    return _edited(weights.select("slot", "bytes").join(slot_map.select("slot", "shard"), "slot"), shards + 1, 0.0, into=shards)


def write_map(slot_map: DataFrame, folder: str, version: int) -> DataFrame:
    """Store a version (never overwritten) and read it back."""
    path = f"{folder.rstrip('/')}/version={version}"
    slot_map.coalesce(1).write.parquet(path)
    return slot_map.sparkSession.read.parquet(path)


def read_map(spark: SparkSession, folder: str, version: int | None = None) -> DataFrame:
    """(slot, shard, bytes, version) of one version, the latest by default."""
    versions = spark.read.parquet(folder)
    if version is None:
        version = versions.agg(F.max("version")).first()[0]
    return versions.filter(F.col("version") == version)


def assign(docs: DataFrame, slot_map: DataFrame, doc_id: str = "doc_id", text: str = "text", slots: int = SLOTS, output: str = "sharding") -> DataFrame:
    """``docs`` with a struct ``output`` (slot, shard): no shuffle, the map has ``slots`` rows and is broadcast.

    A record goes by its id, one without id by its text (null: empty), so rows with equal ids share a slot. An earlier
    column called ``output`` is replaced, others keep their names. An empty table stays empty.
    """
    rows = without(docs, output)
    chosen = slot_map.select(F.col("slot").alias("__slot"), F.col("shard").alias("__shard"))
    at = slot_of(F.col(f"`{doc_id}`"), F.col(f"`{text}`"), slots)
    return rows.join(F.broadcast(chosen), at == F.col("__slot"), "left").select(
        *[rows[f"`{c}`"] for c in rows.columns], F.struct(F.col("__slot").alias("slot"), F.col("__shard").alias("shard")).alias(output))


def positions(rows: DataFrame, slot_map: DataFrame) -> DataFrame:
    """(doc_id, size, crc, virtual_slot, shard, position): each record's place in its shard, gapless from 0.

    A shard holds its slots in order of their numbers, a slot its records in order of id, size and checksum. Nothing is
    ordered beyond a slot; equal records were counted, and are written out in bounded chunks at the end.
    """
    used = rows.groupBy("slot").agg(F.sum("copies").alias("records")).join(F.broadcast(slot_map.select("slot", "shard")), "slot")
    before = Window.partitionBy("shard").orderBy("slot").rowsBetween(Window.unboundedPreceding, -1)
    starts = used.select("slot", "shard", F.coalesce(F.sum("records").over(before), F.lit(0)).alias("start"))
    earlier = Window.partitionBy("slot").orderBy("doc_id", "size", "crc").rowsBetween(Window.unboundedPreceding, -1)
    placed = rows.withColumn("at", F.coalesce(F.sum("copies").over(earlier), F.lit(0)))
    placed = placed.join(F.broadcast(starts), "slot").select("doc_id", "size", "crc", "slot", "shard", "copies", (F.col("start") + F.col("at")).alias("at"))
    few = placed.filter(F.col("copies") <= CHUNK).withColumn("k", F.explode(F.sequence(F.lit(0).cast("long"), F.col("copies") - 1)))
    many = placed.filter(F.col("copies") > CHUNK)
    many = many.withColumn("chunk", F.explode(F.sequence(F.lit(0).cast("long"), F.expr(f"(copies - 1) div {CHUNK}"))))
    many = many.repartition(shuffle_partitions(rows.sparkSession), "doc_id", "size", "crc", "chunk")
    many = many.withColumn("k", F.explode(F.sequence(F.col("chunk") * CHUNK, F.least(F.col("copies"), (F.col("chunk") + 1) * CHUNK) - 1))).drop("chunk")
    return few.unionByName(many).select("doc_id", "size", "crc", F.col("slot").alias("virtual_slot"), "shard", (F.col("at") + F.col("k")).alias("position"))


def shard(docs: DataFrame, shards: int, folder: str, doc_id: str = "doc_id", text: str = "text", slots: int = SLOTS) -> DataFrame:
    """(doc_id, size, text_crc32, virtual_slot, shard, position) of every row, near equal bytes in each shard.

    Writes version 1 of the map to ``folder``. ``size`` is the text's UTF-8 bytes plus 1, a null text counts as empty. A
    record without id goes by its text. Rows with equal ids share a slot, and equal rows differ in ``position`` only. A
    text of any length is a row of this table with three numbers. No shard can hold less than its largest slot. Other
    columns take no part. An empty table gives no rows, and a map that deals its slots by number.
    """
    rows = stored(records(docs, doc_id, text, slots), "records")
    slot_map = write_map(first(slot_bytes(rows, slots), shards), folder, 1)
    return positions(rows, slot_map).select("doc_id", "size", F.col("crc").alias("text_crc32"), "virtual_slot", "shard", "position")
