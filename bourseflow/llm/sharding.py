"""Shards through fixed virtual slots.

Records hash into a fixed number of virtual slots; the bytes of each slot are summed, and a versioned map says which shard holds
which slot. Rebalancing edits the map, never the hash: a record's slot stays the same for ever, and only records of moved slots move.

Everything is DataFrame functions. What grows with the input is summed per slot first; the map has as many rows as there are slots.

Defined results: a null text counts as no bytes (size 1, crc32 of nothing); rows that agree in doc_id and text are one record and
share a virtual slot, but for `place` where more than `least_copies` of them outweigh the other cells: those are dealt over all slots,
so that the law holds and none of them is ordered in one task; a null doc_id hashes as its own value together with the text, so such rows spread by text. An empty table
gives no rows. Extra columns are ignored by `place` and kept by `sharded`."""
from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession, Window as W, functions as F

from bourseflow.llm.common import small_side, stored


@dataclass(frozen=True)
class Settings:
    shards: int = 16
    slots: int = 4096                # virtual slots, fixed for the life of a corpus
    cells: int = 16                  # parts of a slot that are numbered apart, so that numbering never gathers a slot
    seed: int = 10
    spread: float = 8.0              # a cell of so many times the mean is looked into
    least_copies: int = 1000         # copies of a record up to which they stay together


def records(docs: DataFrame, s: Settings) -> DataFrame:
    """doc_id, size, text_crc32 and the place of each record in the fixed slots."""
    text = F.coalesce(F.col("text"), F.lit(""))
    sized = docs.select("doc_id", (F.octet_length(text) + 1).cast("long").alias("size"), F.crc32(text.cast("binary")).alias("text_crc32"))
    h = F.xxhash64(F.lit(s.seed), F.coalesce(F.col("doc_id").cast("string"), F.lit("null")), "text_crc32", "size")
    return sized.withColumn("h", h).select(
        "doc_id", "size", "text_crc32", F.pmod("h", F.lit(s.slots)).cast("int").alias("virtual_slot"),
        F.pmod(F.shiftright("h", 32), F.lit(s.cells)).cast("int").alias("cell"))


def spread_repeats(placed: DataFrame, s: Settings) -> DataFrame:
    """The stored records with copies of one record that would outweigh a cell dealt over all slots, by the number of the row.

    Counts of the cells show where such records can be; only rows of those cells are counted one by one."""
    cells = placed.groupBy("virtual_slot", "cell").agg(F.count(F.lit(1)).alias("rows"), F.sum("size").alias("bytes"))
    total = cells.agg(F.sum("rows").alias("rows"), F.sum("bytes").alias("bytes")).first()
    if not total["rows"]:
        return placed.drop("row")
    usual = {c: s.spread * max(1.0, total[c] / (s.slots * s.cells)) for c in ("rows", "bytes")}
    full = cells.where((F.col("rows") > max(usual["rows"], s.least_copies)) & (F.col("bytes") > usual["bytes"])).select("virtual_slot", "cell")
    if full.isEmpty():
        return placed.drop("row")
    same = ["doc_id", "text_crc32", "size"]
    inside = placed.join(F.broadcast(full), ["virtual_slot", "cell"])                 # s.slots * s.cells rows at most
    often = stored(inside.groupBy(*same).agg(F.count(F.lit(1)).alias("copies")).where(F.col("copies") > max(usual["rows"], s.least_copies)), "repeats")
    # rows of a cell are more than least_copies for each of these, so there are few
    often = small_side(often.select(*[F.col(c).alias(f"_{c}") for c in same], F.lit(True).alias("often")), s.slots * s.cells)
    met = placed.join(often, F.col("doc_id").eqNullSafe(F.col("_doc_id")) & (F.col("text_crc32") == F.col("_text_crc32")) & (F.col("size") == F.col("_size")), "left")
    h = F.xxhash64(F.lit(s.seed), F.lit("copy"), "row", "text_crc32")
    moved = F.col("often").isNotNull()
    return met.select(*same, F.when(moved, F.pmod(h, F.lit(s.slots)).cast("int")).otherwise(F.col("virtual_slot")).alias("virtual_slot"),
                      F.when(moved, F.pmod(F.shiftright(h, 32), F.lit(s.cells)).cast("int")).otherwise(F.col("cell")).alias("cell"))


def slot_bytes(placed: DataFrame, s: Settings) -> DataFrame:
    """Bytes of every virtual slot, also of those that hold nothing."""
    summed = placed.groupBy("virtual_slot").agg(F.sum("size").alias("bytes"))
    every = placed.sparkSession.range(s.slots).select(F.col("id").cast("int").alias("virtual_slot"))
    return every.join(summed, "virtual_slot", "left").select("virtual_slot", F.coalesce("bytes", F.lit(0)).cast("long").alias("bytes"))


def first_map(bytes_of: DataFrame, s: Settings) -> DataFrame:
    """Version 1: slots in falling order of bytes, each to the shard that has least so far (the lowest number of equals)."""
    nobody = F.struct(F.expr(f"array_repeat(0L, {s.shards})").alias("loads"), F.expr("cast(array() as array<int>)").alias("to"))

    def put(acc, slot):
        at = (F.array_position(acc["loads"], F.array_min(acc["loads"])) - 1).cast("int")
        return F.struct(F.transform(acc["loads"], lambda x, i: F.when(i == at, x - slot["less"]).otherwise(x)).alias("loads"),
                        F.concat(acc["to"], F.array(at)).alias("to"))
    listed = bytes_of.agg(F.sort_array(F.collect_list(F.struct((-F.col("bytes")).alias("less"), "virtual_slot"))).alias("slots"))
    laid = listed.select("slots", F.aggregate("slots", nobody, put)["to"].alias("to"))
    return (laid.select(F.explode(F.arrays_zip("slots", "to")).alias("x"))
            .select(F.lit(1).alias("version"), F.col("x.slots.virtual_slot").alias("virtual_slot"), F.col("x.to").alias("shard")))


def newest(slot_map: DataFrame) -> DataFrame:
    """The rows in force: of each slot the one with the highest version."""
    return (slot_map.groupBy("virtual_slot").agg(F.max(F.struct("version", "shard")).alias("x"))
            .select("x.version", "virtual_slot", "x.shard"))


def grown(slot_map: DataFrame, bytes_of: DataFrame, shards: int) -> DataFrame:
    """The edit that adds shard number `shards`: rows of a next version for the slots that move, all of them into the new shard.

    Every old shard gives slots, in an order fixed by hash, while the sum of what it gave stays within its surplus over the new mean."""
    now = newest(slot_map).join(bytes_of, "virtual_slot")
    mean = bytes_of.agg((F.sum("bytes") / (shards + 1)).alias("mean"))
    order = W.partitionBy("shard").orderBy(F.xxhash64(F.lit(shards), "virtual_slot"), "virtual_slot")
    run = (now.withColumn("gone", F.sum("bytes").over(order.rowsBetween(W.unboundedPreceding, 0)))
           .withColumn("load", F.sum("bytes").over(W.partitionBy("shard"))).join(F.broadcast(mean)))
    version = slot_map.agg((F.max("version") + 1).alias("version"))
    return (run.where("bytes > 0 and gone <= load - mean").join(F.broadcast(version.toDF("next")))
            .select(F.col("next").cast("int").alias("version"), "virtual_slot", F.lit(shards).cast("int").alias("shard")))


def write_map(slot_map: DataFrame, folder: str) -> None:
    """Add versions to a stored map: one partition per version, so an edit never rewrites an earlier one."""
    slot_map.write.mode("append").partitionBy("version").parquet(folder)


def read_map(spark: SparkSession, folder: str) -> DataFrame:
    return spark.read.parquet(folder).select(F.col("version").cast("int"), "virtual_slot", "shard")


def place(docs: DataFrame, s: Settings = Settings(), slot_map: DataFrame | None = None) -> DataFrame:
    """One row per document row: doc_id, size, text_crc32, law, shard, slot, grown_shard, virtual_slot, map_version.

    `slot` is the row's number inside its shard, gapless from 0. Without a given map a first one is laid out over these bytes."""
    placed = stored(records(docs, s).withColumn("row", F.monotonically_increasing_id()), "slot-records")
    placed = spread_repeats(placed, s)
    slot_map = first_map(slot_bytes(placed, s), s) if slot_map is None else newest(slot_map)
    slot_map = F.broadcast(stored(slot_map, "slot-map"))                       # s.slots rows
    cells = placed.groupBy("virtual_slot", "cell").count().join(slot_map, "virtual_slot")
    before = W.partitionBy("shard").orderBy("virtual_slot", "cell").rowsBetween(W.unboundedPreceding, -1)
    starts = stored(cells.select("virtual_slot", "cell", "version", "shard", F.coalesce(F.sum("count").over(before), F.lit(0)).alias("start")),
                    "cell-starts")                                             # s.slots * s.cells rows at most
    inside = W.partitionBy("virtual_slot", "cell").orderBy("doc_id", "text_crc32", "size")
    return (placed.withColumn("at", F.row_number().over(inside)).join(F.broadcast(starts), ["virtual_slot", "cell"])
            .select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard",
                    (F.col("start") + F.col("at") - 1).cast("long").alias("slot"), F.lit(None).cast("int").alias("grown_shard"),
                    "virtual_slot", F.col("version").alias("map_version")))


def sharded(docs: DataFrame, s: Settings = Settings()) -> DataFrame:
    """The documents, all columns, with `shard` and `virtual_slot` added (columns of these names are replaced)."""
    size = (F.octet_length(F.coalesce(F.col("text"), F.lit(""))) + 1).cast("long")
    crc = F.crc32(F.coalesce(F.col("text"), F.lit("")).cast("binary"))
    h = F.xxhash64(F.lit(s.seed), F.coalesce(F.col("doc_id").cast("string"), F.lit("null")), crc, size)
    rows = docs.drop("shard", "virtual_slot").withColumn("virtual_slot", F.pmod(h, F.lit(s.slots)).cast("int"))
    sums = stored(slot_bytes(rows.select("virtual_slot", size.alias("size")), s), "slot-bytes")
    slot_map = F.broadcast(stored(first_map(sums, s).select("virtual_slot", "shard"), "slot-map"))
    return rows.join(slot_map, "virtual_slot").select(*rows.columns, "shard")
