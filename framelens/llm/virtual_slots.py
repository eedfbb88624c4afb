"""Sharding by fixed virtual slots with a versioned slot-to-shard map.

Records hash into a fixed number of slots. Bytes are summed per slot, and the map from slots to
shards is a small table with a version. Rebalancing edits it: of each shard the slots beyond
its fair share (its smallest ones) are released and given, largest first, to the shard with the
least bytes; all other slots stay where they are. DataFrame functions only.

The law held is ``bytes``: shard sizes are near equal. Null text counts as empty (size 1), a
null id hashes like any value. Equal rows are interchangeable and numbered one after the other.
Empty table: empty result, and the map stays uniform.
"""
from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from framelens.session import written

SLOTS = 4096
SHARDS = 8


def record_size(text: Column) -> Column:
    return F.coalesce(F.octet_length(text), F.lit(0)).cast("long") + 1


def record_slot(*cols: Column, slots: int = SLOTS) -> Column:
    return F.pmod(F.xxhash64(*cols), F.lit(slots)).cast("int")


def uniform_map(spark: SparkSession, slots: int = SLOTS, shards: int = SHARDS) -> DataFrame:
    """Version 1: slots dealt to the shards in equal runs."""
    return spark.range(slots).select(F.col("id").cast("int").alias("virtual_slot"),
                                     F.floor(F.col("id") * shards / slots).cast("int").alias("shard"),
                                     F.lit(1).alias("version"))


def rebalance(current: DataFrame, slot_bytes: DataFrame, shards: int = SHARDS) -> DataFrame:
    """The next version of the map for the given bytes per slot.

    ``current`` and ``slot_bytes`` have one row per slot, so the one-row steps below are bounded
    by the fixed number of slots. ``shards`` may be larger than before: a new shard starts empty.
    """
    known = current.join(slot_bytes, "virtual_slot", "left").select(
        "virtual_slot", "shard", "version", F.coalesce("bytes", F.lit(0)).cast("long").alias("bytes"))
    share = F.sum("bytes").over(W.partitionBy()) / F.lit(shards)
    filled = F.sum("bytes").over(W.partitionBy("shard").orderBy(F.desc("bytes"), "virtual_slot"))
    marked = known.select("*", (filled <= share).alias("stays"))
    loads = marked.where("stays").groupBy("shard").agg(F.sum("bytes").alias("load"))
    one = marked.agg(F.sort_array(F.collect_list(F.when(
        ~F.col("stays"), F.struct("bytes", "virtual_slot"))), asc=False).alias("free"))
    full = loads.agg(F.collect_list(F.struct("load", "shard"))).scalar()

    def load_of(s: Column) -> Column:
        found = F.filter("loads", lambda x: x["shard"] == s)
        return F.struct(F.coalesce(F.get(found, F.lit(0))["load"], F.lit(0).cast("long")).alias("load"), s.alias("shard"))

    start = F.struct(F.transform(F.sequence(F.lit(0), F.lit(shards - 1)), load_of).alias("loads"),
                     F.array().cast("array<struct<virtual_slot: int, shard: int>>").alias("given"))

    def give(acc: Column, item: Column) -> Column:
        least = F.array_min(acc["loads"])
        put = F.transform(acc["loads"], lambda x: F.when(x["shard"] == least["shard"], F.struct(
            (x["load"] + item["bytes"]).alias("load"), x["shard"].alias("shard"))).otherwise(x))
        return F.struct(put.alias("loads"), F.array_append(acc["given"], F.struct(
            item["virtual_slot"].alias("virtual_slot"), least["shard"].alias("shard"))).alias("given"))

    given = (one.withColumn("loads", full)
             .select(F.inline(F.aggregate("free", start, give, lambda a: a["given"]))))
    moved = given.withColumnRenamed("shard", "new_shard")
    return (marked.join(moved, "virtual_slot", "left")
            .select("virtual_slot", F.coalesce("new_shard", "shard").alias("shard"),
                    (F.col("version") + 1).alias("version")))


def save_map(table: DataFrame, path: str) -> None:
    """Append a version of the map to its store."""
    table.write.mode("append").partitionBy("version").parquet(path)


def load_map(spark: SparkSession, path: str, version: int | None = None) -> DataFrame:
    """A stored version of the map, the newest by default."""
    store = spark.read.parquet(path)
    wanted = F.lit(version) if version is not None else store.agg(F.max("version")).first()[0]
    return store.where(F.col("version") == wanted).select("virtual_slot", "shard", "version")


def assign(df: DataFrame, table: DataFrame, *key: str, slots: int = SLOTS) -> DataFrame:
    """``df`` with virtual_slot and shard; the map has one row per slot, so it is broadcast."""
    return (df.drop("virtual_slot", "shard")
            .withColumn("virtual_slot", record_slot(*[F.col(f"`{k}`") for k in key], slots=slots))
            .join(F.broadcast(table.select("virtual_slot", "shard")), "virtual_slot"))


def write_shards(df: DataFrame, table: DataFrame, path: str, *key: str, slots: int = SLOTS) -> None:
    """The records as one folder of Parquet files per shard, several writers for each."""
    assign(df, table, *key, slots=slots).repartition("shard", "virtual_slot").write.partitionBy("shard").parquet(path)


def shard_digest(df: DataFrame, doc_id: str = "doc_id", text: str = "text",
                 slots: int = SLOTS, shards: int = SHARDS) -> DataFrame:
    """One row per document: size, checksum, shard and its place there.

    Equal rows are counted before the shuffle and numbered together, so that a group of copies
    never meets in one task.
    """
    t = F.col(f"`{text}`")
    rows = df.select(F.col(f"`{doc_id}`").alias("doc_id"), record_size(t).alias("size"),
                     F.crc32(F.coalesce(t, F.lit("")).cast("binary")).alias("text_crc32"))
    counted, _ = written(
        rows.groupBy("doc_id", "size", "text_crc32").agg(F.count(F.lit(1)).alias("n"))
        .withColumn("virtual_slot", record_slot(F.col("doc_id"), F.col("text_crc32"), slots=slots)), "slot-rows")
    per_slot = counted.groupBy("virtual_slot").agg(F.sum(F.col("size") * F.col("n")).alias("bytes"),
                                                   F.sum("n").alias("rows"))
    table, _ = written(rebalance(uniform_map(df.sparkSession, slots, shards), per_slot, shards), "slot-map")
    before = F.coalesce(F.sum("rows").over(W.partitionBy("shard").orderBy("virtual_slot")
                                           .rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    # one row per slot at most
    places = table.join(per_slot, "virtual_slot").select("virtual_slot", "shard", "version", before.alias("first"))
    inside = F.sum("n").over(W.partitionBy("virtual_slot").orderBy("doc_id", "size", "text_crc32")) - F.col("n")
    return (counted.withColumn("inside", inside).join(F.broadcast(places), "virtual_slot")
            .select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard",
                    F.explode(F.sequence(F.lit(0).cast("long"), F.col("n") - 1)).alias("k"),
                    "first", "inside", "virtual_slot", F.col("version").alias("map_version"))
            .select("doc_id", "size", "text_crc32", "law", "shard",
                    (F.col("first") + F.col("inside") + F.col("k")).alias("slot"),
                    F.lit(None).cast("int").alias("grown_shard"), "virtual_slot", "map_version"))
