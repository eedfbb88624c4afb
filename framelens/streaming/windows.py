"""Streams that need only built-in windows: reports, presence sessions, feeds, rough de-duplication."""
from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from framelens.session import scratch_path


def tumbling_report(crossings: DataFrame, interval: str, late: str) -> DataFrame:
    """Crossings (``source, rule_id, ts, a2b``) per source, rule and interval."""
    return (crossings.withWatermark("ts", late).groupBy(F.window("ts", interval), "source", "rule_id")
            .agg(F.count_if("a2b").alias("cross_ab"), F.count_if(~F.col("a2b")).alias("cross_ba"))
            .select("source", F.unix_millis("window.start").alias("interval_start"), "rule_id", "cross_ab", "cross_ba"))


def presence_sessions(rows: DataFrame, gap: str, late: str) -> DataFrame:
    """Visible spans of every track, closed after ``gap`` without a sighting."""
    return (rows.withWatermark("ts", late).groupBy(F.session_window("ts", gap), "source", "track_id")
            .agg(F.count(F.lit(1)).alias("sightings"))
            .select("source", "track_id", F.unix_millis("session_window.start").alias("start_ms"), "sightings"))


def open_sessions(spark: SparkSession, checkpoint: str) -> DataFrame:
    """Sessions that a run of ``presence_sessions`` has not closed yet, read from its state."""
    state = spark.read.format("statestore").load(checkpoint)
    return state.select("key.source", "key.track_id", F.unix_millis("key.sessionStartTime").alias("start_ms"),
                        F.col("value.count").alias("sightings"))


def rough_dedup(alerts: DataFrame, keys: list[str], late: str) -> DataFrame:
    """Approximate de-duplication: the first alert of a key within the watermark delay."""
    return alerts.withWatermark("ts", late).dropDuplicatesWithinWatermark(keys)


def event_feed(spark: SparkSession, path: str, schema: str, files_per_trigger: int = 100) -> DataFrame:
    """New rows of an append-only event table, as they come."""
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_trigger).parquet(path)


def each_result(stream: DataFrame, callback: Callable[[DataFrame, int], None], checkpoint: str):
    """Run user code on every micro-batch of results."""
    return (stream.writeStream.foreachBatch(callback).option("checkpointLocation", checkpoint)
            .trigger(availableNow=True).start())


def run_available(stream: DataFrame, mode: str = "append") -> DataFrame:
    """Process everything that is there, write it to the shared folder and return it as a table."""
    return run_counted(stream, mode)[0]


def run_counted(stream: DataFrame, mode: str = "append", checkpoint: str | None = None) -> tuple[DataFrame, int, int]:
    """As ``run_available``: the table, the number of rows dropped as too late, and the number of micro-batches with rows.

    ``checkpoint`` names the folder of progress and state, to go on from or to look into.
    """
    spark = stream.sparkSession
    out, number = scratch_path(spark, "stream"), {}
    q = (stream.writeStream.format("parquet").outputMode(mode).option("path", out)
         .option("checkpointLocation", checkpoint or scratch_path(spark, "progress")).trigger(availableNow=True).start())
    q.awaitTermination()
    for p in q.recentProgress:
        late = sum(o.numRowsDroppedByWatermark for o in p.stateOperators)
        number[p.batchId] = max(number.get(p.batchId, (0, 0)), (late, p.numInputRows))
    table = spark.read.schema(stream.schema).parquet(out)
    return table, sum(late for late, _ in number.values()), sum(rows > 0 for _, rows in number.values())


def as_stream(df: DataFrame, order: str | None = None) -> DataFrame:
    """Write a table to the shared folder and read it back as a stream."""
    path = scratch_path(df.sparkSession, "feed")
    (df.repartitionByRange(order) if order else df).write.parquet(path)
    return df.sparkSession.readStream.schema(df.schema).parquet(path)


def in_turns(parts: Sequence[DataFrame]) -> DataFrame:
    """A stream that brings the given tables one after the other, one micro-batch each."""
    spark, path = parts[0].sparkSession, scratch_path(parts[0].sparkSession, "turns")
    schema = parts[0].schema
    # a micro-batch takes a fixed number of files, so every turn is written by as many tasks and filled up with empty files
    files = min(spark.sparkContext.defaultParallelism, max(part.rdd.getNumPartitions() for part in parts))
    blank = spark.createDataFrame([], schema).coalesce(1)
    for number, part in enumerate(parts):
        turn = f"{path}/{number}"
        part.coalesce(files).write.parquet(turn)
        for _ in range(files - len(spark.read.schema(schema).parquet(turn).inputFiles())):
            blank.write.mode("append").parquet(turn)
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files).parquet(f"{path}/*")
