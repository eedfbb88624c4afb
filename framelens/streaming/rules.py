"""Rules on a stream: each micro-batch runs the batch operators on its rows and on the few earlier rows that still matter.

Carried from batch to batch, as a written table: the last sighting of each track that is not forgotten yet
(all sightings of its current stretch if a rule times a state), its last row of an accepted class and, between
the two, a first and a last sighting of every ``stale_ms``, the last frame of each source, and for each absence rule the last occupied frame and the first empty one
after it. So the state is a table that Spark partitions, and a busy source is no single task. A batch
that runs again reads the same carried table and overwrites its own results.

Rows of a source must come in order: those not later than its last frame are dropped and counted. A row with
a null track is an empty frame. Absence rules on the region of an intrusion, dwell or abandoned rule
reset it; what they reset lies too far back to be carried, so such a pair of rules is an error.
"""
from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from framelens.operators import rules as R
from framelens.session import scratch_path, staged

COLUMNS = ["source", "ts_ms", "track_id", "cls", "confirmed", "left", "top", "right", "bottom"]
TIMED = ("dwell", "abandoned", "fall", "speed")
#: Track ids of the rows that stand for the last occupied frame of an absence rule.
_MARK = 1 << 61


def check_rules(rules: Sequence[R.Rule]) -> None:
    zones = {r.region for r in rules if r.type == "absence"}
    clash = [r.key for r in rules if r.type in ("intrusion", "dwell", "abandoned") and r.region in zones]
    if clash:
        raise ValueError(f"rules {clash} share their region with an absence rule: run them in batch")


def step(carried: DataFrame | None, rows: DataFrame, rules: Sequence[R.Rule], stale_ms: int = R.STALE_MS,
         chunk_ms: int = R.CHUNK_MS) -> tuple[DataFrame, DataFrame, int]:
    """(events of the new rows, what to carry on, number of rows that came too late)."""
    check_rules(rules)
    rows = rows.select(COLUMNS)
    late = 0
    if carried is not None:
        ends = carried.groupBy("source").agg(F.max("ts_ms").alias("_end"))
        placed = staged(rows.join(ends, "source", "left"))
        on_time = F.col("_end").isNull() | (F.col("ts_ms") > F.col("_end"))
        late = placed.where(~on_time).count()
        rows = placed.where(on_time).select(COLUMNS)
        whole = staged(carried.select(COLUMNS).unionByName(rows))
    else:
        whole = staged(rows)
    known, frames = whole.where("track_id is not null"), whole.select("source", "ts_ms")
    # computed once, for the events and for what is carried on
    lived = staged(R.lives(R.presence(known, frames, stale_ms, chunk_ms)))
    events = R.rule_events(known, rules, frames, stale_ms, chunk_ms, lived)
    if carried is not None:
        events = events.join(ends, "source", "left").where("_end is null or ts_ms > _end").drop("_end")
    return events, _carried(whole, known, lived, rules, stale_ms, chunk_ms), late


def _carried(whole: DataFrame, known: DataFrame, rows: DataFrame, rules: Sequence[R.Rule], stale_ms: int, chunk_ms: int) -> DataFrame:
    ends = whole.groupBy("source").agg(F.max("ts_ms").alias("_end"))
    packed = F.struct(*[c for c in COLUMNS if c not in ("source", "track_id")])
    last = (known.where("track_id > 0").where(F.col("track_id") < _MARK).groupBy("source", "track_id")
            .agg(F.max("ts_ms").alias("_seen")).join(ends, "source").where(F.col("_end") - F.col("_seen") <= stale_ms)
            .drop("_end"))
    frames = whole.select("source", "ts_ms")
    now = rows.groupBy("source", "track_id").agg(F.max("life").alias("_life"))
    live = rows.join(last, ["source", "track_id"]).join(now, ["source", "track_id"]).where("life = _life")
    if any(r.type in TIMED for r in rules):
        kept = live.select(COLUMNS)
    else:
        newest = lambda df, *by: (df.groupBy("source", "track_id", *by).agg(F.max_by(packed, "ts_ms").alias("_row"))
                                  .select("source", "track_id", "_row.*").select(COLUMNS))
        kept = newest(live)
        zones = [(i, r) for i, r in enumerate(rules) if r.type == "intrusion"]
        if zones:
            accepted = R.rules_by_rows(live, [r for _, r in zones])
            kept = kept.unionByName(newest(accepted, "rule_no")).unionByName(_links(live, accepted, stale_ms))
        kept = kept.distinct()
    empty = frames.groupBy("source").agg(F.max("ts_ms").alias("ts_ms"))
    absent = [(i, r) for i, r in enumerate(rules) if r.type == "absence"]
    if absent:
        line = R.timeline(known, frames, chunk_ms)
        counts = R.absence_counts(rows, line, rules)
        full = counts.where("n > 0").groupBy("source", "rule_no").agg(F.max("ts_ms").alias("_full"))
        inside = R.absence_rows(rows, rules).join(full, ["source", "rule_no"]).join(ends, "source")
        marks = (inside.where("ts_ms = _full and ts_ms < _end").groupBy("source", "rule_no").agg(F.first(packed).alias("_row"))
                 .select("source", (F.col("rule_no") + F.lit(_MARK)).alias("track_id"), "_row.*").select(COLUMNS))
        kept = kept.unionByName(marks)
        after = counts.join(full, ["source", "rule_no"]).where("ts_ms > _full").groupBy("source", "rule_no").agg(
            F.min("ts_ms").alias("ts_ms"))
        empty = empty.unionByName(after.select("source", "ts_ms"))
    blank = reduce(lambda df, c: df.withColumn(c, F.lit(None).cast(whole.schema[c].dataType)),
                   [c for c in COLUMNS if c not in ("source", "ts_ms")], empty.distinct())
    return kept.unionByName(blank.select(COLUMNS))


def _links(live: DataFrame, accepted: DataFrame, stale_ms: int) -> DataFrame:
    """Sightings that join a track's last accepted rows to its newest row, as a gap between the two would end the track.

    Of every ``stale_ms`` the first and the last one do: no two neighbours lie further apart than they did before.
    """
    since = (accepted.groupBy("source", "track_id", "rule_no").agg(F.max("ts_ms").alias("_at"))
             .groupBy("source", "track_id").agg(F.min("_at").alias("_since")))
    packed = F.struct(*[c for c in COLUMNS if c not in ("source", "track_id")])
    ends = (live.join(since, ["source", "track_id"]).where("ts_ms >= _since")
            .groupBy("source", "track_id", F.floor(F.col("ts_ms") / stale_ms).alias("_slot"))
            .agg(F.min_by(packed, "ts_ms").alias("_first"), F.max_by(packed, "ts_ms").alias("_last")))
    return ends.select("source", "track_id", F.inline(F.array("_first", "_last"))).select(COLUMNS)


def run_rules(stream: DataFrame, rules: Sequence[R.Rule], stale_ms: int = R.STALE_MS, chunk_ms: int = R.CHUNK_MS,
              checkpoint: str | None = None, folder: str | None = None) -> tuple[DataFrame, int]:
    """Process everything that is there; the events as a table, and the number of rows that came too late.

    ``folder`` holds events and carried tables by batch number and is to be kept with ``checkpoint``.
    """
    check_rules(rules)
    spark = stream.sparkSession
    out, progress = folder or scratch_path(spark, "rules"), checkpoint or scratch_path(spark, "progress")
    kinds = R.rule_events(spark.createDataFrame([], stream.select(COLUMNS).schema), rules).schema

    def save(batch: DataFrame, number: int) -> None:
        before = spark.read.parquet(f"{out}/carried/{number - 1}") if number else None
        events, carried, late = step(before, batch, rules, stale_ms, chunk_ms)
        events.write.mode("overwrite").parquet(f"{out}/events/batch={number}")
        carried.write.mode("overwrite").parquet(f"{out}/carried/{number}")
        spark.createDataFrame([(late,)], "late long").write.mode("overwrite").parquet(f"{out}/late/batch={number}")

    q = (stream.writeStream.foreachBatch(save).option("checkpointLocation", progress).trigger(availableNow=True).start())
    q.awaitTermination()
    table = spark.read.schema(kinds).parquet(f"{out}/events/*")
    return table, spark.read.parquet(f"{out}/late/*").agg(F.sum("late")).first()[0]
