"""Vision-shaped views over the given tables, for Spark and (as SQL text) for the check engine."""
from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F


def fixed(value: Column, digits: int = 4) -> Column:
    """Round to a fixed number of digits by whole-number rounding (same in both engines)."""
    return F.round(value * 10 ** digits) / 10 ** digits


def big(value: Column) -> Column:
    return value.cast("long")


class Tables:
    """The given parquet tables and the views derived from them."""

    def __init__(self, spark: SparkSession, folder: str):
        self.spark, self.folder = spark, folder

    def read(self, name: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.folder}/{name}.parquet")

    @property
    def tracked(self) -> DataFrame:
        """Tracked boxes: one event is one sighting; a user is a track, four cameras."""
        e = self.read("events")
        k = F.get_json_object("props", "$.k").cast("long")
        left = (big(F.round(F.col("value") * 100)) * 7) % 1200
        e = e.select(
            "event_id", (F.col("user_id") % 4).alias("source"),
            F.unix_millis(F.col("ts").cast("timestamp")).alias("ts_ms"),
            (F.col("user_id") + 1).alias("track_id"),
            F.expr("case event_type when 'view' then 0 when 'click' then 1 when 'purchase' then 2 "
                   "when 'signup' then 3 else 4 end").alias("cls"),
            (F.col("event_id") % 10 != 0).alias("confirmed"),
            left.alias("left"), ((k * 7) % 660).alias("top"),
            (20 + F.col("event_id") % 60).alias("w"), (20 + (F.col("event_id") * 7) % 80).alias("h"))
        return (e.withColumn("right", F.col("left") + F.col("w"))
                .withColumn("bottom", F.col("top") + F.col("h")))

    @property
    def boxes(self) -> DataFrame:
        """Detections: one order line is one box; eight orders share a frame."""
        li = self.read("lineitem")
        cents = big(F.round(F.col("l_extendedprice") * 100))
        frame = F.floor(F.col("l_orderkey") / 8).cast("long")
        order = ["l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "_cents"]
        rows = li.select(frame.alias("frame"), *order[:-1], cents.alias("_cents"), "l_quantity")
        # a frame holds a few dozen boxes, so this window stays small; only the columns that all others are made from
        # pass through its shuffle, so every use of the boxes in a query can read the same one
        rows = rows.withColumn("_idx", F.row_number().over(W.partitionBy("frame").orderBy(*order)) - 1)
        b = rows.select(
            "frame", (F.col("frame") % 7).alias("source"), (F.col("l_suppkey") % 3).alias("cls"),
            ((F.col("l_partkey") * 7) % 160).alias("left"), ((F.col("l_partkey") * 13) % 120).alias("top"),
            (40 + big(F.col("l_quantity"))).alias("w"), (40 + F.col("_cents") % 50).alias("h"),
            (((F.col("l_partkey") * 31 + F.col("l_linenumber") * 17 + F.col("_cents")) % 1000) / 1000.0).alias("score"),
            F.col("l_linenumber").cast("long").alias("line"), big(F.col("l_quantity")).alias("qty"),
            big(F.col("_idx")).alias("det_idx"))
        return (b.withColumn("right", F.col("left") + F.col("w"))
                .withColumn("bottom", F.col("top") + F.col("h")))

    @property
    def event_log(self) -> DataFrame:
        """Stored events: id, receive time and a JSON body."""
        e = self.read("events")
        task = F.element_at(F.array(*[F.lit(t) for t in ("detect", "pose", "obb", "seg")]),
                            (F.col("user_id") % 4 + 1).cast("int"))
        kind = F.expr("case event_type when 'view' then 'count' when 'click' then 'near_distance' "
                      "else 'rule_events' end")
        rule = F.expr("case event_type when 'purchase' then 'intrusion' when 'signup' then 'dwell' "
                      "else 'line_cross' end")
        body = F.concat(
            F.lit('{"task":"'), task, F.lit('","event":"'), kind, F.lit('"'),
            F.when(kind == "rule_events", F.concat(F.lit(',"rule_type":"'), rule, F.lit('"')))
            .otherwise(F.lit("")),
            F.when(F.col("event_id") % 3 != 0, F.concat(
                F.lit(',"snapshot":"snapshot_'), F.col("event_id").cast("string"), F.lit('.jpg"')))
            .otherwise(F.lit("")),
            F.lit(',"count":'), (F.col("event_id") % 9).cast("string"), F.lit("}"))
        return e.select((F.col("event_id") + 1).alias("id"),
                        F.unix_millis(F.col("ts").cast("timestamp")).alias("recv_ts"),
                        body.alias("body"))

    @property
    def reviews(self) -> DataFrame:
        """Reviews of events from document labels; every third one is revised later."""
        lab = self.read("labels")
        first = lab.select(
            F.col("doc_id").alias("event_id"), F.lit("llm").alias("source"),
            F.expr("case when toxic = 1 then 'false' when quality = 1 then 'true' else 'uncertain' end")
            .alias("verdict"),
            ((F.col("doc_id") % 100) / 100.0).alias("confidence"),
            (F.lit(1704067200000) + F.col("doc_id") * 1000).alias("ts"))
        second = lab.where("doc_id % 3 = 0").select(
            F.col("doc_id").alias("event_id"), F.lit("manual").alias("source"),
            F.expr("case when doc_id % 2 = 0 then 'false' else 'true' end").alias("verdict"),
            F.lit(1.0).alias("confidence"),
            (F.lit(1704067200500) + F.col("doc_id") * 1000).alias("ts"))
        return first.unionByName(second)


# the same views as SQL -----------------------------------------------------------------

TRACKED = """tracked AS (
  SELECT *, "left" + w AS "right", top + h AS bottom FROM (
    SELECT event_id, user_id % 4 AS source, epoch_us(ts) // 1000 AS ts_ms, user_id + 1 AS track_id,
      CASE event_type WHEN 'view' THEN 0 WHEN 'click' THEN 1 WHEN 'purchase' THEN 2
        WHEN 'signup' THEN 3 ELSE 4 END AS cls,
      event_id % 10 <> 0 AS confirmed,
      (CAST(round(value * 100) AS BIGINT) * 7) % 1200 AS "left",
      (CAST(json_extract_string(props, '$.k') AS BIGINT) * 7) % 660 AS top,
      20 + event_id % 60 AS w, 20 + (event_id * 7) % 80 AS h
    FROM events))"""

FRAMES = TRACKED + """,
frames AS (
  SELECT source, ts_ms, lag(ts_ms) OVER (PARTITION BY source ORDER BY ts_ms) AS prev_frame_ts
  FROM (SELECT DISTINCT source, ts_ms FROM tracked)),
seen AS (
  SELECT t.*, f.prev_frame_ts, lag(t.ts_ms) OVER w AS prev_ts,
    lag(t."left" + t."right") OVER w AS px, lag(t.top + t.bottom) OVER w AS py,
    lag(2 * t.bottom) OVER w AS pb
  FROM tracked t JOIN frames f USING (source, ts_ms)
  WINDOW w AS (PARTITION BY source, track_id ORDER BY ts_ms)),
rows_ AS (
  SELECT *, prev_ts IS NULL OR prev_frame_ts - prev_ts > 86400000 AS is_start FROM seen),
lived AS (
  SELECT *, max(CASE WHEN is_start THEN ts_ms END)
    OVER (PARTITION BY source, track_id ORDER BY ts_ms ROWS UNBOUNDED PRECEDING) AS life
  FROM rows_)"""

BOXES = """boxes AS (
  SELECT *, "left" + w AS "right", top + h AS bottom FROM (
    SELECT l_orderkey // 8 AS frame, (l_orderkey // 8) % 7 AS source, l_suppkey % 3 AS cls,
      (l_partkey * 7) % 160 AS "left", (l_partkey * 13) % 120 AS top,
      40 + CAST(l_quantity AS BIGINT) AS w, 40 + c % 50 AS h,
      ((l_partkey * 31 + l_linenumber * 17 + c) % 1000) / 1000.0::DOUBLE AS score,
      CAST(l_linenumber AS BIGINT) AS line, CAST(l_quantity AS BIGINT) AS qty,
      row_number() OVER (PARTITION BY l_orderkey // 8
        ORDER BY l_orderkey, l_linenumber, l_partkey, l_suppkey, c) - 1 AS det_idx
    FROM (SELECT *, CAST(round(l_extendedprice * 100) AS BIGINT) AS c FROM lineitem)))"""

EVENT_LOG = """event_log AS (
  SELECT event_id + 1 AS id, epoch_us(ts) // 1000 AS recv_ts,
    '{"task":"' || ['detect','pose','obb','seg'][user_id % 4 + 1] || '","event":"' || kind || '"' ||
    CASE WHEN kind = 'rule_events' THEN ',"rule_type":"' || rule || '"' ELSE '' END ||
    CASE WHEN event_id % 3 <> 0 THEN ',"snapshot":"snapshot_' || event_id || '.jpg"' ELSE '' END ||
    ',"count":' || (event_id % 9) || '}' AS body
  FROM (SELECT *, CASE event_type WHEN 'view' THEN 'count' WHEN 'click' THEN 'near_distance'
      ELSE 'rule_events' END AS kind,
    CASE event_type WHEN 'purchase' THEN 'intrusion' WHEN 'signup' THEN 'dwell'
      ELSE 'line_cross' END AS rule FROM events))"""

REVIEWS = """reviews AS (
  SELECT doc_id AS event_id, 'llm' AS source,
    CASE WHEN toxic = 1 THEN 'false' WHEN quality = 1 THEN 'true' ELSE 'uncertain' END AS verdict,
    (doc_id % 100) / 100.0::DOUBLE AS confidence, 1704067200000 + doc_id * 1000 AS ts
  FROM labels
  UNION ALL
  SELECT doc_id, 'manual', CASE WHEN doc_id % 2 = 0 THEN 'false' ELSE 'true' END, 1.0,
    1704067200500 + doc_id * 1000 FROM labels WHERE doc_id % 3 = 0),
latest AS (
  SELECT event_id, arg_max(verdict, ts) AS verdict, arg_max(source, ts) AS rsource,
    arg_max(confidence, ts) AS confidence, max(ts) AS review_ts
  FROM reviews GROUP BY event_id)"""
