"""Streaming forms, checked against the same SQL as their batch forms."""
from __future__ import annotations

from pyspark.sql import functions as F

from framelens.operators import events as E
from framelens.operators import rules as R
from framelens.sources import event_log as L
from framelens.session import scratch_path
from framelens.streaming import rules as SR
from framelens.streaming import stateful as S
from framelens.streaming import windows as SW
from framelens.workload.events import ALERTS, INCOMING, alerts, greedy_throttle, incoming
from framelens.workload.registry import ORACLES, query
from framelens.workload.rules import ABSENT, CROSS, CROWD, DAY, INTRUDE, LINE, SCALE
from framelens.workload.views import EVENT_LOG, REVIEWS, TRACKED, Tables


START, HOUR = 1704067200000, 3_600_000  # 2024-01-01 00:00 UTC


def _turns(df, ts: str, days: int, parts: int):
    """Consecutive time slices; the first and last are open towards their side."""
    slot = F.least(F.greatest(F.floor((F.col(ts) - START) / (days * DAY)), F.lit(0)), F.lit(parts - 1))
    return [df.where(slot == k) for k in range(parts)]


@query("str1_stateful_rules", CROSS + """
SELECT source, ts_ms, track_id, CASE WHEN a2b THEN 'A->B' ELSE 'B->A' END AS detail FROM crossed""")
def str1(t: Tables):
    live, _ = SR.run_rules(SW.in_turns(_turns(t.tracked, "ts_ms", 10, 3)), [LINE], **SCALE)
    return live.select("source", "ts_ms", "track_id", "detail")


@query("str1_many_rules", ORACLES["set2_rule_event_union"])
def str1_many(t: Tables):
    live, _ = SR.run_rules(SW.in_turns(_turns(t.tracked, "ts_ms", 10, 3)), [LINE, ABSENT, CROWD], **SCALE)
    return live.groupBy("source", "type").agg(F.count(F.lit(1)).alias("n"))


@query("str3_state_expiry", ORACLES["rul2_intrusion"])
def str3(t: Tables):
    # forgotten tracks are not carried on and enter the region anew, so the events show that state expires
    live, _ = SR.run_rules(SW.in_turns(_turns(t.tracked, "ts_ms", 10, 3)), [INTRUDE], **SCALE)
    return live.select("source", "ts_ms", "rule_id", "track_id", "cls", "detail")


@query("str4_tumbling_report", CROSS + """
SELECT source, ts_ms // 86400000 * 86400000 AS interval_start, 'gate' AS rule_id,
  count(*) FILTER (a2b) AS cross_ab, count(*) FILTER (NOT a2b) AS cross_ba FROM crossed GROUP BY ALL""")
def str4(t: Tables):
    found = R.line_crossings(R.presence(t.tracked, **SCALE), [LINE]).select(
        "source", "rule_id", F.timestamp_millis("ts_ms").alias("ts"), "a2b")
    return _report(found)


def _report(found):
    """Complete results in one table: windows that are still open when the input ends count as well."""
    stream = SW.tumbling_report(SW.as_stream(found), "1 day", "0 seconds")
    out = scratch_path(found.sparkSession, "report")

    def save(batch, number):
        batch.write.mode("overwrite").parquet(f"{out}/{number}")
    q = (stream.writeStream.outputMode("complete").foreachBatch(save).option(
        "checkpointLocation", scratch_path(found.sparkSession, "progress")).trigger(availableNow=True).start())
    q.awaitTermination()
    last = q.lastProgress["batchId"]
    return found.sparkSession.read.schema(stream.schema).parquet(f"{out}/{last}")


SESSIONS = TRACKED + """,
s AS (SELECT *, CASE WHEN ts_ms - lag(ts_ms) OVER w >= 3600000 OR lag(ts_ms) OVER w IS NULL THEN 1 ELSE 0 END AS fresh FROM tracked
  WINDOW w AS (PARTITION BY source, track_id ORDER BY ts_ms)),
g AS (SELECT *, sum(fresh) OVER (PARTITION BY source, track_id ORDER BY ts_ms) AS n FROM s),
k AS (SELECT source, track_id, min(ts_ms) AS start_ms, max(ts_ms) AS end_ms, count(*) AS sightings FROM g GROUP BY source, track_id, n)
"""


@query("str5_presence_sessions", SESSIONS + " SELECT source, track_id, start_ms, sightings FROM k")
def str5(t: Tables):
    rows = t.tracked.select("source", "track_id", F.timestamp_millis("ts_ms").alias("ts"))
    # the batch form of the same plan closes every session
    return SW.presence_sessions(rows, "1 hour", "1 hour")


@query("str5_sessions_as_stream", SESSIONS + """
SELECT source, track_id, start_ms, sightings, end_ms + 3600000 < (SELECT max(ts_ms) FROM tracked) - 950400000 AS closed FROM k""")
def str5_stream(t: Tables):
    # slices of five days swapped in pairs: rows come up to ten days late, and the watermark allows for eleven
    slices = _turns(t.tracked.select("source", "track_id", "ts_ms", F.timestamp_millis("ts_ms").alias("ts")), "ts_ms", 5, 6)
    shuffled = [slices[k ^ 1] for k in range(6)]
    path = scratch_path(t.spark, "progress")
    closed, _, _ = SW.run_counted(SW.presence_sessions(SW.in_turns(shuffled), "1 hour", "11 days"), checkpoint=path)
    return closed.withColumn("closed", F.lit(True)).unionByName(
        SW.open_sessions(t.spark, path).withColumn("closed", F.lit(False)))


@query("str6_incremental_feed", EVENT_LOG + " SELECT id, recv_ts FROM event_log")
def str6(t: Tables):
    path = scratch_path(t.spark, "events")
    log = t.event_log
    log.write.parquet(path)
    return SW.run_available(SW.event_feed(t.spark, path, "id long, recv_ts long, body string")).select("id", "recv_ts")


@query("str6_live_feed", EVENT_LOG + "," + REVIEWS + """,
c AS (SELECT event_id AS id, verdict, lag(verdict) OVER (PARTITION BY event_id ORDER BY ts) AS before FROM reviews)
SELECT id, 'event' AS kind, NULL AS verdict FROM event_log
UNION ALL SELECT id, 'review', verdict FROM c WHERE verdict IS DISTINCT FROM before AND id IN (SELECT id FROM event_log)""")
def str6_live(t: Tables):
    return _feed(t)[0]


def _feed(t: Tables):
    """Five slices of events and of reviews, in turns: reviews come before and after their events."""
    log = t.event_log.select("id", "recv_ts")
    reviews = t.reviews.select("event_id", "ts", "verdict")
    last = reviews.agg(F.max("ts")).first()[0] + 1
    cut = [last * k // 5 + START * (5 - k) // 5 for k in range(6)]
    said = [reviews.where((F.col("ts") >= a) & (F.col("ts") < b)) for a, b in zip(cut, cut[1:])]
    stream = S.live_feed(SW.in_turns(_turns(log, "recv_ts", 6, 5)), SW.in_turns(said), "1 day", "60 days")
    return SW.run_counted(stream)


@query("str7_stream_throttle", "WITH RECURSIVE " + ALERTS + "," + greedy_throttle("alerts", "source", 14400000) + " SELECT source, ts_ms, id FROM chain")
def str7(t: Tables):
    return _throttled(alerts(t))[0]


def _throttled(rows):
    """Three slices of ten days; a last row far ahead without a source moves the watermark past all others."""
    clock = rows.agg(F.max("ts_ms").alias("ts_ms")).select(*[
        (F.col("ts_ms") + 60 * DAY if c == "ts_ms" else F.lit(None)).cast(rows.schema[c].dataType).alias(c) for c in rows.columns])
    stream = SW.in_turns([*_turns(rows, "ts_ms", 10, 3), clock, clock.withColumn("ts_ms", F.col("ts_ms") + DAY)])
    out, late = S.run_throttle(stream, ["source"], 14400000, ["id"])
    return out.where("source is not null").select("source", "ts_ms", "id"), late


@query("str7_late_alerts", "WITH RECURSIVE " + ALERTS.rstrip() + """,
timely AS (SELECT * FROM alerts WHERE id % 20 <> 0 OR ts_ms >= 1704931200000),
""" + greedy_throttle("timely", "source", 14400000) + """
SELECT source, ts_ms, id, (SELECT count(*) FROM alerts WHERE id % 20 = 0 AND ts_ms < 1704931200000) AS late FROM chain""")
def str7_late(t: Tables):
    """A twentieth of the alerts of the first ten days comes after all others: dropped and counted."""
    rows = alerts(t)
    lost = (F.col("id") % 20 == 0) & (F.col("ts_ms") < START + 10 * DAY)
    clock = rows.agg(F.max("ts_ms").alias("ts_ms")).select(*[
        (F.col("ts_ms") + 60 * DAY if c == "ts_ms" else F.lit(None)).cast(rows.schema[c].dataType).alias(c) for c in rows.columns])
    stream = SW.in_turns([*_turns(rows.where(~lost), "ts_ms", 10, 3), rows.where(lost), clock])
    out, late = S.run_throttle(stream, ["source"], 14400000, ["id"], DAY)
    return out.where("source is not null").select("source", "ts_ms", "id", F.lit(late).cast("long").alias("late"))


@query("str7_dedup_within_watermark", "WITH " + ALERTS + """
SELECT source, id FROM alerts""")
def str7_dedup(t: Tables):
    """Every alert is delivered twice, in two micro-batches; only one of each stays."""
    rows = alerts(t).withColumn("ts", F.timestamp_millis("ts_ms"))
    slices = _turns(rows, "ts_ms", 10, 3)
    return SW.run_available(SW.rough_dedup(SW.in_turns([s for p in slices for s in (p, p)]), ["id"], "40 days")).select("source", "id")


@query("src16_streaming_ingest", INCOMING + " SELECT count(*) AS n FROM incoming WHERE seq % 7 NOT IN (1, 2, 3)")
def src16(t: Tables):
    path = scratch_path(t.spark, "bodies")
    incoming(t).select("body").write.text(path)
    return SW.run_available(L.stream_events(t.spark, path)).agg(F.count(F.lit(1)).alias("n"))


@query("udf1_result_callback", EVENT_LOG + " SELECT count(*) AS n, max(id) AS last_id FROM event_log")
def udf1(t: Tables):
    path, out = scratch_path(t.spark, "results"), scratch_path(t.spark, "callback")
    t.event_log.write.parquet(path)

    def user_code(batch, number):
        batch.agg(F.count(F.lit(1)).alias("n"), F.max("id").alias("last_id")).write.mode("overwrite").parquet(f"{out}/batch={number}")
    feed = SW.event_feed(t.spark, path, "id long, recv_ts long, body string")
    SW.each_result(feed, user_code, scratch_path(t.spark, "progress")).awaitTermination()
    return t.spark.read.parquet(out).agg(F.sum("n").alias("n"), F.max("last_id").alias("last_id"))


@query("udf2_review_provider", EVENT_LOG + " SELECT id AS event_id, 'uncertain' AS verdict, 0.5::DOUBLE AS confidence FROM event_log")
def udf2(t: Tables):
    return E.run_reviews(t.event_log).select("event_id", "verdict", "confidence")
