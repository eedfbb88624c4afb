"""Event store, review, alert and retention queries."""
from __future__ import annotations

from pyspark.sql import functions as F

from framelens.functions import text as X
from framelens.operators import alerts as A
from framelens.operators import events as E
from framelens.operators import reports as RP
from framelens.operators import suppression as S
from framelens.session import scratch_path
from framelens.sources import event_log as L
from framelens.workload.detections import nested
from framelens.workload.registry import query
from framelens.workload.views import BOXES, EVENT_LOG, REVIEWS, Tables, big

TYPE = "coalesce(nullif(json_extract_string(body, '$.rule_type'), ''), nullif(json_extract_string(body, '$.event'), ''), '{0}')"
JOINED = EVENT_LOG + "," + REVIEWS + """,
joined AS (SELECT e.*, l.verdict, l.rsource, l.confidence, l.review_ts FROM event_log e LEFT JOIN latest l ON l.event_id = e.id)"""

INCOMING = """incoming AS (SELECT epoch_us(ts) // 1000 AS recv_ts, event_id AS seq,
  CASE event_id % 7 WHEN 1 THEN '[1,2]' WHEN 2 THEN '{"a":' WHEN 3 THEN 'text' ELSE props END AS body FROM events)"""


def incoming(t: Tables):
    e = t.read("events")
    body = F.expr("""case event_id % 7 when 1 then '[1,2]' when 2 then '{"a":' when 3 then 'text' else props end""")
    return e.select(F.unix_millis(F.col("ts").cast("timestamp")).alias("recv_ts"),
                    F.col("event_id").alias("seq"), body.alias("body"))


@query("evt1_append_with_id", INCOMING + """
SELECT 500 + row_number() OVER (ORDER BY recv_ts, seq) AS id, seq, body FROM incoming WHERE seq % 7 NOT IN (1, 2, 3)""")
def evt1(t: Tables):
    return E.append_events(incoming(t), 500).select("id", "seq", "body")


@query("evt2_query", EVENT_LOG + """
SELECT id, recv_ts, body FROM (SELECT * FROM event_log WHERE id > 40 AND json_extract_string(body, '$.task') = 'pose'
  AND json_extract_string(body, '$.rule_type') = 'dwell' ORDER BY id DESC LIMIT 50)""")
def evt2(t: Tables):
    return E.query_events(t.event_log, "pose", "dwell", 40, 50)


@query("evt2_query_default_limit", EVENT_LOG + """
SELECT id FROM (SELECT * FROM event_log WHERE json_extract_string(body, '$.event') = 'count' ORDER BY id DESC LIMIT 5000)""")
def evt2_default(t: Tables):
    return E.query_events(t.event_log, type="count", limit=5000).select("id")


@query("evt3_get_by_id", EVENT_LOG + " SELECT id, recv_ts, body FROM event_log WHERE id = 77")
def evt3(t: Tables):
    return E.get_event(t.event_log, 77)


@query("evt4_attach_review", JOINED + " SELECT id, verdict, rsource AS source, confidence FROM joined")
def evt4(t: Tables):
    return E.attach_reviews(t.event_log, t.reviews).select("id", "review.verdict", "review.source", "review.confidence")


@query("evt4_unmatched_reviews", EVENT_LOG + "," + REVIEWS + """
SELECT event_id, source, ts FROM reviews WHERE event_id NOT IN (SELECT CASE WHEN id % 5 = 0 THEN -id ELSE id END FROM event_log)""")
def evt4_unmatched(t: Tables):
    return E.unmatched_reviews(t.event_log.withColumn("id", F.when(F.col("id") % 5 == 0, -F.col("id")).otherwise(F.col("id"))), t.reviews).select("event_id", "source", "ts")


@query("jn3_latest_review", REVIEWS + " SELECT event_id AS id, verdict, review_ts AS ts FROM latest")
def jn3(t: Tables):
    return E.latest_reviews(t.reviews).select("id", "review.verdict", "review.ts")


@query("evt5_manual_review", """
SELECT doc_id AS event_id, verdict, verdict IN ('true', 'false') AS accepted, CASE WHEN verdict IN ('true', 'false') THEN 'manual' END AS source
FROM (SELECT doc_id, CASE WHEN toxic = 1 THEN 'false' WHEN quality = 1 THEN 'true' ELSE 'maybe' END AS verdict FROM labels)""")
def evt5(t: Tables):
    sent = t.read("labels").select(F.col("doc_id").alias("event_id"), F.expr(
        "case when toxic = 1 then 'false' when quality = 1 then 'true' else 'maybe' end").alias("verdict"))
    good, bad = E.manual_reviews(sent)
    return good.select("event_id", "verdict", F.lit(True).alias("accepted"), "source").unionByName(
        bad.select("event_id", "verdict", F.lit(False).alias("accepted"), F.lit(None).cast("string").alias("source")))


@query("evt6_feed", JOINED + """
SELECT id, CASE WHEN verdict IS NULL THEN 'event' ELSE 'review' END AS kind FROM (
  SELECT * FROM joined WHERE id > 60)
UNION ALL SELECT id, 'review' FROM joined WHERE id <= 60 AND review_ts > 1704067220000""")
def evt6(t: Tables):
    return E.feed(t.event_log, t.reviews, 60, 1704067220000)


@query("evt7_review_routing", EVENT_LOG + """
SELECT id, CASE WHEN json_extract_string(body, '$.snapshot') IS NOT NULL THEN 'review' ELSE 'forward' END AS route FROM event_log""")
def evt7(t: Tables):
    queued, passed = E.route(t.event_log, True, F.get_json_object("body", "$.snapshot").isNotNull())
    return queued.select("id", F.lit("review").alias("route")).unionByName(
        passed.select("id", F.lit("forward").alias("route")))


def _even_replies(prompts):
    """A user model: judges by the length of the prompt, and sometimes fails."""
    n = prompts.str.len()
    return n.map(lambda v: 'Reply: {"verdict": "%s", "confidence": 0.75, "reason": "len"}' % ("true", "false")[v % 2]
                 if v % 5 else "no idea")


@query("evt8_review_job", EVENT_LOG + """
SELECT id AS event_id, CASE WHEN n % 5 = 0 THEN 'error' WHEN n % 2 = 0 THEN 'true' ELSE 'false' END AS verdict,
  CASE WHEN n % 5 = 0 THEN 0.0 ELSE 0.75 END AS confidence FROM (SELECT id, length(body) + 8 AS n FROM event_log)""")
def evt8(t: Tables):
    return E.run_reviews(t.event_log, _even_replies).select("event_id", "verdict", "confidence")


@query("evt9_false_alarm_archive", JOINED + f"""
SELECT id, review_ts AS ts, json_extract_string(body, '$.task') AS task, {TYPE.format('alert')} AS type,
  json_extract_string(body, '$.snapshot') AS original_snapshot,
  json_extract_string(body, '$.task') || '/' || {TYPE.format('alert')} || '/' || id || '_' || recv_ts || '.jpg' AS image
FROM joined WHERE verdict = 'false' AND json_extract_string(body, '$.snapshot') IS NOT NULL""")
def evt9(t: Tables):
    return E.false_alarm_archive(t.event_log, t.reviews, F.col("recv_ts")).select(
        "id", "ts", "task", "type", "original_snapshot", "image")


@query("snk5_archive_manifest", JOINED + f"""
SELECT json_extract_string(body, '$.task') AS task, {TYPE.format('alert')} AS type, count(*) AS n
FROM joined WHERE verdict = 'false' AND json_extract_string(body, '$.snapshot') IS NOT NULL GROUP BY 1, 2""")
def snk5(t: Tables):
    path = scratch_path(t.spark, "archive")
    L.write_archive(E.false_alarm_archive(t.event_log, t.reviews, F.col("recv_ts")), path)
    back = t.spark.read.schema("id long, task string, type string").json(path)
    return back.groupBy("task", "type").agg(F.count("id").alias("n"))


NOW = 1706745600000


@query("evt10_timeline", JOINED + f"""
SELECT id, recv_ts, {TYPE.format('event')} AS type, coalesce(verdict, 'none') AS verdict FROM joined
WHERE {NOW} - recv_ts <= 2505600000 AND verdict = 'true' AND {TYPE.format('event')} = 'line_cross'
  AND json_extract_string(body, '$.task') = 'detect'""")
def evt10(t: Tables):
    rows = E.timeline_rows(t.event_log, t.reviews, NOW, 2505600000)
    return E.timeline(rows, "true", "line_cross", "detect").select("id", "recv_ts", "type", "verdict")


@query("agg5_timeline_counts", JOINED + f""",
w AS (SELECT {TYPE.format('event')} AS type, coalesce(verdict, 'none') AS verdict FROM joined WHERE {NOW} - recv_ts <= 2505600000)
SELECT 'type' AS "by", type AS value, count(*) AS n FROM w GROUP BY type
UNION ALL SELECT 'verdict', verdict, count(*) FROM w GROUP BY verdict""")
def agg5(t: Tables):
    return E.timeline_counts(E.timeline_rows(t.event_log, t.reviews, NOW, 2505600000))


FILES = """files AS (SELECT 'd' || (doc_id % 2) AS folder, doc_id,
  CASE WHEN doc_id % 5 = 0 THEN 'note_' || doc_id || '.txt' WHEN doc_id % 2 = 0 THEN 'snapshot_' || doc_id || '.jpg'
    ELSE 'clip_' || doc_id || '.avi' END AS name,
  n_chars AS size, 1704067200000 + (doc_id * 7919 % 2000) * 3600000 AS mtime FROM documents)"""


@query("evt11_retention_plan", FILES + """
SELECT folder, name, fresh AND total <= 120000 AS keep FROM (
  SELECT *, sum(CASE WHEN fresh THEN size ELSE 0 END) OVER (PARTITION BY folder ORDER BY mtime DESC, name DESC) AS total
  FROM (SELECT *, 1711267200000 - mtime <= 5184000000 AS fresh FROM files WHERE name NOT LIKE 'note%'))""")
def evt11(t: Tables):
    d, k = t.read("documents"), F.col("doc_id")
    files = d.select(
        F.concat(F.lit("d"), k % 2).alias("folder"),
        F.when(k % 5 == 0, F.concat(F.lit("note_"), k, F.lit(".txt")))
        .when(k % 2 == 0, F.concat(F.lit("snapshot_"), k, F.lit(".jpg")))
        .otherwise(F.concat(F.lit("clip_"), k, F.lit(".avi"))).alias("name"),
        F.col("n_chars").alias("size"), (F.lit(1704067200000) + (k * 7919 % 2000) * 3600000).alias("mtime"))
    return E.retention_plan(files, 1711267200000, 60, 120000).select("folder", "name", "keep")


@query("evt12_keep_last_segments", """
SELECT user_id AS source, event_id AS segment FROM events
QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY ts DESC) <= 5""")
def evt12(t: Tables):
    seg = t.read("events").select(F.col("user_id").alias("source"), F.col("event_id").alias("segment"), F.col("ts").alias("start_ts"))
    return E.last_segments(seg, 5).select("source", "segment")


@query("evt13_review_summary", BOXES + """
SELECT frame, CAST(count(*) AS INT) AS total_detections, coalesce(string_agg(det_idx, ',' ORDER BY det_idx) FILTER (score < 0.3), '') AS low
FROM boxes GROUP BY frame""")
def evt13(t: Tables):
    ids = F.array_join(F.transform("low_conf_items", lambda d: d["det_idx"].cast("string")), ",")
    return E.review_summary(nested(t), 0.3).select("frame", "total_detections", ids.alias("low"))


@query("snk4_event_log_lines", INCOMING + """
SELECT id, '{"id":' || id || ',"recv_ts":' || recv_ts || ',"body":' || body || '}' AS value FROM (
  SELECT row_number() OVER (ORDER BY recv_ts, seq) AS id, * FROM incoming WHERE seq % 7 NOT IN (1, 2, 3))""")
def snk4(t: Tables):
    return L.event_lines(E.append_events(incoming(t)))


@query("snk9_forward_with_verdict", JOINED + """
SELECT id, CASE WHEN verdict IS NULL THEN body ELSE left(body, length(body) - 1) || ',"llm":{"verdict":"' || verdict ||
  '","confidence":' || confidence || ',"reason":""}}' END AS body FROM joined WHERE coalesce(verdict, '') <> 'false'""")
def snk9(t: Tables):
    return E.forward(t.event_log, t.reviews.withColumn("reason", F.lit("")), drop_false=True)


def log_lines(t: Tables):
    """An event log as numbered lines: events, reviews, blank and broken lines."""
    ev = L.event_lines(t.event_log).select((F.col("id") * 10).alias("line_no"), F.expr(
        "case when id % 11 = 0 then '' when id % 13 = 0 then left(value, 20) else value end").alias("value"))
    rv = L.review_lines(t.reviews.withColumn("reason", F.lit("r"))).select(
        (F.col("event_id") * 10 + 15 + F.when(F.col("value").contains("manual"), 1).otherwise(0)).alias("line_no"), "value")
    return ev.unionByName(rv)


LOG = EVENT_LOG + "," + REVIEWS + """,
log AS (SELECT id * 10 AS line_no, id, NULL AS event_id, id % 13 = 0 AS bad FROM event_log WHERE id % 11 <> 0
  UNION ALL SELECT event_id * 10 + 15 + CASE WHEN source = 'manual' THEN 1 ELSE 0 END, NULL, event_id, false FROM reviews),
tail AS (SELECT * FROM log ORDER BY line_no DESC LIMIT 9000)"""


@query("src5_event_log_replay", LOG + """
SELECT e.id, e.body, count(t2.event_id) AS reviews FROM tail t JOIN event_log e ON e.id = t.id
LEFT JOIN tail t2 ON t2.event_id = e.id WHERE NOT t.bad GROUP BY e.id, e.body""")
def src5(t: Tables):
    events, reviews = L.replay(log_lines(t), 9000)
    n = reviews.groupBy(F.col("event_id").alias("id")).agg(F.count(F.lit(1)).alias("reviews"))
    return events.join(n, "id", "left").select("id", "body", F.coalesce("reviews", F.lit(0)).alias("reviews"))


@query("src5_next_id", LOG + " SELECT max(id) + 1 AS next_id FROM tail WHERE NOT bad")
def src5_next(t: Tables):
    return L.next_id(L.replay(log_lines(t), 9000)[0])


@query("win7_continue_ids", INCOMING + """
SELECT (SELECT max(event_id) + 1 FROM events) + row_number() OVER (ORDER BY recv_ts, seq) AS id, seq
FROM incoming WHERE seq % 7 NOT IN (1, 2, 3)""")
def win7(t: Tables):
    last = t.event_log.agg(F.max("id")).scalar()
    return E.append_events(incoming(t), last).select("id", "seq")


@query("sup7_last_n_ascending", EVENT_LOG + " SELECT id FROM event_log ORDER BY id DESC LIMIT 37")
def sup7(t: Tables):
    return S.last_n(t.event_log, 37, "id").select("id")


# filters and texts ---------------------------------------------------------------------

@query("flt10_event_type_match", EVENT_LOG + """
SELECT id, coalesce(json_extract_string(body, '$.rule_type') = 'intrusion', false) AS is_intrusion,
  json_extract_string(body, '$.event') = 'rule_events' AS is_rule FROM event_log""")
def flt10(t: Tables):
    b = F.col("body")
    return t.event_log.select("id", X.matches_type(b, "intrusion").alias("is_intrusion"),
                              X.matches_type(b, "rule_events").alias("is_rule"))


@query("prj7_event_type", EVENT_LOG + f"""
SELECT id, {TYPE.format('alert')} AS archive_type, {TYPE.format('event')} AS shown_type FROM event_log""")
def prj7(t: Tables):
    b = F.col("body")
    return t.event_log.select("id", X.event_type(b, "alert").alias("archive_type"), X.event_type(b, "event").alias("shown_type"))


@query("prj8_event_detail", """
SELECT event_id AS id, CASE event_id % 4
    WHEN 0 THEN 'fall@r' || user_id || '(3s)、dwell' WHEN 1 THEN 'cls0×' || (user_id % 5) || ' cls2×1'
    WHEN 2 THEN 'count=' || (event_id % 9) ELSE '' END AS detail FROM events""")
def prj8(t: Tables):
    e, k = t.read("events"), F.col("event_id")
    body = (F.when(k % 4 == 0, F.concat(F.lit('{"events":[{"type":"fall","rule":"r'), F.col("user_id"),
                                        F.lit('","detail":"3s"},{"type":"dwell"}]}')))
            .when(k % 4 == 1, F.concat(F.lit('{"total":4,"classes":[{"class":0,"count":'), F.col("user_id") % 5,
                                       F.lit('},{"class":2,"count":1}]}')))
            .when(k % 4 == 2, F.concat(F.lit('{"count":'), k % 9, F.lit("}"))).otherwise("{}"))
    return e.select(k.alias("id"), X.event_detail(body).alias("detail"))


REPLY = """replies AS (SELECT conv_id, turn, CASE (conv_id + turn) % 5
    WHEN 0 THEN text WHEN 1 THEN 'Reply ' || '{"verdict":"true","reason":"' || role || '","confidence":0.5}' || ' end'
    WHEN 2 THEN '{"verdict":"maybe"}' WHEN 3 THEN '{"verdict":"false"' ELSE '```{"verdict":"false"}```' END AS reply, text, role FROM conversations)"""


def replies(t: Tables):
    return t.read("conversations").withColumn("reply", F.expr("""case (conv_id + turn) % 5 when 0 then text
      when 1 then concat('Reply ', '{"verdict":"true","reason":"', role, '","confidence":0.5}', ' end')
      when 2 then '{"verdict":"maybe"}' when 3 then '{"verdict":"false"' else '```{"verdict":"false"}```' end"""))


@query("fn28_verdict_extract", REPLY + """
SELECT conv_id, turn, (conv_id + turn) % 5 IN (1, 4) AS ok,
  CASE (conv_id + turn) % 5 WHEN 1 THEN 'true' WHEN 4 THEN 'false' END AS verdict,
  CASE (conv_id + turn) % 5 WHEN 1 THEN role WHEN 4 THEN '' END AS reason,
  CASE (conv_id + turn) % 5 WHEN 1 THEN 0.5::DOUBLE WHEN 4 THEN 0.0 END AS confidence FROM replies""")
def fn28(t: Tables):
    return replies(t).select("conv_id", "turn", X.extract_verdict(F.col("reply")).alias("v")).select("conv_id", "turn", "v.*")


VTEXT = """vtexts AS (SELECT conv_id, turn, turn % 3 <> 2 AS ok, CASE conv_id % 6
  WHEN 0 THEN '{"verdict":"' || role || '","description":"d' || conv_id || '"}' WHEN 1 THEN '结论：疑似误报 ' || text
  WHEN 2 THEN '真实缺陷' WHEN 3 THEN '' WHEN 4 THEN '{"verdict":3}' ELSE text END AS verdict, role, text FROM conversations),
kinds AS (SELECT *, CASE conv_id % 6 WHEN 0 THEN role WHEN 1 THEN 'false_positive' WHEN 2 THEN 'real_defect'
  WHEN 3 THEN 'unparsed' WHEN 4 THEN 'text' ELSE 'text' END AS kind FROM vtexts)"""


def verdict_texts(t: Tables):
    return t.read("conversations").select("conv_id", "turn", (F.col("turn") % 3 != 2).alias("ok"), F.expr("""case conv_id % 6
      when 0 then concat('{"verdict":"', role, '","description":"d', conv_id, '"}') when 1 then concat('结论：疑似误报 ', text)
      when 2 then '真实缺陷' when 3 then '' when 4 then '{"verdict":3}' else text end""").alias("verdict"))


@query("fn29_verdict_classify", VTEXT + " SELECT conv_id, turn, kind FROM kinds")
def fn29(t: Tables):
    return verdict_texts(t).select("conv_id", "turn", X.classify_verdict(F.col("verdict")).alias("kind"))


@query("agg3_verdict_stats", VTEXT + """
SELECT ok, CASE WHEN ok THEN kind ELSE 'failed' END AS kind, count(*) AS n FROM kinds GROUP BY 1, 2""")
def agg3(t: Tables):
    return RP.verdict_stats(verdict_texts(t))


@query("sup10_recent_descriptions", VTEXT + """
SELECT conv_id * 100 + turn AS seq, CASE WHEN conv_id % 6 = 0 THEN 'd' || conv_id ELSE verdict END AS description FROM kinds
WHERE ok AND (conv_id % 6 = 0 OR verdict <> '') ORDER BY seq DESC LIMIT 10""")
def sup10(t: Tables):
    rows = RP.verdict_descriptions(verdict_texts(t)).withColumn("seq", F.col("conv_id") * 100 + F.col("turn"))
    return S.recent_texts(rows, "seq").select("seq", "description")


@query("fn30_json_object", INCOMING + " SELECT seq, seq % 7 NOT IN (1, 2, 3) AS valid FROM incoming")
def fn30(t: Tables):
    return incoming(t).select("seq", X.is_json_object(F.col("body")).alias("valid"))


@query("fn31_duration_and_speed_text", """
SELECT event_id, CAST(round_even(value, 0) AS BIGINT) || 's' AS stay, CAST(round_even(value, 0) AS BIGINT) || 'px/s' AS slow,
  format('{:.1f}km/h', value / 7.0 * 3.6) AS fast FROM events""")
def fn31(t: Tables):
    v = F.col("value")
    return t.read("events").select("event_id", X.seconds_text(v).alias("stay"), X.speed_text(v, 0).alias("slow"),
                                   X.speed_text(v, 7.0).alias("fast"))


# alerts --------------------------------------------------------------------------------

def alerts(t: Tables):
    e = t.read("events")
    return e.select(F.col("event_id").alias("id"), (F.col("user_id") % 4).alias("source"),
                    F.unix_millis(F.col("ts").cast("timestamp")).alias("ts_ms"),
                    F.expr("case event_type when 'view' then 'count' else 'near_distance' end").alias("event"),
                    F.concat(F.lit("task"), F.col("user_id") % 2).alias("task"), (F.col("event_id") % 3).alias("cls"))


def greedy_throttle(source: str, keys: str, interval: int) -> str:
    """SQL chain: each kept row points at the first row an interval later."""
    same = " AND ".join(f"c.{k.strip()} = n.{k.strip()}" for k in keys.split(","))
    return f"""
nexts AS (SELECT {keys}, ts_ms, id, min(ts_ms) OVER (PARTITION BY {keys} ORDER BY ts_ms
    RANGE BETWEEN {interval} FOLLOWING AND UNBOUNDED FOLLOWING) AS nxt,
    row_number() OVER (PARTITION BY {keys} ORDER BY ts_ms, id) AS n,
    row_number() OVER (PARTITION BY {keys}, ts_ms ORDER BY id) AS same FROM {source}),
chain AS (SELECT {keys}, ts_ms, id, nxt FROM nexts WHERE n = 1
  UNION ALL SELECT {', '.join('n.' + k.strip() for k in keys.split(','))}, n.ts_ms, n.id, n.nxt FROM chain c JOIN nexts n ON {same} AND n.ts_ms = c.nxt AND n.same = 1)"""


ALERTS = """alerts AS (SELECT event_id AS id, user_id % 4 AS source, epoch_us(ts) // 1000 AS ts_ms,
  CASE event_type WHEN 'view' THEN event_id % 3 || '' ELSE 'near_dist' END AS dedup_key, 'task' || (user_id % 2) AS task
  FROM events)"""


@query("alr1_alert_throttle", "WITH RECURSIVE " + ALERTS + "," + greedy_throttle("alerts", "source", 14400000) + " SELECT source, ts_ms, id FROM chain")
def alr1(t: Tables):
    return A.alert_throttle(alerts(t), 14400000).select("source", "ts_ms", "id")


@query("alr2_cross_stream_dedup", "WITH RECURSIVE " + ALERTS + "," + greedy_throttle("alerts", "task, dedup_key", 21600000)
       + " SELECT task, dedup_key, ts_ms, id FROM chain")
def alr2(t: Tables):
    return A.cross_stream_dedup(alerts(t), 21600000).select("task", "dedup_key", "ts_ms", "id")


@query("alr3_review_plan", "WITH RECURSIVE " + BOXES + """,
gated AS (SELECT 'cam' || source AS source, frame AS id, frame * 40 AS ts_ms FROM boxes GROUP BY source, frame HAVING min(score) < 0.05),"""
       + greedy_throttle("gated", "source", 2000) + " SELECT source, ts_ms FROM chain")
def alr3(t: Tables):
    frames = nested(t).withColumn("ts_ms", F.col("frame") * 40)
    return A.review_plan(frames, 0.05, 2000).select("source", "ts_ms")


@query("pos3_inference_throttle", "WITH RECURSIVE tr AS (SELECT user_id % 4 AS source, user_id + 1 AS track_id, epoch_us(ts) // 1000 AS ts_ms, event_id AS id FROM events),"
       + greedy_throttle("tr", "source, track_id", 43200000) + " SELECT source, track_id, ts_ms FROM chain")
def pos3(t: Tables):
    return A.inference_throttle(t.tracked.select("source", "track_id", "ts_ms"), 43200000)
