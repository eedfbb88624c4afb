"""Rule queries over the tracked view. Sightings of a track lie hours apart, so the stale
limit is one day and chunks are five days long."""
from __future__ import annotations

from pyspark.sql import functions as F

from framelens.operators import rules as R
from framelens.workload.registry import query
from framelens.workload.views import FRAMES, TRACKED, Tables, big

DAY = 86_400_000
SCALE = {"stale_ms": DAY, "chunk_ms": 5 * DAY}
HALF = DAY // 2
LINE = R.Rule("gate", "line_cross", line=((0, 300), (1280, 300)))
GATE_AB = R.Rule("a2b", "line_cross", line=((0, 300), (1280, 300)), classes=(0, 1, 2), direction="A2B",
                 ref_point="bottom")
ZONE = ((200, 100), (900, 60), (1100, 500), (150, 600))
INTRUDE = R.Rule("zone_in", "intrusion", region=ZONE, classes=(0, 1, 2))
DWELL = R.Rule("zone_stay", "dwell", region=ZONE, dwell_seconds=86400.0)
CROWD = R.Rule("zone_crowd", "crowd", region=ZONE, min_count=1, classes=(1, 3))
ABSENT = R.Rule("zone_empty", "absence", region=ZONE, classes=(2, 4), absence_seconds=7200.0)
ABANDON = R.Rule("left_item", "abandoned", region=ZONE, seconds=3600.0)
FALL = R.Rule("fallen", "fall", fall_seconds=3600.0, fall_aspect=1.1)
SPEED = R.Rule("fast", "speed", speed_limit=0.01, px_per_meter=0.001, speed_seconds=7200.0)

# half-plane test: the zone is convex and winds clockwise on screen
INSIDE = """(700*(cy2-200) + 40*(cx2-400) >= 0 AND 200*(cy2-120) - 440*(cx2-1800) >= 0 AND
  -950*(cy2-1000) - 100*(cx2-2200) >= 0 AND 50*(cy2-1200) + 500*(cx2-300) >= 0)"""
ROWS = FRAMES + f""",
r AS (SELECT *, {INSIDE} AS inside FROM (
  SELECT *, "left" + "right" AS cx2, top + bottom AS cy2 FROM lived))"""

CROSS = FRAMES + """,
sides AS (
  SELECT *, "left" + "right" AS cx, top + bottom AS cy FROM rows_ WHERE confirmed AND NOT is_start),
crossed AS (
  SELECT *, (cy - 600) > 0 AS a2b FROM sides
  WHERE py <> 600 AND cy <> 600 AND (py > 600) <> (cy > 600)
    AND ((cx - px) * (0 - py + 600) + (cy - py) * px > 0)
     <> ((cx - px) * (600 - py) - (cy - py) * (2560 - px) > 0))"""


@query("rul1_line_cross", CROSS + """
SELECT source, 'gate' AS rule_id, CAST(count(*) FILTER (a2b) AS BIGINT) AS cross_ab,
  CAST(count(*) FILTER (NOT a2b) AS BIGINT) AS cross_ba FROM crossed GROUP BY source""")
def rul1(t: Tables):
    rows = R.presence(t.tracked, **SCALE)
    return R.crossing_counts(R.line_crossings(rows, [LINE]), "source")


def _ok(where: str = "true", source: str = "r") -> str:
    """Rows a rule accepts, with its previous accepted row."""
    return f"""
ok AS (SELECT *, lag(inside) OVER w AS pin, lag(ts_ms) OVER w AS pts FROM {source} WHERE {where}
  WINDOW w AS (PARTITION BY source, track_id ORDER BY ts_ms)),
held AS (SELECT *, coalesce(pin AND pts >= life, false) AS was FROM ok)"""


def _first_after(limit_ms: int) -> str:
    """First row of each stretch of `inside` rows that comes `limit_ms` after its start."""
    return f"""
runs AS (SELECT *, sum(CASE WHEN was AND inside THEN 0 ELSE 1 END)
    OVER (PARTITION BY source, track_id ORDER BY ts_ms ROWS UNBOUNDED PRECEDING) AS g FROM held),
began AS (SELECT *, min(ts_ms) OVER (PARTITION BY source, track_id, g) AS t0 FROM runs WHERE inside),
late AS (SELECT *, row_number() OVER (PARTITION BY source, track_id, g ORDER BY ts_ms) AS nth
  FROM began WHERE ts_ms - t0 >= {limit_ms})"""


SECONDS = "CAST(round_even({0} / 1000.0, 0) AS BIGINT) || 's'"


def _out(df):
    return df.select("source", "ts_ms", "rule_id", big(F.col("track_id")).alias("track_id"),
                     F.col("cls").cast("int").alias("cls"), "detail")


def _rows(t: Tables):
    return R.lives(R.presence(t.tracked, **SCALE))


@query("rul0_rule_table", """
WITH raw AS (SELECT s_suppkey, s_suppkey + 1 AS position,
    CASE WHEN s_suppkey % 4 = 0 THEN '' ELSE 'r' || s_suppkey END AS id,
    ['line_cross','intrusion','dwell','absence','crowd','abandoned','fall','speed','other'][s_suppkey % 9 + 1] AS type,
    ['5,10;200,' || s_suppkey, '1,2,3', 'a5,-6, 7;8,9'][s_suppkey % 3 + 1] AS line,
    ['0,0,' || s_suppkey || ',0,9,9', '0,0,5,5', ''][s_suppkey % 5 % 3 + 1] AS region,
    ['both','A2B','B2A','up',''][s_suppkey % 5 + 1] AS direction, s_acctbal AS acct FROM supplier),
parsed AS (SELECT *,
    list_transform(list_filter(string_split_regex(regexp_replace(line, '[^0-9,;-]', '', 'g'), '[,;]'), lambda x: x <> ''), lambda x: CAST(x AS INT)) AS l,
    list_transform(list_filter(string_split_regex(regexp_replace(region, '[^0-9,;-]', '', 'g'), '[,;]'), lambda x: x <> ''), lambda x: CAST(x AS INT)) AS r FROM raw)
SELECT position, CASE WHEN id = '' THEN 'rule' || position ELSE id END AS id, type,
  CAST(len(l) // 2 AS INT) AS line_points, CAST(len(r) // 2 AS INT) AS region_points,
  CASE WHEN direction IN ('A2B', 'B2A') THEN direction ELSE 'both' END AS direction,
  CASE WHEN acct > 0 THEN acct ELSE 10.0 END AS dwell_seconds,
  CASE WHEN type = 'line_cross' THEN len(l) // 2 = 2
    WHEN type IN ('intrusion','dwell','absence','crowd','abandoned') THEN len(r) // 2 >= 3
    WHEN type = 'fall' THEN region = '' OR len(r) // 2 >= 3
    WHEN type = 'speed' THEN acct > 0 AND (region = '' OR len(r) // 2 >= 3) ELSE false END AS valid
FROM parsed""")
def rul0(t: Tables):
    k = F.col("s_suppkey")

    def pick(expr, *values):
        return F.element_at(F.array(*[F.lit(v) if isinstance(v, str) else v for v in values]),
                            (expr + 1).cast("int"))
    raw = t.read("supplier").select(
        (k + 1).alias("position"), F.when(k % 4 == 0, "").otherwise(F.concat(F.lit("r"), k)).alias("id"),
        pick(k % 9, *R.RULE_TYPES, "other").alias("type"),
        pick(k % 3, F.concat(F.lit("5,10;200,"), k), "1,2,3", "a5,-6, 7;8,9").alias("line"),
        pick(k % 5 % 3, F.concat(F.lit("0,0,"), k, F.lit(",0,9,9")), "0,0,5,5", "").alias("region"),
        pick(k % 5, "both", "A2B", "B2A", "up", "").alias("direction"),
        F.col("s_acctbal").alias("dwell_seconds"), F.col("s_acctbal").alias("speed_limit"))
    return R.normalise_rules(raw, "position").select(
        "position", "id", "type", F.floor(F.size("line") / 2).cast("int").alias("line_points"),
        F.floor(F.size("region") / 2).cast("int").alias("region_points"), "direction",
        "dwell_seconds", "valid")


@query("rul1_directed_bottom", FRAMES + """,
m AS (SELECT *, "left" + "right" AS cx, 2 * bottom AS cy FROM rows_ WHERE confirmed AND NOT is_start AND cls IN (0, 1, 2))
SELECT source, ts_ms, 'a2b' AS rule_id, track_id, cls, 'A->B' AS detail FROM m
WHERE pb < 600 AND cy > 600
  AND ((cx - px) * (600 - pb) - (cy - pb) * (0 - px) > 0) <> ((cx - px) * (600 - pb) - (cy - pb) * (2560 - px) > 0)""")
def rul1_directed(t: Tables):
    rows = R.presence(t.tracked, **SCALE)
    return _out(R.line_crossings(rows, [GATE_AB]).where("reported"))


@query("rul2_intrusion", ROWS + "," + _ok("cls IN (0, 1, 2)") + """
SELECT source, ts_ms, 'zone_in' AS rule_id, track_id, cls, '' AS detail FROM held
WHERE confirmed AND inside AND NOT was""")
def rul2(t: Tables):
    return _out(R.intrusion_events(R.region_rows(_rows(t), [INTRUDE], [(0, INTRUDE)], None)))


@query("rul3_dwell", ROWS + "," + _ok() + "," + _first_after(86400000) + f"""
SELECT source, ts_ms, 'zone_stay' AS rule_id, track_id, cls, {SECONDS.format('(ts_ms - t0)')} AS detail
FROM late WHERE nth = 1""")
def rul3(t: Tables):
    return _out(R.dwell_events(R.region_rows(_rows(t), [DWELL], [(0, DWELL)], None), [DWELL]))


ABSENT_SQL = """,
occ AS (SELECT f.source, f.ts_ms, coalesce(bool_or(r.inside AND r.cls IN (2, 4)), false) AS occupied
  FROM frames f LEFT JOIN r ON r.source = f.source AND r.ts_ms = f.ts_ms GROUP BY ALL),
spans AS (SELECT *, sum(CASE WHEN occupied THEN 1 ELSE 0 END)
    OVER (PARTITION BY source ORDER BY ts_ms ROWS UNBOUNDED PRECEDING) AS g FROM occ),
empties AS (SELECT *, min(ts_ms) OVER (PARTITION BY source, g) AS t0 FROM spans WHERE NOT occupied AND g > 0),
absent AS (SELECT source, ts_ms, t0 FROM empties WHERE ts_ms - t0 >= 7200000
  QUALIFY row_number() OVER (PARTITION BY source, g ORDER BY ts_ms) = 1)"""


@query("rul4_absence", ROWS + ABSENT_SQL + f"""
SELECT source, ts_ms, 'zone_empty' AS rule_id, {SECONDS.format('(ts_ms - t0)')} AS detail FROM absent""")
def rul4(t: Tables):
    tracked = t.tracked
    return R.absence_events(R.presence(tracked, **SCALE), R.timeline(tracked, None, SCALE["chunk_ms"]),
                            [ABSENT]).select("source", "ts_ms", "rule_id", "detail")


@query("rul4_absence_resets_regions", ROWS + ABSENT_SQL + "," + _ok("cls IN (0, 1, 2)") + """,
cut AS (SELECT h.*, EXISTS (SELECT 1 FROM absent a WHERE a.source = h.source AND a.ts_ms >= h.pts
    AND a.ts_ms < h.ts_ms) AS cleared FROM held h)
SELECT source, ts_ms, 'zone_in' AS rule_id, track_id, cls, '' AS detail FROM cut
WHERE confirmed AND inside AND NOT (was AND NOT cleared)
UNION ALL
SELECT source, ts_ms, 'zone_empty', 0, -1, CAST(round_even((ts_ms - t0) / 1000.0, 0) AS BIGINT) || 's' FROM absent""")
def rul4_reset(t: Tables):
    # the intrusion rule comes before the absence rule, so it sees the reset one frame later
    return _out(R.rule_events(t.tracked, [INTRUDE, ABSENT], **SCALE))


@query("rul5_crowd", ROWS + """,
n AS (SELECT f.source, f.ts_ms, count(*) FILTER (r.inside AND r.confirmed AND r.cls IN (1, 3)) AS n
  FROM frames f LEFT JOIN r ON r.source = f.source AND r.ts_ms = f.ts_ms GROUP BY ALL)
SELECT source, ts_ms, 'zone_crowd' AS rule_id, n || '人' AS detail FROM (
  SELECT *, lag(n) OVER (PARTITION BY source ORDER BY ts_ms) AS before FROM n)
WHERE n >= 1 AND coalesce(before, 0) < 1""")
def rul5(t: Tables):
    tracked = t.tracked
    return R.crowd_events(R.presence(tracked, **SCALE), R.timeline(tracked, None, SCALE["chunk_ms"]),
                          [CROWD]).select("source", "ts_ms", "rule_id", "detail")


@query("rul6_abandoned", "WITH RECURSIVE " + ROWS + """,
p AS (SELECT *, cx2 / 2.0 AS x, cy2 / 2.0 AS y, greatest(8.0, 0.1 * sqrt(w * w + h * h)) AS reach,
    row_number() OVER (PARTITION BY source, track_id, life ORDER BY ts_ms) AS n FROM r WHERE confirmed AND inside),
walk AS (
  SELECT source, track_id, life, n, ts_ms, cls, x AS ax, y AS ay, ts_ms AS since, false AS fired, false AS hit
  FROM p WHERE n = 1
  UNION ALL
  SELECT p.source, p.track_id, p.life, p.n, p.ts_ms, p.cls,
    CASE WHEN away THEN p.x ELSE ax END, CASE WHEN away THEN p.y ELSE ay END,
    CASE WHEN away THEN p.ts_ms ELSE since END,
    CASE WHEN away THEN false ELSE fired OR p.ts_ms - since >= 3600000 END,
    NOT away AND NOT fired AND p.ts_ms - since >= 3600000
  FROM (SELECT w.*, sqrt((p.x - ax) * (p.x - ax) + (p.y - ay) * (p.y - ay)) > p.reach AS away FROM walk w
        JOIN p ON p.source = w.source AND p.track_id = w.track_id AND p.life = w.life AND p.n = w.n + 1) w
  JOIN p ON p.source = w.source AND p.track_id = w.track_id AND p.life = w.life AND p.n = w.n + 1)
""" + f"""SELECT source, ts_ms, 'left_item' AS rule_id, track_id, cls,
  {SECONDS.format('(ts_ms - since)')} AS detail FROM walk WHERE hit""")
def rul6(t: Tables):
    return _out(R.abandoned_events(_rows(t), [ABANDON]))


@query("rul7_fall", FRAMES + ", r AS (SELECT *, h > 1 AND w / h >= 1.1 AS inside FROM lived)," + _ok("confirmed")
       + "," + _first_after(3600000) + f"""
SELECT source, ts_ms, 'fallen' AS rule_id, track_id, cls, {SECONDS.format('(ts_ms - t0)')} AS detail
FROM late WHERE nth = 1""")
def rul7(t: Tables):
    return _out(R.fall_events(_rows(t), [FALL]))


EMA_SQL = "WITH RECURSIVE " + FRAMES + """,
v AS (SELECT *, row_number() OVER (PARTITION BY source, track_id, life ORDER BY ts_ms) AS n FROM (
  SELECT *, sqrt(pow("left" + "right" - px, 2) + pow(top + bottom - py, 2)) / 2 * 1000.0 / (ts_ms - prev_ts) AS v
  FROM lived WHERE confirmed AND NOT is_start AND ts_ms - prev_ts > 1)),
ema AS (
  SELECT source, track_id, life, n, ts_ms, cls, v AS ema FROM v WHERE n = 1
  UNION ALL
  SELECT v.source, v.track_id, v.life, v.n, v.ts_ms, v.cls, 0.4 * v.v + 0.6 * e.ema
  FROM ema e JOIN v ON v.source = e.source AND v.track_id = e.track_id AND v.life = e.life AND v.n = e.n + 1)"""


@query("rul8_speed", EMA_SQL + ", r AS (SELECT *, ema >= 0.01 AS inside FROM ema)," + _ok() + ","
       + _first_after(7200000) + """
SELECT source, ts_ms, 'fast' AS rule_id, track_id, cls, format('{:.1f}km/h', ema / 0.001 * 3.6) AS detail
FROM late WHERE nth = 1""")
def rul8(t: Tables):
    return _out(R.speed_events(_rows(t), [SPEED]))


@query("rul8_speed_values", EMA_SQL + """
SELECT source, track_id, ts_ms, round(ema * 1000000) / 1000000 AS ema FROM ema""")
def rul8_values(t: Tables):
    return R.speed_rows(_rows(t), [SPEED]).select(
        "source", "track_id", "ts_ms", (F.round(F.col("ema") * 1000000) / 1000000).alias("ema"))


@query("rul9_rule_stats", CROSS + f""",
r AS (SELECT *, {INSIDE} AS inside FROM (SELECT *, "left" + "right" AS cx2, top + bottom AS cy2 FROM lived)),
last AS (SELECT source, max(ts_ms) AS last_ts, arg_max(prev_frame_ts, ts_ms) AS before FROM frames GROUP BY source),
crowd AS (SELECT l.source, count(*) FILTER (r.inside AND r.confirmed AND r.cls IN (1, 3)) AS n
  FROM last l LEFT JOIN r ON r.source = l.source AND r.ts_ms = l.last_ts GROUP BY l.source),
ends AS (SELECT source, track_id, life, arg_max(inside, ts_ms) AS inside, bool_or(inside AND confirmed) AS anchored,
    max(ts_ms) AS seen, max(max(life)) OVER (PARTITION BY source, track_id) AS life_now FROM r GROUP BY source, track_id, life),
held AS (SELECT l.source, count(*) FILTER (e.inside AND e.anchored AND e.life = e.life_now
    AND (seen = last_ts OR before - seen <= 86400000)) AS n FROM last l LEFT JOIN ends e USING (source) GROUP BY l.source)
SELECT l.source, id, type,
  CAST(CASE WHEN id = 'gate' THEN (SELECT count(*) FROM crossed c WHERE c.source = l.source AND a2b) ELSE 0 END AS BIGINT) AS cross_ab,
  CAST(CASE WHEN id = 'gate' THEN (SELECT count(*) FROM crossed c WHERE c.source = l.source AND NOT a2b) ELSE 0 END AS BIGINT) AS cross_ba,
  CAST(CASE WHEN id = 'zone_crowd' THEN crowd.n ELSE 0 END AS BIGINT) AS crowd_now,
  CAST(CASE WHEN id = 'left_item' THEN held.n ELSE 0 END AS BIGINT) AS abandoned_now
FROM last l JOIN crowd USING (source) JOIN held USING (source),
  (VALUES ('gate', 'line_cross'), ('zone_crowd', 'crowd'), ('left_item', 'abandoned')) v(id, type)""")
def rul9(t: Tables):
    return R.rule_stats(t.tracked, [LINE, CROWD, ABANDON], **SCALE)


@query("rul10_periodic_report", CROSS + """
SELECT source, ts_ms // 86400000 * 86400000 AS interval_start, 'gate' AS rule_id,
  CAST(count(*) FILTER (a2b) AS BIGINT) AS cross_ab, CAST(count(*) FILTER (NOT a2b) AS BIGINT) AS cross_ba
FROM crossed GROUP BY ALL""")
def rul10(t: Tables):
    return R.periodic_report(R.line_crossings(R.presence(t.tracked, **SCALE), [LINE]), DAY)


@query("rul10_full_report", CROSS + f""",
r AS (SELECT *, {INSIDE} AS inside FROM (SELECT *, "left" + "right" AS cx2, top + bottom AS cy2 FROM lived)),
fs AS (SELECT source, ts_ms // {HALF} AS slot, max(ts_ms) AS last_ts, arg_max(prev_frame_ts, ts_ms) AS before FROM frames GROUP BY ALL),
span AS (SELECT source, unnest(range(min(slot), max(slot) + 1)) AS slot FROM fs GROUP BY source),
-- the last frame at or before the end of each interval
upto AS (SELECT s.source, s.slot, max_by(f.last_ts, f.slot) AS last_ts, max_by(f.before, f.slot) AS before
  FROM span s JOIN fs f ON f.source = s.source AND f.slot <= s.slot GROUP BY ALL),
crowd AS (SELECT a.source, a.slot, count(*) FILTER (r.inside AND r.confirmed AND r.cls IN (1, 3)) AS n
  FROM upto a LEFT JOIN r ON r.source = a.source AND r.ts_ms = a.last_ts GROUP BY ALL),
seen_now AS (SELECT a.source, a.slot, r.track_id, a.last_ts, a.before, max(r.ts_ms) AS seen, max(r.life) AS life_now, arg_max(r.inside, r.ts_ms) AS inside
  FROM upto a JOIN r ON r.source = a.source AND r.ts_ms <= a.last_ts GROUP BY ALL),
held AS (SELECT n.source, n.slot, count(*) AS n FROM seen_now n WHERE inside AND (seen = last_ts OR before - seen <= 86400000)
  AND EXISTS (SELECT 1 FROM r WHERE r.source = n.source AND r.track_id = n.track_id AND r.life = n.life_now AND r.ts_ms <= n.last_ts
    AND r.inside AND r.confirmed) GROUP BY ALL)
SELECT a.source, a.slot * {HALF} AS interval_start, id AS rule_id, type,
  CAST(CASE WHEN id = 'gate' THEN (SELECT count(*) FROM crossed c WHERE c.source = a.source AND c.ts_ms // {HALF} = a.slot AND a2b) ELSE 0 END AS BIGINT) AS cross_ab,
  CAST(CASE WHEN id = 'gate' THEN (SELECT count(*) FROM crossed c WHERE c.source = a.source AND c.ts_ms // {HALF} = a.slot AND NOT a2b) ELSE 0 END AS BIGINT) AS cross_ba,
  CAST(CASE WHEN id = 'zone_crowd' THEN crowd.n ELSE 0 END AS BIGINT) AS crowd_now,
  CAST(CASE WHEN id = 'left_item' THEN coalesce(held.n, 0) ELSE 0 END AS BIGINT) AS abandoned_now
FROM upto a JOIN crowd USING (source, slot) LEFT JOIN held USING (source, slot),
  (VALUES ('gate', 'line_cross'), ('zone_crowd', 'crowd'), ('left_item', 'abandoned')) v(id, type)""")
def rul10_full(t: Tables):
    return R.rule_report(t.tracked, [LINE, CROWD, ABANDON], HALF, **SCALE)


MID = 1705276800000  # 2024-01-15 00:00 UTC


@query("rul11_counter_carry_over", CROSS.replace("user_id + 1 AS track_id",
       f"user_id + 1 + 1000000 * (epoch_us(ts) // 1000 // {MID}) AS track_id") + """
SELECT source, 'gate' AS id, 'line_cross' AS type, CAST(count(*) FILTER (a2b) AS BIGINT) AS cross_ab,
  CAST(count(*) FILTER (NOT a2b) AS BIGINT) AS cross_ba FROM crossed GROUP BY source""")
def rul11(t: Tables):
    # totals of the first half are stored, the second half starts without track memory
    early, late = t.tracked.where(F.col("ts_ms") < MID), t.tracked.where(F.col("ts_ms") >= MID)
    old = (R.crossing_counts(R.line_crossings(R.presence(early, **SCALE), [LINE]), "source")
           .withColumnRenamed("rule_id", "id").withColumn("type", F.lit("line_cross")))
    return R.rule_stats(late, [LINE], **SCALE, carried=old).select(
        "source", "id", "type", "cross_ab", "cross_ba")


@query("rul12_rule_hints", CROSS + """
SELECT source, ts_ms, track_id, CASE WHEN a2b THEN 'A->B' ELSE 'B->A' END AS detail,
  'check the gate' AS hint FROM crossed""")
def rul12(t: Tables):
    rule = R.Rule("gate", "line_cross", line=LINE.line, hint="check the gate")
    events = _out(R.line_crossings(R.presence(t.tracked, **SCALE), [rule]))
    return R.with_hints(events, [rule]).select("source", "ts_ms", "track_id", "detail", "hint")


@query("agg8_line_counters", CROSS + """
SELECT source, track_id, 'gate' AS rule_id, CAST(count(*) FILTER (a2b) AS BIGINT) AS cross_ab,
  CAST(count(*) FILTER (NOT a2b) AS BIGINT) AS cross_ba FROM crossed GROUP BY ALL""")
def agg8(t: Tables):
    rows = R.presence(t.tracked, **SCALE)
    return R.crossing_counts(R.line_crossings(rows, [LINE]), "source", "track_id")


@query("set2_rule_event_union", ROWS + ABSENT_SQL + """
, crossing AS (SELECT * FROM rows_ WHERE confirmed AND NOT is_start AND py <> 600 AND top + bottom <> 600
    AND (py > 600) <> (top + bottom > 600)
    AND (("left" + "right" - px) * (600 - py) + (top + bottom - py) * px > 0)
     <> (("left" + "right" - px) * (600 - py) - (top + bottom - py) * (2560 - px) > 0)),
n AS (SELECT f.source, f.ts_ms, count(*) FILTER (r.inside AND r.confirmed AND r.cls IN (1, 3)) AS n
  FROM frames f LEFT JOIN r ON r.source = f.source AND r.ts_ms = f.ts_ms GROUP BY ALL)
SELECT source, type, CAST(count(*) AS BIGINT) AS n FROM (
  SELECT source, 'line_cross' AS type FROM crossing
  UNION ALL SELECT source, 'absence' FROM absent
  UNION ALL SELECT source, 'crowd' FROM (SELECT *, lag(n) OVER (PARTITION BY source ORDER BY ts_ms) AS before FROM n)
    WHERE n >= 1 AND coalesce(before, 0) < 1) GROUP BY ALL""")
def set2(t: Tables):
    events = R.rule_events(t.tracked, [LINE, ABSENT, CROWD], **SCALE)
    return events.groupBy("source", "type").agg(F.count(F.lit(1)).alias("n"))


@query("win1_previous_position", FRAMES + """
SELECT source, track_id, ts_ms, prev_ts, px, py FROM seen""")
def win1(t: Tables):
    return R.presence(t.tracked, **SCALE).select(
        "source", "track_id", "ts_ms", "prev_ts", (F.col("prev_left") + F.col("prev_right")).alias("px"),
        (F.col("prev_top") + F.col("prev_bottom")).alias("py"))


@query("win2_stale_break", FRAMES + """
SELECT source, track_id, CAST(count(*) AS BIGINT) AS sightings,
  CAST(count(*) FILTER (is_start) AS BIGINT) AS starts FROM rows_ GROUP BY ALL""")
def win2(t: Tables):
    return R.presence(t.tracked, **SCALE).groupBy("source", "track_id").agg(
        F.count(F.lit(1)).alias("sightings"), F.count_if("is_start").alias("starts"))


@query("win3_visit_ids", ROWS + "," + _ok() + """
SELECT source, track_id, ts_ms, CAST(sum(CASE WHEN inside AND NOT was THEN 1 ELSE 0 END)
  OVER (PARTITION BY source, track_id ORDER BY ts_ms ROWS UNBOUNDED PRECEDING) AS BIGINT) AS visit
FROM held""")
def win3(t: Tables):
    from framelens.plans.chunked import running
    items = R.region_rows(_rows(t), [DWELL], [(0, DWELL)], None)
    start = (F.col("inside") & ~F.col("was_inside")).cast("long")
    return running(items, ["source", "track_id"], ["ts_ms"], {"visit": ("sum", start)}).select(
        "source", "track_id", "ts_ms", "visit")


@query("jn11_rules_by_rows", TRACKED + """
SELECT rule_id, count(*) AS n FROM (
  SELECT 'zone_in' AS rule_id FROM tracked WHERE cls IN (0, 1, 2) UNION ALL SELECT 'zone_empty' FROM tracked WHERE cls IN (2, 4)
  UNION ALL SELECT 'zone_stay' FROM tracked) GROUP BY rule_id""")
def jn11(t: Tables):
    return R.rules_by_rows(t.tracked, [INTRUDE, ABSENT, DWELL]).groupBy("rule_id").agg(F.count(F.lit(1)).alias("n"))
