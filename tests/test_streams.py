"""Streams over several micro-batches: order, late rows and open state."""
import random

from pyspark.sql import functions as F

from framelens.operators import events as E
from framelens.operators import rules as R
from framelens.plans.throttle import throttle
from framelens.streaming import rules as SR
from framelens.streaming import stateful as S
from framelens.streaming import windows as SW

HOUR = 3_600_000


def test_live_feed_over_micro_batches(spark):
    """An event row at once, a review row for each change of verdict; the last row of each event is the batch feed's."""
    log = spark.createDataFrame([(i, i * HOUR) for i in range(1, 41)], "id long, recv_ts long").coalesce(1).cache()
    said = [(i, (i + d) * HOUR + 1, v) for i in range(2, 40, 3) for d, v in ((-1, "true"), (5, "true"), (9, "false"))]
    reviews = spark.createDataFrame([*said, (99, HOUR, "true")], "event_id long, ts long, verdict string").coalesce(1).cache()
    turns = lambda df, ts: SW.in_turns([df.where(f"{ts} >= {a} and {ts} < {a + 10 * HOUR}") for a in range(0, 50 * HOUR, 10 * HOUR)])
    stream = S.live_feed(turns(log, "recv_ts"), turns(reviews, "ts"), "12 hours", "2 days")
    out, late, batches = SW.run_counted(stream)
    rows = out.collect()
    assert batches >= 5 and late == 0
    assert sorted(r["id"] for r in rows if r["kind"] == "event") == list(range(1, 41))
    changed = sorted((r["id"], r["verdict"]) for r in rows if r["kind"] == "review")
    assert changed == sorted((i, v) for i in range(2, 40, 3) for v in ("true", "false"))
    now = {r["id"]: r["kind"] for r in E.feed(log, reviews, 0, 0).collect()}
    assert now == {i: "review" if any(c[0] == i for c in changed) else "event" for i in range(1, 41)}


def test_throttle_with_disorder_and_late_rows(spark):
    """Rows out of order within the delay give the batch result; older ones are dropped and counted."""
    r = random.Random(1)
    rows = [(i, r.choice("ab"), i * 500 + r.randrange(400)) for i in range(120)]
    schema = "id long, source string, ts_ms long"
    parts = [rows[:30], rows[40:60] + rows[30:40], rows[60:90], [(900, "a", 5), (901, "b", 1000)], rows[90:], [(999, "clock", 10 ** 7)]]
    stream = SW.in_turns([spark.createDataFrame(p, schema) for p in parts])
    out, late, _ = SW.run_counted(S.stream_throttle(stream, ["source"], 3000, ["id"], "15 seconds"))
    got = sorted(map(tuple, out.where("source <> 'clock'").collect()))
    want = throttle(spark.createDataFrame(rows, schema), ["source"], "ts_ms", 3000, ["id"])
    assert got == sorted(map(tuple, want.select("id", "source", "ts_ms").collect())) and late == 2


def test_throttle_on_tables_with_disorder_and_late_rows(spark):
    """As above, with equal rows of which one passes, rows of a null key, and a second run that goes on from the first."""
    from framelens.session import scratch_path
    r = random.Random(2)
    rows = [(i, r.choice(["a", "b", None]), i * 500 + r.randrange(400)) for i in range(120)]
    schema = "id long, source string, ts_ms long"
    late = [(900, "a", 5), (901, None, 1000)]
    parts = [rows[:30], rows[40:60] + rows[30:40], rows[:0], rows[60:90], late, rows[90:], rows[119:], [(999, "clock", 10 ** 7)]]
    stream = SW.in_turns([spark.createDataFrame(p, schema) for p in parts])
    progress, folder = scratch_path(spark, "progress"), scratch_path(spark, "kept")
    out, dropped = S.run_throttle(stream, ["source"], 3000, ["id"], 15000, progress, folder)
    got = sorted(map(tuple, out.where("source is null or source <> 'clock'").collect()), key=repr)
    want, last = [], {}
    for i, k, ts in sorted(rows, key=lambda x: (x[2], x[0])):
        if k not in last or ts - last[k] >= 3000:
            want.append((i, k, ts))
            last[k] = ts
    assert got == sorted(want, key=repr) and dropped == 2
    again, dropped = S.run_throttle(stream, ["source"], 3000, ["id"], 15000, progress, folder)
    assert again.count() == out.count() and dropped == 2


def test_throttled_rows_wait_in_tables(spark):
    """No state of the throttle queries is held by the key: their plans keep no state at all."""
    stream = SW.in_turns([spark.createDataFrame([(1, "a", 5)], "id long, source string, ts_ms long")])
    from framelens.session import scratch_path
    progress = scratch_path(spark, "progress")
    S.run_throttle(stream, ["source"], 3000, ["id"], 0, progress)
    import os
    assert os.path.isdir(f"{progress}/commits") and not os.path.exists(f"{progress}/state")


def test_turns_of_several_files_come_one_by_one(spark):
    """A turn of many partitions is one micro-batch, and so is a turn of one row."""
    parts = [spark.range(0, 100, 1, 4), spark.range(100, 101, 1, 1), spark.range(200, 300, 1, 3)]
    seen = {}
    q = SW.each_result(SW.in_turns(parts), lambda df, n: seen.update({n: sorted(r.id for r in df.collect())}), _progress(spark))
    q.awaitTermination()
    assert [seen[n] for n in sorted(seen)] == [list(range(0, 100)), [100], list(range(200, 300))]


def _progress(spark):
    from framelens.session import scratch_path
    return scratch_path(spark, "progress")


def test_sessions_closed_and_open(spark):
    rows = [(1, k, F_ts) for k in (1, 2) for F_ts in (0, 3, 4, 50, 100)] + [(1, 3, 130)]
    df = spark.createDataFrame(rows, "source int, track_id int, t int").withColumn("ts", F.timestamp_seconds("t"))
    stream = SW.in_turns([df.where("t >= 50 and t < 100"), df.where("t < 50"), df.where("t = 100"), df.where("t > 100")])
    from framelens.session import scratch_path
    path = scratch_path(spark, "progress")
    closed, late, _ = SW.run_counted(SW.presence_sessions(stream, "10 seconds", "60 seconds"), checkpoint=path)
    assert late == 0
    assert sorted(map(tuple, closed.collect())) == [(1, 1, 0, 3), (1, 1, 50000, 1), (1, 2, 0, 3), (1, 2, 50000, 1)]
    assert sorted(map(tuple, SW.open_sessions(spark, path).collect())) == [(1, 1, 100000, 1), (1, 2, 100000, 1), (1, 3, 130000, 1)]


def test_other_classes_keep_a_track_alive_between_batches(spark):
    """The last row of an accepted class lies further back than the stale limit; rows of another class join it on."""
    zone = R.Rule("zone", "intrusion", region=((0, 0), (100, 0), (100, 100), (0, 100)), classes=(0,))
    schema = "source long, ts_ms long, track_id long, cls int, confirmed boolean, left int, top int, right int, bottom int"
    row = lambda ts, track, cls: (1, ts, track, cls, True, 10, 10, 20, 20)
    frames = [row(ts, 9, 1) for ts in range(0, 6000, 100)]
    seen = [row(0, 5, 0), *[row(ts, 5, 1) for ts in range(750, 3000, 750)], row(3200, 5, 0)]
    left = [row(0, 6, 0), row(700, 6, 1), row(3100, 6, 0)]
    rows = spark.createDataFrame([*frames, *seen, *left], schema)
    cuts = [(0, 2500), (2500, 3000), (3000, 9000)]
    live, late = SR.run_rules(SW.in_turns([rows.where(f"ts_ms >= {a} and ts_ms < {b}") for a, b in cuts]), [zone], 1000, 5000)
    whole = R.rule_events(rows, [zone], rows.select("source", "ts_ms"), 1000, 5000)
    got = sorted((r.ts_ms, r.track_id) for r in live.collect())
    assert got == sorted((r.ts_ms, r.track_id) for r in whole.collect()) == [(0, 5), (0, 6), (3100, 6)] and late == 0


def test_a_micro_batch_computes_presence_once(spark, monkeypatch):
    """Events and the rows that are carried on come from one table of sightings."""
    calls, presence = [], R.presence
    monkeypatch.setattr(R, "presence", lambda *a, **k: calls.append(1) or presence(*a, **k))
    schema = "source long, ts_ms long, track_id long, cls int, confirmed boolean, left int, top int, right int, bottom int"
    rows = spark.createDataFrame([(1, 100 * i, 5, 0, True, 10, 30 * i, 20, 30 * i + 20) for i in range(4)], schema)
    line = R.Rule("gate", "line_cross", line=((0, 50), (100, 50)))
    events, carried, late = SR.step(None, rows, [line])
    assert len(calls) == 1 and late == 0
    assert [(r.ts_ms, r.track_id) for r in events.collect()] == [(200, 5)]
    assert [r.ts_ms for r in carried.where("track_id = 5").collect()] == [300]
