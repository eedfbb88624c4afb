"""Scripted scenes with known events, at once and in steps as a stream brings them."""
import random

import pytest

from framelens.operators import rules as R
from framelens.streaming import rules as L

SQUARE = ((0, 0), (100, 0), (100, 100), (0, 100))
SCHEMA = ("source int, ts_ms long, track_id long, cls int, confirmed boolean, left long, top long, right long, bottom long")


def row(ts, cx, cy, w=20, h=20, track=1, cls=0, ok=True):
    return (0, int(ts * 1000), track, cls, ok, int(cx - w / 2), int(cy - h / 2), int(cx + w / 2), int(cy + h / 2))


def run(spark, rules, rows, frames=(), **kw):
    tracked = spark.createDataFrame(rows, SCHEMA)
    times = spark.createDataFrame([(0, int(t * 1000)) for t in frames], "source int, ts_ms long") if frames else None
    got = [tuple(r) for r in R.rule_events(tracked, rules, times, **kw).select("ts_ms", "type", "rule_id", "track_id", "detail").collect()]
    return sorted((e[1], e[0] / 1000, e[4]) for e in got)


LINE = R.Rule("gate", "line_cross", line=((0, 100), (200, 100)))


def test_line_both_ways(spark):
    rows = [row(t / 10, 100, y) for t, y in enumerate([150, 50, 150, 250])]
    assert [e[2] for e in run(spark, [LINE], rows)] == ["B->A", "A->B"]


def test_line_ignores_other_class_and_unconfirmed(spark):
    rule = R.Rule("gate", "line_cross", line=LINE.line, classes=(0,))
    rows = [row(0, 100, 150, cls=2), row(.1, 100, 50, cls=2), row(0, 50, 150, track=2, ok=False), row(.1, 50, 50, track=2, ok=False)]
    assert run(spark, [rule], rows) == []


def test_direction_filter_counts_both(spark):
    rule = R.Rule("gate", "line_cross", line=LINE.line, direction="A2B")
    rows = [row(t / 10, 100, y) for t, y in enumerate([150, 50, 150])]
    assert [e[2] for e in run(spark, [rule], rows)] == ["A->B"]
    stats = R.rule_stats(spark.createDataFrame(rows, SCHEMA), [rule]).first()
    assert (stats.cross_ab, stats.cross_ba) == (1, 1)


def test_reference_point(spark):
    rows = [row(0, 100, 80, h=20), row(.1, 100, 95, h=20)]
    foot = R.Rule("foot", "line_cross", line=LINE.line, ref_point="bottom")
    assert run(spark, [LINE], rows) == [] and len(run(spark, [foot], rows)) == 1


def test_point_on_line_is_not_counted(spark):
    assert run(spark, [LINE], [row(t / 10, 100, y) for t, y in enumerate([150, 100, 50])]) == []


def test_region_life_cycle(spark):
    rules = [R.Rule("in", "intrusion", region=SQUARE), R.Rule("stay", "dwell", region=SQUARE, dwell_seconds=2),
             R.Rule("gone", "absence", region=SQUARE, absence_seconds=2)]
    rows = [row(0, 200, 50)] + [row(.1 + i * .5, 50, 50) for i in range(7)] + [row(4 + i * .5, 200, 50) for i in range(6)] + [row(7.5, 50, 50)]
    kinds = [e[0] for e in sorted(run(spark, rules, rows), key=lambda e: e[1])]
    assert kinds == ["intrusion", "dwell", "absence", "intrusion"]


def test_absence_reset_before_and_after(spark):
    # the track vanishes inside the region and comes back inside: only the reset makes it enter again
    early, late = R.Rule("early", "intrusion", region=SQUARE), R.Rule("late", "intrusion", region=SQUARE, classes=(0, 1))
    gone = R.Rule("gone", "absence", region=SQUARE, absence_seconds=1, classes=(0,))
    rows = [row(0, 50, 50), row(3.0, 50, 50)] + [row(t, 50, 50, track=2, cls=1) for t in (0, .5, 1, 1.5, 2, 2.5)]
    run(spark, [early, gone, late], rows, frames=[0, .5, 1, 1.5, 2, 2.5, 3.0])


def test_crowd_rising_edges(spark):
    rule = R.Rule("crowd", "crowd", region=SQUARE, min_count=2)
    rows = [row(t, 30 + 10 * k, 50, track=k + 1) for t, n in enumerate([1, 2, 2, 1, 2]) for k in range(n)]
    assert [e[1] for e in run(spark, [rule], rows)] == [1, 4]


def test_abandoned_once_per_anchor(spark):
    rule = R.Rule("bag", "abandoned", region=SQUARE, seconds=1)
    rows = [row(i * .5, 30, 30) for i in range(4)] + [row(2 + i * .5, 70, 70) for i in range(4)]
    assert [e[1] for e in run(spark, [rule], rows)] == [1.0, 3.0]


def test_fall_and_get_up(spark):
    rule = R.Rule("fall", "fall", fall_seconds=1, fall_aspect=1.2)
    lying = [row(t, 50, 50, w=60, h=20) for t in (0, .5, 1.1)]
    up = [row(1.5, 50, 50)]
    again = [row(t, 50, 50, w=60, h=20) for t in (2, 2.5, 3.1)]
    assert [e[2] for e in run(spark, [rule], lying + up + again)] == ["1s", "1s"]


def test_speed_and_km_per_hour(spark):
    rows = [row(i * .2, 50 + i * 40, 50) for i in range(5)]
    px = R.Rule("v", "speed", speed_limit=100, speed_seconds=.3)
    kmh = R.Rule("v", "speed", speed_limit=100, speed_seconds=.3, px_per_meter=10)
    assert [e[2] for e in run(spark, [px], rows)] == ["200px/s"]
    assert [e[2] for e in run(spark, [kmh], rows)] == ["72.0km/h"]


def test_stale_needs_a_frame_between(spark):
    rule = R.Rule("in", "intrusion", region=SQUARE)
    rows = [row(0, 50, 50), row(9, 50, 50)]
    assert len(run(spark, [rule], rows)) == 1
    assert len(run(spark, [rule], rows, frames=[0, 8, 9])) == 2


ZONE = ((20, 20), (150, 10), (160, 140), (10, 120))
AWAY = ((0, 0), (60, 0), (60, 60), (0, 60))


@pytest.mark.parametrize("seed,rules", [
    (0, [LINE, R.Rule("in", "intrusion", region=ZONE, classes=(0,)), R.Rule("gone", "absence", region=AWAY, absence_seconds=1),
         R.Rule("many", "crowd", region=ZONE, min_count=2)]),
    (1, [R.Rule("stay", "dwell", region=ZONE, dwell_seconds=1.5), R.Rule("bag", "abandoned", region=ZONE, seconds=1),
         R.Rule("fall", "fall", fall_seconds=.6), R.Rule("v", "speed", speed_limit=150, speed_seconds=.5),
         R.Rule("gone", "absence", region=AWAY, classes=(1,), absence_seconds=1)])])
def test_steps_equal_the_whole(spark, seed, rules):
    """Events of a scene at once, and in eight micro-batches with carried rows."""
    rnd = random.Random(seed)
    rows = [row(f * .3, rnd.randrange(10, 190), rnd.randrange(10, 190), w=rnd.choice([20, 60]), h=rnd.choice([20, 30]),
                track=k, cls=rnd.randrange(2), ok=rnd.random() < .8)
            for f in range(48) for k in range(1, 4) if rnd.random() < (.1 if 15 < f < 30 else .5)]
    rows += [(0, int(f * 300), *[None] * 7) for f in range(48)]
    df = spark.createDataFrame(rows, SCHEMA).cache()
    scale = {"stale_ms": 900, "chunk_ms": 4000}
    whole = R.rule_events(df.where("track_id is not null"), rules, df.select("source", "ts_ms"), **scale)
    carried, got, sizes = None, [], []
    for k in range(8):
        part = df.where(f"ts_ms >= {k * 1800} and ts_ms < {(k + 1) * 1800}")
        events, carried, late = L.step(carried, part, rules, **scale)
        got += events.collect()
        carried = spark.createDataFrame(carried.collect(), SCHEMA)
        sizes.append(carried.count())
        assert late == 0
    want = whole.collect()
    assert sorted(map(str, got)) == sorted(map(str, want)) and len(want) > 10
    if seed == 0:
        assert max(sizes) <= 3 * 2 + 3  # last rows, accepted rows, marks and frames only
    assert L.step(carried, df.where("ts_ms < 600"), rules, **scale)[2] == df.where("ts_ms < 600").count()


def test_absence_on_a_shared_region_is_refused(spark):
    with pytest.raises(ValueError, match="in"):
        L.check_rules([R.Rule("in", "intrusion", region=ZONE), R.Rule("gone", "absence", region=ZONE)])


@pytest.mark.parametrize("keep,chunk_ms", [(0.6, 3_600_000), (0.6, 7_000), (0.97, 40_000), (0.0, 3_600_000)])
def test_speed_smoothing_over_many_rows(spark, keep, chunk_ms):
    rng = random.Random(4)
    xs = [0]
    for i in range(2500):  # long stops between moves
        xs.append(xs[-1] + (rng.randint(-40, 60) if i % 900 < 350 else 0))
    tracked = spark.createDataFrame([(0, 50 * i, 1, 0, True, x, 0, x + 20, 20) for i, x in enumerate(xs)], SCHEMA)
    rows = R.lives(R.presence(tracked, None, R.STALE_MS, chunk_ms))
    got = R.speed_rows(rows, [R.Rule("v", "speed", speed_limit=100)], keep).orderBy("ts_ms").select("ema").collect()
    want, ema = [], None
    for a, b in zip(xs, xs[1:]):
        v = abs(b - a) * 20
        ema = v if ema is None else keep * ema + (1 - keep) * v
        want.append(ema)
    assert [r.ema for r in got] == pytest.approx(want, rel=1e-9, abs=1e-12)


def test_polygon_of_many_points_stays_valid(spark):
    region = ",".join(f"{i},{i * i % 97}" for i in range(1500))
    rules = spark.createDataFrame([(1, "wide", "intrusion", region), (2, "flat", "intrusion", "0,0,5,5")],
                                  "position int, id string, type string, region string")
    assert [(r.id, len(r.region)) for r in R.compile_rules(rules, "position")] == [("wide", 1500)]


def test_report_equals_the_stats_at_each_interval_end(spark):
    """Gauges of the report against ``rule_stats`` of all frames up to the end of the interval; empty intervals appear."""
    rnd = random.Random(5)
    rules = [LINE, R.Rule("many", "crowd", region=ZONE, min_count=2), R.Rule("bag", "abandoned", region=ZONE, classes=(0,), seconds=1)]
    busy = [f for f in range(40) if not 14 <= f < 24]
    rows = [row(f * .3, rnd.randrange(10, 190), rnd.randrange(10, 190), track=k, cls=rnd.randrange(2), ok=rnd.random() < .8)
            for f in busy for k in range(1, 4) if rnd.random() < .5]
    df = spark.createDataFrame(rows, SCHEMA).coalesce(2).cache()
    frames = spark.createDataFrame([(0, int(f * 300)) for f in busy], "source int, ts_ms long").coalesce(1).cache()
    scale = {"stale_ms": 900, "chunk_ms": 4000}
    got = {(r["interval_start"], r["rule_id"]): r for r in R.rule_report(df, rules, 1500, frames, **scale).collect()}
    assert len(got) == 3 * 8 and got[4500, "gate"]["cross_ab"] == 0
    totals = {"cross_ab": 0, "cross_ba": 0}
    for start in range(0, 12000, 1500):
        upto = R.rule_stats(df.where(f"ts_ms < {start + 1500}"), rules, frames.where(f"ts_ms < {start + 1500}"), **scale)
        for want in upto.collect():
            mine = got[start, want["id"]]
            assert (mine["crowd_now"], mine["abandoned_now"]) == (want["crowd_now"], want["abandoned_now"]), (start, want)
            if want["id"] == "gate":
                for c in totals:
                    totals[c] += mine[c]
                    assert totals[c] == want[c]
