"""Chunked helpers against plain loops, for keys that span many chunks."""
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from framelens.plans.chunked import CHUNK, even_chunks, previous, running, with_chunk
from framelens.plans.numbering import global_row_number, last_rows
from framelens.plans.throttle import _exits, throttle


def data(spark, n=300):
    rnd = random.Random(1)
    return sorted({(rnd.choice("aab"), rnd.randrange(2000)) for _ in range(n)})


def test_previous_and_running(spark):
    rows = data(spark)
    df = with_chunk(spark.createDataFrame(rows, "k string, ts long"), "ts", 100)
    df = previous(df, ["k"], ["ts"], {"before": "ts"})
    got = {(r.k, r.ts): (r.before, r.total) for r in running(df, ["k"], ["ts"], {"total": ("sum", F.col("ts"))}).collect()}
    last, total = {}, {}
    for k, ts in rows:
        total[k] = total.get(k, 0) + ts
        assert got[(k, ts)] == (last.get(k), total[k])
        last[k] = ts


def test_throttle_equals_loop(spark):
    rows = data(spark)
    for interval, chunk in ((7, 50), (40, 40), (300, 1000)):
        kept, last = set(), {}
        for k, ts in rows:
            if k not in last or ts - last[k] >= interval:
                kept.add((k, ts))
                last[k] = ts
        got = throttle(spark.createDataFrame(rows, "k string, ts long"), ["k"], "ts", interval, chunk_length=chunk)
        assert {tuple(r) for r in got.collect()} == kept


def test_global_row_number(spark):
    df = spark.range(1000).select((F.col("id") * 7919 % 1000).alias("v"))
    rows = global_row_number(df, ["v"], "n", 5).collect()
    assert all(r.n == r.v + 5 for r in rows)


def test_throttle_of_even_rows(spark):
    # evenly spaced rows: tables stay as long as one interval, and chunks still join up
    ts = np.arange(0, 33 * 9000, 33)
    assert len(_exits(ts, 2000)) <= 62
    df = spark.createDataFrame([(1, int(t)) for t in ts], "k int, ts long")
    got = [r.ts for r in throttle(df, ["k"], "ts", 2000, chunk_length=30_000).orderBy("ts").collect()]
    want, last = [], None
    for t in ts:
        if last is None or t - last >= 2000:
            want.append(int(t))
            last = t
    assert got == want


@pytest.mark.parametrize("width", [2, 3, 256])
def test_throttle_levels_equal_loop(spark, monkeypatch, width):
    """Many sparse chunks: tables compose over several levels, chains may pass whole chunks."""
    from framelens.plans import throttle as module
    monkeypatch.setattr(module, "WIDTH", width)
    r = random.Random(width)
    times = sorted({r.randrange(0, 30_000) if r.random() < .5 else r.randrange(12_000, 12_600) for _ in range(700)})
    rows = [(k, t) for k in (1, 2) for t in times if k == 1 or t % 3]
    df = spark.createDataFrame(rows, "k int, ts long")
    for interval, length in ((70, 100), (500, 120)):
        got = {(x["k"], x["ts"]) for x in module.throttle(df, ["k"], "ts", interval, chunk_length=length).collect()}
        want, last = set(), {}
        for k, t in rows:
            if k not in last or t - last[k] >= interval:
                want.add((k, t))
                last[k] = t
        assert got == want


@pytest.mark.parametrize("n", [0, 1, 7, 150, 199, 200, 900])
def test_last_rows_equal_a_sort(spark, n):
    r = random.Random(n)
    values = r.sample(range(-10 ** 9, 10 ** 12), 199)
    df = spark.createDataFrame([(v, "x") for v in values] + [(None, "x")], "at long, t string").repartition(3)
    got = [x["at"] for x in last_rows(df, "at", n, buckets=16).collect()]
    assert sorted(got, key=lambda v: (v is None, v)) == sorted(
        sorted(values + [None], key=lambda v: (v is not None, v))[200 - min(n, 200):], key=lambda v: (v is None, v))


def test_lower_medians_equal_a_sort(spark):
    """Several rounds, ties that fill whole parts, nulls, one-row groups."""
    from framelens.plans.selection import lower_medians
    r = random.Random(9)
    rows = [(k, r.choice([0.0, 0.0, r.gauss(0, 1), r.gauss(5, 1e6)]) if k else r.random(), None if r.random() < .1 else float(r.randrange(3)))
            for k in (0, 1, 2) for _ in range(700)] + [(3, 1.5, None), (4, -2.0, 7.0)]
    df = spark.createDataFrame(rows, "k int, a double, b double").repartition(3)
    got = {x["k"]: (x["a"], x["b"]) for x in lower_medians(df, ["k"], ["a", "b"], few=3).collect()}
    middle = lambda v: sorted(v)[(len(v) - 1) // 2] if v else None
    assert got == {k: tuple(middle([x[c] for x in rows if x[0] == k and x[c] is not None]) for c in (1, 2)) for k in range(5)}


def test_even_chunks_cut_one_score(spark):
    # one class holds most rows, and nine tenths of them share one score
    rows = [("b" if i % 50 == 0 else "a", 0.5 if i % 10 else (i % 97) / 97, i) for i in range(40_000)]
    df = spark.createDataFrame(rows, "k string, score double, i long").repartition(16)
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        ranged = even_chunks(df, ["k", F.desc("score"), "i"])
        sizes = sorted(r["count"] for r in ranged.groupBy(CHUNK).count().collect())
        # the tasks that run the window are these ranges
        tasks = sorted(r["n"] for r in ranged.groupBy(F.spark_partition_id().alias("p")).agg(F.count("*").alias("n")).collect())
        out = running(ranged, ["k"], [F.desc("score"), "i"], {"n": ("sum", F.lit(1))})
        got = {r.i: r.n for r in out.collect()}
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    assert len(sizes) > 2 and sizes[-1] <= 2 * sizes[len(sizes) // 2]
    assert tasks == sizes
    for k in "ab":
        order = sorted((r for r in rows if r[0] == k), key=lambda r: (-r[1], r[2]))
        assert [got[r[2]] for r in order] == list(range(1, len(order) + 1))


def test_clip_spans_count_what_clip_frames_lists(spark):
    from framelens.operators import sampling as SA
    ev = spark.range(80).selectExpr("id", "if(id = 5, null, id % 3) source", "id * id % 97 * 50 ts_ms")
    fr = ev.select("source", (F.col("ts_ms") + F.col("id") % 2 * 25).alias("ts_ms")).distinct().where("ts_ms > 900")
    listed = SA.clip_frames(ev, fr, 700, 1000.0).groupBy("id").agg(F.count(F.lit(1)).alias("frames"), F.min("ts_ms").alias("first_ts"))
    got = SA.clip_spans(ev, fr, 700)
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, listed.select(*got.columns).collect())) and 0 < got.count() < 79


def test_medians_send_no_large_group_to_one_task(spark):
    from framelens.plans.selection import lower_medians
    df = spark.range(6000).selectExpr("if(id = 0, null, if(id % 100 < 98, 1, id % 3 + 2)) k", "id * 7919 % 6007 / 3 a", "id % 5 b")
    got = lower_medians(df, ["k"], ["a", "b"], few=500)
    want = {}
    for r in df.where("k is not null").collect():
        want.setdefault(r["k"], ([], []))[0].append(r["a"])
        want[r["k"]][1].append(r["b"])
    assert {r["k"]: (r["a"], r["b"]) for r in got.collect()} == {
        k: tuple(float(sorted(v)[(len(v) - 1) // 2]) for v in both) for k, both in want.items()}
    plan = got._jdf.queryExecution().sparkPlan().toString()
    assert "BroadcastHashJoin" in plan and "SortMergeJoin" not in plan


def test_ordered_pass_takes_many_keys_at_once(spark):
    """A slice of rows is one step, however many keys it holds, and a key goes on in the next slice."""
    from framelens.plans.sequential import ordered_pass

    def start():
        n = 0

        def step(rows, begins):
            nonlocal n
            out = []
            for begin in begins.tolist():
                n = 1 if begin else n + 1
                out.append(n)
            return rows.assign(n=out, rows=len(rows))
        return step
    rows = [(k, t) for k in range(50) for t in range(1 + k % 4)] + [(99, t) for t in range(30)]
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", 7)
    try:
        got = ordered_pass(spark.createDataFrame(rows, "k long, t long"), ["k"], ["t"],
                           "k long, t long, n long, rows long", start).collect()
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    assert sorted((r.k, r.t) for r in got) == sorted(rows)
    assert all(r.n == r.t + 1 for r in got) and max(r.rows for r in got) == 7
