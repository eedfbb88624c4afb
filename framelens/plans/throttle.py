"""Exact greedy throttle: keep a row when at least ``interval`` passed since the last kept one.

The rule is sequential, yet the next kept row depends only on the current one. So each
chunk of a key can say beforehand where a chain that enters it at any time would leave it.
Those small tables compose: the tables of up to ``WIDTH`` neighbouring chunks make one table of the same
kind, level by level, until a key has ``WIDTH`` of them at most. Entry times then go down the
same levels, and each chunk is replayed on its own. No task ever holds more than one chunk of a
key, or ``WIDTH`` tables.
"""
from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from framelens.plans.chunked import CHUNK, with_chunk
from framelens.session import written

_LOW = -(2 ** 62)
#: Tables composed into one.
WIDTH = 256


def _exits(ts: np.ndarray, interval: int) -> list[dict]:
    """Step table (last entry time, exit time) of one chunk, equal exits merged.

    Rows kept earlier lie before the chunk, so chains enter it less than an interval after its
    first row: later steps can't be asked for and are left out.
    """
    nxt = np.searchsorted(ts, ts + interval, side="left")
    exit_at = np.empty(len(ts), dtype=np.int64)
    for i in range(len(ts) - 1, -1, -1):
        exit_at[i] = exit_at[nxt[i]] if nxt[i] < len(ts) else ts[i] + interval
    last = np.append(np.flatnonzero(np.diff(exit_at)), len(ts) - 1)
    last = last[:np.searchsorted(ts[last], ts[0] + interval, side="left") + 1]
    return [{"upto": int(ts[i]), "leave": int(exit_at[i])} for i in last]


def _composed(tables: Sequence[dict], interval: int) -> list[dict]:
    """Step table of consecutive chunks; chains enter less than an interval after the first step's rows begin."""
    uptos = [np.array([s["upto"] for s in t["_steps"]], dtype=np.int64) for t in tables]
    leaves = [np.array([s["leave"] for s in t["_steps"]], dtype=np.int64) for t in tables]
    # a later chunk is entered first only by chains that start within an interval of the first chunk's first step
    limit = uptos[0][0] + interval
    starts = np.unique(np.concatenate([u[:np.searchsorted(u, limit, side="left") + 1] for u in uptos]))
    at = starts.copy()
    for upto, leave in zip(uptos, leaves):
        k = np.searchsorted(upto, at, side="left")
        inside = k < len(upto)
        at[inside] = leave[k[inside]]
    keep = np.append(np.flatnonzero(np.diff(at)), len(at) - 1)
    return [{"upto": int(starts[i]), "leave": int(at[i])} for i in keep]


def _replay(ts: np.ndarray, entry: int, interval: int) -> list[int]:
    """Times kept in one chunk when nothing before ``entry`` may be kept."""
    out, i = [], int(np.searchsorted(ts, entry, side="left"))
    while i < len(ts):
        out.append(int(ts[i]))
        i = int(np.searchsorted(ts, ts[i] + interval, side="left"))
    return out


def throttle(df: DataFrame, keys: Sequence[str], ts: str, interval: int,
             tie: Sequence[str | Column] = (), chunk_length: int | None = None) -> DataFrame:
    """Rows of ``df`` that pass the throttle; ``ts`` and ``interval`` are longs of one unit.

    Of rows with equal key and time only the first in ``tie`` order can pass.
    """
    @F.pandas_udf("array<struct<upto: long, leave: long>>")
    def steps_of(times: pd.Series) -> pd.Series:
        return times.map(lambda t: _exits(t, interval))

    @F.pandas_udf("array<long>")
    def kept_of(times: pd.Series, entry: pd.Series) -> pd.Series:
        return pd.Series([_replay(t, int(e), interval) for t, e in zip(times, entry)], dtype=object)

    # one row per chunk with its distinct times: at most `chunk_length` of them
    distinct = with_chunk(df.groupBy(*keys, F.col(ts).cast("long").alias("_ts")).agg(
        F.min(F.struct(*tie) if tie else F.lit(1)).alias("_tie")), "_ts", chunk_length or interval * 256)
    chunks = distinct.groupBy(*keys, CHUNK).agg(F.array_sort(F.collect_list("_ts")).alias("_times"))

    @F.pandas_udf("array<struct<upto: long, leave: long>>")
    def compose(tables: pd.Series) -> pd.Series:
        return tables.map(lambda t: _composed(sorted(t, key=lambda x: x[CHUNK]), interval))

    # one small row per chunk, read at every level
    tables, _ = written(chunks.select(*keys, CHUNK, steps_of("_times").alias("_steps")), "throttle-steps")
    levels = [tables]
    group = F.floor(F.col(CHUNK) / WIDTH).cast("long")
    span = F.max(CHUNK) - F.min(CHUNK)
    most = tables.groupBy(*keys).agg(span.alias("n")).agg(F.max("n")).first()[0] or 0
    while most >= WIDTH:
        # only key, number and table go up, and a row has at most WIDTH tables
        up = levels[-1].groupBy(*keys, group.alias(CHUNK)).agg(F.collect_list(F.struct(F.col(CHUNK), F.col("_steps"))).alias("_all"))
        above, _ = written(up.select(*keys, CHUNK, compose("_all").alias("_steps")), "throttle-levels")
        levels.append(above)
        most = -(-most // WIDTH)

    def enter(acc: Column, item: Column) -> Column:
        hit = F.filter(item["_steps"], lambda s: s["upto"] >= acc["at"])
        leave = F.when(F.size(hit) > 0, hit[0]["leave"]).otherwise(acc["at"])
        seen = F.struct(item[CHUNK].alias(CHUNK), acc["at"].alias("_entry"))
        return F.struct(leave.alias("at"), F.array_append(acc["out"], seen).alias("out"))

    def entered(rows: DataFrame, entry: Column) -> DataFrame:
        start = F.struct(entry.alias("at"), F.array().cast(f"array<struct<{CHUNK}: bigint, _entry: bigint>>").alias("out"))
        return rows.select(*keys, F.inline(F.aggregate("_all", start, enter, lambda a: a["out"])))

    packed = F.array_sort(F.collect_list(F.struct(CHUNK, "_steps"))).alias("_all")
    entries = entered(levels[-1].groupBy(*keys).agg(packed), F.lit(_LOW).cast("long"))
    for below in reversed(levels[:-1]):
        inner = below.withColumn("_group", group).groupBy(*keys, "_group").agg(packed)
        above = entries.withColumnRenamed(CHUNK, "_group").withColumnRenamed("_entry", "_from")
        entries = entered(inner.join(above, [*keys, "_group"]), F.col("_from"))
    kept = (chunks.join(entries, [*keys, CHUNK])
            .select(*keys, F.explode(kept_of("_times", "_entry")).alias("_ts")))
    rows = df.withColumn("_ts", F.col(ts).cast("long"))
    if not tie:
        return rows.join(kept, [*keys, "_ts"], "left_semi").drop("_ts")
    first = kept.join(distinct.drop(CHUNK), [*keys, "_ts"])
    return rows.withColumn("_tie", F.struct(*tie)).join(
        first, [*keys, "_ts", "_tie"], "left_semi").drop("_ts", "_tie")
