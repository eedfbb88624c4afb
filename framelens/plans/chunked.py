"""Ordered-series building blocks that never put a whole key into one task.

A key (a camera, a track, a class) may hold a third of all rows, so a plain
``Window.partitionBy(key)`` would sort that third in one task. Here every key is cut into
chunks that are monotone in the order column. Windows run inside ``(key, chunk)``; one
summary row per ``(key, chunk)`` carries what the next chunks must know.
"""
from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from framelens.session import staged

CHUNK = "_chunk"


def with_chunk(df: DataFrame, order: str, length: float, name: str = CHUNK) -> DataFrame:
    """Add the chunk number ``floor(order / length)``."""
    return df.withColumn(name, F.floor(F.col(order) / F.lit(length)).cast("long"))


def even_chunks(df: DataFrame, order: Sequence[Column | str], name: str = CHUNK) -> DataFrame:
    """Add the number of the row's range in ``order`` (keys first); ranges ascend and hold about equally many rows.

    Spark samples the bounds over the whole order, so a key, or one value, that fills most of the table
    is cut by the later columns. The result is written once, because a second sampling could choose other
    bounds, and is laid out by range, so windows over it by key and range need no further shuffle. Sampling
    reads ``df`` twice: hand in a written table where it is dear.
    """
    ranged = staged(df.repartitionByRange(*order).withColumn(name, F.spark_partition_id()))
    return ranged.repartitionById(max(1, ranged.rdd.getNumPartitions()), F.col(name))


def previous(df: DataFrame, keys: Sequence[str], order: Sequence[str],
             cols: Mapping[str, str], chunk: str = CHUNK) -> DataFrame:
    """Add ``new = value of old on the preceding row of the key`` for each item of ``cols``."""
    packed = F.struct(*[F.col(old).alias(new) for new, old in cols.items()])
    local = W.partitionBy(*keys, chunk).orderBy(*order)
    tails = df.groupBy(*keys, chunk).agg(
        F.max_by(packed, F.struct(*order)).alias("_tail"))
    entry = tails.select(*keys, chunk, F.lag("_tail").over(
        W.partitionBy(*keys).orderBy(chunk)).alias("_entry"))
    out = (df.withColumn("_lag", F.lag(packed).over(local))
           .join(entry, [*keys, chunk], "left")
           .withColumn("_prev", F.coalesce("_lag", "_entry")))
    return (out.select(*[c for c in df.columns],
                       *[F.col(f"_prev.{new}").alias(new) for new in cols]))


_FOLD = {
    "sum": (F.sum, lambda a, b: F.coalesce(a, F.lit(0)) + F.coalesce(b, F.lit(0))),
    "max": (F.max, lambda a, b: F.greatest(a, b)),
    "min": (F.min, lambda a, b: F.least(a, b)),
}


def running(df: DataFrame, keys: Sequence[str], order: Sequence[Column | str],
            aggs: Mapping[str, tuple[str, Column]], chunk: str = CHUNK,
            descending_chunks: bool = False) -> DataFrame:
    """Add running ``sum`` / ``max`` / ``min`` columns over each key, current row included."""
    local = W.partitionBy(*keys, chunk).orderBy(*order).rowsBetween(W.unboundedPreceding, 0)
    by_chunk = F.col(chunk).desc() if descending_chunks else F.col(chunk).asc()
    earlier = W.partitionBy(*keys).orderBy(by_chunk).rowsBetween(W.unboundedPreceding, -1)
    totals = df.groupBy(*keys, chunk).agg(
        *[_FOLD[kind][0](col).alias(f"_t_{name}") for name, (kind, col) in aggs.items()])
    before = totals.select(*keys, chunk, *[
        _FOLD[kind][0](f"_t_{name}").over(earlier).alias(f"_b_{name}")
        for name, (kind, _) in aggs.items()])
    out = df.select("*", *[_FOLD[kind][0](col).over(local).alias(f"_l_{name}")
                           for name, (kind, col) in aggs.items()]).join(before, [*keys, chunk], "left")
    return out.select(*df.columns, *[
        _FOLD[kind][1](F.col(f"_b_{name}"), F.col(f"_l_{name}")).alias(name)
        for name, (kind, _) in aggs.items()])
