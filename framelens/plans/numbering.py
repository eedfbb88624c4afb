"""Dense row numbers over a whole table without a one-task window."""
from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from framelens.session import staged


def global_row_number(df: DataFrame, order: Sequence[str | Column], name: str,
                      first: int | Column = 1) -> DataFrame:
    """Number the rows ``first, first+1, ...`` in the given (total) order.

    Rows are range-partitioned and numbered inside their range; the offsets come from one
    count per range. The ranges are written once, because a second sampling pass could
    choose other bounds.
    """
    ranged = staged(df.repartitionByRange(*order).withColumn("_range", F.spark_partition_id()))
    counts = ranged.groupBy("_range").agg(F.count(F.lit(1)).alias("_n"))
    # one row per range: bounded by the number of shuffle partitions
    offsets = counts.select("_range", F.coalesce(F.sum("_n").over(
        W.orderBy("_range").rowsBetween(W.unboundedPreceding, -1)), F.lit(0)).alias("_before"))
    local = F.row_number().over(W.partitionBy("_range").orderBy(*order))
    first = F.lit(first) if isinstance(first, int) else first
    return (ranged.withColumn("_local", local).join(offsets, "_range")
            .withColumn(name, (first + F.col("_before") + F.col("_local") - 1).cast("long"))
            .drop("_range", "_local", "_before"))


def last_rows(df: DataFrame, order: str, n: int, buckets: int = 1024) -> DataFrame:
    """The ``n`` rows with the greatest values of a whole-number column, as a filter.

    The least value wanted is found from counts by value range, refined in the range that holds it, so no
    task sorts the ``n`` rows. Of rows with equal values at the cut any may be chosen. Null values come last.
    """
    value = F.col(order).cast("long")
    low, high, total = df.agg(F.min(value), F.max(value), F.count(value)).first()
    if total <= n:
        rest = df.where(F.col(order).isNull()).limit(n - total) if n > total else df.limit(0)
        return df.where(F.col(order).isNotNull()).unionByName(rest)
    need = n
    while low < high:
        width = (high - low) // buckets + 1
        found = (df.where(value.between(low, high)).groupBy(F.floor((value - low) / width).alias("b")).count()
                 .orderBy(F.desc("b")).collect())  # at most ``buckets`` rows
        for row in found:
            if row["count"] >= need:
                low, high = low + row["b"] * width, min(high, low + (row["b"] + 1) * width - 1)
                break
            need -= row["count"]
    return df.where(value > low).unionByName(df.where(value == low).limit(need))
