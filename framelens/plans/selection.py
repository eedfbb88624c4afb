"""Exact medians of large groups without holding a group's values in one buffer."""
from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from framelens.session import staged

#: Parts into which a range is cut in each round, and values of a range that may be sorted as one array.
PARTS, FEW = 64, 10_000


def lower_medians(df: DataFrame, keys: Sequence[str], values: Sequence[str], few: int = FEW) -> DataFrame:
    """Per group the element ``floor((n - 1) / 2)`` of the sorted values of each column; nulls do not count.

    Every round cuts the range that holds the element at approximate quantiles (a sketch of bounded size), counts
    the values between and at the cuts exactly, and goes on in the part that holds it. A value
    that fills a part by itself is found as a cut. Ranges with ``few`` values or fewer are sorted.
    """
    keys, by = list(keys), [*keys, "_name"]
    rows = staged(df.select(*keys, F.explode(F.array(*[F.struct(F.lit(c).alias("_name"), F.col(c).cast("double").alias("_v"))
                                                       for c in values])).alias("_x")).select(*keys, "_x.*")
                  .where(" and ".join(f"`{c}` is not null" for c in [*keys, "_v"])))
    none = F.lit(None).cast("double")
    sizes = staged(rows.groupBy(*by).agg(F.count(F.lit(1)).alias("_n")))
    # a large group has more than ``few`` rows, so there is one of them for ``few`` rows at most: they are broadcast,
    # and no task sorts or holds the rows of a large group
    large = sizes.where(F.col("_n") > few)
    small = (rows.join(F.broadcast(large.select(*by)), by, "left_anti").groupBy(*by).agg(F.sort_array(F.collect_list("_v")).alias("_all"))
             .select(*by, F.get("_all", F.floor((F.size("_all") - 1) / 2).cast("int")).alias("_value")))
    found = large.select(*by, none.alias("_low"), none.alias("_high"), "_n", F.floor((F.col("_n") - 1) / 2).alias("_skip"),
                         none.alias("_value"))
    inside = "(_low is null or _v > _low) and (_high is null or _v < _high)"
    while True:
        found = staged(found)
        wide = found.where(F.col("_value").isNull() & (F.col("_n") > few))
        if wide.isEmpty():
            break
        held = rows.join(F.broadcast(wide), by).where(inside)
        grid = [k / PARTS for k in range(PARTS + 1)]
        cuts = held.groupBy(*by).agg(F.array_sort(F.array_distinct(F.percentile_approx("_v", grid, 1000))).alias("_cuts"))
        below = F.size(F.filter("_cuts", lambda c: c < F.col("_v")))
        at = 2 * below + F.array_contains("_cuts", F.col("_v")).cast("int")
        counts = (held.join(F.broadcast(cuts), by).groupBy(*by, at.alias("_at")).agg(F.count(F.lit(1)).alias("_count")))
        upto = F.sum("_count").over(W.partitionBy(*by).orderBy("_at"))  # at most 2 PARTS + 3 rows a group
        hit = (counts.withColumn("_upto", upto).join(wide, by).join(cuts, by)
               .where("_upto - _count <= _skip and _skip < _upto"))
        k = F.floor(F.col("_at") / 2).cast("int")
        equal = F.col("_at") % 2 == 1
        found = found.join(wide.select(*by), by, "left_anti").unionByName(hit.select(
            *by, F.coalesce(F.get("_cuts", k - 1), "_low").alias("_low"), F.coalesce(F.get("_cuts", k), "_high").alias("_high"),
            F.col("_count").alias("_n"), (F.col("_skip") - F.col("_upto") + F.col("_count")).alias("_skip"),
            F.when(equal, F.get("_cuts", k)).alias("_value")))
    last = (rows.join(F.broadcast(found.where("_value is null")), by).where(inside).groupBy(*by, "_skip")
            .agg(F.sort_array(F.collect_list("_v")).alias("_all")).select(*by, F.get("_all", F.col("_skip").cast("int")).alias("_value")))
    every = found.where("_value is not null").select(*by, "_value").unionByName(last).unionByName(small)
    return every.groupBy(*keys).agg(*[F.max(F.when(F.col("_name") == c, F.col("_value"))).alias(c) for c in values])
