"""Connected components of a table of links, by alternating stars.

Every round hangs the larger neighbours of each node, then its smaller ones, on the smallest
neighbour, until only stars around the smallest ids remain (Kiveris et al., 2014). Each step is
an aggregate and a join on written tables, so Spark knows the sizes and can split a hot node.
"""
from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from framelens.session import drop_path, written


def _star(edges: DataFrame, hub: str, leaf: str, mins: DataFrame) -> DataFrame:
    """(leaf, least neighbour of hub) for each edge."""
    return (edges.select(F.col(hub).alias("hub"), F.col(leaf).alias("leaf")).join(mins, "hub")
            .select(F.col("leaf").alias("a"), F.col("least").alias("b")).where("a <> b"))


def components(links: DataFrame) -> DataFrame:
    """(node, root) of every node that has a link; root is the smallest node reachable.

    ``links`` has two columns of ids; direction, repeats, nulls and self-links do not matter.
    """
    a, b = links.columns
    known = links.where(F.col(a).isNotNull() & F.col(b).isNotNull() & (F.col(a) != F.col(b)))
    first = known.select(F.greatest(a, b).alias("a"), F.least(a, b).alias("b")).distinct()
    edges, path = written(first, "links")
    before = _print(edges)
    while True:
        paths = [path]
        # large star: neighbours above a node hang on its least neighbour
        both = edges.select(F.col("a").alias("hub"), F.col("b").alias("n")).union(edges.select("b", "a"))
        mins, path = written(both.groupBy("hub").agg(F.least(F.min("n"), F.col("hub")).alias("least")), "mins")
        paths.append(path)
        large, path = written(_star(edges, "b", "a", mins).distinct(), "large")
        paths.append(path)
        # small star: neighbours below a node, and the node, hang on the least of them
        mins, path = written(large.groupBy(F.col("a").alias("hub")).agg(F.min("b").alias("least")), "mins")
        paths.append(path)
        small = _star(large, "a", "b", mins).union(mins.select("hub", "least"))
        edges, path = written(small.distinct(), "links")
        after = _print(edges)
        for old in paths:
            drop_path(links.sparkSession, old)
        if after == before:
            return edges.select(F.col("a").alias("node"), F.col("b").alias("root"))
        before = after


def _print(edges: DataFrame):
    return edges.agg(F.count(F.lit(1)), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
