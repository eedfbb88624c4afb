"""Candidate reduction inside frames: top-k, greedy suppression, duplicates.

A frame (or a class in a frame) holds a bounded number of candidates: model heads emit
at most a few thousand. So a frame may be sorted as one array and folded JVM-side (turned boxes: as
Arrow batches of frames); no pairs are ever written out as rows.
"""
from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence
from functools import partial

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from framelens.functions.geometry import Box, iou
from framelens.functions.polygons import Polygons, box_ious, overlaps, pair_blocks
from framelens.plans.spread import spread


def top_k(dets: DataFrame, k: int = 128, keys: Sequence[str] = ("frame",)) -> DataFrame:
    """The ``k`` best-scored rows per key; Spark trims every partition before the shuffle."""
    w = W.partitionBy(*keys).orderBy(F.desc("score"), "det_idx")
    return dets.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k)


def _ranked(dets: DataFrame, keys: Sequence[str], extra: Sequence[str] = ()) -> DataFrame:
    """One row per key with its candidates best first."""
    rest = [c for c in dets.columns if c not in keys and c not in ("score", "det_idx")]
    item = F.struct((-F.col("score")).alias("neg"), "det_idx", "score", *rest, *extra)
    return spread(dets, *keys).groupBy(*keys).agg(F.array_sort(F.collect_list(item)).alias("_all"))


def _greedy(ranked: Column, overlaps: Callable[[Column, Column], Column],
            limit: int | None = None) -> Column:
    """Keep a candidate unless a kept one overlaps it; stop at ``limit`` kept."""
    def step(kept: Column, item: Column) -> Column:
        drop = F.exists(kept, lambda k: overlaps(k, item))
        if limit is not None:
            drop = (F.size(kept) >= limit) | drop
        return F.when(drop, kept).otherwise(F.array_append(kept, item))
    return F.aggregate(ranked, F.slice(ranked, 1, 0), step)


def _boxes_overlap(threshold: float, inclusive: bool = False, floor: float = 0.0):
    def test(a: Column, b: Column) -> Column:
        value = iou(Box.field(a), Box.field(b), floor)
        return value >= threshold if inclusive else value > threshold
    return test


def nms(dets: DataFrame, threshold: float, keys: Sequence[str] = ("frame", "cls"),
        limit: int | None = None) -> DataFrame:
    """Greedy suppression by score inside each key: overlap above the threshold drops a box."""
    folded = _ranked(dets, keys).select(
        *keys, F.inline(_greedy(F.col("_all"), _boxes_overlap(threshold), limit)))
    return folded.drop("neg").select(*dets.columns)


def nms_agnostic(dets: DataFrame, conf: float, threshold: float, max_before: int = 256,
                 max_results: int = 100) -> DataFrame:
    """Score cut, best ``max_before`` per frame, suppression across classes, then a result limit."""
    cut = top_k(dets.where(F.col("score") >= conf), max_before).drop("rank")
    return nms(cut, threshold, ("frame",), max_results)


def rotated_nms(dets: DataFrame, threshold: float, keys: Sequence[str] = ("frame", "cls"),
                skip_low_bounds: bool = False) -> DataFrame:
    """Suppression by polygon overlap. Needs ``poly`` and its bounds ``left .. bottom``.

    The bounds test comes first, so the polygon clip runs only for boxes that can meet.
    ``skip_low_bounds`` also skips pairs whose bounds overlap no more than the threshold
    (a faster variant that can miss overlaps). Clips run on arrays of pairs, and a step then settles the
    candidates of one rank in all groups of a batch.
    """
    grouped = _ranked(dets, keys)
    return grouped.mapInArrow(partial(_rotated_batches, keys=list(keys), names=dets.columns, threshold=threshold,
                                      lowest=threshold if skip_low_bounds else 0.0), dets.schema)


def _rotated_batches(batches: Iterator[pa.RecordBatch], keys: Sequence[str], names: Sequence[str], threshold: float,
                     lowest: float) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        lists = batch.column("_all")
        items, size = lists.flatten(), np.diff(lists.offsets.to_numpy()).astype("int64")
        group = np.repeat(np.arange(len(batch)), size)
        first = (np.cumsum(size) - size)[group]
        rank = np.arange(len(group)) - first
        polys = Polygons(items.field("poly"))
        edges = [items.field(c).to_numpy(zero_copy_only=False).astype("float64") for c in ("left", "top", "right", "bottom")]
        # pairs that exclude each other: an item and one before it in its group
        later, earlier = [np.zeros(0, dtype="int64")], [np.zeros(0, dtype="int64")]
        for i, j in pair_blocks(first, rank):
            near = box_ious(edges, i, j) > lowest
            i, j = i[near], j[near]
            over = overlaps(polys, polys, j, i) > threshold
            later.append(i[over]), earlier.append(j[over])
        later, earlier = np.concatenate(later), np.concatenate(earlier)
        order = np.argsort(rank[later], kind="stable")
        later, earlier = later[order], earlier[order]
        kept = np.ones(len(group), dtype=bool)
        cuts = np.append(np.flatnonzero(np.diff(rank[later], prepend=-1)), len(later))
        for a, b in zip(cuts, cuts[1:]):
            kept[later[a:b][kept[earlier[a:b]]]] = False
        at = pa.array(np.flatnonzero(kept))
        groups = pa.array(group[kept])
        yield pa.RecordBatch.from_arrays([batch.column(c).take(groups) if c in keys else items.field(c).take(at) for c in names],
                                         names=list(names))


def flag_duplicates(dets: DataFrame, threshold: float = 0.75) -> DataFrame:
    """Mark near-duplicates (same class, overlap at least the threshold); all rows stay."""
    keys = ("frame", "cls")
    kept = _greedy(F.col("_all"), _boxes_overlap(threshold, inclusive=True))
    flagged = (_ranked(dets, keys).withColumn("_ids", F.transform(kept, lambda k: k["det_idx"]))
               .select(*keys, "_ids", F.inline("_all")))
    return flagged.withColumn("suppressed", ~F.array_contains("_ids", F.col("det_idx"))).select(
        *dets.columns, "suppressed")


def mask_cap(dets: DataFrame, limit: int = 64) -> DataFrame:
    """First ``limit`` boxes of a frame by score, the ones that get masks."""
    return top_k(dets, limit)


def last_n(df: DataFrame, n: int, order: str) -> DataFrame:
    """The ``n`` rows with the highest order value, ascending."""
    return df.orderBy(F.desc(order)).limit(n).orderBy(order)


def top_classes(counts: DataFrame, n: int = 5) -> DataFrame:
    """The ``n`` most frequent classes (ties by class) with the total over all classes."""
    total = counts.agg(F.sum("n").alias("total")).scalar()
    return counts.orderBy(F.desc("n"), "cls").limit(n).withColumn("total", total)


def recent_texts(df: DataFrame, order: str, n: int = 10) -> DataFrame:
    """Last ``n`` descriptions in arrival order."""
    return last_n(df, n, order)
