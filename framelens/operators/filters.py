"""Row filters and lookups over detections and per-frame arrays."""
from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from framelens.functions.geometry import Box, parse_points, point_in_polygon

# fixed values: the reference's detection cap per frame and label text for unknown ids
UNKNOWN_LABEL = "null"
MAX_LABELS = 10_000


def roi_filter(dets: DataFrame, roi: str) -> DataFrame:
    """Keep boxes whose centre is inside or on the polygon; bad polygons switch it off."""
    polygon = parse_points(roi, strict=True)
    if len(polygon) < 3:
        return dets
    box = Box.of()
    return dets.where(point_in_polygon(box.left + box.right, box.top + box.bottom,
                                       [(2 * x, 2 * y) for x, y in polygon]))


def privacy_masks(dets: DataFrame, classes: Sequence[int], width: int, height: int,
                  inset: int = 2) -> DataFrame:
    """Rectangles to hide: boxes of the listed classes, inset and clipped to the frame."""
    box = Box.of()
    x1 = F.greatest(box.left + inset, F.lit(0))
    y1 = F.greatest(box.top + inset, F.lit(0))
    x2 = F.least(box.right - inset, F.lit(width))
    y2 = F.least(box.bottom - inset, F.lit(height))
    return (dets.where(F.col("cls").isin(*classes))
            .withColumn("mask_x", x1).withColumn("mask_y", y1)
            .withColumn("mask_w", x2 - x1).withColumn("mask_h", y2 - y1)
            .where("mask_w > 0 and mask_h > 0"))


def score_filter(dets: DataFrame, conf: float) -> DataFrame:
    return dets.where(F.col("score") >= conf)


def valid_boxes(dets: DataFrame, n_classes: int) -> DataFrame:
    return dets.where((F.col("w") > 0) & (F.col("h") > 0) & F.col("cls").between(0, n_classes - 1))


def class_whitelist(dets: DataFrame, classes: Sequence[int]) -> DataFrame:
    """Keep the listed classes; an empty list keeps all."""
    return dets.where(F.col("cls").isin(*classes)) if classes else dets


def label_of(cls: Column, names: Sequence[str], fallback: str = "null") -> Column:
    """Class name from a literal list; ``fallback='class'`` gives ``class_<id>`` outside it."""
    if len(names) > MAX_LABELS:
        raise ValueError("use label_lookup for long label tables")
    other = F.concat(F.lit("class_"), cls.cast("string")) if fallback == "class" else F.lit(UNKNOWN_LABEL)
    table = F.array(*[F.lit(n) for n in names]) if names else F.array().cast("array<string>")
    return F.coalesce(F.when(cls >= 0, F.get(table, cls.cast("int"))), other)


def label_lookup(dets: DataFrame, labels: DataFrame) -> DataFrame:
    """Add ``label`` from a table ``cls, label``; Spark broadcasts it only when it is small."""
    return dets.join(labels.select("cls", "label"), "cls", "left").withColumn(
        "label", F.coalesce("label", F.lit(UNKNOWN_LABEL)))


def display_filter(tracked: DataFrame, threshold: float, order: str = "det_idx", limit: int | None = None) -> DataFrame:
    """Rows good enough to show: score at the threshold; with ``limit``, the first ones of a frame."""
    shown = tracked.where(F.col("score") >= threshold)
    if limit is None:
        return shown
    rank = F.row_number().over(W.partitionBy("frame").orderBy(order))
    return shown.withColumn("_rank", rank).where(F.col("_rank") <= limit).drop("_rank")


def borderline_gate(frames: DataFrame, min_conf: float, submit_all: bool = False) -> DataFrame:
    """Frames worth a review: any detection below ``min_conf`` (or every frame)."""
    if submit_all:
        return frames
    return frames.where(F.exists("dets", lambda d: d["score"] < min_conf))


def has_person(poses: Column, min_keypoints: int = 3, min_score: float = 0.5) -> Column:
    """Whether some pose has enough keypoints with a good score (third member)."""
    return F.coalesce(F.exists(poses, lambda p: F.size(F.filter(
        p["kpts"], lambda k: F.coalesce(F.get(k, F.lit(2)) >= min_score, F.lit(False)))) >= min_keypoints),
        F.lit(False))
