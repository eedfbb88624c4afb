"""Skeleton windows of tracked poses, and scoring of the windows by a user model."""
from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from framelens.functions.decode import top1
from framelens.functions.geometry import Box, normalise_keypoint
from framelens.plans.chunked import CHUNK, previous, running


def first_per_frame(poses: DataFrame) -> DataFrame:
    """Tracked poses only, and of a track only its first pose in a frame."""
    keys = ["source", "track_id", "frame"]
    rest = [c for c in poses.columns if c not in keys]
    best = poses.where("track_id > 0").groupBy(*keys).agg(F.min_by(F.struct(*rest), "det_idx").alias("_p"))
    return best.select(*keys, "_p.*")


def skeleton_windows(poses: DataFrame, frames: DataFrame, length: int, stale_frames: int,
                     chunk_frames: int = 100_000) -> DataFrame:
    """Windows of the last ``length`` frames of every track, oldest slot first.

    ``poses``: source, frame, track_id, det_idx, kpts, left .. bottom; ``frames``: source, frame,
    every processed frame. A frame without the track is an empty slot (null keypoints). A track
    lives on for ``stale_frames`` frames after its last pose; then it starts anew, and so it
    does after a gap of ``length`` frames between processed poses. A window is given once
    ``length`` slots are there.
    """
    one = first_per_frame(poses).withColumn(CHUNK, F.floor(F.col("frame") / chunk_frames).cast("long"))
    keys = ["source", "track_id"]
    one = previous(one, keys, ["frame"], {"before": "frame"})
    fresh = F.col("before").isNull() | (F.col("frame") - F.col("before") > stale_frames)
    one = running(one, keys, ["frame"], {"life": ("max", F.when(fresh, F.col("frame")))})
    # slots: from each pose up to the next pose of the track, no further than it stays alive
    last = frames.groupBy("source").agg(F.max("frame").alias("_end"))
    nxt = one.select(*keys, F.col("before").alias("frame"), F.col("frame").alias("_next"))
    span = one.join(nxt, [*keys, "frame"], "left").join(last, "source")
    until = F.least(F.coalesce(F.col("_next") - 1, F.col("_end")), F.col("frame") + stale_frames)
    body = F.struct("kpts", "left", "top", "right", "bottom")
    # numbers are dense within a life, so a window reaches over at most `length` slots
    slots = span.select(*keys, "life", F.col("frame").alias("_seen"), body.alias("pose"),
                        F.explode(F.sequence("frame", F.greatest(until, F.col("frame")))).alias("frame"))
    slots = slots.withColumn("pose", F.when(F.col("frame") == F.col("_seen"), F.col("pose")))
    # halo: each chunk also receives the last length-1 slots of the chunk before
    chunk = F.floor(F.col("frame") / chunk_frames).cast("long")
    slots = slots.withColumn("_home", chunk)
    ahead = F.floor((F.col("frame") + length - 1) / chunk_frames).cast("long")
    slots = slots.withColumn(CHUNK, F.explode(F.sequence("_home", ahead)))
    w = W.partitionBy(*keys, "life", CHUNK).orderBy("frame").rowsBetween(-(length - 1), 0)
    return (slots.withColumn("slots", F.collect_list(F.struct("frame", "pose")).over(w))
            .where((F.size("slots") == length) & (F.col("_home") == F.col(CHUNK)))
            .select(*keys, "frame", "life", F.transform("slots", lambda s: s["pose"]).alias("slots")))


def window_tensor(windows: DataFrame, joints: int, image_size: tuple[int, int] | None = None) -> DataFrame:
    """Flat ``[3, T, V]`` tensor: x plane, y plane, score plane; empty slots are zero."""
    def plane(part: int) -> Column:
        def slot(s: Column) -> Column:
            def joint(k: Column) -> Column:
                if part == 2:
                    return k[2].cast("double")
                if image_size is None:
                    xy = normalise_keypoint(k[0], k[1], Box.field(s))
                else:
                    xy = normalise_keypoint(k[0], k[1], None, F.lit(float(image_size[0])), F.lit(float(image_size[1])))
                return xy[part].cast("double")
            return F.when(s.isNull(), F.array_repeat(F.lit(0.0), joints)).otherwise(F.transform(s["kpts"], joint))
        return F.flatten(F.transform("slots", slot))
    return windows.withColumn("tensor", F.concat(plane(0), plane(1), plane(2)))


def score_actions(windows: DataFrame, model: Callable[[pd.Series], pd.Series]) -> DataFrame:
    """Action of each window: ``model`` maps tensors to class values, then the top class is taken.

    The model runs on Arrow batches as a step of its own, so it never ends up inside the
    lambdas of the scoring expression.
    """
    keys = ["source", "track_id", "frame"]
    kinds = dict(windows.dtypes)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            yield batch[keys].assign(_values=model(batch["tensor"]))

    values = windows.select(*keys, "tensor").mapInPandas(
        run, ", ".join(f"{k} {kinds[k]}" for k in keys) + ", _values array<double>")
    return (values.withColumn("_best", top1(F.col("_values")))
            .select(*keys, F.col("_best.cls").alias("action"), F.col("_best.score").alias("score")))


def stable_presence(frames: DataFrame, flag: str = "present", last: int = 4) -> DataFrame:
    """Per source: the newest row has a person and three quarters of the last rows do."""
    w = W.partitionBy("source").orderBy(F.desc("frame"))
    recent = frames.withColumn("_r", F.row_number().over(w)).where(F.col("_r") <= last)
    return recent.groupBy("source").agg(
        F.bool_or((F.col("_r") == 1) & F.col(flag)).alias("_now"), F.count_if(flag).alias("_have"),
        F.count(F.lit(1)).alias("_n")).select(
        "source", (F.col("_now") & (F.col("_have") >= F.ceil(F.col("_n") * 0.75))).alias("stable"))


def box_jitter(tracks: DataFrame, min_continuity: float = 0.85, chunk_frames: int = 100_000) -> DataFrame:
    """Median height and foot movement between consecutive hits of steady tracks."""
    rows = tracks.withColumn("_h", F.col("bottom") - F.col("top")).withColumn(
        CHUNK, F.floor(F.col("frame") / chunk_frames).cast("long"))
    rows = previous(rows, ["source", "track_id"], ["frame"], {"_f": "frame", "_ph": "_h", "_pb": "bottom"})
    steps = rows.where("_f is not null").withColumn("dh", F.abs(F.col("_h") - F.col("_ph"))).withColumn(
        "dy", F.abs(F.col("bottom") - F.col("_pb")))
    # whole-pixel steps: counting equal values keeps the exact lower median mergeable
    def lower_median(name: str) -> Column:
        return F.expr(f"percentile_disc(0.5) within group (order by {name})").cast("double")
    out = steps.groupBy("source", "track_id").agg(
        (F.count(F.lit(1)) + 1).alias("hits"), lower_median("dh").alias("dh"), lower_median("dy").alias("dy"),
        (1 - F.count_if(F.col("frame") - F.col("_f") != 1) / F.count(F.lit(1))).alias("continuity"))
    return out.where(F.col("continuity") >= min_continuity)
