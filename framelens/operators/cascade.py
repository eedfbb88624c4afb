"""Two-stage results: sub labels of detections, crops for a second model, text lines."""
from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from framelens.functions.geometry import Box, crop_affine


def attach_sub_labels(dets: DataFrame, subs: DataFrame) -> DataFrame:
    """Second-stage result of each detection by position; missing or negative classes stay out."""
    return dets.join(subs.where("sub_cls >= 0"), ["frame", "det_idx"], "left")


def crop_plan(dets: DataFrame, model_w: int, model_h: int, pad: float = 1.0) -> DataFrame:
    """Crop mapping of every detection for a second model."""
    return dets.withColumn("crop", crop_affine(Box.of(), model_w, model_h, pad))


def classify_crops(dets: DataFrame, outputs: DataFrame, score: Callable[[Column], Column],
                   names: Column | None = None) -> DataFrame:
    """Detect, crop, classify: ``outputs`` has ``frame, det_idx, values`` from the second model."""
    top = score(F.col("values"))
    subs = outputs.select("frame", "det_idx", top["cls"].alias("sub_cls"), top["score"].alias("sub_score"))
    out = attach_sub_labels(dets, subs)
    if names is not None:
        out = out.withColumn("sub_label", F.coalesce(F.get(names, F.col("sub_cls").cast("int")), F.lit("")))
    return out


def pair_text_lines(frames: DataFrame) -> DataFrame:
    """Text lines with the polygons they were read from, by position."""
    return frames.select("frame", F.posexplode(F.arrays_zip("polygons", "lines")).alias("line_no", "_p")).select(
        "frame", "line_no", F.col("_p.polygons").alias("polygon"), F.col("_p.lines").alias("line"))
