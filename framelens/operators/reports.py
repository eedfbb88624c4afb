"""Aggregations for reports: detections, verdicts, sources, run metrics."""
from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from framelens.functions.text import classify_verdict

BORDERLINE = 0.5


def detection_stats(frames: DataFrame) -> DataFrame:
    """One row of totals over result frames (``type``, ``dets``). Only detect frames feed the rest."""
    detect = F.col("type") == "detect"
    dets = F.when(detect, F.col("dets"))

    def fold(start, step):
        return F.aggregate(dets, F.lit(start), step)

    # per-frame numbers first, so no row is exploded for the totals
    slim = frames.select(
        detect.alias("detect"), F.coalesce(F.size(dets), F.lit(0)).alias("n"),
        F.when(F.size(dets) > 0, fold(0.0, lambda a, d: a + d["score"])).alias("s"),
        F.array_min(F.transform(dets, lambda d: d["score"])).alias("lo"),
        F.array_max(F.transform(dets, lambda d: d["score"])).alias("hi"),
        F.coalesce(F.size(F.filter(dets, lambda d: d["score"] < BORDERLINE)), F.lit(0)).alias("b"))
    return slim.agg(
        F.count(F.lit(1)).alias("frames"), F.count_if(F.col("detect") & (F.col("n") > 0)).alias("frames_with_dets"),
        F.coalesce(F.sum(F.greatest("n", F.lit(0))), F.lit(0)).alias("total"),
        (F.sum("s") / F.sum(F.greatest("n", F.lit(0)))).alias("mean_score"),
        F.min("lo").alias("min_score"), F.max("hi").alias("max_score"),
        F.sum(F.greatest("b", F.lit(0))).alias("borderline"))


def report_label(det: Column) -> Column:
    given = F.when((det["label"] != "") & (det["label"] != "null"), det["label"])
    return F.coalesce(given, F.concat(F.lit("class_"), det["cls"].cast("string")))


def detections_by_label(frames: DataFrame) -> DataFrame:
    return (frames.where("type = 'detect'").select(F.explode("dets").alias("d"))
            .groupBy(report_label(F.col("d")).alias("label")).agg(F.count(F.lit(1)).alias("n")))


def frames_by_source(frames: DataFrame) -> DataFrame:
    """Detect frames per non-empty source, frames without detections included."""
    return (frames.where("type = 'detect' and source <> ''").groupBy("source")
            .agg(F.count(F.lit(1)).alias("frames")))


def verdict_stats(records: DataFrame) -> DataFrame:
    """Records ``ok, verdict``: failed calls, and successful ones by class of verdict."""
    kind = F.when(F.coalesce(F.col("ok"), F.lit(False)), classify_verdict(F.coalesce("verdict", F.lit(""))))
    return (records.groupBy(F.coalesce("ok", F.lit(False)).alias("ok"),
                            F.coalesce(kind, F.lit("failed")).alias("kind"))
            .agg(F.count(F.lit(1)).alias("n")))


def verdict_descriptions(records: DataFrame, max_bytes: int | None = None) -> DataFrame:
    """Description of each successful review: its JSON text, or the raw text (with ``max_bytes``: a shorter one)."""
    raw = F.coalesce("verdict", F.lit(""))
    found = F.get_json_object(raw, "$.description")
    fits = F.lit(True) if max_bytes is None else F.octet_length(raw) < max_bytes
    short = F.when((F.length(raw) > 0) & fits, raw)
    return records.where("ok").withColumn("description", F.coalesce(found, short)).where(
        "description is not null")


def observed_classes(dets: DataFrame, label: Column) -> DataFrame:
    return dets.groupBy(label.alias("name")).agg(F.count(F.lit(1)).alias("n"))


def unique_objects(tracked: DataFrame, by: tuple[str, ...] = ("source",)) -> DataFrame:
    """Confirmed tracks per class, each counted once, in the class it was confirmed with."""
    first = (tracked.where("confirmed and track_id > 0").groupBy(*by, "track_id")
             .agg(F.min_by("cls", "ts_ms").alias("cls")))
    return first.groupBy(*by, "cls").agg(F.count(F.lit(1)).alias("objects"))


def frame_class_counts(dets: DataFrame) -> DataFrame:
    """Total and sorted ``classes`` list of every frame."""
    counts = dets.groupBy("frame", "cls").agg(F.count(F.lit(1)).alias("n"))
    return counts.groupBy("frame").agg(
        F.sum("n").alias("total"),
        F.array_sort(F.collect_list(F.struct(F.col("cls").alias("class"), F.col("n").alias("count"))))
        .alias("classes"))


def count_alerts(dets: DataFrame, min_count: int) -> DataFrame:
    """Frames with at least ``min_count`` detections, with their class counts."""
    return frame_class_counts(dets).where(F.col("total") >= min_count)


def merge_run_metrics(parts: DataFrame) -> DataFrame:
    """Metrics of a run from its parts: overall fps, stage times weighted by frames."""
    frames = F.sum("processed_frames")

    def weighted(name: str) -> Column:
        return F.when(frames > 0, F.sum(F.col(name) * F.col("processed_frames")) / frames).otherwise(0.0)
    return parts.groupBy("run").agg(
        frames.cast("long").alias("processed_frames"), F.sum("elapsed_seconds").alias("elapsed_seconds"),
        F.when(F.sum("elapsed_seconds") > 0, frames / F.sum("elapsed_seconds")).otherwise(0.0).alias("avg_fps"),
        weighted("preprocess").alias("preprocess"), weighted("inference").alias("inference"))


def recent_average(df: DataFrame, keys: list[str], order: list[str], value: str, last: int = 1000) -> DataFrame:
    """Mean of the last ``last`` measurements per key (top rows are trimmed before the shuffle)."""
    w = W.partitionBy(*keys).orderBy(*[F.desc(o) for o in order])
    return (df.withColumn("_r", F.row_number().over(w)).where(F.col("_r") <= last)
            .groupBy(*keys).agg(F.avg(value).alias("average"), F.count(F.lit(1)).alias("n")))


def coverage(results: DataFrame, images: DataFrame) -> DataFrame:
    """Evaluated images out of all images, and how many result rows belong to known images."""
    known = images.select("image_id").distinct()
    total = images.agg(F.count_distinct("image_id").alias("images_total")).scalar()
    rows = (results.join(known.withColumn("_known", F.lit(True)), "image_id", "left")
            .agg(F.count(F.lit(1)).alias("exported"), F.count_if("_known").alias("evaluated"),
                 F.count_distinct(F.when(F.col("_known"), F.col("image_id"))).alias("images_evaluated")))
    return rows.withColumn("images_total", total)


def class_areas(pixels: DataFrame) -> DataFrame:
    """Per-pixel class with the highest value (lowest class on ties), then pixels per class."""
    best = pixels.groupBy("frame", "px", "py").agg(
        F.max_by("cls", F.struct(F.col("value"), -F.col("cls"))).alias("cls"))
    return best.groupBy("frame", "cls").agg(F.count(F.lit(1)).alias("pixels"))


def markdown_rows(df: DataFrame, cells: list[Column], order: list[str]) -> DataFrame:
    """Table lines ``| a | b |`` as strings, with their order columns."""
    body = F.concat(F.lit("| "), F.concat_ws(" | ", *cells), F.lit(" |"))
    return df.select(*order, body.alias("line"))
