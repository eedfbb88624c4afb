"""Alert rates: throttle per source, de-duplication across sources, review pacing."""
from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from framelens.operators.filters import borderline_gate
from framelens.plans.throttle import throttle


def alert_throttle(alerts: DataFrame, interval_ms: int, tie: Sequence[str] = ("id",)) -> DataFrame:
    """At most one alert per source and interval; count and near-distance alerts share it."""
    return throttle(alerts, ["source"], "ts_ms", interval_ms, tie)


def cross_stream_dedup(alerts: DataFrame, interval_ms: int, tie: Sequence[str] = ("id",)) -> DataFrame:
    """At most one alert per task and class (or task and ``near_dist``) across all sources."""
    key = F.when(F.col("event") == "near_distance", "near_dist").otherwise(F.col("cls").cast("string"))
    return throttle(alerts.withColumn("dedup_key", key), ["task", "dedup_key"], "ts_ms", interval_ms, tie)


def review_plan(frames: DataFrame, min_conf: float, interval_ms: int, submit_all: bool = False) -> DataFrame:
    """Frames to submit: those that pass the gate, no closer than the interval per source."""
    return throttle(borderline_gate(frames, min_conf, submit_all), ["source"], "ts_ms", interval_ms)


def inference_throttle(rows: DataFrame, interval_ms: int) -> DataFrame:
    """Rows of each track on which a second model runs."""
    return throttle(rows, ["source", "track_id"], "ts_ms", interval_ms)
