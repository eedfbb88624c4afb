"""Stored events and their reviews: append, query, attach, route, archive, retention."""
from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from framelens.functions.text import VERDICTS, event_type, extract_verdict, is_json_object, matches_type
from framelens.operators.suppression import last_n
from framelens.plans.chunked import running
from framelens.plans.numbering import global_row_number

# fixed values: public query limits, files under retention, review defaults
DEFAULT_LIMIT = 100
SNAPSHOT_NAME = r"^(snapshot_.*\.jpg|clip_.*\.avi)$"


def append_events(incoming: DataFrame, last_id: int | Column = 0, order: tuple = ("recv_ts", "seq")) -> DataFrame:
    """Give ids to bodies that are JSON objects, in arrival order after ``last_id``."""
    good = incoming.where(is_json_object(F.col("body")))
    first = (F.lit(last_id) if isinstance(last_id, int) else last_id) + 1
    return global_row_number(good, list(order), "id", first)


def rejected_events(incoming: DataFrame) -> DataFrame:
    return incoming.where(~is_json_object(F.col("body")))


def query_events(events: DataFrame, task: str = "", type: str = "", since: int = 0,
                 limit: int = DEFAULT_LIMIT) -> DataFrame:
    """Latest events after ``since`` with the task and type, oldest first."""
    if limit <= 0:
        limit = DEFAULT_LIMIT
    rows = events.where(F.col("id") > since)
    if task:
        rows = rows.where(F.get_json_object("body", "$.task") == task)
    return last_n(rows.where(matches_type(F.col("body"), type)), limit, "id")


def get_event(events: DataFrame, event_id: int) -> DataFrame:
    """The newest event with the id."""
    return events.where(F.col("id") == event_id).orderBy(F.desc("recv_ts")).limit(1)


def latest_reviews(reviews: DataFrame, order: tuple = ("ts",)) -> DataFrame:
    """One review per event: the last one wins. Aggregated before any shuffle of whole rows."""
    rest = [c for c in reviews.columns if c != "event_id"]
    best = reviews.groupBy("event_id").agg(F.max_by(F.struct(*rest), F.struct(*order)).alias("review"))
    return best.withColumnRenamed("event_id", "id")


def attach_reviews(events: DataFrame, reviews: DataFrame, order: tuple = ("ts",)) -> DataFrame:
    return events.join(latest_reviews(reviews, order), "id", "left")


def unmatched_reviews(events: DataFrame, reviews: DataFrame) -> DataFrame:
    """Reviews of unknown events; they stay in the log and are reported."""
    return reviews.join(events.select(F.col("id").alias("event_id")), "event_id", "left_anti")


def manual_reviews(submitted: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Valid manual reviews (source manual, confidence 1) and the rejected rest."""
    ok = F.coalesce(F.col("verdict").isin(*VERDICTS), F.lit(False))
    good = submitted.where(ok).withColumn("source", F.lit("manual")).withColumn("confidence", F.lit(1.0))
    return good, submitted.where(~ok)


def feed(events: DataFrame, reviews: DataFrame, after_id: int, after_ts: int, turn: int | None = None) -> DataFrame:
    """Next rows for a reader: all newer events, or the ``turn`` oldest of them, and reviews changed since."""
    newer = events.where(F.col("id") > after_id)
    fresh = attach_reviews(newer if turn is None else newer.orderBy("id").limit(turn), reviews)
    fresh = fresh.select("id", F.when(F.col("review").isNotNull(), "review").otherwise("event").alias("kind"))
    changed = (latest_reviews(reviews).where(F.col("review.ts") > after_ts)
               .join(events.where(F.col("id") <= after_id).select("id"), "id", "left_semi")
               .select("id", F.lit("review").alias("kind")))
    return fresh.unionByName(changed)


def route(events: DataFrame, review_on: bool, wanted: Column | None = None) -> tuple[DataFrame, DataFrame]:
    """Events queued for review, and events forwarded unchanged."""
    queue = F.lit(review_on) & F.coalesce(wanted if wanted is not None else F.lit(True), F.lit(False))
    return events.where(queue), events.where(~queue)


def mock_provider(prompts: pd.Series) -> pd.Series:
    """Deterministic stand-in for a review model."""
    return pd.Series(['{"verdict": "uncertain", "confidence": 0.5, "reason": "mock"}'] * len(prompts))


def review_prompt(body: Column, hint: Column, extra: str = "") -> Column:
    return F.concat(F.lit("Event: "), body, F.lit("\n"),
                    F.lit(f"Notes: {extra}\n" if extra else ""),
                    F.when(hint != "", F.concat(F.lit("Rule: "), hint, F.lit("\n"))).otherwise(""))


def run_reviews(events: DataFrame, provider: Callable[[pd.Series], pd.Series] = mock_provider,
                hint: Column | None = None, extra: str = "") -> DataFrame:
    """Ask a user-supplied model about each event; unusable replies get the verdict ``error``."""
    asked = events.select("id", review_prompt(
        F.col("body"), hint if hint is not None else F.lit(""), extra).alias("prompt"))

    def call(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            yield pd.DataFrame({"id": batch["id"], "reply": provider(batch["prompt"]).astype(str).to_numpy()})

    replies = asked.mapInPandas(call, f"id {dict(events.dtypes)['id']}, reply string")
    parsed = replies.withColumn("v", extract_verdict(F.col("reply")))
    return parsed.select(
        F.col("id").alias("event_id"), F.lit("llm").alias("source"),
        F.when(F.col("v.ok"), F.col("v.verdict")).otherwise("error").alias("verdict"),
        F.coalesce("v.confidence", F.lit(0.0)).alias("confidence"),
        F.when(F.col("v.ok"), F.col("v.reason")).otherwise("unusable reply").alias("reason"))


def forward(events: DataFrame, reviews: DataFrame, drop_false: bool = False) -> DataFrame:
    """Bodies to send on, with the verdict added. Failed reviews send the body unchanged."""
    joined = attach_reviews(events, reviews)
    verdict = F.col("review.verdict")
    done = F.coalesce(verdict.isin(*VERDICTS), F.lit(False))
    if drop_false:
        joined = joined.where(~(done & (verdict == "false")))
    note = F.to_json(F.struct(verdict.alias("verdict"), F.col("review.confidence").alias("confidence"),
                              F.coalesce("review.reason", F.lit("")).alias("reason")))
    out = F.concat(F.expr("left(body, length(body) - 1)"), F.lit(',"llm":'), note, F.lit("}"))
    return joined.select("id", F.when(done & F.col("body").endswith("}"), out).otherwise(F.col("body")).alias("body"))


def false_alarm_archive(events: DataFrame, reviews: DataFrame, stamp: Column) -> DataFrame:
    """Archive rows for events judged false that have a snapshot."""
    rows = attach_reviews(events, reviews).where("review.verdict = 'false'")
    snapshot = F.get_json_object("body", "$.snapshot")
    task = F.coalesce(F.nullif(F.get_json_object("body", "$.task"), F.lit("")), F.lit("detect"))
    rows = rows.where(F.coalesce(snapshot, F.lit("")) != "").select(
        "id", F.col("review.ts").alias("ts"), task.alias("task"), event_type(F.col("body"), "alert").alias("type"),
        F.col("review.source").alias("source"),
        F.coalesce(F.get_json_object("body", "$.detail"), F.lit("")).alias("detail"),
        snapshot.alias("original_snapshot"), stamp.alias("_stamp"))
    return rows.withColumn("image", F.concat_ws("/", "task", "type", F.concat(
        F.concat_ws("_", "id", "_stamp"), F.lit(".jpg")))).drop("_stamp")


def timeline_rows(events: DataFrame, reviews: DataFrame, now: int, window_ms: int = 0) -> DataFrame:
    """Events of the window with ``type`` and ``verdict`` (none without review, empty is uncertain)."""
    rows = events if window_ms <= 0 else events.where(F.lit(now) - F.col("recv_ts") <= window_ms)
    rows = attach_reviews(rows, reviews)
    verdict = F.when(F.col("review").isNull(), "none").otherwise(
        F.coalesce(F.nullif(F.col("review.verdict"), F.lit("")), F.lit("uncertain")))
    return rows.withColumn("type", event_type(F.col("body"), "event")).withColumn("verdict", verdict)


def timeline(rows: DataFrame, verdict: str = "", type: str = "", task: str = "") -> DataFrame:
    """Filtered timeline, newest first."""
    for name, value in (("verdict", verdict), ("type", type)):
        rows = rows.where(F.col(name) == value) if value else rows
    if task:
        rows = rows.where(F.coalesce(F.get_json_object("body", "$.task"), F.lit("")) == task)
    return rows.orderBy(F.desc("id"))


def timeline_counts(rows: DataFrame) -> DataFrame:
    """Counts of the window by type and by verdict, in one pass."""
    return (rows.groupBy("type", "verdict")
            .agg(F.count(F.lit(1)).alias("n"))
            .select(F.inline(F.array(
                F.struct(F.lit("type").alias("by"), F.col("type").alias("value"), F.col("n")),
                F.struct(F.lit("verdict").alias("by"), F.col("verdict").alias("value"), F.col("n")))))
            .groupBy("by", "value").agg(F.sum("n").alias("n")))


def retention_plan(files: DataFrame, now: int, max_age_days: int = 0, max_bytes: int = 0,
                   chunk_ms: int = 86_400_000) -> DataFrame:
    """Snapshot and clip files (``folder, name, size, mtime``) with ``keep``.

    Old files go first; then the oldest until the rest fits. Sizes are summed newest first
    by day, so a folder with very many files is not sorted in one task.
    """
    rows = files.where(F.col("name").rlike(SNAPSHOT_NAME))
    fresh = F.lit(True) if max_age_days <= 0 else F.lit(now) - F.col("mtime") <= max_age_days * 86_400_000
    rows = rows.withColumn("_fresh", fresh).withColumn("_chunk", F.floor(F.col("mtime") / chunk_ms).cast("long"))
    kept = running(rows.where("_fresh"), ["folder"], [F.desc("mtime"), F.desc("name")],
                   {"_total": ("sum", F.col("size"))}, descending_chunks=True)
    fits = F.lit(True) if max_bytes <= 0 else F.col("_total") <= max_bytes
    out = kept.withColumn("keep", fits).drop("_total").unionByName(
        rows.where("not _fresh").withColumn("keep", F.lit(False)))
    return out.drop("_fresh", "_chunk")


def last_segments(segments: DataFrame, n: int, keys: tuple = ("source",), order: str = "start_ts") -> DataFrame:
    """The ``n`` newest recording segments per source."""
    w = W.partitionBy(*keys).orderBy(F.desc(order))
    return segments.withColumn("_r", F.row_number().over(w)).where(F.col("_r") <= n).drop("_r")


def review_summary(frames: DataFrame, min_conf: float, limit: int | None = None) -> DataFrame:
    """Short form of a frame for a prompt: total and low-scored detections (the first ``limit``)."""
    low = F.filter("dets", lambda d: d["score"] < min_conf)
    low = low if limit is None else F.slice(low, 1, limit)
    return frames.select("frame", F.size("dets").alias("total_detections"),
                         F.lit(min_conf).alias("low_conf_threshold"), low.alias("low_conf_items"))
