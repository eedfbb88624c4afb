"""Event-log lines: replay and writing."""
from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from framelens.functions.text import is_json_object
from framelens.plans.numbering import last_rows
from framelens.schema import EVENT_LINE


def replay(lines: DataFrame, keep_last: int, order: str = "line_no") -> tuple[DataFrame, DataFrame]:
    """Events and reviews of the last ``keep_last`` non-empty lines (``line_no, value``).

    Lines that are no JSON object, and events without a number id or an object body, are skipped.
    """
    tail = last_rows(lines.where(F.length("value") > 0), order, keep_last)
    parsed = (tail.where(is_json_object(F.col("value")))
              .select(order, "value", F.from_json("value", EVENT_LINE).alias("r")))
    review = F.coalesce(F.col("r.kind") == "review", F.lit(False))
    reviews = parsed.where(review).select(
        order, "r.event_id", "r.source", "r.verdict", F.coalesce("r.confidence", F.lit(0.0)).alias("confidence"),
        "r.ts", "r.reason")
    # the raw text keeps the body as it was written
    body = F.get_json_object("value", "$.body")
    events = parsed.where(~review).select(
        order, "r.id", F.coalesce("r.recv_ts", F.lit(0)).alias("recv_ts"), body.alias("body"))
    return events.where("id is not null").where(is_json_object(F.col("body"))), reviews


def next_id(events: DataFrame) -> DataFrame:
    """The id the next event gets: one more than the highest, 1 for an empty log."""
    return events.agg((F.coalesce(F.max("id"), F.lit(0)) + 1).alias("next_id"))


def event_lines(events: DataFrame) -> DataFrame:
    """Log lines of new events: id, receive time and the untouched body."""
    return events.select("id", F.concat(
        F.lit('{"id":'), F.col("id"), F.lit(',"recv_ts":'), F.col("recv_ts"), F.lit(',"body":'),
        F.col("body"), F.lit("}")).alias("value"))


def review_lines(reviews: DataFrame) -> DataFrame:
    return reviews.select("event_id", F.to_json(F.struct(
        F.lit("review").alias("kind"), "event_id", "source", "verdict", "confidence", "ts",
        "reason")).alias("value"))


def append_log(lines: DataFrame, path: str) -> None:
    lines.select("value").write.mode("append").text(path)


def stream_events(spark: SparkSession, path: str, files_per_trigger: int = 64) -> DataFrame:
    """Continuous ingest of event bodies from files, objects only."""
    rows = (spark.readStream.option("maxFilesPerTrigger", files_per_trigger)
            .schema("value string").text(path))
    return rows.where(is_json_object(F.col("value"))).select(F.col("value").alias("body"))


def write_archive(rows: DataFrame, path: str) -> None:
    """False-alarm manifest, one folder per task and type."""
    rows.write.mode("append").partitionBy("task", "type").json(path)
