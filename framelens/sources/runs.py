"""Run summaries of evaluations, with the speed from their metrics files."""
from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from framelens.schema import SUMMARY


def summaries(files: DataFrame, metrics: DataFrame) -> DataFrame:
    """Files ``dir, name, value`` (JSON text) to runs ``dir, tag, kind, fps`` and metric columns.

    Sweep results (tags starting with conf) and texts that are no objects are skipped. A
    missing kind is ``obb`` when oriented metrics are there; other summaries are dropped.
    """
    tag = F.regexp_extract("name", r"^summary_(.*)\.json$", 1)
    rows = files.where(F.col("name").rlike(r"^summary_.*\.json$")).withColumn("tag", tag).where(~F.col("tag").startswith("conf"))
    rows = rows.where(F.coalesce(F.schema_of_variant(F.try_parse_json("value")).startswith("OBJECT"), F.lit(False)))
    rows = rows.select("dir", "tag", F.from_json("value", SUMMARY).alias("s")).select("dir", "tag", "s.*")
    oriented = F.col("mAP50_95").isNotNull() | F.col("AP50_per_class").isNotNull()
    rows = rows.withColumn("kind", F.coalesce("kind", F.when(oriented, "obb"))).where("kind is not null")
    # the engine's name is the key of the entry with a pipeline; other entries may stand before it
    engines = F.filter(F.map_values(F.from_json("value", "map<string,string>")),
                       lambda x: F.get_json_object(x, "$.pipeline").isNotNull())
    m = metrics.select("dir", F.regexp_extract("name", r"^metrics_(.*)\.json$", 1).alias("tag"),
                       F.get_json_object(F.get(engines, F.lit(0)), "$.pipeline.avg_fps").cast("double").alias("fps"))
    return rows.join(m, ["dir", "tag"], "left").withColumn("fps", F.coalesce("fps", F.lit(0.0)))


def read_texts(spark: SparkSession, path: str) -> DataFrame:
    """Whole small files as ``dir, name, value``."""
    full = F.input_file_name()
    return spark.read.text(path, wholetext=True).select(
        F.regexp_extract(full, r"^(.*)/[^/]*$", 1).alias("dir"), F.regexp_extract(full, r"([^/]*)$", 1).alias("name"), "value")
