"""From documents to packed token sequences: classify, drop near copies, cut repeats, mix, pack."""
from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from framelens.llm import pattern_packing, poisson_mix, quality_fm, simhash_gray, suffix_merge
from framelens.session import written


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the factorisation machine accepts, with all their columns as they are.

    Null, empty and very long texts are scored like all others; repeated rows are judged alike.
    """
    return quality_fm.keep_good(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))


def near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near fingerprints, the one with the smallest id.

    Null and empty texts share one fingerprint, so one of them stays. Equal rows are one document. Rows
    without an id stay.
    """
    return simhash_gray.keep_one(docs)


def repeats(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts without the passages of 50 words and more (strings of 200 bytes) that an earlier place has too.

    The first copy of a passage stays, in order of ids. Documents whose words were all cut out go;
    those that had none stay. Null and empty texts stay as they are.
    """
    return suffix_merge.strip_repeats(docs)


def mixture(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document as often as its source's target weight asks for, in random order, with its own columns.

    A null source is a source of its own; equal ids draw the same number.
    """
    return poisson_mix.draw(docs)


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token pieces with their places in sequences; null and empty texts are an end token alone."""
    return pattern_packing.pack_documents(docs)


STAGES = [("quality", quality), ("near_copies", near_copies), ("repeats", repeats),
          ("mixture", mixture), ("packing", packing)]
#: SQL can't express the trained classifier, XXH64 fingerprints or the tokenizer.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents; each result is written and read again."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES:
        docs, _ = written(stage(spark, docs, sf_dir), f"stage-{name}")
    return docs
