"""Registered corpus queries, their SQL where SQL can express them."""
from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

import corpus_pipeline

from framelens.llm import (language_id, multi_index, pattern_packing, periodic_runs, poisson_mix, quality_fm,
                           quality_rules, simhash_gray, skip_chain_pii, suffix_merge, token_alignment, toxicity, virtual_slots)

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def _register(name: str, sql: str | None = None):
    def wrap(fn):
        QUERIES[name] = fn
        if sql:
            ORACLES[name] = sql.strip()
        return fn
    return wrap


def _table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


@_register("op1_quality_rules", quality_rules.SQL)
def op1(spark: SparkSession, folder: str) -> DataFrame:
    return quality_rules.judge(_table(spark, folder, "documents"))


@_register("op2_multi_index")
def op2(spark: SparkSession, folder: str) -> DataFrame:
    return multi_index.near_vectors(_table(spark, folder, "embeddings"))


@_register("op3_language_id")
def op3(spark: SparkSession, folder: str) -> DataFrame:
    return language_id.held_out_languages(_table(spark, folder, "documents"))


@_register("op4_source_mix", poisson_mix.SQL)
def op4(spark: SparkSession, folder: str) -> DataFrame:
    return poisson_mix.mix(_table(spark, folder, "documents"))


@_register("op5_quality_fm")
def op5(spark: SparkSession, folder: str) -> DataFrame:
    return quality_fm.quality_scores(_table(spark, folder, "documents"), _table(spark, folder, "labels"))


@_register("op6_simhash_gray")
def op6(spark: SparkSession, folder: str) -> DataFrame:
    return simhash_gray.fingerprint_components(_table(spark, folder, "documents"))


@_register("op7_suffix_merge")
def op7(spark: SparkSession, folder: str) -> DataFrame:
    return suffix_merge.removal_digest(_table(spark, folder, "documents"))


@_register("op8_toxicity")
def op8(spark: SparkSession, folder: str) -> DataFrame:
    return toxicity.toxicity_scores(_table(spark, folder, "documents"), _table(spark, folder, "labels"))


@_register("op9_pattern_packing")
def op9(spark: SparkSession, folder: str) -> DataFrame:
    return pattern_packing.pack_documents(_table(spark, folder, "documents"))


@_register("op10_virtual_slots")
def op10(spark: SparkSession, folder: str) -> DataFrame:
    return virtual_slots.shard_digest(_table(spark, folder, "documents"))


@_register("op11_periodic_runs")
def op11(spark: SparkSession, folder: str) -> DataFrame:
    return periodic_runs.run_digest(_table(spark, folder, "documents"))


@_register("op12_token_alignment")
def op12(spark: SparkSession, folder: str) -> DataFrame:
    return token_alignment.align_digest(_table(spark, folder, "documents"))


@_register("op13_skip_chain_pii")
def op13(spark: SparkSession, folder: str) -> DataFrame:
    return skip_chain_pii.span_digest(_table(spark, folder, "documents"))


_register("pipeline", corpus_pipeline.ORACLE_SQL)(corpus_pipeline.run)
