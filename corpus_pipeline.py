"""The corpus pipeline: quality, exact and near duplicates, benchmark passages, packing. Each stage takes (spark, docs, sf_dir) and
returns a DataFrame that is written as Parquet and read back as the next stage's docs; all but the last return the columns of docs.
Every stage judges all rows its predecessor kept. Nulls, empty tables, repeated rows and extra columns are as each operator states."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from plumbline.llm import decontaminate as benchmark_passages
from plumbline.llm import exact_dedup, packing, quality, simhash
from plumbline.llm.base import stage_tables, stored, table


def keep_good(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return quality.keep_good(docs, table(spark, sf_dir, "labels"))


def drop_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return exact_dedup.deduplicate(docs)


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return simhash.drop_near_duplicates(docs)


def decontaminate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return benchmark_passages.decontaminate(docs, table(spark, sf_dir, "benchmark"))


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return packing.pack(docs)


STAGES = [("quality", keep_good), ("exact_dedup", drop_copies), ("near_dedup", drop_near_copies), ("decontaminate", decontaminate), ("packing", pack)]
#: The quality model, fingerprints, links and packing are not SQL; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for _, stage in STAGES[:-1]:
        with stage_tables(spark):  # what a stage stored on its way goes once its output is written
            docs = stored(stage(spark, docs, sf_dir), note=False)
    return STAGES[-1][1](spark, docs, sf_dir)
