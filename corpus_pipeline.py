"""Corpus pipeline: quality, near copies, mixing, packing; each stage's rows are written and read again as the next one's."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from corpusloom.llm import mixing, near, packing, quality
from corpusloom.llm.common import keep

STAGES = [("quality", quality.stage), ("near_copies", near.stage), ("mixing", mixing.stage), ("packing", packing.stage)]
#: No SQL expresses a trained classifier or a tokenizer.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES:
        rows = keep(stage(spark, rows, sf_dir), f"pipeline-{name}")
    return rows
