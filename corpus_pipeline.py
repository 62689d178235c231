"""Corpus pipeline: language, near copies, benchmark leaks, mixture, token files."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from anchorline.llm import stages
from anchorline.llm.frames import table
from anchorline.session import scratch_path

STAGES = [
    ("language_id", stages.language_id),
    ("near_dedup", stages.near_dedup),
    ("decontamination", stages.decontamination),
    ("mixture", stages.mixture),
    ("token_files", stages.token_output),
]
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``; each writes its rows and the next one reads them again."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        path = scratch_path(spark, name)
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
    return STAGES[-1][1](spark, docs, sf_dir)
