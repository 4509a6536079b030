"""Corpus pipeline: the stages a text corpus passes before training, each written and read again."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from convoeval.llm.common import stored
from convoeval.llm.stages import STAGES

#: Some stages (a trained scorer, sampled signatures, piece lookup) have no SQL form.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``; each stage's result is written as Parquet and reread."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES:
        docs = stored(stage(spark, docs, sf_dir), name)
    return docs
