"""Resuming: what is done, what is left, what must be scored again."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from convoeval.functions.text import ERROR_PREFIX
from convoeval.operators.joins import not_answered, with_questions
from convoeval.operators.reports import MISSING


def completed(responses: DataFrame, order: list[str]) -> DataFrame:
    """First good response per question; errors do not count."""
    good = responses.where(~F.col("response").startswith(ERROR_PREFIX))
    rest = [c for c in good.columns if c != "qid"]
    first = good.groupBy("qid").agg(F.min_by(F.struct(*rest), F.struct(*order)).alias("_r"))
    return first.select("qid", "_r.*")


def remaining(samples: DataFrame, questions: DataFrame, done: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Samples with open questions, and those questions."""
    left = not_answered(questions, done)
    return with_questions(samples, left), left


def latest(evaluations: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """Newest evaluation per key, so that an appended re-run replaces the old rows."""
    rest = [c for c in evaluations.columns if c not in keys]
    last = evaluations.groupBy(*keys).agg(F.max_by(F.struct(*rest), F.struct(*order)).alias("_r"))
    return last.select(*keys, "_r.*")


def missing_metrics(metric: Column, expected: list[str]) -> Column:
    """Expected metrics that are absent or -1."""
    valid = F.map_keys(F.map_filter(F.coalesce(metric, F.create_map().cast("map<string,double>")), lambda k, v: v != MISSING))
    return F.array_sort(F.array_except(F.array(*[F.lit(m) for m in expected]), valid))


def audit_completeness(evaluations: DataFrame, expected: list[str]) -> DataFrame:
    """Incomplete evaluations: ``qid`` and what is missing."""
    return evaluations.select("qid", missing_metrics(F.col("metric"), expected).alias("missing")).where(
        F.size("missing") > 0
    )


def needs_rerun(responses: DataFrame, evaluations: DataFrame, expected: list[str]) -> DataFrame:
    """One row: counts on both sides, incomplete rows and the verdict."""
    bad = F.size(missing_metrics(F.col("metric"), expected)) > 0
    left = evaluations.agg(F.count("*").alias("n_evaluated"), F.count(F.when(bad, 1)).alias("n_incomplete"))
    n = responses.agg(F.count("*")).scalar()
    out = left.withColumn("n_responses", n)
    return out.withColumn(
        "rerun", (F.col("n_incomplete") > 0) | (F.col("n_responses") != F.col("n_evaluated"))
    )
