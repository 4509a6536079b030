"""Averages, leaderboards and presence tables over long evaluation records.

Records are ``(agent, task, qid, category, metric, value)``; -1 means missing.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

MISSING = -1.0


def valid(value: str | Column) -> Column:
    value = F.col(value) if isinstance(value, str) else value
    return F.nullif(value, F.lit(MISSING))


def strict(value: Column, combined: Column) -> Column:
    """``combined``, or the sentinel as soon as one value is the sentinel."""
    return F.when(F.bool_or(value == MISSING), F.lit(MISSING)).otherwise(combined)


def mean_valid(records: DataFrame, keys: list[str]) -> DataFrame:
    """Mean without missing values, with the number of valid ones."""
    return records.groupBy(*keys, "metric").agg(
        F.round(F.avg(valid("value")), 6).alias("avg_value"),
        F.count(valid("value")).alias("n_valid"),
    )


def strict_mean(records: DataFrame, keys: list[str]) -> DataFrame:
    """Mean and total per metric; one missing value spoils both."""
    v = F.col("value")
    return records.groupBy(*keys, "metric").agg(
        F.round(strict(v, F.avg(v)), 6).alias("avg_value"),
        F.round(strict(v, F.sum(v)), 6).alias("total_value"),
        F.count("*").alias("n"),
    )


def strict_mean_levels(records: DataFrame, keys: list[str], level: str) -> DataFrame:
    """``strict_mean`` overall and by ``level`` in one pass over the records."""
    v = F.col("value")
    grouped = records.groupingSets(
        [[*[F.col(k) for k in keys], F.col("metric")],
         [*[F.col(k) for k in keys], F.col("metric"), F.col(level)]],
        *keys, "metric", level,
    )
    return grouped.agg(
        F.grouping(level).cast("int").alias("is_total"),
        F.round(strict(v, F.avg(v)), 6).alias("avg_value"),
        F.count("*").alias("n"),
    )


def question_total(records: DataFrame, keys: list[str]) -> DataFrame:
    """Per key, the sum over categories of the count of the category's first metric.

    The first metric is the one of the lowest question id, then the lowest name.
    """
    counts = records.groupBy(*keys, "category", "metric").agg(
        F.count("*").alias("n"), F.min("qid").alias("first_qid")
    )
    first = counts.groupBy(*keys, "category").agg(
        F.min_by("n", F.struct("first_qid", "metric")).alias("n")
    )
    return first.groupBy(*keys).agg(F.sum("n").alias("total_questions"))


def filter_by_rules(records: DataFrame, rules: DataFrame) -> DataFrame:
    """Keep rows of ruled tasks only in their listed categories; others all.

    ``rules`` is a small table ``(task, category)``.
    """
    listed = rules.select("task", "category").distinct()
    ruled = listed.select("task").distinct().withColumn("_ruled", F.lit(True))
    allowed = listed.withColumn("_allowed", F.lit(True))
    joined = records.join(ruled, "task", "left").join(allowed, ["task", "category"], "left")
    return joined.where(F.col("_ruled").isNull() | F.col("_allowed").isNotNull()).drop(
        "_ruled", "_allowed"
    )


def metric_table(records: DataFrame, keys: list[str], metrics: list[str]) -> DataFrame:
    """Wide strict means, one column per metric, -1 where a metric is absent."""
    v = F.col("value")
    wide = records.groupBy(*keys).pivot("metric", metrics).agg(F.round(strict(v, F.avg(v)), 6))
    return wide.na.fill(MISSING, metrics)


def leaderboard(records: DataFrame, metric: str) -> DataFrame:
    """Long leaderboard: agent, task, score, row mean over valid cells, best flags."""
    v = F.col("value")
    cells = (
        records.where(F.col("metric") == metric)
        .groupBy("agent", "task")
        .agg(strict(v, F.avg(v)).alias("score"))
    )
    # agents x tasks is the size of the report, not of the data
    best = cells.groupBy("task").agg(F.max(valid("score")).alias("best"))
    means = cells.groupBy("agent").agg(F.avg(valid("score")).alias("agent_avg"))
    top = means.agg(F.max("agent_avg")).scalar()
    out = cells.join(best, "task").join(means, "agent").withColumn("best_avg", top)

    def is_best(value: Column, other: str) -> Column:
        return F.coalesce((value != MISSING) & (F.abs(value - F.col(other)) < 1e-6), F.lit(False))

    return out.select(
        "agent", "task",
        F.round("score", 6).alias("score"),
        F.round("agent_avg", 6).alias("agent_avg"),
        is_best(F.col("score"), "best").alias("best_in_task"),
        is_best(F.col("agent_avg"), "best_avg").alias("best_average"),
    )


def leaderboard_wide(records: DataFrame, metric: str, tasks: list[str]) -> DataFrame:
    """One row per agent, one column per task, NULL for a missing cell."""
    cells = leaderboard(records, metric)
    return cells.groupBy("agent", "agent_avg").pivot("task", tasks).agg(F.max(valid("score")))


def presence_matrix(outputs: DataFrame, tasks: list[str]) -> DataFrame:
    """Which agent has output for which task, as 1 or 0."""
    wide = outputs.select("agent", "task").distinct().groupBy("agent").pivot("task", tasks).agg(
        F.max(F.lit(1))
    )
    return wide.na.fill(0, tasks)


def scaling_series(scores: DataFrame, pattern: str = r"^synth-ss(\d+)") -> DataFrame:
    """Score by the session count written in the task name."""
    return (
        scores.where(F.col("task").rlike(pattern) & valid("score").isNotNull())
        .select(
            "agent",
            F.regexp_extract("task", pattern, 1).cast("int").alias("sessions"),
            "score",
        )
    )


def question_timing(batches: DataFrame) -> DataFrame:
    """Time per question: batch time over the questions asked at one position."""
    sizes = batches.groupBy("task_id", "position").agg(
        F.count("*").alias("n"), F.max("duration").alias("duration")
    )
    return sizes.withColumn("generation_time", F.col("duration") / F.col("n"))


def judge_summary(details: DataFrame) -> DataFrame:
    """Evaluated items and the mean of successful scores."""
    good = F.when(F.col("status") == "success", F.col("score"))
    return details.agg(
        F.count("*").alias("total_items"),
        F.count(good).alias("evaluated_items"),
        F.coalesce(F.bround(F.avg(good), 4), F.lit(0.0)).alias("average_score"),
    )
