"""Samples, stratified subsets and training rows. Draws are hashes of (seed, id)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from convoeval.functions.draws import draw
from convoeval.functions.text import CONVERSATION_HEADER
from convoeval.operators.ordered import (
    draw_bucket, id_bucket, joined_text, numbered, prefix_sums, top_per_key,
)


def small_set(samples: DataFrame, questions: DataFrame, n: int = 10, seed: int = 0, bits: int = 12) -> DataFrame:
    """Questions of randomly ordered samples until ``n``; the last sample is cut to fit.

    ``samples(task_id)``, ``questions(qid, task_id)``. The running sum is taken over
    hash buckets, so no task sees all samples.
    """
    sizes = questions.groupBy("task_id").agg(F.count("*").alias("_n"))
    placed = samples.select("task_id").join(sizes, "task_id").withColumn("_h", draw(seed, "task_id"))
    running = prefix_sums(placed, [], ["_h", "task_id"], draw_bucket(F.col("_h"), bits), _sum=F.col("_n"))
    room = running.withColumn("_room", F.lit(n) - (F.col("_sum") - F.col("_n"))).where("_room > 0")
    cut = questions.join(room.select("task_id", "_n", "_room"), "task_id")
    # a sample that is kept whole needs no ranking; only the last one is cut
    whole = cut.where(F.col("_n") <= F.col("_room")).drop("_n", "_room")
    part = cut.where(F.col("_n") > F.col("_room"))
    ranked = top_per_key(part, ["task_id"], [draw(seed + 1, "qid"), F.asc("qid")], n, "_r")
    return whole.unionByName(ranked.where(F.col("_r") <= F.col("_room")).drop("_n", "_room", "_r"))


def cap_questions(questions: DataFrame, limit: int = 10, seed: int = 0) -> DataFrame:
    """At most ``limit`` random questions per sample; order is the caller's ``ord``."""
    order = [draw(seed, "qid"), F.asc("qid")]
    return top_per_key(questions, ["task_id"], order, limit, "_r").drop("_r")


def stratified(df: DataFrame, by: str, key: str, n: int = 20, seed: int = 0) -> DataFrame:
    """``n`` rows per group, the whole group when it is smaller."""
    drawn = df.withColumn("_h", draw(seed, key))
    return top_per_key(drawn, [by], [F.asc("_h"), F.asc(key)], n, "_r").drop("_r", "_h")


def exclude_sources(df: DataFrame, column: str, names: list[str]) -> DataFrame:
    return df.where(~F.col(column).isin(names))


def batch_questions(questions: DataFrame, k: int = 10, bucket_rows: int = 1 << 20) -> DataFrame:
    """Questions of a sample in groups of ``k``: ids, texts and answers as arrays."""
    rows = numbered(questions, ["task_id"], ["ord"], id_bucket("ord", bucket_rows), "_row")
    rows = rows.withColumn("batch_index", F.floor((F.col("_row") - 1) / k))
    packed = rows.groupBy("task_id", "batch_index").agg(
        F.array_sort(F.collect_list(F.struct("_row", "qid", "query", "answer"))).alias("_q")
    )
    return packed.select(
        "task_id", "batch_index", F.col("_q.qid").alias("question_ids"),
        F.col("_q.query").alias("queries"), F.col("_q.answer").alias("answers"),
    )


def sample_contexts(chunks: DataFrame, part_rows: int = 10_000) -> DataFrame:
    """Context per sample: chunks joined by blank lines, the repeated
    conversation line dropped from all but the first chunk."""
    repeated = (
        (F.col("position") > 0) & F.col("text").startswith(CONVERSATION_HEADER) & F.contains("text", F.lit("\n"))
    )
    body = F.when(repeated, F.regexp_replace("text", r"^[^\n]*\n", "")).otherwise(F.col("text"))
    return joined_text(chunks, ["task_id"], "position", body, "\n\n", part_rows)


def training_rows(
    chunks: DataFrame, questions: DataFrame, data_source: str, agent_name: str, k: int = 10, part_rows: int = 10_000,
) -> DataFrame:
    """Nested training rows: one per question batch, with the whole context.

    Samples without chunks give no rows.
    """
    context = sample_contexts(chunks, part_rows)
    sizes = chunks.groupBy("task_id").agg(F.count("*").alias("num_chunks"))
    rows = batch_questions(questions, k).join(sizes, "task_id").join(context, "task_id")
    tools = F.create_map(F.lit("memory"), F.create_map(F.lit("num_chunks"), F.col("num_chunks").cast("string")))
    return rows.select(
        F.lit(data_source).alias("data_source"),
        F.array(F.struct(F.col("queries").alias("content"), F.lit("user").alias("role"))).alias("prompt"),
        F.col("text").alias("context"),
        F.struct(F.col("answers").alias("ground_truth")).alias("reward_model"),
        F.struct(
            "task_id", "batch_index", "num_chunks", "question_ids",
            F.col("queries").alias("question"), tools.alias("tools_kwargs"),
        ).alias("extra_info"),
        F.lit(agent_name).alias("agent_name"),
    )


def require_rows(df: DataFrame) -> DataFrame:
    """``df``, or an error when it is empty."""
    if not df.limit(1).count():
        raise ValueError("no samples produced; check the input data")
    return df


def profile_training(rows: DataFrame, column: str = "data_source", top: int = 10) -> DataFrame:
    """Rows, distinct sources and the most frequent sources."""
    counts = rows.groupBy(column).agg(F.count("*").alias("n"))
    total, distinct = counts.agg(F.sum("n")).scalar(), counts.agg(F.count("*")).scalar()
    best = counts.orderBy(F.desc("n"), F.asc(column)).limit(top)
    return best.withColumns({"n_rows": total, "n_sources": distinct})


def drop_uniform_groups(rows: DataFrame, group: str, metric: str) -> DataFrame:
    """Rows of groups whose metric is not the same everywhere."""
    mixed = rows.groupBy(group).agg(F.min(metric).alias("_lo"), F.max(metric).alias("_hi"))
    return rows.join(mixed.where("_lo <> _hi").select(group), group, "left_semi")


def group_relative(rows: DataFrame, group: str, reward: str, epsilon: float = 1e-6) -> DataFrame:
    """Adds the reward minus its group mean, over the group deviation.

    Mean and deviation are aggregated with map-side combine and joined back, so a
    hot group is never gathered in one task.
    """
    stats = rows.groupBy(group).agg(F.avg(reward).alias("_mean"), F.stddev_samp(reward).alias("_std"))
    spread = F.coalesce("_std", F.lit(0.0)) + epsilon
    out = rows.join(stats, group)
    return out.withColumn("advantage", (F.col(reward) - F.col("_mean")) / spread).drop("_mean", "_std")


def overlong_penalty(length: Column, max_length: int, buffer: int, factor: float = 1.0) -> Column:
    """Linear penalty once a text runs into the last ``buffer`` units of its limit."""
    over = length - (max_length - buffer)
    return F.least(-over / F.lit(buffer) * factor, F.lit(0.0))
