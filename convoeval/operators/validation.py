"""Checks of ledger samples; every check yields findings or a small report."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from convoeval.functions.text import money
from convoeval.operators.patterns import mentioned
from convoeval.session import cut_lineage


def distribution(df: DataFrame, by: str) -> DataFrame:
    """Count and percent per value."""
    counts = df.groupBy(by).agg(F.count("*").alias("n"))
    total = counts.agg(F.sum("n")).scalar()
    return counts.withColumn("percent", F.round(F.col("n") * 100.0 / total, 4))


def transaction_findings(samples: DataFrame, tx: DataFrame) -> DataFrame:
    """No transactions, amounts not above zero, dates that do not parse.

    ``tx`` has ``task_id, ord, date_text, amount``.
    """
    empty = samples.select("task_id").join(tx.select("task_id"), "task_id", "left_anti").select(
        "task_id", F.lit(None).cast("long").alias("ord"), F.lit("no transactions").alias("finding")
    )
    bad_amount = F.when(F.col("amount") <= 0, "amount not positive")
    bad_date = F.when(F.try_to_timestamp("date_text", F.lit("yyyy-MM-dd")).isNull(), "bad date")
    rows = tx.withColumn("finding", F.explode(F.array_compact(F.array(bad_amount, bad_date))))
    return empty.unionByName(rows.select("task_id", "ord", "finding"))


def total_mismatches(answers: DataFrame, tx: DataFrame, tolerance: float = 0.01) -> DataFrame:
    """Given totals that differ from the recomputed ones; ``answers(task_id, answer)``."""
    sums = tx.groupBy("task_id").agg(F.sum("amount").alias("expected"))
    return answers.join(sums, "task_id").where(F.abs(F.col("expected") - F.col("answer")) > tolerance)


def chunk_count_mismatches(samples: DataFrame, chunks: DataFrame) -> DataFrame:
    """Samples whose number of chunks is not their number of sessions."""
    counts = chunks.groupBy("task_id").agg(F.count("*").alias("n_chunks"))
    joined = samples.join(counts, "task_id", "left").withColumn("n_chunks", F.coalesce("n_chunks", F.lit(0)))
    return joined.where(F.col("n_chunks") != F.col("num_sessions"))


def position_offenders(questions: DataFrame, chunks: DataFrame) -> DataFrame:
    """First question per sample that is not asked at the last chunk."""
    last = chunks.groupBy("task_id").agg(F.max("position").alias("last_position"))
    wrong = questions.join(last, "task_id").where(F.col("position") != F.col("last_position"))
    return wrong.groupBy("task_id").agg(
        F.min_by(F.struct("qid", "position", "last_position"), F.col("ord")).alias("w")
    ).select("task_id", "w.qid", "w.position", "w.last_position")


def unmentioned(tx: DataFrame, chunks: DataFrame) -> DataFrame:
    """Transactions whose scene and amount both occur nowhere in the talk of a task.

    The scenes, in small letters, and the amounts, written raw, with two decimals or as a whole number, are
    patterns that an automaton per task looks for in one pass over the talk; what is found is taken off by
    key. No chunk ever meets all transactions of its task.
    """
    amount = F.col("amount")
    forms = [amount.cast("long").cast("string"), money(amount), amount.cast("string")]
    heard = mentioned(tx.select("task_id", F.lower("scene").alias("pattern")), chunks.select("task_id", F.lower("text").alias("text")))
    numbers = cut_lineage(mentioned(tx.select("task_id", F.explode(F.array(*forms)).alias("pattern")), chunks.select("task_id", "text")))
    left = tx.withColumn("_p", F.lower("scene")).join(heard.withColumnRenamed("pattern", "_p"), ["task_id", "_p"], "left_anti")
    for form in forms:
        left = left.withColumn("_p", form).join(numbers.withColumnRenamed("pattern", "_p"), ["task_id", "_p"], "left_anti")
    return left.drop("_p")
