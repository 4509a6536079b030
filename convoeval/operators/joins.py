"""Joins of questions, answers, categories, sessions and visible chunks."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from convoeval.functions.text import TRUNCATED_HEAD
from convoeval.operators.ordered import id_bucket, joined_text, prefix_sums


def match_answers(questions: DataFrame, answers: DataFrame, keys: list[str]) -> DataFrame:
    """Questions with their answer by id."""
    return questions.join(answers, keys)


def with_category(results: DataFrame, categories: DataFrame, default: str = "unknown") -> DataFrame:
    """Category by question id, a default where there is none."""
    return results.join(categories.select("qid", "category"), "qid", "left").withColumn(
        "category", F.coalesce("category", F.lit(default))
    )


def not_answered(questions: DataFrame, done: DataFrame) -> DataFrame:
    return questions.join(done.select("qid"), "qid", "left_anti")


def with_questions(samples: DataFrame, questions: DataFrame) -> DataFrame:
    return samples.join(questions.select("task_id"), "task_id", "left_semi")


def drop_ignored(df: DataFrame, names: DataFrame, column: str) -> DataFrame:
    """Drops rows whose ``column`` is in the one-column table ``names(name)``."""
    return df.join(names.select(F.col("name").alias(column)), column, "left_anti")


def zip_dates(sessions: Column, dates: Column, missing: str = "Unknown") -> Column:
    """Array of (session, date) by ordinal; a missing date gets a default."""
    return F.transform(
        sessions,
        lambda s, i: F.struct(s.alias("session"), F.coalesce(F.get(dates, i), F.lit(missing)).alias("date")),
    )


def visible_extent(
    questions: DataFrame, chunks: DataFrame, bucket_rows: int = 1 << 20
) -> DataFrame:
    """What a question at position p can see: the chunks ``0 .. p`` of its task.

    The visible set is a prefix, so it is given by running totals looked up once
    per question (``n_visible``, ``n_chars``, ``upto``); no (question, chunk) pair
    is made. A question past the last chunk sees all of them.
    """
    sized = chunks.select(
        "task_id", "position", F.lit(1).cast("long").alias("_one"), F.length("text").cast("long").alias("_len")
    )
    seen = prefix_sums(
        sized, ["task_id"], ["position"], id_bucket("position", bucket_rows),
        n_visible=F.col("_one"), n_chars=F.col("_len"),
    ).select("task_id", F.col("position").alias("upto"), "n_visible", "n_chars")
    last = chunks.groupBy("task_id").agg(F.max("position").alias("_last"))
    asked = questions.join(last, "task_id").withColumn("upto", F.least("position", "_last")).drop("_last")
    return asked.join(seen, ["task_id", "upto"])


def visible_tail(
    questions: DataFrame, chunks: DataFrame, budget: int, separator: str = "\n\n",
    marker: str = TRUNCATED_HEAD, bucket_rows: int = 1 << 20,
) -> DataFrame:
    """The last ``budget`` characters a question can see, with a marker when cut.

    Chunks are keyed by the piece of ``budget`` characters their text touches in
    the joined text of the task; a question needs the chunks of two pieces only.
    """
    sep = len(separator)
    sized = chunks.select("task_id", "position", "text", (F.length("text") + sep).cast("long").alias("_len"))
    placed = prefix_sums(sized, ["task_id"], ["position"], id_bucket("position", bucket_rows), _end=F.col("_len"))
    placed = placed.withColumn("_start", F.col("_end") - F.col("_len"))
    ends = placed.select("task_id", F.col("position").alias("upto"), (F.col("_end") - sep).alias("_total"))
    last = chunks.groupBy("task_id").agg(F.max("position").alias("_last"))
    asked = (
        questions.select("qid", "task_id", "position").join(last, "task_id")
        .select("qid", "task_id", F.least("position", "_last").alias("upto"))
        .join(ends, ["task_id", "upto"])
        .withColumn("_from", F.greatest(F.col("_total") - budget, F.lit(0)))
    )
    wanted = asked.withColumn(
        "_piece", F.explode(F.sequence(F.floor(F.col("_from") / budget), F.floor(F.col("_total") / budget)))
    )
    touches = placed.withColumn(
        "_piece",
        F.explode(F.sequence(F.floor(F.col("_start") / budget), F.floor((F.col("_end") - 1) / budget))),
    )
    # of a chunk that spans several pieces only its share of each piece travels
    lo = F.greatest(F.col("_start"), F.col("_piece") * budget)
    hi = F.least(F.col("_end"), (F.col("_piece") + 1) * budget)
    whole = F.concat("text", F.lit(separator))
    shares = touches.select(
        "task_id", "position", "_piece", lo.alias("_lo"), hi.alias("_hi"),
        F.substring(whole, (lo - F.col("_start") + 1).cast("int"), (hi - lo).cast("int")).alias("_text"),
    )
    met = wanted.join(shares, ["task_id", "_piece"]).where(
        (F.col("_hi") > F.col("_from")) & (F.col("_lo") < F.col("_total"))
    )
    a = F.greatest(F.col("_lo"), F.col("_from"))
    b = F.least(F.col("_hi"), F.col("_total"))
    cut = F.substring("_text", (a - F.col("_lo") + 1).cast("int"), (b - a).cast("int"))
    pieces = met.groupBy("qid", "task_id", "upto", "_total").agg(
        F.array_sort(F.collect_list(F.struct(a.alias("a"), cut.alias("t")))).alias("_p")
    )
    body = F.array_join(F.col("_p.t"), "")
    text = F.when(F.col("_total") > budget, F.concat(F.lit(marker), body)).otherwise(body)
    return asked.select("qid", "task_id", "upto").join(
        pieces.select("qid", text.alias("context")), "qid", "left"
    ).withColumn("context", F.coalesce("context", F.lit("")))


def task_context(chunks: DataFrame, separator: str = "\n\n", part_rows: int = 10_000) -> DataFrame:
    """All chunks of a task in order as one text."""
    return joined_text(chunks, ["task_id"], "position", F.col("text"), separator, part_rows)
