"""Prompts for judges and answer batches, built as table joins."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from convoeval.functions.answers import batch_answer, batch_reply, fill_template
from convoeval.functions.text import TRUNCATED_HEAD, strip
from convoeval.operators.joins import visible_tail
from convoeval.operators.ordered import id_bucket, numbered


def parse_rubric(texts: DataFrame) -> DataFrame:
    """``(task_type, template)`` from rubric texts with ``# type a, b`` headers.

    Types that share a header share the section. The table is the size of the
    rubric file.
    """
    section = r"(?m)^# type\s+(.+)$([\s\S]*?)(?=^# type\s+.+$|\z)"
    found = texts.select(
        F.explode(F.arrays_zip(
            F.regexp_extract_all("text", F.lit(section), F.lit(1)).alias("names"),
            F.regexp_extract_all("text", F.lit(section), F.lit(2)).alias("body"),
        )).alias("s")
    )
    return found.select(
        F.explode(F.transform(F.split("s.names", "[、,]"), strip)).alias("task_type"),
        strip(F.col("s.body")).alias("template"),
    )


def judge_prompts(items: DataFrame, rubric: DataFrame) -> DataFrame:
    """Items with a rubric, its three slots filled."""
    prompt = fill_template(F.col("template"), F.col("question"), F.col("reference_answer"), F.col("model_answer"))
    return items.join(rubric, "task_type").withColumn("prompt", prompt).drop("template")


def drop_unrated(items: DataFrame, rubric: DataFrame) -> DataFrame:
    return items.join(rubric.select("task_type"), "task_type", "left_semi")


def choose_template(questions: DataFrame, known: DataFrame, abstention_rule: str = "inner") -> DataFrame:
    """Template name per question: abstention, the category if known, or default.

    The ``inner`` rule looks for ``_abs`` before a trailing index of the id, the
    ``suffix`` rule at its end.
    """
    if abstention_rule == "inner":
        abstains = F.col("qid").rlike(r"^[^_]*_.*_abs_[^_]*$")
    elif abstention_rule == "suffix":
        abstains = F.col("qid").endswith("_abs")
    else:
        raise ValueError("abstention_rule must be inner or suffix")
    marked = questions.join(known.select("category", F.lit(True).alias("_known")), "category", "left")
    name = F.when(abstains, "abstention").when(F.col("_known"), F.col("category")).otherwise("default")
    return marked.withColumn("template", name).drop("_known")


def question_batches(questions: DataFrame, k: int, order: str = "position", bucket_rows: int = 1 << 20) -> DataFrame:
    """Adds ``idx``, ``batch_index`` and the number within the batch."""
    rows = numbered(questions, ["task_id"], [order], id_bucket(order, bucket_rows), "_row")
    return rows.withColumn("idx", F.col("_row") - 1).drop("_row").withColumns(
        {"batch_index": F.floor(F.col("idx") / k), "in_batch": F.col("idx") % k}
    )


def batch_prompts(
    questions: DataFrame, chunks: DataFrame, k: int = 5, budget: int = 49_152,
    reserve_per_question: int = 3072, margin: int = 100, instruction: str = "",
) -> DataFrame:
    """Memory text and a numbered question list per batch of ``k`` questions.

    The memory keeps its end when it does not fit what the questions leave of the
    budget. Only that end is ever gathered: at most ``budget`` characters.
    """
    placed = question_batches(questions, k)
    line = F.concat(F.col("in_batch").cast("string"), F.lit(": "), "query")
    batches = placed.groupBy("task_id", "batch_index").agg(
        F.array_join(F.transform(
            F.array_sort(F.collect_list(F.struct("in_batch", line.alias("t")))), lambda s: s["t"]
        ), "\n").alias("_list"),
        F.count("*").alias("_n"), F.max("position").alias("position"),
    )
    batches = batches.withColumns(
        {"queries": F.concat(F.lit(instruction), "_list"), "qid": F.concat_ws("_", "task_id", "batch_index")}
    )
    tail = visible_tail(batches, chunks, budget, marker="").select("qid", "context")
    room = F.lit(budget - margin) - F.col("_n") * reserve_per_question - F.length("queries")
    fits = F.length("context") <= room
    memory = F.when(fits, F.col("context")).otherwise(
        F.concat(F.lit(TRUNCATED_HEAD), F.right("context", F.greatest(room, F.lit(0)).cast("int")))
    )
    prompt = F.concat(F.lit("Your memory:\n"), memory, F.lit("\n\n"), "queries")
    return batches.join(tail, "qid").select("task_id", "batch_index", prompt.alias("prompt"))


def parse_batch_answers(replies: DataFrame, keys: list[str], reply: str, n: int) -> DataFrame:
    """Answers ``0 .. n-1`` of batch replies as rows; missing ones are NULL."""
    parsed = replies.select(*keys, batch_reply(F.col(reply)).alias("_map"))
    rows = parsed.select(
        *keys, "_map", F.explode(F.sequence(F.lit(0), F.lit(n - 1))).alias("i")
    ).select(*keys, "i", F.try_element_at("_map", F.col("i").cast("string")).alias("_raw"))
    return rows.select(*keys, "i", batch_answer(F.col("_raw")).alias("answer"))
