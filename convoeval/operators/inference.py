"""Model calls as batch jobs over a caller-supplied function.

The functions run inside tasks and may be retried with them, so they must be
idempotent. No model ships with this package.
"""

from __future__ import annotations

import random
import time
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from convoeval.functions.text import keep_head
from convoeval.operators import memory as M
from convoeval.operators.retrieval import bm25_scoped_topk
from convoeval.session import gathered

ERROR = "ERROR_API_CALL: "

#: Bytes of the texts of one call, about.
BATCH_BYTES = 1 << 22


def call_with_retries(fn: Callable, *args, tries: int = 3, base_wait: float = 0.0, max_time: float = 300.0):
    """Result of ``fn`` and no error, or no result and the error text."""
    start, error = time.monotonic(), ""
    for attempt in range(tries):
        try:
            return fn(*args), None
        except Exception as exc:  # any failure of a remote call becomes text
            error = f"{ERROR}{exc}"
            if time.monotonic() - start > max_time:
                break
            if base_wait and attempt + 1 < tries:
                time.sleep(random.uniform(0, base_wait * 2**attempt))
    return None, error


def batch_infer(
    df: DataFrame, fn: Callable, input_column: str, output_column: str = "response", tries: int = 3,
    make_client: Callable | None = None, partitions: int | None = None, base_wait: float = 0.0,
) -> DataFrame:
    """Adds ``fn(client, texts) -> texts`` for batches of rows.

    One client per partition; ``partitions`` bounds how many calls run at a time. A call gets texts of about
    ``BATCH_BYTES`` in all, and only they become Python objects; the other columns pass by as they are.
    A batch that keeps failing is tried row by row; rows that fail get error text.
    """
    rows = df.repartition(partitions) if partitions else df
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in df.schema.fields)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        client = make_client() if make_client else None
        for batch in (part for whole in batches for part in bounded_bytes(whole, input_column, BATCH_BYTES)):
            texts = batch.column(input_column).to_pylist()
            done, error = call_with_retries(fn, client, texts, tries=tries, base_wait=base_wait)
            if error is None:
                answers = list(done)
            else:
                answers = []
                for text in texts:
                    one, bad = call_with_retries(fn, client, [text], tries=tries, base_wait=base_wait)
                    answers.append(bad if bad else list(one)[0])
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(answers, pa.string())], [*batch.schema.names, output_column])

    return rows.mapInArrow(run, f"{schema}, `{output_column}` string")


def bounded_bytes(whole: pa.RecordBatch, column: str, most: int) -> Iterator[pa.RecordBatch]:
    """``whole`` in pieces with at most ``most`` bytes in a text column, or of one row."""
    ends = np.cumsum(pc.fill_null(pc.binary_length(whole.column(column)), 0).to_numpy(zero_copy_only=False).astype("i8"))
    at = 0
    while at < whole.num_rows:
        to = max(at + 1, int(np.searchsorted(ends, (ends[at - 1] if at else 0) + most, side="right")))
        yield whole.slice(at, to - at)
        at = to


EMPTY_MEMORY = "No previous memory"
FAILED_UPDATE = "[Memory update failed due to API error] "


def fold_summary(
    chunks: DataFrame, fn: Callable, keys: list[str], order: str, text: str = "text", query: str | None = None,
    tries: int = 3,
) -> DataFrame:
    """Memory per key after ``memory = fn(memory, chunk[, query])`` over its chunks in order.

    A failed step appends its chunk. Keys are spread over tasks; within a task rows
    stream by in order and only the running memory is held, never a key's chunks.
    """
    need = [*keys, order, text, *([query] if query else [])]
    rows = gathered(chunks.select(*need), *keys).sortWithinPartitions(*keys, order)
    types = dict(chunks.dtypes)
    schema = ", ".join(f"`{k}` {types[k]}" for k in keys) + ", memory string"

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        current, memory = None, EMPTY_MEMORY
        for pdf in batches:
            out = []
            for row in pdf.to_dict("records"):
                key = tuple(row[k] for k in keys)
                if key != current:
                    if current is not None:
                        out.append((*current, memory))
                    current, memory = key, EMPTY_MEMORY
                args = (memory, row[text], row[query]) if query else (memory, row[text])
                new, error = call_with_retries(fn, *args, tries=tries)
                if error is None:
                    memory = new
                elif memory == EMPTY_MEMORY:
                    memory = FAILED_UPDATE + row[text]
                else:
                    memory = f"{memory}\n\n{FAILED_UPDATE}{row[text]}"
            yield pd.DataFrame(out, columns=[*keys, "memory"])
        if current is not None:
            yield pd.DataFrame([(*current, memory)], columns=[*keys, "memory"])

    return rows.mapInPandas(run, schema)


def answer_by_retrieval(
    questions: DataFrame, chunks: DataFrame, fn: Callable, k: int = 20, budget: int = 46_000, tries: int = 3
) -> DataFrame:
    """Answers from the best visible chunks of each question: ``(qid, query, context, response)``."""
    hits = bm25_scoped_topk(questions.withColumnRenamed("query", "text"), chunks, k)
    texts = hits.join(chunks.select("task_id", "position", "text"), ["task_id", "position"])
    # at most k texts per question
    packed = texts.groupBy("qid").agg(F.array_sort(F.collect_list(F.struct("rank", "text"))).alias("_h"))
    context = keep_head(F.to_json(F.col("_h.text")), budget)
    asked = questions.select("qid", "query").join(packed.select("qid", context.alias("context")), "qid", "left")
    prompt = F.concat(
        F.lit("Retrieved Conversation Turns:\n"), F.coalesce("context", F.lit("[]")),
        F.lit("\n\nQuestion: "), "query", F.lit("\nAnswer:"),
    )
    return batch_infer(asked.withColumn("prompt", prompt), fn, "prompt", tries=tries).drop("prompt")


def consolidate_memory(
    texts: DataFrame, state: DataFrame, extract: Callable, suggest: Callable, operate: Callable,
    categories: list[str],
) -> dict[str, DataFrame]:
    """New items, suggestions, operations and items after them, for texts of sessions.

    ``texts(key, seq, text, date)``; ``state(key, seq, memory_id, content,
    mentioned_at)``. The three functions stand for the model calls; their replies
    are parsed and replayed as tables.
    """
    replies = batch_infer(texts, extract, "text", "reply")
    parts = replies.withColumn("_s", M.sections(F.col("reply"), M.SECTION_HEADERS)).withColumn(
        "activity", F.col("_s")["activity"]
    )
    items = M.stamp_lines(parts, ["key", "seq"], "activity", "date")
    asked = batch_infer(parts.select("key", "seq", "date", "activity"), suggest, "activity", "reply")
    suggestions = asked.select("key", "seq", "date", F.explode(M.parse_suggestions(F.col("reply"), categories)).alias("s"))
    suggestions = suggestions.select("key", "seq", "date", "s.category", "s.suggestion")
    replied = batch_infer(suggestions, operate, "suggestion", "reply")
    ops = replied.select("key", "category", "seq", "date", F.posexplode(M.parse_operations(F.col("reply"))).alias("i", "o"))
    stamp = F.left(F.md5(F.concat_ws("|", "key", "category", "seq", "i")), F.lit(8))
    ops = ops.select(
        "key", "category", (F.col("seq") * (1 << 20) + F.col("i")).alias("seq"), "o.operation",
        F.when(F.col("o.operation") == "ADD", stamp).otherwise(F.col("o.target_id")).alias("target_id"),
        "o.content", F.col("date").alias("mentioned_at"),
    )
    return {"items": items, "suggestions": suggestions, "operations": ops, "state": M.apply_operations(ops, state)}
