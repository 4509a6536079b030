"""Many patterns in many texts: an automaton per key finds every pattern of the key in one pass over a text."""

from __future__ import annotations

import ahocorasick
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from convoeval.session import by_key, cut_lineage

#: Patterns of one automaton, and characters of text that one automaton reads.
PATTERNS, CHARS = 20_000, 16_000_000


def mentioned(patterns: DataFrame, texts: DataFrame, max_patterns: int = PATTERNS, max_chars: int = CHARS) -> DataFrame:
    """Distinct ``(task_id, pattern)`` of ``patterns`` that stand somewhere in a text of the same task.

    ``patterns(task_id, pattern)``, ``texts(task_id, text)``; a pattern is met as it is written. A task's
    patterns are cut into blocks of about ``max_patterns`` and its texts into parts of about ``max_chars``
    characters; each block meets each part once, so a task of any size is dealt to many. A text lies in
    one part, so a mention is never cut. The empty pattern stands in every text; null ones in none.
    """
    wanted = patterns.select("task_id", "pattern").where("pattern IS NOT NULL").distinct()
    said = texts.select("task_id", "text").where("text IS NOT NULL")
    n_blocks = wanted.groupBy("task_id").agg(F.ceil(F.count(F.lit(1)) / max_patterns).alias("_blocks"))
    n_parts = said.groupBy("task_id").agg(F.ceil((F.sum(F.char_length("text")) + 1) / max_chars).alias("_parts"))
    sizes = cut_lineage(n_blocks.join(n_parts, "task_id"))
    part = F.pmod(F.xxhash64("text"), F.col("_parts"))
    left = said.join(sizes, "task_id").select(
        "task_id", part.alias("part"), F.explode(F.sequence(F.lit(0).cast("long"), F.col("_blocks") - 1)).alias("block"), "text")
    block = F.pmod(F.xxhash64("pattern"), F.col("_blocks"))
    right = wanted.join(sizes, "task_id").select(
        "task_id", F.explode(F.sequence(F.lit(0).cast("long"), F.col("_parts") - 1)).alias("part"), block.alias("block"), "pattern")
    keys = ["task_id", "part", "block"]
    kind = dict(wanted.dtypes)["task_id"]

    def find(key: tuple, texts: pa.Table, patterns: pa.Table) -> pa.Table:
        found = hits(patterns.column("pattern").to_pylist(), texts.column("text"))
        return pa.table({"task_id": pa.array([key[0].as_py()] * len(found), patterns.schema.field("task_id").type), "pattern": pa.array(found, pa.string())})

    met = by_key(left, *keys).groupBy(*keys).cogroup(by_key(right, *keys).groupBy(*keys)).applyInArrow(find, f"task_id {kind}, pattern string")
    return met.distinct()


def hits(patterns: list[str], texts) -> list[str]:
    """The patterns that stand in one of ``texts``, an Arrow column."""
    if not patterns or not len(texts):
        return []
    tree = ahocorasick.Automaton()
    for p in filter(None, patterns):
        tree.add_word(p, p)
    found = {""} if "" in patterns else set()
    if len(tree):
        tree.make_automaton()
        for text in texts:
            found.update(p for _, p in tree.iter(text.as_py()))
            if len(found) == len(patterns):
                break
    return sorted(found)


def mentioned_facts(facts: DataFrame, talk: DataFrame, name: str = "scene") -> DataFrame:
    """Rows of ``facts(task_id, <name>, ...)`` whose name stands in the talk of their task, in any case of letters.

    Null names are mentioned nowhere.
    """
    low = facts.withColumn("_name", F.lower(name))
    heard = mentioned(low.select("task_id", F.col("_name").alias("pattern")), talk.select("task_id", F.lower("text").alias("text")))
    return low.join(heard.withColumnRenamed("pattern", "_name"), ["task_id", "_name"], "left_semi").drop("_name")
