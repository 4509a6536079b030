"""Filter interaction audit: what each filter removes, in every order of the filters.

Each filter has one table of failing ids. The documents that a set of filters leaves are those left after a
left-anti join with each of its tables, and a filter's own failures are a left-semi join with its table. An
order's step adds one filter to a set, so all orders together see only the 2^n sets: one left-anti join a
filter, over a row's copies for the sets that hold the filter, gives the survivors of every set, and removals,
redundancies and label losses of a step are differences between two neighbouring sets.
"""

from __future__ import annotations

import json
from functools import reduce
from itertools import permutations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from convoeval.llm.common import BLANKS, stored

#: Rows of a failing-id table that one task joins, about.
ROWS_PER_TASK = 500_000


def failures(docs: DataFrame) -> DataFrame:
    """``docs(doc_id, text, source)`` as (doc_id, part, A, B, C, D, E): which filters a document fails.

    A: under 50 words. B: 100 x distinct words < 65 x words. C: 100 x capitals A-Z > 5 x code points.
    D: holds one of ``#$%&*|``. E: the text of a document with a smaller doc_id is the same. Words are
    maximal runs without white space, case-sensitive. Null texts are empty, a null source is the part ''.
    A row without doc_id fails E never and makes no other fail. Every row comes back, repeated rows too
    (equal doc_ids are not smaller than each other); no rows give none.
    """
    text = F.coalesce("text", F.lit(""))
    words = F.split(F.btrim(F.regexp_replace(text, r"[\t-\r ]+", " "), F.lit(BLANKS)), " ", -1)
    read = docs.select(
        "doc_id", F.coalesce("source", F.lit("")).alias("part"), F.unhex(F.sha2(text, 256)).alias("sha"),
        F.char_length(text).alias("chars"), F.regexp_count(text, F.lit("[A-Z]")).alias("capitals"),
        text.rlike(r"[#$%&*|]").alias("D"), words.alias("words"),
    )
    blank = F.element_at("words", 1) == ""  # of an empty text
    n = F.when(blank, 0).otherwise(F.size("words"))
    distinct = F.when(blank, 0).otherwise(F.size(F.array_distinct("words")))
    rows = stored(read.select(
        "doc_id", "part", "sha", (n < 50).alias("A"), (100 * distinct.cast("long") < 65 * n.cast("long")).alias("B"),
        (100 * F.col("capitals").cast("long") > 5 * F.col("chars").cast("long")).alias("C"), "D"), "audit-rows")
    # (written, so that the join below shuffles both sides anew and Spark can split a text with very many copies)
    first = stored(rows.groupBy("sha").agg(F.min("doc_id").alias("first"), F.max("doc_id").alias("last")).where("first < last")
                   .select(F.col("sha").alias("same"), "first"), "audit-first")
    return rows.join(first, F.col("sha") == F.col("same"), "left").select(
        "doc_id", "part", "A", "B", "C", "D", F.coalesce(F.col("doc_id") > F.col("first"), F.lit(False)).alias("E"))


def prefix_counts(rows: DataFrame, names: list[str]) -> DataFrame:
    """(part, kind, mask, n, good, toxic) over ``rows(part, good, toxic, one boolean column a filter)``.

    Only rows that fail a filter are looked at. ``kind`` is 'left' for those that the filters of the bits in
    ``mask`` leave, 'fails' for those that fail the one filter in ``mask``.
    """
    marked = stored(rows.where(reduce(lambda a, b: a | b, [F.col(c) for c in names])).withColumn("row", F.monotonically_increasing_id()), "audit-failing")
    parts = max(8, -(-marked.count() // ROWS_PER_TASK))
    every = marked.select("row", "part", "good", "toxic").repartition(parts, "row")
    # dealt by id once: the shuffles are reused by all joins, which then need none of their own
    ids = [marked.where(F.col(c)).select("row").repartition(parts, "row") for c in names]

    # each join takes its filter's failures from those copies of a row whose set has the filter
    survivors = every.withColumn("mask", F.lit(0))
    for i, failing in enumerate(ids):
        copies = survivors.withColumn("mask", F.explode(F.array("mask", F.col("mask") + (1 << i))))
        failing = failing.withColumnRenamed("row", "failed")
        survivors = copies.join(failing, (F.col("row") == F.col("failed")) & (F.col("mask") >= 1 << i), "left_anti")
    found = [survivors.select(F.lit("left").alias("kind"), "mask", "part", "good", "toxic")]
    for i, failing in enumerate(ids):
        found.append(every.join(failing, "row", "left_semi").select(F.lit("fails").alias("kind"), F.lit(1 << i).alias("mask"), "part", "good", "toxic"))
    return reduce(DataFrame.unionAll, found).groupBy("part", "kind", "mask").agg(
        F.count(F.lit(1)).alias("n"), F.sum("good").alias("good"), F.sum("toxic").alias("toxic"))


def audit(rows: DataFrame, labels: DataFrame, names: list[str]) -> DataFrame:
    """One row per part, order of all the filters ``names`` and step, with the counts of that step.

    ``rows(doc_id, part, one boolean column a filter)``: true where the document fails. ``labels(doc_id,
    quality, toxic)``: a document is good or toxic where any of its labels says 1; without a label neither.
    Columns: part, filter_order, step, kept (after the step), removed, redundant (failing the step's filter
    but removed before), unique_fails (failing that filter only), good_lost and toxic_lost (of the removed),
    shapley (the filter's removals added up over all orders). Every part has all orders and steps, zeros
    included; every row counts as a document; no rows give none.
    """
    marks = labels.groupBy(F.col("doc_id").alias("labelled")).agg(
        F.max((F.col("quality") == 1).cast("long")).alias("good"), F.max((F.col("toxic") == 1).cast("long")).alias("toxic"))
    rows = stored(rows.select("doc_id", "part", *names), "audit-flags")
    whole = rows.groupBy("part").agg(F.count(F.lit(1)).alias("docs"))
    labelled = rows.join(marks, F.col("doc_id") == F.col("labelled"), "left").select(
        "part", *names, *[F.coalesce(c, F.lit(0)).alias(c) for c in ("good", "toxic")])
    counts = prefix_counts(labelled, names)
    key = F.struct("kind", "mask")
    by_part = counts.groupBy("part").agg(F.map_from_entries(F.collect_list(F.struct(key, F.struct("n", "good", "toxic")))).alias("at"))  # 2^n + n entries

    full = (1 << len(names)) - 1
    steps = [{"filter_order": "".join(order), "step": i + 1, "own": 1 << names.index(f), "before": sum(1 << names.index(x) for x in order[:i])}
             for order in permutations(names) for i, f in enumerate(order)]
    literal = F.from_json(F.lit(json.dumps(steps)), "array<struct<filter_order: string, step: int, own: int, before: int>>")

    def at(kind, mask, what="n"):
        return F.coalesce(F.try_element_at("at", F.struct(F.lit(kind).alias("kind"), mask.cast("int").alias("mask")))[what], F.lit(0))

    own, before = F.col("own"), F.col("before")
    after = before.bitwiseOR(own)
    others = F.lit(full) - own
    grid = whole.join(by_part, "part", "left").select("part", "docs", "at", F.explode(literal).alias("s")).select("part", "docs", "at", "s.*")
    done = grid.select(
        "part", "filter_order", "step", "own", (F.col("docs") - at("left", F.lit(0)) + at("left", after)).alias("kept"),
        (at("left", before) - at("left", after)).alias("removed"), at("fails", own).alias("failing"),
        (at("left", others) - at("left", F.lit(full))).alias("unique_fails"),
        *[(at("left", before, c) - at("left", after, c)).alias(f"{c}_lost") for c in ("good", "toxic")])
    total = done.groupBy("part", "own").agg(F.sum("removed").alias("shapley"))
    return done.join(total, ["part", "own"]).select(
        "part", "filter_order", "step", "kept", "removed", (F.col("failing") - F.col("removed")).alias("redundant"),
        "unique_fails", "good_lost", "toxic_lost", "shapley")
