"""Questions over a transaction ledger, answered by aggregation.

Transactions are ``(*keys, date, scene, subscene, amount)``. Everything starts
from ``daily``: one row per key, day and scene. That single aggregation combines
on the map side; ranges are then joined day by day to the small result, never to
the transactions.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from convoeval.functions.draws import draw
from convoeval.functions.text import money
from convoeval.operators.ordered import id_bucket, prefix_sums
from convoeval.session import cut_lineage


def daily(tx: DataFrame, keys: list[str] | None = None) -> DataFrame:
    """Amount, count and largest amount per key, day and scene."""
    return tx.groupBy(*(keys or []), "date", "scene").agg(
        F.sum("amount").alias("total"), F.count("*").alias("n"), F.max("amount").alias("largest")
    )


def _by_day(questions: DataFrame) -> DataFrame:
    return questions.withColumn("date", F.explode(F.sequence("start", "end")))


def _in_range(questions: DataFrame, days: DataFrame, on: list[str]) -> DataFrame:
    return _by_day(questions).join(days, [*on, "date"])


def _answered(questions: DataFrame, found: DataFrame, fill: Column | None = None) -> DataFrame:
    """Every question keeps a row; ``fill`` stands in for no transaction."""
    out = questions.join(found, "qid", "left")
    return out if fill is None else out.withColumn("answer", F.coalesce("answer", fill))


def spend(questions: DataFrame, days: DataFrame, keys: list[str] | None = None) -> DataFrame:
    """Money spent in ``[start, end]``; in ``scenes`` only when that array is there."""
    keys = keys or []
    if "scenes" in questions.columns:
        asked = questions.withColumn("scene", F.explode(F.array_distinct("scenes")))
        hits = _in_range(asked, days, [*keys, "scene"])
    elif keys:
        hits = _in_range(questions, days, keys)
    else:
        hits = _in_range(questions, days, [])
    sums = hits.groupBy("qid").agg(F.round(F.sum("total"), 2).alias("answer"))
    return _answered(questions, sums, F.lit(0.0))


def top_scenes(questions: DataFrame, days: DataFrame, keys: list[str] | None = None) -> DataFrame:
    """Scene or scenes with the highest spending, all ties, sorted."""
    sums = (
        _in_range(questions, days, keys or [])
        .groupBy("qid", "scene")
        .agg(F.round(F.sum("total"), 2).alias("total"))
    )
    first = F.rank().over(Window.partitionBy("qid").orderBy(F.desc("total")))
    best = sums.withColumn("_r", first).where("_r = 1").groupBy("qid").agg(
        F.array_join(F.array_sort(F.collect_list("scene")), ", ").alias("answer")
    )
    return _answered(questions, best)


def busiest_dates(days: DataFrame, keys: list[str]) -> DataFrame:
    """Date or dates with most transactions per key and scene, all ties."""
    group = [*keys, "scene"]
    most = days.groupBy(*group).agg(F.max("n").alias("most"))
    return (
        days.join(most, group)
        .where(F.col("n") == F.col("most"))
        .groupBy(*group)
        .agg(F.array_join(F.array_sort(F.collect_list(F.col("date").cast("string"))), ", ").alias("answer"))
    )


def largest_single(questions: DataFrame, days: DataFrame, keys: list[str] | None = None) -> DataFrame:
    found = _in_range(questions, days, keys or []).groupBy("qid").agg(F.max("largest").alias("answer"))
    return _answered(questions, found)


def on_date(questions: DataFrame, days: DataFrame, keys: list[str] | None = None) -> DataFrame:
    """Spending of one scene on one date, 0 without a transaction."""
    found = questions.join(days, [*(keys or []), "scene", "date"]).groupBy("qid").agg(
        F.round(F.sum("total"), 2).alias("answer")
    )
    return _answered(questions, found, F.lit(0.0))


def rollups(tx: DataFrame) -> DataFrame:
    """Totals by scene, scene-subscene, date and date-scene in one result.

    The transactions are combined to the finest level once; the four groupings
    expand only that.
    """
    fine = tx.groupBy("date", "scene", "subscene").agg(
        F.sum("amount").alias("amount"), F.count("*").alias("n")
    )
    c = {name: F.col(name) for name in ("date", "scene", "subscene")}
    sets = [[c["scene"]], [c["scene"], c["subscene"]], [c["date"]], [c["date"], c["scene"]]]
    return fine.groupingSets(sets, "date", "scene", "subscene").agg(
        F.grouping_id().cast("int").alias("level"),
        F.round(F.sum("amount"), 2).alias("amount"),
        F.sum("n").alias("n"),
    )


def summary(tx: DataFrame, keys: list[str], session: str) -> DataFrame:
    """Sessions, transactions, date range and total per key."""
    return tx.groupBy(*keys).agg(
        F.countDistinct(session).alias("num_sessions"),
        F.count("*").alias("num_transactions"),
        F.min("date").alias("start"),
        F.max("date").alias("end"),
        F.round(F.sum("amount"), 2).alias("total_amount"),
    )


def take_until(samples: DataFrame, order: str, size: str, n: int, cap: int, bucket_rows: int = 1 << 20) -> DataFrame:
    """Samples in order until their sizes reach ``n``, at most ``cap`` of them."""
    bucket = id_bucket(order, bucket_rows)
    placed = prefix_sums(
        samples, [], [order], bucket, _sum=F.col(size).cast("long"), _row=F.lit(1).cast("long")
    )
    return placed.where((F.col("_sum") - F.col(size) < n) & (F.col("_row") <= cap)).drop("_sum", "_row")


def sample_dates(first: Column, last: Column, n: int, seed: int) -> Column:
    """``n`` distinct sorted days of a range, chosen by hash."""
    days = F.sequence(first, last)
    keyed = F.transform(days, lambda d: F.struct(draw(seed, d).alias("h"), d.alias("d")))
    return F.array_sort(F.transform(F.slice(F.array_sort(keyed), 1, n), lambda s: s["d"]))


def _pick(n: Column, *parts: Column) -> Column:
    return (draw(0, *parts) % n).cast("int")


def make_questions(tx: DataFrame, scenes: list[str], per_type: int = 5, seed: int = 0) -> DataFrame:
    """Question rows with computed answers per task.

    Ranges come from the days that occur in a task; equal question texts keep the
    first. Answers are text, money with two decimals.
    """
    days = cut_lineage(daily(tx, ["task_id"]))  # read by every question type, made once
    task_days = days.groupBy("task_id").agg(F.array_sort(F.collect_set("date")).alias("days"))
    types = [
        "time_range_scene_amount", "time_range_multiple_scenes_amount", "time_range_total_amount",
        "max_scene", "max_frequency_date", "max_single_amount", "single_date_scene_amount",
    ]
    drawn = (
        task_days.withColumn("category", F.explode(F.array(*[F.lit(t) for t in types])))
        .withColumn("draw", F.explode(F.sequence(F.lit(1), F.lit(per_type))))
    )
    n = F.size("days")
    at = [F.col("task_id"), F.col("category"), F.col("draw"), F.lit(seed)]
    scene_list = F.array(*[F.lit(s) for s in scenes])
    lo = _pick(n - 1, *at, F.lit("start"))
    drawn = drawn.withColumn("_lo", F.when(n >= 2, lo))
    hi = F.col("_lo") + 1 + _pick(n - 1 - F.col("_lo"), *at, F.lit("end"))
    shuffled = F.array_sort(
        F.transform(scene_list, lambda s: F.struct(draw(0, *at, s).alias("h"), s.alias("s")))
    )
    drawn = drawn.withColumns(
        {
            "start": F.get("days", F.col("_lo")),
            "end": F.get("days", hi),
            "date": F.get("days", _pick(n, *at, F.lit("day"))),
            "_mixed": F.transform(shuffled, lambda s: s["s"]),
            "_many": 2 + _pick(F.lit(2), *at, F.lit("many")),
        }
    )
    drawn = drawn.withColumns(
        {
            "scene": F.get("_mixed", F.lit(0)),
            "scenes": F.slice("_mixed", F.lit(1), F.col("_many")),
            "qid": F.concat_ws("_", "task_id", "category", "draw"),
        }
    ).drop("days", "_lo", "_mixed", "_many")
    ranged = drawn.where("start IS NOT NULL")
    span = F.concat(F.lit(" from "), F.col("start").cast("string"), F.lit(" to "), F.col("end").cast("string"), F.lit("?"))

    def of(category: str, source: DataFrame = ranged) -> DataFrame:
        return source.where(F.col("category") == category)

    def done(answered: DataFrame, text: Column, answer: Column) -> DataFrame:
        kept = answered.where(F.col("answer").isNotNull())
        return kept.select("task_id", "category", "draw", text.alias("query"), answer.alias("answer"))

    key = ["task_id"]
    amount = money(F.col("answer"))
    one = of(types[0]).withColumn("scenes", F.array("scene"))
    parts = [
        done(spend(one, days, key), F.concat(F.lit("How much was spent on "), F.col("scene"), span), amount),
        done(
            spend(of(types[1]), days, key),
            F.concat(F.lit("How much was spent on "), F.array_join("scenes", ", "), F.lit(" in total"), span),
            amount,
        ),
        done(spend(of(types[2]).drop("scenes"), days, key), F.concat(F.lit("What was the total spending"), span), amount),
        done(
            top_scenes(of(types[3]).drop("scene"), days, key),
            F.concat(F.lit("Which scene had the highest spending"), span),
            F.col("answer"),
        ),
        done(
            of(types[4]).drop("date").join(busiest_dates(days, key), ["task_id", "scene"]),
            F.concat(F.lit("On which date were there the most "), F.col("scene"), F.lit(" transactions?")),
            F.col("answer"),
        ),
        done(
            largest_single(of(types[5]).drop("scene"), days, key),
            F.concat(F.lit("What was the largest single transaction amount"), span),
            amount,
        ),
        done(
            on_date(of(types[6], drawn), days, key),
            F.concat(F.lit("How much was spent on "), F.col("scene"), F.lit(" on "), F.col("date").cast("string"), F.lit("?")),
            amount,
        ),
    ]
    total = days.groupBy("task_id").agg(F.sum("total").alias("answer")).select(
        "task_id", F.lit("total_amount").alias("category"), F.lit(1).alias("draw"),
        F.lit("What is the total spending across all records?").alias("query"), amount.alias("answer"),
    )
    union = total
    for part in parts:
        union = union.unionByName(part)
    return (
        union.groupBy("task_id", "query")
        .agg(F.min_by(F.struct("category", "answer", "draw"), F.struct("category", "draw")).alias("_b"))
        .select("task_id", "query", "_b.category", "_b.answer", "_b.draw")
    )
