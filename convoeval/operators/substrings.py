"""Substring search over many items with a stored trigram index.

A word of three or more characters can only stand in an item that holds all its trigrams, so its rarest
trigrams give few candidates and the text itself decides. Each different word is looked up once, however many
queries have it, and only items with a hit become rows. Few words that are asked once need no index: they are
counted in one pass over the texts.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from convoeval.functions.text import occurrences, words
from convoeval.operators.ordered import numbered_by_range, top_per_key
from convoeval.session import cut_lineage, work_folder

#: Trigrams of a word that are intersected, the rarest ones.
RAREST = 3

#: Lines of one posting list: two to this power.
STRETCH_BITS = 12


#: Different words that one pass over the texts counts faster than an index is built.
SCANNED_WORDS = 128


@dataclass(frozen=True)
class TrigramIndex:
    """``path/items``: line, the ids, content, low; ``path/grams/bucket=<b>``: gram, stretch, n, lines."""

    spark: SparkSession
    path: str
    ids: tuple[str, ...]
    buckets: int

    @property
    def items(self) -> DataFrame:
        return self.spark.read.parquet(f"{self.path}/items")

    @property
    def grams(self) -> DataFrame:
        return self.spark.read.parquet(f"{self.path}/grams")


def _bucket(gram: Column, buckets: int) -> Column:
    return F.pmod(F.xxhash64(gram), F.lit(buckets)).cast("int")


def grams_of(text: str) -> set[str]:
    return {text[i : i + 3] for i in range(len(text) - 2)}


def build_trigrams(items: DataFrame, ids: list[str], path: str | None = None, buckets: int = 64) -> TrigramIndex:
    """Writes the index of ``items(ids, content)``; null contents are not searched."""
    spark = items.sparkSession
    path = path or work_folder(spark, "trigrams")
    rows = items.where("content IS NOT NULL").select(F.monotonically_increasing_id().alias("line"), *ids, "content", F.lower("content").alias("low"))
    rows.write.mode("overwrite").parquet(f"{path}/items")

    def spread(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 500):
                lines, found = [], []
                part = batch.slice(at, 500)
                for line, low in zip(part.column("line").to_pylist(), part.column("low"), strict=True):
                    own = grams_of(low.as_py())
                    found += own
                    lines += [line] * len(own)
                yield pa.RecordBatch.from_arrays([pa.array(lines, pa.int64()), pa.array(found, pa.string())], ["line", "gram"])

    pairs = spark.read.parquet(f"{path}/items").select("line", "low").mapInArrow(spread, "line long, gram string")
    lists = pairs.groupBy("gram", F.shiftright("line", STRETCH_BITS).alias("stretch")).agg(
        F.count(F.lit(1)).alias("n"), F.array_sort(F.collect_list("line")).alias("lines"))
    bucket = _bucket(F.col("gram"), buckets)
    lists.withColumn("bucket", bucket).sortWithinPartitions("bucket", "gram").write.mode("overwrite").partitionBy("bucket").parquet(f"{path}/grams")
    return TrigramIndex(spark, path, tuple(ids), buckets)


def candidates(asked: DataFrame, index: TrigramIndex) -> DataFrame:
    """``(word, line)`` that have the rarest trigrams of each ``asked(word)`` of three or more characters."""

    @F.arrow_udf("array<string>")
    def split(words: pa.Array) -> pa.Array:
        return pa.array([sorted(grams_of(w)) for w in words.to_pylist()], pa.list_(pa.string()))

    wanted = cut_lineage(asked.where(F.char_length("word") >= 3).select("word", F.explode(split("word")).alias("gram")))
    met = [r["b"] for r in wanted.select(_bucket(F.col("gram"), index.buckets).alias("b")).distinct().collect()]  # at most ``buckets``
    lists = index.grams.where(F.col("bucket").isin(met))
    df = lists.join(wanted.select("gram").distinct(), "gram").groupBy("gram").agg(F.sum("n").alias("df"))
    known = wanted.join(df, "gram", "left").withColumn("df", F.coalesce("df", F.lit(0)))
    rare = cut_lineage(top_per_key(known, ["word"], [F.asc("df"), F.asc("gram")], RAREST, "_place"))
    needed = rare.groupBy("word").agg(F.count(F.lit(1)).alias("_need"), F.min("df").alias("_least")).where("_least > 0")
    return (
        rare.select("word", "gram").join(needed.select("word", "_need"), "word").join(lists.select("gram", "stretch", "lines"), "gram")
        .groupBy("word", "stretch", "_need").agg(F.flatten(F.collect_list("lines")).alias("_l"))  # at most RAREST lists
        .select("word", "_need", F.explode("_l").alias("line")).groupBy("word", "line", "_need").agg(F.count(F.lit(1)).alias("_n"))
        .where(F.col("_n") == F.col("_need")).select("word", "line")
    )


def found_words(asked: DataFrame, index: TrigramIndex) -> DataFrame:
    """``(word, line, times)``: how often each distinct ``asked(word)`` stands in an item, where it does.

    Words of one or two characters have no trigram: all items are tested for them, in one pass.
    """
    items = index.items.select("line", "low")
    long = candidates(asked, index).join(items, "line").select("word", "line", occurrences(F.col("low"), F.col("word")).alias("times"))
    short = asked.where(F.char_length("word") < 3).agg(F.collect_set("word").alias("w"))  # pairs of characters at most
    tested = items.withColumn("_w", short.select("w").scalar()).select(
        "line", "low", F.explode(F.filter("_w", lambda w: F.contains("low", w))).alias("word"))
    return long.unionByName(tested.select("word", "line", occurrences(F.col("low"), F.col("word")).alias("times"))).where("times > 0")


def _asked(queries: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Words of ``queries(qid, text)`` with their number, and the queries with their size."""
    split = queries.select("qid", words(F.lower("text")).alias("w")).where(F.size("w") > 0)
    each = split.select("qid", F.size("w").alias("size"), F.explode("w").alias("word"))
    return cut_lineage(each.groupBy("qid", "size", "word").agg(F.count(F.lit(1)).alias("qtf"))), split.select("qid")


def scanned_words(asked: list[str], items: DataFrame) -> DataFrame:
    """``found_words`` for few words, with the other columns of ``items(line, ..., low)``: each text is read once."""
    kept = [c for c in items.columns if c != "low"]
    schema = ", ".join(f"`{c}` {kind}" for c, kind in items.dtypes if c != "low") + ", word string, times long"

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for word in asked:
                times = pc.count_substring(batch.column("low"), word).to_numpy(zero_copy_only=False).astype("i8")
                at = np.flatnonzero(times)
                if len(at):
                    own = batch.select(kept).take(pa.array(at))
                    yield pa.RecordBatch.from_arrays([*own.columns, pa.array([word] * len(at), pa.string()), pa.array(times[at])], [*kept, "word", "times"])

    return items.mapInArrow(count, schema)


def _hits(items: DataFrame | TrigramIndex, each: DataFrame, ids: list[str]) -> tuple[DataFrame, DataFrame]:
    """``(word, line, ids, times)`` of the asked words, and the items."""
    asked = each.select("word").distinct()
    words = [] if isinstance(items, TrigramIndex) else [r["word"] for r in asked.limit(SCANNED_WORDS + 1).collect()]
    if not isinstance(items, TrigramIndex) and len(words) <= SCANNED_WORDS:
        # written, so that a line keeps its number
        path = work_folder(items.sparkSession, "items")
        items.where("content IS NOT NULL").select(F.monotonically_increasing_id().alias("line"), *ids, "content").write.parquet(path)
        rows = items.sparkSession.read.parquet(path)
        return scanned_words(words, rows.select("line", *ids, F.lower("content").alias("low"))), rows
    index = items if isinstance(items, TrigramIndex) else build_trigrams(items, ids)
    return found_words(asked, index).join(index.items.select("line", *index.ids), "line"), index.items


def keyword_score_topk(items: DataFrame | TrigramIndex, queries: DataFrame, ids: list[str], k: int = 5) -> DataFrame:
    """Share of the query words that occur in an item, above zero only: ``(qid, ids, content, score, rank)``."""
    each, _ = _asked(queries)
    found, rows = _hits(items, each, ids)
    scored = each.join(found, "word").groupBy("qid", "line", *ids).agg(F.round(F.sum("qtf") / F.max("size"), 9).alias("score"))
    return _ranked(scored, rows, ids, k)


def term_frequency_topk(items: DataFrame | TrigramIndex, queries: DataFrame, ids: list[str], k: int = 5) -> DataFrame:
    """Occurrences of the query words in an item; zero scores stay in, the first items first."""
    each, every = _asked(queries)
    found, rows = _hits(items, each, ids)
    scored = cut_lineage(each.join(found, "word").groupBy("qid", "line", *ids).agg(F.sum(F.col("qtf") * F.col("times")).alias("score")))
    counts = scored.groupBy("qid").agg(F.count(F.lit(1)).alias("_hits"))
    # of the first k + hits items at least k have no hit; with k hits no other is needed
    short = cut_lineage(every.join(counts, "qid", "left").withColumn("_hits", F.coalesce("_hits", F.lit(0))).where(F.col("_hits") < k))
    most = short.agg(F.max("_hits").alias("m")).first()["m"]
    if most is not None:
        first = rows.select("line", F.struct(*ids).alias("_id")).orderBy("_id").limit(int(most) + k)
        first = numbered_by_range(first, "_id", "_row").select("_row", "line", "_id.*")
        near = short.select("qid", F.explode(F.sequence(F.lit(1).cast("long"), F.col("_hits") + k)).alias("_row")).join(first, "_row")
        pads = near.join(scored.select("qid", "line"), ["qid", "line"], "left_anti").select("qid", "line", *ids, F.lit(0).cast("long").alias("score"))
        scored = scored.unionByName(pads)
    return _ranked(scored, rows, ids, k)


def _ranked(scored: DataFrame, rows: DataFrame, ids: list[str], k: int) -> DataFrame:
    best = top_per_key(scored, ["qid"], [F.desc("score"), *[F.asc(i) for i in ids]], k)
    return best.join(rows.select("line", "content"), "line").select("qid", *ids, "content", "score", "rank")
