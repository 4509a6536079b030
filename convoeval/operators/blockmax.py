"""Exact BM25 top k over postings in blocks, where blocks that cannot enter are skipped.

A block holds the postings of one term for a stretch of documents, with the largest term count and the
smallest length in it. Both together bound what the term can add to any document of the stretch, whatever
the mean length is. Per query the bounds of its terms add up to a bound of the stretch: the best stretches
are scored first, their k-th best score is what the others have to reach.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from convoeval.operators.ordered import top_per_key
from convoeval.session import cut_lineage


def raw_idf(n: Column, df: Column) -> Column:
    return F.log(n - df + 0.5) - F.log(df + 0.5)


def floored_idf(n: Column, df: Column, mean: Column, epsilon: float) -> Column:
    """Okapi idf; a negative one becomes a small share of the mean idf."""
    raw = raw_idf(n, df)
    return F.when(raw < 0, F.lit(epsilon) * mean).otherwise(raw)


def saturation(tf: Column, length: Column, avg_len: Column, k1: float, b: float) -> Column:
    return tf * (k1 + 1) / (tf + k1 * (1 - b + b * length / avg_len))


def term_counts(rows: DataFrame, mark: bool = False) -> DataFrame:
    """Terms of ``rows(..., t)`` with their count: ``(..., len, term, tf)``.

    ``t`` are the tokens of a text and ``len`` their number. A text lies in one batch, so its terms
    are counted where they are and nothing is shuffled. With ``mark`` every text gives one more row,
    with a null term.
    """
    kept = [c for c in rows.columns if c != "t"]
    schema = ", ".join(f"`{c}` {kind}" for c, kind in rows.dtypes if c != "t") + ", len long, term string, tf long"

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            step = max(1, whole.num_rows * (4 << 20) // max(1, whole.column("t").nbytes))
            for at in range(0, whole.num_rows, step):
                batch = whole.slice(at, step)
                toks = batch.column("t")
                sizes = pc.fill_null(pc.list_value_length(toks), 0).to_numpy(zero_copy_only=False).astype("i8")
                coded = pc.list_flatten(toks).cast(pa.string()).dictionary_encode()
                terms = max(1, len(coded.dictionary))
                pair, tf = np.unique(np.repeat(np.arange(len(sizes)), sizes) * terms + coded.indices.to_numpy(zero_copy_only=False), return_counts=True)
                row, code = np.divmod(pair, terms)
                if mark:
                    row, tf = np.append(row, np.arange(len(sizes))), np.append(tf, np.zeros(len(sizes), "i8"))
                term = coded.dictionary.take(pa.array(code))
                if mark:
                    term = pa.concat_arrays([term, pa.nulls(len(sizes), pa.string())])
                yield pa.RecordBatch.from_arrays(
                    [*(batch.column(c).take(pa.array(row)) for c in kept), pa.array(sizes[row]), term, pa.array(tf.astype("i8"))], [*kept, "len", "term", "tf"])

    return rows.mapInArrow(count, schema)


def in_blocks(counted: DataFrame, keys: list[str], doc: str, dealt: list[str] | None = None, parts: int = 1) -> DataFrame:
    """Postings ``(keys, tf, len, doc)`` as one row a block: ``(keys, n, max_tf, min_len, docs)``, documents in order.

    The rows are shuffled by ``dealt`` (the keys, where it is left out) to ``parts`` partitions at least, sorted,
    and cut into blocks as they stream by. A block must be of bounded size; null keys are equal to each other.
    """
    types = dict(counted.dtypes)
    schema = ", ".join(f"`{k}` {types[k]}" for k in keys) + f", n long, max_tf long, min_len long, docs array<struct<id: {types[doc]}, tf: long, len: long>>"
    n_parts = max(parts, int(counted.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    rows = counted.select(*keys, F.col("tf").cast("long"), F.col("len").cast("long"), F.col(doc).alias("_id"))
    ordered = rows.repartition(n_parts, *(dealt or keys)).sortWithinPartitions(*keys, "_id")

    def differs(column: pa.ChunkedArray) -> np.ndarray:
        x, y = column[1:], column[:-1]
        both_null = pc.and_(pc.is_null(x), pc.is_null(y))
        return pc.if_else(both_null, False, pc.fill_null(pc.not_equal(x, y), True)).to_numpy()

    def starts_of(table: pa.Table) -> np.ndarray:
        return np.flatnonzero(np.concatenate(([True], np.logical_or.reduce([differs(table.column(k)) for k in keys]))))

    def blocks(table: pa.Table, starts: np.ndarray) -> pa.RecordBatch:
        ends = np.append(starts[1:], table.num_rows)
        first = table.select(keys).take(pa.array(starts)).combine_chunks()
        tf, size, ids = (table.column(c).combine_chunks() for c in ("tf", "len", "_id"))
        docs = pa.ListArray.from_arrays(pa.array(np.append(starts, table.num_rows), pa.int32()), pa.StructArray.from_arrays([ids, tf, size], ["id", "tf", "len"]))
        return pa.RecordBatch.from_arrays(
            [*(first.column(k).combine_chunks() for k in keys), pa.array(ends - starts), pa.array(np.maximum.reduceat(tf.to_numpy(), starts)),
             pa.array(np.minimum.reduceat(size.to_numpy(), starts)), docs], [*keys, "n", "max_tf", "min_len", "docs"])

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = None
        for batch in batches:
            if not batch.num_rows:
                continue
            table = pa.Table.from_batches([batch])
            table = table if held is None else pa.concat_tables([held, table])
            starts = starts_of(table)
            if len(starts) > 1:  # the last block may go on in the next batch
                yield blocks(table.slice(0, int(starts[-1])), starts[:-1])
            held = table.slice(int(starts[-1]))
        if held is not None:
            yield blocks(held, np.array([0]))

    return ordered.mapInArrow(cut, schema)


def stretch_bounds(asked: DataFrame, heads: DataFrame, scope: list[str], k1: float, b: float) -> DataFrame:
    """``(qid, block, bound)``: what no document of the stretch can exceed; stretches without a term are left out.

    ``asked(qid, scope, term, weight, avg_len, last)``: ``last`` is the last stretch that a query sees,
    null for all. ``heads(scope, term, block, max_tf, min_len)``.
    """
    met = asked.join(heads, [*scope, "term"]).where(F.col("last").isNull() | (F.col("block") <= F.col("last")))
    most = F.greatest(F.col("weight"), F.lit(0.0)) * saturation(F.col("max_tf"), F.col("min_len"), F.col("avg_len"), k1, b)
    return met.groupBy("qid", "block").agg(F.sum(most).alias("bound"))


def scores_in(stretches: DataFrame, asked: DataFrame, blocks: DataFrame, scope: list[str], k1: float, b: float) -> DataFrame:
    """``(qid, id, score)`` of the documents of ``stretches(qid, block)`` that hold a term of the query.

    ``asked`` has besides the last document ``upto`` that a query sees, null for all.
    """
    wanted = stretches.select("qid", "block").join(asked, "qid")
    rows = wanted.join(blocks.select(*scope, "term", "block", "docs"), [*scope, "term", "block"]).select(
        "qid", "weight", "avg_len", "upto", F.explode("docs").alias("d"))
    part = F.col("weight") * saturation(F.col("d.tf"), F.col("d.len"), F.col("avg_len"), k1, b)
    return rows.where(F.col("upto").isNull() | (F.col("d.id") <= F.col("upto"))).groupBy("qid", F.col("d.id").alias("id")).agg(
        F.round(F.sum(part), 9).alias("score"))


def reachable(asked: DataFrame, blocks: DataFrame, scope: list[str], k: int, first: int, k1: float, b: float) -> tuple[DataFrame, DataFrame]:
    """Scores of all documents that can be among the best ``k`` above zero, and the stretches that were left.

    A query with fewer than ``k`` documents above zero in its ``first`` best stretches has all its stretches
    scored, so all documents with a term are there. For the others a stretch is left out only if its bound
    is below the k-th best score found (scores are compared at nine decimals).
    """
    bounds = cut_lineage(stretch_bounds(asked, blocks.drop("docs"), scope, k1, b))
    ranked = top_per_key(bounds, ["qid"], [F.desc("bound"), F.asc("block")], first, "_place")
    best = cut_lineage(ranked.select("qid", "block"))
    early = cut_lineage(scores_in(best, asked, blocks, scope, k1, b))
    floor = top_per_key(early.where("score > 0"), ["qid"], [F.desc("score")], k, "_place").groupBy("qid").agg(
        F.min("score").alias("floor"), F.count(F.lit(1)).alias("_n")).where(F.col("_n") >= k).drop("_n")
    rest = cut_lineage(bounds.join(best, ["qid", "block"], "left_anti").join(floor, "qid", "left").where(
        F.col("floor").isNull() | (F.col("bound") + 1e-9 >= F.col("floor"))))
    return cut_lineage(early.unionByName(scores_in(rest, asked, blocks, scope, k1, b))), rest
