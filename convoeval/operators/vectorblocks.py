"""Exact cosine top k over vectors in blocks, where blocks that cannot enter are skipped.

A block has a centre and the largest distance of its vectors from it. For a unit query q and any x of the
block, q.x = q.centre + q.(x - centre) is at most q.centre + radius. The blocks with the best bounds are
looked through first; the others have to reach the k-th best cosine found there.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from convoeval.operators.ordered import top_per_key
from convoeval.session import cut_lineage


VECTOR = T.ArrayType(T.DoubleType())


def _rows(lists: pa.Array) -> Iterator[np.ndarray]:
    values, offsets = lists.values.to_numpy(zero_copy_only=False), lists.offsets.to_numpy()
    return (values[a:b] for a, b in zip(offsets[:-1], offsets[1:], strict=True))


def _lists(rows: list[np.ndarray]) -> pa.Array:
    sizes = np.cumsum([0, *map(len, rows)])
    return pa.ListArray.from_arrays(pa.array(sizes, pa.int32()), pa.array(np.concatenate(rows) if rows else np.zeros(0)))


@F.arrow_udf(VECTOR)
def units(vectors: pa.Array) -> pa.Array:
    """Vectors at length 1; a zero vector stays. Scaled first, so that no square over- or underflows."""
    out = []
    for x in _rows(vectors.cast(pa.list_(pa.float64()))):
        x = x / m if len(x) and (m := np.abs(x).max()) > 0 else x
        out.append(x / n if (n := np.sqrt(x @ x)) > 0 else x)
    return _lists(out)


@F.arrow_udf(T.StructType([T.StructField("centre", VECTOR), T.StructField("radius", T.DoubleType())]))
def ball(vectors: pa.Array, counts: pa.Array) -> pa.Array:
    """Centre and radius of each row of vectors, which lie one after another."""
    centres, radii = [], []
    for x, n in zip(_rows(vectors), counts.to_pylist(), strict=True):
        x = x.reshape(n, -1)
        centres.append(x.mean(axis=0))
        radii.append(float(np.sqrt(((x - centres[-1]) ** 2).sum(axis=1).max())))
    return pa.StructArray.from_arrays([_lists(centres), pa.array(radii)], ["centre", "radius"])


@F.arrow_udf(VECTOR)
def dots(queries: pa.Array, vectors: pa.Array) -> pa.Array:
    """Products of each row's query with each of its vectors, which lie one after another."""
    return _lists([x.reshape(-1, len(q)) @ q if len(q) else np.zeros(0) for q, x in zip(_rows(queries), _rows(vectors), strict=True)])


def pack(vectors: DataFrame, keys: list[str]) -> DataFrame:
    """``vectors(keys, id, embedding)`` as one row a block: ``(keys, ids, x, centre, radius)``.

    ``keys`` name a block of bounded size. Vectors have one length; null and empty ones are left out.
    """
    rows = vectors.where(F.size("embedding") > 0).select(*keys, "id", units("embedding").alias("v"))
    grouped = rows.groupBy(*keys).agg(F.array_sort(F.collect_list(F.struct("id", "v"))).alias("d"))
    flat = grouped.select(*keys, F.col("d.id").alias("ids"), F.flatten("d.v").alias("x"))
    return flat.withColumn("_b", ball("x", F.size("ids"))).select(*keys, "ids", "x", "_b.centre", "_b.radius")


def _found(pairs: DataFrame, asked: DataFrame, blocks, scope: list[str]) -> DataFrame:
    """``(qid, id, score)`` of the vectors that the blocks in ``pairs(qid, block)`` hold, up to each query's ``upto``."""
    blocks = blocks(pairs) if callable(blocks) else blocks
    rows = pairs.select("qid", "block").join(asked, "qid").join(blocks.select(*scope, "block", "ids", "x"), [*scope, "block"])
    scored = rows.select("qid", "upto", "ids", dots("q", "x").alias("s")).select(
        "qid", "upto", F.explode(F.arrays_zip("ids", "s")).alias("z"))
    seen = F.col("upto").isNull() | (F.col("z.ids") <= F.col("upto"))
    return scored.where(seen).select("qid", F.col("z.ids").alias("id"), F.round("z.s", 9).alias("score"))


def block_topk(asked: DataFrame, blocks, scope: list[str], bounds, k: int, first: int = 4) -> tuple[DataFrame, DataFrame]:
    """Best ``k`` vectors of each query, ``(qid, id, score, rank)``, and the blocks ``(qid, block)`` looked through.

    ``asked(qid, scope, q, upto)``: a unit vector, and the last id it sees or null. ``bounds(floor)`` gives
    ``(qid, block, bound)``; with ``floor(qid, floor)`` only rows whose bound reaches it are needed.
    ``blocks`` are those of ``pack``, or a function that gives the ones for some ``(qid, block)``.
    """
    early = bounds(None)
    best = cut_lineage(top_per_key(early, ["qid"], [F.desc("bound"), F.asc("block")], first, "_place").select("qid", "block"))
    order = [F.desc("score"), F.asc("id")]
    found = cut_lineage(top_per_key(_found(best, asked, blocks, scope), ["qid"], order, k).drop("rank"))
    floor = found.groupBy("qid").agg(F.min("score").alias("floor"), F.count(F.lit(1)).alias("_n")).where(F.col("_n") >= k).drop("_n")
    rest = cut_lineage(bounds(floor).join(best, ["qid", "block"], "left_anti").select("qid", "block"))
    every = found.unionByName(_found(rest, asked, blocks, scope))
    return top_per_key(every, ["qid"], order, k), best.unionByName(rest)


def reaching(bounds: DataFrame, floor: DataFrame | None) -> DataFrame:
    if floor is None:
        return bounds
    return bounds.join(floor, "qid", "left").where(F.col("floor").isNull() | (F.col("bound") + 1e-9 >= F.col("floor"))).drop("floor")


def semantic_scoped_topk(questions: DataFrame, chunks: DataFrame, k: int, size: int = 64, first: int = 4) -> DataFrame:
    """Cosine of each question with the chunks of its task up to its position, best ``k`` first.

    ``questions(qid, task_id, position, embedding)``, ``chunks(task_id, position, embedding)``; chunks
    without a vector are not ranked. Exact: blocks of ``size`` positions are skipped by their bounds only.
    Output ``(qid, task_id, position, score, rank)``, ranked by score at nine decimals, then by position.
    """
    return scoped_search(questions, chunks, k, size, first)[0]


def scoped_search(questions: DataFrame, chunks: DataFrame, k: int, size: int, first: int) -> tuple[DataFrame, DataFrame]:
    rows = chunks.select("task_id", F.floor(F.col("position") / size).alias("block"), F.col("position").alias("id"), "embedding")
    blocks = cut_lineage(pack(rows, ["task_id", "block"]))
    asked = cut_lineage(questions.where(F.size("embedding") > 0).select("qid", "task_id", units("embedding").alias("q"), F.col("position").alias("upto")))
    heads = blocks.select("task_id", "block", "centre", "radius")
    met = asked.join(heads, "task_id").where(F.col("block") <= F.floor(F.col("upto") / size))
    bounds = cut_lineage(met.select("qid", "block", (F.element_at(dots("q", "centre"), 1) + F.col("radius")).alias("bound")))
    hits, looked = block_topk(asked, blocks, ["task_id"], lambda floor: reaching(bounds, floor), k, first)
    return hits.join(questions.select("qid", "task_id"), "qid").select("qid", "task_id", F.col("id").alias("position"), "score", "rank"), looked


# one corpus -------------------------------------------------------------------------
def head_bounds(asked: DataFrame, heads: DataFrame, floor: DataFrame | None, per_pass: int = 1 << 14) -> DataFrame:
    """``(qid, block, bound)`` of every query with every block of ``heads(block, centre, radius)``.

    The queries go to the tasks in passes of ``per_pass``; with ``floor(qid, floor)`` a task gives back only
    bounds that reach it.
    """
    schema = f"qid {dict(asked.dtypes)['qid']}, block {dict(heads.dtypes)['block']}, bound double"
    rows = asked if floor is None else asked.join(floor, "qid", "left")
    n_passes = max(1, -(-asked.count() // per_pass))
    out = None
    for number in range(n_passes):
        table = rows.where(F.pmod(F.xxhash64("qid"), F.lit(n_passes)) == number).select("qid", "q", *([] if floor is None else ["floor"])).toArrow()
        if not table.num_rows:
            continue
        least = np.full(table.num_rows, -np.inf) if floor is None else table.column("floor").to_pandas().fillna(-np.inf).to_numpy()
        q = np.array([*_rows(table.column("q").combine_chunks())])
        shared = asked.sparkSession.sparkContext.broadcast((table.column("qid").combine_chunks(), q, least))

        def run(batches: Iterator[pa.RecordBatch], shared=shared) -> Iterator[pa.RecordBatch]:
            qids, q, least = shared.value
            for whole in batches:
                for at in range(0, whole.num_rows, step := max(1, 1_000_000 // len(q))):
                    batch = whole.slice(at, step)
                    centres = np.array([*_rows(batch.column("centre"))])
                    bound = q @ centres.T + batch.column("radius").to_numpy()
                    i, j = np.nonzero(bound + 1e-9 >= least[:, None])
                    yield pa.RecordBatch.from_arrays([qids.take(pa.array(i)), batch.column("block").take(pa.array(j)), pa.array(bound[i, j])], ["qid", "block", "bound"])

        part = heads.select("block", "centre", "radius").mapInArrow(run, schema)
        out = part if out is None else out.unionByName(part)
    return out if out is not None else asked.sparkSession.createDataFrame([], schema)


def nearest_cell(vectors: DataFrame, pivots: np.ndarray) -> DataFrame:
    """``vectors(id, embedding)`` with the number of the pivot nearest by cosine; ``pivots`` are few unit vectors."""
    shared = vectors.sparkSession.sparkContext.broadcast(pivots)

    @F.arrow_udf("int")
    def cell(v: pa.Array) -> pa.Array:
        rows = [*_rows(v)]
        return pa.array((np.array(rows) @ shared.value.T).argmax(axis=1).astype("i4") if rows else np.zeros(0, "i4"))

    return vectors.where(F.size("embedding") > 0).withColumn("cell", cell(units("embedding")))
