"""Embedding near-dedup: random-hyperplane sign hashing, exact cosine, connected components.

Equal vectors are one class. The signs of ``bits`` random projections name a bucket in each of several
tables; classes of one bucket are compared by exact cosine, large buckets in pairs of blocks. A pair that
shares buckets in several tables counts in the first one only, so link counts are exact without a table
of pairs; of the links themselves only those that connect leave a task.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from convoeval.llm.common import components, stored

SEED = 77003
BLOCK = 1024
MISS = 1e-3


def plan(n: int, threshold: float, miss: float = MISS) -> tuple[int, int]:
    """(bits, tables): buckets of about one unrelated vector, and as many tables as a pair just at the
    threshold needs to meet in one of them but for the chance ``miss``."""
    bits = max(8, math.ceil(math.log2(max(n, 1))) + 1)
    meet = (1 - math.acos(threshold) / math.pi) ** bits
    return bits, math.ceil(math.log(miss) / math.log1p(-meet))


def planes(dim: int, table: int, bits: int) -> np.ndarray:
    return np.random.default_rng([SEED, dim, table]).standard_normal((dim, bits))


def buckets_of(x: np.ndarray, table: int, bits: int) -> np.ndarray:
    """A bucket number for each row of ``x``, for vectors of one length."""
    return (x @ planes(x.shape[1], table, bits) >= 0) @ (np.int64(1) << np.arange(bits, dtype=np.int64))


def scaled(x: np.ndarray) -> np.ndarray:
    """Rows with a largest component near 1, by a power of two: exact, and no square over- or underflows."""
    if not len(x):
        return x
    return np.ldexp(x, -np.frexp(np.abs(x).max(axis=1))[1][:, None])


def spanning(n: int, a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Edges (node, smallest node of its component) of the graph of n nodes with edges a-b."""
    root = np.arange(n)
    while True:
        before = root.copy()
        np.minimum.at(root, a, root[b])
        np.minimum.at(root, b, root[a])
        root = root[root]
        if (root == before).all():
            break
    node = np.flatnonzero(root != np.arange(n))
    return node, root[node]


def vector_duplicates(vectors: DataFrame, threshold: float = 0.9, miss: float = MISS) -> DataFrame:
    """``vectors(vec_id, embedding)`` as (vec_id, n_links, component_id, kept).

    Two vectors of the same length are linked if their cosine, in double precision, is at least
    ``threshold``. Links to other rows count once each, those to equal vectors too. Null, empty and zero
    vectors and those with null or non-finite components link with nothing and are kept. A vec_id that
    comes twice is two rows; a row without vec_id links as any other, its component is named by the
    smallest vec_id there is, and null if there is none. Other columns are not read; no rows give none.
    """
    usable = F.coalesce(
        (F.size("v") > 0) & ~F.exists("v", lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf"))) & F.exists("v", lambda x: x != 0), F.lit(False))
    rows = vectors.select("vec_id", F.col("embedding").cast("array<double>").alias("v")).withColumn("usable", usable)
    key = F.unhex(F.sha2(F.concat_ws(",", F.transform("v", lambda x: (x + 0.0).cast("string"))), 256))
    rows = stored(rows.select("vec_id", F.when(F.col("usable"), key).alias("cls"), F.when(F.col("usable"), F.col("v")).alias("v")), "vectors")
    classes = stored(rows.where("cls is not null").groupBy("cls").agg(F.min("vec_id").alias("least"), F.count(F.lit(1)).alias("weight"), F.first("v").alias("v")), "vector-classes")
    bits, tables = plan(classes.count(), threshold, miss)

    def place(batches):
        for batch in batches:
            sizes = batch.column("v").value_lengths().to_numpy()
            for dim in np.unique(sizes):
                part = batch.take(pa.array(np.flatnonzero(sizes == dim)))
                x = scaled(part.column("v").flatten().to_numpy().reshape(-1, dim))
                for t in range(tables):
                    number = (np.int64(t) << 40) + buckets_of(x, t, bits)
                    yield pa.RecordBatch.from_arrays([part.column("cls"), pa.array(np.full(len(x), dim), pa.int32()), pa.array(number)], ["cls", "dim", "bucket"])

    placed = classes.select("cls", "v").mapInArrow(place, "cls binary, dim int, bucket long")
    sizes = placed.groupBy("dim", "bucket").agg(F.count(F.lit(1)).alias("size")).where("size > 1")
    # a block of a large bucket meets every block once: its rows go to one group for each other block
    members = placed.join(sizes, ["dim", "bucket"]).withColumn("blocks", F.ceil(F.col("size") / BLOCK).cast("int")).withColumn(
        "own", F.pmod(F.xxhash64("cls"), F.col("blocks")).cast("int"))
    dealt = members.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1))).select(
        "cls", "dim", "bucket", F.least("own", "other").alias("i"), F.greatest("own", "other").alias("j"), "own")
    parts = max(1, int(vectors.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    full = dealt.join(classes.select("cls", "v", "weight"), "cls").repartition(parts, "dim", "bucket", "i", "j").sortWithinPartitions("dim", "bucket", "i", "j")

    def compare(batches):
        for table in _runs(batches, ["dim", "bucket", "i", "j"]):
            dim, number, i, j, own = (table.column(c).to_numpy() for c in ("dim", "bucket", "i", "j", "own"))
            keys, weight = table.column("cls").to_pylist(), table.column("weight").to_numpy()
            starts = np.flatnonzero(np.concatenate(([True], (number[1:] != number[:-1]) | (dim[1:] != dim[:-1]) | (i[1:] != i[:-1]) | (j[1:] != j[:-1]))))
            ends = np.append(starts[1:], len(keys))
            offsets = table.column("v").combine_chunks().offsets.to_numpy() if table.num_rows else []
            values = table.column("v").combine_chunks().values.to_numpy()
            left, right = [], []
            for s, e in zip(starts.tolist(), ends.tolist(), strict=True):
                if e - s < 2:
                    continue
                x = scaled(values[offsets[s] : offsets[e]].reshape(e - s, -1))
                norm = np.sqrt((x * x).sum(axis=1))
                if i[s] == j[s]:
                    p = q = np.arange(e - s)
                else:
                    p, q = np.flatnonzero(own[s:e] == i[s]), np.flatnonzero(own[s:e] == j[s])
                close = (x[p] @ x[q].T) >= threshold * norm[p][:, None] * norm[q] * (1 - 1e-12)
                a, b = np.nonzero(np.triu(close, 1) if i[s] == j[s] else close)
                if not len(a):
                    continue
                a, b = p[a], q[b]
                exact = (x[a] * x[b]).sum(axis=1) / (norm[a] * norm[b]) >= threshold
                a, b = a[exact], b[exact]
                for t in range(int(number[s] >> 40)):  # met before in table t
                    if not len(a):
                        break
                    seen = buckets_of(x, t, bits)
                    new = seen[a] != seen[b]
                    a, b = a[new], b[new]
                left.append(a + s)
                right.append(b + s)
            if left and sum(map(len, left)):
                a, b = np.concatenate(left), np.concatenate(right)
                n = np.bincount(a, weight[b], len(keys)) + np.bincount(b, weight[a], len(keys))
                node, root = spanning(len(keys), a, b)
                at = np.flatnonzero(n)
                yield _out([keys[k] for k in at], [None] * len(at), n[at].astype(np.int64))
                yield _out([keys[k] for k in node], [keys[k] for k in root], np.zeros(len(node), np.int64))

    found = stored(full.select("cls", "dim", "bucket", "i", "j", "own", "v", "weight").mapInArrow(compare, "a binary, b binary, n long"), "vector-links")
    counts = found.where("b is null").groupBy("a").agg(F.sum("n").alias("n")).withColumnRenamed("a", "cls")
    roots = components(found.where("b is not null")).withColumnRenamed("node", "cls")
    named = classes.select("cls", "least", "weight").join(counts, "cls", "left").join(roots, "cls", "left").withColumn("root", F.coalesce("root", "cls"))
    smallest = named.groupBy("root").agg(F.min("least").alias("component_id"))
    facts = named.join(smallest, "root").select("cls", (F.col("weight") - 1 + F.coalesce("n", F.lit(0))).alias("n_links"), "component_id")
    out = rows.select("vec_id", "cls").join(facts, "cls", "left").select(
        "vec_id", F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"),
        F.when(F.col("cls").isNull(), F.col("vec_id")).otherwise(F.col("component_id")).cast("long").alias("component_id"))
    return out.withColumn("kept", F.coalesce(F.col("vec_id") == F.col("component_id"), F.col("component_id").isNull()))


def _out(a: list, b: list, n: np.ndarray) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(a, pa.binary()), pa.array(b, pa.binary()), pa.array(n)], ["a", "b", "n"])


def _runs(batches, by: list[str], least: int = 4_000):
    """Tables of whole groups of ``by``, of about ``least`` rows where groups are small."""
    held: list[pa.RecordBatch] = []
    rows = 0
    last = None
    for batch in batches:
        if not batch.num_rows:
            continue
        columns = [batch.column(c).to_numpy() for c in by]
        first, end = tuple(c[0] for c in columns), tuple(c[-1] for c in columns)
        if held and rows >= least and first != last:
            yield pa.Table.from_batches(held)
            held, rows = [], 0
        if rows + batch.num_rows >= least and first != end:
            change = np.flatnonzero(np.any([c[1:] != c[:-1] for c in columns], axis=0))[-1] + 1
            held.append(batch.slice(0, change))
            yield pa.Table.from_batches(held)
            held, rows = [batch.slice(change)], batch.num_rows - change
        else:
            held.append(batch)
            rows += batch.num_rows
        last = end
    if held:
        yield pa.Table.from_batches(held)
