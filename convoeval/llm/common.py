"""Helpers of the corpus operators: work folders, column checks, byte tables, components."""

from __future__ import annotations

import uuid

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from convoeval.session import checkpoint_dir

#: A-Z and a-z, for lower-casing ASCII letters alone.
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"

#: White space of the corpus contracts: space and the five controls 09-0D.
BLANKS = " \t\n\x0b\x0c\r"


def ascii_lower(text: Column) -> Column:
    return F.translate(text, UPPER, LOWER)


def work_folder(spark: SparkSession, name: str) -> str:
    """A new folder below the shared checkpoint folder, for tables an operator reads several times."""
    return f"{checkpoint_dir(spark).rstrip('/')}/{name}-{uuid.uuid4().hex}"


def stored(df: DataFrame, name: str) -> DataFrame:
    """``df`` written to a work folder and read from there: lineage ends, columns stay prunable."""
    folder = work_folder(df.sparkSession, name)
    df.write.parquet(folder)
    return df.sparkSession.read.schema(df.schema).parquet(folder)


def slices(batches, column: str, size: int = 2 << 20):
    """Arrow batches cut so that ``column`` has about ``size`` bytes in each.

    What Python holds of a batch at a time is then bounded by ``size``, or by one row. At the end
    freed Arrow memory goes back to the system, as a worker lives on for other tasks.
    """
    for batch in batches:
        step = max(1, batch.num_rows * size // max(1, batch.column(column).nbytes))
        for at in range(0, batch.num_rows, step):
            yield batch.slice(at, step)
    pa.default_memory_pool().release_unused()


def word_bytes() -> bytes:
    """A table for ``bytes.translate``: A-Z to a-z, other ASCII that is no letter or digit to a space.

    Bytes of 80 and above stay, so UTF-8 text keeps its other letters. The words of the corpus
    contracts are then what ``bytes.split`` returns.
    """
    table = bytearray(range(256))
    for i in range(128):
        c = chr(i)
        table[i] = ord(c.lower()) if c.isalnum() else 32
    return bytes(table)


def components(edges: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """Connected components of ``edges(a, b)``: one row (node, root) for each node that has an edge.

    ``root`` is the smallest node of the component. Each round hangs every node on its smallest
    neighbour, shortens the chains twice and contracts the edges, so rounds grow with the logarithm
    of a component's diameter. All steps are grouped minima and equi joins; each round's tables are
    written, so a lost executor costs one round at most. Null ends are no edges.
    """
    live = stored(
        edges.select(F.col(a).alias("a"), F.col(b).alias("b")).where("a <> b").distinct(), "edges"
    )
    nodes = maps = None
    while not live.isEmpty():
        both = live.select(F.col("a").alias("node"), F.col("b").alias("near")).unionAll(
            live.select(F.col("b").alias("node"), F.col("a").alias("near"))
        )
        up = both.groupBy("node").agg(F.min("near").alias("near")).select("node", F.least("node", "near").alias("root"))
        step = stored(_jump(_jump(up)), "hang")
        maps = step if maps is None else stored(_follow(maps, step), "roots")
        nodes = maps
        live = stored(
            live.join(step.select(F.col("node").alias("a"), F.col("root").alias("ra")), "a")
            .join(step.select(F.col("node").alias("b"), F.col("root").alias("rb")), "b")
            .where("ra <> rb").select(F.col("ra").alias("a"), F.col("rb").alias("b")).distinct(),
            "edges",
        )
    if nodes is None:
        return live.select(F.col("a").alias("node"), F.col("a").alias("root"))
    return nodes


def _jump(up: DataFrame) -> DataFrame:
    return _follow(up, up)


def _follow(maps: DataFrame, step: DataFrame) -> DataFrame:
    """Roots of ``maps`` replaced by their own roots in ``step`` where they have one."""
    higher = step.select(F.col("node").alias("root"), F.col("root").alias("higher"))
    return maps.join(higher, "root", "left").select("node", F.coalesce("higher", "root").alias("root"))
