"""A table that grows by batches and is read from a bounded number of segments.

Each micro-batch writes one segment of level 0. Where ``fan`` segments of a level have come together they are
merged into one of the next level, so after n batches at most (fan - 1) log n segments are live. What is live
stands in a list that is written after the segments, in one of two places in turn: a reader finds a whole list
at any time, and a batch that runs again starts from the list before it.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

LIST = "version long, segment string, level int, number long"


def _lists(spark: SparkSession, path: str) -> list:
    rows = []
    for place in (0, 1):
        try:
            rows += spark.read.schema(LIST).parquet(f"{path}/live/place{place}").collect()  # a few rows each
        except AnalysisException as missing:
            if missing.getCondition() != "PATH_NOT_FOUND":
                raise
    return rows


def live_segments(spark: SparkSession, path: str, before: int | None = None) -> list[tuple[str, int, int]]:
    """(name, level, number) of the segments of the newest list, or of the newest one older than batch ``before``."""
    rows = [r for r in _lists(spark, path) if before is None or r["version"] < before]
    newest = max((r["version"] for r in rows), default=None)
    return sorted(((r["segment"], r["level"], r["number"]) for r in rows if r["version"] == newest and r["segment"] is not None), key=lambda s: s[2])


def segment_path(path: str, name: str) -> str:
    return f"{path}/segments/segment={name}"


def read_segments(spark: SparkSession, path: str, names: list[str] | None = None) -> DataFrame:
    """Rows of the live segments, with the columns ``segment`` (its name) and those of its folders."""
    names = [s[0] for s in live_segments(spark, path)] if names is None else names
    return spark.read.option("basePath", f"{path}/segments").parquet(*[segment_path(path, n) for n in names])


def add_segment(
    batch: DataFrame, batch_id: int, path: str, write: Callable[[DataFrame, str], None],
    merge: Callable[[DataFrame, str], None], fan: int = 8,
) -> None:
    """``write`` puts ``batch`` at a path, ``merge`` puts the rows of several segments at one."""
    spark = batch.sparkSession
    live = live_segments(spark, path, batch_id)
    name = f"b{batch_id}-0"
    write(batch, segment_path(path, name))
    live.append((name, 0, batch_id << 8))
    level = 0
    while len(full := [s for s in live if s[1] == level]) >= fan:
        name = f"b{batch_id}-{level + 1}"
        merge(read_segments(spark, path, [s[0] for s in full]), segment_path(path, name))
        live = [s for s in live if s[1] != level] + [(name, level + 1, (batch_id << 8) + level + 1)]
        level += 1
    spark.createDataFrame([(batch_id, *s) for s in live], LIST).coalesce(1).write.mode("overwrite").parquet(f"{path}/live/place{batch_id % 2}")


def drop_dead_segments(spark: SparkSession, path: str) -> int:
    """Deletes segments that neither list names; only while no stream writes to ``path``. Returns their number."""
    named = {r["segment"] for r in _lists(spark, path)}
    folder = spark._jvm.org.apache.hadoop.fs.Path(f"{path}/segments")
    files = folder.getFileSystem(spark._jsc.hadoopConfiguration())
    dead = [s.getPath() for s in files.listStatus(folder) if s.getPath().getName().removeprefix("segment=") not in named]
    return sum(bool(files.delete(p, True)) for p in dead)


def segment_number(spark: SparkSession, path: str) -> Column:
    """Number of a row's segment among the live ones, from its name."""
    numbers = {name: i for i, (name, _, _) in enumerate(live_segments(spark, path))}
    return F.element_at(F.create_map(*[F.lit(x) for pair in numbers.items() for x in pair]), F.col("segment"))
