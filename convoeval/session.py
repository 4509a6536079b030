"""Session settings shared by the tests, the bench and batch jobs."""

from __future__ import annotations

import os
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def build_session(master: str | None = None, app: str = "convoeval", **conf: str) -> SparkSession:
    """A session with UTC, Arrow and adaptive execution on.

    On a cluster the master, memory, shuffle partitions and checkpoint folder
    come from spark-submit; ``master`` and ``conf`` are for local runs.
    """
    builder = (
        SparkSession.builder.appName(app)
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.adaptive.skewJoin.enabled", "true")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
        .config("spark.cleaner.referenceTracking.cleanCheckpoints", "true")
    )
    if master:
        builder = builder.master(master).config("spark.ui.enabled", "false")
    for key, value in conf.items():
        builder = builder.config(key, value)
    return builder.getOrCreate()


def checkpoint_dir(spark: SparkSession) -> str:
    """The shared checkpoint folder of the session.

    A cluster names it in ``spark.checkpoint.dir``. Only when that is unset and
    the session is local (tests) a temporary folder is used.
    """
    context = spark.sparkContext
    if context.getCheckpointDir():
        return context.getCheckpointDir()
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if not folder:
        if not context.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a shared folder on a cluster")
        folder = tempfile.mkdtemp(prefix="spark-", dir=os.environ.get("TMPDIR", "/tmp"))
    context.setCheckpointDir(folder)
    return context.getCheckpointDir()


def work_folder(spark: SparkSession, name: str) -> str:
    """A new folder below the shared checkpoint folder."""
    return f"{checkpoint_dir(spark).rstrip('/')}/{name}-{uuid.uuid4().hex}"


def cut_lineage(df: DataFrame) -> DataFrame:
    """Write ``df`` to the reliable checkpoint folder and read it from there."""
    checkpoint_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def few(df: DataFrame, most: int = 1 << 20) -> DataFrame:
    """``df``, which is cheap to count, marked for a broadcast where it has at most ``most`` rows.

    The size of a written frame is not known to Spark, so that a join with it would shuffle the large side.
    """
    return F.broadcast(df) if df.limit(most + 1).count() <= most else df


def spread(df: DataFrame, split: int = 1 << 24) -> DataFrame:
    """``df`` over all cores when its input has fewer splits than there are cores.

    For work that is heavy per row, on a table as it is read. The size comes from the
    file listing: no job runs, and an input of more than ``split`` bytes a core is
    left as it is, so nothing large is ever shuffled.
    """
    cores = df.sparkSession.sparkContext.defaultParallelism
    size = int(str(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))
    return df.repartition(cores) if size < cores * split else df


def by_key(df: DataFrame, *keys: str) -> DataFrame:
    """``df`` shuffled by key into the full number of shuffle partitions.

    For Python work per key: a shuffle without a number would be merged by its
    bytes into few tasks, although the work per byte is high.
    """
    n = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return df.repartition(n, *keys)


def gathered(df: DataFrame, *keys: str) -> DataFrame:
    """``by_key`` for ``mapInPandas`` and its like, which ask nothing of how rows lie.

    Behind a join on the same keys Spark takes a shuffle by them for done; if the join then turns into a
    broadcast, rows are read where they were written and a key lies in several tasks. The hash of the keys is
    no key of the join, so this shuffle stays.
    """
    n = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return df.repartition(n, F.xxhash64(*keys))
