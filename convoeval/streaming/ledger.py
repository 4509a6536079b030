"""The running ledger kept up to date while transactions arrive."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from convoeval.operators.memory import ledger_titles
from convoeval.streaming.segments import add_segment, read_segments


def ledger_stream(tx: DataFrame, keys: list[str]) -> DataFrame:
    """Day and scene totals of a transaction stream.

    State is one row per key, day and scene. There is no watermark: a day stays
    open, as late transactions of any age count.
    """
    return tx.groupBy(*keys, "date", "scene").agg(
        F.sum("amount").alias("s"), F.count("*").alias("n"), F.max("amount").alias("m")
    )


def _newest(totals: DataFrame, keys: list[str]) -> DataFrame:
    """The totals of the latest batch for every key, day and scene."""
    group = [*keys, "date", "scene"]
    return totals.groupBy(*group).agg(F.max_by(F.struct("s", "n", "m", "batch"), F.col("batch")).alias("_t")).select(*group, "_t.*")


def start_ledger(tx: DataFrame, keys: list[str], path: str, checkpoint: str, fan: int = 8) -> StreamingQuery:
    """Writes the changed totals of each micro-batch as a segment; merged segments keep the newest totals only."""

    def each(batch: DataFrame, number: int) -> None:
        add_segment(
            batch.withColumn("batch", F.lit(number).cast("long")), number, path, lambda rows, place: rows.write.mode("overwrite").parquet(place),
            lambda rows, place: _newest(rows, keys).write.mode("overwrite").parquet(place), fan)

    return (
        ledger_stream(tx, keys).writeStream.outputMode("update").option("checkpointLocation", checkpoint)
        .trigger(availableNow=True).foreachBatch(each).start()
    )


def current_totals(spark: SparkSession, path: str, keys: list[str]) -> DataFrame:
    """The current table: one row per key, day and scene, read from the live segments only."""
    return _newest(read_segments(spark, path), keys).drop("batch")


def read_ledger(spark: SparkSession, path: str, keys: list[str]) -> DataFrame:
    """Titled values from the current table."""
    return ledger_titles(current_totals(spark, path, keys), keys)
