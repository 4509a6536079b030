"""Writers. Batch writes are idempotent per task, agent or batch."""

from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def write_canonical(samples: DataFrame, path: str, rebuild: bool = False, by: list[str] | None = None) -> None:
    """Normalised samples once: an existing table is kept unless ``rebuild``."""
    writer = samples.write.mode("overwrite" if rebuild else "ignore")
    (writer.partitionBy(*by) if by else writer).parquet(path)


def append_results(results: DataFrame, path: str, done: DataFrame | None = None) -> None:
    """Appends result lines, one a question.

    Questions that the target or ``done`` already hold are not written again, and of
    several lines of a batch for one question one is kept, so a repeated call
    changes nothing.
    """
    schema = f"qid {dict(results.dtypes)['qid']}"
    try:
        held = results.sparkSession.read.schema(schema).json(path)
    except AnalysisException as missing:
        if missing.getCondition() != "PATH_NOT_FOUND":
            raise
        held = results.sparkSession.createDataFrame([], schema)
    if done is not None:
        held = held.unionByName(done.select("qid"))
    results.dropDuplicates(["qid"]).join(held, "qid", "left_anti").write.mode("append").json(path)


def write_training(rows: DataFrame, path: str) -> None:
    rows.write.mode("overwrite").parquet(path)


def write_report(report: DataFrame, path: str, form: str = "csv") -> None:
    """A report table. It has the size of agents x tasks, so one file is enough."""
    writer = report.repartition(1).write.mode("overwrite")
    writer.option("header", True).csv(path) if form == "csv" else writer.parquet(path)


def write_chunks(chunks: DataFrame, path: str, corpus: str) -> None:
    """Chunk records as JSON and, made from those, as readable text; both next to each other."""
    chunks.write.mode("overwrite").json(f"{path}/json")
    need = [corpus, "chunk_id", "start_time", "end_time", "text"]
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in chunks.select(*need).schema.fields)
    written = chunks.sparkSession.read.schema(schema).json(f"{path}/json")
    head = F.concat_ws(
        " ", F.lit("=== chunk"), F.col(corpus).cast("string"), F.col("chunk_id").cast("string"),
        F.col("start_time"), F.lit("-"), F.col("end_time"), F.lit("==="),
    )
    written.select(F.concat(head, F.lit("\n"), "text", F.lit("\n")).alias("value")).write.mode("overwrite").text(
        f"{path}/text"
    )


def write_category_store(store: DataFrame, path: str) -> None:
    """Replaces only the categories that are in ``store``, partition by partition."""
    (
        store.write.mode("overwrite").option("partitionOverwriteMode", "dynamic")
        .partitionBy("character", "category").parquet(path)
    )


def batch_writer(path: str):
    """``foreachBatch`` sink: a replayed batch overwrites its own folder."""

    def write(batch: DataFrame, batch_id: int) -> None:
        batch.write.mode("overwrite").parquet(f"{path}/batch={batch_id}")

    return write
