"""Memory edits replayed as a stream, for any order of arrival.

Ids do not influence each other, so the state is keyed by pages of (key, memory id),
with the latest ``seq`` seen of each. Edits are kept as facts, those that come after a later one
are marked; the current items are a small aggregation over the facts by ``seq``,
so they are the same whichever files come first. Segments of facts are merged in
levels, without the facts that no later edit can bring back.
"""

from __future__ import annotations

import json
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle, StreamingQuery

from convoeval.operators.memory import apply_operations, complete
from convoeval.sources.writers import batch_writer
from convoeval.streaming.segments import add_segment, read_segments

ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
PAGE = T.StructType([T.StructField("page", T.IntegerType())])
STATE = T.StructType([T.StructField("last_seqs", T.StringType())])
NONE = -1
FACT_COLUMNS = ["key", "memory_id", "operation", "seq", "content", "mentioned_at", "late"]
#: Ids are dealt to pages, pages to groups. Fixed, as the state of a running stream is kept by them.
PAGES, GROUPS = 2048, 128


class EditProcessor(StatefulProcessor):
    """The ids of one group: every edit as a fact, late ones marked.

    Each group and each question to the state costs milliseconds, so ids share groups and pages of
    ``{id: last seq}``; a batch reads and writes the pages of its own ids only.
    """

    def init(self, handle: StatefulProcessorHandle) -> None:
        self._state = handle.getMapState("edits", PAGE, STATE)

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        before: dict[int, dict[str, int]] = {}
        newest: dict[int, dict[str, int]] = {}
        for pdf in rows:
            last = {}
            for (page, i), seq in pdf.groupby(["page", "id"])["seq"].max().items():
                if page not in before:
                    held = self._state.getValue((int(page),))
                    before[page] = json.loads(held[0]) if held is not None else {}
                    newest[page] = {}
                last[i] = before[page].get(i, NONE)
                newest[page][i] = max(newest[page].get(i, last[i]), int(seq))
            yield pdf[["id", "operation", "seq", "content", "mentioned_at"]].assign(late=pdf["seq"] <= pdf["id"].map(last))
        for page, seqs in newest.items():
            self._state.updateValue((int(page),), (json.dumps(before[page] | seqs),))

    def close(self) -> None:
        pass


def edit_facts(edits: DataFrame) -> DataFrame:
    """Facts of an edit stream ``(key, seq, operation, target_id, content, mentioned_at)``."""
    id_type = f"key {dict(edits.dtypes)['key']}, memory_id string"
    # a TOUCH changes nothing, so it need not reach the state
    ready = complete(edits).where("operation <> 'TOUCH'").select(
        F.to_json(F.struct("key", F.col("target_id").alias("memory_id"))).alias("id"), "seq", "operation", "content", "mentioned_at")
    paged = ready.withColumn("page", F.pmod(F.xxhash64("id"), F.lit(PAGES)).cast("int"))
    facts = paged.withColumn("part", F.col("page") % GROUPS).groupBy("part").transformWithStateInPandas(
        statefulProcessor=EditProcessor(), outputStructType="id string, operation string, seq long, content string, mentioned_at string, late boolean",
        outputMode="Update", timeMode="None"
    )
    return facts.withColumn("_id", F.from_json("id", id_type)).select("_id.*", *FACT_COLUMNS[2:])


def condensed(facts: DataFrame) -> DataFrame:
    """The facts that can still matter, whatever edits of any ``seq`` may yet come.

    Per id: the last delete, the adds behind it and the last update. An add before a delete stays dead,
    and where the last update does not count no earlier one does.
    """
    at, verb = ["key", "memory_id"], F.col("operation")
    row = F.struct("operation", "seq", "content", "mentioned_at", "late")
    last = facts.where(verb.isin("DELETE", "UPDATE")).groupBy(*at, "operation").agg(F.max_by(row, F.col("seq")).alias("r"))
    cut = last.where(verb == "DELETE").select(*at, F.col("r.seq").alias("_cut"))
    adds = facts.where(verb == "ADD").join(cut, at, "left").where(F.col("_cut").isNull() | (F.col("seq") > F.col("_cut")))
    return adds.select(FACT_COLUMNS).unionByName(last.select(*at, "r.*").select(FACT_COLUMNS))


def start_memory(edits: DataFrame, path: str, checkpoint: str, fan: int = 8) -> StreamingQuery:
    """Writes the facts of each micro-batch as a segment; merged segments keep the facts that can still matter.

    Late edits are listed besides below ``path/late``. The operator needs the RocksDB state store. A query
    keeps the setting it starts with, so the session gets its own value back.
    """
    conf, name = edits.sparkSession.conf, "spark.sql.streaming.stateStore.providerClass"
    before = conf.get(name)
    late = batch_writer(f"{path}/late")

    def each(batch: DataFrame, number: int) -> None:
        batch = batch.persist()  # the state is asked once, its answer written twice
        late(batch.where("late").coalesce(1), number)
        add_segment(
            batch, number, path, lambda rows, place: rows.write.mode("overwrite").parquet(place),
            lambda rows, place: condensed(rows).write.mode("overwrite").parquet(place), fan)
        batch.unpersist()

    conf.set(name, ROCKSDB)
    try:
        return (
            edit_facts(edits).writeStream.outputMode("update").option("checkpointLocation", checkpoint)
            .trigger(availableNow=True).foreachBatch(each).start()
        )
    finally:
        conf.set(name, before)


def read_memory(spark: SparkSession, path: str) -> DataFrame:
    """Living items: the replay of the facts in the live segments, late ones at their place."""
    return apply_operations(read_segments(spark, path).drop("segment").withColumnRenamed("memory_id", "target_id"))


def late_edits(spark: SparkSession, path: str) -> DataFrame:
    """Edits that came in a later batch than a later one of the same id."""
    return spark.read.parquet(f"{path}/late").drop("batch")
